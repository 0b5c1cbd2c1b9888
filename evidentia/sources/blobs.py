"""Files of any store that Arrow can open, for tasks that read them block by block."""

from __future__ import annotations

import urllib.parse

import pyarrow.fs as afs


def store(uri: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are local, ``s3a`` and ``s3n`` are ``s3``."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return afs.LocalFileSystem(), uri
    if scheme == "file":
        return afs.LocalFileSystem(), "/" + rest.lstrip("/")
    name = "s3" if scheme in ("s3a", "s3n") else scheme
    return afs.FileSystem.from_uri(f"{name}:{urllib.parse.quote(rest)}")


def opened(uri: str):
    """A seekable file of bytes."""
    where, path = store(uri)
    return where.open_input_file(path)
