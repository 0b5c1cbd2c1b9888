"""Pages of paged files as a Spark data source, for batch and stream: ``spark.read.format("pages")``.

Small files share a partition and the pages of large ones are dealt to several, so that work follows the bytes. No file is
opened to plan: a partition holds shares (i of n) of files, and the task that reads a share counts the file's pages itself.
Filters on ``file_name`` and bounds of ``page_number`` reach the source (with ``spark.sql.python.filterPushdown.enabled``);
what they exclude isn't opened, or not extracted.

Options: ``path`` (a folder), ``extractor`` (``module:name`` of an object with ``count`` and ``texts``, see ``FormFeed``),
``suffix`` (of file names, case aside; ``.pdf``), ``recursive`` and ``bytesPerPartition``.

As a stream the source takes each file once, in order of modification time and path; a file has to be complete when it
appears, with the time at which it appears (written elsewhere and copied, or renamed and touched).
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)
from pyspark.sql.types import StructType

from evidentia.sources.blobs import store

SCHEMA = "path string, file_name string, page_number int, page_text string, page_char_length int"
_ARROW = pa.schema([("path", pa.string()), ("file_name", pa.string()), ("page_number", pa.int32()), ("page_text", pa.string()), ("page_char_length", pa.int32())])
BYTES = 32 << 20
#: Characters of text that are sent on together.
CHARS = 8 << 20


class FormFeed:
    """Text files whose pages are parted by form feeds; the extractor that needs no library."""

    BLOCK = 1 << 20

    def count(self, file) -> int:
        n = 1
        while block := file.read(self.BLOCK):
            n += block.count(b"\f")
        return n

    def texts(self, file, first: int, last: int) -> Iterator[str]:
        """Texts of the pages from ``first`` (0: the first of all) to before ``last``."""
        number, held = 0, []
        while number < last and (block := file.read(self.BLOCK)):
            *ended, rest = block.split(b"\f")
            for part in ended:
                if first <= number < last:
                    yield b"".join([*held, part]).decode()
                held = []
                number += 1
            if first <= number < last:
                held.append(rest)
        if first <= number < last:
            yield b"".join(held).decode()


class Pypdf:
    """PDF files, by the pypdf library where it is installed."""

    def _reader(self, file):
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ModuleNotFoundError("extracting PDF pages needs the pypdf library, or another extractor") from e
        return PdfReader(file)

    def count(self, file) -> int:
        return len(self._reader(file).pages)

    def texts(self, file, first: int, last: int) -> Iterator[str]:
        pages = self._reader(file).pages
        for k in range(first, min(last, len(pages))):
            yield pages[k].extract_text() or ""


form_feed, pypdf = FormFeed(), Pypdf()


@dataclass(frozen=True)
class Found:
    path: str
    size: int
    at: int  # nanoseconds


@dataclass
class Shares(InputPartition):
    """(path, i, n): the i-th of n shares of a file's pages."""

    own: list[tuple[str, int, int]]


def dealt(files: list[Found], most: int) -> list[Shares]:
    """Partitions of about ``most`` bytes: whole small files together, each share of a large one by itself."""
    out, held, size = [], [], 0
    for f in files:
        n = -(-f.size // most)
        if n > 1:
            out += [Shares([(f.path, i, n)]) for i in range(n)]
            continue
        if held and size + f.size > most:
            out.append(Shares(held))
            held, size = [], 0
        held.append((f.path, 0, 1))
        size += f.size
    return [*out, Shares(held)] if held else out


class _Pages:
    """What batch and stream share: listing, and reading of shares."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        if "path" not in options:
            raise ValueError("the option path names a folder of files")
        self.folder, self.suffix = options["path"], options.get("suffix", ".pdf").lower()
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.most = int(options.get("bytesperpartition", BYTES))
        self.extractor = options.get("extractor", f"{__name__}:pypdf")
        self.names: set[str] | None = None
        self.first, self.last = 0, 2**31

    def listed(self) -> list[Found]:
        where, path = store(self.folder)
        prefix = self.folder[: len(self.folder) - len(path)] if self.folder.endswith(path) else ""
        found = where.get_file_info(afs.FileSelector(path, recursive=self.recursive))
        rows = [Found(prefix + f.path, f.size, f.mtime_ns or 0) for f in found if f.type == afs.FileType.File and f.base_name.lower().endswith(self.suffix) and f.base_name[0] not in "._"]
        rows = [f for f in rows if self.names is None or f.path.rpartition("/")[2] in self.names]
        return sorted(rows, key=lambda f: (f.at, f.path))

    def extract(self, shares: Shares) -> Iterator[pa.RecordBatch]:
        module, _, name = self.extractor.partition(":")
        own = getattr(importlib.import_module(module), name)
        rows: list[tuple] = []
        chars = 0
        for path, i, n in shares.own:
            where, inside = store(path)
            first, last = 0, 2**31
            if n > 1:
                with where.open_input_file(inside) as file:
                    pages = own.count(file)
                first, last = pages * i // n, pages * (i + 1) // n
            first, last = max(first, self.first), min(last, self.last)
            if first >= last:
                continue
            with where.open_input_file(inside) as file:
                for k, text in enumerate(own.texts(file, first, last)):
                    rows.append((path, path.rpartition("/")[2], first + k + 1, text, len(text)))
                    chars += len(text)
                    if chars >= CHARS:
                        yield _batch(rows)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class PagesReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("file_name",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                names = set(f.value) if isinstance(f, In) else {f.value}
                self.names = names if self.names is None else self.names & names
            elif column == ("page_number",) and isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.value is not None:
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, f.value - (not isinstance(f, GreaterThan)))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Shares]:
        return dealt(self.listed(), self.most) or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        return self.extract(partition)


class PagesStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.listed()
        return {"at": found[-1].at, "path": found[-1].path} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Shares]:
        a, b = (start["at"], start["path"]), (end["at"], end["path"])
        return dealt([f for f in self.listed() if a < (f.at, f.path) <= b], self.most) or [Shares([])]

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        return self.extract(partition)

    def commit(self, end: dict) -> None:
        pass


class PagesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagesReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PagesStream(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, and let filters reach it."""
    spark.dataSource.register(PagesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
