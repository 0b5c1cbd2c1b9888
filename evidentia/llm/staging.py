"""Staged tables of the operators: those of the library; and memory of the driver."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

from evidentia.staging import BROADCAST, discard, fit, fresh, shared_dir, stage, table, widened

__all__ = ["BROADCAST", "discard", "fit", "fresh", "release", "shared_dir", "stage", "table", "widened"]


def release() -> None:
    """Give back to the system what numpy and Arrow have freed; the C library keeps it else."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
