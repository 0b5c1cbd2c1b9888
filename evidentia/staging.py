"""Tables written to the cluster's shared folder, to cut lineage and share intermediate results."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no shared folder and everything runs on one machine (tests).
_OWN: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_INSIDE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, a temporary one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="evidentia-"))
    return _OWN[0]


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that run inside go as soon as these have ended, as nothing reads them any more."""
    with _LOCK:  # threads may write at once; the first one's setting is put back by the last
        _INSIDE.append(_INSIDE[0] if _INSIDE else spark.conf.get(_CLEANUP, "false"))
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            before = _INSIDE.pop()
            if not _INSIDE:
                spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; others are left alone."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: Rows that are broadcast at most (of a few short columns each); a larger side is shuffled.
BROADCAST = 1_000_000


def fit(df: DataFrame) -> DataFrame:
    """``df`` (a staged table or one that is cheap to count) marked for broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a like one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def widened(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])
