"""Incremental builds as a stream of micro-batches over arriving files, with the batch operators inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, folder: str, schema: T.StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, files: int = 100) -> StreamingQuery:
    """Feed Parquet files that arrive in ``folder`` to ``apply`` (rows, batch number), each once, and stop when none is left.

    apply computes and writes a table's next version from the rows; named by the batch number, a repeated batch replaces
    what it wrote before, which makes a restart safe.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed(rows: DataFrame, key: str, text: str, late: str, ts: str = "loaded_at") -> DataFrame:
    """A stream's rows without repeats of the same key and text within the watermark."""
    own = rows.withWatermark(ts, late).withColumn("_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    return own.dropDuplicatesWithinWatermark([key, "_hash"]).drop("_hash")
