"""Writers. A table's next version goes to a new folder; its readers switch when it is complete."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.text import spreadsheet_safe


def write_version(df: DataFrame, table: str, version: int) -> str:
    """Write the table's version; a job that fails leaves it without its marker file, so readers keep the one before."""
    path = f"{table}/version={version:08d}"
    df.write.mode("errorifexists").parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Overwrite only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A summary that spreadsheets open without running formulas: one header, values made safe."""
    rows = df.select(*[spreadsheet_safe(F.col(c).cast("string")).alias(c) for c in columns])
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


#: Columns of an evaluation's summary, in order.
SUMMARY = [
    "id", "status", "question", "expected_document", "vector_hit", "vector_top_k_hit", "reranked_hit", "first_vector_hit_rank",
    "first_reranked_hit_rank", "error_stage", "error",
]


def write_summary(records: DataFrame, path: str) -> None:
    """An evaluation's summary as one CSV file with a byte order mark, in order of id, in one step (questions are few)."""
    rows = records.select(*[spreadsheet_safe(F.col(c).cast("string")).alias(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY])
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(SUMMARY)
    writer.writerows(tuple(r) for r in rows.orderBy("id").collect())
    _replace(records.sparkSession, ("\ufeff" + out.getvalue()).encode(), path)


def evolved(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in a newer schema: columns that it lacks are null, types must be equal, and none may be lost."""
    have = {f.name: f.dataType for f in df.schema.fields}
    if lost := set(have) - set(schema.fieldNames()):
        raise ValueError(f"the new schema lacks {sorted(lost)}")
    if changed := [f.name for f in schema.fields if f.name in have and have[f.name] != f.dataType]:
        raise ValueError(f"the new schema changes the types of {changed}")
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    """A small JSON report in one step, so that no reader sees half of it or none."""
    _replace(spark, json.dumps(report, allow_nan=False, ensure_ascii=False, indent=2).encode(), path)


def _replace(spark: SparkSession, data: bytes, path: str) -> None:
    """Written beside its place and renamed over what is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    place, beside = hadoop.fs.Path(path), hadoop.fs.Path(path + ".part")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = place.getFileSystem(conf).create(beside, True)
    out.write(bytearray(data))
    out.close()
    context = hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).makeQualified(place).toUri(), conf)
    over = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    over[0] = hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(beside), context.makeQualified(place), over)
