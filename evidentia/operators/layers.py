"""Writes as functions from tables to new tables: upserts, replacements and hash diffs.

File tables have no row-level writes, so each returns the table's next version; ``evidentia.sources.sinks`` writes it to a
new place and never to one that the plan reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidentia.operators.hashtree import digest
from evidentia.staging import fit, stage

#: Ranges that new rows are numbered in, and rows that their bounds are taken from, about.
RANGES = 64
SAMPLE = 4_096


def upsert_documents(target: DataFrame, source: DataFrame, key: str = "document_name", id: str = "document_id", hash: str = "file_hash", loaded_at: Column | None = None) -> DataFrame:
    """Rows of ``source`` (unique in ``key``) replace those of the same identity, keeping their id; others get new ids.

    New ids follow the largest one in order of the key. Nothing is returned, but ValueError raised, if ``source`` has a key
    twice, a name has more than one identity in ``target``, or another document of ``target`` owns a hash. loaded_at: when the rows were
    written, for a column of that name of ``target``.
    """
    twice = source.groupBy(key).count().filter("count > 1").select(key, F.lit("key of several source rows").alias("problem"))
    found = conflicts(target, source, key, hash).unionByName(twice).orderBy(key, "problem").head(5)
    if found:
        raise ValueError("documents can't be stored: " + "; ".join(f"{r[key]}: {r['problem']}" for r in found))
    if loaded_at is not None:
        source = source.withColumn("loaded_at", loaded_at)
    columns = [c for c in target.columns if c != id]
    # rows are wide, so keys alone are numbered
    known = source.select(key).join(target.select(key, id), key, "left")
    most = target.agg(F.coalesce(F.max(id), F.lit(0)).alias("most"))
    new = numbered(known.filter(F.col(id).isNull()).drop(id), [key], "_n").crossJoin(F.broadcast(most))
    new = new.withColumn(id, (F.col("most") + F.col("_n")).cast(target.schema[id].dataType))
    ids = known.filter(F.col(id).isNotNull()).unionByName(new.select(*known.columns))
    ids = fit(stage(ids.withColumnRenamed(key, "_key"), "ids"))
    rest = target.join(source.select(key), key, "left_anti")
    return rest.select(id, *columns).unionByName(source.join(ids, source[key].eqNullSafe(ids["_key"])).select(id, *columns))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a number from 1 in the given order, without a window over all rows.

    Ranges of the first column are sorted and numbered in themselves, and the few counts of ranges give each its start. A
    row's range follows from its value alone (bounds come from a sample chosen by hash), so however often and wherever the
    plan computes it, it is the same.
    """
    first = F.col(order[0])
    total = df.count()
    some = df.select(first.alias("v")).filter(first.isNotNull())
    if total > SAMPLE:
        some = some.filter(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int(SAMPLE / total * (1 << 30)))
    values = sorted({r.v for r in some.limit(4 * SAMPLE).collect()})
    bounds = F.array(*[F.lit(v).cast(df.schema[order[0]].dataType) for v in values[:: max(1, len(values) // RANGES)][1:]])
    at = F.when(first.isNull(), F.lit(-1)).otherwise(F.size(F.filter(bounds, lambda x: x <= first))) if len(values) > 1 else F.lit(0)
    ranged = df.withColumn("_range", at)
    counts = ranged.groupBy("_range").count()
    starts = counts.select("_range", (F.sum("count").over(W.orderBy("_range")) - F.col("count")).alias("_start"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_own")).drop("_range", "_own", "_start")


def conflicts(target: DataFrame, source: DataFrame, key: str = "document_name", hash: str = "file_hash") -> DataFrame:
    """Source rows that can't be stored: several identities of one name in the target, or a hash that another one owns."""
    many = target.groupBy(key).count().filter("count > 1").select(key, F.lit("duplicate identity").alias("problem"))
    owner = target.select(F.col(key).alias("owner"), hash)
    owned = source.join(owner, hash).filter(F.col(key) != F.col("owner")).select(key, F.lit("hash of another document").alias("problem"))
    return source.select(key).join(many, key).unionByName(owned).distinct()


def upsert_pages(target: DataFrame, source: DataFrame, keys: tuple[str, ...] = ("document_id", "page_number"), doc: str = "document_id") -> DataFrame:
    """Pages of ``source`` replace those of the same number; a source document's pages beyond its last are removed."""
    last = source.groupBy(doc).agg(F.max(keys[1]).alias("_last"))
    kept = target.join(source.select(*keys), list(keys), "left_anti").join(last, doc, "left")
    kept = kept.filter(F.col("_last").isNull() | (F.col(keys[1]) <= F.col("_last"))).select(*target.columns)
    return kept.unionByName(source.select(*target.columns))


def replace_by(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """All target rows with the keys of any source row give way to the source."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source.select(*target.columns))


def update_metadata(target: DataFrame, changes: DataFrame, key: str = "document_name") -> DataFrame:
    """Values of ``changes`` that aren't null replace the target's, by key."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in own])
    rows = target.join(new, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in target.columns])


def chunk_status(old: DataFrame, new: DataFrame, columns: list[str], doc: str = "document_id", order: str = "chunk_order", dry_run: bool = False) -> DataFrame:
    """(document_id, status) of the documents of ``new``: unchanged if all chunks equal the stored ones, else (to be) rebuilt."""
    # hashes are compared, as chunks are long and all would be exchanged
    own = F.unhex(digest(*[F.col(c) for c in columns]))
    left = new.select(doc, order, own.alias("_new"))
    right = old.select(doc, order, own.alias("_old")).join(new.select(doc).distinct(), doc, "left_semi")
    both = left.join(right, [doc, order], "full_outer")
    other = F.max((~F.col("_new").eqNullSafe(F.col("_old"))).cast("int"))
    return both.groupBy(doc).agg(F.when(other == 1, "would_rebuild" if dry_run else "rebuilt").otherwise("unchanged").alias("status"))


def pending(silver: DataFrame, gold: DataFrame, model_id: str, model_version: str) -> DataFrame:
    """Chunks without a current embedding of the model version: none, or one of another chunk or input hash."""
    have = gold.filter((F.col("model_id") == model_id) & (F.col("model_version") == model_version))
    own = silver.withColumn("embedding_input_hash", F.sha2("chunk_text", 256))
    if have.isEmpty():  # a first build, whose texts need no exchange
        return own
    return own.join(have.select("chunk_id", "chunk_hash", "embedding_input_hash"), ["chunk_id", "chunk_hash", "embedding_input_hash"], "left_anti")


def stale(silver: DataFrame, gold: DataFrame) -> DataFrame:
    """Embeddings whose chunk is gone or has changed."""
    own = silver.select("chunk_id", F.col("chunk_hash").alias("_hash"), F.sha2("chunk_text", 256).alias("_input"))
    rows = gold.join(own, "chunk_id", "left")
    reason = F.when(F.col("_hash").isNull(), "chunk is gone").when(F.col("_hash") != F.col("chunk_hash"), "chunk has changed").when(F.col("_input") != F.col("embedding_input_hash"), "input has changed")
    return rows.withColumn("reason", reason).filter("reason is not null").select("chunk_id", "model_id", "model_version", "reason")


def selected_chunks(silver: DataFrame, documents: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Chunks to inspect: of the given documents, and the first ``limit`` by id (before any diff)."""
    rows = silver if documents is None else silver.filter(F.col("document_name").isin(documents))
    return rows if limit is None else rows.orderBy("chunk_id").limit(limit)
