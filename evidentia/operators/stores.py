"""The layers as tables of a lake: what may be stored, and the jobs that write them, each in one transaction.

Racing writers of the same tables come out as if one had followed the other (see ``evidentia.sources.lake``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schemas
from evidentia.operators import jobs, layers
from evidentia.sources.lake import Check, Constraint, Foreign, Lake, Transaction, Unique
from evidentia.staging import discard, fit, stage

DOCUMENTS, PAGES, CHUNKS, EMBEDDINGS, TREES = "documents", "pages", "chunks", "embeddings", "trees"
#: Parts that embeddings are dealt to by a hash of the chunk; each is committed by itself.
PARTS = 16
#: Document ids of a range that is sorted in itself.
RANGE = 4_096


def _present(*columns: str) -> list[Constraint]:
    return [Check(f"{c} is missing", f"{c} is not null") for c in columns]


def _hex(column: str) -> Check:
    return Check(f"{column} is no lower-case hash", f"{column} rlike '\\\\A[0-9a-f]{{64}}\\\\z'")


def constraints(dimension: int = 1024) -> dict[str, list[Constraint]]:
    """What the tables' rows must obey; ``dimension``: of the vectors."""
    return {
        DOCUMENTS: [
            *_present("document_id", "document_name", "file_name", "file_type", "full_text"),
            Unique("document_id repeats", ("document_id",)), Unique("document_name repeats", ("document_name",)), Unique("file_hash repeats", ("file_hash",)),
        ],
        PAGES: [
            *_present("document_id", "page_number", "page_text", "page_char_length"), Check("page_number below 1", "page_number > 0"),
            Check("page_char_length below 0", "page_char_length >= 0"), Unique("page repeats", ("document_id", "page_number")),
            Foreign("page without document", ("document_id",), DOCUMENTS),
        ],
        CHUNKS: [
            *_present("chunk_id", "document_id", "document_name", "chunk_order", "chunk_text"),
            Check("page range", "(page_start is null and page_end is null) or coalesce(page_start > 0 and page_end >= page_start, false)"),
            Unique("chunk_id repeats", ("chunk_id",)), Unique("chunk_order repeats", ("document_id", "chunk_order")),
            Foreign("chunk without document", ("document_id",), DOCUMENTS),
        ],
        EMBEDDINGS: [
            *_present("chunk_id", "chunk_hash", "embedding_input_hash", "model_id", "model_version", "embedding"), _hex("chunk_hash"), _hex("embedding_input_hash"),
            Check("dimension", f"size(embedding) = {dimension}"), Check("element is missing or not finite", "forall(embedding, x -> coalesce(abs(x) < double('infinity'), false))"),
            Unique("embedding repeats", ("chunk_id", "model_id")), Foreign("embedding without chunk", ("chunk_id",), CHUNKS),
        ],
    }


def create(lake: Lake) -> None:
    """Make the tables that aren't there yet, empty; existing ones stay as they are."""
    trees = schemas.columns("document_id int, input_root string, chunk_root string")
    kinds = {DOCUMENTS: schemas.BRONZE_DOCUMENTS, PAGES: schemas.BRONZE_PAGES, CHUNKS: schemas.SILVER_CHUNKS, EMBEDDINGS: schemas.GOLD_EMBEDDINGS, TREES: trees}

    def work(t: Transaction) -> None:
        for name, kind in kinds.items():
            if not t.has(name):
                t.write(name, lake.spark.createDataFrame([], kind))

    lake.transact(work, "create")


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns: cast, in order; null where ``df`` has none."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def store_documents(lake: Lake, documents: DataFrame, pages: DataFrame) -> int:
    """Store documents (by document_name, without ids) and their pages (document_name, page_number, page_text), all or none."""
    rules = constraints()

    def work(t: Transaction) -> None:
        old = t.table(DOCUMENTS)
        new = fitted(documents, schemas.BRONZE_DOCUMENTS).withColumn("loaded_at", F.coalesce("loaded_at", F.localtimestamp())).drop("document_id")
        t.write(DOCUMENTS, fitted(layers.upsert_documents(old, new), schemas.BRONZE_DOCUMENTS), rules[DOCUMENTS])
        ids = t.table(DOCUMENTS).select("document_id", "document_name")
        own = pages.join(fit(ids), "document_name").withColumns({"page_char_length": F.length("page_text"), "loaded_at": F.localtimestamp()})
        t.write(PAGES, layers.upsert_pages(t.table(PAGES), fitted(own, schemas.BRONZE_PAGES)), rules[PAGES])

    return lake.transact(work, "store documents")


def _with_ids(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Numbers for chunks that have none, after the largest one that is stored, in order of document and chunk.

    Chunks of a document are numbered from 1, so only documents are sorted, in ranges of ids, and no chunk is exchanged.
    """
    known, new = chunks.filter("chunk_id is not null"), chunks.filter("chunk_id is null").drop("chunk_id")
    most = stored.agg(F.coalesce(F.max("chunk_id"), F.lit(0)).alias("_most"))
    last = new.groupBy("document_id").agg(F.max("chunk_order").cast("long").alias("_last"))
    last = stage(last.withColumn("_range", F.floor(F.col("document_id") / RANGE)), "last")
    before = lambda n, order: F.sum(n).over(order) - F.col(n)
    ranges = last.groupBy("_range").agg(F.sum("_last").alias("_all"))
    ranges = ranges.select("_range", before("_all", W.orderBy("_range")).alias("_before"))
    starts = last.withColumn("_start", before("_last", W.partitionBy("_range").orderBy("document_id"))).join(F.broadcast(ranges), "_range")
    starts = stage(starts.select("document_id", (F.col("_before") + F.col("_start")).alias("_start")), "starts")
    new = new.join(fit(starts), "document_id", "left").crossJoin(F.broadcast(most))  # one row
    return known.unionByName(new.withColumn("chunk_id", (F.col("_most") + F.col("_start") + F.col("chunk_order")).cast("int")).select(*chunks.columns))


def _silver(t: Transaction, wanted: DataFrame, rules: dict, **how) -> None:
    stored = t.table(CHUNKS)
    built = jobs.build_silver(wanted, t.table(DOCUMENTS), t.table(PAGES), stored, trees=t.table(TREES), **how)
    t.write(TREES, built.trees.select("document_id", "input_root", "chunk_root"), [Unique("document repeats", ("document_id",))])
    names = t.table(DOCUMENTS).select("document_id", F.col("document_name").alias("_name"))
    table = fitted(built.table, schemas.SILVER_CHUNKS).join(fit(names), "document_id", "left")
    table = table.withColumns({"document_name": F.coalesce("document_name", "_name"), "created_at": F.coalesce("created_at", F.localtimestamp())})
    t.write(CHUNKS, _with_ids(fitted(table, schemas.SILVER_CHUNKS), stored), rules[CHUNKS])
    # a rebuilt chunk has a new id; embeddings of the old one go with it
    gone = t.table(EMBEDDINGS).join(t.table(CHUNKS).select("chunk_id"), "chunk_id", "left_semi")
    t.write(EMBEDDINGS, fitted(gone, schemas.GOLD_EMBEDDINGS), rules[EMBEDDINGS])
    discard(built.rows)


def _embedded(rows: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    made = embed(rows)
    return made.withColumns({"embedding_dimension": F.size("embedding"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()})


def build_silver(lake: Lake, wanted: DataFrame, dimension: int = 1024, **how) -> int:
    """Chunks of the wanted documents, without embeddings of chunks that are gone, in one commit (see ``jobs.build_silver``).

    The hash trees of each build are stored with it, so the next one parses changed documents only.
    """
    return lake.transact(lambda t: _silver(t, wanted, constraints(dimension), **how), "build silver")


def build_layers(lake: Lake, wanted: DataFrame, model_id: str, model_version: str, embed: Callable[[DataFrame], DataFrame], dimension: int = 1024, **how) -> int:
    """Silver and Gold in one commit: a build that fails at either leaves readers on the pair before."""

    def work(t: Transaction) -> None:
        rules = constraints(dimension)
        _silver(t, wanted, rules, **how)
        built = jobs.build_gold(t.table(CHUNKS), t.table(EMBEDDINGS), model_id, model_version, lambda rows: _embedded(rows, embed))
        t.write(EMBEDDINGS, fitted(built.table, schemas.GOLD_EMBEDDINGS), rules[EMBEDDINGS])

    return lake.transact(work, "build layers")


def build_gold(lake: Lake, model_id: str, model_version: str, embed: Callable[[DataFrame], DataFrame], dimension: int = 1024, parts: int = PARTS) -> list[int]:
    """Embeddings part by part, each part of the chunks (by a hash of their ids) with its own commit; the commits' numbers.

    A job that has died goes on where it stopped: what is committed isn't pending any more, so no model is asked twice for
    it. A part without pending chunks is left alone.
    """
    rules, done = constraints(dimension), []
    own = F.pmod(F.xxhash64("chunk_id"), F.lit(parts))
    names = [f"{k:05d}-of-{parts:05d}" for k in range(parts)]

    def dealt(t: Transaction) -> None:
        if t.parts(EMBEDDINGS) != set(names):
            rows = t.table(EMBEDDINGS)
            for k, name in enumerate(names):
                t.write(EMBEDDINGS, rows.filter(own == k), part=name)
            for other in t.parts(EMBEDDINGS) - set(names):
                t.remove(EMBEDDINGS, other)

    lake.transact(dealt, f"deal embeddings to {parts} parts")
    for k, name in enumerate(names):

        def work(t: Transaction, k: int = k, name: str = name) -> None:
            built = jobs.build_gold(t.table(CHUNKS).filter(own == k), t.table(EMBEDDINGS).filter(own == k), model_id, model_version, lambda rows: _embedded(rows, embed))
            if not built.status.filter("status = 'embedded'").isEmpty():
                t.write(EMBEDDINGS, fitted(built.table, schemas.GOLD_EMBEDDINGS), rules[EMBEDDINGS], part=name)

        before = lake.snapshot().version
        if (version := lake.transact(work, f"embed part {name}")) != before:
            done.append(version)
    return done


def open_lake(spark: SparkSession, root: str) -> Lake:
    """The lake of a folder, with all tables."""
    lake = Lake(spark, root)
    create(lake)
    return lake
