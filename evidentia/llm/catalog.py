"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, dialogue, jaccard, language, mixing, nearest, pieces, quality, ranked, shards, suffixlm, toxicity, urls
from evidentia.llm.staging import table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary; the file is read by every worker."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def documents(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), keep=remainder(5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir), vocabulary()).drop("text")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


#: All pairs that share a shingle, counted; components by following links. For small tables.
OP4_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, CAST(len(w) AS BIGINT) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM words WHERE len(w) > 0),
 sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
 links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.a JOIN sizes n ON n.doc_id = p.b WHERE 100 * shared >= 75 * (m.n + n.n - shared)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(b) FROM reach r WHERE r.a = d.doc_id) AS component_id, (SELECT count(*) FROM links l WHERE l.a = d.doc_id) AS n_links FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(documents(spark, sf_dir, "lang"), keep=remainder(3) != 1)
    found = language.predict(documents(spark, sf_dir), model)
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op6_suffixlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlm.score(documents(spark, sf_dir), remainder(7) != 2)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.shard(documents(spark, sf_dir), 16)
    # both are taken from the text that has reached the shard
    landed = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(landed) + 1).cast("long")
    found = found.withColumn("size", F.when(F.col("size") == size, size).otherwise(F.raise_error(F.lit("op7_shards: a text changed on its way"))))
    return found.select("doc_id", "size", F.crc32(landed).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).drop("text")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", "text"))


#: All postings joined with all terms of items. For small tables.
OP11_SQL = r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
 asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL), sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY ALL),
 whole AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 q AS (SELECT item_id, term, count(*) AS r FROM asked GROUP BY ALL),
 scored AS (SELECT q.item_id, tf.doc_id, CAST(sum(q.r * CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id) CROSS JOIN whole GROUP BY ALL),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.repair_all(dialogue.damage(rows), rows)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_urls, op2_toxicity, op3_bpe, op4_jaccard, op5_language, op6_suffixlm, op7_shards, op8_mixing, op9_quality, op10_nearest, op11_ranked, op12_dialogue, op13_pieces]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard": OP4_SQL, "op11_ranked": OP11_SQL}
