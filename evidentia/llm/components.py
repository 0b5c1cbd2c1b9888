"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.staging import discard, stage


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the smallest node reachable, the node itself included.

    Every round writes its edges to the shared folder; rounds grow with the logarithm of a component's size. Null ends
    and loops are left out.
    """
    edges = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    old: list[DataFrame] = [edges]
    for _ in range(most_rounds):
        # large star: every larger neighbour is linked with the smallest of a node's neighbours and itself
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: smaller neighbours and the node itself are linked with the smallest
        large = stage(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = stage(small, "edges")
        discard(*old, large)
        old = [edges]
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
