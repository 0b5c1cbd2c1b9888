"""Mixing sources to target weights with soft memberships.

A classifier fitted on the labelled table predicts for every document the posterior of each domain: naive Bayes with normal
densities of a few text statistics, and of the number of different words that the labelled texts show to be telling. A
document's tokens count for each domain by its posterior. Rates (how often a document is taken, nonnegative) are then
fitted by distributed projected-gradient least squares, so that the expected tokens of every domain match its target.
Every step is one aggregation over (tokens, posteriors, rate) of all documents and returns one number for each domain.
Where the steps end before the targets are met, Newton steps of the dual go on from there.

Domains are ``poor`` (quality 0), ``toxic`` (toxic 1) and ``good`` (the rest). ``copies`` rounds a rate to a whole number
of copies, up or down by a hash of the id, so that expected totals stay.

All of it is DataFrame expressions. Defined results: a null text has no tokens and the classes' priors as posteriors;
null labels are left out, repeated ones count once (the largest); a domain without labelled documents gets no posterior
and its weight goes to the others; without any, every document is ``good``; repeated rows and ids have equal rates.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.staging import stage
from evidentia.llm.toxicity import by_hash

DOMAINS = ["good", "poor", "toxic"]
WEIGHTS = {"good": 0.85, "poor": 0.10, "toxic": 0.05}
#: Labelled rows of each domain that telling words are chosen by, about at most (by a hash of the id), and words chosen.
SAMPLE = 2000
WORDS = 300
#: Steps of the gradient at most, and the largest relative error of a domain's total at which they end.
STEPS = 40
TOLERANCE = 2e-3
#: Further aggregations at most, where the gradient has not met it.
PASSES = 60
#: Errors are relative to a domain's target, or to this share of all targets where that is more: a domain that hardly
#: occurs must not outweigh the others.
LEAST_SCALE = 0.05
#: What an anchor's target lies above its tokens, so that inexact totals drop none of its documents.
ANCHOR_SLACK = 0.01
FEATURES = ["length", "variety", "marks", "capitals", "telling"]
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "#*$%&|<>!"


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when((quality == 1) | (toxic == 0), "good")


def words(text: Column) -> Column:
    """Words, in lower case; an empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s.,!|]+"), lambda x: x != "")


def telling_words(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, n: int = WORDS) -> list[str]:
    """Words of toxic labelled texts that are rarest elsewhere, by smoothed log odds of the texts that hold them."""
    held = docs.join(F.broadcast(by_hash(labelled, "domain", sample, 19)), "doc_id").select("domain", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))
    toxic = F.col("domain") == "toxic"
    counts = held.groupBy("word").agg(F.count(F.when(toxic, 1)).alias("t"), F.count(F.when(~toxic, 1)).alias("o"))
    odds = F.log((F.col("t") + 0.5) / (F.col("o") + 0.5))
    best = counts.filter(F.col("t") >= 3).filter(odds > 1.5).orderBy(F.desc(F.col("t") * odds), "word").limit(n)
    return [r["word"] for r in best.collect()]


def features(docs: DataFrame, telling: list[str]) -> DataFrame:
    """(doc_id, tokens, FEATURES) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w"))
    size = F.greatest(F.length("text"), F.lit(1))
    marks = F.length("text") - F.length(F.translate("text", _MARKS, ""))
    capitals = F.length("text") - F.length(F.translate("text", _CAPITALS, ""))
    found = F.size(F.array_intersect("w", F.array(*map(F.lit, telling)))) if telling else F.lit(0)
    tokens = F.size("w")
    return rows.select(
        "doc_id",
        tokens.cast("long").alias("tokens"),
        F.log1p(tokens.cast("double")).alias("length"),
        (F.size(F.array_distinct("w")) / F.greatest(tokens, F.lit(1))).alias("variety"),
        F.log1p(1000 * marks / size).alias("marks"),
        F.log1p(1000 * capitals / size).alias("capitals"),
        F.log1p(found.cast("double")).alias("telling"),
    )


def posteriors(rows: DataFrame, labelled: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with the array ``p`` of posteriors of the domains that have labelled documents, and these domains."""
    spread = [f(F.col(c)).alias(f"{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("v", F.var_pop))]
    fitted = {r["domain"]: r for r in rows.join(labelled, "doc_id").groupBy("domain").agg(F.count("*").alias("n"), *spread).collect()}
    names = [d for d in DOMAINS if d in fitted]
    if not names:
        return rows.withColumn("p", F.array(F.lit(1.0))), ["good"]
    total = sum(fitted[d]["n"] for d in names)
    logs = []
    for d in names:
        own = F.lit(math.log(fitted[d]["n"] / total))
        for c in FEATURES:
            v = max(fitted[d][f"v_{c}"] or 0.0, 0.02)
            own = own - F.pow(F.col(c) - F.lit(fitted[d][f"m_{c}"]), 2) / (2 * v) - 0.5 * math.log(v)
        logs.append(F.when(F.col("tokens") > 0, own).otherwise(math.log(fitted[d]["n"] / total)))
    rows = rows.withColumn("l", F.array(*logs)).withColumn("e", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("p", F.transform("e", lambda x: x / whole)).drop("l", "e"), names


def rates(rows: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """``rows`` (tokens, p) with ``rate``: nonnegative, near 1, with expected domain totals that match the targets.

    Projected gradient on the squared relative errors of the totals. The step is the inverse of the largest curvature,
    bounded by the trace of the totals' second moments, and extrapolated (Nesterov). What is left after ``steps`` is settled
    by the dual.
    """
    d = range(len(targets))
    at = [F.col("p")[k] for k in d]
    scale = [max(t, LEAST_SCALE * sum(targets), 1.0) for t in targets]
    # a document's gradient is divided by its tokens (a diagonal preconditioner), so rates depend on posteriors alone
    moments = rows.agg(*[F.sum(F.col("tokens") * at[j] * at[k]).alias(f"m{j}{k}") for j in d for k in d]).first()
    curvature = sum((moments[f"m{k}{k}"] or 0.0) / scale[k] / scale[k] for k in d)
    if not curvature:
        return rows.withColumn("rate", F.lit(1.0))
    step = 1 / curvature
    rate, before, momentum = F.lit(1.0), F.lit(1.0), 1.0
    table = rows.withColumns({"rate": F.lit(1.0), "before": F.lit(1.0)})
    for k in range(steps):
        following = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead = F.col("rate") + (momentum - 1) / following * (F.col("rate") - F.col("before"))
        sums = table.agg(*[F.sum(F.col("tokens") * at[j] * ahead).alias(f"a{j}") for j in d], *[F.sum(F.col("tokens") * at[j] * F.col("rate")).alias(f"t{j}") for j in d]).first()
        if max(abs((sums[f"t{j}"] or 0.0) - targets[j]) / scale[j] for j in d) < TOLERANCE:
            break
        error = [((sums[f"a{j}"] or 0.0) - targets[j]) / scale[j] / scale[j] for j in d]
        moved = F.greatest(F.lit(0.0), ahead - step * sum((error[j] * at[j] for j in d), F.lit(0.0)))
        table = table.withColumns({"before": F.col("rate"), "rate": moved})
        if k % 5 == 4:
            table = stage(table, "rates")
        momentum = following
    else:
        table = settled(stage(table, "rates"), targets, scale)
    return table.drop("before")


def settled(table: DataFrame, targets: list[float], scale: list[float], passes: int = PASSES) -> DataFrame:
    """``table`` (tokens, p, rate) with the nearest nonnegative rates whose totals match the targets.

    These are max(0, rate + a number for each domain times its posterior); the numbers are the dual's solution, by damped
    Newton steps, each of which is one aggregation. What can't be met is reported by a warning.
    """
    d = range(len(targets))
    share = [F.col("p")[k] / scale[k] for k in d]
    goal = np.array(targets) / scale

    def moved(dual: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.col("rate") + sum((float(dual[k]) * share[k] for k in d), F.lit(0.0)))

    def measured(dual: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        new, n = moved(dual), F.col("tokens")
        active = F.when(new > 0, n).otherwise(0)
        sums = [F.sum(n * share[j] * new) for j in d] + [F.sum(active * share[j] * share[k]) for j in d for k in d]
        got = [float(x or 0.0) for x in table.agg(F.sum(n * new * new / 2), *sums).first()]
        return got[0] - float(dual @ goal), np.array(got[1 : 1 + len(goal)]) - goal, np.array(got[1 + len(goal) :]).reshape(len(goal), -1)

    dual = np.zeros(len(goal))
    value, error, moments = measured(dual)
    length = 1.0
    for _ in range(passes):
        if np.abs(error).max() < TOLERANCE or length < 1e-6:
            break
        step = -np.linalg.lstsq(moments, error, rcond=1e-14)[0]
        there = measured(dual + length * step)
        if there[0] <= value + 1e-4 * length * float(error @ step):
            dual, (value, error, moments), length = dual + length * step, there, 1.0
        else:
            length /= 4
    if np.abs(error).max() >= TOLERANCE:
        warnings.warn(f"mixing: totals miss their targets by {(error / np.maximum(goal, 1e-300)).tolist()} of them", stacklevel=2)
    return table.withColumn("rate", moved(dual))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, anchor: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_poor, p_toxic, rate, copies) of every row of (doc_id, text).

    Targets are ``weights`` of the least total at which no domain has to shrink, so documents are rather repeated than
    dropped; or, with an ``anchor``, of the total at which that domain keeps its tokens (and ANCHOR_SLACK more).
    """
    weights = WEIGHTS if weights is None else weights
    docs = docs.select("doc_id", "text")
    own = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = own.select("doc_id", domain(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null")
    labelled = stage(labelled.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    rows = stage(features(docs, telling_words(docs, labelled)), "features")
    rows, names = posteriors(rows, labelled)
    rows = stage(rows.select("doc_id", "tokens", "p"), "posteriors")
    sums = rows.agg(*[F.sum(F.col("tokens") * F.col("p")[k]).alias(str(k)) for k in range(len(names))]).first()
    have = [float(sums[str(k)] or 0.0) for k in range(len(names))]
    share = [weights.get(n, 0.0) for n in names]
    whole = sum(share)
    share = [s / whole for s in share] if whole else [1 / len(names)] * len(names)
    total = max((h / s for h, s in zip(have, share, strict=True) if s), default=0.0)
    if anchor in names and share[names.index(anchor)]:
        total = have[names.index(anchor)] * (1 + ANCHOR_SLACK) / share[names.index(anchor)]
    out = rates(rows, [total * s for s in share])
    turn = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    p = {n: F.col("p")[names.index(n)] if n in names else F.lit(0.0) for n in DOMAINS}
    return out.select(
        "doc_id",
        F.col("tokens").alias("n_tokens"),
        *[p[n].alias(f"p_{n}") for n in DOMAINS],
        "rate",
        F.floor(F.col("rate") + turn).cast("int").alias("copies"),
    )
