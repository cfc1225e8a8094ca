"""Problem 9: mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies (share * total / tokens of the source); the
whole part is certain, the fraction is a probability. Fractions are settled in pairs: probability mass is moved
at random from one document to the other, weighted so that the expected tokens stay exactly the same, until one
of the two is 0 or 1. Every block of documents leaves one unsettled document at most; these residuals are
settled among themselves level by level (a reduction tree), so a source misses its target by less than one document."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ship
from .bpe import VOCABULARY, token_counts

BLOCK = 4096
_ROWS = "doc_id long, source string, n_tokens long, whole long, p double, settled boolean"


def pivotal(weights: list[float], probs: list[float], rng: random.Random):
    """0 or 1 for all but at most one item, which keeps a probability; the weighted sum of the result is that of probs."""
    out = list(probs)
    carry = None
    for j, p in enumerate(probs):
        if not 1e-12 < p < 1 - 1e-12:
            out[j] = float(round(p))
            continue
        if carry is None:
            carry = j
            continue
        i = carry
        wi, wj, a, b = weights[i], weights[j], out[i], out[j]
        up = min((1 - a) * wi, b * wj)  # mass that may move from j to i
        down = min(a * wi, (1 - b) * wj)
        moved = up if rng.random() * (up + down) < down else -down
        out[i], out[j] = a + moved / wi, b - moved / wj
        for k in (i, j):
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = float(round(out[k]))
        open_ = [k for k in (i, j) if 0 < out[k] < 1]
        carry = open_[0] if open_ else None
    return out, carry


def _settle(seed: int, level: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = random.Random(f"{seed}/{level}/{pdf['source'].iloc[0]}/{int(pdf['block'].iloc[0])}")
        probs, left = pivotal(pdf["n_tokens"].astype(float).tolist(), pdf["p"].tolist(), rng)
        if left is not None and last:
            probs[left] = 1.0 if rng.random() < probs[left] else 0.0
            left = None
        settled = [k != left for k in range(len(probs))]
        return pdf.assign(p=probs, settled=settled)[["doc_id", "source", "n_tokens", "whole", "p", "settled"]]

    return run


def source_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per listed source: target_share, max_repeats, n_docs, tokens, goal (tokens) and rate (copies per document).

    Shares of sources without a token cannot be met: the others keep their proportions to each other. Without
    total_tokens the total is the largest with which every remaining source meets its share within max_repeats;
    a larger total leaves sources at their cap below their share. Null shares or repeats are 0; a source listed
    twice counts once, with its greatest row."""
    t = targets.where("source is not null").groupBy("source").agg(
        F.max(F.struct(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("s"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("r"))).alias("x"))
    t = t.select("source", F.col("x.s").alias("target_share"), F.col("x.r").alias("max_repeats"))
    plan = t.join(sizes, "source", "left").fillna(0, ["n_docs", "tokens"])
    usable = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    whole = plan.where(usable).agg(F.sum("target_share").alias("s")).first().s or 1.0
    plan = plan.withColumn("share", F.when(usable, F.col("target_share") / F.lit(whole)).otherwise(0.0))
    if total_tokens is None:
        total_tokens = plan.where("share > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("share")).alias("t")).first().t or 0.0
    goal = F.col("share") * F.lit(float(total_tokens))
    rate = F.when(F.col("share") > 0, F.least(goal / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return plan.withColumn("goal", goal).withColumn("rate", rate)


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY, block: int = BLOCK):
    """(copies, report). copies(doc_id, source, n_tokens, copies): how often each document is used, one row per row of docs;
    report(source, target_share, n_docs, tokens, used_tokens, actual_share, most_copies).

    Sizes are tokens of the vocabulary over whole texts. Documents of null or unlisted sources, of shares of 0 and
    without a token (null, empty) get 0 copies; none gets more than max_repeats. A listed source without documents is
    reported with 0. doc_id must be unique; the result depends on ids and the seed only. Extra columns are not read."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select("doc_id", "source", "text")
    counted = cut(token_counts(src, "doc_id", "text", ["source"], vocabulary))
    sizes = counted.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = cut(source_plan(sizes, targets, total_tokens))
    rated = counted.join(plan.select("source", "rate", "n_docs"), "source", "left").withColumn("rate", F.when(F.col("n_tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0))
    whole = F.floor(F.col("rate") + 1e-12)
    rated = rated.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(F.col("rate") - whole, F.lit(0.0)))
    sure = rated.where("p <= 1e-12").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    todo = rated.where("p > 1e-12").select("doc_id", "source", "n_tokens", "whole", "p", F.ceil(F.col("n_docs") / block).cast("long").alias("blocks"))
    most = plan.agg(F.max("n_docs").alias("n")).first().n or 0
    levels = max(1, math.ceil(math.log(max(most, 2)) / math.log(block)))
    parts = [sure]
    for level in range(levels + 1):
        # A block is a share of one source by the ids' hash: a hot source has many, all of bounded size.
        grouped = todo.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), F.col("blocks")))
        kept = todo.select("doc_id", "blocks")
        last = level == levels
        done = cut(grouped.groupBy("source", "block").applyInPandas(_settle(seed, level, last), _ROWS))
        parts.append(done.where("settled").select("doc_id", "source", "n_tokens", (F.col("whole") + F.round("p").cast("long")).alias("copies")))
        if last:
            break
        open_ = done.where("not settled").join(kept, "doc_id")
        todo = open_.select("doc_id", "source", "n_tokens", "whole", "p", F.ceil(F.col("blocks") / block).cast("long").alias("blocks"))
    copies = parts[0]
    for x in parts[1:]:
        copies = copies.unionByName(x)
    copies = copies.select("doc_id", "source", "n_tokens", F.col("copies").cast("int").alias("copies"))
    used = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    per = plan.join(used, "source", "left").fillna(0, ["used_tokens", "most_copies"])
    total = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))  # over the listed sources only
    report = per.select(
        "source", "target_share", "n_docs", "tokens", "used_tokens",
        F.when(total > 0, F.col("used_tokens") / total).otherwise(0.0).alias("actual_share"), "most_copies")
    return copies, report
