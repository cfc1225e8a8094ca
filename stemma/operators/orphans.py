"""Problem 2: references to records that do not exist at the time of the reference.

A Bloom filter of all (branch, id) keys of the parent table is built by aggregation on the executors and
travels to every task. Its size has a fixed bound (max_bits, 8 MiB), so it never
grows with the data; beyond the bound only its false-positive rate grows. What the filter rejects is a
definite orphan ('missing') and takes part in no join. What it accepts is verified exactly
against the parent rows, which are reduced map-side to one row per (branch, id, deletion time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN = "main"


WORD_BITS, BITS_PER_KEY = 64, 12


def _hash(branch: Column, node: Column, seed: int) -> Column:
    return F.xxhash64(branch, node, F.lit(seed))


def _bits(branch: Column, node: Column) -> Column:
    """Three of a word's 64 bits."""
    h = _hash(branch, node, 1)
    one = F.lit(1).cast("long")
    bit = lambda k: F.call_function("shiftleft", one, F.shiftright(h, k).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


class BloomFilter:
    """A blocked Bloom filter: a key sets three bits of one 64-bit word.

    Words are built by a bitwise-or aggregate per word number, combined on the map side and spread over all reducers;
    only the finished words, at most max_bits / 8 bytes, come together in one row, which queries read as a scalar
    subquery. Beyond the bound the filter only passes more keys."""

    def __init__(self, keys: DataFrame, items: int, max_bits: int = 1 << 26):
        self.words = max(1, min(max_bits, BITS_PER_KEY * max(1, items)) // WORD_BITS)
        word = F.pmod(_hash(F.col("branch"), F.col("id"), 0), F.lit(self.words)).alias("word")
        some = keys.select(word, _bits(F.col("branch"), F.col("id")).alias("m")).groupBy("word").agg(F.bit_or("m").alias("m"))
        every = keys.sparkSession.range(self.words).select(F.col("id").alias("word"))
        full = every.join(some, "word", "left").select("word", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
        row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "m"))), lambda x: x["m"]).alias("words"))
        self.column = row.scalar()

    def might_contain(self, branch: Column, node: Column) -> Column:
        bits = _bits(branch, node)
        held = F.get(self.column, F.pmod(_hash(branch, node, 0), F.lit(self.words)).cast("int"))
        return held.bitwiseAND(bits) == bits


def reference_ends(edges: DataFrame) -> DataFrame:
    """Both ends of the current row of every (branch, edge id): branch, edge_id, type, side, node_id, at.

    Current is the newest indexed_at (null is oldest); repeated rows of the same time are identical, the
    greatest is taken. Ends that are null or '' are no references. A null edge id or branch is a value of its own."""
    current = edges.groupBy("branch", "id").agg(
        F.max(F.struct("indexed_at", "type", "source_id", "target_id")).alias("e")
    )
    ends = current.select(
        "branch",
        F.col("id").alias("edge_id"),
        F.col("e.type").alias("type"),
        F.col("e.indexed_at").alias("at"),
        F.explode(
            F.array(
                F.struct(F.lit("source").alias("side"), F.col("e.source_id").alias("node_id")),
                F.struct(F.lit("target").alias("side"), F.col("e.target_id").alias("node_id")),
            )
        ).alias("x"),
    )
    return ends.select("branch", "edge_id", "type", "at", "x.side", "x.node_id").where("node_id <> ''")


def find_orphans(edges: DataFrame, nodes: DataFrame, max_bits: int = 1 << 26) -> DataFrame:
    """Every end that no visible node row carries at the edge's time.

    Output: branch, edge_id, type, side, node_id, at, reason (missing | late | deleted). Visible are
    rows of the same branch or of main, all versions. Empty tables give an empty result (or, without
    nodes, only 'missing'). An edge without indexed_at has no time at which a node row could hold: its
    ends are 'missing' when no row is visible, else 'deleted'. Extra columns are ignored."""
    ends = reference_ends(edges.select("branch", "id", "type", "source_id", "target_id", "indexed_at"))
    keys = nodes.select("branch", "id", "indexed_at", "deleted_at").where("id is not null and branch is not null")
    bloom = BloomFilter(keys, keys.count(), max_bits)
    hit = bloom.might_contain(F.col("branch"), F.col("node_id")) | bloom.might_contain(F.lit(MAIN), F.col("node_id"))
    probed = ends.withColumn("hit", F.coalesce(hit, F.lit(False)))
    cols = ["branch", "edge_id", "type", "side", "node_id", "at"]
    definite = probed.where(~F.col("hit")).select(*cols, F.lit("missing").alias("reason"))
    # One row per (branch, id, deletion time) decides as all its rows do: of equal deletion times the
    # earliest start covers most, and the latest start says whether anything came later.
    spans = keys.groupBy("branch", "id", "deleted_at").agg(
        F.min("indexed_at").alias("start"), F.max("indexed_at").alias("latest")
    )
    # The array holds one entry per branch and distinct deletion of one id, not one per delivered row.
    parents = spans.groupBy(F.col("id").alias("pid")).agg(
        F.collect_list(F.struct("branch", "start", "latest", "deleted_at")).alias("v")
    )
    joined = probed.where("hit").join(parents, F.col("node_id") == F.col("pid"), "left")
    visible = F.filter("v", lambda x: (x["branch"] == F.col("branch")) | (x["branch"] == MAIN))
    fine = F.exists(
        "s",
        lambda x: (x["start"] <= F.col("at")) & (x["deleted_at"].isNull() | (x["deleted_at"] > F.col("at"))),
    )
    late = F.exists("s", lambda x: x["latest"] > F.col("at"))
    verified = (
        joined.withColumn("s", visible)
        .withColumn(
            "reason",
            F.when(F.coalesce(F.size("s"), F.lit(0)) <= 0, "missing")
            .when(F.coalesce(fine, F.lit(False)), None)
            .when(F.coalesce(late, F.lit(False)), "late")
            .otherwise("deleted"),
        )
        .where("reason is not null")
        .select(*cols, "reason")
    )
    return definite.unionByName(verified)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts per edge type, branch, month of indexed_at, side and reason."""
    return orphans.groupBy(
        "type", "branch", F.date_format("at", "yyyy-MM").alias("month"), "side", "reason"
    ).agg(F.count("*").alias("orphans"))
