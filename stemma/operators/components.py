"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every round is two group-by-minimum joins; a hub's neighbours are never gathered into one row or task. The
links of a round are written to the shared folder, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(u, v) of any orderable type -> (id, component), component being the smallest id joined to id.

    Ids that occur only in a link to themselves get themselves; null ends are dropped; an empty input gives
    an empty result. Repeated links are fine."""
    clean = links.where("u is not null and v is not null").select("u", "v")
    given = cut(clean.distinct())
    alone = given.where("u = v").select(F.col("u").alias("id"), F.col("u").alias("component"))
    now = given.where("u <> v")
    mark = None
    for _ in range(max_rounds):
        nxt = cut(_small_star(_large_star(now)).where("u <> v").distinct())
        # The links are a star forest when a round no longer moves any: same count and same checksum.
        s = nxt.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        drop_cut(now)
        now = nxt
        if (s.n, s.x) == mark:
            break
        mark = (s.n, s.x)
    else:
        raise RuntimeError("connected_components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    tops = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.unionByName(tops).unionByName(alone).groupBy("id").agg(F.min("component").alias("component"))
