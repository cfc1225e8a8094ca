"""Problem 3: similarity clusters by Markov clustering.

The similarity graph holds every record's nearest records from the posting lists (postings.py). Markov
clustering alternates squaring of the sparse column-stochastic flow matrix (a join on the shared index and a
sum), inflation and pruning of small entries; no column ever holds more than WIDTH entries, so a round's work
is linear in the records. A column whose flow has all gone into one row is that row's from then on and takes no
further part, so rounds shrink; once what is still moving has at most FINISH entries, one task ends it. It ends when no
column moves (van Dongen's chaos), else with an error. Rows with flow left are attractors: they define the clusters, and
the members that most flow passes represent them.

Groups in the sense of "joined by a chain of similar records" are unions of those clusters, since flow never leaves such
a chain. The exact check looks at the lists that hold several clusters, and there only at similar pairs whose ends lie
in different ones; within a cluster nothing but the flow joins its members."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, drop_cut
from .postings import BLOCK, blocks
from .similar import K, LEAST, lists_of, near_links, posting_lists

WIDTH, PRUNE, INFLATION, ROUNDS, FINISH, STILL = 8, 0.05, 2.0, 100, 1 << 19, 1e-3
# One missed link can part a group, so rows enter more lists than problem 5 needs.
WIDE_REACH, WIDE_ENTRIES = 0.36, 32


def _columns(entries: DataFrame, width: int) -> DataFrame:
    """Keeps of every column j of entries(i, j, w) its strongest `width`, of those the ones above PRUNE of their sum, and
    rescales them to 1. The rank limit cuts a hub's column down before the shuffle. n counts a column's entries, chaos is
    its greatest entry less the sum of its squares: 0 for a column that squaring and inflation leave as it is."""
    w = Window.partitionBy("j")
    top = entries.withColumn("r", F.row_number().over(w.orderBy(F.col("w").desc(), "i"))).where(F.col("r") <= width)
    kept = top.withColumn("p", F.col("w") / F.sum("w").over(w)).where((F.col("p") >= PRUNE) | (F.col("r") == 1))
    scaled = kept.select("i", "j", (F.col("p") / F.sum("p").over(w)).alias("w"))
    return scaled.select("i", "j", "w", F.count("*").over(w).cast("int").alias("n"), (F.max("w").over(w) - F.sum(F.col("w") * F.col("w")).over(w)).alias("chaos"))


def _merge(i, j, w, n):
    """Entries of the same place added up, in order of j and i."""
    key = j * n + i
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    return key[first] % n, key[first] // n, np.add.reduceat(w[order], first) if len(key) else w


def _trim(i, j, w, n, width):
    order = np.lexsort((i, -w, j))
    i, j, w = i[order], j[order], w[order]
    rank = np.arange(len(j)) - np.searchsorted(j, j)
    i, j, w, rank = (x[rank < width] for x in (i, j, w, rank))
    p = w / np.bincount(j, w, minlength=n)[j]
    keep = (p >= PRUNE) | (rank == 0)
    i, j, p = i[keep], j[keep], p[keep]
    return i, j, p / np.bincount(j, p, minlength=n)[j]


def settle(i, j, w, width: int = WIDTH, inflation: float = INFLATION, rounds: int = ROUNDS):
    """Markov rounds over the entries (i, j, w) of a bounded matrix until no column moves: the entries then. A row without
    a column of its own keeps what flows into it."""
    ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n, i, j = len(ids), at[: len(i)], at[len(i) :]
    bare = np.setdiff1d(i, j)
    i, j, w = np.r_[i, bare], np.r_[j, bare], np.r_[w, np.ones(len(bare))]
    for _ in range(rounds):
        order = np.argsort(j, kind="stable")
        i, j, w = i[order], j[order], w[order]
        size, start = np.bincount(j, minlength=n), np.searchsorted(j, np.arange(n))
        top = np.zeros(n)
        np.maximum.at(top, j, w)
        if (top - np.bincount(j, w * w, minlength=n)).max() < STILL:
            return ids[i], ids[j], w
        moving = (size > 1)[j]
        k, reps = i[moving], size[i[moving]]
        pick = np.repeat(start[k] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
        p = _merge(i[pick], np.repeat(j[moving], reps), np.repeat(w[moving], reps) * w[pick], n)
        p = _trim(p[0], p[1], p[2] ** inflation, n, width)
        i, j, w = np.r_[i[~moving], p[0]], np.r_[j[~moving], p[1]], np.r_[w[~moving], p[2]]
    raise RuntimeError("Markov clustering did not settle")


def _settle_rest(width: int, inflation: float, rounds: int):
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            i, j, w = settle(*(t.column(c).to_numpy() for c in ("i", "j", "w")), width, inflation, rounds)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(w)], names=["i", "j", "w"])

    return run


def markov_clusters(links: DataFrame, inflation: float = INFLATION, rounds: int = ROUNDS, width: int = WIDTH, finish: int = FINISH) -> DataFrame:
    """links(a, b, weight > 0), undirected -> (id, cluster, strength): the smallest attractor of each end's cluster and the
    flow that its neighbours send to it at first. Repeated links count once with their greatest weight; an empty input
    gives an empty result."""
    both = links.select(F.col("a").alias("i"), F.col("b").alias("j"), "weight").unionByName(links.select(F.col("b").alias("i"), F.col("a").alias("j"), "weight"))
    both = both.where("i is not null and j is not null and i <> j and weight > 0").groupBy("j", "i").agg(F.max("weight").alias("w"))
    # Each column's loop weighs as much as its greatest entry; it comes with the column's first row.
    column = Window.partitionBy("j")
    entry, loop = F.struct("i", "w"), F.struct(F.col("j").alias("i"), F.max("w").over(column).alias("w"))
    looped = both.select("j", F.when(F.row_number().over(column.orderBy("i")) == 1, F.array(entry, loop)).otherwise(F.array(entry)).alias("e"))
    flow = cut(_columns(looped.select("j", F.explode("e").alias("e")).select("e.i", "j", "e.w"), width))
    strength = cut(flow.groupBy(F.col("i").alias("id")).agg(F.sum("w").alias("strength")))
    for _ in range(rounds):
        moving = flow.where("n > 1")
        s = moving.agg(F.count("*").alias("entries"), F.max("chaos").alias("chaos")).first()
        if not s.entries or s.chaos < STILL:
            break
        if s.entries <= finish:
            # All that moves and the settled columns it looks at: at most twice as many entries.
            seen = flow.where("n = 1").join(moving.select(F.col("i").alias("j")).distinct(), "j", "left_semi")
            rest = moving.select("i", "j", "w").unionByName(seen.select("i", "j", "w")).repartition(1).mapInArrow(_settle_rest(width, inflation, rounds), "i long, j long, w double")
            last = cut(rest.join(seen.select("j"), "j", "left_anti").unionByName(flow.where("n = 1").select("i", "j", "w")))
            drop_cut(flow)
            flow = last
            break
        left = flow.select("i", F.col("j").alias("k"), F.col("w").alias("wl"))
        right = moving.select(F.col("i").alias("k"), "j", F.col("w").alias("wr"))
        squared = left.join(right, "k").groupBy("j", "i").agg(F.sum(F.col("wl") * F.col("wr")).alias("w"))
        moved = _columns(squared.select("i", "j", F.pow("w", F.lit(inflation)).alias("w")), width)
        nxt = cut(moved.unionByName(flow.where("n = 1")))
        drop_cut(flow)
        flow = nxt
    else:
        raise RuntimeError("Markov clustering did not settle")
    strongest = flow.groupBy("j").agg(F.max(F.struct(F.round("w", 6).alias("w"), (-F.col("i")).alias("i"))).alias("m"))
    to = cut(strongest.select(F.col("j").alias("id"), (-F.col("m.i")).alias("attractor")))
    drop_cut(flow)
    # Attractors that flow into each other are one system; its smallest member names the cluster.
    systems = connected_components(to.select(F.col("attractor").alias("u"), F.col("id").alias("v")).join(
        to.select(F.col("attractor").alias("v")).distinct(), "v", "left_semi"))
    named = to.join(systems.select(F.col("id").alias("attractor"), "component"), "attractor", "left")
    return named.select("id", F.coalesce("component", "attractor").alias("cluster")).join(strength, "id", "left").select("id", "cluster", F.coalesce("strength", F.lit(0.0)).alias("strength"))


def _between_clusters(least: float):
    """Links between the clusters of one unit of lists that any similar pair joins: every cluster to the smallest one of
    those joined to it."""

    def run(table: pa.Table) -> pa.Table:
        cluster, us, vs = table.column("cluster").to_numpy(), [], []
        for ids, u, query, same, at in lists_of(table):
            names, lab = np.unique(cluster[at], return_inverse=True)
            if len(names) < 2:
                continue
            rows, cols = (slice(None), slice(None)) if same else (query, ~query)
            if not same and (query.all() or not query.any()):
                continue
            s = u[rows].astype(np.float32) @ u[cols].astype(np.float32).T
            r, c = np.nonzero((s >= least - 1e-5) & (lab[rows][:, None] != lab[cols][None, :]))
            doubt = np.flatnonzero(np.abs(s[r, c] - least) < 2e-5)
            ok = np.ones(len(r), bool)
            ok[doubt] = np.einsum("ij,ij->i", u[rows][r[doubt]], u[cols][c[doubt]]) >= least
            pairs = np.unique(lab[rows][r[ok]] * len(names) + lab[cols][c[ok]])
            pairs = pairs // len(names), pairs % len(names)
            low = np.arange(len(names))
            while True:
                new = low.copy()
                np.minimum.at(new, pairs[0], low[pairs[1]])
                np.minimum.at(new, pairs[1], low[pairs[0]])
                new = new[new]
                if (new == low).all():
                    break
                low = new
            joined = np.flatnonzero(low != np.arange(len(names)))
            us.append(names[joined])
            vs.append(names[low[joined]])
        none = [np.zeros(0, np.int64)]
        return pa.table([np.concatenate(us or none), np.concatenate(vs or none)], names=["u", "v"])

    return run


def similarity_groups(vectors: DataFrame, key: str, vector: str, least: float = LEAST, k: int = K, block: int = BLOCK) -> DataFrame | None:
    """(id, cluster, strength, group) of every record with a similar one: its Markov cluster and the smallest id of
    all records that chains of similar records join to it. None without a valid vector.

    Null, short, zero and non-finite vectors take no part; ties go to the smaller id; extra columns are not read."""
    lists = posting_lists(vectors, key, vector, reach=WIDE_REACH, entries=WIDE_ENTRIES)
    if lists is None:
        return None
    links = cut(near_links(lists, k, least, block))
    clusters = cut(markov_clusters(links.select("a", "b", F.col("cosine").alias("weight"))))
    drop_cut(links)
    named = lists.select("list", "id").join(clusters.select("id", "cluster"), "id")
    several = named.groupBy("list").agg(F.min("cluster").alias("least"), F.max("cluster").alias("most")).where("least <> most").select("list")
    # At most one row per list, whose number the index bounds.
    few = cut(named.join(several, "list", "left_semi").distinct())
    numbers = few.select("list").distinct()
    check = lists.select("list", "id", "v").join(F.broadcast(numbers), "list", "left_semi").join(few, ["list", "id"])
    across = blocks(check, block).groupBy("pack", "qb", "sb").applyInArrow(_between_clusters(least), "u long, v long")
    across = cut(across)
    joined = cut(connected_components(across))
    tagged = cut(clusters.join(joined.select(F.col("id").alias("cluster"), "component"), "cluster", "left").select("id", "cluster", "strength", F.coalesce("component", "cluster").alias("component")))
    for part in (*lists._stemma_parts, few, clusters, across, joined):
        drop_cut(part)
    least_id = tagged.groupBy("component").agg(F.min("id").alias("group"))
    return tagged.join(least_id, "component").select("id", "cluster", "strength", "group")


def describe(groups: DataFrame, by: str, members: int = 3) -> DataFrame:
    """Size and most typical members (strongest flow, then smallest id) of every cluster or group."""
    w = Window.partitionBy(by, "salt").orderBy(F.col("strength").desc(), "id")
    # Typical members are picked per salt first, so that a hot group is never sorted in one task.
    some = groups.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= members)
    top = some.withColumn("r2", F.row_number().over(Window.partitionBy(by).orderBy(F.col("strength").desc(), "id"))).where(F.col("r2") <= members)
    typical = top.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("r2", "id"))).alias("t"))
    sizes = groups.groupBy(by).agg(F.count("*").alias("size"))
    return sizes.join(typical, by).select(by, "size", F.transform("t", lambda x: x["id"]).alias("typical"))
