"""Balanced posting lists over unit vectors, shared by problems 5 (most similar) and 3 (clusters).

Fit: centroids are drawn from a bounded sample (SAMPLE rows, at most MAX_CENTROIDS of them) so that no two are
closer than SEPARATION, then moved to the mean of their sample. They are searched by an in-memory graph of two layers:
pivots, each linked to the centroids near it (a centroid to its DEGREE nearest pivots), and links from every centroid
to its nearest ones. A row walks from its ENTRIES best pivots to their centroids, widens that if none is near, and hops
on along the links of the best one; rows that stand at the same pivot are compared with its centroids by one matrix
product. The graph is at most 60 MB whatever the data and is broadcast. Where the sample says that a list would exceed
MAX_LIST rows, its centroid is split into as many as balance it.
Rows far from all centroids, whose like the sample missed, get a second level of centroids, drawn from a bounded sample
of themselves; so small groups find each other too. A row that has a centroid may be like one that is far from it, unless
it is as near as SURE to its own: from there on its neighbours (cosine 0.75) are all within REACH of that. So rows below
SURE also enter the second level's lists within reach. Where the second sample was not all rows, they and the far rows
are brought together by cells.py instead, as two rows of no centroid share a list by chance only.
Index: every row enters its nearest list. A row at a boundary also enters the lists whose distance is within RATIO of the
nearest or whose centroid's cosine is at least REACH, at most REPLICAS: a row similar to a member of a list (cosine
0.75, the member being some 0.8 from its centroid) is itself about 0.6 from that centroid. Lists above BLOCK rows are
worked on in blocks (query block times stored block), so a hot list is spread over many tasks.
Vectors travel as bytes of the narrowest number type that holds them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread

DIM, SAMPLE, MAX_CENTROIDS, SEPARATION = 128, 65_536, 65_536, 0.6
REACH = 0.42
SURE = 0.92
REPLICAS, RATIO, DEGREE, LINKS, ENTRIES, WIDER, BLOCK, MAX_LIST = 12, 1.12, 4, 16, 16, 4, 2048, 32_768


def valid(vector: Column, dim: int = DIM) -> Column:
    """Exactly dim finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(x: np.ndarray) -> np.ndarray:
    """Lengths of one, without overflow for very large or very small numbers."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_centroids(u: np.ndarray, separation: float = SEPARATION, most: int = MAX_CENTROIDS, step: int = 256):
    """Greedy leaders of the sample in its order, each moved to the mean of the sample rows nearest to it; and
    each sample row's leader."""
    u = u.astype(np.float32, copy=False)
    lead = np.zeros((min(most, len(u)), u.shape[1]), np.float32)
    n = 0
    own = np.zeros(len(u), np.int64)
    for a in range(0, len(u), step):
        b = u[a : a + step]
        best = np.full(len(b), -2.0, np.float32)
        if n:
            s = b @ lead[:n].T
            own[a : a + step] = s.argmax(axis=1)
            best = s.max(axis=1)
        far = np.flatnonzero(best < separation)
        taken: list[int] = []
        gram = b[far] @ b[far].T
        for i in range(len(far)):
            if n < len(lead) and (not taken or gram[i, taken].max() < separation):
                taken.append(i)
                lead[n] = b[far[i]]
                own[a + far[i]] = n
                n += 1
            elif taken:
                j = int(gram[i, taken].argmax())
                if gram[i, taken[j]] > best[far[i]]:
                    own[a + far[i]] = n - len(taken) + j
    return _means(u, own, lead[:n]), own


def _means(u: np.ndarray, own: np.ndarray, lead: np.ndarray) -> np.ndarray:
    order = np.argsort(own, kind="stable")
    used, first = np.unique(own[order], return_index=True)
    total = np.zeros(lead.shape)
    total[used] = np.add.reduceat(u[order], first, axis=0, dtype=np.float64)
    norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
    return np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), lead).astype(np.float32)


def balance(u: np.ndarray, own: np.ndarray, c: np.ndarray, scale: float, most: int = MAX_LIST) -> np.ndarray:
    """Splits centroids whose list would exceed `most` rows, a sample row standing for `scale` rows, by k-means
    among their sample rows."""
    size = np.bincount(own, minlength=len(c)) * scale
    parts = [c[size <= most]]
    for k in np.flatnonzero(size > most):
        rows = u[own == k].astype(np.float32)
        m = min(len(rows), int(np.ceil(2 * size[k] / most)))
        sub = rows[:m].copy()
        for _ in range(4):
            at = np.concatenate([(rows[a : a + 4096] @ sub.T).argmax(axis=1) for a in range(0, len(rows), 4096)])
            sub = _means(rows, at, sub)
        parts.append(sub)
    return np.concatenate(parts)


def _groups(keys: np.ndarray):
    """(key, positions) of every distinct key."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return zip(keys[order][np.r_[0, cuts]], np.split(order, cuts)) if len(keys) else ()


def _strongest(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k greatest values, in no order."""
    return np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))


class CentroidGraph:
    def __init__(self, c: np.ndarray, pivots: np.ndarray, members: np.ndarray, first: np.ndarray, links: np.ndarray):
        self.c, self.pivots, self.members, self.first, self.links = c, pivots, members, first, links
        self.part = False  # fitted on a part of the rows

    @staticmethod
    def build(c: np.ndarray, degree: int = DEGREE, links: int = LINKS) -> "CentroidGraph":
        n = len(c)
        pivots = np.random.default_rng(0).permutation(n)[: max(1, int(4 * np.sqrt(n)))]
        p = c[pivots]
        near = np.concatenate([_strongest(c[a : a + 4096] @ p.T, degree) for a in range(0, n, 4096)])
        order = np.argsort(near.ravel(), kind="stable")
        members = np.repeat(np.arange(n), near.shape[1])[order]
        first = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))
        # A centroid's links are the nearest of those that share a pivot with it, itself where there are fewer.
        src, dst, sim = [], [], []
        for k in range(len(pivots)):
            m = members[first[k] : first[k + 1]]
            if len(m) > 1:
                s = c[m] @ c[m].T
                np.fill_diagonal(s, -2)
                top = _strongest(s, min(links, len(m) - 1))
                src.append(np.repeat(m, top.shape[1]))
                dst.append(m[top].ravel())
                sim.append(np.take_along_axis(s, top, 1).ravel())
        out = np.tile(np.arange(n, dtype=np.int32)[:, None], (1, links))
        if src:
            a, b, w = np.concatenate(src), np.concatenate(dst), np.concatenate(sim)
            _, once = np.unique(a * n + b, return_index=True)
            a, b, w = a[once], b[once], w[once]
            order = np.lexsort((-w, a))
            a, b = a[order], b[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            ok = place < links
            out[a[ok], place[ok]] = b[ok]
        return CentroidGraph(c, pivots.astype(np.int32), members.astype(np.int32), first, out)

    def _visit(self, q, rows, pivots, best, at, hits, least):
        """Compares rows with the centroids of the pivots they stand at, pivot by pivot."""
        for k, place in _groups(pivots):
            m = self.members[self.first[k] : self.first[k + 1]]
            if not len(m):
                continue
            r = rows[place]
            s = q[r] @ self.c[m].T
            j = s.argmax(axis=1)
            top = s[np.arange(len(r)), j]
            better = top > best[r]
            best[r[better]], at[r[better]] = top[better], m[j[better]]
            if top.max() >= least:
                x, y = np.nonzero(s >= least)
                hits.append((r[x], m[y], s[x, y]))

    def search(self, q: np.ndarray, least: float = REACH, near: float = SEPARATION, entries: int = ENTRIES, wider: int = WIDER):
        """(row, centroid, cosine) of the nearest centroid of every row of q and of those found at or above least."""
        n, rows = len(self.c), np.arange(len(q))
        best, at, hits = np.full(len(q), -2, np.float32), np.zeros(len(q), np.int64), []
        s = q @ self.c[self.pivots].T
        entry = _strongest(s, min(entries, s.shape[1]))
        self._visit(q, np.repeat(rows, entry.shape[1]), entry.ravel(), best, at, hits, least)
        lost = np.flatnonzero(best < near)
        if len(lost) and entry.shape[1] < s.shape[1]:
            rest = s[lost]
            np.put_along_axis(rest, entry[lost], -9, 1)
            more = _strongest(rest, min(entries * wider, s.shape[1] - entry.shape[1]))
            self._visit(q, np.repeat(lost, more.shape[1]), more.ravel(), best, at, hits, least)
        for a in range(0, len(q), 1024):
            b = slice(a, a + 1024)
            to = self.links[at[b]]
            s = np.einsum("ij,ikj->ik", q[b], self.c[to])
            j = s.argmax(axis=1)
            top = s[np.arange(len(s)), j]
            better = top > best[b]
            best[b] = np.where(better, top, best[b])
            at[b] = np.where(better, to[np.arange(len(s)), j], at[b])
            x, y = np.nonzero(s >= least)
            hits.append((a + x, to[x, y], s[x, y]))
        row, c, sim = (np.concatenate([h[k] for h in hits] + [own]) for k, own in enumerate((rows, at, best)))
        _, once = np.unique(row * n + c, return_index=True)
        return row[once], c[once], sim[once]

    def lists(self, q: np.ndarray, replicas: int = REPLICAS, ratio: float = RATIO, reach: float = REACH, entries: int = ENTRIES):
        """(row, list, far) of every row of q as in nearest(); far marks the one entry of a row that no centroid is as near as SEPARATION."""
        row, c, best = self.nearest(q, replicas, ratio, reach, entries)
        return row, c, best < SEPARATION

    def nearest(self, q: np.ndarray, replicas: int = REPLICAS, ratio: float = RATIO, reach: float = REACH, entries: int = ENTRIES):
        """(row, list, best) of every row of q: its nearest list, and of those whose centroid has a cosine of reach, or is
        within ratio of the nearest one's distance, the best `replicas`; best is the cosine at the nearest and 2 at the others."""
        row, c, sim = self.search(q.astype(np.float32), reach, entries=entries)
        order = np.lexsort((c, -sim, row))
        row, c, sim = row[order], c[order], sim[order]
        first = np.searchsorted(row, row)
        dist, rank = np.sqrt(np.maximum(2 - 2 * sim, 1e-9)), np.arange(len(row)) - first
        use = (rank == 0) | (rank < replicas) & ((sim >= reach) | (dist <= dist[first] * ratio))
        return row[use], c[use], np.where(rank[use] == 0, sim[use], 2)


def fit(vectors: DataFrame, vector: str, key: str, sample: int = SAMPLE) -> CentroidGraph | None:
    """The graph from a sample of about `sample` rows at most, chosen by a hash of their key; None without rows."""
    total = vectors.count()
    rows = vectors.select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).alias("v"))
    if total > sample:
        share = 0.97 * sample / total
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    arrow = rows.toArrow().combine_chunks()
    if not arrow.num_rows:
        return None
    order = np.argsort(arrow["h"].to_numpy(), kind="stable")[:sample]
    x = numbers(arrow["v"].combine_chunks())
    u = unit(x[order].astype(np.float64)).astype(np.float32)
    del arrow, x
    c, own = choose_centroids(u)
    graph = CentroidGraph.build(balance(u, own, c, total / len(u)))
    graph.part = total > len(u)
    return graph


def numbers(column) -> np.ndarray:
    """The rows of an Arrow column of packed bytes or of lists of one length, as they are stored."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, DIM), np.float32)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return unpack([column[k].as_buffer() for k in range(len(column))])
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: half, single or double precision, the first that holds a batch exactly. The first byte says which."""
    for code, kind in enumerate((np.float16, np.float32, np.float64)):
        with np.errstate(over="ignore"):
            y = x.astype(kind)
        if kind is np.float64 or (y.astype(x.dtype) == x).all():
            break
    mark = bytes([code])
    return [mark + r.tobytes() for r in y]


def unpack(rows: list) -> np.ndarray:
    """What pack() packed, as doubles; batches of different precision may be mixed."""
    size = np.array([len(r) for r in rows])
    out = None
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        raw = np.frombuffer(b"".join([rows[k] for k in at]), np.uint8).reshape(len(at), n)
        kind = (np.float16, np.float32, np.float64)[raw[0, 0]]
        x = np.ascontiguousarray(raw[:, 1:]).view(kind).astype(np.float64)
        out = np.zeros((len(rows), x.shape[1])) if out is None else out
        out[at] = x
    return out


def index(vectors: DataFrame, key: str, vector: str, graph: CentroidGraph, first: int = 0, reach: float = REACH, entries: int = ENTRIES, within: bool = False) -> DataFrame:
    """(list, id, v, far, loose): every row in its lists (numbered from first), v being its packed numbers; far and loose
    mark the one entry of a row whose nearest centroid is not as near as SEPARATION and SURE. The vectors may be packed
    already. A smaller reach and more entries miss less and cost more. within leaves out what has no centroid in reach."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((graph.c, graph.pivots, graph.members, graph.first, graph.links))

    def run(batches):
        g = CentroidGraph(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = numbers(batch.column("v")), batch.column("id").to_numpy(zero_copy_only=False)
            for a in range(0, len(x), 4096):
                part = x[a : a + 4096]
                row, lists, best = g.nearest(unit(part.astype(np.float64)), reach=reach, entries=entries)
                if within:
                    row, lists, best = (y[best >= reach] for y in (row, lists, best))
                raw = pack(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((lists + first).astype(np.int32)), pa.array(ids[a + row].astype(np.int64)), pa.array([raw[r] for r in row], pa.binary()), pa.array(best < SEPARATION), pa.array(best < SURE)],
                    names=["list", "id", "v", "far", "loose"])

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return spread(rows).mapInArrow(run, "list int, id long, v binary, far boolean, loose boolean")


PACK = 32


def blocks(indexed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The columns of indexed with (pack, qb, sb, query): the units of work are (pack, qb, sb). Lists of up to `block` rows
    are packed by PACK, so small lists cost no group each. A longer list is divided into blocks by the ids' hash; every
    pair of its blocks qb <= sb is one unit, so no unit holds more than PACK * block rows, and one of a long list some
    2 * block."""
    sizes = indexed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    # One row per list at most, whose number the index bounds.
    rows = indexed.join(F.broadcast(sizes), "list").withColumn("b", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda k: F.struct(F.least(F.col("b"), k).alias("qb"), F.greatest(F.col("b"), k).alias("sb")))
    pack_no = F.when(F.col("nb") == 1, F.floor(F.col("list") / PACK)).otherwise(-1 - F.col("list")).cast("int").alias("pack")
    spread_out = rows.select(*indexed.columns, pack_no, F.explode(others).alias("p"), "b")
    return spread_out.select(*indexed.columns, "pack", "p.qb", "p.sb", (F.col("b") == F.col("p.qb")).alias("query"))
