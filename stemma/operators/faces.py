"""Clustering of embeddings as the studied system defines it: average linkage, noise absorption, DBSCAN, merging,
splitting, merge suggestions, labels, and non-maximum suppression (L01-L08, A23, A24, T10).

Average linkage and DBSCAN depend on the order of all rows of a run. cluster_runs takes the runs as given, each of at
most MAX_RUN rows. cluster_whole clusters a whole collection: neither method ever joins rows that no chain of pairs at
or above its threshold connects, so the connected parts of that graph are runs that give the result of one run over all."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..session import cut, partitions, ship
from .components import connected_components

MAX_RUN = 4000
BLOCK_ROWS, STRIP = 8192, 512
#: Joins of at least this similarity are made first, in the small connected parts of that level.
COARSE = 0.6
LABELS = "run string, id long, cluster int"


def _units(vectors) -> np.ndarray:
    x = np.array(list(vectors), dtype=np.float64)
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def agglomerate(u: np.ndarray, images: list, least: float, min_size: int) -> list[int]:
    """Average linkage: the most similar pair of clusters without a common image is joined while their mean similarity
    is at least `least` and positive; small clusters become -1, the rest is numbered from 1 by first member.
    Sums of similarities are kept per pair of clusters, so a join costs one row."""
    n = len(u)
    total = u @ u.T
    size = np.ones(n)
    block = np.equal.outer(np.array(images, object), np.array(images, object)) if n else np.zeros((0, 0), bool)
    np.fill_diagonal(block, True)
    alive = np.ones(n, bool)
    owner = np.arange(n)
    while True:
        mean = np.where(block | ~alive[:, None] | ~alive[None, :], -np.inf, total / np.outer(size, size))
        mean = np.triu(mean, 1) + np.where(np.tri(n, dtype=bool), -np.inf, 0)
        if not n or not np.isfinite(mean).any():
            break
        at = int(mean.argmax())
        a, b = divmod(at, n)
        if mean[a, b] < least or mean[a, b] <= 0:
            break
        total[a] += total[b]
        total[:, a] += total[:, b]
        size[a] += size[b]
        block[a] |= block[b]
        block[:, a] |= block[:, b]
        block[a, a] = True
        alive[b] = False
        owner[owner == b] = a
    labels, nxt = {}, 1
    for c in np.flatnonzero(alive):
        if size[c] < min_size:
            labels[c] = -1
        else:
            labels[c], nxt = nxt, nxt + 1
    return [labels[o] for o in owner]


def linkage(total: np.ndarray, size: np.ndarray, images: list[set], least: float) -> np.ndarray:
    """The clusters of `agglomerate` without its matrix: row i is a cluster of size[i] rows whose unit vectors add up to
    total[i]; the result is each row's first row. Joining two clusters never brings the new one closer to a third than
    the closer of the two was (a mean lies between its parts, a common image stays one), so all pairs that are each
    other's nearest can be joined at once and only rows that lose their nearest look for another. Similarities are
    compared to 12 decimals, ties go to the lower row."""
    n = len(total)
    total, size, images = total.copy(), size.astype(np.float64), [set(x) for x in images]
    where: dict = {}
    for i, own in enumerate(images):
        for image in own:
            where.setdefault(image, set()).add(i)
    alive, dirty, owner = np.ones(n, bool), np.ones(n, bool), np.arange(n)
    near, best = np.full(n, -1), np.full(n, -np.inf)
    while True:
        live, todo = np.flatnonzero(alive), np.flatnonzero(alive & dirty)
        mean, place = total[live] / size[live, None], np.full(n, -1)
        place[live] = np.arange(len(live))
        for a in range(0, len(todo), STRIP):
            rows = todo[a : a + STRIP]
            s = np.round(mean[place[rows]] @ mean.T, 12)
            for k, row in enumerate(rows):
                s[k, place[row]] = -np.inf
                for image in images[row]:
                    s[k, place[list(where[image])]] = -np.inf
            at = s.argmax(axis=1)
            near[rows], best[rows] = live[at], s[np.arange(len(rows)), at]
        some = np.flatnonzero(alive & (best >= least) & (best > 0))
        if not len(some):
            break
        first = some[(near[near[some]] == some) & (some < near[some])]
        if not len(first):  # rounding parted the two directions of a pair
            first = some[[best[some].argmax()]]
        changed = []
        for a, b in zip(first.tolist(), near[first].tolist()):
            a, b = min(a, b), max(a, b)
            total[a] += total[b]
            size[a] += size[b]
            for image in images[b]:
                where[image].discard(b)
                where[image].add(a)
            images[a] |= images[b]
            alive[b], owner[b] = False, a
            changed += [a, b]
        dirty = np.isin(near, changed)
        dirty[changed] = True
    while (owner != owner[owner]).any():
        owner = owner[owner]
    return owner


def dbscan(u: np.ndarray, images: list, least: float, min_pts: int) -> list[int]:
    """Density clustering in row order; a cluster takes one row per image. -1 is noise. Neighbours are found a strip of
    rows at a time as they are asked for."""
    n, labels, cluster = len(u), [0] * len(u), 0
    known: dict[int, np.ndarray] = {}

    def neighbours(i: int, soon) -> np.ndarray:
        if i not in known:
            rows = list(dict.fromkeys([i, *[j for j in soon if labels[j] <= 0 and j not in known]]))[:STRIP]
            known.update(zip(rows, map(np.flatnonzero, (u[rows] @ u.T) >= least)))
        return known.pop(i)

    for i in range(n):
        if labels[i]:
            continue
        around = [j for j in neighbours(i, range(i + 1, min(n, i + STRIP))) if j != i]
        if len(around) + 1 < min_pts:
            labels[i] = -1
            continue
        cluster += 1
        labels[i] = cluster
        # A row passed over once is passed over for good, so it waits in the queue once.
        used, queue, waited = {images[i]}, list(around), {i, *around}
        for at, j in enumerate(queue):
            if labels[j] > 0 or images[j] in used:
                continue
            labels[j] = cluster
            used.add(images[j])
            more = [k for k in neighbours(j, queue[at + 1 : at + STRIP]) if k != j]
            if len(more) + 1 >= min_pts:
                new = [k for k in more if labels[k] <= 0 and k not in waited]
                queue.extend(new)
                waited.update(new)
    return labels


def cluster_runs(faces: DataFrame, run: str, method: str = "average", least: float = 0.3, min_size: int = 2, max_run: int = MAX_RUN) -> DataFrame:
    """faces(id, image, embedding, <run>) -> LABELS, one clustering per value of run, rows in the order of id.

    A run above max_run rows raises: these methods are quadratic in a run by definition."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_run:
            raise ValueError(f"run {pdf['run'].iloc[0]} has {len(pdf)} rows; the limit is {max_run}")
        pdf = pdf.sort_values("id")
        f = agglomerate if method == "average" else dbscan
        return pd.DataFrame({"run": pdf["run"], "id": pdf["id"], "cluster": f(_units(pdf["embedding"]), pdf["image"].tolist(), least, min_size)})

    src = faces.select(F.col(run).cast("string").alias("run"), F.col("id").cast("long").alias("id"), "image", "embedding").where("embedding is not null")
    return src.groupBy("run").applyInPandas(go, LABELS)


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label holds every row's smallest row."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label[:] = label[label]


def similar_links(faces: DataFrame, levels: list[float]) -> DataFrame:
    """(level, u, v): for each of the levels, links that connect all rows which pairs of at least that cosine connect.

    All pairs are compared, a pair of blocks a task; of what a task finds only a spanning star per connected part
    leaves it. Single precision proposes, double precision decides near a level."""
    n = max(1, -(-faces.count() // BLOCK_ROWS))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, block, u = pdf["id"].to_numpy(), pdf["block"].to_numpy(), _units(pdf["embedding"])
        left, right, w = np.flatnonzero(block == pdf["lo"].iloc[0]), np.flatnonzero(block == pdf["hi"].iloc[0]), u.astype(np.float32)
        labels = [np.arange(len(ids)) for _ in levels]
        for at in range(0, len(left), STRIP):
            rows = left[at : at + STRIP]
            s = w[rows] @ w[right].T
            for label, least in zip(labels, levels):
                r, c = np.nonzero(s >= least - 1e-5)
                x, y, ok = rows[r], right[c], np.ones(len(r), bool)
                close = np.flatnonzero(s[r, c] < least + 1e-5)
                ok[close] = np.einsum("ij,ij->i", u[x[close]], u[y[close]]) >= least
                _unite(label, x[ok], y[ok])
        out = [pd.DataFrame({"level": k, "u": ids[x[m]], "v": ids[m]}) for k, x in enumerate(labels) for m in [np.flatnonzero(x != np.arange(len(x)))]]
        return pd.concat(out).astype({"level": np.int32})

    src = faces.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    paired = src.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "embedding", "block", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"))
    return paired.groupBy("lo", "hi").applyInPandas(go, "level int, u long, v long")


def cluster_whole(faces: DataFrame, method: str = "average", least: float = 0.3, min_size: int = 2, reach: float | None = None) -> DataFrame:
    """faces(id, image, embedding) -> LABELS: one clustering over all rows, in the order of id. run is the smallest id of
    the row's connected part at `reach` (at most `least`, which it is if not given); clusters are numbered within it.

    A part is one task of time quadratic in its rows (average linkage: in its clusters at COARSE) and memory in proportion to them."""
    ship(faces.sparkSession)
    reach, high = min(least, least if reach is None else reach), max(least, COARSE)
    src = faces.select(F.col("id").cast("long").alias("id"), "image", "embedding").where("embedding is not null")
    levels = [reach, high] if method == "average" and high > reach else [reach]
    links = cut(similar_links(src, levels))
    parts = [connected_components(links.where(F.col("level") == k).select("u", "v")).withColumnRenamed("component", "run") for k in range(len(levels))]

    def join_high(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        own = linkage(_units(pdf["embedding"]), np.ones(len(pdf)), [{x} for x in pdf["image"]], high)
        return pd.DataFrame({"id": pdf["id"], "head": pdf["id"].to_numpy()[own]})

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        u = _units(pdf["embedding"])
        if method != "average":
            cluster = dbscan(u, pdf["image"].tolist(), least, min_size)
        else:
            _, at = np.unique(pdf["head"].to_numpy(), return_inverse=True)
            count = np.bincount(at)
            total, images = np.zeros((len(count), u.shape[1])), [set() for _ in count]
            np.add.at(total, at, u)
            for k, image in zip(at.tolist(), pdf["image"]):
                images[k].add(image)
            own = linkage(total, count, images, least)
            size = np.bincount(own, weights=count, minlength=len(count))
            kept = np.flatnonzero(size >= max(min_size, 1))
            number = np.full(len(count), -1)
            number[kept] = np.arange(1, len(kept) + 1)
            cluster = number[own][at]
        return pd.DataFrame({"run": pdf["run"].astype(str), "id": pdf["id"], "cluster": cluster})

    rows = src.join(parts[0], "id", "left")
    joined = rows.where("run is not null")
    if len(parts) > 1:
        heads = src.join(parts[1], "id").groupBy("run").applyInPandas(join_high, "id long, head long")
        joined = joined.join(heads, "id", "left").withColumn("head", F.coalesce("head", "id"))
    else:
        joined = joined.withColumn("head", F.col("id"))
    alone = rows.where("run is null").select(F.col("id").cast("string").alias("run"), "id", F.lit(1 if min_size <= 1 else -1).alias("cluster"))
    return joined.groupBy("run").applyInPandas(go, LABELS).unionByName(alone)


def absorb_noise(faces: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """(id, cluster): noise rows join the cluster of their most similar member, unless it has a row of their image;
    ties go to the lower cluster. Pairs are compared within a run only."""
    f = faces.select("id", "image", "embedding").join(labels, "id")
    members = f.where("cluster > 0").select("run", "cluster", F.col("image").alias("m_image"), F.col("embedding").alias("m_emb"))
    noise = f.where("cluster = -1").select("run", "id", "image", "embedding")
    images = members.select("run", "cluster", F.col("m_image").alias("image")).distinct()
    near = noise.join(members, "run").select("run", "id", "image", "cluster", cosine(F.col("embedding"), F.col("m_emb")).alias("s")).groupBy("run", "id", "image", "cluster").agg(F.max("s").alias("s"))
    free = near.join(images, ["run", "cluster", "image"], "left_anti").where(F.col("s") >= least).where("s > 0")
    best = free.groupBy("id").agg(F.max(F.struct("s", (-F.col("cluster")).alias("c"))).alias("b")).select("id", (-F.col("b.c")).alias("new"))
    return labels.join(best, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


def merge_clusters(labels: DataFrame, names: DataFrame, merge: list[int], into: int) -> tuple[DataFrame, DataFrame]:
    """labels(id, cluster) with the listed clusters made one; its name is the target's, else the first merged one's."""
    moved = labels.withColumn("cluster", F.when(F.col("cluster").isin(merge), into).otherwise(F.col("cluster")))
    rank = F.when(F.col("cluster") == into, 0).otherwise(F.col("cluster"))
    kept = names.where(F.col("cluster").isin([*merge, into])).agg(F.min_by("name", rank).alias("name")).where("name is not null").select(F.lit(into).alias("cluster"), "name")
    return moved, names.where(~F.col("cluster").isin([*merge, into])).unionByName(kept)


def split_cluster(faces: DataFrame, labels: DataFrame, cluster: int, least: float, min_pts: int = 2) -> DataFrame:
    """The cluster divided by DBSCAN: of the parts in the order of their first ids the first keeps the cluster's id, the
    others get new ones; noise becomes -1. A cluster of any size is divided, along the connected parts of its pairs at or
    above the threshold; only one row a part is ranked."""
    part = faces.join(labels.where(F.col("cluster") == cluster).select("id"), "id")
    top = labels.agg(F.max("cluster").alias("top")).scalar()
    sub = cut(cluster_whole(part, "dbscan", least, min_pts))
    first = sub.where("cluster > 0").groupBy("run", "cluster").agg(F.min("id").alias("first"))
    place = first.withColumn("place", F.row_number().over(Window.orderBy("first")))
    new = F.when(F.col("place") == 1, cluster).when(F.col("place") > 1, F.col("place") - 1 + F.coalesce(top, F.lit(0))).otherwise(-1)
    moved = sub.join(place, ["run", "cluster"], "left").select("id", new.cast("int").alias("new"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("new", "cluster").alias("cluster"))


MAX_MEANS_BYTES = 64 << 20


def suggest_merges(faces: DataFrame, labels: DataFrame, least: float = 0.2) -> DataFrame:
    """(a, b, avg) of cluster pairs (a < b) whose mean pair similarity exceeds `least`.

    The mean over all pairs of unit vectors is the product of the two clusters' mean vectors, so no pairs of rows are
    formed. The means go to all tasks in slices of at most some 64 MiB (65,000 clusters) and are multiplied in blocks; only
    pairs above the threshold leave a task."""
    spark = faces.sparkSession
    f = faces.select("id", "embedding").join(labels.where("cluster > 0").select("id", "cluster"), "id").select("cluster", F.col("embedding").cast("array<double>").alias("e"))

    def sums(frames):
        for pdf in frames:
            pdf = pdf[[v is not None and len(v) > 0 for v in pdf["e"]]]
            if pdf.empty:
                continue
            u = _units(pdf["e"])
            own, at = np.unique(pdf["cluster"].to_numpy(), return_inverse=True)
            total = np.zeros((len(own), u.shape[1]))
            np.add.at(total, at, u)
            count = np.bincount(at, weights=(u != 0).any(axis=1))
            yield pd.DataFrame({"cluster": own, "k": count.astype(np.int64), "s": list(total)})

    part = f.mapInPandas(sums, "cluster int, k long, s array<double>")  # one row per cluster and batch
    counts = part.select("cluster", "k", F.posexplode("s").alias("i", "x")).groupBy("cluster", "i").agg((F.sum("x") / F.greatest(F.sum("k"), F.lit(1))).alias("x"))
    means = counts.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))  # one entry per dimension
    means = cut(means)
    slices = max(1, -(-int(means.agg(F.sum(F.size("v") * 8)).first()[0] or 0) // MAX_MEANS_BYTES))

    def products(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(sorted((r.cluster, r.v) for r in part.collect()))

        def go(frames):
            ids = np.array([i for i, _ in shared.value], np.int64)
            m = np.array([v for _, v in shared.value], np.float64)
            for pdf in frames:
                if not len(ids) or pdf.empty:
                    continue
                s = np.array(pdf["v"].tolist(), np.float64) @ m.T
                own = pdf["cluster"].to_numpy()
                r, c = np.nonzero((s > least) & (own[:, None] < ids[None, :]))
                yield pd.DataFrame({"a": own[r], "b": ids[c], "avg": s[r, c]})

        return means.repartition(partitions(spark), "cluster").mapInPandas(go, "a int, b int, avg double")

    found = [products(means.where(F.pmod(F.col("cluster"), F.lit(slices)) == n)) for n in range(slices)]
    return reduce(DataFrame.unionByName, found).orderBy(F.col("avg").desc(), "a", "b")


def greatest_similarity(faces: DataFrame, labels: DataFrame, pairs: DataFrame, block: int = 1024) -> DataFrame:
    """pairs(a, b, ...) of clusters with max, the greatest similarity of a row of the one to a row of the other.

    Clusters are divided into blocks by the ids' hash, and a block of a meets a block of b in one task, so neither cluster
    is gathered; every block pair leaves one number."""
    f = faces.select("id", F.col("embedding").cast("array<double>").alias("e")).where("embedding is not null").join(labels.where("cluster > 0").select("id", "cluster"), "id")
    nb = f.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    rows = f.join(nb, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    two = pairs.select("a", "b").distinct()
    size = lambda side: nb.select(F.col("cluster").alias(side), F.col("nb").alias(f"n{side}"))
    sized = two.join(size("a"), "a").join(size("b"), "b")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select(F.col("cluster").alias("a"), F.col("block").alias("ba"), "e").join(sized, "a").withColumn("bb", others("nb")).withColumn("left", F.lit(True))
    right = rows.select(F.col("cluster").alias("b"), F.col("block").alias("bb"), "e").join(sized, "b").withColumn("ba", others("na")).withColumn("left", F.lit(False))
    cols = ["a", "b", "ba", "bb", "left", "e"]

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (_units(pdf.loc[pdf["left"] == side, "e"]) for side in (True, False))
        top = float((x @ y.T).max()) if len(x) and len(y) else None
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "max": [top]})

    best = left.select(*cols).unionByName(right.select(*cols)).groupBy("a", "b", "ba", "bb").applyInPandas(go, "a int, b int, max double")
    return pairs.join(best.groupBy("a", "b").agg(F.max("max").alias("max")), ["a", "b"])


def cluster_sizes(labels: DataFrame, names: DataFrame | None = None) -> DataFrame:
    out = labels.where("cluster > 0").groupBy("cluster").agg(F.count("*").alias("size"))
    return out.join(names, "cluster", "left") if names is not None else out


def unlabelled(labels: DataFrame, names: DataFrame) -> DataFrame:
    return cluster_sizes(labels).join(names, "cluster", "left_anti")


def appearances(faces: DataFrame, labels: DataFrame, names: DataFrame) -> DataFrame:
    """AppearsIn: every named cluster's person and its distinct images."""
    return faces.join(labels, "id").join(names, "cluster").select(F.col("name").alias("person"), "image").distinct()


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """boxes(image, idx, confidence, min_x, min_y, max_x, max_y) without those that overlap a more confident kept box of
    their image by more than `most` (intersection over union)."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "idx"], ascending=[False, True])
        x0, y0, x1, y1 = (pdf[c].to_numpy(float) for c in ("min_x", "min_y", "max_x", "max_y"))
        area, kept = np.maximum(0, x1 - x0) * np.maximum(0, y1 - y0), np.zeros(len(pdf), bool)
        for i in range(len(pdf)):
            k = np.flatnonzero(kept[:i])
            both = np.maximum(0, np.minimum(x1[i], x1[k]) - np.maximum(x0[i], x0[k])) * np.maximum(0, np.minimum(y1[i], y1[k]) - np.maximum(y0[i], y0[k]))
            kept[i] = not (both > most * np.maximum(area[i] + area[k] - both, 1e-9)).any()
        return pdf.loc[kept, ["image", "idx"]]

    src = boxes.where("min_x is not null and confidence is not null").select("image", "idx", F.col("confidence").cast("double").alias("confidence"), *[F.col(c).cast("long").alias(c) for c in ("min_x", "min_y", "max_x", "max_y")])
    return src.groupBy("image").applyInPandas(go, "image string, idx int")
