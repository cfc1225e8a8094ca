import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import cells, cluster, postings, similar

DIM = 128


def faces(seed=0, groups=40, singles=60, hot=300):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        c = rng.normal(size=DIM)
        c /= np.linalg.norm(c)
        for _ in range(hot if g == 0 else int(rng.integers(2, 12))):
            x = c + rng.normal(size=DIM) * 0.045
            rows.append(x / np.linalg.norm(x) * rng.choice([1.0, 1.0, 7.5]))
    rows += [rng.normal(size=DIM) for _ in range(singles)]
    rows += [rows[0].copy(), rows[0] * 3.0]
    order = rng.permutation(len(rows))
    return [(int(k * 3 + 1), [float(v) for v in rows[i]]) for k, i in enumerate(order)]


BAD = [(900001, None), (900002, []), (900003, [0.0] * DIM), (900004, [1.0] * 5), (900005, [float("nan")] + [1.0] * 127), (900006, [float("inf")] + [0.0] * 127), (900007, [None] + [1.0] * 127)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", -1) for i, v in rows], "face_id long, embedding array<double>, id string, list int")


def brute(rows, k=5, least=0.75):
    ids = np.array([i for i, _ in rows])
    u = postings.unit(np.array([v for _, v in rows]))
    s = u @ u.T
    near, parent = set(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        c = [b for b in range(len(rows)) if b != a and s[a, b] >= least]
        for b in sorted(c, key=lambda b: (-round(s[a, b], 12), ids[b]))[:k]:
            near.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
        for b in c:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(int(ids[a]))
    return near, {(i, min(g)) for g in groups.values() if len(g) > 1 for i in g}


def test_neighbours_and_groups_against_brute_force(spark):
    rows = faces()
    df = frame(spark, rows + BAD)
    near, groups = brute(rows)
    got = {(r.a, r.b) for r in similar.pairs(similar.nearest(df, "face_id", "embedding")).collect()}
    assert len(got & near) >= 0.98 * len(near) and len(got - near) <= 0.02 * len(near)
    found = cluster.similarity_groups(df, "face_id", "embedding").cache()
    assert {(r.id, r.group) for r in found.select("id", "group").collect()} == groups
    # Markov clusters lie within groups, and every group is described once.
    assert found.select("cluster", "group").distinct().count() == found.select("cluster").distinct().count()
    told = {r["group"]: r for r in cluster.describe(found, "group").collect()}
    assert sum(r.size for r in told.values()) == len(groups) and all(1 <= len(r.typical) <= 3 for r in told.values())


def test_empty_and_only_bad_rows(spark):
    for rows in ([], BAD):
        df = frame(spark, rows)
        assert similar.nearest(df, "face_id", "embedding").count() == 0
        assert cluster.similarity_groups(df, "face_id", "embedding") is None


def test_identical_vectors_tie_by_id(spark):
    v = [1.0] + [0.0] * 127
    df = frame(spark, [(i, v) for i in range(1, 10)])
    got = {(r.id, r.rank): r.neighbour for r in similar.nearest(df, "face_id", "embedding").collect()}
    assert [got[(9, k)] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [got[(1, k)] for k in range(1, 6)] == [2, 3, 4, 5, 6]


def test_hot_list_in_blocks_equals_one_block(spark):
    rows = faces(3, groups=1, singles=0, hot=120)
    df = frame(spark, rows)
    whole = {tuple(r) for r in similar.nearest(df, "face_id", "embedding").select("id", "neighbour", "rank").collect()}
    parts = {tuple(r) for r in similar.nearest(df, "face_id", "embedding", block=16).select("id", "neighbour", "rank").collect()}
    assert parts == whole and len(whole) == 5 * 122
    groups = [{tuple(r) for r in cluster.similarity_groups(df, "face_id", "embedding", block=b).select("id", "group").collect()} for b in (16, 2048)]
    assert groups[0] == groups[1] == brute(rows)[1]


@pytest.mark.parametrize("n", [1, 5, 300, 3000])
def test_graph_search_finds_near_centroids(n):
    rng = np.random.default_rng(5)
    c = postings.unit(rng.normal(size=(n, DIM))).astype(np.float32)
    g = postings.CentroidGraph.build(c)
    pick = rng.integers(0, n, 200)
    q = postings.unit(c[pick] + rng.normal(size=(200, DIM)) * 0.04)
    row, lists, far = g.lists(q)
    nearest = {r: k for r, k in reversed(list(zip(row, lists)))}
    assert set(row) == set(range(200)) and np.mean([k == pick[r] for r, k in nearest.items()]) >= 0.99 and not far.any()
    assert len({(r, k) for r, k in zip(row, lists)}) == len(row) and np.bincount(row).max() <= postings.REPLICAS


@pytest.mark.parametrize("kind,size", [(np.float16, 2), (np.float32, 4), (np.float64, 8)])
def test_packed_vectors_are_exact(kind, size):
    x = np.random.default_rng(1).normal(size=(50, DIM)).astype(kind).astype(np.float64)
    raw = postings.pack(x)
    assert (postings.unpack(raw) == x).all() and len(raw[0]) == size * DIM + 1
    other = postings.pack(x[:3].astype(np.float16).astype(np.float64))
    assert (postings.unpack(raw + other)[50:] == x[:3].astype(np.float16)).all()


def test_balance_splits_heavy_centroids():
    rng = np.random.default_rng(6)
    u = postings.unit(np.r_[rng.normal(size=(400, DIM)) * 0.03 + np.eye(DIM)[0], rng.normal(size=(40, DIM))])
    c, own = postings.choose_centroids(u)
    assert len(postings.balance(u, own, c, 1.0, 100_000)) == len(c)
    assert len(postings.balance(u, own, c, 1000.0, 100_000)) >= len(c) + 6


def test_markov_clusters_of_two_cliques_and_a_bridge(spark):
    links = [(a, b, 0.9) for a in range(5) for b in range(a)] + [(a + 10, b + 10, 0.9) for a in range(5) for b in range(a)] + [(4, 10, 0.3), (7, 7, 1.0), (None, 3, 1.0)]
    got = {r.id: r.cluster for r in cluster.markov_clusters(spark.createDataFrame(links, "a long, b long, weight double")).collect()}
    assert len({got[k] for k in range(5)}) == 1 and len({got[k + 10] for k in range(5)}) == 1 and got[0] != got[10]
    assert cluster.markov_clusters(spark.createDataFrame([], "a long, b long, weight double")).count() == 0


def test_markov_rounds_settle_alike_in_one_task_and_in_many(spark):
    rng = random.Random(2)
    links = [(a, b, rng.random() + 0.1) for a in range(120) for b in {rng.randrange(120), (a * 7 + 1) % 120} if a != b]
    df = spark.createDataFrame(links, "a long, b long, weight double")
    got = [{r.id: r.cluster for r in cluster.markov_clusters(df, finish=f).collect()} for f in (0, 100, 10**6)]
    parts = [{frozenset(i for i in g if g[i] == c) for c in set(g.values())} for g in got]
    assert len(parts[0]) > 3 and len(parts[0] & parts[2]) >= 0.9 * len(parts[2]) and len(parts[1] & parts[2]) >= 0.9 * len(parts[2])
    with pytest.raises(RuntimeError):
        cluster.markov_clusters(df, finish=0, rounds=1)


def test_settled_matrix_against_dense_rounds():
    rng = np.random.default_rng(8)
    m = np.kron(np.eye(4), np.ones((5, 5))) * rng.uniform(0.5, 1, (20, 20))
    m /= m.sum(0)
    i, j = np.nonzero(m)
    got = cluster.settle(i, j, m[i, j], width=20)
    for _ in range(60):
        m = (m @ m) ** 2
        m = np.where(m >= 0.05 * m.sum(0), m, 0)
        m /= m.sum(0)
    out = np.zeros((20, 20))
    out[got[0], got[1]] = got[2]
    assert np.abs(out - m).max() < 1e-2


def test_the_check_only_looks_between_clusters():
    x = postings.unit(np.random.default_rng(1).normal(size=(6, DIM)) * 0.02 + np.eye(DIM)[0])
    unit_of_work = lambda clusters: pa.table({"list": [1] * 6, "id": range(6), "v": postings.pack(x), "qb": [0] * 6, "sb": [0] * 6, "query": [True] * 6, "cluster": clusters})
    check = cluster._between_clusters(0.75)
    assert check(unit_of_work([3] * 6)).num_rows == 0
    assert sorted(zip(*check(unit_of_work([3, 3, 4, 4, 5, 5])).to_pydict().values())) == [(4, 3), (5, 3)]


def small_groups(seed=4, groups=700, singles=300):
    """Groups of two to four, most of which a sample of 60 rows doesn't touch."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = postings.unit(rng.normal(size=(1, DIM)))[0]
        rows += [c + rng.normal(size=DIM) * 0.04 for _ in range(int(rng.integers(2, 5)))]
    rows += list(rng.normal(size=(singles, DIM)))
    order = rng.permutation(len(rows))
    return [(k, [float(v) for v in rows[i]]) for k, i in enumerate(order)]


def sampled(monkeypatch, sample=60):
    fit = postings.fit
    monkeypatch.setattr(similar, "fit", lambda vectors, vector, key: fit(vectors, vector, key, sample))


def test_groups_that_both_samples_miss_are_found(spark, monkeypatch):
    rows = small_groups()
    sampled(monkeypatch)
    found = cluster.similarity_groups(frame(spark, rows), "face_id", "embedding")
    got, want = {(r.id, r.group) for r in found.select("id", "group").collect()}, brute(rows)[1]
    assert len(got & want) >= 0.995 * len(want) and len(got - want) <= 0.005 * len(want)


def test_neighbours_that_both_samples_miss_are_found(spark, monkeypatch):
    rows = small_groups(7, 400, 200)
    sampled(monkeypatch)
    got = {(r.a, r.b) for r in similar.pairs(similar.nearest(frame(spark, rows), "face_id", "embedding")).collect()}
    near = brute(rows)[0]
    assert len(got & near) >= 0.995 * len(near) and len(got - near) <= 0.005 * len(near)


@pytest.mark.parametrize("cosine", [0.76, 0.85])
def test_alike_rows_share_a_cell_in_some_table(cosine):
    rng = np.random.default_rng(9)
    a = postings.unit(rng.normal(size=(400, DIM)))
    z = rng.normal(size=a.shape)
    z = postings.unit(z - (z * a).sum(1, keepdims=True) * a)
    b = cosine * a + np.sqrt(1 - cosine**2) * z
    u = np.r_[a, b].astype(np.float32)
    v, met = cells.narrow(u), set()
    width, tables = cells.layout(1_000_000)
    for t in range(tables):
        cell = cells.cells(u, cells.directions(t, DIM, 2 * width))
        order = np.argsort(cell, kind="stable")
        met |= {(min(p), max(p)) for p in zip(*(order[k].tolist() for k in cells.alike(cell[order], v[order])))}
    assert len(met & {(k, k + 400) for k in range(400)}) >= 0.98 * 400 and len(met) <= 400


def beside(rng, u, cosine):
    """A row for every row of u, of this cosine to it and in a direction of its own."""
    z = rng.normal(size=u.shape)
    z = postings.unit(z - (z * u).sum(1, keepdims=True) * u)
    return cosine * u + np.sqrt(1 - cosine**2) * z


def hubs(rng, near):
    """Sampled hubs with pairs beside them: of each pair one row is `near` from its hub, the other is far from it."""
    hub = postings.unit(rng.normal(size=(10, DIM)))
    members = np.concatenate([h + rng.normal(size=(100, DIM)) * 0.02 for h in hub])
    h = np.repeat(hub, 20, axis=0)
    a = beside(rng, h, near)
    off = postings.unit((h * a).sum(1, keepdims=True) * a - h)
    b = 0.77 * a + np.sqrt(1 - 0.77**2) * (0.8 * off + 0.6 * postings.unit(beside(rng, off, 0.0)))
    rows = np.r_[members, a, postings.unit(b), rng.normal(size=(300, DIM))]
    order = rng.permutation(len(rows))
    at = np.argsort(order)
    return [(k, [float(v) for v in rows[i]]) for k, i in enumerate(order)], at[1000:1200], at[1200:1400]


def test_neighbours_of_which_one_is_near_a_centroid(spark, monkeypatch):
    rows, a, b = hubs(np.random.default_rng(12), 0.64)
    sampled(monkeypatch)
    got = {(r.a, r.b) for r in similar.pairs(similar.nearest(frame(spark, rows), "face_id", "embedding")).collect()}
    near = brute(rows)[0]
    want = near & {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(want) >= 150 and len(got & want) >= 0.98 * len(want)
    assert len(got & near) >= 0.98 * len(near) and len(got - near) <= 0.02 * len(near)


def test_the_second_sample_is_not_drawn_from_the_first(spark, monkeypatch):
    rows, sizes, choose = small_groups(5, 400, 600), [], postings.choose_centroids
    monkeypatch.setattr(postings, "choose_centroids", lambda u: sizes.append(len(u)) or choose(u))
    sampled(monkeypatch)
    similar.posting_lists(frame(spark, rows), "face_id", "embedding")
    assert len(sizes) == 2 and min(sizes) >= 35


def test_a_cell_of_many_alike_rows_is_joined_in_bounded_memory():
    rng = np.random.default_rng(13)
    x = postings.unit(np.r_[rng.normal(size=(9000, DIM)) * 0.03 + np.eye(DIM)[0], rng.normal(size=(50, DIM)), rng.normal(size=(9000, DIM)) * 0.03 + np.eye(DIM)[1]])
    tracemalloc.start()
    a, b = cells.alike(np.zeros(len(x), np.int64), cells.narrow(x))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and len(a) == 2 * 8999 and set(a.tolist()) == {0, 9050} and ((a == 0) == (b < 9000)).all()


def test_neighbours_of_which_one_is_near_a_centroid_and_few_are_far(spark, monkeypatch):
    rows, a, b = hubs(np.random.default_rng(14), 0.64)
    fit = postings.fit
    monkeypatch.setattr(similar, "fit", lambda vectors, vector, key: fit(vectors, vector, key, 60 if vector == "embedding" else 10_000))
    got = {(r.a, r.b) for r in similar.pairs(similar.nearest(frame(spark, rows), "face_id", "embedding")).collect()}
    want = brute(rows)[0] & {(min(p), max(p)) for p in zip(a.tolist(), b.tolist())}
    assert len(want) >= 150 and len(got & want) >= 0.98 * len(want)
