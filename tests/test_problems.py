import random
from datetime import datetime, timedelta

from stemma.operators.components import connected_components
from stemma.operators.hierarchy import descendants, edge_nodes, hierarchies, loop_edges, parent_links
from stemma.operators.orphans import find_orphans, orphan_report

T0 = datetime(2024, 1, 1)
E = "branch string, id string, type string, source_id string, target_id string, indexed_at timestamp, hit string"
N = "branch string, id string, indexed_at timestamp, deleted_at timestamp, reason string"
day = lambda k: None if k is None else T0 + timedelta(days=k)


def brute(edges, nodes):
    best = {}
    for b, i, t, s, d, at, _ in edges:
        if (b, i) not in best or (at or datetime.min) > (best[(b, i)][3] or datetime.min):
            best[(b, i)] = (t, s, d, at)
    out = set()
    for (b, i), (t, s, d, at) in best.items():
        for side, x in (("source", s), ("target", d)):
            if not x:
                continue
            vis = [n for n in nodes if n[1] == x and n[0] in (b, "main")]
            if any(n[2] and at and n[2] <= at and (n[3] is None or n[3] > at) for n in vis):
                continue
            out.add((b, i, side, "missing" if not vis else "late" if any(n[2] and at and n[2] > at for n in vis) else "deleted"))
    return out


def test_orphans_equal_brute_force_with_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(1)
    edges = [(rng.choice(["main", "f", "g"]), f"e{rng.randint(0, 60)}", "Calls", rng.choice(["", None, "hot", *[f"n{k}" for k in range(12)]]), rng.choice(["hot", "hot", *[f"n{k}" for k in range(20)]]), None, "x") for _ in range(150)]
    edges = [(*e[:5], day(k), "x") for k, e in enumerate(edges)]  # distinct times: one current row per key
    nodes = [(rng.choice(["main", "f"]), f"n{rng.randint(0, 14)}", day(rng.randint(0, 150)), rng.choice([None, None, day(rng.randint(20, 170))]), "y") for _ in range(60)] + [("main", None, day(1), None, "y"), (None, "n1", day(1), None, "y"), ("main", "n2", None, None, "y")]
    e, n = spark.createDataFrame(edges + edges[:20], E), spark.createDataFrame(nodes + nodes[:10], N)
    got = {(r.branch, r.edge_id, r.side, r.reason) for r in find_orphans(e, n).collect()}
    assert got == brute(edges, nodes) and len(got) > 20
    assert orphan_report(find_orphans(e, n)).agg({"orphans": "sum"}).first()[0] == len(got)
    # A filter far too small for the keys only costs joins.
    assert {(r.branch, r.edge_id, r.side, r.reason) for r in find_orphans(e, n, 64).collect()} == got


def test_orphans_of_empty_tables(spark):
    e, n = spark.createDataFrame([("main", "e", "Calls", "a", "b", day(1), "")], E), spark.createDataFrame([], N)
    assert sorted(r.reason for r in find_orphans(e, n).collect()) == ["missing", "missing"]
    assert find_orphans(e.limit(0), n).count() == 0


def forest(rng, n, loops=True):
    links = []
    for c in range(1, n):
        links.append((f"n{c}", f"n{rng.randint(0, n - 1) if loops and rng.random() < 0.1 else rng.randint(max(0, c - 6), c - 1)}"))
    return links


def climb(links):
    parent = dict(links)
    out = {}
    for x in {y for link in links for y in link}:
        way = [x]
        while way[-1] in parent and parent[way[-1]] not in way:
            way.append(parent[way[-1]])
        if way[-1] in parent:
            ring = way[way.index(parent[way[-1]]):]
            out[x] = (min(ring), -1, x in ring)
        else:
            out[x] = (way[-1], len(way) - 1, False)
    return out


def test_hierarchies_both_ways_equal_climbing(spark):
    links = forest(random.Random(7), 300) + [("self", "self"), ("s2", "self")]
    want = climb(links)
    df = spark.createDataFrame(links, "child string, parent string")
    for limit in (10**6, 5):
        got = {r.node_id: (r.root_id, r.depth, r.on_loop) for r in hierarchies(df, max_component=limit).collect()}
        assert got == want
        slim = {r.node_id: (r.root_id, r.depth, r.on_loop) for r in hierarchies(df, max_component=limit, with_paths=False).collect()}
        assert slim == want
    h = hierarchies(df)
    assert loop_edges(h).count() == sum(v[2] for v in want.values())
    assert descendants(h).count() == sum(v[1] for v in want.values() if v[1] > 0)
    for r in h.where("depth > 0").collect():
        assert r.path[0] == r.root_id and r.path[-1] == r.node_id and len(r.path) == r.depth + 1


def test_deep_chain_and_lone_nodes(spark):
    chain = [(f"c{k:04d}", f"c{k - 1:04d}") for k in range(1, 1500)]
    df = spark.createDataFrame(chain, "child string, parent string")
    lone = spark.createDataFrame([("x",), ("c0000",), (None,)], "id string")
    for limit in (10**6, 10):
        h = {r.node_id: r.depth for r in hierarchies(df, lone, limit, with_paths=False).collect()}
        assert h["c1499"] == 1499 and h["x"] == 0 and h["c0000"] == 0 and len(h) == 1501
    assert hierarchies(df.limit(0)).count() == 0


def test_parent_is_the_newest_then_the_smallest(spark):
    rows = [("main", "1", "Contains", "b", "x", day(1), ""), ("main", "2", "Contains", "c", "x", day(3), ""), ("main", "3", "Contains", "a", "x", day(3), ""), ("main", "4", "Calls", "q", "x", day(9), ""), ("f", "5", "Contains", "q", "x", day(9), ""), ("main", "6", "Contains", "", "x", day(9), ""), ("main", "7", "Contains", "d", None, day(9), ""), ("main", "8", "Contains", "e", "y", None, "")]
    e = spark.createDataFrame(rows, E)
    assert {(r.child, r.parent) for r in parent_links(e).collect()} == {("x", "a"), ("y", "e")}
    assert sorted(r.id for r in edge_nodes(e).collect()) == ["a", "b", "c", "e", "x", "y"]


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(500, k) for k in range(300, 400)] + [(7, 7), (900, 900)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up}
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links + [(None, 3)], "u long, v long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_large_components_give_what_the_walk_gives(spark):
    """Trees, a loop with trees on it, a loop alone and an edge to itself, walked and by pointer doubling."""
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("e", "d")] + [("p", "q"), ("q", "r"), ("r", "p"), ("s", "p"), ("t", "s"), ("u", "s"), ("v", "q")] + [("x", "y"), ("y", "x"), ("z", "z"), ("w", "z")]
    df = spark.createDataFrame(links, "child string, parent string")
    key = lambda r: (r.node_id, r.parent_id, r.root_id, r.depth, tuple(r.path), r.n_descendants, r.on_loop, r.loop_size)
    walked, doubled = (sorted(map(key, hierarchies(df, max_component=m).collect())) for m in (1000, 1))
    assert walked == doubled and len(walked) == 16
