"""Problem 7: parent-child links to full hierarchies.

Connected components are found first; every component of at most max_component nodes is co-located and
walked by an iterative depth-first traversal with node colouring. Larger components are never brought to one
task: they are resolved by pointer doubling, whose rounds grow with the logarithm of the depth.
Both ways give the same columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop_cut, partitions, ship
from .components import connected_components

OUT = "node_id string, parent_id string, root_id string, depth int, path array<string>, n_descendants long, on_loop boolean, loop_size int"


def parent_links(edges: DataFrame, branch: str | None = "main", edge_type: str | None = "Contains") -> DataFrame:
    """child, parent: the source of the child's newest row, on a tie the smallest source_id.

    Rows with a null or empty end are dropped; a null indexed_at is older than any time."""
    rows = edges.select("branch", "type", "source_id", "target_id", "indexed_at")
    if branch is not None:
        rows = rows.where(F.col("branch") == branch)
    if edge_type is not None:
        rows = rows.where(F.col("type") == edge_type)
    rows = rows.where("source_id <> '' and target_id <> ''")
    age = F.coalesce(-F.unix_micros(F.col("indexed_at").cast("timestamp")), F.lit((1 << 63) - 1))
    return rows.groupBy(F.col("target_id").alias("child")).agg(
        F.min(F.struct(age.alias("age"), F.col("source_id").alias("parent"))).alias("p")
    ).select("child", "p.parent")


def edge_nodes(edges: DataFrame, branch: str = "main", edge_type: str = "Contains") -> DataFrame:
    """All ids at either end of the usable rows, also of sources that are nobody's current parent."""
    rows = edges.where((F.col("branch") == branch) & (F.col("type") == edge_type))
    rows = rows.where("source_id <> '' and target_id <> ''")
    return rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()


def walk_component(children, parents, with_paths=True):
    """Iterative depth-first traversal with colouring (white, grey, black) of whole components' parent map.

    Yields rows of OUT. A grey node met again closes a back edge: the nodes of that loop and all
    below it get depth -1 and the smallest id of the loop as root."""
    parent = dict(zip(children, parents))
    kids: dict = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)
    nodes = set(parent) | set(kids)
    colour: dict = {}
    loop_of: dict = {}
    for start in nodes:  # upwards: a functional graph has one way up, so the stack is a path
        trail, n = [], start
        while n is not None and n not in colour:
            colour[n] = 1
            trail.append(n)
            n = parent.get(n)
        if n is not None and colour.get(n) == 1:
            ring = trail[trail.index(n):]
            least = min(ring)
            for x in ring:
                loop_of[x] = (least, len(ring))
        for x in trail:
            colour[x] = 2
    rows = []
    size: dict = {}
    first = (lambda n: [n]) if with_paths else (lambda n: None)
    starts = [(n, n, 0, first(n)) for n in nodes if n not in parent] + [(n, loop_of[n][0], -1, first(n)) for n in loop_of]
    for n, root, depth, path in starts:
        stack = [(n, root, depth, path, False)]
        while stack:
            x, root, depth, path, done = stack.pop()
            below = [c for c in kids.get(x, ()) if c not in loop_of]
            if done:
                size[x] = sum(1 + size[c] for c in below)
                on = loop_of.get(x)
                rows.append((x, parent.get(x), root, depth, path, size[x], on is not None, on[1] if on else 0))
                continue
            stack.append((x, root, depth, path, True))
            for c in below:
                stack.append((c, root, depth + 1 if depth >= 0 else -1, path + [c] if with_paths else None, False))
    return rows


def _walk(pdf: pd.DataFrame, with_paths: bool) -> pd.DataFrame:
    cols = [c.split(" ")[0] for c in OUT.split(", ")]
    return pd.DataFrame(walk_component(pdf["child"].tolist(), pdf["parent"].tolist(), with_paths), columns=cols)


def _double(links: DataFrame, with_paths: bool, max_rounds: int = 64) -> DataFrame:
    """The large components: pointer doubling. Roots, depths and paths in log2(depth) rounds; what never
    reaches a root hangs on a loop and goes on until a jump is longer than the longest possible loop."""
    nodes = links.select(F.col("child").alias("id"), F.col("parent").alias("up"))
    tops = links.select(F.col("parent").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    path = F.array("up", "id") if with_paths else F.array().cast("array<string>")
    # jump: id reached; steps: how far; least: smallest id on the way; path: from jump down to id
    state = cut(
        nodes.select("id", F.col("up").alias("jump"), F.lit(1).cast("long").alias("steps"), F.least("id", "up").alias("least"), path.alias("path"), F.lit(False).alias("top"))
        .unionByName(tops.select("id", F.col("id").alias("jump"), F.lit(0).cast("long").alias("steps"), F.col("id").alias("least"), (F.array("id") if with_paths else F.array().cast("array<string>")).alias("path"), F.lit(True).alias("top")))
    )
    total, open_before = state.count(), -1
    looping = False
    for r in range(max_rounds):
        target = state.select(F.col("id").alias("jump"), F.col("jump").alias("j2"), F.col("steps").alias("s2"), F.col("least").alias("l2"), F.col("path").alias("p2"), F.col("top").alias("t2"))
        done, todo = state.where("top"), state.where("not top")
        joined = todo.join(target, "jump").select(
            "id", F.col("j2").alias("jump"), (F.col("steps") + F.col("s2")).alias("steps"), F.least("least", "l2").alias("least"),
            (F.when(F.lit(looping), F.col("path")).otherwise(F.concat("p2", F.slice("path", 2, (1 << 31) - 1))) if with_paths else F.col("path")).alias("path"),
            F.col("t2").alias("top"),
        )
        nxt = cut(done.unionByName(joined))
        drop_cut(state)
        state = nxt
        left = state.where("not top").count()
        # Nothing resolved in a round whose jumps exceed what is left: only loops remain.
        if left == 0 or (looping and 2 ** (r + 1) > total):
            break
        looping = looping or left == open_before
        open_before = left
    state = state.select("id", F.when(F.col("top"), F.col("jump")).alias("root"), F.when(F.col("top"), F.col("steps").cast("int")).otherwise(-1).alias("depth"), "path", "least", "jump")
    # On a loop the way is longer than the loop, so 'least' of any node that lies on it is the loop's least id.
    ring = state.where("root is null").select(F.col("jump").alias("x")).distinct()
    loops = state.where("root is null").join(ring, F.col("id") == F.col("x"), "left_semi").select(F.col("id").alias("jump"), F.col("least").alias("lroot"), F.lit(True).alias("is_on"))
    out = state.join(loops.select("jump", "lroot"), "jump", "left").join(loops.select(F.col("jump").alias("id"), "is_on"), "id", "left")
    sizes = loops.groupBy("lroot").agg(F.count("*").cast("int").alias("loop_size"))
    out = out.join(sizes, "lroot", "left").join(nodes, "id", "left")
    return out.select(
        F.col("id").alias("node_id"), F.col("up").alias("parent_id"), F.coalesce("root", "lroot").alias("root_id"), "depth", "path",
        F.lit(None).cast("long").alias("n_descendants"), F.coalesce("is_on", F.lit(False)).alias("on_loop"),
        F.when(F.coalesce("is_on", F.lit(False)), F.col("loop_size")).otherwise(0).alias("loop_size"),
    )


def hierarchies(links: DataFrame, nodes: DataFrame | None = None, max_component: int = 200_000, with_paths: bool = True) -> DataFrame:
    """links(child, parent) -> one row of OUT per node: parent, root, depth, path from the root, number of
    descendants, and whether it lies on a loop. Ids of nodes(id) that no link has are roots of depth 0.

    Of a child given twice the smallest parent counts. A node on a loop, or below one, has depth -1 and the
    loop's smallest id as root; its path starts at the loop's node. Null ends are dropped; an empty input
    gives an empty result. n_descendants leaves the ring itself out for nodes on a loop. Paths take the sum of
    all depths in space; with_paths=False leaves them (and n_descendants of large components) null."""
    ship(links.sparkSession)
    clean = links.where("child is not null and parent is not null").groupBy("child").agg(F.min("parent").alias("parent"))
    clean = cut(clean)
    comp = connected_components(clean.select(F.col("child").alias("u"), F.col("parent").alias("v")))
    tagged = cut(clean.join(comp, F.col("child") == F.col("id")).select("child", "parent", "component"))
    sizes = tagged.groupBy("component").agg((F.count("*") + 1).alias("n"))
    large = sizes.where(F.col("n") > max_component).select("component")
    n_large = large.count()
    small = tagged.join(large, "component", "left_anti") if n_large else tagged
    # Whole components, packed by their id's hash into groups of some 20,000 links and one component more.
    packs = max(partitions(links.sparkSession), tagged.count() // 20_000)
    pack = F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack")
    out = small.groupBy(pack).applyInPandas(lambda p: _walk(p, with_paths), OUT)
    if n_large:
        big = cut(tagged.join(large, "component").select("child", "parent"))
        wide = cut(_double(big, with_paths))
        if with_paths:
            ways = wide.where("depth >= 0").select("node_id", "path")
            hanging = cut(wide.where("depth < 0 and not on_loop").select(F.col("node_id").alias("child")))
            if not hanging.isEmpty():
                # Without the rings' own links, what hangs on a loop is a tree below the ring's node.
                inner = cut(_double(big.join(hanging, "child", "left_semi"), True)).select("node_id", "path")
                ways = cut(ways.unionByName(inner))
            below = ways.select(F.explode("path").alias("node_id")).groupBy("node_id").agg((F.count("*") - 1).alias("k"))
            wide = wide.drop("path").join(ways, "node_id", "left").withColumn("path", F.coalesce("path", F.array("node_id")))
            wide = wide.join(below, "node_id", "left").withColumn("n_descendants", F.coalesce("k", F.lit(0))).drop("k")
        else:
            wide = wide.withColumn("path", F.lit(None).cast("array<string>")).withColumn("n_descendants", F.lit(None).cast("long"))
        out = out.unionByName(wide.select(out.columns))
    if nodes is not None:
        lone = nodes.select(F.col("id").alias("node_id")).where("node_id is not null").distinct()
        ends = clean.select(F.explode(F.array("child", "parent")).alias("node_id")).distinct()
        lone = lone.join(ends, "node_id", "left_anti")
        out = out.unionByName(lone.select(
            "node_id", F.lit(None).cast("string").alias("parent_id"), F.col("node_id").alias("root_id"), F.lit(0).alias("depth"),
            F.array("node_id").alias("path"), F.lit(0).cast("long").alias("n_descendants"), F.lit(False).alias("on_loop"), F.lit(0).alias("loop_size"),
        ))
    return out


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node below another, from the paths; loops excluded."""
    h = hierarchy.where("depth > 0")
    return h.select("node_id", "depth", F.posexplode("path").alias("at", "ancestor_id")).where("at < depth").select(
        "ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance")
    )


def loop_edges(hierarchy: DataFrame) -> DataFrame:
    """The back edges: the parent links of all nodes that lie on a loop."""
    return hierarchy.where("on_loop").select("node_id", "parent_id", "root_id", "loop_size")
