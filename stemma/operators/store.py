"""Store algebra: branch overlay, filters, point and neighbour lookups, mutations, export and path migration.

Everything is a lazy DataFrame over nodes and edges. Writes are expressed as the new state of the table; the
caller overwrites the branch partition with it (write_branch)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, NODE_COLUMNS, edge_id, node_id

# ---- F01-F05, F10: predicates ---------------------------------------------------------------------

# Types whose nodes are embedded, and types that count as code in ranking.
EMBEDDABLE = ["Function", "Method", "Class", "Struct", "Interface", "Document", "APIEndpoint", "Service", "DBModel", "AIGuideline", "Directory", "Topic", "Person"]
CODE_TYPES = ["Function", "Method", "Struct", "Class", "Interface", "Enum", "Type", "APIEndpoint", "TestFunction"]


def glob_regex(pattern: str) -> str | None:
    """A shell pattern as an anchored regex: * and ? stop at '/', [..] classes with ^ and ranges, backslash escapes.
    None for a malformed pattern, which matches nothing."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                return None
            out.append(re.escape(pattern[i]))
        elif c == "[":
            j = i + 1
            negate = j < len(pattern) and pattern[j] == "^"
            j += negate
            body, first = "", True
            while j < len(pattern) and (pattern[j] != "]" or first):
                if pattern[j] == "\\":
                    j += 1
                    if j >= len(pattern):
                        return None
                    body += re.escape(pattern[j])
                elif pattern[j] == "-" and not first and j + 1 < len(pattern) and pattern[j + 1] != "]":
                    body += "-"
                else:
                    body += re.escape(pattern[j])
                first = False
                j += 1
            if j >= len(pattern) or not body:
                return None
            out.append(f"[{'^' if negate else ''}{body}]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def glob(column: Column, pattern: str) -> Column:
    r = glob_regex(pattern)
    return F.lit(False) if r is None else column.rlike(r.replace("$", r"\z") if r.endswith("$") else r)


@dataclass
class NodeFilter:
    """Conjunction of constraints; unset ones hold for every node."""

    type: str = ""
    file_path: str = ""
    package: str = ""
    language: str = ""
    name_pattern: str = ""
    exported: bool | None = None
    properties: dict[str, str] = field(default_factory=dict)

    def column(self) -> Column:
        c = F.lit(True)
        for name in ("type", "file_path", "package", "language"):
            if getattr(self, name):
                c = c & (F.col(name) == getattr(self, name))
        if self.name_pattern:
            c = c & glob(F.col("name"), self.name_pattern)
        if self.exported is not None:
            c = c & (F.col("exported") == self.exported)
        for k, v in self.properties.items():
            # Property values match by containment, also when equality was meant.
            c = c & F.coalesce(F.element_at("properties", k).contains(v), F.lit(False))
        return c


# ---- S03, S05, S06, P09: overlay reads -------------------------------------------------------------


def _priority(branches: list[str]) -> Column:
    c = F.lit(len(branches))
    for i in reversed(range(len(branches))):
        c = F.when(F.col("branch") == branches[i], i).otherwise(c)
    return c


def overlay(rows: DataFrame, branches: list[str]) -> DataFrame:
    """Each id from the first branch that has it (dedup before anything looks at the content)."""
    read = rows.where(F.col("branch").isin(branches))
    names = [c for c in read.columns if c != "id"]
    return read.groupBy("id").agg(F.min_by(F.struct(*names), _priority(branches)).alias("r")).select(*[F.col("id") if c == "id" else F.col("r." + c) for c in read.columns])


def query_nodes(nodes: DataFrame, branches: list[str], flt: NodeFilter | None = None) -> DataFrame:
    """Filter first, then one version per id: where the version of the first branch doesn't match the filter but
    that of a later branch does, the later one is returned."""
    found = nodes.where(flt.column()) if flt else nodes
    return overlay(found, branches).withColumn("graph_source", F.col("branch"))


def get_node(nodes: DataFrame, branches: list[str], wanted: str) -> DataFrame:
    return overlay(nodes.where(F.col("id") == wanted), branches).withColumn("graph_source", F.col("branch"))


def list_branches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("branch").unionByName(edges.select("branch")).distinct()


# ---- J01-J05, U02: lookups along edges --------------------------------------------------------------


def get_edges(edges: DataFrame, node: str, edge_type: str = "") -> DataFrame:
    """Edges that leave or enter a node, a self-loop once."""
    c = (F.col("source_id") == node) | (F.col("target_id") == node)
    return edges.where(c & (F.col("type") == edge_type) if edge_type else c)


def directed(edges: DataFrame) -> DataFrame:
    """Every edge once per end: node_id, peer_id, direction (out, in), edge id and type; a self-loop only outwards."""
    out = edges.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("peer_id"), F.lit("out").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"))
    back = edges.where("source_id <> target_id").select(
        F.col("target_id").alias("node_id"), F.col("source_id").alias("peer_id"), F.lit("in").alias("direction"), F.col("id").alias("edge_id"), F.col("type").alias("edge_type"))
    return out.unionByName(back)


def neighbours(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, edge_type: str = "", direction: str = "both") -> DataFrame:
    """(node_id, peer columns) of the distinct existing peers of every seed(node_id); dangling peers fall away."""
    links = directed(edges if not edge_type else edges.where(F.col("type") == edge_type))
    if direction != "both":
        links = links.where(F.col("direction") == direction)
    pairs = links.join(seeds.select("node_id").distinct(), "node_id").select("node_id", "peer_id").distinct()
    peers = nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("peer_name"), F.col("type").alias("peer_type"))
    return pairs.join(peers, "peer_id").select("node_id", "peer_id", "peer_name", "peer_type")


def edge_entries(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, edge_type: str = "", direction: str = "both", keep_unresolved: bool = True) -> DataFrame:
    """(node_id, edge_id, edge_type, direction, peer_id, peer_name, peer_type): the peer's id stands for its name where it
    is not in the graph; keep_unresolved=False drops such rows."""
    links = directed(edges if not edge_type else edges.where(F.col("type") == edge_type))
    if direction != "both":
        links = links.where(F.col("direction") == direction)
    peers = nodes.select(F.col("id").alias("peer_id"), F.col("name").alias("n"), F.col("type").alias("t"))
    out = links.join(seeds.select("node_id").distinct(), "node_id").join(peers, "peer_id", "left" if keep_unresolved else "inner")
    return out.select("node_id", "edge_id", "edge_type", "direction", "peer_id", F.coalesce(F.when(F.col("n") != "", F.col("n")), F.col("peer_id")).alias("peer_name"), F.coalesce("t", F.lit("")).alias("peer_type"))


def resolve(nodes: DataFrame, wanted: str) -> DataFrame:
    """The node of that id, else the one of that name (glob) with the smallest id."""
    by_id = nodes.where(F.col("id") == wanted).withColumn("rank", F.lit(0))
    by_name = nodes.where(glob(F.col("name"), wanted)).withColumn("rank", F.lit(1))
    return by_id.unionByName(by_name).orderBy("rank", "id").limit(1).drop("rank")


def implementors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(interface_id, interface_name, implementor_id, implementor_name): interfaces without any keep one row of nulls."""
    faces = nodes.where("type = 'Interface'").select(F.col("id").alias("interface_id"), F.col("name").alias("interface_name"))
    impl = edges.where("type = 'Implements'").select(F.col("target_id").alias("interface_id"), F.col("source_id").alias("implementor_id")).distinct()
    named = impl.join(nodes.select(F.col("id").alias("implementor_id"), F.col("name").alias("implementor_name")), "implementor_id")
    return faces.join(named, "interface_id", "left").select("interface_id", "interface_name", "implementor_id", "implementor_name")


# ---- K01-K06, K10: mutations as new table states -------------------------------------------------------


def upsert(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows with those of new put in place of the same (branch, id). Repeated keys in new count once."""
    one = new.dropDuplicates(["branch", "id"])
    return rows.join(one.select("branch", "id"), ["branch", "id"], "left_anti").unionByName(one)


def update(rows: DataFrame, new: DataFrame) -> DataFrame:
    """As upsert, but every new key has to exist."""
    missing = new.join(rows.select("branch", "id"), ["branch", "id"], "left_anti").limit(1).count()
    if missing:
        raise KeyError("update of a node that does not exist")
    return upsert(rows, new)


def delete_nodes(nodes: DataFrame, edges: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes of keys(branch, id) and without the edges of that branch that touch them."""
    k = keys.select("branch", "id").distinct()
    left = nodes.join(k, ["branch", "id"], "left_anti")
    for end in ("source_id", "target_id"):
        edges = edges.join(k.select("branch", F.col("id").alias(end)), ["branch", end], "left_anti").select(*edges.columns)
    return left, edges


def delete_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    return edges.join(keys.select("branch", "id").distinct(), ["branch", "id"], "left_anti")


def delete_by_file(nodes: DataFrame, edges: DataFrame, branch: str, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes all nodes of the files (file_path) on the write branch only: other branches stay visible."""
    keys = nodes.where(F.col("branch") == branch).join(paths.select("file_path").distinct(), "file_path", "left_semi")
    return delete_nodes(nodes, edges, keys)


def delete_branches(rows: DataFrame, branches: list[str]) -> DataFrame:
    return rows.where(~F.col("branch").isin(branches))


def stale_branches(rows: DataFrame, live: DataFrame, keep: str = "default") -> DataFrame:
    """Branches of the store that version control no longer has."""
    return rows.select("branch").distinct().where(F.col("branch") != keep).join(live.select("branch"), "branch", "left_anti")


def write_branch(rows: DataFrame, path: str) -> None:
    """Overwrites the (branch, type) partitions that rows has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("branch", "type").parquet(path)


# ---- K07, S07-S09: JSON lines ------------------------------------------------------------------------------


def to_export(nodes: DataFrame, edges: DataFrame, branch: str) -> DataFrame:
    """Lines {kind, branch, data} of one branch, nodes before edges (column ord sorts them)."""
    lines = []
    for i, (kind, df, cols) in enumerate((("node", nodes, NODE_COLUMNS), ("edge", edges, EDGE_COLUMNS))):
        data = F.struct(*[F.col(c) for c in cols if c != "branch"])
        lines.append(df.where(F.col("branch") == branch).select(F.lit(i).alias("ord"), F.to_json(F.struct(F.lit(kind).alias("kind"), F.col("branch"), data.alias("data"))).alias("value")))
    return lines[0].unionByName(lines[1])


def from_export(lines: DataFrame, target_branch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of exported lines (column value); rows go to target_branch if given. Corrupt lines fall away."""
    strip = lambda s: ", ".join(p for p in s.replace("map<string,", "map<string;").split(", ") if not p.startswith("branch ")).replace(";", ",")
    out = []
    from ..model import EDGE_SCHEMA, NODE_SCHEMA

    for kind, schema in (("node", NODE_SCHEMA), ("edge", EDGE_SCHEMA)):
        row = F.from_json("value", f"kind string, branch string, data struct<{strip(schema).replace(' ', ':').replace(',:', ', ')}>")
        df = lines.select(row.alias("r")).where((F.col("r.kind") == kind) & F.col("r.data.id").isNotNull())
        branch = F.lit(target_branch) if target_branch else F.col("r.branch")
        out.append(df.select(branch.alias("branch"), "r.data.*"))
    return out[0], out[1]


def peek_branch(lines: DataFrame) -> DataFrame:
    return lines.select(F.get_json_object("value", "$.branch").alias("branch")).where("branch is not null").limit(1)


# ---- K09: absolute to relative paths -----------------------------------------------------------------------


def migrate_paths(nodes: DataFrame, edges: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Strips root from file paths (and from names that are paths), rehashes the ids and remaps both ends of edges."""
    prefix = root.rstrip("/") + "/"
    cut = lambda c: F.when(F.col(c).startswith(prefix), F.expr(f"substring({c}, {len(prefix) + 1})")).otherwise(F.col(c))
    moved = nodes.withColumn("old_id", F.col("id")).withColumn("touched", F.col("file_path").startswith(prefix))
    moved = moved.withColumn("name", F.when(F.col("touched"), cut("name")).otherwise(F.col("name"))).withColumn("file_path", cut("file_path"))
    moved = moved.withColumn("id", F.when(F.col("touched"), node_id(F.col("type"), F.col("file_path"), F.col("name"))).otherwise(F.col("id")))
    ids = moved.where("touched").select("branch", "old_id", F.col("id").alias("new_id"))
    e = edges
    for end in ("source_id", "target_id"):
        e = e.join(ids.select("branch", F.col("old_id").alias(end), F.col("new_id").alias("n_" + end)), ["branch", end], "left")
    touched = F.col("n_source_id").isNotNull() | F.col("n_target_id").isNotNull()
    src, dst = F.coalesce("n_source_id", "source_id"), F.coalesce("n_target_id", "target_id")
    e = e.select("branch", F.when(touched, edge_id(src, F.col("type"), dst)).otherwise(F.col("id")).alias("id"), "type", src.alias("source_id"), dst.alias("target_id"), "properties")
    return moved.drop("old_id", "touched"), e


# ---- A01, A02: statistics -------------------------------------------------------------------------------


def stats(nodes: DataFrame, edges: DataFrame, branches: list[str]) -> DataFrame:
    """(kind, type, n): nodes and edges per type, one version per id; type '' holds the total."""
    rows = []
    for kind, df in (("node", nodes), ("edge", edges)):
        per = overlay(df.select("branch", "id", "type"), branches).rollup("type").agg(F.count("*").alias("n"), F.grouping("type").alias("g"))
        rows.append(per.select(F.lit(kind).alias("kind"), F.when(F.col("g") == 1, F.lit("")).otherwise(F.col("type")).alias("type"), "n"))
    return rows[0].unionByName(rows[1])


def centrality(edges: DataFrame) -> DataFrame:
    """(id, degree): edges that touch a node, a self-loop once."""
    return directed(edges).groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("degree"))


