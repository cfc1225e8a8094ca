import pytest
from pyspark.sql import functions as F

from stemma.facade import TOOLS, GraphStore
from stemma.model import EDGE_SCHEMA, NODE_SCHEMA, current_nodes, node_id
from stemma.operators import analysis as A
from stemma.operators import store as S
from stemma.operators import traverse as T


def node(i, kind="Function", name="f", path="a/b.go", line=1, package="p", language="go", exported=False, branch="main", props=None, sig="", doc=""):
    return (branch, i, kind, name, f"{package}.{name}", path, line, line, package, language, exported, sig, doc, props, None)


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODE_SCHEMA)


def edges(spark, *rows):
    return spark.createDataFrame([(b, i, t, s, d, None) for b, i, t, s, d in rows], EDGE_SCHEMA)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_node_id(spark):
    assert spark.range(1).select(node_id("Function", "main.go", "main").alias("x")).first().x == "f65bd298334c213eb3df8251"


@pytest.mark.parametrize(
    "pattern,hits",
    [("Handle*", ["HandleRequest", "HandleResponse"]), ("*", ["HandleRequest", "HandleResponse", "ProcessData"]), ("[HP]*t*", ["HandleRequest", "ProcessData"]), ("?rocess*", ["ProcessData"]),
     ("[", []), ("Handle\\*", []), ("*handler*", []), ("[^H]*", ["ProcessData"]), ("pkg/*.go", ["pkg/handler.go"]), ("handle*", [])])
def test_glob(spark, pattern, hits):
    df = spark.createDataFrame([(x,) for x in ("HandleRequest", "HandleResponse", "ProcessData", "pkg/handler.go")], "name string")
    assert ids(df.where(S.glob(F.col("name"), pattern)), "name") == sorted(hits)


def test_overlay_filters_before_it_takes_versions(spark):
    n = nodes(spark, node("x", exported=True), node("x", exported=False, branch="feature"), node("m"), node("f", branch="feature"))
    read = ["feature", "main"]
    assert ids(S.query_nodes(n, read)) == ["f", "m", "x"]
    hit = S.query_nodes(n, read, S.NodeFilter(exported=True)).collect()
    assert [(r.id, r.graph_source) for r in hit] == [("x", "main")]
    assert S.get_node(n, read, "x").first().graph_source == "feature"


def test_property_filter_is_containment(spark):
    n = nodes(spark, node("a", props={"receiver": "BranchStore"}), node("b", props={"receiver": "Other"}), node("c"))
    assert ids(n.where(S.NodeFilter(properties={"receiver": "Store"}).column())) == ["a"]


def test_cascade_and_delete_by_file_keep_other_branches(spark):
    n = nodes(spark, node("a"), node("b", path="other.go"), node("a", branch="feature"))
    e = edges(spark, ("main", "e1", "Calls", "a", "b"), ("main", "e2", "Calls", "b", "b"), ("feature", "e1", "Calls", "a", "b"))
    n2, e2 = S.delete_by_file(n, e, "main", spark.createDataFrame([("a/b.go",)], "file_path string"))
    assert sorted((r.branch, r.id) for r in n2.collect()) == [("feature", "a"), ("main", "b")]
    assert sorted((r.branch, r.id) for r in e2.collect()) == [("feature", "e1"), ("main", "e2")]


def test_update_needs_the_node(spark):
    n = nodes(spark, node("a"))
    with pytest.raises(KeyError):
        S.update(n, nodes(spark, node("zz")))
    assert S.update(n, nodes(spark, node("a", name="g"))).first().name == "g"


def test_export_round_trip_and_broken_lines(spark):
    n = nodes(spark, node("a", props={"k": "v,\"x\"\n"}, doc="ü\n"), node("b", branch="feature"))
    e = edges(spark, ("main", "e", "Calls", "a", "b"))
    lines = S.to_export(n, e, "main").select("value").unionByName(spark.createDataFrame([("{broken",), ("",)], "value string"))
    n2, e2 = S.from_export(lines, "copy")
    r = n2.first()
    assert (r.branch, r.id, r.properties, r.doc_comment) == ("copy", "a", {"k": "v,\"x\"\n"}, "ü\n") and n2.count() == 1
    assert e2.first().source_id == "a" and S.peek_branch(lines).first().branch == "main"


def test_path_migration_remaps_edges(spark):
    n = nodes(spark, node("o1", path="/w/x.go", name="f"), node("o2", path="y.go", name="g"))
    n2, e2 = S.migrate_paths(n, edges(spark, ("main", "e", "Calls", "o1", "o2")), "/w")
    new = {r.file_path: r.id for r in n2.collect()}
    assert new["y.go"] == "o2" and new["x.go"] != "o1"
    assert (e2.first().source_id, e2.first().target_id) == (new["x.go"], "o2")


def test_neighbours_drop_dangling_and_count_loops_once(spark):
    n, e = nodes(spark, node("a"), node("b")), edges(spark, ("main", "1", "Calls", "a", "b"), ("main", "2", "Calls", "a", "gone"), ("main", "3", "Calls", "a", "a"), ("main", "4", "Tests", "b", "a"))
    seeds = spark.createDataFrame([("a",)], "node_id string")
    assert ids(S.neighbours(n, e, seeds), "peer_id") == ["a", "b"]
    assert {r.id: r.degree for r in S.centrality(e).collect()} == {"a": 4, "b": 2, "gone": 1}
    entries = S.edge_entries(n, e, seeds)
    assert entries.count() == 4 and entries.where("peer_name = 'gone'").count() == 1
    assert S.edge_entries(n, e, seeds, keep_unresolved=False).count() == 3


def test_unused_coverage_and_percent(spark):
    n = nodes(spark, node("a", name="used"), node("b", name="lonely"), node("c", name="main"), node("d", name="Shown", exported=True), node("e", name="TestX"), node("f", "File", "h.go", "h.go", package="pkg/a"), node("g", "File", "u.go", "u.go", package=""), node("t", "TestFile", "h_test.go", "h_test.go"))
    e = edges(spark, ("main", "1", "Calls", "x", "a"), ("main", "2", "Tests", "t", "f"))
    assert ids(A.unused(n, e)) == ["b"]
    assert ids(A.unused(n, e, include_exported=True)) == ["b", "d"]
    per = {r.package: (r.covered, r.total, r.percent) for r in A.package_coverage(A.coverage(n, e, "file")).collect()}
    assert per == {"pkg/a": (1, 1, 100.0), "(unknown)": (0, 1, 0.0)}


def test_impact_levels_are_shortest(spark):
    e = edges(spark, ("main", "1", "Calls", "b", "a"), ("main", "2", "Calls", "c", "b"), ("main", "3", "Calls", "c", "a"), ("main", "4", "Calls", "d", "c"), ("main", "5", "Calls", "z", "d"), ("main", "6", "Calls", "y", "z"), ("main", "7", "Calls", "a", "d"), ("main", "8", "Contains", "q", "a"))
    got = {r.id: r.level for r in T.impact(e, spark.createDataFrame([("a",)], "root_id string")).collect()}
    assert got == {"b": 1, "c": 1, "d": 2, "z": 3}


def test_current_version_and_empty(spark):
    rows = spark.sql("select * from values ('main','a',timestamp'2024-01-01',null,'old'),('main','a',timestamp'2024-02-01',null,'new'),('main','b',timestamp'2024-01-01',timestamp'2024-01-01','x'),(null,'c',null,null,'y') t(branch,id,indexed_at,deleted_at,name)")
    for c, t in (("type", "string"), ("qualified_name", "string"), ("file_path", "string"), ("line", "int"), ("end_line", "int"), ("package", "string"), ("language", "string"), ("exported", "boolean"), ("signature", "string"), ("doc_comment", "string"), ("properties", "map<string,string>"), ("metrics", "map<string,double>")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    got = current_nodes(rows).collect()
    assert [(r.id, r.name, r.line, r.package, r.exported) for r in got] == [("a", "new", 0, "", False)]
    assert current_nodes(rows.limit(0)).count() == 0


def test_facade_tools(spark):
    n = nodes(spark, node("a", name="Run"), node("i", "Interface", "Port", line=2), node("s", "Struct", "Impl"))
    e = edges(spark, ("main", "1", "Implements", "s", "i"), ("main", "2", "Calls", "s", "a"))
    g = GraphStore(n, e, ["work", "main"])
    args = {"get_file_info": {"path": "a/b.go"}, "get_impact_analysis": {"node": "a"}, "search_nodes": {"pattern": "R*"}, "query_file_symbols": {"path": "a/b.go"}, "query_node_edges": {"node": "Port"}}
    for name in TOOLS:
        if name != "semantic_search":
            g.tool(name, **args.get(name, {})).count()
    assert g.tool("query_interface_implementors").first().implementor_name == "Impl"
    h = g.upsert(nodes=nodes(spark, node("a", name="Changed")))
    assert h.get("a").first().name == "Changed" and g.get("a").first().name == "Run"
    assert h.delete_files(spark.createDataFrame([("a/b.go",)], "file_path string")).get("a").first().name == "Run"
    g.register_views()
    assert spark.sql("select count(*) n from graph_nodes").first().n == 3


def test_entry_and_query_names(spark):
    import __spark_entry__ as entry

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 150 and "j08_unused_antijoin" in q
