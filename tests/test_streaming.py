import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_store import edges, node, nodes

from stemma.streaming import events as Ev

T = datetime(2024, 1, 1)


def test_debounce(spark):
    rows = [("a", T + timedelta(milliseconds=k), op) for k, op in ((0, "Create"), (50, "Write"), (149, "Write"), (300, "Remove"))] + [("b", T, "Write"), ("b", None, "Write")]
    df = spark.createDataFrame(rows, "path string, ts timestamp, op string")
    got = sorted((r.path, r.op, r.events) for r in Ev.debounce(df).collect())
    assert got == [("a", "Remove", 1), ("a", "Write", 3), ("b", "Write", 1)]
    assert Ev.debounce(df.limit(0)).count() == 0


def test_operations(spark):
    df = spark.createDataFrame([("a", "WRITE", T), ("a", "CREATE|WRITE", T + timedelta(1)), ("b", "CHMOD", T), ("c", "RENAME", T), (None, "WRITE", T)], "path string, op string, ts timestamp")
    assert {(r.path, r.op) for r in Ev.last_operations(df).collect()} == {("a", "Create"), ("c", "Rename")}


def test_stream_updates_the_store_by_file(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps(x) for x in ({"path": "a.go", "op": "REMOVE", "ts": "2024-01-01T00:00:00Z"}, {"path": "b.go", "op": "WRITE", "ts": "2024-01-01T00:00:01Z"})))
    state = {"n": nodes(spark, node("1", path="a.go"), node("2", path="b.go"), node("3", path="c.go"), node("1", path="a.go", branch="old")), "e": edges(spark, ("main", "e", "Calls", "3", "1"))}

    def parse(paths):
        n = state["n"].limit(0).unionByName(paths.select(F.col("path")).join(state["n"].limit(0).drop("file_path"), F.lit(False), "left").select(
            *[(F.lit("main") if c == "branch" else F.lit("new") if c == "id" else F.col("path") if c == "file_path" else F.col(c)).alias(c) for c in state["n"].columns]))
        return n, state["e"].limit(0)

    def handle(batch, _):
        n, e = Ev.apply_batch(state["n"], state["e"], batch, parse, "main")
        state["got"] = (sorted((r.branch, r.id) for r in n.collect()), e.count())

    Ev.watch(spark, Ev.event_files(spark, str(src)), handle, str(tmp_path / "ck")).awaitTermination(120)
    assert state["got"] == ([("main", "3"), ("main", "new"), ("old", "1")], 0)


def test_sessions_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"path": "a", "op": "w", "ts": f"2024-01-01T00:{m:02d}:00Z"}) for m in (0, 1, 30)))
    q = Ev.session_counts(Ev.event_files(spark, str(src)), "5 minutes", "path", "ts", "1 minute").writeStream.format("memory").queryName("sess").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select events from sess").first().events == 2  # the later session may still grow


def test_sync_plan(spark):
    st = spark.createDataFrame([("main", "c1")], "branch string, commit string")
    assert Ev.sync_plan("c1", st, "main", None)[0] == "none" and Ev.sync_plan("c2", st, "new", None)[0] == "full"
    assert Ev.sync_plan("c2", st, "main", lambda c: st)[0] == "incremental"
    assert Ev.sync_plan("c2", st, "main", lambda c: 1 / 0)[0] == "full"
    assert Ev.auto_import_due(2.0, 1.0) and not Ev.auto_import_due(1.0, 2.0) and Ev.auto_import_due(1.0, None)


def test_index_run_parses_what_changed_and_hooks_once(spark):
    from stemma.facade import GraphStore
    from stemma.model import EDGE_SCHEMA, NODE_SCHEMA

    at = lambda k: T + timedelta(k)
    state = spark.createDataFrame([("a.go", at(0)), ("b.go", at(0)), ("gone.go", at(0))], "path string, modification_time timestamp")
    scan = spark.createDataFrame([("a.go", at(0)), ("b.go", at(1)), ("new/c.go", at(1))], "path string, modification_time timestamp")
    store = GraphStore(nodes(spark, node("1", path="a.go"), node("2", path="b.go"), node("3", path="gone.go")), edges(spark, ("main", "e", "Calls", "1", "3")), ["main"])
    ran = []

    def parse(files):
        return nodes(spark, *[node("n" + r.path, path=r.path) for r in files.collect()]), spark.createDataFrame([], EDGE_SCHEMA)

    def hook(s):
        ran.append(1)
        return s

    after, seen = Ev.index_run(store, scan, state, parse, [hook])
    assert sorted(r.id for r in after.view[0].collect()) == ["1", "nb.go", "nnew/c.go"] and after.view[1].count() == 0 and ran == [1]
    again, _ = Ev.index_run(after, scan, seen, parse, [hook])
    assert again is after and ran == [1] and len(NODE_SCHEMA) > 0
    from stemma.sources.files import changed_files

    ops = {(r.path, r.op) for r in Ev.changes_to_events(changed_files(scan, state)).collect()}
    assert ops == {("b.go", "Write"), ("new/c.go", "Create"), ("gone.go", "Remove")}
