from pyspark.sql import functions as F
from test_store import node, nodes

from stemma.functions import metrics as M
from stemma.functions import scalars as X
from stemma.functions.classify import classify
from stemma.operators import link as L


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_scalar_cases(spark):
    s = F.lit
    assert one(spark, X.top_dir(s("hypatia/src/main.py")), X.top_dir(s("main.py")), X.top_dir(s("")), X.top_dir(s("/x/y"))) == ("hypatia", "(root)", "", "(root)")
    assert one(spark, *[X.normalize_url(s(p)) for p in ("/api/v1/instances/{id}", "/API/V1/Users/", "api/v1/data", "/a/:user_id", "/a/<item_id>/b")]) == ("/api/v1/instances/*", "/api/v1/users", "/api/v1/data", "/a/*", "/a/*/b")
    assert one(spark, X.normalize_path(s("/api//v1///data")), X.normalize_path(s("api/v1"))) == ("/api/v1/data", "/api/v1")
    assert one(spark, X.match_segments(s("/a/*"), s("/a/b")), X.match_segments(s("/a/c"), s("/*/c")), X.match_segments(s("/a"), s("/a/b")), X.match_segments(s("/a/b"), s("/a/c"))) == (True, True, False, False)
    assert one(spark, X.source_paths(s("pkg/handler_test.go"), s("go")), X.source_paths(s("src/utils.spec.ts"), s("typescript")), X.source_paths(s("src/TestFoo.java"), s("java")), X.source_paths(s("tests/test_x.rs"), s("rust"))) == (
        ["pkg/handler.go"], ["src/utils.ts"], ["src/Foo.java"], ["src/x.rs", "tests/x.rs"])
    assert one(spark, X.source_names(s("TestFoo_Bar"), s("go")), X.source_names(s("testProcessUser"), s("java")), X.source_names(s("BenchmarkSort"), s("go")), X.source_names(s("test_x"), s("python"))) == (
        ["Foo", "Bar", "Foo.Bar"], ["processUser", "ProcessUser"], ["Sort"], ["x"])
    assert one(spark, X.normalize_python(s("My-Pkg")), X.pep508(s("fastapi[all]>=0.1 ; x"))["name"], X.truncate(s("abcdef"), 3), X.location(s("a.go"), s(0))) == ("my_pkg", "fastapi", "abc...", "a.go")
    assert one(spark, X.is_test_file(s("a/b_test.go"), s("")), X.is_test_file(s("src/tests/a.rs"), s("rust")), X.is_test_file(s("FooTests.cs"), s("csharp")), X.is_test_file(s("FooTests.cs"), s("csharp"), False), X.is_test_file(s("latest.go"), s("go"))) == (True, True, True, False, False)
    assert X.keywords("How does the LLM provider é work") == ["llm", "provider", "work"]


def test_complexity_and_lines(spark):
    go = "if a && b {\n for i := range x {\n case 1:\n go f()\n } else {}"
    assert one(spark, M.complexity(F.lit(go), F.lit("go")), M.complexity(F.lit("éif x"), F.lit("python")), M.complexity(F.lit("if"), F.lit("cobol"))) == (8, 2, 1)
    src = "package a\n\n// one\n/*\n two\n*/\nfunc f() {\n}\nvar x int\n"
    assert tuple(one(spark, M.lines_of_code(F.lit(src), F.lit("go")))[0]) == (9, 1, 4, 4)
    assert tuple(one(spark, M.lines_of_code(F.lit(""), F.lit("go")))[0]) == (0, 0, 0, 0)
    py = '"""doc"""\n"""open\nin\n"""\nx = 1\n# c'
    assert tuple(one(spark, M.lines_of_code(F.lit(py), F.lit("python")))[0]) == (6, 0, 5, 1)


def test_classifier_rules(spark):
    rows = [
        node("1", "Class", "A", language="java", props={"annotations": "RestController"}), node("2", "Struct", "UserRepo"), node("3", "Class", "U", language="python", props={"bases": "Base"}),
        node("4", "Struct", "LoginRequest"), node("5", "Function", "NewX", sig="func NewX() *X"), node("6", "Function", "NewY", sig="func NewY() Y"), node("7", "Struct", "OrderAggregate", path="x.go"),
        node("8", "Struct", "AuthMiddleware"), node("9", "Class", "B", language="java", props={"methods": "getInstance,findAll,getOne,saveX"}), node("10", "Class", "E", language="java", props={"annotations": "Service, Entity"}),
        node("11", "Struct", "QBuilder", path="config/q.go")]
    got = {r.id: (r.role, r.new_type, r.patterns, r.layer) for r in classify(nodes(spark, *rows)).collect()}
    assert got["1"] == ("controller", "Class", "", "presentation")
    assert got["2"] == ("repository", "Struct", "repository", "data_access")
    assert got["3"] == ("", "DBModel", "", "data_access")
    assert got["4"] == ("", "DTO", "", "presentation")
    assert got["5"][2] == "factory" and got["6"][2] == ""
    assert got["7"] == ("domain_model", "DomainModel", "", "business")
    assert got["8"][0] == "middleware"
    assert got["9"] == ("repository", "Class", "singleton,repository", "data_access")
    assert got["10"] == ("service", "DBModel", "", "business")
    assert got["11"][2:] == ("builder", "infrastructure")


def dep(i, name, path, /, **props):
    return node(i, "Dependency", name, path, props=props)


def pairs(df):
    return sorted((r.source_id, r.target_id) for r in df.collect())


def test_imports_prefer_the_longest_prefix_and_the_own_service(spark):
    n = nodes(
        spark, dep("m1", "github.com/foo/bar", "s1/go.mod", kind="manifest_dep"), dep("m2", "github.com/foo", "s1/go.mod", kind="manifest_dep"), dep("m3", "axios", "s1/package.json", kind="manifest_dep"),
        dep("m4", "axios", "s2/package.json", kind="manifest_dep"), dep("m5", "my-pkg", "s2/req.txt", kind="manifest_dep"), dep("m6", "spring-core", "s3/pom", kind="manifest_dep"),
        dep("i1", "github.com/foo/bar/pkg/util", "s1/a.go", kind="import"), dep("i2", "axios", "s2/a.ts", kind="import"), dep("i3", "my_pkg.sub", "s1/a.py", kind="import"),
        dep("i4", "org.spring.core.X", "s1/a.java", kind="import"), dep("i5", "nothing", "s1/a.py", kind="import"), dep("i6", "axios", "s9/a.ts", kind="import"))
    assert pairs(L.link_imports(n)) == [("i1", "m1"), ("i2", "m4"), ("i3", "m5"), ("i4", "m6"), ("i6", "m3"), ("i6", "m4")]


def most_rows(df):
    """The rows of df and the most rows that a step of its plan put out."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            out, kids = p.metrics().get("numOutputRows"), p.children()
            most = max(most, out.get().value() if out.isDefined() else 0)
            todo += [kids.apply(k) for k in range(kids.size())]
    return rows, most


def test_imports_make_no_pairs_that_are_not_kept(spark):
    """120 directories with one library: 120 of 14,400 pairs are kept, and no more are made."""
    n = nodes(spark, *[x for k in range(120) for x in (dep(f"m{k}", "axios", f"s{k}/package.json", kind="manifest_dep"), dep(f"i{k}", "axios", f"s{k}/a.ts", kind="import"))])
    rows, most = most_rows(L.link_imports(n))
    assert sorted((r.source_id, r.target_id) for r in rows) == sorted((f"i{k}", f"m{k}") for k in range(120)) and most <= 1000


def test_imports_stop_at_their_first_tier_with_a_match(spark):
    n = nodes(
        spark, dep("a1", "lib/x", "s1/p", kind="manifest_dep"), dep("a2", "lib", "s2/p", kind="manifest_dep"), dep("b1", "my-pkg", "s1/p", kind="manifest_dep"), dep("b2", "my_pkg", "s3/p", kind="manifest_dep"), dep("b3", "My_Pkg", "s4/p", kind="manifest_dep"),
        dep("i1", "lib/x/y", "s2/a.ts", kind="import"), dep("i2", "my_pkg.a.b", "s3/a.py", kind="import"), dep("i3", "My_Pkg.a", "s9/a.py", kind="import"), dep("i4", "lib", "", kind="import"))
    got = sorted(tuple(r) for r in L.match_imports(n.where("id like 'i%'"), L.manifests(n)).collect())
    assert got == [("i1", "a1", 2), ("i2", "b2", 3), ("i3", "b1", 3), ("i3", "b2", 3), ("i3", "b3", 3), ("i4", "a2", 1)]


def test_calls_endpoints_services(spark):
    n = nodes(
        spark, node("e1", "APIEndpoint", "x", "back/api/a.py", props={"path": "/v1/users/{id}"}), node("e2", "APIEndpoint", "y", "back/api/b.py", props={"path": "/v1/data"}), node("r", "Variable", "router", "back/main.py", props={"kind": "router_mount", "prefix": "/api"}),
        dep("c1", "a", "front/x.ts", kind="api_call", path="/v1/data"), dep("c2", "b", "front/x.ts", kind="api_call", path="/gw/v1/data/"), dep("c3", "c", "front/x.ts", kind="api_call", path="/v1/users/42"), dep("c4", "d", "front/x.ts", kind="api_call", path="/none"),
        node("f1", "File", "back/api/a.py", "back/api/a.py"), node("f2", "File", "front/x.ts", "front/x.ts"))
    e = L.link_api_calls(n)
    assert pairs(e.where("type = 'Consumes'")) == [("c1", "e2"), ("c2", "e2"), ("c3", "e1")]
    assert e.where("type = 'DependsOn'").count() == 1
    assert {r.endpoint_id: r.full_path for r in L.endpoint_paths(n).collect()} == {"e1": "/api/v1/users/{id}", "e2": "/api/v1/data"}
    assert sorted(r.group for r in L.services(n).collect()) == ["back", "front"] and L.link_endpoints(n).count() == 2


def test_phases_read_what_earlier_ones_left(spark):
    """A router mounted above the endpoint: the call of the full path is found, and by the service made on the way."""
    n = nodes(
        spark, node("e1", "APIEndpoint", "x", "back/api/a.py", props={"path": "/users"}), node("e2", "APIEndpoint", "y", "other/b.py", props={"path": "/users"}), node("r", "Variable", "router", "back/main.py", props={"kind": "router_mount", "prefix": "/api"}),
        dep("c1", "a", "front/x.ts", kind="api_call", path="/api/users"), node("f1", "File", "back/api/a.py", "back/api/a.py"), node("f2", "File", "front/x.ts", "front/x.ts"), node("s", "Service", "front", "front/package.json"))
    after, found = L.chain(n)
    assert {r.id: r.properties.get("full_path") for r in after.where("type = 'APIEndpoint'").collect()} == {"e1": "/api/users", "e2": None}
    made = after.where("type = 'Service' and id <> 's'").collect()
    assert [(r.name, r.file_path) for r in made] == [("back", "")] and after.count() == n.count() + 1
    e = found.cache()
    assert pairs(e.where("type = 'Consumes'")) == [("c1", "e1")]
    assert pairs(e.where("phase = 'api_calls' and type = 'DependsOn'")) == [("s", made[0].id)]
    ends = {r.source_id for r in e.collect()} | {r.target_id for r in e.collect()}
    assert ends <= {r.id for r in after.collect()}
    counts = {r.phase: r.linked for r in L.phase_counts(found).collect()}
    assert set(counts) == set(L.PHASES) and counts["documents"] == 0 and counts["api_calls"] == 2
    from stemma.facade import GraphStore

    store = GraphStore(n, spark.createDataFrame([], "branch string, id string, type string, source_id string, target_id string, properties map<string,string>"), ["main"]).link()
    nodes_after, edges_after = store.view
    assert nodes_after.where("type = 'Service'").count() == 2 and nodes_after.where("element_at(properties, 'full_path') = '/api/users'").count() == 1 and edges_after.count() == e.select("id").distinct().count()


def test_wildcards_equal_brute_force(spark):
    import itertools

    parts = ["a", "b", "*", "c"]
    paths = ["/" + "/".join(p) for k in (1, 2, 3, 4) for p in itertools.islice(itertools.product(parts, repeat=k), 0, None, 1 if k < 3 else 5)]
    df = spark.createDataFrame([(p, p) for p in paths], "call_id string, path string")
    keyed = L._segment_keys(df.select("call_id", F.col("path").alias("p")), "p", ["call_id"], True).join(L._segment_keys(df.select(F.col("call_id").alias("endpoint_id"), F.col("path").alias("q")), "q", ["endpoint_id"], False), ["n", "k1", "k2", "k3"])
    got = sorted((r.p, r.q) for r in keyed.where(X.match_segments(F.col("p"), F.col("q"))).collect())
    fits = lambda p, q: len(p.split("/")) == len(q.split("/")) and all(a == b or "*" in (a, b) for a, b in zip(p.split("/"), q.split("/")))
    assert got == sorted((p, q) for p in paths for q in paths if fits(p, q))


def test_contained_names_equal_brute_force(spark):
    import random

    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abé_") for _ in range(n))
    texts, names = ["", "x" * 700 + "abab"] + [word(rng.randint(0, 30)) for _ in range(60)] + ["ab" * 400], ["", "x" * 300, "abab"] + [word(rng.randint(1, 7)) for _ in range(60)]
    t, n = spark.createDataFrame([(x, "clash") for x in texts], "t string, name2 string"), spark.createDataFrame([(x,) for x in names], "name string")
    got = sorted((r.t, r.name) for r in L.contained(t, "t", n, "name", ["t"]).collect())
    assert got == sorted({(x, y) for x in texts for y in names if y and y in x})


def test_event_ends_and_inferred_matches(spark):
    n = nodes(
        spark, node("p", name="PublishOrder", path="a/x.go"), node("c", name="run", path="b/y.go", sig="func run(c Consumer)"), node("o", name="other", path="b/z.go"), node("m", "Method", "EmitAll", "a/x.go"),
        node("f1", "File", "a/x.go", "a/x.go"), node("f2", "File", "b/y.go", "b/y.go"), node("e", "APIEndpoint", "e", "b/y.go", props={"path": "/v1/{id}"}), dep("k1", "k", "a/x.go", kind="api_call", path="/none"), dep("k2", "k", "a/x.go", kind="api_call", path="/v1/7"))
    assert sorted((r.id, r.service, r.produces, r.consumes) for r in L.event_ends(n).collect()) == [("c", "b", False, True), ("p", "a", True, False)]
    m = spark.createDataFrame([("a", "/v1/{id}", "high"), ("a", "/unknown", "high"), ("b", "/v1/{id}", None)], "service string, endpoint_path string, confidence string")
    e = L.link_inferred(n, m)
    assert pairs(e.where("type = 'Consumes'")) == [("k2", "e")] and e.where("type = 'DependsOn'").count() == 1
    assert L.link_inferred(n, m.withColumn("confidence", F.lit("low"))).count() == 0


def test_implements(spark):
    m = lambda i, name, receiver: node(i, "Method", name, "s.go", props={"receiver": receiver})
    n = nodes(
        spark, node("i", "Interface", "Store", "i.go", props={"methods": "Add, Get,Close"}), node("s", "Struct", "Mem", "s.go"), node("p", "Struct", "Part", "s.go"), m("1", "Add", "MemStore"), m("2", "Get", "Mem"), m("3", "Close", "Mem"), m("4", "Add", "Part"),
        node("j", "Interface", "Empty", "j.go", props={"methods": ""}), node("k", "Class", "K", "k.py", language="python", props={"bases": "Proto,object"}), node("q", "Interface", "Proto", "q.py", language="python", props={"protocol": "true"}),
        node("c", "Class", "C", "c.ts", language="typescript", props={"implements": "Store"}))
    assert pairs(L.structural_implements(n)) == [("s", "i")]
    assert pairs(L.structural_implements(n, exact_receiver=True)) == []
    assert pairs(L.nominal_implements(n)) == [("c", "i"), ("k", "q")]


def test_tests_calls_documents(spark):
    n = nodes(
        spark, node("f", "File", "p/handler.go", "p/handler.go"), node("t", "TestFile", "p/handler_test.go", "p/handler_test.go"), node("fn", name="ProcessUser", path="p/handler.go"), node("tf", "TestFunction", "TestProcessUser", "p/handler_test.go"),
        node("m", "Method", "Run", "p/a.go", props={"unresolved_calls": "ProcessUser, Run ,Nope"}), node("d", "Document", "x.md", "x.md", doc="Call processuser before anything else."), node("d2", "Document", "y.md", "y.md", doc="too short"))
    assert pairs(L.link_test_files(n)) == [("t", "f")] and pairs(L.link_test_functions(n)) == [("tf", "fn")]
    assert pairs(L.link_calls(n)) == [("m", "fn")]
    assert pairs(L.link_documents(n)) == [("d", "fn")]
    assert L.run_phases(n).count() > 4 and L.run_phases(n.limit(0)).count() == 0


def test_document_mentions_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abé_-. ") for _ in range(rng.randint(2, 6)))
    names = [(f"n{i}", word()) for i in range(60)]
    texts = [(f"d{i}", "".join(rng.choice("abé_-. ") for _ in range(rng.randint(15, 60)))) for i in range(30)]
    n = nodes(spark, *[node(i, "Function", x) for i, x in names], *[node(i, "Document", i, doc=t) for i, t in texts])
    want = sorted({(d, i) for d, t in texts if len(t.encode()) >= 20 for i, x in names if len(x.encode()) >= 3 and not x.isspace() and x in t})
    assert pairs(L.link_documents(n)) == want


def test_document_mentions_bring_no_names_together_by_a_common_run(spark):
    """100 files whose longest run is in all of 100 documents, which name one file each: the rarest run finds it, and
    pairs of a document and a node aren't moved to be made distinct."""
    path = lambda k: f"surcharge/s{k:03d}x.go"
    n = nodes(spark, *[node(f"n{k}", "File", path(k)) for k in range(100)], *[node(f"d{k}", "Document", f"d{k}", doc=f"The surcharge is made in {path(k)}, see there.") for k in range(100)])
    rows, most = most_rows(L.link_documents(n))
    assert sorted((r.source_id, r.target_id) for r in rows) == sorted((f"d{k}", f"n{k}") for k in range(100)) and most <= 2000


def test_phases_are_counted_one_at_a_time_over_narrow_nodes(spark, monkeypatch):
    """The counts are those of the chain's edges, and no more columns are written than the phases read."""
    n = nodes(spark, node("e1", "APIEndpoint", "x", "back/a.py", props={"path": "/users"}), dep("c1", "a", "front/x.ts", kind="api_call", path="/users"), node("f1", "File", "back/a.py", "back/a.py"))
    written = []
    monkeypatch.setattr(L, "cut", lambda df, cut=L.cut: (written.append(df.columns), cut(df))[1])
    got = {r.phase: r.linked for r in L.count_phases(n, ["services", "endpoints", "api_calls"]).collect()}
    assert got == {"services": 1, "endpoints": 1, "api_calls": 1} and written == [L.READ] * 3
    assert L.run_phases(n, ["services"]).count() == 1 and written[3:] == [L.READ] * 2
