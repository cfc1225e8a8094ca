import io
import json
import subprocess
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemma.functions import lexer
from stemma.operators import documents as D
from stemma.operators import faces as C
from stemma.operators import retrieve as R
from stemma.sources import extract as E
from stemma.sources import files as Fi
from stemma.sources import git as G
from stemma.sources.manifests import read_manifest
from stemma.sources.office import documents, office_text


def test_chunks_round_trip():
    text = "\n\n".join(f"Paragraph {k} " + "word " * 58 for k in range(20))
    parts = R.chunk_bounds(text.encode())
    assert len(parts) >= 2 and all(b[1] - b[0] <= 1500 for b in parts)
    assert parts[0][0] == 0 and all(parts[k + 1][0] <= parts[k][1] for k in range(len(parts) - 1))
    assert R.chunk_texts("") == [""] and R.chunk_texts("x" * 1500) == ["x" * 1500]
    assert len(R.chunk_texts("x" * 4000)) == 3
    # A tail of less than the minimum joins its predecessor whole.
    tail = "x" * 1300 + " " + "y" * 250
    assert len(R.chunk_texts(tail, 1500, 0, 300)) == 1


def test_chunk_frame_knn_and_rank(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 2000)], "id long, text string")
    got = R.chunks(df, "id", "text").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {2: 1, 3: len(R.chunk_texts("a " * 2000))}
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "id long, v array<double>")
    near = R.knn(vec, "id", "v", vec.where("id = 1"), "id", "v", 2).orderBy("rank").collect()
    assert [(r.id, r.rank) for r in near] == [(1, 1), (2, 2)]
    assert R.knn(vec.limit(0), "id", "v", vec.where("id = 1"), "id", "v", 2).count() == 0
    emb = R.embed(df.where("text is not null"), "text").collect()
    assert abs(sum(x * x for x in emb[1].embedding) - 1) < 1e-5


def test_manifests():
    req = "fastapi[all]>=0.1\n# c\n\n-r base.txt\n-i http://x\nuvicorn"
    assert [(r[0], r[1], r[2], r[3]) for r in read_manifest("svc/requirements.txt", req)] == [("service", "svc", "", 1), ("manifest_dep", "fastapi[all]", ">=0.1", 1), ("include", "base.txt", "", 4), ("manifest_dep", "uvicorn", "", 6)]
    pkg = json.dumps({"name": "web", "version": "1", "dependencies": {"axios": "^1"}, "devDependencies": {"jest": "2"}}, indent=1)
    assert [(r[0], r[1], r[5]) for r in read_manifest("package.json", pkg)] == [("service", "web", ""), ("manifest_dep", "axios", ""), ("manifest_dep", "jest", "dev")]
    mod = "module github.com/x/y\n\nrequire (\n\ta.b/c v1 // indirect\n\td.e/f v2\n)\nrequire g.h/i v3\n"
    assert [(r[1], r[2], r[5]) for r in read_manifest("go.mod", mod)] == [("github.com/x/y", "", ""), ("a.b/c", "v1", "indirect"), ("d.e/f", "v2", ""), ("g.h/i", "v3", "")]
    toml = '[project]\nname = "p"\nversion = "2"\ndependencies = ["httpx>=1"]\n'
    assert [(r[0], r[1], r[2], r[3]) for r in read_manifest("pyproject.toml", toml)] == [("service", "p", "2", 1), ("manifest_dep", "httpx", ">=1", 4)]
    assert list(read_manifest("package.json", "{")) == [] and list(read_manifest("pyproject.toml", "[")) == []


def archive(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


W = 'xmlns:w="http://w"'


def test_office_documents(spark):
    docx = archive(word__document_xml=f'<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t><w:tab/><w:t>World</w:t></w:r></w:p><w:p/><w:p><w:t>Two</w:t></w:p></w:body></w:document>')
    assert office_text("a.docx", docx) == "Hello\tWorld\nTwo"
    pptx = archive(ppt__slides__slide2_xml=f"<x {W}><w:p><w:t>B</w:t></w:p></x>", ppt__slides__slide1_xml=f"<x {W}><w:p><w:t>A</w:t></w:p></x>")
    assert office_text("a.pptx", pptx) == "--- Slide 1 ---\nA\n\n--- Slide 2 ---\nB"
    xlsx = archive(xl__sharedStrings_xml="<sst><si><t>name</t></si></sst>", xl__worksheets__sheet1_xml='<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row><row/></sheetData></worksheet>')
    assert office_text("a.xlsx", xlsx) == "--- Sheet 1 ---\nname\t5"
    odt = archive(content_xml='<o xmlns:t="t"><t:body><t:text><t:h>Head</t:h><t:p>One <t:span>two</t:span></t:p></t:text></t:body></o>')
    assert office_text("a.odt", odt) == "Head\nOne two"
    ods = archive(content_xml='<o xmlns:t="t"><t:body><t:spreadsheet><t:table><t:table-row><t:table-cell><t:p>1</t:p></t:table-cell><t:table-cell><t:p>2</t:p></t:table-cell></t:table-row></t:table></t:spreadsheet></t:body></o>')
    assert office_text("a.ods", ods) == "--- Sheet 1 ---\n1\t2"
    odp = archive(content_xml='<o xmlns:t="t"><t:body><t:presentation><t:page><t:p>Hi</t:p></t:page></t:presentation></t:body></o>')
    assert office_text("a.odp", odp) == "--- Slide 1 ---\nHi"
    assert office_text("a.docx", b"no archive") is None and office_text("a.docx", None) is None
    df = spark.createDataFrame([("a.docx", docx), ("b.txt", b"x"), ("c.odt", b"")], "path string, content binary")
    assert {r.path: r.text for r in documents(df).collect()} == {"a.docx": "Hello\tWorld\nTwo", "c.odt": None}


@pytest.mark.parametrize("path,hit", [("a/x.min.js", True), ("node_modules/a/b.js", True), ("src/a.js", False), ("keep.log", False), ("x.log", True), ("docs/a/b.md", True), ("docs/b.md", True), ("src/docs/b.md", False), ("build/x", True), ("src/build", True)])
def test_ignore_rules(spark, path, hit):
    rules = Fi.ignore_rules(["# c", "", "*.min.js", "node_modules/", "*.log", "!keep.log", "docs/**/*.md", "build"])
    assert spark.range(1).select(Fi.ignored(F.lit(path), rules).alias("x")).first().x is hit


def test_ignore_rules_are_scoped(spark):
    rules = Fi.ignore_rules(["*.tmp", "out/x"], "sub")
    got = [spark.range(1).select(Fi.ignored(F.lit(p), rules).alias("x")).first().x for p in ("sub/a.tmp", "a.tmp", "sub/out/x", "out/x")]
    assert got == [True, False, True, False]


def test_file_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(Fi.is_binary(F.lit(bytearray(b"ab\x00c")))) and not one(Fi.is_binary(F.lit(bytearray(b"\x10\x01abc")))) and not one(Fi.is_binary(F.lit(bytearray(b""))))
    assert one(Fi.csv_preview(F.lit("a,b\n1,2\n3,4\n5,6\n7,8\n9,9\n0,0"))) == "CSV headers: a,b\nSample rows:\n1,2\n3,4\n5,6\n7,8\n9,9\n...\n"
    assert one(Fi.csv_preview(F.lit("only"))) == "CSV headers: only"


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    subprocess.run(["git", "init", "-q", "-b", "main", str(tmp_path)], check=True)
    run("config", "user.email", "a@b")
    run("config", "user.name", "dev")
    (tmp_path / "a.txt").write_text("1\n")
    run("add", "-A")
    run("commit", "-qm", "first | bar")
    (tmp_path / "b.txt").write_text("2\n")
    (tmp_path / "a.txt").unlink()
    run("add", "-A")
    run("commit", "-qm", "second")
    assert {(r.path, r.change) for r in G.diff_since(spark, str(tmp_path), "HEAD~1").collect()} <= {("a.txt", "deleted"), ("b.txt", "added"), ("b.txt", "modified")}
    assert [r.message for r in G.commits(spark, str(tmp_path)).collect()] == ["second", "first | bar"]
    assert G.branch_info(str(tmp_path))["ahead"] == 0


def kinds(path, text):
    return [(r[2], r[3]) for r in E.records(path, text) if r[0] == "node"]


def test_extraction():
    go = 'package p\n\nimport (\n\t"fmt"\n)\n\n// "func Fake() {"\ntype S struct{}\n\ntype I interface {\n\tRun(x int) error\n}\n\nfunc (s *S) Run(x int) error {\n\treturn nil // }\n}\n\nfunc New() *S { return &S{} }\n'
    assert kinds("a/b.go", go) == [("File", "a/b.go"), ("Struct", "S"), ("Interface", "I"), ("Method", "Run"), ("Function", "New"), ("Dependency", "fmt")]
    py = 'import os\nfrom a.b import c\n\nclass K(Base):\n    def m(self):\n        return "def x(): pass"\n\n@app.get("/u/{id}")\ndef top():\n    requests.get("http://h/v1/x")\n'
    got = kinds("s/t.py", py)
    assert ("Method", "m") in got and ("Function", "top") in got and ("APIEndpoint", "GET /u/{id}") in got and ("Dependency", "GET /v1/x") in got and ("Function", "x") not in got
    assert {n for k, n, _ in E.python_declarations(py)} == {"K", "m", "top"}
    ts = "import {a} from './a';\nexport class C {\n  run(x: number): string {\n    return `}`;\n  }\n}\nexport const f = (x) => {\n  return 1;\n};\n"
    got = kinds("a.ts", ts)
    assert ("Class", "C") in got and ("Method", "run") in got and ("Function", "f") in got
    md = "---\ntitle: T\n---\n# Head\n[x](other.md) [y](http://z)\n```go\ncode\n```\nTODO: fix\n"
    assert kinds("CLAUDE.md", md) == [("AIGuideline", "CLAUDE.md"), ("Document", "Head"), ("Dependency", "other.md"), ("Document", "code-block:6"), ("Document", "TODO:9")]
    assert ("Function", "build") in kinds("Makefile", "V := 1\n## doc\nbuild: dep\n\tgo build\ndep:\n") and ("Variable", "V") in kinds("Makefile", "V := 1\n")
    assert ("Dependency", "x.js") in kinds("a.html", '<script src="x.js"></script><my-tag></my-tag>') and ("Function", "f") in kinds("a.sh", "f() {\n}\n")
    assert ("Struct", "aws_s3.b") in kinds("a.tf", 'resource "aws_s3" "b" {\n}\n') and ("Service", "m") in kinds("x/go.mod", "module m\n")
    gha = "name: CI\non: [push]\njobs:\n  test:\n    steps:\n      - name: Check\n      - uses: actions/checkout@v4\n"
    assert {("Function", "test"), ("Function", "test/Check"), ("Variable", "push")} <= set(kinds(".github/workflows/a.yml", gha))
    assert kinds("a.bin", "") == [("Document", "a.bin")]


def test_extract_frames(spark):
    df = spark.createDataFrame([("a.go", b"package a\nfunc F() {}\n"), (None, b"x"), ("b.go", b"\x00"), ("c.py", None), ("d.py", b"\xff\xfe def f(): pass")], "path string, content binary")
    n, e = E.graph_of(E.extract(df), "main")
    assert {r.name for r in n.collect()} >= {"a.go", "F", "c.py"} and e.count() >= 1
    assert E.extract(df.limit(0)).count() == 0


def test_go_calls_are_resolved():
    src = """package shop

import (
	"fmt"
	store "example.com/x/kv"
)

type Cart struct {
	db, log *store.Client
	inner   *Part
}

type Part struct{}

func (p *Part) Add(x int) { helper(x) }
func (o *Other) Add(x int) {}

func (c *Cart) Pay(x int) error {
	fmt.Println("helper(")
	c.db.Put(x)
	c.inner.Add(len(x))
	outside(x)
	outside(2)
	return helper(x)
}

func helper(x int) error { return helper(x - 1) }
"""
    rows = list(E.records("shop/cart.go", src))
    ids = {(r[2], r[13].get("receiver", ""), r[3]): r for r in rows if r[0] == "node"}
    calls = {(r[14], r[15]) for r in rows if r[0] == "edge" and r[2] == "Calls"}
    at = lambda *k: ids[k][1]
    pay = at("Method", "Cart", "Pay")
    assert calls == {(at("Method", "Part", "Add"), at("Function", "", "helper")), (pay, at("Dependency", "", "fmt")), (pay, at("Dependency", "", "example.com/x/kv")), (pay, at("Method", "Part", "Add")), (pay, at("Function", "", "helper"))}
    assert ids["Method", "Cart", "Pay"][13]["unresolved_calls"] == "outside" and at("Method", "Other", "Add") != at("Method", "Part", "Add")


def test_lexer_states():
    """Nested comments, raw strings, lifetimes, templates with code inside, regular expressions and heredocs."""
    rs = 'fn a<\'x>(s: &\'x str) { let c = \'{\'; /* a /* nested } */ } */ let r = r#"}"#; }\n/// Doc\nfn b() { }\n'
    assert [(f[0], f[1], f[2], f[4]) for f in lexer.functions_of(rs, "a.rs")] == [("a", 1, 1, ""), ("b", 3, 3, "/// Doc")]
    js = 'function a() { const r = /[{"]/g; const t = `x ${ {a: `in ${1} }`}.a } {`; return x / 2 / y; }\n/** Doc. */\nconst b = (x) => { return "}" }\n'
    assert [(f[0], f[1], f[2], f[4]) for f in lexer.functions_of(js, "a.js")] == [("a", 1, 1, ""), ("b", 3, 3, "/** Doc. */")]
    rb = 'def a\n  x = <<~END\n    def not\n  END\n  s = "a #{ {b: "}"} } end"\nend\n# Doc\ndef b\n  %w[if do]\nend\n'
    assert [(f[0], f[1], f[2], f[4]) for f in lexer.functions_of(rb, "a.rb")] == [("a", 1, 6, ""), ("b", 8, 10, "# Doc")]
    cs = 'public void A() { var s = @"a""{"; var r = """ { """; }\n'
    assert [(f[0], f[2]) for f in lexer.functions_of(cs, "a.cs")] == [("A", 1)]
    for kind in ("c", "go", "rust", "java", "cs", "python", "ruby"):
        for bad in ("", '"', "'", "`", "/*", '"""', "${", "`${", "}", "r#", "<<~A", "/", '"#{', "%w[", "=begin"):
            assert all(0 <= a < b <= len(bad) for _, a, b in lexer.lex(bad, kind))


def test_lexer_strings_and_comments():
    src = 'x = "// no" # yes\n"""\n# in string\n"""\n'
    assert [k for k, _, _ in lexer.lex(src, "python")] == ["string", "comment", "string"]
    rs = 'fn a() { let s = r#"}"#; let c = \'}\'; }\nfn b() {}\n'
    assert [(f[0], f[1], f[2]) for f in lexer.functions_of(rs, "a.rs")] == [("a", 1, 1), ("b", 2, 2)]
    rb = "class A\n  # Doc\n  def x\n    if y\n      1\n    end\n  end\nend\n"
    assert [(f[0], f[1], f[2], f[4]) for f in lexer.functions_of(rb, "a.rb")] == [("x", 3, 7, "# Doc")]


def test_clusterings(spark):
    vec = [("a", 1, "i1", [1.0, 0.0]), ("a", 2, "i2", [0.9, 0.1]), ("a", 3, "i3", [0.0, 1.0]), ("a", 4, "i3", [0.0, 0.9]), ("a", 5, "i4", [0.7, 0.7])]
    f = spark.createDataFrame(vec, "run string, id long, image string, embedding array<double>")
    lab = {r.id: r.cluster for r in C.cluster_runs(f, "run", "average", 0.9, 2).collect()}
    assert lab == {1: 1, 2: 1, 3: -1, 4: -1, 5: -1}  # 3 and 4 are of one image
    db = {r.id: r.cluster for r in C.cluster_runs(f, "run", "dbscan", 0.9, 2).collect()}
    assert db[1] == db[2] == 1
    labels = C.cluster_runs(f, "run", "average", 0.9, 2)
    assert {r.id: r.cluster for r in C.absorb_noise(f, labels, 0.7).collect()}[5] == 1
    with pytest.raises(Exception, match="limit"):
        C.cluster_runs(f, "run", max_run=2).collect()
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (5, 3)], "id long, cluster int")
    got = {(r.a, r.b): round(r.avg, 3) for r in C.suggest_merges(f, own, 0.5).collect()}
    assert set(got) == {(1, 3), (2, 3)}
    moved, names = C.merge_clusters(own, spark.createDataFrame([(2, "n2")], "cluster int, name string"), [2], 1)
    assert {r.cluster for r in moved.collect()} == {1, 3} and names.first().name == "n2"
    boxes = spark.createDataFrame([("i", 0, 0.9, 0, 0, 10, 10), ("i", 1, 0.8, 1, 1, 10, 10), ("i", 2, 0.7, 50, 50, 60, 60), ("i", 3, None, 0, 0, 1, 1)], "image string, idx int, confidence double, min_x int, min_y int, max_x int, max_y int")
    assert sorted(r.idx for r in C.suppress(boxes).collect()) == [0, 2]


def test_all_documents_are_parsed(spark, monkeypatch):
    import hashlib
    from types import SimpleNamespace

    from stemma.plans import ingest

    bodies = ["---\ntitle: \"A b\"\nowner: me\n---\n# Top\n\n```go\n# no section\n```\n## Sub\n", "```\n# inside\n---\n```\n# Out\n", "# One\n---\n# Two\n", "---\n# Never closed\n", "plain\n", "# Open\n```py\n# lost\n", "---\nk: v\n---\n"]
    texts = dict(enumerate([x for b in bodies for x in (b, b.replace("\n", "\r\n"))] + ["", None, "a\rb"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(ingest, "Graph", lambda spark, d: SimpleNamespace(table=lambda name: docs))
    want = set()
    for i, text in texts.items():
        lines = (text or "").replace("\r\n", "\n").split("\n")
        closed = lines[0] == "---" and "---" in lines[1:]
        fence = None
        for k, x in enumerate(lines):
            if closed and k <= lines.index("---", 1):
                continue
            if x.startswith("```"):
                want |= {(f"d/{i}.md", f"code-block:{fence[0]}", fence[0], "code-block", fence[1])} if fence else set()
                fence = None if fence else (k + 1, x[3:] or "text")
            elif x.startswith("#") and not fence:
                want.add((f"d/{i}.md", x.lstrip("# "), k + 1, "section", None))
    rows = ingest.QUERIES["e10_markdown_nodes"](spark, "").collect()
    assert {(r.file_path, r.name, r.line, r.kind, r.lang) for r in rows if r.kind in ("section", "code-block")} == want
    front = {r.file_path: json.loads(r.front_matter) for r in rows if r.kind is None}
    assert set(front) == {f"d/{i}.md" for i, t in texts.items() if t is not None}
    assert front["d/0.md"] == front["d/1.md"] == {"fm_title": "A b", "fm_owner": "me"} and front["d/12.md"] == front["d/13.md"] == {"fm_k": "v"} and front["d/6.md"] == {}
    got = {r.path: r.hash for r in ingest.QUERIES["e16_all_documents"](spark, "").collect()}
    assert got == {f"d/{i}.text": "sha256:" + hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items() if t is not None}
    raw = E.extract(spark.createDataFrame([("x.bin2", bytearray(b"a\r\n\xff"))], "path string, content binary")).first()
    assert raw.properties["content_hash"] == "sha256:" + hashlib.sha256(b"a\r\n\xff").hexdigest()


def plain_dbscan(u, images, least, min_pts):
    near, labels, cluster = (u @ u.T) >= least, [0] * len(u), 0
    for i in range(len(u)):
        if labels[i] == 0 and near[i].sum() < min_pts:
            labels[i] = -1
        elif labels[i] == 0:
            cluster += 1
            labels[i], used, queue = cluster, {images[i]}, [j for j in np.flatnonzero(near[i]) if j != i]
            for j in queue:
                if labels[j] <= 0 and images[j] not in used:
                    labels[j] = cluster
                    used.add(images[j])
                    queue.extend(k for k in np.flatnonzero(near[j]) if k != j and near[j].sum() >= min_pts)
    return labels


def test_whole_clusterings_equal_one_run_over_all(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 260)] + 0.35 * rng.normal(size=(260, 8)), rng.normal(size=(40, 8))])
    images = [f"i{k}" for k in rng.integers(0, 150, len(x))]
    f = spark.createDataFrame([(i, images[i], x[i].tolist()) for i in range(len(x))], "id long, image string, embedding array<double>")
    monkeypatch.setattr(C, "BLOCK_ROWS", 90)
    u = C._units(x)
    groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == c).tolist()) for c in set(labels) if c > 0}

    def got(df):
        rows = {r.id: (r.run, r.cluster) for r in df.collect()}
        assert len(rows) == len(x)
        return {frozenset(i for i in rows if rows[i] == c) for c in set(rows.values()) if c[1] > 0}

    for least, reach in ((0.3, None), (0.6, 0.5), (0.9, None)):
        assert got(C.cluster_whole(f, "average", least, 2, reach)) == groups(C.agglomerate(u, images, least, 2))
    assert got(C.cluster_whole(f, "dbscan", 0.8, 3)) == groups(plain_dbscan(u, images, 0.8, 3))


def test_face_queries_take_all_valid_rows(spark, monkeypatch):
    from types import SimpleNamespace

    from stemma.plans import search

    v = lambda k, e=0.0: [float(i == k) + e * (i == 100) for i in range(128)]
    rows = [(1, "a", v(0), 7), (2, "b", v(0, 0.1), 8), (3, "c", v(0, 0.2), None), (4, "d", v(1), -1), (5, "e", v(1, 0.1), 0), (6, "f", v(2), 7), (7, "g", v(0)[:5], 7), (8, "h", [0.0] * 128, 7)]
    faces = spark.createDataFrame(rows, "face_id long, image_path string, embedding array<float>, cluster_id int")
    monkeypatch.setattr(search, "Graph", lambda spark, d: SimpleNamespace(table=lambda name: faces))
    for name in ("l01_average_linkage", "l02_absorb_noise", "l03_dbscan"):
        got = {r.id: (r.run, r.cluster) for r in search.QUERIES[name](spark, "").collect()}
        assert set(got) == {1, 2, 3, 4, 5, 6} and got[1] == got[2] == got[3] != got[4] == got[5] and got[6][1] == -1, name


def test_topics_and_directories(spark):
    n, e = D.topic_rows(spark.createDataFrame([("d1", ["A  b", "a B", ""]), ("d2", ["a b"])], "doc_id string, topics array<string>"))
    assert [r.name for r in n.collect()] == ["a b"] and e.count() == 2
    n, e = D.directories(spark.createDataFrame([("x/y/z.md",), ("x/q.md",), ("top.md",)], "path string"), "path")
    assert sorted(r.name for r in n.collect()) == ["x", "x/y"] and e.count() == 3


def test_json_array_and_stored_index(spark, tmp_path):
    from stemma.functions import scalars as X

    assert X.first_json_array('say [1, "]", [2]] and [3]') == '[1, "]", [2]]' and X.first_json_array("[1") is None and X.first_json_array(None) is None
    df = spark.createDataFrame([('x [{"a": 1}] y',), (None,)], "t string")
    assert [r.x for r in df.select(X.json_array(F.col("t")).alias("x")).collect()] == ['[{"a": 1}]', None]
    vec = spark.createDataFrame([("n1", 0, [1.0]), ("n1", 1, [0.5]), ("n2", 0, [0.1])], "id string, chunk_index int, embedding array<float>")
    for version in (1, 2):
        R.save_index(vec, str(tmp_path / "ix"), "hash", "m", 1)
        chunks, meta = R.load_index(spark, str(tmp_path / "ix"))
        assert (meta.first().version, meta.first().chunks, meta.first().nodes) == (version, 3, 2)
    assert not R.needs_reindex(meta, "hash", "m") and R.needs_reindex(meta, "hash", "other") and R.needs_reindex(meta.limit(0), "hash", "m")
    assert R.remove_nodes(chunks, spark.createDataFrame([("n1",)], "id string")).count() == 1


def _png(x, kind, filters):
    import struct
    import zlib

    from stemma.sources import images as I

    h, w, n = x.shape
    lines = b""
    for y in range(h):
        f, row, up = filters[y % len(filters)], x[y].reshape(-1).astype(int), (x[y - 1].reshape(-1) if y else np.zeros(w * n, np.uint8)).astype(int)
        left, corner = np.r_[np.zeros(n, int), row[:-n]], np.r_[np.zeros(n, int), up[:-n]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        lines += bytes([f]) + ((row - (0, left, up, (left + up) // 2, paeth)[f]) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + b"0000"
    return I.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_are_read_and_brought_down(spark):
    from stemma.sources import images as I

    rng = np.random.default_rng(3)
    for kind, n in ((0, 1), (2, 3), (4, 2), (6, 4)):
        x = rng.integers(0, 256, (9, 7, n), dtype=np.uint8)
        if n in (2, 4):
            x[:, :, -1] = 255
        want = x[:, :, :3] if n >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
        assert (I.read_png(_png(x, kind, [0, 1, 2, 3, 4])) == want).all()
    clear = np.zeros((2, 2, 4), np.uint8)
    assert (I.read_png(_png(clear, 6, [0])) == 255).all()
    x = rng.integers(0, 256, (40, 80, 3), dtype=np.uint8)
    assert (I.read_png(I.write_png(x)) == x).all() and (I.shrink(x, 80) == x).all()
    y = I.shrink(x, 20)
    assert y.shape == (10, 20, 3) and abs(int(y[3, 4, 1]) - x[12:16, 16:20, 1].mean()) <= 1
    df = spark.createDataFrame([(1, bytearray(I.write_png(x))), (2, None), (3, bytearray(b"no image")), (4, bytearray())], "i int, content binary")
    got = {r.i: r.image for r in I.downscale(df, longest=16).collect()}
    assert (got[1].width, got[1].height, got[1].old_width) == (16, 8, 80) and got[2] is None and got[3] is None and got[4] is None


def test_a_cluster_is_split_whatever_its_size(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_RUN", 3)
    rng = np.random.default_rng(2)
    rows = [(i, f"p{i}", (np.eye(8)[i % 3 if i < 30 else 7 - i % 2] + rng.normal(size=8) * 0.02).tolist(), 4 if i < 40 else 9) for i in range(44)]
    faces = spark.createDataFrame(rows, "id long, image string, embedding array<double>, cluster int")
    got = {r.id: r.cluster for r in C.split_cluster(faces, faces.select("id", "cluster"), 4, 0.8).collect()}
    assert {got[i] for i in range(0, 30, 3)} == {4} and all(got[i] == 9 for i in range(40, 44))
    assert sorted({got[i] for i in range(40)}) == [4, 10, 11, 12, 13] and got[1] == 10 and got[2] == 11
    pairs = C.suggest_merges(faces, faces.select("id", "cluster"), -1.0)
    top = {(r.a, r.b): r["max"] for r in C.greatest_similarity(faces, faces.select("id", "cluster"), pairs, block=8).collect()}
    u = {i: np.array(v) / np.linalg.norm(v) for i, _, v, _ in rows}
    assert abs(top[4, 9] - max(u[i] @ u[j] for i in range(40) for j in range(40, 44))) < 1e-9


def test_ranks_over_all_rows(spark):
    import random

    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, 1.0, 0.5, rng.random()])) for i in range(300)]
    got = {r.id: r["rank"] for r in R.ranked(spark.createDataFrame(rows, "id int, score double")).collect()}
    assert [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] == sorted(got, key=got.get) and sorted(got.values()) == list(range(1, 301))
    assert (R.fetch_size(15), R.fetch_size(30, True), R.tool_fetch_size(15), R.tool_fetch_size(30, True)) == (75, 200, 15, 60)


def test_questions_are_answered_end_to_end(spark):
    from test_store import edges, node, nodes

    n = nodes(spark, *[node(str(i), "Function" if i % 2 else "Document", f"ledger{i}", sig="f()", doc=f"text {i}") for i in range(12)])
    index = R.embed(R.chunks(R.node_texts(n), "id", "text"), "chunk_text", prefix="search_document: ")
    got = R.ask(n, edges(spark), index, "how does the ledger3 work", 5, no_docs=True).collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5] and got[0].id == "3" and all(int(r.id) % 2 for r in got)


def test_results_as_text(spark):
    from stemma.functions import render

    df = spark.createDataFrame([("a|b", 1, None), ("c\nd", None, "x")], "name string, n int, t string")
    assert [r.json for r in render.json_lines(df).collect()] == ['{"name":"a|b","n":1}', '{"name":"c\\nd","t":"x"}']
    assert render.table_text(df, "T", 1) == "## T\n\n| name | n | t |\n|-|-|-|\n| a\\|b | 1 |  |\n... more than 1 rows\n"
    assert render.context_text("All", {"one": df, "none": df.limit(0)}).count("##") == 1


def test_bounded_broadcasts_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, rng.normal(size=8).tolist(), i % 6 + 1) for i in range(60)], "id long, embedding array<double>, cluster int")
    ask = lambda: sorted(map(tuple, R.knn(rows, "id", "embedding", rows.where("id % 3 = 0"), "id", "embedding", 4).collect()))
    merge = lambda: sorted((r.a, r.b, round(r.avg, 9)) for r in C.suggest_merges(rows.drop("cluster"), rows.select("id", "cluster"), -1.0).collect())
    whole = ask(), merge()
    monkeypatch.setattr(R, "MAX_QUERY_BYTES", 200)
    monkeypatch.setattr(C, "MAX_MEANS_BYTES", 130)
    assert (ask(), merge()) == whole and len(whole[0]) == 80 and len(whole[1]) == 15
