import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stemma.llm import bpe, docs, generated, mix, mojibake, split

VOCABULARY = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary file")


# ---- 6: pieces ----------------------------------------------------------------------------------------------------


def whole(data, limit, overlap, size):
    for k in range(max(0, (len(data) - 1) // size) + 1):
        o = max(0, k * size - 2 * limit)
        yield from split.range_pieces(data[o : o + size + 4 * limit], o, len(data), k, limit, overlap, size)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n\ré漢。 ", min_size=1, max_size=4000), st.sampled_from([(64, 0), (64, 20), (100, 40)]))
def test_pieces_restore_the_text(text, how):
    data, end = text.encode(), 0
    out = b""
    for a, b in whole(data, *how, 512):
        assert 0 < b - a <= how[0] and a <= end < b and (end == 0 or end - a <= how[1])
        data[a:b].decode()
        out += data[end:b]
        end = b
    assert out == data


def test_pieces_of_frames(spark):
    rng = random.Random(2)
    long = "".join(rng.choice(["word ", "x" * 40, "\n", ". ", "漢字。"]) for _ in range(60_000))
    rows = [(1, "short"), (2, ""), (3, None), (4, "a" * 1500), (5, "b" * 1501), (6, "line one\n" * 400), (6, "line one\n" * 400), (None, "x"), (7, long), (8, "é" * 5000)]
    df = spark.createDataFrame([(i, t, "clash", 9) for i, t in rows], "rid long, t string, item string, start int")
    got = split.split_items(df, "rid", "t").cache()
    n = {int(r.item): r.n_pieces for r in got.where("piece_no = 0").collect()}
    assert n[1] == n[4] == 1 and n[5] == 2 and set(n) == {1, 4, 5, 6, 7, 8} and n[7] > 100
    assert got.where("octet_length(text) > 1500").count() == 0
    texts = {int(r.item): r.text for r in split.restore(got).collect()}
    assert texts == {i: t for i, t in rows if i and t}
    assert all(r.text.endswith("\n") for r in got.where("item = '6' and piece_no < n_pieces - 1").collect())
    assert split.split_items(df.limit(0), "rid", "t").count() == 0


def test_files_are_read_by_range(spark, tmp_path):
    data = ("One sentence. " * 20_000).encode()
    (tmp_path / "big.txt").write_bytes(data)
    (tmp_path / "empty.txt").write_bytes(b"")
    df = spark.createDataFrame([(str(tmp_path / "big.txt"), len(data)), (str(tmp_path / "empty.txt"), 0), (None, 5)], "p string, n long")
    got = split.split_files(df, "p", "n")
    assert [r.text for r in split.restore(got).collect()] == [data.decode()]


# ---- 8: tokens -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return bpe.Transducer(bpe.read_ranks(Path(bpe.VOCABULARY).read_bytes()))


@VOCABULARY
def test_transducer_equals_the_library(coder):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    rng = random.Random(1)
    texts = ["", " ", "a" * 9000, "<|endoftext|>", "\r\n\t ", "don't we'll", "漢字かな混じり文", "🔧👩‍🔧", "x" * 1023 + "é" * 700, "=" * 5000, "the" * 3000]
    texts += ["".join(rng.choice("abcdeé漢 .\n\t0123_-'ABC") for _ in range(rng.randint(1, 200))) for _ in range(400)]
    for t in texts:
        ids = coder.encode(t)
        assert ids == other.encode_ordinary(t)
        assert coder.decode([ids[i : i + 2] for i in range(0, len(ids), 2)]) == t
    assert coder.encode(None) == []


@VOCABULARY
def test_streamed_portions_give_the_same_tokens(coder):
    rng = random.Random(5)
    word = "".join(rng.choice("etaoinshrdlu") for _ in range(6000)).encode()
    once = list(coder.stream([word]))
    assert once == list(coder.stream([word[i : i + 7] for i in range(0, len(word), 7)]))
    assert b"".join(coder.bytes_of[i] for i in once) == word


@VOCABULARY
def test_corpus_frames(spark, coder):
    df = spark.createDataFrame([(1, "hello world", 0), (2, "", 0), (3, None, 0), (4, "é" * 3000, 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got[1] == coder.encode("hello world") and got[2] == got[3] == [] and got[4] == coder.encode("é" * 3000)
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    back = {r.doc_id: r.text for r in bpe.decode_corpus(bpe.encode_corpus(df)).collect()}
    assert back[1] == "hello world" and back[4] == "é" * 3000


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_utf8_machine(data):
    m = bpe.Utf8Machine()
    assert "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end() == data.decode("utf-8", "replace")


# ---- 9: mixing -------------------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.001, 0.999)), min_size=1, max_size=60), st.integers(0, 99))
def test_pivotal_keeps_the_weighted_sum(items, seed):
    w, p = [float(a) for a, _ in items], [b for _, b in items]
    out, left = mix.pivotal(w, p, random.Random(seed))
    assert abs(sum(a * b for a, b in zip(w, out)) - sum(a * b for a, b in zip(w, p))) < 1e-4 * max(1, sum(w))
    assert all(x in (0.0, 1.0) or k == left for k, x in enumerate(out))


def test_pivotal_is_unbiased():
    rng = random.Random(0)
    hits = [0, 0, 0]
    for _ in range(6000):
        out, left = mix.pivotal([1.0, 5.0, 2.0], [0.3, 0.6, 0.5], rng)
        if left is not None:
            out[left] = 1.0 if rng.random() < out[left] else 0.0
        hits = [a + b for a, b in zip(hits, out)]
    assert all(abs(h / 6000 - p) < 0.03 for h, p in zip(hits, (0.3, 0.6, 0.5)))


@VOCABULARY
def test_mix_of_sources(spark):
    rng = random.Random(3)
    rows = [(i, "a" if i % 3 else "b", "word " * rng.randint(1, 30)) for i in range(600)] + [(1000 + i, "tiny", "one two three") for i in range(5)]
    rows += [(2001, None, "x"), (2002, "unlisted", "x"), (2003, "a", None), (2004, "a", ""), (2005, "zero", "x y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, copies int")
    goal = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("tiny", 0.02, 3), ("zero", 0.0, 1), ("none", 0.08, 4)], "source string, target_share double, max_repeats int")
    copies, report = mix.mix(df, goal, block=16)
    c = {r.doc_id: r for r in copies.collect()}
    assert len(c) == len(rows) and all(c[i].copies == 0 for i in (2001, 2002, 2003, 2004, 2005))
    assert max(r.copies for r in c.values() if r.source == "tiny") <= 3 and max(r.copies for r in c.values() if r.source == "a") <= 1
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"a", "b", "tiny", "zero", "none"} and r["none"].used_tokens == 0
    total = sum(x.used_tokens for x in r.values())
    for s, share in (("a", 0.5), ("b", 0.4), ("tiny", 0.02)):
        assert abs(r[s].used_tokens - share / 0.92 * total) < 80
    again = {x.doc_id: x.copies for x in mix.mix(df, goal, block=16)[0].collect()}
    assert again == {i: x.copies for i, x in c.items()}
    assert mix.mix(df.limit(0), goal)[0].count() == 0


GIVEN = Path("/root/testdata/sf0.01")


@VOCABULARY
@pytest.mark.skipif(not GIVEN.exists(), reason="no test data")
def test_shares_over_the_given_tables(spark):
    """Every source with documents misses its goal by less than its largest document, the total being the greatest at
    which all of them can meet their shares within their caps."""
    targets = {r.source: r for r in spark.read.parquet(str(GIVEN / "mix_targets.parquet")).collect()}
    copies, report = mix.mix(spark.read.parquet(str(GIVEN / "documents.parquet")), spark.read.parquet(str(GIVEN / "mix_targets.parquet")))
    largest = {r.source: r.n for r in copies.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
    rows = [r for r in report.collect() if r.tokens and r.target_share > 0]
    whole = sum(r.target_share for r in rows)
    total = min(r.tokens * targets[r.source].max_repeats / (r.target_share / whole) for r in rows)
    assert len(rows) > 5
    for r in rows:
        assert abs(r.used_tokens - r.target_share / whole * total) <= largest[r.source] and r.most_copies <= targets[r.source].max_repeats


# ---- 1: files not written by hand -----------------------------------------------------------------------------------------------

HAND = "package a\n\n// We regenerate this page at night.\nfunc Pay(x int) int {\n\tif x > 3 {\n\t\treturn x\n\t}\n\tlog.Println(x)\n\treturn 0\n}\n"
LIB = "\n".join(f"function part{k}(a, b) {{ return a.value{k} + b.other{k} * {k}; }}" for k in range(20)) + "\n"
CASES = [
    ("a.go", HAND, ""), ("gen.go", "// Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("late.go", "// Copyright 2024 Me\n//\n" + "// note\n" * 80 + "// Automatisch erzeugt durch x\n" + HAND, "generated"),
    ("foot.go", HAND + "\n// Generated by: tool --in a.proto\n", "generated"), ("about.py", "HEADER = '# Code generated by x. DO NOT EDIT.'\n\ndef write(out):\n    out.write(HEADER)\n", ""),
    ("was.go", HAND + "// This was generated code once; it has been maintained by hand since 2020.\n", ""), ("stub.py", "def a():\n    \"\"\"Auto-generated method stub\"\"\"\n    return do(1)\n", ""),
    ("x/__generated__/a.ts", "export const a = 1;\n", "generated"), ("tools/gen/a.ts", "export const a = 1;\n", ""), ("yarn.lock", "x\n", "generated"), ("m.js", "!function(a){b.c=d(5)}(k);" * 40, "minified"),
    ("one_line.ts", HAND + "const PATTERN = '" + "abc|" * 300 + "';\n", ""), ("lib/x.js", LIB.replace(" ", "  ").replace("\n", "\r\n"), "vendored"), ("up.js", "/*!\n * kit v3.1\n * (c) kit contributors\n * Released under the MIT licence\n */\n" + HAND, "vendored"),
    ("own.js", "// Copyright 2020 Firm\n// SPDX-License-Identifier: MIT\n" + HAND, ""), ("app/vendor/model.go", HAND, ""), ("d.py", "t = [\n" + "  0x01, 0x02, 0x7f, 0x33,\n" * 100 + "]\n", "data"),
    ("rows.py", "id,item,day,qty\n" + "".join(f"{k},thing,2024-01-01,{k}\n" for k in range(90)), "data"), ("small.go", HAND + "var t = []int{1, 2, 3, 4, 5}\n", ""), ("msg.py", "m = {\n" + "".join(f'  "key.{k}": "some text {k}",\n' for k in range(80)) + "}\n", "data"),
    ("none.go", None, ""), ("empty.go", "", ""), ("n.go", "package a\n" + "".join(f"func (c *K) take{k:03d}(x int) int {{\n\tif x > {k % 7} {{\n\t\treturn part{k % 5}(x)\n\t}}\n\tlog.Println(x, {k % 3})\n\treturn {k % 4} + len(c.rows)\n}}\n" for k in range(12)), "generated"),
    ("n.java", "class A {\n" + "".join(f"  private String takeRow{k}(int x) {{\n    return this.part{k * k % 7}(x{', 1' * (k % 3)});\n    // {'row ' * (k % 4)}\n  }}\n" for k in range(12)) + "}\n", "generated"),
    ("step.py", "".join(f"def {w}_{k}(x):\n    return x * {k}\n\n\n" for k, w in enumerate("load parse check sort store".split())), ""), ("edits.go", "// Your changes will be lost with the next run.\n" + HAND, "generated"),
]


def test_reasons(spark):
    rows = [(p, None if t is None else bytearray(t.encode()), "clash") for p, t, _ in CASES] + [(None, bytearray(b"x"), ""), ("twice.go", bytearray(b"// Code generated by x. DO NOT EDIT.\n"), ""), ("twice.go", bytearray(HAND.encode()), "")]
    lib = spark.createDataFrame([(LIB,), (None,)], "content string")
    df = spark.createDataFrame(rows, "path string, content binary, data string")
    got = {r.path: {k for k in ("generated", "minified", "vendored", "data") if r[k]} for r in generated.file_reasons(df, lib).collect()}
    for p, _, want in CASES:
        assert got[p] == ({want} if want else set()), p
    assert got["twice.go"] == {"generated"} and None not in got
    assert generated.file_reasons(df, None).where("path = 'lib/x.js' and vendored").count() == 0
    assert generated.file_reasons(df.limit(0), lib).count() == 0


@pytest.mark.parametrize("path,head,copy", [
    ("web/vendor/oxbow/a.go", "", True), ("third_party/kit-1.2.3/a.go", "// Copyright 2010 Jo Doe\n", True), ("svc/external/kettle_2.0/src/a.go", "", True), ("deps/parsnip/parse.go", "", True), ("vendor/github.com/x/y/a.go", "", True),
    ("static/vendor/kit.js", "/*!\n * Released under the MIT license\n */\n", True), ("vendor/kit.c", "// Redistribution and use in source and binary forms, with or without\n", True), ("third_party/a.go", "// Licensed under the Apache License, Version 2.0\n", True), ("web/models/vendor/kit-1.2/a.go", "", True),
    ("app/models/vendor/sample.go", "", False), ("app/models/vendor/orders/sample.go", "", False), ("app/vendor/model.go", "", False), ("app/vendor/model.go", "// SPDX-License-Identifier: MIT\n", False), ("app/api/deps/auth/token.go", "", False), ("web/vendor/model.go", "// Pays vendors.\n", False), ("web/vendor/export.go", "// Copyright 2023 Firm\n// SPDX-License-Identifier: Apache-2.0\n", False), ("web/vendors/export.go", "", False), ("web/vendors.go", "// Licensed under the MIT licence\n", False), ("web/external/client.go", "", False)])
def test_directories_for_others_code(path, head, copy):
    machine = generated.automaton(generated.NOTICES, generated.RETRACTIONS)
    assert generated.judge(path, head + HAND, machine, generated.Catalogue([])) == (False, False, copy, False)


# ---- 4: functions and their documentation --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name,doc,says",
    [
        ("loadPart", "Loads the part from disk unless it is cached.", True), ("loadPart", "loadPart loads the part.", False), ("loadPart", "Loads part", False), ("load_part", "The load part function.", False), ("getPart", "Getter for part.", False),
        ("f", "/** Blocks until the sensor is ready. */", True), ("f", "// Falls back to the ledger.", True), ("f", '"""Never returns a stale row."""', True), ("f", None, False), ("f", " \n\t", False), ("f", "/** */", False), ("f", "---------", False),
        ("f", "@param a\n@param b\n@return", False), ("f", "@param a the unsorted roster\n@return every open row", True), ("f", "Args:\n    a:\n    b:\n\nReturns:\n", False), ("f", "TODO: write docs for this function later on", False),
        ("f", "Keeps it. TODO: handle nulls", False), ("f", "Keeps the order of rows. TODO: handle nulls", True), ("f", "See interface.", False), ("f", "{@inheritDoc}", False), ("f", "same as above", False), ("f", "noqa: E501", False),
        ("f", "eslint-disable-next-line no-unused-vars", False), ("f", "SPDX-License-Identifier: MIT", False), ("f", "Copyright (c) 2024 Firm. All rights reserved.", False), ("f", "@author me\n@since 1.2", False),
        ("f", "if x == nil {\n    return y\n}", False), ("f", "a = b.c(d);\nreturn a;", False), ("f", "Fusionne la clé avec le récepteur le plus ancien.", True), ("f", "この関数は古い行を捨てます。", True), ("f", "Проверяет, что ключ ещё нужен.", True),
        ("f", "Description of the method.", False), ("f", "No description provided.", False), ("f", "#region F", False), ("f", "MARK: - f", False), ("f", "N/A", False), ("f", "<summary>Drops rows that are older than a day.</summary>", True)])
def test_what_says_something(name, doc, says):
    assert docs.informative(name, doc) is says


@pytest.mark.parametrize(
    "doc,says",
    [
        ("Compare two versions by precedence and return -1, 0 or 1.", True), ("Implements exponential backoff between retries.", True), ("Overrides the default timeout for slow links.", True), ("Add a comment to the given issue and return its id.", True),
        ("Write the summary table to the report folder.", True), ("Strips the copyright line from each file.", True), ("Copyright headers are checked before the upload.", True), ("Summary of open orders per customer.", True), ("Placeholder shown while the image loads.", True),
        ("Author names are sorted by surname.", True), ("Link the two accounts.", True), ("Same as parse, but keeps trailing comments.", True), ("Insert the parsed node and its description.", True), ("Since 3.2 the cache is shared by all workers.", True), ("Created by the scheduler for every job.", True),
        ("Implements io.Reader.", False), ("Implements the Reader interface.", False), ("Overrides the method of the base class.", False), ("Compare Foo.bar().", False), ("See Foo, Bar and Baz for details.", False), ("See the ledger service for settlement rules.", False), ("{@link Foo#bar}", False),
        ("Add a description here.", False), ("Write documentation for this method.", False), ("Missing docs.", False), ("Description goes here", False), ("Auto-generated method stub", False), ("placeholder text", False), ("To be documented later.", False),
        ("Copyright 2024 The Firm Authors.", False), ("Copyright Firm Inc.", False), ("Licensed under the MIT licence.", False), ("Author: Jo Doe", False), ("Written by Jo Doe", False), ("Since 1.2", False), ("Firm Inc. All rights reserved.", False)])
def test_only_whole_sentences_are_pointers_or_notices(doc, says):
    assert docs.informative("f", doc) is says


def test_pairs_of_nodes_and_sources(spark):
    src = "package a\n\n// Pay sends the money unless the order is closed.\nfunc Pay(x int) int {\n\treturn x // }\n}\n\n// Run\nfunc Run() {}\n"
    files = spark.createDataFrame([("a.go", None, bytearray(b"old")), ("a.go", 1, bytearray(src.encode()))], "path string, t int, content binary").withColumn("modification_time", F.timestamp_seconds("t"))
    n = "branch string, id string, type string, name string, file_path string, line int, signature string, doc_comment string, t int, d int, description string"
    row = lambda i, doc, kind="Function", sig="func Pay(x int) int", t=1, d=None: ("main", i, kind, "Pay", "a.go", 4, sig, doc, t, d, "clash")
    good = "Sends the money unless closed."
    nodes = spark.createDataFrame([row("1", good), row("2", "Pay"), row("3", good, "Class"), row("4", good, sig=""), row("5", good, t=1), row("5", "Pay", t=2), row("6", good, d=3), row("7", good, "Method"), row("7", good, "Method"), row("8", None)], n)
    nodes = nodes.withColumn("indexed_at", F.timestamp_seconds("t")).withColumn("deleted_at", F.timestamp_seconds("d"))
    got = {r.node_id: r for r in docs.node_pairs(nodes, files).collect()}
    assert set(got) == {"1", "7"} and got["1"].code.startswith("func Pay") and got["1"].code.endswith("}") and got["1"].description == good
    pairs = docs.source_pairs(files).collect()
    assert [(r.name, r.description) for r in pairs] == [("Pay", "Pay sends the money unless the order is closed.")]
    assert docs.node_pairs(nodes.limit(0), files).count() == 0


def test_the_lexed_function_decides(spark):
    """A comment that repeats its function's body is code: only the function as lexed shows it. A comment that the file
    doesn't have at the node's place is judged by itself."""
    src = "class A:\n    # move the money now\n    def pay(self):\n        move the money now\n\n    def run(self):\n        \"\"\"Waits until the sensor is ready.\"\"\"\n        return '}'\n"
    files = spark.createDataFrame([("a.py", bytearray(src.encode()))], "path string, content binary").withColumn("modification_time", F.lit(None).cast("timestamp"))
    rows = [("1", "pay", 3, "move the money now"), ("2", "run", 6, "* Waits until\n the sensor is ready"), ("3", "run", 6, "move the money now"), ("4", "gone", 90, "move the money now"), ("5", "run", 6, "run")]
    nodes = spark.createDataFrame([("main", i, "Method", n, "a.py", k, "def x(self)", doc, None, None) for i, n, k, doc in rows], "branch string, id string, type string, name string, file_path string, line int, signature string, doc_comment string, indexed_at timestamp, deleted_at timestamp")
    got = {r.node_id: r for r in docs.node_pairs(nodes, files).collect()}
    assert set(got) == {"2", "3", "4"} and got["2"].code.startswith("def run") and got["2"].description == "Waits until the sensor is ready." and got["4"].code is None
    assert {r.node_id for r in docs.node_pairs(nodes, files, code=False).collect()} == set(got)
    assert {r.node_id for r in docs.node_pairs(nodes).collect()} == {"1", "2", "3", "4"}


# ---- 10: wrong encodings -------------------------------------------------------------------------------------------------------------------

CLEAN = [
    "Größe und Übergabe müssen geprüft werden.", "L’équipe préfère un schéma plus léger.", "AVALIAÇÃO: A OPÇÃO está à direita.", "Каждый список хранит не более 200 записей.", "ОШИБКА возникает, когда узел удалён.", "依存関係は2024-05-26に確認しました。",
    "├── silo/\n│   └── a.go\n┌────┐", "Drift at 40 °C was ½ of €60 ± 2 µm ≤ 3 × 4 → ok ✅ 🔧 👩‍🔧", "한국어 목록", "مرحبا", "Ωμέγα", "<p>A &nbsp;&eacute;&#233;&#8217;&amp; co. &#x2192;</p>", "plain ascii only", "“quoted” – it’s…", "==\u200b\ufeff", "§ 12 © ® ™ £5 ¥3", "naïve café, crêpe and jalapeño", "São Paulo, Łódź, Århus",
]
DAMAGE = [
    lambda t: t.encode("utf-8").decode("cp1252", "replace") if "�" not in t.encode("utf-8").decode("cp1252", "replace") else t.encode("utf-8").decode("latin-1"), lambda t: t.encode("utf-8").decode("latin-1"), lambda t: t.encode("utf-8").decode("cp437"),
    lambda t: t.encode("utf-8").decode("mac_roman"), lambda t: t.encode("utf-8").decode("cp850"), lambda t: t.encode("utf-8").decode("latin-1").encode("utf-8").decode("latin-1"),
    lambda t: "".join(c if ord(c) < 128 else f"&#{ord(c)};" for c in t.encode("utf-8").decode("latin-1")),
]
TEXTS = ["Die Größe hängt von der Übergabe ab und wird später geprüft.", "La clé a été supprimée après la réunion, où placer le modèle ?", "La función añade un pequeño retraso según el árbol.", "Каждый список хранит не более двухсот записей."]


@pytest.fixture(scope="module")
def restorer():
    pairs = {}
    for w in "каждый список хранит не более двухсот записей узел удалён ошибка возникает когда объект пустой после проверки модуль строк важен порядок меняется".split() * 30:
        for a, b in zip("^" + w, w + "$"):
            pairs[a + b] = pairs.get(a + b, 0) + 1
    return mojibake.Restorer(pairs)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_are_no_case(restorer, text):
    assert restorer.document(text)[1] == 0 and restorer.document(text)[3] == 0


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("k", range(len(DAMAGE)))
def test_damage_is_found_and_mostly_restored(restorer, text, k):
    bad = DAMAGE[k](text)
    back, gain, paths, lost = restorer.document("Kept. " + bad)
    assert gain > 0, (bad, back)
    right = sum(a == b for a, b in zip(back[6:].split(), text.split()))
    assert right >= 0.7 * len(text.split()), (bad, back)


@pytest.mark.parametrize("was,read,text", [("cp1252", "cp1251", TEXTS[0]), ("koi8_r", "cp1251", TEXTS[3]), ("cp866", "cp1251", TEXTS[3]), ("mac_roman", "cp1252", TEXTS[1]), ("cp932", "cp1252", "依存関係は確認しました。")])
def test_one_byte_pages(restorer, was, read, text):
    data = text.encode(was, "ignore")
    bad = data.decode(read, "ignore") if read != "cp1252" else "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)
    assert restorer.document(bad)[1] > 0


def test_every_encoding_is_read_after_every_page():
    tried = {}
    for page in mojibake.READ_AS:
        for enc in mojibake.WAS_IN:
            # Two bytes that a page and an encoding both know, of different characters.
            for data in (bytes([a, b]) for a in range(0xA1, 0xF0, 3) for b in range(0xA1, 0xF0, 3)):
                s, t = mojibake._decode(data, page), mojibake._decode(data, enc)
                if s and t and s != t and mojibake._encode(s, page) == data:
                    tried[page, enc] = t in {x for _, x, _ in mojibake.moves(s)}
                    break
    assert all(tried.values()) and {(p, e) for p in ("gbk", "cp932") for e in ("koi8_r", "cp866", "mac_roman", "iso8859_5", "mac_cyrillic", "cp437", "cp850")} <= set(tried)


def test_a_limit_only_stops_texts_beyond_it(restorer):
    for t in [*CLEAN, *TEXTS, *(d(t) for d in DAMAGE for t in TEXTS)]:
        whole = mojibake.Plausibility(restorer.model.counts).cost(t)
        for limit in (0.0, 0.7 * whole, whole, whole + 1e-6):
            c = mojibake.Plausibility(restorer.model.counts).cost(t, limit)
            assert c == whole or limit <= c <= whole


def test_tables_cost_like_characters(restorer, monkeypatch):
    for t in [*CLEAN, *TEXTS, *(d(t) for d in DAMAGE for t in TEXTS), "\U0001f527b\u200d", "–s–a ёЁ aL│★★", "aBcD éÉ"]:
        monkeypatch.setattr(mojibake, "SHORT", 10**9)
        one = mojibake.Plausibility(restorer.model.counts).cost(t)
        monkeypatch.setattr(mojibake, "SHORT", 0)
        assert abs(mojibake.Plausibility(restorer.model.counts).cost(t) - one) < 1e-9


@pytest.mark.parametrize("read", ["latin-1", "cp1252"])
@pytest.mark.parametrize("n", [1333, 5000, 10_000])
def test_long_runs_are_restored_like_short_ones(restorer, read, n):
    text = ("依存関係は日に確認しました。節点の一覧を記録する。" * n)[:n]
    bad = "".join(chr(b) if read == "latin-1" or b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode())
    assert restorer.document(bad)[0] == text
    mixed = "{" + '"k":"v",' * 700 + bad + '"k":1,' * 900 + bad + "}"
    assert restorer.document(mixed)[0] == mixed.replace(bad, text)
    escaped = "".join(f"&#{ord(c)};" for c in text.encode().decode("latin-1"))
    assert restorer.document(escaped)[0] == text


def test_long_clean_runs_are_no_case(restorer):
    for text in ("依存関係は確認しました。" * 900, "é" * 9000, "x" * 9000 + "Größe", "Каждыйсписок" * 900):
        assert restorer.document(text)[:2] == (text, 0)


def test_garbled_frames(spark):
    rows = [(1, TEXTS[0]), (2, DAMAGE[1](TEXTS[0])), (3, None), (4, ""), (5, "lost: caf\ufffd"), (2, DAMAGE[1](TEXTS[0])), (6, "x" * 50_000 + " " + "é" * 5000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, gain double")
    got = mojibake.find_garbled(df).collect()
    assert sorted(r.doc_id for r in got) == [2, 2, 5]
    assert sorted(r.doc_id for r in mojibake.garbled_ids(df).collect()) == [2, 5]
    odd = spark.createDataFrame([(None, DAMAGE[1](TEXTS[0])), (None, "Größe"), (1, DAMAGE[1](TEXTS[1])), (1, "x"), (1, DAMAGE[1](TEXTS[0]))], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.restored) for r in mojibake.find_garbled(odd).collect()) == sorted([(0, TEXTS[0]), (1, TEXTS[1]), (1, TEXTS[0])])
    assert next(r for r in got if r.doc_id == 2).restored == TEXTS[0] and next(r for r in got if r.doc_id == 5).lost == 1
    assert mojibake.find_garbled(df.limit(0)).count() == 0


def test_lines_of_the_own_body_are_code():
    body = "func Pay() {\n\tmove the money now\n}"
    assert docs.informative("Pay", "move the money now") and not docs.informative("Pay", "move the money now", body)
