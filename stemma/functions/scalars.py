"""Scalar functions as Column expressions: paths, URLs, names, lists in strings, test-naming rules."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Paths (X01, X06, X07, X10, X12) ----------------------------------------------------------------


def top_dir(path: Column) -> Column:
    """'' for '', '(root)' without a slash or with a leading one, else the first component."""
    return F.when(path == "", "").when(~path.contains("/") | path.startswith("/"), "(root)").otherwise(F.split_part(path, F.lit("/"), F.lit(1)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dir_name(path: Column) -> Column:
    """'.' for a bare file name, '/' for one at the root."""
    d = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when(~path.contains("/"), ".").when(d == "", "/").otherwise(d)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


# Languages by suffix.
LANGUAGES = {
    ".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".java": "java", ".rs": "rust",
    ".cs": "csharp", ".rb": "ruby", ".rake": "ruby",
}
MORE_LANGUAGES = LANGUAGES | {
    ".html": "html", ".htm": "html", ".md": "markdown", ".mk": "makefile", ".sh": "shell", ".bash": "shell", ".tf": "terraform", ".tfvars": "terraform",
    ".yaml": "yaml", ".yml": "yaml", ".vue": "html", ".svelte": "html", ".jinja": "html", ".jinja2": "html", ".tmpl": "html",
}


def _lookup(column: Column, table: dict[str, str], default: str = "") -> Column:
    out = F.lit(default)
    for value in dict.fromkeys(table.values()):
        out = F.when(column.isin([k for k, v in table.items() if v == value]), value).otherwise(out)
    return out


def infer_language(path: Column, everything: bool = False) -> Column:
    return _lookup(extension(path), MORE_LANGUAGES if everything else LANGUAGES)


def language_of(language: Column, path: Column) -> Column:
    """The stated language, by suffix where it is unset."""
    return F.when(language != "", language).otherwise(infer_language(path))


def immediate_dir(path: Column, package: Column) -> Column:
    """Name of the directory that holds the file, the package where there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(package)


def relative(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


# ---- URLs (X02-X04) -----------------------------------------------------------------------------------


def normalize_path(path: Column) -> Column:
    """One slash for several, and one in front."""
    p = F.regexp_replace(path, "/+", "/")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def normalize_url(path: Column) -> Column:
    """Lower case, no trailing slash, a leading one, parameters {x}, :x and <x> as '*'."""
    p = F.regexp_replace(F.lower(path), "/+$", "")
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    return F.regexp_replace(p, r"\{[^}]+\}|:[a-z_][a-z0-9_]*|<[^>]+>", "*")


def match_segments(a: Column, b: Column) -> Column:
    """Same number of segments, each equal or '*' on either side."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.forall(F.zip_with(x, y, lambda p, q: (p == q) | (p == "*") | (q == "*")), lambda t: F.coalesce(t, F.lit(False)))
    return (F.size(x) == F.size(y)) & same


# ---- Names and text (X05, X11, X13, X14, X18, X19, X22-X25) ------------------------------------------------


def normalize_python(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("-"), F.lit("_")))


def comma_split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def normalize_topic(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, r"[\s]+", " "))), " +", " ")


def strip_svg(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"\s+", " "))


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substr(text, F.lit(1), F.lit(n)), F.lit("..."))).otherwise(text)


def snippet(text: Column, lines: int = 3, most: int = 200) -> Column:
    """The first lines that are neither blank nor a code fence, joined by ' | ', cut at `most`."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("```"))
    s = F.array_join(F.slice(kept, 1, lines), " | ")
    return F.when(F.length(s) > most, F.concat(F.substr(s, F.lit(1), F.lit(most)), F.lit("..."))).otherwise(s)


def pep508(line: Column) -> Column:
    """struct(name, version) of a requirement line: extras and markers left out."""
    return F.struct(
        F.regexp_extract(line, r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)", 1).alias("name"),
        F.trim(F.regexp_extract(line, r"^\s*[A-Za-z0-9][A-Za-z0-9._-]*(?:\[[^\]]*\])?\s*([^;#]*)", 1)).alias("version"),
    )


def find_line(lines: Column, needle: Column) -> Column:
    """Number of the first line that contains needle, 0 if none."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: x.contains(needle)), True), F.lit(0)).cast("int")


def diff_files(diff: Column) -> Column:
    """Paths of a unified diff's '+++ b/' headers."""
    return F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(.+)$"), F.lit(1))


# Words that carry no meaning in a question.
STOP_WORDS = ["the", "and", "for", "how", "what", "does", "this", "that", "with", "from", "are", "was", "has", "not", "all"]


def keywords(question: str) -> list[str]:
    """Words of three bytes and more, lower case, without stop words."""
    return [w for w in question.lower().split() if len(w.encode()) >= 3 and w not in STOP_WORDS]


def entity_in_question(question: Column) -> Column:
    """The first word that looks like a path, else the first that looks like a name."""
    words = F.transform(F.split(question, r"\s+"), lambda w: F.regexp_replace(w, r"^[\"'`(]+|[\"'`),.?!:;]+$", ""))
    paths = F.filter(words, lambda w: w.rlike(r"^[\w./-]+\.[A-Za-z]{1,5}$"))
    names = F.filter(words, lambda w: w.rlike(r"^[A-Za-z_]\w*$") & (w.rlike(r"[a-z][A-Z]") | w.contains("_") | w.rlike("^[A-Z][a-z]+[A-Z]")))
    return F.coalesce(F.try_element_at(paths, F.lit(1)), F.try_element_at(names, F.lit(1)), F.lit(""))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where either vector is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def first_json_array(text: str | None) -> str | None:
    """The first balanced [...] of a text, brackets in strings left out of account; None if there is none."""
    start = (text or "").find("[")
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for k in range(start, len(text)):
        c = text[k]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "[]":
            depth += 1 if c == "[" else -1
            if depth == 0:
                return text[start : k + 1]
    return None


def json_array(text: Column) -> Column:
    """first_json_array of a column, to be read by from_json."""
    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(first_json_array)

    return cut(text)


# ---- Test naming (F07-F09, X08, X09) ---------------------------------------------------------------------


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# How test files are named, per language; one regex each keeps the generated code small.
TEST_FILES = {
    "go": r"_test\.go$", "python": r"(^|/)(test_[^/]*\.py|[^/]*_test\.py)$", "typescript": r"\.(test|spec)\.tsx?$", "javascript": r"\.(test|spec)\.jsx?$",
    "java": r"(^|/)([^/]*(Test|Tests|IT)|Test[^/]*)\.java$", "rust": r"(^|/)tests(/|$)", "csharp": r"(^|/)([^/]*(Test|Tests)|Test[^/]*)\.cs$",
    "ruby": r"(^|/)([^/]*(_spec|_test)|test_[^/]*)\.rb$",
}
_SUFFIX = {"go": "go", "python": "py", "typescript": "tsx?", "javascript": "jsx?", "java": "java", "rust": "rs", "csharp": "cs", "ruby": "(rb|rake)"}
_FIVE = ["go", "python", "typescript", "javascript", "java"]


def _speaks(lang: str, language: Column, path: Column) -> Column:
    """The node's language is lang, by its suffix where it is unset."""
    return (language == lang) | ((language == "") & path.rlike(rf"(?i)\.{_SUFFIX[lang]}$"))


def is_test_file(path: Column, language: Column, all_languages: bool = True) -> Column:
    """By the file name, for the stated language (by suffix where unset): eight languages, or the five of the queries."""
    return _any(*[_speaks(k, language, path) & path.rlike(v) for k, v in TEST_FILES.items() if all_languages or k in _FIVE])


def is_test_function(name: Column, language: Column, path: Column, all_languages: bool = True) -> Column:
    """By its name, in most languages only within a test file."""
    named = {"go": "^(Test|Benchmark|Example|Fuzz)", "python": "^test_", "java": "^test", "rust": "^test_", "csharp": "^Test", "ruby": "^test_"}
    out = []
    for lang in TEST_FILES if all_languages else _FIVE:
        c = _speaks(lang, language, path)
        if lang in named:
            c = c & name.rlike(named[lang])
        if lang not in ("go", "java"):
            c = c & path.rlike(TEST_FILES[lang])
        out.append(c)
    return _any(*out)


def _join(d: Column, b: Column) -> Column:
    return F.when(d == ".", b).when(d == "/", F.concat(d, b)).otherwise(F.concat(d, F.lit("/"), b))


def source_paths(path: Column, language: Column) -> Column:
    """Candidate source files of a test file, best first."""
    d, b = dir_name(path), base_name(path)
    put = lambda cond, new, where=None: F.when(cond, _join(d if where is None else where, new))
    sub = lambda pattern, new: F.regexp_replace(b, pattern, new)
    suffixed = lambda ext: [
        F.when(b.rlike(rf"Tests\{ext}$"), _join(d, sub(rf"Tests\{ext}$", ext))).when(b.rlike(rf"Test\{ext}$"), _join(d, sub(rf"Test\{ext}$", ext))),
        put(b.startswith("Test"), F.regexp_replace(b, "^Test", "")),
    ]
    java = suffixed(".java")
    java[0] = java[0].when(b.rlike(r"IT\.java$"), _join(d, sub(r"IT\.java$", ".java")))
    plain = lambda items: F.filter(F.array(*items), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    return (
        F.when(language == "go", plain([put(b.endswith("_test.go"), sub(r"_test\.go$", ".go"))]))
        .when(language == "python", plain([put(b.startswith("test_"), sub("^test_", "")), put(b.endswith("_test.py"), sub(r"_test\.py$", ".py"))]))
        .when(language == "typescript", plain([put(b.rlike(r"\.(test|spec)\.tsx?$"), sub(r"\.(?:test|spec)\.(tsx?)$", ".$1"))]))
        .when(language == "javascript", plain([put(b.rlike(r"\.(test|spec)\.jsx?$"), sub(r"\.(?:test|spec)\.(jsx?)$", ".$1"))]))
        .when(language == "java", plain(java))
        .when(language == "csharp", plain(suffixed(".cs")))
        .when(language == "rust", plain([put(b.startswith("test_"), sub("^test_", ""), _join(dir_name(d), F.lit("src"))), put(b.startswith("test_"), sub("^test_", ""))]))
        .when(language == "ruby", plain([put(b.endswith("_spec.rb"), sub(r"_spec\.rb$", ".rb")), put(b.endswith("_test.rb"), sub(r"_test\.rb$", ".rb")), put(b.startswith("test_"), sub("^test_", ""))]))
        .otherwise(none)
    )


def source_names(name: Column, language: Column) -> Column:
    """Candidate names of the function that a test function tests, best first."""
    rest = F.regexp_extract(name, "^(?:Test|Benchmark|Example|Fuzz)(.+)$", 1)
    at = F.instr(rest, "_")
    owner, method = F.regexp_extract(rest, "^([^_]+)_", 1), F.regexp_extract(rest, "^[^_]+_(.*)$", 1)
    go = F.when(rest == "", F.array().cast("array<string>")).when(at > 1, F.when(method != "", F.array(owner, method, F.concat(owner, F.lit("."), method))).otherwise(F.array(owner))).otherwise(F.array(rest))
    after = lambda prefix: F.regexp_replace(name, "^" + prefix, "")
    lower = lambda c: F.concat(F.lower(F.substr(c, F.lit(1), F.lit(1))), F.substr(c, F.lit(2)))
    none = F.array().cast("array<string>")
    return (
        F.when(language == "go", go)
        .when(language.isin("python", "rust", "ruby"), F.when(name.startswith("test_"), F.array(after("test_"))).otherwise(none))
        .when(language.isin("typescript", "javascript"), F.array(name))
        .when(language == "java", F.when(name.rlike("^test."), F.array(lower(after("test")), after("test"))).otherwise(none))
        .when(language == "csharp", F.when(name.rlike("^Test."), F.array(after("Test"), lower(after("Test")))).otherwise(none))
        .otherwise(none)
    )


# ---- Rows (P06, P07, P10) ----------------------------------------------------------------------------------


def location(path: Column, line: Column) -> Column:
    return F.when(line > 0, F.concat_ws(":", path, line.cast("string"))).otherwise(path)


def line_range(line: Column, end: Column) -> Column:
    return F.when((end > 0) & (end != line), F.concat_ws("-", line.cast("string"), end.cast("string"))).otherwise(line.cast("string"))


def embeddable_text(prop=lambda k: F.element_at("properties", k)) -> Column:
    """What is embedded for a node: name, package, file, qualified name, role, pattern, layer, documentation and
    signature on lines of their own; '' without documentation and signature."""
    col = F.col
    tagged = lambda c, label: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    text = F.concat_ws(
        "\n", col("name"), tagged(col("package"), "Package"), tagged(col("file_path"), "File"),
        F.when(col("qualified_name") != col("name"), tagged(col("qualified_name"), "Qualified")),
        tagged(prop("architectural_role"), "Role"), tagged(prop("design_pattern"), "Pattern"), tagged(prop("layer"), "Layer"),
        F.when(col("doc_comment") != "", col("doc_comment")), F.when(col("signature") != "", col("signature")),
    )
    return F.when((col("doc_comment") == "") & (col("signature") == ""), "").otherwise(text)
