"""Problem 4: functions paired with their documentation.

A state machine (functions/lexer.py) divides source text into code, strings and comments, so braces and keywords
inside strings and comments don't count. Functions are found in what is left, delimited by matched braces (indentation
in Python, keyword pairs in Ruby), and get the documentation comment that stands directly before them (the docstring in
Python). In the same pass each comment is cleaned of marks and judged beside its function's name and body: what says
nothing in words beyond them is dropped. Nodes take the verdict on the function at their place."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexer import functions_of
from ..session import partitions, ship

FUNCTIONS = "path string, name string, line int, end_line int, signature string, doc string, code string, print string, description string"

# ---- Descriptions -------------------------------------------------------------------------------

_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//[/!]?|#+(?!\w)|--+|;+|<!--|-->|\"\"\"|'''|%+)\s?|\s*(?:\*+/|-->|\"\"\"|''')\s*$")
_XML = re.compile(r"</?(?:summary|remarks|para|p|returns?|param|value|exception|see|seealso|inheritdoc|c|code|example|br|b|i|ul|li|typeparam)\b[^>]*>", re.I)
# Tags whose words describe, and tags that only manage.
_TAG_WITH_NAME = re.compile(r"^[@:\\](?:param|arg|argument|parameter|property|prop|tparam|template|throws?|exception|raises?|type|typeparam)\b:?\s*(?:\{[^}]*\}\s*)?[\w$.\[\]]*:?\s*-?\s*", re.I)
_TAG_RETURN = re.compile(r"^[@:\\](?:returns?|yields?)\b:?\s*(?:\{[^}]*\}\s*)?-?\s*", re.I)
_TAG_OTHER = re.compile(r"^\{?@(?!deprecated|brief|summary|description|desc|details|remarks?|note)\w+\b.*$|^:(?!param|returns?|raises?)\w+:.*$", re.I)
_TAG_WORDS = re.compile(r"^@(?:brief|summary|description|desc|details|remarks?|note|deprecated)\b:?\s*", re.I)
_HEADING = re.compile(r"^(?:args?|arguments?|parameters?|params?|returns?|raises|throws|yields|examples?|usage|notes?|description|summary|remarks|attributes|see also|since|author|version|todo)\s*:?\s*$", re.I)
_ITEM = re.compile(r"^[\w$*]+\s*(?:\([^)]*\))?\s*:\s*")
_TOOL = re.compile(
    r"^(?:noqa\b|nolint\b|eslint[-\w]*|ts-(?:ignore|expect-error|nocheck)|tslint:|jshint|jslint|istanbul\b|c8 ignore|v8 ignore|prettier-ignore|pylint:|flake8:|mypy:|pyright:|type:\s*ignore|"
    r"pragma\b|nosec\b|nosonar\b|rubocop:|standard:|checkstyle|spotless|go:\w+|lint:\w+|\+build\b|rustfmt::|clippy::|allow\(|suppresswarnings|suppress\b|resharper\b|noinspection\b|stylecop|codeql|coverage:|"
    r"#?region\b|#?endregion\b|mark:|pragma mark|generated by|language=|vim:|-\*-|fmt:|yapf:|isort:|black:|sonar\b|biome-ignore|deno-lint-ignore|phpcs:|psalm-|swiftlint:|ktlint|detekt|nocov|skipcq|cspell:|spell-checker:)", re.I)
_RIGHTS = re.compile(
    r"^\W*(?:spdx-license-identifier|copyright\b(?=\W*(?:$|\(c\)|©|\d{4}|by\b|notice\W*$|(?-i:[A-Z])))|©|(?:this|the) (?:\w+ ){1,3}(?:is|are) (?:free software|licen[cs]ed (?:under|to)\b)|(?:dual[- ])?licen[cs]ed (?:under|to)\b|"
    r"use of this source|governed by the licen[cs]e|authors?(?:\s*[:=]|\W*$|\s+(?-i:[A-Z]))|(?:written|created) by\b\s*(?:$|:|(?-i:[A-Z]))|maintainers?(?:\s*:|\W*$|\s+(?-i:[A-Z]))|(?:since|version)\s*:?\s*v?[\d.]+\W*$)|"
    r"\(c\)\s*\d{4}|all rights reserved\W*$|\bis governed by the licen[cs]e|licen[cs]e in the (?:\w+ ){0,2}(?:root|licen[cs]e|copying|file|repository|project|distribution)", re.I)
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b.*", re.S)
_TODO_LOW = re.compile(r"^(?:todo|fixme|xxx|hack|tbd|tba|wip)\b", re.I)
# A sentence points elsewhere if it is such a phrase and its target; what follows the target in a clause of its own is
# said here. Words that may as well tell what a function does point only if nothing but names and _TARGET words follow.
_POINTER = re.compile(
    r"^(?:\{?@(?:see|inheritdoc|link|ref)\b|(?:see|inheritdoc)\b|refer to\b|cf\.|same as\b|as above|as below|ditto\b|idem\b|dito\b|siehe\b|voir\b|véase\b|ver\b|veja\b|см\b|смотри|inherited\b|documented (?:in|at|elsewhere)|"
    r"(?:for )?(?:details|documentation|docs|more)[^.]{0,20}\bsee\b)", re.I)
_POINTER_OR_VERB = re.compile(r"^(?:compare(?: (?:to|with))?|overrides?|implements?|link|ref)\b", re.I)
_CLAUSE = re.compile(r"[;,]|\s[-–—]\s|\b(?:but|except|because|which|unless|instead|otherwise|and (?:also|then))\b")
_TARGET = set("interface interfaces base parent super superclass subclass class trait protocol abstract virtual method methods member documentation docs doc details detail info information description comment above below here there section file page spec contract same corresponding inherited".split())
_NAMED = re.compile(r"`[^`]*`|\{@[^}]*\}|https?://\S+|\w+(?:(?:\.|::|#|->|/)\w+)+(?:\(\))?|#\w+|\w+\(\)|\b\w*[a-z]\w*[A-Z]\w*|\b\w+_\w+|\b(?-i:[A-Z])\w*")
_END = (
    r"(?:\W+(?:here|goes|go|of|for|to|the|this|that|these|it|its|a|an|in|method|function|class|constructor|type|field|member|param|parameters?|returns?|value|text|description|documentation|docs?|comment|summary|what|does|do|later|soon|please|missing|needed|required|pending|follows|coming|"
    r"unavailable|not|yet|now|be|is|are|was|added|written|done|defined|documented|completed|filled|provided|given|available|found|exists?|stub|block|code|todo|tbd|and|or|by|author|developer|there))*\W*")
_PLACEHOLDER = re.compile(
    r"^(?:n/?a|none|nil|empty|todo|tbd|tba|wip|xxx+|\?+|\.{2,}|…+|-+|lorem ipsum.*|placeholder" + _END + r"|(?:auto-?generated|generated) (?:method|function|constructor|catch|code|javadoc|documentation)?\s*(?:stub|block)?" + _END + r"|"
    r"(?:insert|add|write|put|enter|provide|fill in|missing|no|needs?|pending|your|some|short|brief|proper)\b(?:\s+(?:a|an|the|in|your|my|some|any|proper|short|brief|meaningful|useful|better|more|detailed|good|full|real|actual|further|missing|method|function|class|code|java|api|here|is|this|of))*\s+"
    r"(?:description|documentation|docs?|docstring|comment|summary|text|javadoc)\b" + _END + r"|"
    r"(?:description|documentation|docs?|docstring|summary|comment|javadoc)\s+(?:of|for|goes|pending|missing|needed|required|here|to come|to be|follows|tbd|coming|unavailable|not)\b" + _END + r"|"
    r"(?:description|documentation|docs?|docstring|_?summary_?|comment|doc)|undocumented|(?:document|describe|explain) (?:this|me|it)|to be (?:done|documented|written|completed|defined)" + _END + r"|coming soon|"
    r"beschreibung (?:fehlt|folgt)(?:\W+\w+){0,2}|à (?:compléter|documenter|faire)(?:\W+\w+){0,2}|por (?:hacer|documentar|definir)(?:\W+\w+){0,2}|a (?:definir|documentar)(?:\W+\w+){0,2}|sin (?:descripción|documentación)|sem (?:descrição|documentação)|ohne beschreibung|keine beschreibung|pas de description)$", re.I)
_FILLER = set(
    "a an the this that these those it its of for to in on at by with and or is are be as does do did done will can when used use uses using called call calls method methods function functions func fn procedure routine "
    "getter setter accessor mutator constructor helper implementation implements performs perform executes execute handles handle runs value values object instance given "
    "field fields number get gets getting set sets setting return returns returning".split())
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*", re.U)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯฀-๿]")
_CODE_LINE = re.compile(
    r"^(?:[{}()\[\];,]+|.*[;{]|(?:[\w$]+\.)*[\w$\[\]]+\s*(?::=|\+=|-=|=)\s*\S.*|(?:[\w$]+(?:\.|::|->))*[\w$]+\((?:[^()]|\([^()]*\))*\)[;,]?|"
    r"(?:if|elif|for|while|switch|unless|until|foreach)\b.*(?:==|!=|<=|>=|<|>|&&|\|\||\bin\b.*:|\{|:)\s*.*|return(?:\s+[\w.$()\[\]\"']+)?;?|(?:else|try|finally|begin|end|do|pass|break|continue)\b\s*[:{]?|"
    r"(?:import|from|package|using|require|include|def|func|fn|function|class|const|let|var|print|raise|throw|yield|assert|await|async)\b.*[({;:\"']?.*[)};:\"'])$")


def clean(comment: str | None) -> str:
    """A comment's text without marks, markup and the blank frame around it."""
    if not comment:
        return ""
    text = comment.strip()
    out = []
    for line in text.splitlines():
        s = line.strip()
        for _ in range(3):
            t = _MARKS.sub("", s)
            if t == s:
                break
            s = t.strip() if not t.startswith(" ") else t.rstrip()
        out.append(_XML.sub(" ", s).strip())
    return "\n".join(out).strip("\n ")


def _stem(w: str) -> str:
    w = w.lower()
    for end in ("ings", "ing", "ies", "ied", "ers", "er", "ed", "es", "s", "e", "y", "t"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def _name_stems(name: str) -> set[str]:
    parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+", name or "")
    return {_stem(p) for p in parts} | {_stem(p) for p in re.findall(r"[^\W\d_]+", name or "")} | {_stem(re.sub(r"[\W_]", "", name or ""))}


def _beyond_pointer(bare: str) -> str:
    """A sentence without the part that only points elsewhere."""
    m = _POINTER.match(bare)
    if m:
        clause = _CLAUSE.search(bare, m.end())
        return _NAMED.sub(" ", bare[clause.end() :]) if clause else ""
    m = _POINTER_OR_VERB.match(bare)
    if m:
        rest = _NAMED.sub(" ", bare[m.end() :])
        if not any(w.lower() not in _TARGET | _FILLER and len(w) > 1 for w in _WORD.findall(rest)):
            return ""
    return bare


def words_said(name: str | None, doc: str | None, body: str | None = None) -> int:
    """How many words of a documentation comment say something beyond the function's name; CJK text counts two
    characters as a word. 0 for what only marks, points elsewhere, instructs tools, states rights, is code or to do. Lines
    that stand in the function's body as lexed (strings and comments left out) are code put into a comment."""
    text = clean(doc)
    if not text:
        return 0
    own = {x for x in map(str.strip, body.split("\n")) if len(x) > 3} if body else ()
    known = _name_stems(name or "")
    lines, params = [], set()
    for raw in text.split("\n"):
        s = raw.strip()
        if not re.search(r"[^\W_]", s):
            continue
        m = _TAG_WITH_NAME.match(s)
        if m:
            lines.append(("tag", s[m.end():]))
            continue
        m = _TAG_RETURN.match(s)
        if m:
            lines.append(("tag", s[m.end():]))
            continue
        s = _TAG_WORDS.sub("", s)
        if not s or _TAG_OTHER.match(s) or _HEADING.match(s) or _TOOL.match(s) or _RIGHTS.search(s) or _CODE_LINE.match(s) or s in own:
            continue
        lines.append(("text", s))
    total = 0
    for kind, s in lines:
        if kind == "text" and _ITEM.match(s) and len(lines) > 1:
            s = _ITEM.sub("", s, count=1)
        for sentence in re.split(r"(?<=[.!?。])\s+", s):
            sentence = _TODO.sub("", sentence).strip()
            bare = sentence.strip(" \t.!?:;-–—*_[](){}<>\"'`~=#|/\\")
            if not bare or _TODO_LOW.match(bare) or _PLACEHOLDER.match(bare) or _TOOL.match(sentence):
                if _TODO_LOW.match(bare):
                    break
                continue
            bare = _beyond_pointer(bare)
            cjk = len(_CJK.findall(bare))
            if cjk:
                total += cjk // 2
            for w in _WORD.findall(bare):
                if _CJK.search(w):
                    continue
                low = w.lower()
                if low in _FILLER or _stem(low) in known or len(low) < 2:
                    continue
                total += 1
    return total


def informative(name: str | None, doc: str | None, body: str | None = None, least: int = 2) -> bool:
    return words_said(name, doc, body) >= least


# ---- Operators ----------------------------------------------------------------------------------


def print_of(comment: str | None) -> str:
    """A comment reduced to its letters and digits: marks, frames and line breaks make no difference."""
    return re.sub(r"[\W_]+", "", comment or "")


def _print_column(comment) -> Column:
    return F.md5(F.regexp_replace(comment, r"[^\p{L}\p{N}]+", ""))


def extract_functions(files: DataFrame, path: str = "path", content: str = "content", modified: str | None = "modification_time", columns: list[str] | None = None) -> DataFrame:
    """All functions of the newest version of each file: FUNCTIONS, or those of its columns that are asked for. doc is the
    comment that the lexer attached, as written ('' if none), print the md5 of its letters and digits (null if it has
    none), description its clean text if it says something (else null).

    Files of null path or null or empty content give none; bytes that aren't UTF-8 are replaced. Versions of the same
    time count as one (the greatest content). Only the named columns are read."""
    ship(files.sparkSession)
    at = F.col(modified) if modified else F.lit(None).cast("timestamp")
    src = files.select(F.col(path).alias("path"), at.alias("at"), F.col(content).alias("content")).where("path is not null")
    newest = src.groupBy("path").agg(F.max(F.struct("at", "content")).alias("f")).select("path", F.col("f.content").alias("content"))
    kinds = dict(c.split(" ") for c in FUNCTIONS.split(", "))
    wanted = columns or list(kinds)

    def run(frames):
        for pdf in frames:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                text = c.decode("utf-8", "replace") if isinstance(c, (bytes, bytearray)) else (c or "")
                for name, line, end, signature, doc, code, body in functions_of(text.replace("\r\n", "\n").replace("\r", "\n"), p):
                    mark = print_of(doc)
                    said = clean(doc) if doc and informative(name, doc, body) else None
                    rows.append({"path": p, "name": name, "line": line, "end_line": end, "signature": signature, "doc": doc, "code": code, "print": hashlib.md5(mark.encode("utf-8", "replace")).hexdigest() if mark else None, "description": said})
            yield pd.DataFrame(rows, columns=wanted)

    return newest.repartition(partitions(files.sparkSession), "path").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in wanted))


def source_pairs(files: DataFrame, **columns) -> DataFrame:
    """Pairs straight from source files: functions whose documentation says something, with the clean description."""
    return extract_functions(files, **columns).drop("print").where("description is not null")


def _said(name: Column, text: Column) -> Column:
    """The clean text of a comment that says something, null for others."""

    @F.pandas_udf("string")
    def said(names: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([clean(d) if d and informative(n, d) else None for n, d in zip(names, texts)], dtype=object)

    return said(F.coalesce(name, F.lit("")), text)


def node_pairs(nodes: DataFrame, files: DataFrame | None = None, code: bool = True) -> DataFrame:
    """Function and Method nodes whose documentation says something: (branch, node_id, name, signature, description, code).

    Of each (branch, id) the newest row counts (null indexed_at is oldest, of equal times the greatest row); deleted
    nodes and those without a signature are dropped. A node is paired with the function that the lexer found at its path
    and line and whose attached comment is the node's; name, comment and body as lexed decide whether it says
    something. Only a comment that the newest version of the file does not have there (the file is missing, was changed
    since, or holds another comment) is judged as the node states it; its code is then null unless the function is
    there. code=False leaves that column out and reads less. Empty tables give an empty result."""
    cols = ["type", "name", "file_path", "line", "signature", "doc_comment"]
    newest = nodes.groupBy("branch", "id").agg(F.max(F.struct("indexed_at", "deleted_at", *cols)).alias("n")).select("branch", F.col("id").alias("node_id"), "n.*")
    alive = newest.where("type in ('Function', 'Method') and deleted_at is null and signature <> '' and doc_comment <> ''")
    wanted = alive.select("branch", "node_id", "name", "file_path", "line", "signature", "doc_comment", _print_column(F.col("doc_comment")).alias("own_print"))
    out = ["branch", "node_id", "name", "signature", "description", *(["code"] if code else [])]
    if files is None:
        return wanted.withColumn("description", _said(F.col("name"), F.col("doc_comment"))).where("description is not null").withColumn("code", F.lit(None).cast("string")).select(*out)
    lexed = extract_functions(files, columns=["path", "line", "print", "description", *(["code"] if code else [])])
    # A comment belongs to one function of a line, as it begins a line of its own before it.
    first = F.struct(F.col("print").isNotNull().alias("has"), "print", "description")
    there = lexed.groupBy(F.col("path").alias("file_path"), "line").agg(F.max(first).alias("f"), *([F.max_by("code", first).alias("code")] if code else []))
    both = wanted.join(there, ["file_path", "line"], "left").withColumn("same", F.col("f.print").eqNullSafe(F.col("own_print")))
    stated = _said(F.col("name"), F.when(~F.col("same"), F.col("doc_comment")))
    return both.withColumn("description", F.when(F.col("same"), F.col("f.description")).otherwise(stated)).where("description is not null").select(*out)
