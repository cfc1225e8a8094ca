"""Problem 1: source files that nobody wrote by hand in their repository.

Four kinds of evidence, all from whole files:
generated  a generation notice anywhere in the leading or closing comments, found by one pass of a multi-pattern
           automaton (Aho-Corasick), the path of a generator's output, a body of a few line shapes, or functions
           numbered on from first to last;
minified   code with almost no blanks, whatever its suffix;
vendored   an upstream notice in the leading comments, a copy of a catalogued library file (blanks and line
           ends ignored), a package manager's directory, or a directory for others' code (vendor, third_party,
           external, deps) with a second sign: a library's folder in it or the file's licence header;
data       literals make up nearly all of the file.
Hand-written code that only mentions such things has them in strings or later comments, not in its header."""

from __future__ import annotations

import bisect
import re
from collections import Counter

import ahocorasick
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import partitions, ship

# Wordings of generation notices (lower case), and what takes such a notice back.
NOTICES = [
    "code generated by", "code generated from", "<auto-generated", "autogenerated file", "autogenerated from", "autogenerated by",
    "auto-generated file", "auto-generated from", "auto-generated by", "auto generated file", "automatically generated", "@generated",
    "generated by:", "generated by ", "generated from ", "file is generated", "file was generated", "generated file", "generated code - do not",
    "this is the output of", "was written by the", " compiler from ", "rendered by ", ".tmpl", "see the template for changes", "is rebuilt from",
    "edit the schema instead", "edit the template instead", "edit the source instead", "produit automatiquement",
    "généré automatiquement", "automatisch erzeugt", "automatisch generiert", "generado automáticamente", "gerado automaticamente",
    "generato automaticamente", "自動生成", "автоматически сгенерирован", "создан автоматически",
]
# What happens to whose edits, and what a machine wrote: every combination is a notice.
NOTICES += [f"{edit} {fate}" for edit in ("edit", "edits", "change", "changes", "modifications") for fate in ("will be lost", "will vanish", "will be overwritten", "are lost", "are overwritten", "is lost", "is overwritten", "will not survive")]
NOTICES += [f"{who}{how}" for who in ("machine", "tool", "computer") for how in ("-written", "-generated", " generated", "-made", "-produced")]
NOTICES += ["will be overwritten"]
RETRACTIONS = ["by hand since", "maintained by hand", "no longer generated", "was generated code once", "used to be generated", "not generated", "regenerated from this", "method stub"]
# Paths of generators' output, of package managers' copies, and lock files.
GENERATED_PATH = re.compile(
    r"(^|/)(__generated__|generated|generated-sources|generated-src|autogen|build/generated|(?<!tools/)(?<!cmd/)(?<!scripts/)gen|pb)/|(^|/)zz_generated[^/]*$|_(generated|string|enumer)\.(go|py|ts|js|rs|java|rb|cs)$|_pb2(_grpc)?\.pyi?$|[._]pb\.(go|js|d\.ts|rb|cs|cc|h)$|\.pb\.\w+$"
    r"|\.(gen|generated|g)\.\w+$|_autogen\.\w+$|\.Designer\.(cs|vb)$|(Grpc|OuterClass)\.java$|^.*\.min\.\w+\.map$"
)
PACKAGE_PATH = re.compile(r"(^|/)(node_modules|bower_components|jspm_packages|site-packages|Godeps/_workspace|Pods|Carthage/Checkouts)/")
# Directories for others' code, folders that are parts of an application and no library,
# and licence headers (an SPDX line alone is what a firm's own files carry).
OTHERS_PATH = re.compile(r"(?:^|.*?/)(?:vendor|third_party|external|deps)/(?P<rest>.+)$")
LAYOUT = set(
    "app api apis models model entities entity domain controllers controller views view schemas schema services service handlers handler routes router routers "
    "components pages repositories repository migrations types serializers forms admin auth common core shared utils util helpers internal clients client tests test spec".split())
VERSION = re.compile(r"(?:^|[-_@.])v?\d+(?:[._]\d+)+")
LICENCE = re.compile(
    r"permission is hereby granted|redistribution and use in source|licen[cs]ed under the|released under the|distributed under the|dual licen[cs]ed|@licen[cs]e|\b(?:mit|bsd|isc|apache|zlib|boost|mozilla public|gnu (?:lesser |affero )?general public)[\w. -]{0,20}licen[cs]e"
    r"|subject to the terms of the|copyright (?:\(c\) |© )?[\d, -]*\d{4}[\d, -]*.*\b(?:authors|contributors|foundation|project|developers|maintainers|team)\b", re.I)
LOCK_NAMES = {
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "gemfile.lock", "cargo.lock", "poetry.lock",
    "pipfile.lock", "go.sum", "packages.lock.json", "uv.lock",
}
MINIFIED_PATH = re.compile(r"[.-](min|bundle|chunk|prod)\.(js|ts|css|mjs|cjs)$|\.[0-9a-f]{8}\.(js|ts|css)$", re.I)
UPSTREAM = re.compile(
    r"upstream:\s*(https?|git)://"
    r"|\b(?:imported|copied|vendored|included|taken) (?:here )?(?:unmodified|unchanged|verbatim|as is)\b"
    r"|this file is part of [\w.@/-]+ \(release"
    r"|licensed to the [\w.@/-]+ project under"
    r"|copyright (\(c\) )?\d{4}(-\d{4})? the [\w.@/-]+ authors\. all rights reserved\.\s*\W*version:"
    r"|[\w.@/-]+ v\d+(\.\d+)+\s*\W*\(c\) [\w.@/-]+ contributors"
    r"|^\W*[\w.@/-]+ v?\d+(\.\d+)+ - https?://\S+ - [\w.+-]+\s*$",
    re.I | re.M,
)
REASONS = "path string, generated boolean, minified boolean, vendored boolean, data boolean"

_COMMENT = re.compile(r"\s*(//|#|/\*|\*|--|;|<!--|\(\*|%)")
_LITERAL = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[a-zA-Z]{0,3}")
_CSV = re.compile(r"[^(){}=;\"'<>]*(?:,[^(){}=;\"'<>,]*){2,}")


def automaton(notices: list[str], retractions: list[str]):
    a = ahocorasick.Automaton()
    for w in notices:
        a.add_word(w, (1, w))
    for w in retractions:
        a.add_word(w, (-1, w))
    a.make_automaton()
    return a


def header(text: str) -> str:
    """The leading comments and blank lines, however long; a block comment with all its lines."""
    out, end = [], None
    for line in text.splitlines():
        s = line.strip()
        if end:
            out.append(line)
            if end in s:
                end = None
            continue
        if not s or s.startswith("#!") or s in ('"use strict";', "'use strict';", "<?php"):
            out.append(line)
        elif s.startswith("/*"):
            out.append(line)
            end = None if "*/" in s[2:] else "*/"
        elif s.startswith("<!--"):
            out.append(line)
            end = None if "-->" in s else "-->"
        elif s.startswith(('"""', "'''")):
            out.append(line)
            end = None if len(s) > 5 and s.endswith(s[:3]) else s[:3]
        elif s.startswith(("//", "#", "--", ";", "%")) and not s.startswith(("#include", "#define", "#if", "#[", "#!", "#pragma", "#region")):
            out.append(line)
        else:
            break
    return "\n".join(out)


def footer(text: str) -> str:
    """The closing comment lines."""
    out = []
    for line in reversed(text.splitlines()):
        s = line.strip()
        if s and not s.startswith(("//", "#", "--", ";", "%", "/*", "*", "<!--")):
            break
        out.append(line)
    return "\n".join(reversed(out))


def noticed(head: str, machine) -> bool:
    """Whether some line of the header gives notice of generation and no retraction stands beside it."""
    low = head.lower()
    bounds = [m.start() for m in re.finditer("\n", low)]
    found = Counter()
    taken_back = set()
    for end, (kind, _) in machine.iter(low):
        line = bisect.bisect_left(bounds, end)
        if kind > 0:
            found[line] += 1
        else:
            taken_back.add(line)
    return any(n not in taken_back for n in found)


def minified(text: str, path: str) -> bool:
    """Nearly all of the code stands on dense lines: long ones with almost no blanks. One long line in a file
    written by hand leaves the rest of it."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not _COMMENT.match(x)]
    total = sum(map(len, lines))
    if not total:
        return False
    by_name = bool(MINIFIED_PATH.search(path))
    dense = [len(x) for x in lines if len(x) > 30 and sum(map(x.count, " \t")) < (0.12 if by_name else 0.08) * len(x)]
    few = len(lines) - len(dense) <= max(4, 0.5 * len(lines))
    return few and sum(dense) >= (0.7 if by_name else 0.9) * total


_NAME, _NUMBER = re.compile(r"[A-Za-z_]\w*"), re.compile(r"\d+")


def stencilled(text: str) -> bool:
    """Code of few line shapes (names and numbers blotted out) for its length: accessors written out by a tool."""
    lines = [x.strip() for x in text.splitlines() if x.strip() and not _COMMENT.match(x)]
    shapes = Counter(_NUMBER.sub("0", _NAME.sub("a", x)) for x in lines)
    return len(lines) >= 12 and len(shapes) <= 0.4 * len(lines) and sum(n for _, n in shapes.most_common(8)) >= 0.97 * len(lines)


_DECLARES = re.compile(
    r"\s*(?:(?:export|default|pub|async|static|final|override|virtual)\s+)*(?:func|function|def|fn|public|private|protected|internal)\b"
    r"(?!.*\b(?:class|interface|record|enum|struct|namespace)\b)(?!.*;\s*$)")
_COUNTED = re.compile(r"([A-Za-z]\w*?)_?(\d+)[?!]?\s*(?:[(<]|$)")


def serial(text: str) -> bool:
    """Nearly all functions are numbered on in the order they stand in (name000, name001, ...), as only a tool does."""
    numbers, functions = [], 0
    for line in text.splitlines():
        if _DECLARES.match(line):
            functions += 1
            m = _COUNTED.search(line)
            if m:
                numbers.append(int(m.group(2)))
    steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:]))
    return steps >= 7 and steps >= 0.8 * (functions - 1)


def data_share(text: str) -> float:
    """The share of the bytes outside comments that lie on lines of nothing but literals; 0 where more than four other
    lines outnumber a third of those."""
    total = data = count = other = 0
    for line in text.splitlines():
        s = line.strip()
        if not s or _COMMENT.match(line):
            continue
        total += len(s)
        rest = _LITERAL.sub("", s)
        names = re.sub(r"[\s,:\[\]{}()=>;+|&.*?-]", "", rest)
        if len(names) <= 0.04 * len(s) or (len(s) > 200 and len(names) <= 0.1 * len(s)) or (_CSV.fullmatch(s) and (len(s) < 2 or s[-1] not in "({,")):
            data, count = data + len(s), count + 1
        else:
            other += 1
    return data / total if total and other <= max(4, count / 3) else 0.0


_BLANKS = re.compile(r"\s+")


def line_prints(text: str) -> list[int]:
    """Fingerprints of the lines without any blanks; lines of brackets and the like are left out."""
    lines = (_BLANKS.sub("", x) for x in text.splitlines())
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "replace")) for x in lines if len(x) > 8]


class Catalogue:
    """Line fingerprints of the known library files."""

    def __init__(self, contents: list[str], least: float = 0.8):
        self.sizes, self.by_line, self.least = [], {}, least
        for k, text in enumerate(dict.fromkeys(x for x in contents if x)):
            prints = set(line_prints(text))
            self.sizes.append(len(prints))
            for p in prints:
                self.by_line.setdefault(p, []).append(k)

    def copies(self, text: str) -> bool:
        """Whether at least 0.8 of a library file's lines stand in the text, or of the text's in one library file."""
        own = set(line_prints(text))
        hits = Counter(k for p in own for k in self.by_line.get(p, ()))
        return any(n >= 3 and (n >= self.least * self.sizes[k] or n >= self.least * len(own)) for k, n in hits.items())


def others(path: str, head: str) -> bool:
    """Whether a file lies in a directory for others' code and a second sign says that it is a copy: the folder of a
    library below it, with or without version, or a licence in the file's header. Below a part of an application (as
    app/models/vendor) the directory's name is a word of the trade; there only a folder with a version counts."""
    m = OTHERS_PATH.match(path)
    if not m:
        return False
    above, folders = path[: m.start("rest")].rstrip("/").split("/")[:-1], m["rest"].split("/")[:-1]
    if any(VERSION.search(x) for x in folders):
        return True
    if above and above[-1].lower() in LAYOUT:
        return False
    return bool(folders) and folders[0].lower() not in LAYOUT or bool(LICENCE.search(head))


def judge(path: str, text: str, machine, catalogue: Catalogue):
    head = header(text)
    name = path.rsplit("/", 1)[-1].lower()
    generated = noticed(head, machine) or noticed(footer(text), machine) or bool(GENERATED_PATH.search(path)) or name in LOCK_NAMES
    vendored = bool(UPSTREAM.search(head)) or bool(PACKAGE_PATH.search(path)) or others(path, head) or catalogue.copies(text)
    data, dense = data_share(text) >= 0.85, minified(text, path)
    if not (generated or data or dense or vendored):
        generated = stencilled(text) or serial(text)
    return generated, dense, vendored, data


def file_reasons(files: DataFrame, libraries: DataFrame | None, path: str = "path", content: str = "content", notices: list[str] | None = None) -> DataFrame:
    """(path, generated, minified, vendored, data) for every path; a path is what any of its versions is.

    Content is bytes (UTF-8, faults replaced) or text; null and empty content leave only the path's evidence; a
    null path is dropped. libraries has a column content; it is a catalogue whose size is checked (64 MiB).
    An empty table gives an empty result. Only the named columns are read."""
    spark = files.sparkSession
    ship(spark)
    known: list[str] = []
    if libraries is not None:
        size = libraries.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        if size > 64 << 20:
            raise ValueError("the library catalogue exceeds 64 MiB; give its fingerprints a join instead")
        known = sorted(r.content for r in libraries.select("content").where("content is not null").collect())
    shared = spark.sparkContext.broadcast((notices or NOTICES, RETRACTIONS, known))

    def run(frames):
        words, back, contents = shared.value
        machine, catalogue = automaton(words, back), Catalogue(contents)
        for pdf in frames:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"]):
                text = c.decode("utf-8", "replace") if isinstance(c, (bytes, bytearray)) else (c or "")
                rows.append((p, *judge(p, text, machine, catalogue)))
            yield pd.DataFrame(rows, columns=["path", "generated", "minified", "vendored", "data"])

    src = files.select(F.col(path).alias("path"), F.col(content).alias("content")).where("path is not null")
    flags = src.repartition(partitions(spark)).mapInPandas(run, REASONS)
    return flags.groupBy("path").agg(*(F.max(c).alias(c) for c in ("generated", "minified", "vendored", "data")))


def not_hand_written(reasons: DataFrame) -> DataFrame:
    return reasons.where("generated or minified or vendored or data")
