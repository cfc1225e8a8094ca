"""File sources: directory scans with ignore rules, file classes, dispatch to parsers, previews and change detection
(S10, S11, S16, S23, F11-F13, X07, X14-X16, U04)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as X

# Document and image suffixes, mime types by suffix.
DOCUMENTS = [".docx", ".pptx", ".xlsx", ".odt", ".ods", ".odp", ".pdf"]
IMAGES = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".tif"]
MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json", ".xml": "application/xml", ".yaml": "application/yaml", ".yml": "application/yaml",
    ".html": "text/html", ".svg": "image/svg+xml", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".webp": "image/webp", ".bmp": "image/bmp", ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", ".odt": "application/vnd.oasis.opendocument.text", ".ods": "application/vnd.oasis.opendocument.spreadsheet", ".odp": "application/vnd.oasis.opendocument.presentation",
}


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modification_time, length, content) of all files below a directory."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("modificationTime").alias("modification_time"), "length", "content")


# ---- Ignore rules ----------------------------------------------------------------------------------------------


def _part(pattern: str) -> str:
    """One path component of a shell pattern as a regex."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            out += "[" + ("^" if body[0] in "^!" else "") + re.sub(r"([\\\[])", r"\\\1", body.lstrip("^!")) + "]"
            i = j
        else:
            out += re.escape(c)
        i += 1
    return out


def ignore_rules(lines: list[str], base: str = "") -> list[tuple[str, bool]]:
    """(regex over the whole path, negated) per rule, in order. A pattern with a slash is relative to base, '**' stands
    for any number of directories; others match any component below base. Blank lines and comments are no rules."""
    rules, root = [], re.escape(base.rstrip("/") + "/") if base else ""
    for line in lines:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[1:] if negated else p
        p = p.removesuffix("/")
        if "/" in p:
            parts = [x for x in p.split("/") if x]
            r = ""
            for k, x in enumerate(parts):
                last = k == len(parts) - 1
                if x == "**":
                    r += ".*" if last else "(?:[^/]+/)*"
                else:
                    r += _part(x) + ("" if last else "/")
            if parts and parts[-1] == "**" and len(parts) > 1:
                r = r.removesuffix("/.*") + "(?:/.*)?" if r.endswith("/.*") else r
            rules.append((f"^{root}{'/?' if not base else ''}{r}$", negated))
        else:
            rules.append((f"^{root}(?:.*/)?{_part(p)}(?:/.*)?$", negated))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that matches ignores the path."""
    out = F.lit(False)
    for regex, negated in rules:
        out = F.when(path.rlike(regex), not negated).otherwise(out)
    return out


# ---- Classes, dispatch, previews ----------------------------------------------------------------------------------


def file_class(path: Column, excluded: tuple = ()) -> Column:
    """skip (excluded suffixes, also compound ones like .min.js), document, image or text."""
    base, ext = F.lower(X.base_name(path)), X.extension(path)
    out = F.when(ext.isin(DOCUMENTS), "document").when(ext.isin(IMAGES), "image").otherwise("text")
    for e in excluded:
        out = F.when(base.endswith(e), "skip").otherwise(out)
    return out


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512: in hexadecimal, a 00 at an even place."""
    return F.coalesce(F.hex(F.substring(content, 1, 512)).rlike("^(?:[0-9A-F]{2})*?00"), F.lit(False))


def mime_type(path: Column) -> Column:
    return X._lookup(X.extension(path), MIME, "application/octet-stream")


def dispatch(files: DataFrame, by_suffix: dict[str, str], by_name: dict[str, str], fallback: str) -> DataFrame:
    """files with the name of the parser that takes them: by file name, by suffix, else the fallback."""
    name, ext = X.base_name(F.col("path")), X.extension(F.col("path"))
    return files.withColumn("parser", F.coalesce(*[F.when(name == k, v) for k, v in by_name.items()], *[F.when(ext == k, v) for k, v in by_suffix.items()], F.lit(fallback)))


def csv_preview(text: Column, rows: int = 5) -> Column:
    """Header line and the first rows, '...' where there are more."""
    lines = F.split(text, "\n")
    head = F.concat(F.lit("CSV headers: "), F.trim(F.element_at(lines, 1)))
    sample = F.concat(F.lit("\nSample rows:\n"), F.array_join(F.transform(F.slice(lines, 2, rows), lambda x: F.concat(F.trim(x), F.lit("\n"))), ""))
    return F.when(F.size(lines) > 1, F.concat(head, sample, F.when(F.size(lines) > rows + 1, "...\n").otherwise(""))).otherwise(head)


def changed_files(scan_rows: DataFrame, state: DataFrame) -> DataFrame:
    """(path, change): files newer than their state row(path, modification_time), new ones, and ones that are gone."""
    s = state.select("path", F.col("modification_time").alias("seen"))
    both = scan_rows.select("path", "modification_time").join(s, "path", "full_outer")
    change = F.when(F.col("seen").isNull(), "added").when(F.col("modification_time").isNull(), "deleted").when(F.col("modification_time") > F.col("seen"), "modified")
    return both.select("path", change.alias("change")).where("change is not null")
