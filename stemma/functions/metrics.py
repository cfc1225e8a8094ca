"""Metrics of source text as Columns: branch complexity, lines by kind, markers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords and operators that branch, per language.
BRANCHES = {
    "go": "if else case for range && || go select",
    "python": "if elif else for while except and or with",
    "typescript": "if else case for while do catch && || ??",
    "javascript": "if else case for while do catch && || ??",
    "java": "if else case for while do catch && ||",
}


def word_count(text: Column, word: str) -> Column:
    """Occurrences of an ASCII word (accented letters end a word, as in RE2) or of an operator."""
    if word[0].isalpha():
        return F.regexp_count(text, F.lit(f"(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])"))
    return F.regexp_count(text, F.lit("".join("\\" + c for c in word)))


def complexity(text: Column, language: Column) -> Column:
    """1 plus all branching words; 1 for other languages."""
    out = F.lit(1)
    for lang, words in BRANCHES.items():
        total = reduce(lambda a, b: a + b, [word_count(text, w) for w in words.split()], F.lit(1))
        out = F.when(F.lower(language) == lang, total).otherwise(out)
    return F.coalesce(out, F.lit(1))


def markers(text: Column, words: tuple = ("TODO", "FIXME", "HACK")) -> list[Column]:
    return [F.regexp_count(text, F.lit(f"(?i)(?<![A-Za-z0-9_]){w}(?![A-Za-z0-9_])")).alias(w.lower() + "_count") for w in words]


def lines_of_code(text: Column, language: Column) -> Column:
    """struct(total, blank, comment, code): a fold over the lines that carries whether a block comment is open."""
    lang = F.lower(language)
    c_like = lang.isin("go", "java", "typescript", "javascript")
    lines = F.split(text, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    zero = F.struct(F.lit(False).alias("open"), F.lit(0).alias("blank"), F.lit(0).alias("comment"))

    def step(acc, line):
        t = F.trim(F.regexp_replace(line, r"[\t\r\f\x0b]", " "))
        starts = F.when(lang == "python", t.startswith('"""') | t.startswith("'''")).when(lang == "html", t.startswith("<!--")).otherwise(t.startswith("/*"))
        ends_inside = F.when(lang == "python", t.endswith('"""') | t.endswith("'''")).when(lang == "html", t.contains("-->")).otherwise(t.contains("*/"))
        ends_same = F.when(lang == "python", (t.endswith('"""') | t.endswith("'''")) & (F.length(t) > 3)).when(lang == "html", t.endswith("-->")).otherwise(t.endswith("*/"))
        one = F.when(c_like, t.startswith("//")).when(lang == "python", t.startswith("#")).when(lang == "html", F.lit(False)).otherwise(t.startswith("//") | t.startswith("#"))
        blank = t == ""
        comment = ~blank & (acc["open"] | starts | one)
        open_ = F.when(blank, acc["open"]).when(acc["open"], ~ends_inside).when(starts, ~ends_same).otherwise(False)
        return F.struct(open_.alias("open"), (acc["blank"] + blank.cast("int")).alias("blank"), (acc["comment"] + comment.cast("int")).alias("comment"))

    return F.aggregate(
        lines, zero, step,
        lambda a: F.struct(F.size(lines).alias("total"), a["blank"].alias("blank"), a["comment"].alias("comment"), (F.size(lines) - a["blank"] - a["comment"]).alias("code")),
    )


#: Calculators by name: (text, language) -> {metric: column}. Further ones are added by register_calculator.
CALCULATORS: dict = {
    "complexity": lambda text, language: {"cyclomatic_complexity": complexity(text, language)},
    "lines": lambda text, language: (lambda m: {"lines_of_code": m["total"], "blank_lines": m["blank"], "comment_lines": m["comment"], "code_lines": m["code"]})(lines_of_code(text, language)),
    "markers": lambda text, language: dict(zip(("todo_count", "fixme_count", "hack_count"), markers(text))),
}


def register_calculator(name: str, calculate) -> None:
    CALCULATORS[name] = calculate


def all_metrics(text: Column, language: Column, calculators: list[str] | None = None) -> Column:
    """One map of all of a file's metrics, or of some calculators'."""
    pairs = [(k, c) for name in calculators or CALCULATORS for k, c in CALCULATORS[name](text, language).items()]
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[c.cast("double") for _, c in pairs]))
