"""Results as text: JSON lines and tables in Markdown, and the agents' contexts put together from them.

Rendering is a projection of rows to lines, so it is as distributed as what it renders; only the heading lines are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as a JSON object in the order of the columns; null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def row_line(*columns) -> Column:
    """Columns as a line of a Markdown table: bars escaped, line ends as blanks, null as nothing."""
    cells = []
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for what, instead in (("|", "\\|"), ("\r", ""), ("\n", " ")):
            text = F.replace(text, F.lit(what), F.lit(instead))
        cells.append(text)
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def table_rows(df: DataFrame) -> DataFrame:
    """Each row as a line of a Markdown table."""
    return df.select(row_line(*[f"`{c}`" for c in df.columns]).alias("line"))


def table_text(df: DataFrame, title: str = "", most: int = 200) -> str:
    """A Markdown table of at most `most` rows, for a reader or a prompt; says how many more there are."""
    rows = [r.line for r in table_rows(df).limit(most + 1).collect()]
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    more = [f"... more than {most} rows"] if len(rows) > most else []
    return "\n".join(([f"## {title}", ""] if title else []) + head + rows[:most] + more) + "\n"


def context_text(title: str, parts: dict[str, DataFrame], most: int = 50) -> str:
    """An agent's context: a title and one table per part, empty parts left out."""
    out = [f"# {title}\n"]
    for name, df in parts.items():
        text = table_text(df, name, most)
        if text.count("\n") > 4:
            out.append(text)
    return "\n".join(out)
