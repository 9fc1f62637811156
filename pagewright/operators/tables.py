"""Tables in plain text: cells of lines, blocks of tabular lines, Markdown."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

MOST_COLUMNS, LEAST_SHARE, LEAST_CHARACTERS = 8, 0.65, 8


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.posexplode(F.split("text", "\r?\n")).alias("line", "content"))


def table_cells(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, cells) for each line with 2 to 8 cells that isn't a rule."""
    rows = lines(docs, key).withColumn("cells", T.cells(F.col("content")))
    return rows.filter(F.size("cells").between(2, MOST_COLUMNS) & ~T.is_separator_line(F.col("content"))).select(key, "line", "cells")


def table_blocks(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, first_line, n_rows, n_columns) for each table in a run of tabular lines: from the first line on from which the rest of the run has two rows or more,
    most of them with the same number of cells. Lines before it are no table."""
    rows = lines(docs, key).withColumn("cells", T.cells(F.col("content"))).withColumn("rule", T.is_separator_line(F.col("content")))
    rows = rows.withColumn("tabular", ~F.col("rule") & F.size("cells").between(2, MOST_COLUMNS))
    breaks = F.sum((~F.col("tabular") & ~F.col("rule")).cast("int")).over(Window.partitionBy(key).orderBy("line"))
    runs = rows.withColumn("run", breaks).filter("tabular").withColumn("size", F.size("cells")).withColumn("chars", F.length(F.array_join("cells", "")))
    run = Window.partitionBy(key, "run")
    rest = run.orderBy(F.col("line").desc())  # a line and all below it
    mode = F.greatest(*(F.struct(F.sum((F.col("size") == n).cast("long")).over(rest).alias("n"), F.lit(n).alias("size")) for n in range(2, MOST_COLUMNS + 1)))
    each = runs.select(key, "run", "line", mode.alias("mode"), F.count("*").over(rest).alias("n_rows"), F.sum("chars").over(rest).alias("chars"))
    good = each.filter((F.col("n_rows") >= 2) & (F.col("mode.n") / F.col("n_rows") >= LEAST_SHARE) & (F.col("chars") >= LEAST_CHARACTERS))
    first = good.withColumn("first_line", F.min("line").over(run)).filter("line = first_line")
    return first.select(key, "first_line", "n_rows", F.col("mode.size").alias("n_columns"))


# --- the same by rows in order, with Markdown -------------------------------


def cells_of(line: str) -> list[str]:
    t = line.strip()
    if not t:
        return []
    if t.startswith("|") and t.endswith("|") and t.count("|") >= 3:
        return [c.strip() for c in t.strip("|").split("|")]
    tabs = [c for c in (x.strip() for x in t.split("\t")) if c]
    if "\t" in t and len(tabs) >= 2:
        return tabs
    import re

    return [c for c in (x.strip() for x in re.split(" {2,}", t)) if c]


def is_rule(line: str) -> bool:
    return "-" in line and all(c in "-|+:=" or c.isspace() for c in line)


def is_table(rows: list[list[str]]) -> bool:
    if len(rows) < 2 or not all(2 <= len(r) <= MOST_COLUMNS for r in rows):
        return False
    return max(Counter(map(len, rows)).values()) / len(rows) >= LEAST_SHARE and sum(len(c) for r in rows for c in r) >= LEAST_CHARACTERS


def markdown_table(headers: list[str], rows: list[list[str]], alignments: list[str] = ()) -> str:
    """A Markdown table; alignments are left, center or right."""
    width = max([len(headers), *map(len, rows)])
    if not width:
        return ""
    clean = lambda c: c.strip().replace("\r", " ").replace("\n", " ").replace("|", "\\|")
    line = lambda cells: "|" + "".join(f" {clean(cells[i]) if i < len(cells) else ''} |" for i in range(width))
    rule = {"left": "---|", "center": ":---:|", "right": "---:|"}
    ruled = "|" + "".join(rule[alignments[i] if i < len(alignments) else "left"] for i in range(width))
    return "\n".join([line(headers), ruled, *map(line, rows)]).rstrip()


def with_markdown_tables(text: str) -> str:
    """The text with each run of tabular lines that makes a table written as Markdown."""
    rows, out, at = text.splitlines(), [], 0
    while at < len(rows):
        first = cells_of(rows[at])
        if 2 <= len(first) <= MOST_COLUMNS and not is_rule(rows[at]):
            table, n = [first], 1
            while at + n < len(rows):
                if is_rule(rows[at + n]):
                    n += 1
                    continue
                own = cells_of(rows[at + n])
                if not 2 <= len(own) <= MOST_COLUMNS:
                    break
                table.append(own)
                n += 1
            if is_table(table):
                out.append(markdown_table(table[0], table[1:]))
                at += n
                continue
        out.append(rows[at])
        at += 1
    return "\n".join(out)


@F.pandas_udf(StringType())
def _reconstruct(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: with_markdown_tables(t) if t else t)


def reconstruct_tables(text: Column) -> Column:
    """The text with Markdown tables, where it can hold one at all (two spaces, a tab or a pipe)."""
    return F.when(text.contains("  ") | text.contains("\t") | text.contains("|"), _reconstruct(text)).otherwise(text)
