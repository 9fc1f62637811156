"""Reading order of text fragments on a page: fragments(doc_id, page, ord, x, y, width, height, text)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc_id", "page"]
FURTHEST = 14_400.0
BIN, GUTTER = 2.0, 12.0
NARROW, LEAST_WIDTH, LEAST_FRAGMENTS, LEAST_CHARACTERS, LEAST_SIDE = 0.55, 140.0, 4, 15, 0.15
INTERIOR = (0.18, 0.82)
SAME_LINE = 3.5


def fragment_width(text: Column, size: Column) -> Column:
    """The width of a text in a proportional font, at least 2."""
    factor = lambda c: (
        F.when(c == "", 0.0)
        .when(c == " ", 0.25)
        .when(c.isin(*".,:;!?'\"|"), 0.22)
        .when(c.isin(*"iljtIf"), 0.28)
        .when(c.isin("r", "s"), 0.38)
        .when(c.isin(*"mwMW"), 0.72)
        .when(c.between("A", "Z"), 0.60)
        .otherwise(0.48)
    )
    return F.greatest(F.lit(2.0), F.aggregate(F.split(text, ""), F.lit(0.0), lambda s, c: s + factor(c)) * size)


def extents(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, x_min, x_max) over fragments with places that a page can have."""
    end = F.col("x") + F.col("width")
    fine = ~F.isnan("x") & ~F.isnan(end) & (F.least("x", end) >= -FURTHEST) & (F.greatest("x", end) <= FURTHEST)
    return fragments.filter(fine).groupBy(*PAGE).agg(F.min("x").alias("x_min"), F.max(end).alias("x_max"))


def gutters(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, split_x): the middle of each empty band between columns, with enough text on both sides."""
    counts = fragments.groupBy(*PAGE).agg(F.count("*").alias("n"))
    rows = fragments.join(extents(fragments), PAGE).join(counts, PAGE).filter(f"n >= {LEAST_FRAGMENTS} AND x_max - x_min >= {LEAST_WIDTH}")
    rows = rows.filter(F.col("width") <= (F.col("x_max") - F.col("x_min")) * NARROW).withColumn("chars", F.length("text"))
    page = Window.partitionBy(*PAGE)
    rows = rows.withColumn("m", F.count("*").over(page)).withColumn("total", F.sum("chars").over(page)).filter(f"m >= {LEAST_FRAGMENTS} AND total >= {LEAST_CHARACTERS}")
    bins = F.greatest(F.lit(1), F.ceil((F.col("x_max") - F.col("x_min")) / BIN)).cast("int")
    rows = rows.withColumn("bins", bins).withColumn("a", F.greatest(F.lit(0), F.floor((F.col("x") - F.col("x_min")) / BIN)).cast("int"))
    rows = rows.withColumn("b", F.least("bins", F.ceil((F.col("x") + F.col("width") - F.col("x_min")) / BIN)).cast("int"))
    taken = rows.filter("a < b").select(*PAGE, F.explode(F.expr("sequence(a, b - 1)")).alias("bin")).distinct()
    pages = rows.select(*PAGE, "bins", "x_min", "total").distinct()
    first, last = F.floor(F.col("bins") * INTERIOR[0]).cast("int"), F.ceil(F.col("bins") * INTERIOR[1]).cast("int")
    inside = pages.select(*PAGE, "x_min", "total", F.explode(F.sequence(first, last - 1)).alias("bin"))
    empty = inside.join(taken, [*PAGE, "bin"], "left_anti")
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("bin"))
    bands = empty.withColumn("island", island).groupBy(*PAGE, "x_min", "total", "island").agg(F.min("bin").alias("p"), (F.max("bin") + 1).alias("q"))
    bands = bands.filter(F.col("q") - F.col("p") >= math.ceil(GUTTER / BIN)).withColumn("split_x", F.col("x_min") + (F.col("p") + F.col("q")) * BIN / 2)
    sides = bands.join(rows.select(*PAGE, "x", "width", "chars"), PAGE).groupBy(*PAGE, "split_x", "total")
    sides = sides.agg(F.sum(F.when(F.col("x") + F.col("width") <= F.col("split_x"), F.col("chars")).otherwise(0)).alias("l"), F.sum(F.when(F.col("x") >= F.col("split_x"), F.col("chars")).otherwise(0)).alias("r"))
    return sides.filter((F.col("l") / F.col("total") >= LEAST_SIDE) & (F.col("r") / F.col("total") >= LEAST_SIDE)).select(*PAGE, "split_x")


def with_columns(fragments: DataFrame) -> DataFrame:
    """fragments with part (0: spanning head, 1: columns, 2: spanning foot) and the number of the column."""
    splits = gutters(fragments).groupBy(*PAGE).agg(F.sort_array(F.collect_set("split_x")).alias("splits"))
    rows = fragments.join(extents(fragments), PAGE, "left").join(splits, PAGE, "left")
    wide = F.col("width") > F.greatest(F.lit(1.0), F.coalesce(F.col("x_max") - F.col("x_min"), F.lit(FURTHEST))) * NARROW
    page = Window.partitionBy(*PAGE)
    top = F.max(F.when(~wide, F.col("y") + F.col("height"))).over(page)
    low = F.min(F.when(~wide, F.col("y"))).over(page)
    part = F.when(F.col("splits").isNull() | ~wide, 1).when(F.col("y") >= top - 5, 0).when(F.col("y") <= low + 5, 2).otherwise(1)
    rows = rows.withColumn("part", part)
    column = F.when((F.col("part") == 1) & F.col("splits").isNotNull(), F.size(F.filter("splits", lambda s: F.col("x") >= s))).otherwise(F.lit(0))
    return rows.withColumn("column", column).drop("x_min", "x_max")


def lines_of(fragments: list[dict]) -> list[dict]:
    """Lines from top to bottom: a fragment joins the first line whose first fragment stands within 3.5 points of it."""
    rows: list[list[dict]] = []
    for f in sorted(fragments, key=lambda f: (-f["y"], f["x"])):
        own = next((r for r in rows if abs(r[0]["y"] - f["y"]) <= SAME_LINE), None)
        if own is None:
            rows.append([f])
        else:
            own.append(f)
    out = []
    for row in rows:
        row.sort(key=lambda f: f["x"])
        text = row[0]["text"]
        for before, f in zip(row, row[1:], strict=False):
            gap = f["x"] - (before["x"] + before["width"])
            if gap >= max(f["height"] * 0.2, 2.4) and not text.endswith((" ", "-")) and not f["text"].startswith(" "):
                text += " "
            text += f["text"]
        out.append({"y": min(f["y"] for f in row), "text": text})
    return sorted(out, key=lambda r: -r["y"])


def page_text(parts: list[tuple[int, int, list[dict]]], n_columns: int) -> str:
    """The text of a page from its parts: spanning heads, columns from left to right, spanning feet."""
    if n_columns == 1:
        return "\n".join(r["text"] for _, _, f in parts for r in lines_of(f))
    out = ""
    for part, column, fragments in sorted(parts, key=lambda p: p[:2]):
        if part == 2 and not out.endswith("\n\n"):
            out += "\n"
        out += "".join(r["text"] + "\n" for r in lines_of(fragments))
        if (part == 0 or part == 1 and column + 1 < n_columns) and not out.endswith("\n\n"):
            out += "\n"
    return out.strip()


def reading_order(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, n_columns, text): the text of each page in reading order."""
    rows = with_columns(fragments)

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        splits = pdf["splits"].iloc[0]
        n = 1 if splits is None else len(splits) + 1
        parts = [(int(p), int(c), g.to_dict("records")) for (p, c), g in pdf.groupby(["part", "column"], sort=True)]
        return pd.DataFrame([[*key, n, page_text(parts, n)]], columns=[*PAGE, "n_columns", "text"])

    kinds = dict(fragments.dtypes)
    return rows.groupBy(*PAGE).applyInPandas(write, f"doc_id {kinds['doc_id']}, page {kinds['page']}, n_columns int, text string")


def fragment_lines(fragments: DataFrame) -> DataFrame:
    """(doc_id, page, line, text): lines of pages read as one column."""

    def write(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = lines_of(pdf.to_dict("records"))
        return pd.DataFrame([[*key, i, r["text"]] for i, r in enumerate(rows)], columns=[*PAGE, "line", "text"])

    kinds = dict(fragments.dtypes)
    return fragments.groupBy(*PAGE).applyInPandas(write, f"doc_id {kinds['doc_id']}, page {kinds['page']}, line int, text string")
