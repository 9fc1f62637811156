"""Sections: headings found in text, outlines, page ranges, page look-ups by title."""

from __future__ import annotations

import itertools
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line, level, title) for each line of pages(doc_id, page_number, text) that reads like a heading."""
    lines = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\r?\n")).alias("line", "content"))
    return lines.withColumn("h", T.heading(F.col("content"))).filter("h IS NOT NULL").select("doc_id", "page_number", "line", "h.level", "h.title")


def infer_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, ord, section_id, title, level, page_start, page_end, parent_id, content_preview) from the headings of each document.

    Level 1 has no parent, level 2 belongs to the last heading of level 1, deeper ones to the last of level 2 if it came after the last of level 1, else to
    that one. A document without headings is one section.
    """
    order = Window.partitionBy("doc_id").orderBy("page_number", "line")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = headings(pages).withColumn("ord", F.row_number().over(order) - 1).withColumn("section_id", F.concat(T.slugify(F.col("title")), F.lit("-p"), F.col("page_number").cast("string")))
    last = lambda level: F.last(F.when(F.col("level") == level, F.struct("ord", "section_id")), True).over(upto)
    rows = rows.withColumn("h1", last(1)).withColumn("h2", last(2))
    under = F.when(F.col("h2").isNotNull() & (F.col("h1").isNull() | (F.col("h2.ord") > F.col("h1.ord"))), F.col("h2.section_id")).otherwise(F.col("h1.section_id"))
    parent = F.when(F.col("level") == 1, F.lit(None).cast("string")).when(F.col("level") == 2, F.col("h1.section_id")).otherwise(under)
    found = rows.select("doc_id", F.col("ord").cast("int").alias("ord"), "section_id", "title", "level", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), parent.alias("parent_id"), F.lit("").alias("content_preview"))
    rest = pages.join(found.select("doc_id").distinct(), "doc_id", "left_anti").groupBy("doc_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.min_by("text", "page_number").alias("text"))
    whole = rest.select("doc_id", F.lit(0).alias("ord"), F.lit("full-document").alias("section_id"), F.lit("Document Content").alias("title"), F.lit(1).alias("level"), "page_start", "page_end", F.lit(None).cast("string").alias("parent_id"), F.coalesce(F.split("text", "\r?\n")[0], F.lit("")).alias("content_preview"))
    return found.unionByName(whole)


def fallback_outline(native: DataFrame, pages: DataFrame) -> DataFrame:
    """The native sections of documents that have some, and inferred ones for the others."""
    rest = pages.join(native.select("doc_id").distinct(), "doc_id", "left_anti")
    return native.unionByName(infer_sections(rest), allowMissingColumns=True)


def page_ends(sections: DataFrame, totals: DataFrame, depth: int = 32) -> DataFrame:
    """sections(doc_id, ord, section_id, parent_ord, page_start) with page_end; totals(doc_id, total_pages) bounds the last ones.

    A bound goes down: the next sibling's start, else the parent's bound. A leaf ends before its next sibling, else at its bound; a parent ends where its
    last child does; none ends before it begins. Levels are worked off one by one, down and up.
    """
    sibling = Window.partitionBy("doc_id", "parent_ord").orderBy("ord")
    rows = sections.withColumn("next_start", F.lead("page_start").over(sibling)).withColumn("is_last", F.row_number().over(Window.partitionBy("doc_id", "parent_ord").orderBy(F.col("ord").desc())) == 1)
    level = rows.filter("parent_ord IS NULL").join(totals, "doc_id").withColumn("parent_bound", F.col("total_pages")).drop("total_pages")
    level = level.withColumn("bound", F.coalesce("next_start", "parent_bound"))
    levels = [level]
    for _ in range(depth):
        up = levels[-1].select("doc_id", F.col("ord").alias("parent_ord"), F.col("bound").alias("parent_bound"))
        down = rows.join(up, ["doc_id", "parent_ord"]).withColumn("bound", F.coalesce("next_start", "parent_bound")).select(level.columns)
        if down.isEmpty():
            break
        levels.append(down)
    own = F.greatest("page_start", F.coalesce(F.col("next_start") - 1, "parent_bound"))
    done = levels[-1].withColumn("page_end", own)
    out = done
    for level in reversed(levels[:-1]):
        last = done.filter("is_last").select("doc_id", F.col("parent_ord").alias("ord"), F.col("page_end").alias("child_end"))
        done = level.join(last, ["doc_id", "ord"], "left").withColumn("page_end", F.when(F.col("child_end").isNotNull(), F.greatest("page_start", "child_end")).otherwise(own)).drop("child_end")
        out = out.unionByName(done)
    return out.select(*sections.columns, "page_end")


def leaf_page_ends(sections: DataFrame, totals: DataFrame) -> DataFrame:
    """page_end for sections without children: before the next one of the document begins, the last at its end."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    rows = sections.join(totals, "doc_id").withColumn("next", F.lead("page_start").over(order))
    return rows.withColumn("page_end", F.greatest("page_start", F.coalesce(F.col("next") - 1, "total_pages"))).drop("next", "total_pages")


def title_pages(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, ord, page): the first page from the section's own on whose text has its title, in any case; titles have more than 3 bytes."""
    wanted = sections.filter(F.octet_length("title") > 3).select("doc_id", "ord", F.lower("title").alias("title"), "page_start")
    both = wanted.join(pages.select("doc_id", "page_number", F.lower("text").alias("text")), "doc_id").filter((F.col("page_number") >= F.col("page_start")) & F.contains("text", "title"))
    return both.groupBy("doc_id", "ord").agg(F.min("page_number").alias("page"))


def repaired(sections: list[tuple[str, int]], texts: dict[int, str]) -> list[tuple[int, bool, str]]:
    """(page, found, preview) for the (title, page_start) of a document's sections in order: those that claim page 1 or none are looked up by title, from the
    last page reached on; the preview is the first 160 characters of the page without control characters."""
    numbers, lower, last, out = sorted(texts), {n: t.lower() for n, t in texts.items()}, 1, []
    for title, page in sections:
        wanted = title.strip().lower()
        found = next((n for n in numbers if n >= last and wanted in lower[n]), None) if page <= 1 and len(title.strip().encode()) > 3 else None
        page = page if found is None else found
        last = max(last, page)
        shown = itertools.islice((c for c in texts.get(page, "") if unicodedata.category(c) != "Cc"), 160)
        out.append((page, found is not None, "".join(shown).strip()))
    return out


def reconcile(sections: DataFrame, pages: DataFrame) -> DataFrame:
    """sections(doc_id, ord, title, page_start, content_preview, ...) with pages and previews as repaired() gives them. Which page was reached depends on all
    earlier sections, so the sections of a document are walked in order."""
    texts = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    rows = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "title", "page_start"))).alias("s")).join(texts, "doc_id")

    @F.pandas_udf("array<struct<ord:int,page:int,preview:string>>")
    def walk(s: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for own, found in zip(s, p, strict=True):
            got = repaired([(x["title"], int(x["page_start"])) for x in own], {x["page_number"]: x["text"] for x in found})
            out.append([{"ord": int(x["ord"]), "page": page, "preview": preview} for x, (page, _, preview) in zip(own, got, strict=True)])
        return pd.Series(out)

    each = rows.select("doc_id", F.explode(walk("s", "p")).alias("r")).select("doc_id", "r.*")
    return sections.drop("content_preview").join(each, ["doc_id", "ord"]).withColumn("page_start", F.col("page")).withColumn("content_preview", F.col("preview")).drop("page", "preview")


def outline(sections: DataFrame, max_depth: int = 3) -> DataFrame:
    """(doc_id, ord, depth, line) for the sections down to max_depth, walked from the roots."""
    rows = sections.select("doc_id", "ord", "section_id", "title", "level", "page_start", "page_end", "parent_id")
    level = rows.filter("parent_id IS NULL").withColumn("depth", F.lit(1))
    out = level
    for d in range(2, max_depth + 1):
        up = level.select("doc_id", F.col("section_id").alias("parent_id"), F.col("ord").alias("up"))
        # ids can repeat: the nearest earlier section with the id is the parent
        near = rows.join(up, ["doc_id", "parent_id"]).filter("up < ord").groupBy(*rows.columns).agg(F.max("up").alias("up")).drop("up")
        level = near.withColumn("depth", F.lit(d))
        out = out.unionByName(level)
    return out.select("doc_id", "ord", "depth", T.outline_line(F.col("depth"), F.col("title"), F.col("page_start"), F.col("page_end")).alias("line"))


def section_counts(sections: DataFrame) -> DataFrame:
    return sections.groupBy("doc_id").agg(F.count("*").alias("total_sections"))
