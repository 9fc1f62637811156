"""What pages hold besides running text: their kind, hidden text, links, form fields, attachments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

FEW, SOME, LARGE_SIDE, LARGE_AREA = 50, 150, 150, 40_000
MOST_SNIPPETS, MOST_GROWTH = 512, 4


def visible_chars(text: Column) -> Column:
    """Characters that are neither white space nor control characters."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\p{Cntrl}]", ""))


def page_kind(text: Column, images: Column) -> Column:
    """digital_text, scanned_image or empty; images is an array of (w, h)."""
    n, count = visible_chars(text), F.coalesce(F.size(images), F.lit(0))
    large = F.exists(images, lambda i: ((i["w"] >= LARGE_SIDE) & (i["h"] >= LARGE_SIDE)) | (i["w"] * i["h"] >= LARGE_AREA))
    scanned = (count > 0) & ((n < FEW) | ((n < SOME) & F.coalesce(large, F.lit(False))))
    return F.when(scanned, F.lit("scanned_image")).when((n == 0) & (count <= 0), F.lit("empty")).otherwise(F.lit("digital_text"))


def scan_summary(pages: DataFrame) -> DataFrame:
    """(doc_id, total_pages, scanned_pages, empty_pages, resident_bytes) from pages(doc_id, text, kind)."""
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), count("scanned_image").alias("scanned_pages"), count("empty").alias("empty_pages"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("resident_bytes"))


def marked_hidden(text: str, snippets: list[str]) -> str | None:
    """The text with each hidden snippet marked once where it stands; None if there is nothing to mark or too much."""
    needles = sorted({s.strip() for s in snippets if len(s.strip()) >= 2})
    if not needles or len(needles) > MOST_SNIPPETS:
        return None
    marks = []
    for needle in needles:
        at = text.find(needle)
        while at >= 0:
            marks.append((at, at + len(needle)))
            at = text.find(needle, at + len(needle))
    if not marks:
        return None
    marks.sort(key=lambda m: (m[0], -m[1]))
    out, size, last, limit = [], 0, 0, MOST_GROWTH * len(text.encode())
    for a, b in marks:
        if a < last:
            continue
        part = f'{text[last:a]}[Untrusted Hidden Text: "{text[a:b]}"]'
        out.append(part)
        size += len(part.encode())
        if size > limit:
            return None
        last = b
    return "".join(out) + text[last:]


@F.pandas_udf(StringType())
def annotate_hidden(texts: pd.Series, snippets: pd.Series) -> pd.Series:
    """Pages with hidden text marked, headed by one line of advice; as they are if nothing is hidden."""
    out = []
    for t, s in zip(texts, snippets, strict=True):
        own = [] if s is None else [x for x in s if x]
        if not own:
            out.append(t)
            continue
        out.append("[⚠️ Untrusted Hidden Text Detected]\n" + (marked_hidden(t or "", own) or t or ""))
    return pd.Series(out)


# --- links ------------------------------------------------------------------


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, ord, uri, kind) for each href of pages(page_id, html); kind is external for addresses with a scheme or host, else internal."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))).alias("ord", "uri"))
    rows = rows.withColumn("uri", F.trim("uri")).filter("uri <> ''")
    return rows.withColumn("kind", F.when(F.col("uri").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|//)"), "external").otherwise("internal"))


def html_title(pages: DataFrame) -> DataFrame:
    """(page_id, title, slug): the text of the first heading of level 1 and what it is called in an id."""
    inner = F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.trim(F.regexp_replace(F.regexp_replace(inner, "<[^>]*>", ""), r"\s+", " "))
    return pages.select("page_id", title.alias("title")).withColumn("slug", T.slugify(F.col("title")))


def filter_links(links: DataFrame, kind: str | None = None) -> DataFrame:
    """Links of a kind; anything but external, internal and named stands for all."""
    return links.filter(F.col("kind") == kind) if kind in ("external", "internal", "named") else links


def link_counts(links: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("kind") == kind)
    return links.groupBy("page_id").agg(F.count("*").alias("total_links"), count("external").alias("external_links"), count("internal").alias("internal_links"))


# --- forms ------------------------------------------------------------------


def field_type(kind: Column, flags: Column) -> Column:
    """text, button, radio, checkbox, choice, signature, or the unknown kind itself."""
    return (
        F.when(kind == "Tx", "text")
        .when((kind == "Btn") & (flags.bitwiseAND(1 << 16) != 0), "button")
        .when((kind == "Btn") & (flags.bitwiseAND(1 << 15) != 0), "radio")
        .when(kind == "Btn", "checkbox")
        .when(kind == "Ch", "choice")
        .when(kind == "Sig", "signature")
        .otherwise(kind)
    )


def classify_fields(fields: DataFrame) -> DataFrame:
    """fields(field_id, parent_id, name, kind, flags, value) -> (field_id, fully_qualified_name, field_type, read_only, required, value) for leaves; kind and flags
    that a field lacks are those of the nearest ancestor that has them; the names of ancestors are put before its own. Up to 32 levels."""
    level = fields.filter("parent_id IS NULL").select("field_id", F.coalesce("name", F.lit("")).alias("fq"), "kind", "flags", "value")
    parents = fields.filter("parent_id IS NOT NULL").select("parent_id").distinct()
    out = level
    for _ in range(32):
        up = level.select(F.col("field_id").alias("parent_id"), F.col("fq").alias("up"), F.col("kind").alias("up_kind"), F.col("flags").alias("up_flags"))
        level = fields.join(up, "parent_id").select("field_id", F.when(F.coalesce("name", F.lit("")) == "", F.col("up")).when(F.col("up") == "", F.col("name")).otherwise(F.concat("up", F.lit("."), "name")).alias("fq"), F.coalesce("kind", "up_kind").alias("kind"), F.coalesce("flags", "up_flags").alias("flags"), "value")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    leaves = out.join(parents.withColumnRenamed("parent_id", "field_id"), "field_id", "left_anti")
    flags = F.coalesce("flags", F.lit(0))
    return leaves.select("field_id", F.col("fq").alias("fully_qualified_name"), field_type(F.col("kind"), flags).alias("field_type"), (flags.bitwiseAND(1) != 0).alias("read_only"), (flags.bitwiseAND(2) != 0).alias("required"), "value")


def filter_fields(fields: DataFrame, page: int | None = None, filled_only: bool = False) -> DataFrame:
    if page is not None:
        fields = fields.filter(F.col("page_number") == page)
    return fields.filter("trim(value) <> ''") if filled_only else fields


# --- attachments ------------------------------------------------------------


def dedupe_attachments(attachments: DataFrame) -> DataFrame:
    """One row for each stream of a document: of several the one from the first source (name tree 0, associated files 1, annotations 2), then by ord."""
    order = Window.partitionBy("doc_id", "stream_id").orderBy("source", "ord")
    return attachments.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def find_attachment(attachments: DataFrame, name_or_id: str) -> DataFrame:
    """The first attachment with the file name or id, in any ASCII case."""
    low = name_or_id.lower()
    return attachments.filter((F.lower("filename") == low) | (F.lower("id") == low)).orderBy("ord").limit(1)


def safe_name(filename: Column) -> Column:
    """A bare file name that may be written, else null."""
    name = F.trim(filename)
    return F.when((name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\:\x00]"), name)


def attachment_content(data: Column, is_text: Column, most: int = 524_288, encoding: str | None = None) -> Column:
    """The first bytes of an attachment as text or base64."""
    cut = F.substring(data, 1, most)
    as_text = F.decode(cut, "UTF-8")
    if encoding == "base64":
        return F.base64(cut)
    if encoding == "text":
        return as_text
    return F.when(is_text, as_text).otherwise(F.base64(cut))
