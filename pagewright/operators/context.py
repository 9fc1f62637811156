"""Putting hits together within a token budget: evidence with citations, conceptual context, expanded sections, pages."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def pack_evidence(hits: DataFrame, max_tokens: int = 1500, max_chunks: int = 5, compacted: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, snippet_page, section_id, title, citation, text, estimated_tokens, running_tokens, truncated) for the hits that fit.

    hits(query_id, rank, doc_id, snippet_page, section_id, title, snippet) are taken by rank while their tokens fit; the first always does. truncated
    tells whether one of the first max_chunks hits of the query did not fit.
    """
    text = T.compact(F.col("snippet")) if compacted else F.col("snippet")
    rows = hits.filter(F.col("rank") <= max_chunks).withColumn("text", text).withColumn("estimated_tokens", T.estimate_tokens(F.col("text")))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("running_tokens", F.sum("estimated_tokens").over(order))
    rows = rows.withColumn("kept", (F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) == 1) | (F.col("running_tokens") <= max_tokens))
    rows = rows.withColumn("truncated", F.max(~F.col("kept")).over(Window.partitionBy("query_id")))
    return rows.filter("kept").select("query_id", "rank", "doc_id", "snippet_page", "section_id", "title", T.citation(F.col("doc_id"), F.col("snippet_page"), F.col("section_id")).alias("citation"), "text", "estimated_tokens", "running_tokens", "truncated")


def evidence_markdown(packed: DataFrame) -> DataFrame:
    """(query_id, markdown): the packed evidence as numbered quotations."""
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    item = F.concat(F.lit("**["), number.cast("string"), F.lit("] "), "citation", F.lit("**\n> "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n> ")), F.lit("\n\n"))
    rows = packed.withColumn("item", item)
    each = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.max("running_tokens").alias("tokens"), F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("items"), F.max("truncated").alias("truncated"))
    head = F.concat(F.lit("### Evidencia Recuperada ("), F.col("n").cast("string"), F.lit(" fragmentos, ~"), F.col("tokens").cast("string"), F.lit(" tokens)\n\n"))
    tail = F.when(F.col("truncated"), F.lit("*(Resultados adicionales omitidos para respetar el presupuesto de contexto)*\n")).otherwise(F.lit(""))
    return each.select("query_id", F.concat(head, F.array_join(F.transform("items", lambda x: x["item"]), ""), tail).alias("markdown"))


def tokens_of(text: str) -> int:
    return math.ceil(len(text.encode()) / T.BYTES_PER_TOKEN)


def expanded(head: str, pages: list[tuple[int, str]], max_tokens: int) -> str:
    """A section's head and the pages that fit; a page that does not is cut and ends it."""
    out = head + "### Contenido:\n"
    used = tokens_of(out)
    for page, text in pages:
        own = tokens_of(text)
        if used + own > max_tokens:
            left = int(max(0, max_tokens - used) * T.BYTES_PER_TOKEN)
            return out + f"\n--- [Página {page} (Parcial)] ---\n{text[:left]}\n\n*(Contenido podado por límite de presupuesto de contexto)*\n"
        out += f"\n--- [Página {page}] ---\n{text}"
        used += own
    return out


def section_heads(sections: DataFrame) -> DataFrame:
    """(doc_id, section_id, head, head_without_parent, page_start, page_end) for the first section of each id: title, provenance, parent, children."""
    first = Window.partitionBy("doc_id", "section_id").orderBy("ord")
    one = sections.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    parent = one.select("doc_id", F.col("section_id").alias("parent_id"), F.format_string("*Sección Padre:* **%s** (pp. %d-%d)\n\n", "title", "page_start", "page_end").alias("parent"))
    child = sections.filter("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("section_id"))
    child = child.agg(F.array_sort(F.collect_list(F.struct("ord", F.format_string("- **%s** (pp. %d-%d)\n", "title", "page_start", "page_end").alias("line")))).alias("c"))
    rows = one.join(parent, ["doc_id", "parent_id"], "left").join(child, ["doc_id", "section_id"], "left")
    title = F.format_string("# %s\n\n**Metadatos de Provenance:** Documento: `%s`, Páginas: %d-%d, ID: `%s`\n\n", "title", "doc_id", "page_start", "page_end", "section_id")
    children = F.when(F.col("c").isNotNull(), F.concat(F.lit("### Subsecciones:\n"), F.array_join(F.transform("c", lambda x: x["line"]), ""), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select("doc_id", "section_id", F.concat(title, F.coalesce("parent", F.lit("")), children).alias("head"), F.concat(title, children).alias("head_without_parent"), "page_start", "page_end")


def section_bodies(sections: DataFrame, pages: DataFrame, include_parent: bool = True) -> DataFrame:
    """(doc_id, section_id, head, pages): what expand_sections() needs, a row for each section."""
    heads = section_heads(sections)
    inside = heads.select("doc_id", "section_id", "page_start", "page_end").join(pages.select("doc_id", "page_number", "text"), "doc_id").filter("page_number BETWEEN page_start AND page_end")
    body = inside.groupBy("doc_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text")))).alias("pages"))
    head = F.col("head" if include_parent else "head_without_parent")
    return heads.join(body, ["doc_id", "section_id"], "left").select("doc_id", "section_id", head.alias("head"), F.coalesce("pages", F.array().cast("array<struct<page_number:int,text:string>>")).alias("pages"))


def expand_sections(sections: DataFrame, pages: DataFrame, include_parent: bool = True, max_tokens: int = 1500) -> DataFrame:
    """(doc_id, section_id, text): sections with parent, children and as much of their pages as the budget holds."""

    @F.pandas_udf("string")
    def expand(heads: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([expanded(h, [(p["page_number"], p["text"]) for p in b], max_tokens) for h, b in zip(heads, bodies, strict=True)])

    return section_bodies(sections, pages, include_parent).select("doc_id", "section_id", expand("head", "pages").alias("text"))


def conceptual_context(queries: DataFrame, hits: DataFrame, sections: DataFrame, pages: DataFrame, max_tokens: int = 1500, max_chunks: int = 5, compacted: bool = True) -> DataFrame:
    """(query_id, text): the context of a query's hits; sections are expanded (each once, to at most 600 tokens), pages come as snippets.

    A budget depends on what came before, so the hits of a query (max_chunks of them) are put together in one step.
    """
    bodies = section_bodies(sections, pages)
    rows = hits.filter(F.col("rank") <= max_chunks).withColumn("clean", T.compact(F.col("snippet")) if compacted else F.col("snippet"))
    rows = rows.join(bodies, ["doc_id", "section_id"], "left").join(queries.select("query_id", "query"), "query_id")
    each = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "section_id", "snippet_page", "clean", "head", "pages"))).alias("hits"))

    @F.pandas_udf("string")
    def write(asked: pd.Series, found: pd.Series) -> pd.Series:
        texts = []
        for query, own in zip(asked, found, strict=True):
            out = f"### Contexto Conceptual para: '{query}' (Presupuesto: ~{max_tokens} tokens)\n\n"
            used, seen = tokens_of(out), set()
            for h in own:
                if used >= max_tokens:
                    out += "\n*(Límite de presupuesto de contexto alcanzado)*\n"
                    break
                if h["section_id"] is None:
                    part = f"**[Doc: {h['doc_id']} p. {h['snippet_page']}]** {h['clean']}\n\n"
                    out += part
                    used += tokens_of(part)
                elif (h["doc_id"], h["section_id"]) not in seen:
                    seen.add((h["doc_id"], h["section_id"]))
                    if h["head"] is not None:
                        part = expanded(h["head"], [(p["page_number"], p["text"]) for p in h["pages"]], min(600, max_tokens - used))
                        out += part + "\n---\n\n"
                        used += tokens_of(part)
            texts.append(out)
        return pd.Series(texts)

    return each.select("query_id", write("query", "hits").alias("text"))


def read_pages(pages: DataFrame, page_start: int, page_end: int, max_chars: int = 8000, most_pages: int = 30) -> DataFrame:
    """(doc_id, page_number, text, truncated): a run of pages of each document with their heads, until max_chars bytes are used; the page that exceeds them is cut and ends the run.

    At most most_pages pages are read at once; a longer range ends earlier. pages may have kind and untrusted_text_detected, which show in the heads.
    """
    if page_start < 1 or page_end < page_start:
        raise ValueError(f"pages {page_start} to {page_end} are no range; the first page is 1")
    page_end = min(page_end, page_start + most_pages - 1)
    kind = F.col("kind") if "kind" in pages.columns else F.lit("digital_text")
    hidden = F.col("untrusted_text_detected") if "untrusted_text_detected" in pages.columns else F.lit(False)
    note = F.when(kind == "scanned_image", F.lit(" [📷 Imagen Escaneada / Sin Capa de Texto]")).when(hidden, F.lit(" [⚠️ Untrusted Hidden Text Detected]")).when(kind == "empty", F.lit(" [Página en Blanco]")).otherwise(F.lit(""))
    head = F.concat(F.lit("--- Página "), F.col("page_number").cast("string"), note, F.lit(" ---\n"))
    rows = pages.filter(F.col("page_number").between(page_start, page_end)).select("doc_id", "page_number", head.alias("head"), F.coalesce("text", F.lit("")).alias("body"))
    order = Window.partitionBy("doc_id").orderBy("page_number")
    size = F.octet_length("head") + F.octet_length("body")
    rows = rows.withColumn("size", size).withColumn("used", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("over", F.col("used") > max_chars).withColumn("n_over", F.sum(F.col("over").cast("int")).over(order)).filter("n_over <= 1")
    left = F.greatest(F.lit(0), F.lit(max_chars) - (F.col("used") - F.col("size")) - F.octet_length("head")).cast("int")
    return rows.select("doc_id", "page_number", F.concat("head", F.when(F.col("over"), F.substring(F.col("body"), F.lit(1), left)).otherwise(F.col("body"))).alias("text"), F.col("over").alias("truncated"))
