"""The tools over a collection: listing, outlines, queries, sections, pages, images, extraction. Scopes are checked, and an unknown document is an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context, extract, index, render, retrieve, structure
from ..sources import store


class UnknownDocument(LookupError):
    """No document has the id; the message names some that exist."""


@dataclass
class Collection:
    """Tables of a collection, and indices of what was searched."""

    spark: SparkSession
    doc_meta: DataFrame
    pages: DataFrame
    sections: DataFrame
    links: DataFrame | None = None
    forms: DataFrame | None = None
    attachments: DataFrame | None = None

    def __post_init__(self):
        self.indices = index.IndexCache()

    @classmethod
    def from_store(cls, store) -> Collection:
        return cls(store.spark, *(store.read(t) for t in ("doc_meta", "pages", "sections")), **{t: store.read(t) for t in ("links", "forms", "attachments") if store._there(t)})

    def _known(self, document_id: str) -> str:
        """The id of the document with this id or content hash."""
        own = document_id.strip()
        found = self.doc_meta.filter((F.col("doc_id") == own) | (F.col("content_hash") == own)).select("doc_id").limit(1).collect()
        if not found:
            some = [r["doc_id"] for r in self.doc_meta.select("doc_id").orderBy("doc_id").limit(10).collect()]
            raise UnknownDocument(f"no document {own!r}; there are: {', '.join(some) or 'none'}")
        return found[0]["doc_id"]

    def _scope(self, document_id: str | None) -> str | None:
        """None for all documents (no id or a blank one), else a known id; never more than was asked for."""
        return self._known(document_id) if document_id and document_id.strip() else None

    def _of(self, table: DataFrame, doc: str | None) -> DataFrame:
        return table if doc is None else table.filter(F.col("doc_id") == doc)

    def document_list(self) -> DataFrame:
        return self.doc_meta.orderBy("doc_id")

    def document_info(self, document_id: str) -> DataFrame:
        """The metadata row with a preview of the first 25 sections."""
        doc = self._known(document_id)
        lines = structure.outline(self._of(self.sections, doc), 2).orderBy("ord").limit(25).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("p"))
        return self._of(self.doc_meta, doc).join(lines.select("doc_id", F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("outline_preview")), "doc_id", "left")

    def document_outline(self, document_id: str, max_depth: int = 3) -> DataFrame:
        return structure.outline(self._of(self.sections, self._known(document_id)), max_depth).orderBy("ord")

    def index_of(self, document_id: str | None = None) -> index.Index:
        """The index of a scope; its statistics are those of the scope."""
        doc = self._scope(document_id)
        signature = store.corpus_signature(self._of(self.doc_meta, doc).select("doc_id", "content_hash")).first()["signature"]
        return self.indices.get_or_build(signature, lambda: index.build(self._of(self.pages, doc), self._of(self.sections, doc)))

    def document_query(self, queries: DataFrame, document_id: str | None = None, mode: str = "evidence", max_tokens: int = 1200, max_items: int = 4) -> DataFrame:
        """Answers to queries(query_id, query): as evidence (query_id, markdown), context (query_id, text) or hits; queries without evidence get a row that says so in the first two."""
        if mode not in ("evidence", "context", "hits"):
            raise ValueError(f"mode {mode!r} is none of evidence, context, hits")
        i = self.index_of(document_id)
        hits = retrieve.hybrid_search(queries, i, max_items if mode == "hits" else 2 * max_items)
        if mode == "hits":
            return hits
        none = retrieve.no_evidence_text(retrieve.no_evidence(queries, i)).select("query_id", "text")
        if mode == "evidence":
            out = context.evidence_markdown(context.pack_evidence(hits, max_tokens, max_items)).select("query_id", F.col("markdown").alias("text"))
        else:
            out = context.conceptual_context(queries, hits, self.sections, self.pages, max_tokens, max_items)
        return out.unionByName(none)

    def document_get_section(self, document_id: str, section_id: str, include_parent: bool = True, max_tokens: int = 1500) -> DataFrame:
        doc = self._known(document_id)
        out = context.expand_sections(self._of(self.sections, doc), self._of(self.pages, doc), include_parent, max_tokens).filter(F.col("section_id") == section_id)
        if out.isEmpty():
            raise LookupError(f"document {doc} has no section {section_id!r}; document_outline lists them")
        return out

    def document_read_pages(self, document_id: str, page_start: int, page_end: int, max_chars: int = 8000) -> DataFrame:
        doc = self._known(document_id)
        total = self._of(self.doc_meta, doc).first()["total_pages"]
        if page_start > total:
            raise ValueError(f"page_start {page_start} is beyond the last page, {total}")
        return context.read_pages(self._of(self.pages, doc), page_start, page_end, min(max_chars, 50_000)).orderBy("page_number")

    def document_render_page(self, document_id: str, page_number: int, max_width: int = 1024) -> DataFrame:
        doc = self._known(document_id)
        return render.render_pages(self._of(self.pages, doc).filter(F.col("page_number") == page_number), max_width)

    def document_extract(self, document_id: str, kind: str, page: int | None = None, link_kind: str | None = None, filled_only: bool = False) -> DataFrame:
        doc = self._known(document_id)
        if kind not in ("links", "forms", "attachments"):
            raise ValueError(f"kind {kind!r} is none of links, forms, attachments")
        rows = self._of(getattr(self, kind), doc)
        if kind == "forms":
            return extract.filter_fields(rows, page, filled_only)
        if page is not None:
            rows = rows.filter(F.col("page_number") == page)
        return extract.filter_links(rows, link_kind) if kind == "links" else rows.drop("data")

    def document_read_attachment(self, document_id: str, name_or_id: str, max_bytes: int = 524_288, encoding: str | None = None) -> DataFrame:
        doc = self._known(document_id)
        found = extract.find_attachment(self._of(self.attachments, doc), name_or_id)
        if found.isEmpty():
            raise LookupError(f"document {doc} has no attachment {name_or_id!r}; document_extract lists them")
        return found.select("id", "filename", "size_bytes", extract.attachment_content(F.col("data"), F.col("is_text"), max_bytes, encoding).alias("content"), (F.octet_length("data") > max_bytes).alias("truncated"))
