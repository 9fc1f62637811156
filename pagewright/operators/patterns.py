"""Design-pattern catalogues: the parts of a pattern's section, comparison of two patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Words that begin the parts of a pattern, and what the parts are called.
CLAUSES = {
    "intent": "Intent",
    "propósito": "Intent",
    "motivation": "Motivation",
    "motivación": "Motivation",
    "applicability": "Applicability",
    "aplicabilidad": "Applicability",
    "structure": "Structure",
    "estructura": "Structure",
    "participants": "Participants",
    "participantes": "Participants",
    "collaborations": "Collaborations",
    "colaboraciones": "Collaborations",
    "consequences": "Consequences",
    "consecuencias": "Consequences",
    "implementation": "Implementation",
    "implementación": "Implementation",
    "sample code": "Sample Code",
    "código de ejemplo": "Sample Code",
    "related patterns": "Related Patterns",
    "patrones relacionados": "Related Patterns",
}
PARTS = ["Intent", "Motivation", "Applicability", "Structure", "Participants", "Consequences", "Sample Code"]
TITLE_WORDS = ["pattern", "patrón", "patrones"]
SECTION_WORDS = ["creational", "creacionales", "structural", "estructurales", "behavioral", "comportamiento"]


def applicable(doc_meta: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id) of documents that are about patterns: by their title or a top section's."""
    has = lambda column, words: F.lower(column).rlike("|".join(words))
    by_section = sections.filter(F.col("parent_id").isNull() & has("title", SECTION_WORDS)).select("doc_id")
    return doc_meta.filter(has("title", TITLE_WORDS)).select("doc_id").union(by_section).distinct()


def clause_of(line: str) -> str | None:
    low = line.strip().lower()
    return next((part for word, part in CLAUSES.items() if low == word or (low.startswith(word) and len(line.strip().encode()) < 40)), None)


def text_parts(text: str) -> dict[str, str]:
    """The labelled blocks of a text; the first of each kind, related patterns from all of them."""
    out: dict[str, str] = {}
    now, lines = None, []

    def done():
        clean = "\n".join(lines).strip()
        if now and clean:
            out[now] = out[now] + "\n" + clean if now == "Related Patterns" and now in out else out.get(now, clean)

    for line in text.splitlines():
        clause = clause_of(line)
        if clause:
            done()
            now, lines = clause, []
        elif now:
            lines.append(line)
    done()
    return out


def names_in(text: str) -> list[str]:
    import re

    return [x for x in (p.strip() for p in re.split("[,;\n]", text)) if 3 <= len(x.encode()) <= 40]


def extract_patterns(sections: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, pattern, name, category, section_id, page_start, page_end, parts, related_patterns) for each document that has a section named like pattern of names(pattern).

    The parts come from the section's children by their titles; where these give neither intent nor consequences, from the labelled blocks of its text.
    """
    first = Window.partitionBy("doc_id", "pattern").orderBy("ord")
    own = sections.join(F.broadcast(names), F.contains(F.lower("title"), F.lower("pattern"))).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")

    def with_text(rows: DataFrame, keys: list[str]) -> DataFrame:
        inside = rows.join(pages.select("doc_id", "page_number", "text"), "doc_id").filter("page_number BETWEEN page_start AND page_end")
        texts = inside.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_number", "text"))).alias("p"))
        return texts.withColumn("body", F.array_join(F.transform("p", lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("\n"))), "")).drop("p")

    keys = ["doc_id", "pattern"]
    whole = with_text(own, keys)
    child = sections.select("doc_id", F.col("parent_id").alias("section_id"), F.col("ord").alias("child"), F.col("title").alias("child_title"), "page_start", "page_end").join(own.select(*keys, "section_id", F.col("ord").alias("own")), ["doc_id", "section_id"]).filter("child > own")
    bodies = with_text(child, [*keys, "child", "child_title"])
    children = bodies.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("child", "child_title", "body"))).alias("children"))

    @F.pandas_udf("parts map<string,string>, related array<string>")
    def parts_of(children: pd.Series, body: pd.Series) -> pd.DataFrame:
        out = []
        for own, text in zip(children, body, strict=True):
            parts: dict[str, str] = {}
            for c in own if own is not None else []:
                part = next((p for w, p in CLAUSES.items() if w in c["child_title"].lower()), None)
                if part:
                    parts[part] = c["body"]
            if "Intent" not in parts and "Consequences" not in parts:
                found = text_parts(text or "")
                related = parts.get("Related Patterns", "") + "\n" + found.get("Related Patterns", "")
                parts = {**found, **parts, "Related Patterns": related}
            out.append(({k: v for k, v in parts.items() if k in PARTS}, names_in(parts.get("Related Patterns", ""))))
        return pd.DataFrame(out, columns=["parts", "related"])

    rows = own.join(whole, keys, "left").join(children, keys, "left").withColumn("r", parts_of("children", "body"))
    return rows.select(*keys, F.col("title").alias("name"), F.col("parent_id").alias("category"), "section_id", "page_start", "page_end", "r.parts", F.col("r.related").alias("related_patterns"))


def compare_patterns(patterns: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, a, b) for each document that has both patterns; a and b are the rows."""
    side = lambda name, alias: patterns.filter(F.col("pattern") == name).select("doc_id", F.struct(*[c for c in patterns.columns if c != "doc_id"]).alias(alias))
    return side(a, "a").join(side(b, "b"), "doc_id")
