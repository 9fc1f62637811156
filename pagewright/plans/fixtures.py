"""Small literal tables for operators that the folder's tables have no rows for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OFF_TOPIC = "(900001, 'zirconium paella kubernetes ingress'), (900002, 'memoization of the sourdough macros'), (900003, 'the and of'), (900004, 'document content of the réplica'), (900005, 'azafrán xylophone thththth')"
LINES = """(1, 'INTENT'), (2, 'Define the thing.'), (3, '1. First part'), (4, '1.2. Deeper'), (5, '### Third level'), (6, '# Top'), (7, '## Second'), (8, 'Chapter 4 begins here'),
(9, 'capítulo dos'), (10, 'ends with comma,'), (11, 'A | B'), (12, '| Name | Size | Kind |'), (13, '|---|---|---|'), (14, '| one | 2 | x |'), (15, '| two | 3 | y |'), (16, ''),
(17, 'col a    col b    col c'), (18, 'x1    y1    z1'), (19, 'x2    y2    z2'), (20, 'prose with one gap  here'), (21, '1.2.3.4 Deepest'), (22, 'CONSECUENCIAS ÑANDÚ'), (23, 'Wait...'), (24, '  ## Indented  '),
(25, 'u1  u2'), (26, 'v1  v2  v3'), (27, 'w1  w2  w3  w4'), (28, '---'), (29, 'x1  x2  x3  x4'), (30, 'y1  y2  y3  y4'), (31, '')"""
TREE = "('a', 0, NULL, 1), ('a', 1, 0, 1), ('a', 2, 0, 4), ('a', 3, 2, 4), ('a', 4, 2, 6), ('a', 5, NULL, 9), ('a', 6, 5, 12), ('b', 0, NULL, 3), ('b', 1, NULL, 3), ('b', 2, 1, 7)"
PAGES = """('scans', 1, '', 600, 800), ('scans', 2, 'Stamp 42', 10, 10), ('scans', 3, 'A short caption of somewhat more than fifty visible characters stands below it', 300, 200), ('scans', 4, 'A short caption of somewhat more than fifty visible characters stands below it', 100, 100),
('scans', 5, '', NULL, NULL), ('scans', 6, NULL, NULL, NULL), ('scans', 7, 'Few words', NULL, NULL)"""
FIELDS = """(1, NULL, 'employee', NULL, NULL, NULL), (2, 1, 'address', NULL, NULL, NULL), (3, 2, 'zip', 'Tx', 2, '12345'), (4, 2, 'city', 'Tx', 0, ' '), (5, NULL, 'agree', 'Btn', 0, 'Yes'),
(6, NULL, 'sex', 'Btn', 32768, NULL), (7, NULL, 'go', 'Btn', 65536, NULL), (8, NULL, 'list', 'Ch', 3, 'a, b'), (9, 8, '', NULL, NULL, 'kid'), (10, NULL, 'sign', 'Sig', 1, ''), (11, NULL, 'other', 'Xy', 0, 'z')"""
ATTACHMENTS = """('d1', 0, 1, 7, 'att_data_csv', 'data.csv'), ('d1', 1, 2, 7, 'att_again', 'data.csv'), ('d1', 2, 3, 8, 'att_img', 'img.png'), ('d1', 2, 4, 9, 'att_up', '../up.txt'), ('d1', 0, 5, 10, 'att_c', 'C:evil'), ('d2', 2, 6, 7, 'att_x', '..'), ('d2', 0, 7, 7, 'att_y', ' ok.txt ')"""


def _columns() -> str:
    rows = []
    for i in range(12):
        y = 700 - 14 * i
        rows.append(f"('two', 1, {2 * i}, 50, {y}, 200, 10, 'left column line {i}')")
        rows.append(f"('two', 1, {2 * i + 1}, 320, {y}, 200, 10, 'right column line {i}')")
    rows.append("('two', 1, 24, 50, 760, 480, 14, 'A heading that spans both columns of the page')")
    rows.append("('two', 1, 25, 50, 400, 480, 10, 'A foot that spans both columns of the page')")
    for i in range(5):
        rows.append(f"('one', 1, {i}, 50, {700 - 14 * i}, 460, 10, 'a single line of text number {i} over the whole width')")
    rows += ["('gaps', 1, 0, 10, 100, 20, 10, 'Hel')", "('gaps', 1, 1, 30, 101, 20, 10, 'lo')", "('gaps', 1, 2, 60, 99, 30, 10, 'world')", "('gaps', 1, 3, 10, 80, 30, 10, 'well-')", "('gaps', 1, 4, 50, 80, 30, 10, 'known')"]
    return ", ".join(rows)


FRAGMENTS = _columns()


def manual(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(sections, pages) of a small manual of patterns."""
    sections = [
        ("manual", 0, "behavioral", "Behavioral Patterns", 1, 1, 4, None),
        ("manual", 1, "strategy", "Strategy", 2, 2, 3, "behavioral"),
        ("manual", 2, "strategy-intent", "Intent", 3, 2, 2, "strategy"),
        ("manual", 3, "strategy-cons", "Consecuencias", 3, 3, 3, "strategy"),
        ("manual", 4, "observer", "Observer", 2, 4, 4, "behavioral"),
    ]
    pages = [
        ("manual", 1, "Behavioral patterns deal with algorithms and duties."),
        ("manual", 2, "Define a family of algorithms and make them interchangeable."),
        ("manual", 3, "More objects, but no conditionals."),
        ("manual", 4, "Intent\nTell dependents of changes.\nConsequences\nLoose coupling.\nRelated Patterns\nMediator, Singleton; Strategy"),
    ]
    return (
        spark.createDataFrame(sections, "doc_id string, ord int, section_id string, title string, level int, page_start int, page_end int, parent_id string"),
        spark.createDataFrame(pages, "doc_id string, page_number int, text string"),
    )


def write_pdf(pages: list[str]) -> bytes:
    """A plain PDF file with lines of text in Latin-1, and an outline entry for each page."""
    objects: list[bytes] = [b"", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b""]
    kids, entries = [], []
    for text in pages:
        shown = [line[i : i + 90] for line in text.split("\n") for i in range(0, max(1, len(line)), 90)]
        quote = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
        body = b"BT /F1 8 Tf 10 TL 40 780 Td " + b" ".join(b"(" + quote(t) + b") Tj T*" for t in shown) + b" ET"
        objects.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    for n, page in enumerate(kids):
        after = b" /Next %d 0 R" % (len(objects) + 2) if n + 1 < len(kids) else b""
        objects.append(b"<< /Title (Page %d) /Parent 4 0 R /Dest [%d 0 R /Fit]%s >>" % (n + 1, page, after))
        entries.append(len(objects))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R /Outlines 4 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    objects[3] = b"<< /Type /Outlines /First %d 0 R /Last %d 0 R >>" % (entries[0], entries[-1]) if entries else b"<< /Type /Outlines >>"
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R /Size %d >>\n%%%%EOF\n" % (len(objects) + 1)


def pdf_bytes(pages: str):
    """A column of PDF files from an array of (page_number, text)."""
    @F.pandas_udf("binary")
    def make(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: write_pdf([r["text"] for r in rows]))

    return make(pages)
