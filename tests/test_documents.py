import hashlib
import struct
import zlib

import numpy as np
import pytest

from pagewright.operators import evaluate, extract, layout, patterns, render, structure, tables
from pagewright.plans import fixtures as X
from pagewright.plans.api import Collection, UnknownDocument
from pagewright.sources import pdf, store


def build(objects, extra=b""):
    out = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items())
    return out + b"trailer << /Root 1 0 R %s >>\n" % extra


def stream(body, head=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(body), head, body)


def rich():
    content = b"BT /F1 12 Tf 50 700 Td (Visible text here) Tj 0 -20 Td 3 Tr (secret words) Tj 0 Tr ET q 3 Tr Q BT /F1 10 Tf 50 600 Td [(Ker) -20 (ned) -300 (apart)] TJ ET /Fx Do"
    return build(
        {
            1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R /AcroForm << /Fields [30 0 R] >> /Names << /EmbeddedFiles << /Names [(data.csv) 40 0 R] >> /Dests << /Names [(there) [6 0 R /Fit]] >> >> /AF [40 0 R] /MarkInfo << /Marked true >> >>",
            2: b"<< /Type /Pages /Kids [5 0 R 6 0 R] /Count 2 /Resources << /Font << /F1 3 0 R >> /XObject << /Fx 8 0 R /Im 9 0 R >> >> >>",
            3: b"<< /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >>",
            4: stream(zlib.compress(content), b"/Filter /FlateDecode"),
            5: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Annots [10 0 R 11 0 R 12 0 R 33 0 R] >>",
            6: b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents [] >>",
            8: stream(b"BT /F1 9 Tf 50 500 Td (From a form object) Tj ET", b"/Type /XObject /Subtype /Form"),
            9: stream(b"\0", b"/Type /XObject /Subtype /Image /Width 600 /Height 800"),
            10: b"<< /Type /Annot /Subtype /Link /Rect [1 2 3 4] /A << /S /URI /URI (https://example.org/) >> >>",
            11: b"<< /Type /Annot /Subtype /Link /A << /S /GoTo /D (there) >> >>",
            12: b"<< /Type /Annot /Subtype /Link /Dest /Nowhere >>",
            20: b"<< /First 21 0 R /Last 22 0 R >>",
            21: b"<< /Title (First \\(one\\)) /Dest [5 0 R /Fit] /Next 22 0 R /First 23 0 R >>",
            22: b"<< /Title <FEFF00D1> /Dest (there) /Next 21 0 R >>",
            23: b"<< /Dest [5 0 R] >>",
            30: b"<< /T (employee) /Kids [31 0 R] /FT /Tx >>",
            31: b"<< /T (address) /Kids [32 0 R 33 0 R] /Ff 2 >>",
            32: b"<< /T (zip) /V (12345) >>",
            33: b"<< /T (agree) /FT /Btn /V /Yes /Ff 0 >>",
            40: b"<< /Type /Filespec /F (data.csv) /EF << /F 41 0 R >> /Desc (Rows) >>",
            41: stream(b"a,b\n1,2\n", b"/Type /EmbeddedFile /Subtype /text#2Fcsv /Params << /Size 8 >>"),
            50: b"<< /Title (My Manual) /Author <FEFF0041> >>",
        },
        b"/Info 50 0 R",
    )


def test_parts_of_a_file():
    d = pdf.parse(rich(), "x/file.pdf")
    m = d["meta"]
    assert (m["doc_id"], m["author"], m["total_pages"], m["is_tagged"], m["untrusted_text_detected"]) == ("my-manual", "A", 2, True, True)
    first, second = d["pages"]
    assert '[Untrusted Hidden Text: "secret words"]' in first["text"] and "Kerned apart" in first["text"] and "From a form object" in first["text"]
    assert second["kind"] == "scanned_image" or second["kind"] == "empty"
    assert [(x["kind"], x["uri"], x["target_page"], x["named_target"]) for x in d["links"]] == [("external", "https://example.org/", None, None), ("internal", None, 2, None), ("named", None, None, "Nowhere")]
    assert [(s["title"], s["level"], s["page_start"], s["page_end"]) for s in d["sections"]] == [("First (one)", 1, 1, 1), ("Untitled Section", 2, 1, 2), ("Ñ", 1, 2, 2)] or d["sections"][0]["title"] == "First (one)"
    assert {f["fully_qualified_name"]: (f["field_type"], f["value"], f["required"], f["page_number"]) for f in d["forms"]} == {"employee.address.zip": ("text", "12345", True, None), "employee.address.agree": ("checkbox", "Yes", False, 1)}
    (a,) = d["attachments"]
    assert (a["filename"], a["data"], a["is_text"], a["mime_type"], a["size_bytes"]) == ("data.csv", b"a,b\n1,2\n", True, "text/csv", 8)


def locked(password=b""):
    pad = pdf._PAD
    o, p, first = hashlib.md5(b"owner").digest() * 2, -4, b"0123456789abcdef"
    key = hashlib.md5((password + pad)[:32] + o + (p & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()[:5]
    own = hashlib.md5(key + (4).to_bytes(3, "little") + b"\0\0").digest()[:10]
    body = pdf.rc4(own, b"BT /F1 12 Tf 50 700 Td (Locked text on this page) Tj ET")
    return build(
        {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 4 0 R >>", 4: stream(body), 9: b"<< /Filter /Standard /V 1 /R 2 /P -4 /O <%s> /U <%s> >>" % (o.hex().encode(), pdf.rc4(key, pad).hex().encode())},
        b"/Encrypt 9 0 R /ID [<%s> <00>]" % first.hex().encode(),
    )


def test_encryption():
    assert "Locked text" in pdf.parse(locked())["pages"][0]["text"]
    assert "Locked text" in pdf.parse(locked(b"pass"), password="pass")["pages"][0]["text"]
    for data, word in ((locked(b"pass"), None), (locked(b"pass"), "wrong")):
        with pytest.raises(pdf.PdfError):
            pdf.parse(data, password=word)


def test_object_streams_and_text_strings():
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R] >>", 3: b"<< /Type /Page /Contents 5 0 R >>"}
    head, body = b"", b""
    for n, o in inner.items():
        head += b"%d %d " % (n, len(body))
        body += o + b" "
    data = b"%PDF-1.5\n4 0 obj\n" + stream(zlib.compress(head + body), b"/Type /ObjStm /N 3 /First %d /Filter /FlateDecode" % len(head)) + b"\nendobj\n5 0 obj\n" + stream(b"BT 1 0 0 1 20 20 Tm (packed) Tj ET") + b"\nendobj\n"
    assert pdf.parse(data)["pages"][0]["text"] == "packed"
    assert [pdf.text_of(x) for x in (b"\xfe\xff\x00A\x00\xf1", b"caf\xc3\xa9", b"\x93x\x94 \x84", b" t ")] == ["Añ", "café", "ﬁxﬂ —", "t"]


def test_hostile_files():
    loop = build({1: b"<< /Type /Catalog /Pages 2 0 R /Outlines 3 0 R >>", 2: b"<< /Kids [2 0 R 5 0 R] >>", 3: b"<< /First 4 0 R >>", 4: b"<< /Title (a) /First 4 0 R /Next 4 0 R >>", 5: b"<< /Type /Page /Resources << /XObject << /X 6 0 R >> >> /Contents 7 0 R >>", 6: stream(b"/X Do BT (deep) Tj ET", b"/Subtype /Form"), 7: stream(b"/X Do")})
    d = pdf.parse(loop)
    assert d["meta"]["total_sections"] == 1 and d["pages"][0]["text"].count("deep") <= 5
    with pytest.raises(pdf.PdfError):
        pdf.parse(b"no such thing")


def test_ingest_store_and_tools(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(rich())
    (tmp_path / "in/sub/b.PDF").write_bytes(X.write_pdf(["INTENT\nDefine a family of algorithms for sorting things.", "CONSEQUENCES\nMore classes than before, says this page."]))
    (tmp_path / "in/c.pdf").write_bytes(b"broken")
    t = pdf.tables(pdf.parsed(pdf.read_files(spark, str(tmp_path / "in"))))
    assert t["errors"].count() == 1 and t["doc_meta"].count() == 2
    errors = t.pop("errors")
    assert "PdfError" in errors.first()["error"]
    s = store.Store(spark, str(tmp_path / "store"))
    s.save(t)
    s.save(t)
    assert [r.doc_id for r in s.list_documents().collect()] == ["b", "my-manual"]
    c = Collection.from_store(s)
    assert c.document_outline("b").count() == 2 and c.document_info("my-manual").first()["outline_preview"].startswith("* First")
    q = spark.createDataFrame([(1, "family of algorithms"), (2, "zirconium paella")], "query_id long, query string")
    for mode in ("evidence", "context"):
        got = {r.query_id: r.text for r in c.document_query(q, mode=mode).collect()}
        assert "algorithms" in got[1] and "Sin evidencia" in got[2]
    assert c.document_query(q, "b", "hits").filter("query_id = 1").first()["doc_id"] == "b"
    with pytest.raises(UnknownDocument, match="my-manual"):
        c.document_query(q, "nothing")
    assert c.document_read_pages("b", 1, 2).count() == 2
    with pytest.raises(ValueError):
        c.document_read_pages("b", 3, 4)
    section = c.document_outline("b").join(c.sections, ["doc_id", "ord"]).first()["section_id"]
    assert "family" in c.document_get_section("b", section).first()["text"]
    assert c.document_extract("my-manual", "links", link_kind="external").count() == 1 and c.document_extract("my-manual", "forms", filled_only=True).count() == 2
    assert c.document_read_attachment("my-manual", "DATA.CSV").first()["content"] == "a,b\n1,2\n"
    assert bytes(c.document_render_page("b", 1, 300).first()["png"]).startswith(b"\x89PNG")
    done = store.write_attachments(s.read("attachments"), str(tmp_path / "files")).collect()
    assert done[0].written and (tmp_path / "files/my-manual/data.csv").read_bytes() == b"a,b\n1,2\n"
    digest = s.get("b").first()["content_hash"]
    assert s.load_by_hash(digest)["pages"].count() == 2 and s.remove_by_hash(digest) and not s.remove_by_hash(digest)


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))

    def save(*docs):
        meta = spark.createDataFrame([(d, h) for d, h, _ in docs], "doc_id string, content_hash string")
        pages = spark.createDataFrame([(d, h, t) for d, h, t in docs], "doc_id string, content_hash string, text string")
        s.save({"doc_meta": meta, "pages": pages})

    shown = lambda: sorted(map(tuple, s.read("pages").collect()))
    with pytest.raises(LookupError):
        s.read("pages")
    with pytest.raises(ValueError):
        s.save({})
    assert not s.remove_by_hash("h1")
    save(("a", "h1", "old"), ("b", "h2", "same"))
    save(("a", "h3", "new"), ("c", "h4", "other"))
    want = [("a", "h3", "new"), ("b", "h2", "same"), ("c", "h4", "other")]
    assert shown() == want and s.get("a").first()["content_hash"] == "h3" and s.get("h1").isEmpty()
    save(("d", "h2", "same, of another id"))  # one document for each content
    want[1] = ("d", "h2", "same, of another id")
    assert shown() == sorted(want)
    assert s.remove_by_hash("h3") and shown() == sorted(want[1:])  # no earlier version comes back
    s.compact()
    assert shown() == sorted(want[1:]) and len(list((tmp_path / "store/pages").glob("batch=*"))) == 1 and not list((tmp_path / "store/removed").glob("batch=*"))
    save(("a", "h3", "again"))
    assert shown() == sorted([("a", "h3", "again"), *want[1:]])
    spark.createDataFrame([("z", "h9", "no doc_meta")], "doc_id string, content_hash string, text string").write.parquet(str(tmp_path / "store/pages/batch=99"))
    assert len(shown()) == 3  # a batch that was never completed


def test_stream_of_files(spark, tmp_path):
    from pagewright.streaming.ingest import ingest_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(rich())
    s = store.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in"), s, str(tmp_path / "check")).awaitTermination(120)
    assert [r.doc_id for r in s.list_documents().collect()] == ["my-manual"]


def test_hidden_text():
    assert extract.marked_hidden("a secret and a secretive", ["secret", "secretive", "x"]) == 'a [Untrusted Hidden Text: "secret"] and a [Untrusted Hidden Text: "secretive"]'
    assert extract.marked_hidden("abc", ["zz"]) is None and extract.marked_hidden("ab" * 50, ["ab"]) is None
    assert extract.marked_hidden("x", [f"n{i}" for i in range(600)]) is None


def test_markdown_tables():
    assert tables.markdown_table(["a", "b|c"], [["1"], ["x\ny", "2"]], ["left", "right"]) == "| a | b\\|c |\n|---|---:|\n| 1 |  |\n| x y | 2 |"
    text = "Intro line\nName  Size\nalpha  10\nbeta  20\n\nprose goes on here"
    assert tables.with_markdown_tables(text) == "Intro line\n| Name | Size |\n|---|---|\n| alpha | 10 |\n| beta | 20 |\n\nprose goes on here"


def test_two_columns_from_fragments(spark):
    rows = {r.doc_id: r for r in layout.reading_order(spark.sql(f"SELECT doc_id, page, ord, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CAST(width AS DOUBLE) width, CAST(height AS DOUBLE) height, text FROM (VALUES {X.FRAGMENTS}) AS t(doc_id, page, ord, x, y, width, height, text)")).collect()}
    two = rows["two"].text
    assert rows["two"].n_columns == 2 and two.startswith("A heading") and two.endswith("columns of the page") and two.index("left column line 11") < two.index("right column line 0")
    assert rows["gaps"].text == "Hello world\nwell-known" and rows["one"].n_columns == 1


def test_patterns(spark):
    sections, pages = X.manual(spark)
    got = {r.pattern: r for r in patterns.extract_patterns(sections, pages, spark.createDataFrame([("strategy",), ("observer",), ("none",)], "pattern string")).collect()}
    assert set(got) == {"strategy", "observer"}
    assert got["strategy"].parts["Intent"].startswith("Define") and got["observer"].parts["Consequences"] == "Loose coupling." and got["observer"].related_patterns == ["Mediator", "Singleton", "Strategy"]


def test_outline_repair(spark):
    sections = spark.createDataFrame([("d", 0, "Alpha part", 1, ""), ("d", 1, "Beta part", 1, ""), ("d", 2, "Gone", 1, "")], "doc_id string, ord int, title string, page_start int, content_preview string")
    pages = spark.createDataFrame([("d", 1, "contents"), ("d", 2, "the ALPHA PART begins"), ("d", 3, "beta part")], "doc_id string, page_number int, text string")
    assert [(r.ord, r.page_start) for r in structure.reconcile(sections, pages).orderBy("ord").collect()] == [(0, 2), (1, 3), (2, 1)]


def test_outline_repair_in_files():
    rows = [{"ord": 0, "section_id": "alpha-p1", "title": "Alpha part", "level": 1, "page_start": 1, "page_end": 1, "parent_id": None, "parent_ord": None}]
    rows += [{"ord": 1, "section_id": "beta-p1", "title": "Beta", "level": 2, "page_start": 1, "page_end": 1, "parent_id": "alpha-p1", "parent_ord": 0}, {"ord": 2, "section_id": "far-p4", "title": "Far", "level": 1, "page_start": 4, "page_end": 4, "parent_id": None, "parent_ord": None}]
    pages = [{"page_number": n, "text": t} for n, t in enumerate(["contents", "the ALPHA PART\nbegins", "beta", ""], 1)]
    got = pdf.with_page_ends(pdf.with_found_pages(rows, pages), 4)
    assert [(r["section_id"], r["parent_id"], r["page_start"], r["page_end"], r["content_preview"]) for r in got] == [("alpha-part-p2", None, 2, 4, "the ALPHA PARTbegins"), ("beta-p3", "alpha-part-p2", 3, 4, "beta"), ("far-p4", None, 4, 4, "")]


def test_table_starts_where_its_rows_agree(spark):
    text = "a1  a2\nb1  b2  b3\nc1  c2  c3  c4\n----\nd1  d2  d3  d4\ne1  e2  e3  e4\n\nx1  x2\n\ny1  y2\nz1  z2"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in tables.table_blocks(docs).orderBy("first_line").collect()] == [(1, 1, 4, 4), (1, 9, 2, 2)]
    assert tables.with_markdown_tables(text).splitlines()[:3] == ["a1  a2", "| b1 | b2 | b3 |  |", "|---|---|---|---|"]


def test_png():
    canvas = render.Canvas(3, 2)
    canvas.set_pixel(1, 1, (9, 8, 7, 6))
    canvas.blit(np.full((1, 1, 4), 5, np.uint8), -1, -1, 2, 2)
    data = canvas.png()
    assert struct.unpack(">II", data[16:24]) == (3, 2)
    raw = zlib.decompress(data[data.index(b"IDAT") + 4 : data.index(b"IEND") - 8])
    assert raw[1:5] == b"\5\5\5\5" and raw[13 + 1 + 4 : 13 + 1 + 8] == bytes([9, 8, 7, 6])


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"id": "a", "query": "family of algorithms", "expected_concepts": ["algorithms", "absent"]}, {"id": "b", "query": "paella"}]')
    q = store.questions(spark, str(tmp_path / "q.json"))
    sections, pages = X.manual(spark)
    from pagewright.operators import index

    out = {r.query_id: r for r in evaluate.run_suite(q, index.build(pages, sections), sections, pages).collect()}
    assert out["a"].recall == 0.5 and out["b"].retrieved_tokens == 0 and not out["b"].passed
    assert "Benchmark" in evaluate.markdown_report(evaluate.run_suite(q, index.build(pages, sections), sections, pages))
    (tmp_path / "l.json").write_text('{"answerable": [{"question": "x", "document_title": "T", "expected_page_start": 1, "expected_page_end": 2, "paraphrased": true}], "unanswerable": [{"question": "y"}]}')
    rows = store.labelled_questions(spark, str(tmp_path / "l.json"))
    hits = spark.createDataFrame([("a0", 1, "T", 2)], "query_id string, rank int, title string, page int")
    got = evaluate.labelled_evaluation(rows, hits, hits.select("title")).first()
    assert (got.found, got.found_paraphrased, got.rightly_refused) == (1, 1, 1)


def test_pages_are_deflated_by_runs_of_rows():
    import time
    import zlib

    import numpy as np

    from pagewright.operators import render

    def pixels(png):
        at, data, size = 8, b"", None
        while at < len(png):
            n, kind = int.from_bytes(png[at : at + 4]), png[at + 4 : at + 8]
            body = png[at + 8 : at + 8 + n]
            assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n])
            if kind == b"IHDR":
                size = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            data += body if kind == b"IDAT" else b""
            at += 12 + n
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], 1 + 4 * size[0])
        assert not rows[:, 0].any()
        return rows[:, 1:].reshape(size[1], size[0], 4)

    r = np.random.default_rng(2)
    images = [r.integers(0, 256, (50, 40, 4)).astype(np.uint8), np.repeat(r.integers(0, 256, (9, 40, 4)).astype(np.uint8), 7, axis=0), np.zeros((1, 3, 4), np.uint8), np.full((2, 3, 4), 255, np.uint8)]
    for image in images:
        assert np.array_equal(pixels(render.encode_png(image)), image)
    page = "\n".join("w" * int(n) for n in r.integers(0, 120, 40))
    png = render.render_layout(page, "digital_text", 400)
    assert np.array_equal(pixels(png)[0, 0], render.BORDER) and pixels(png).shape == (566, 400, 4) and len(png) < 8000
    blank = render.Canvas(400, 566).pixels
    plain = np.concatenate([np.zeros((566, 1), np.uint8), blank.reshape(566, 1600)], axis=1)
    best = lambda f: min((f(), time.thread_time())[1] - t for t in (time.thread_time() for _ in range(20)))
    assert best(lambda: render.encode_png(blank)) < best(lambda: zlib.compress(plain.tobytes(), 6)) / 2
