import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import vectors as V
from pagewright.operators import context, index, retrieve
from pagewright.plans import queries
from pagewright.sources import tables as S


def corpus(spark, texts):
    pages = spark.createDataFrame([("d", i + 1, t) for i, t in enumerate(texts)], "doc_id string, page_number int, text string")
    return index.build(pages, S.whole_sections(pages))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_folding_and_tokens(spark):
    df = spark.createDataFrame([("Intención AÑO ﬁn ﬂujo co-op the --",), ("intención",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [["intencion", "año", "fin", "flujo", "co-op", "--"], ["intencio"], []]


def test_slugs_and_headings(spark):
    cases = {"### A b": (3, "A b"), "1. Intro": (1, "Intro"), "1.2.3 Deep": (2, "Deep"), "1.2.3.4 Deeper": (3, "Deeper"), "INTENT": (2, "INTENT"), "A sentence.": None, "So on...": None, "x,": None, "Chapter 1": (1, "Chapter 1"), "ABC": None, "": None, "A" * 130: None, "2.1 Ends with a dot.": (1, "Ends with a dot.")}
    df = spark.createDataFrame([(k,) for k in cases], "line string").withColumn("h", T.heading(F.col("line")))
    assert {r.line: (tuple(r.h) if r.h else None) for r in df.collect()} == cases
    assert spark.createDataFrame([("¡Hola, Mundo!",), ("***",)], "t string").select(T.slugify(F.col("t"))).collect() == [("hola-mundo",), ("section",)]


def test_compacting(spark):
    r = random.Random(1)

    def plain(text):
        out, space, lines = "", False, 0
        for c in text:
            if c in "\r\n":
                lines += 1
                out += "\n" if lines <= 2 else ""
                space = False
            elif c.isspace():
                if not space and not lines:
                    out += " "
                    space = True
            else:
                out += c
                space, lines = False, 0
        return out.strip()

    rows = ["".join(r.choices("ab \t\n\r", k=r.randint(0, 14))) for _ in range(1500)]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.compact(F.col("t")).alias("c")).collect()
    assert all(x.c == plain(x.t) for x in got)


def test_admission_is_inclusive_and_refusals_are_rows(spark):
    i = corpus(spark, [f"common words on page {k} of this manual" for k in range(12)] + ["replication factor of the cluster is three today"])
    q = ask(spark, "What is the replication factor?", "paella kubernetes", "the of")
    hits = retrieve.hybrid_search(q, i, 5).collect()
    assert {h.query_id for h in hits} == {0} and any("replication" in h.snippet for h in hits)
    none = {r.query_id: r for r in retrieve.no_evidence(q, i).collect()}
    assert set(none) == {1, 2} and none[1].absent_terms == ["paella", "kubernetes"] and none[2].required_idf == 0.0


def test_other_forms(spark):
    i = corpus(spark, ["the subscribe call registers observers with its diseño here", "patterns describe algorithms and tests of years"])
    tokens = spark.createDataFrame([(t,) for t in ("subscribers", "pattern", "diseno", "tests", "unknowns")], "token string")
    assert {(r.token, r.form) for r in retrieve.corpus_forms(tokens, i.terms).collect()} == {("subscribers", "subscribe"), ("pattern", "patterns"), ("diseno", "diseño")}


def test_smaller_limits_are_prefixes_and_passages_differ(spark):
    texts = [f"strategy pattern encapsulates algorithm number {k} in a class of its own" for k in range(20)] + ["strategy pattern boilerplate that repeats everywhere"] * 6
    i = corpus(spark, texts)
    q = ask(spark, "strategy pattern", "boilerplate repeats")
    large = {(h.query_id, h.rank): h.unit_id for h in retrieve.hybrid_search(q, i, 8).collect()}
    small = {(h.query_id, h.rank): h.unit_id for h in retrieve.hybrid_search(q, i, 3).collect()}
    assert all(large[k] == v for k, v in small.items() if k[0] == 0)
    seen = [h.snippet for h in retrieve.hybrid_search(q, i, 8).collect() if h.query_id == 1]
    assert len(seen) == len(set(seen))


def test_snippets():
    text = "á" * 100 + " palabra clave " + "z" * 400
    s, place = retrieve.snippet_of(text, ["nada", "clave"])
    assert place == 209 and "clave" in s and s.startswith("... ") and s.endswith(" ...")
    assert retrieve.snippet_of("short", ["none"]) == ("short", 0)
    assert retrieve.snippet_of("ﬁn de la línea", ["linea"])[1] == len("ﬁn de la ".encode())

    r = random.Random(3)
    for _ in range(400):
        text = "".join(r.choices("abÉéñ ßİΣﬁ\u0301🙂\n", k=r.randint(0, 600)))
        term = "".join(r.choices("abeñ", k=2))
        # character by character
        each = [c.lower().translate(retrieve._FOLD) for c in text]
        at = "".join(each).find(term)
        place, done = 0, 0
        if at >= 0:
            for c, f in zip(text, each, strict=True):
                if done + len(f) > at:
                    break
                done += len(f)
                place += len(c.encode())
        assert retrieve.snippet_of(text, [term])[1] == place


def test_indices_follow_their_data(spark, tmp_path):
    def write(word):
        rows = [(1, 0, "user", f"a talk about {word} and the weather of today")]
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")

    write("orchids")
    assert "orchids" in {r.term for r in queries.built(spark, str(tmp_path)).terms.collect()}
    write("zeppelins")
    terms = {r.term for r in queries.built(spark, str(tmp_path)).terms.collect()}
    assert "zeppelins" in terms and "orchids" not in terms


def test_words_are_counted_as_in_whole_units(spark):
    pages = spark.createDataFrame([("d", 1, "one two two"), ("d", 2, "two three three and more words of it"), ("d", 3, None), ("e", 1, "x")], "doc_id string, page_number int, text string")
    sections = spark.createDataFrame([("d", 0, "a", "Two parts", 1, 1, 3, None), ("d", 1, "b", "Inner", 2, 2, 2, "a"), ("e", 0, "c", "", 1, 1, 1, None)], "doc_id string, ord int, section_id string, title string, level int, page_start int, page_end int, parent_id string")
    i = index.build(pages, sections)
    want = index.terms_of(index.units(pages, sections), "unit_id").groupBy("unit_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(i.postings.select("unit_id", "term", "tf").collect()) == sorted(want.collect())
    def own(texts: pd.Series) -> pd.Series:
        return texts.str.len().map(lambda n: [float(n), 1.0])

    vectors = F.pandas_udf(own, "array<double>")
    q = ask(spark, "three words")
    assert {r.unit_id for r in retrieve.hybrid_search(q, i, 5, embed=vectors).collect()} == {r.unit_id for r in retrieve.hybrid_search(q, i, 5).collect()}


def test_section_pages_are_cited(spark):
    pages = spark.createDataFrame([("d", k, f"page {k} speaks of marker{k} and nothing else at all") for k in range(1, 6)], "doc_id string, page_number int, text string")
    i = index.build(pages, S.whole_sections(pages))
    q = ask(spark, *(f"marker{k}" for k in range(1, 6)))
    hits = retrieve.hybrid_search(q, i, 5).collect()
    assert hits and all(h.snippet_page == h.query_id + 1 for h in hits if h.section_id)


def test_saved_indices_answer_alike(spark, tmp_path):
    i = corpus(spark, [f"page {k} of the handbook about topic{k % 3} and more" for k in range(9)])
    i.save(str(tmp_path))
    q = ask(spark, "topic1 handbook", "topic2")
    loaded = index.Index.load(spark, str(tmp_path))
    assert sorted(retrieve.bm25_search(q, i).collect()) == sorted(retrieve.bm25_search(q, loaded).collect())


def test_embedding_matches_a_plain_version():
    def plain(text, dim=128):
        v = np.zeros(dim)
        for w in text.lower().split():
            for f, x in [(w, 2.0), *((w[i : i + 3], 1.0) for i in range(len(w) - 2)), *((w[i : i + 4], 1.2) for i in range(len(w) - 3))]:
                h = 0xCBF29CE484222325
                for b in f.encode():
                    h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
                h ^= h >> 33
                h = h * 0xFF51AFD7ED558CCD & (2**64 - 1)
                h ^= h >> 33
                h = h * 0xC4CEB9FE1A85EC53 & (2**64 - 1)
                h ^= h >> 33
                v[h % dim] += -x if h >> 63 else x
        return v / max(np.linalg.norm(v), 1e-9)

    texts = ["Intención del patrón Strategy", "a bb ccc dddd", "", None, "🙂🙂🙂🙂 x"]
    assert np.allclose(V.embed_texts(texts), [plain(t or "") for t in texts])


def test_evidence_packing(spark):
    r = random.Random(4)
    rows, want = [], set()
    for q in range(30):
        used, kept = 0, True
        for rank in range(1, r.randint(2, 9)):
            n = r.choice([10, 100, 700])
            rows.append((q, rank, "d", 1, None, "t", "w" * n))
            if rank <= 5 and kept:
                tokens = -(-n * 10 // 38)
                if used + tokens > 150 and rank > 1:
                    kept = False
                else:
                    used += tokens
                    want.add((q, rank))
    hits = spark.createDataFrame(rows, "query_id long, rank int, doc_id string, snippet_page int, section_id string, title string, snippet string")
    packed = context.pack_evidence(hits, 150, 5)
    assert {(x.query_id, x.rank) for x in packed.collect()} == want
    assert context.evidence_markdown(packed).count() == 30


def test_page_ranges(spark):
    pages = spark.createDataFrame([("d", k, "x" * 100) for k in range(1, 60)], "doc_id string, page_number int, text string")
    assert context.read_pages(pages, 2, 50, 10**6).count() == 30
    out = context.read_pages(pages, 1, 9, 250).orderBy("page_number").collect()
    assert [x.truncated for x in out] == [False, False, True] and sum(len(x.text.encode()) for x in out) == 2 * 118 + 18  # the head of the page that is cut
    for a, b in ((0, 3), (5, 4)):
        with pytest.raises(ValueError):
            context.read_pages(pages, a, b)


def test_nearest_vectors_hold_a_tile_of_scores(spark):
    def plain(q, v, k):
        s = np.clip(np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T, 12), 0, 1)
        return {(i, int(j), n + 1) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(v)), -s[i]))[:k])}

    r = np.random.default_rng(1)
    v = r.integers(-2, 3, (3000, 6)) + 0.5  # many equal ones
    v[7] = -v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    for k, block in ((5, None), (5, 40), (4000, None)):
        q = rows.filter("vec_id % 20 = 0 AND vec_id < 2400").selectExpr("vec_id AS query_id", "embedding") if k == 5 else rows.filter("vec_id < 2").selectExpr("vec_id AS query_id", "embedding")
        got = {(int(x.query_id) // 20 if k == 5 else x.query_id, x.vec_id, x.rank) for x in retrieve.cosine_topk(q, rows, k, block).collect()}
        assert got == plain(v[:2400:20] if k == 5 else v[:2], v, k)


def test_scores_of_many_queries_take_little_memory(spark):
    """2000 queries and 20,000 vectors: all scores are 320 MB."""

    def most(batches):
        import resource

        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * b.num_rows)], ["mb"])

    rows = spark.range(20_000, numPartitions=1).selectExpr("id AS vec_id", "transform(sequence(1, 8), i -> cast(sin(id * i) AS float)) AS embedding")
    q = rows.filter("vec_id < 2000").selectExpr("vec_id AS query_id", "embedding")
    before = spark.range(1, numPartitions=1).mapInArrow(most, "mb long").first()[0]
    assert retrieve.cosine_topk(q, rows).count() == 20_000
    after = max(x[0] for x in spark.range(64, numPartitions=64).mapInArrow(most, "mb long").collect())
    assert after - before < 300


def steps(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_and_counting_shuffle_no_pairs(spark):
    i = corpus(spark, [f"page {k} of the handbook about topic{k % 3} and more" for k in range(9)])
    terms = spark.createDataFrame([(0, 0, "handbook", 5, 1.5), (0, 1, "topic1", 3, 2.0)], "query_id long, ord int, term string, df long, idf double")
    plan = steps(retrieve.admitted(terms, i))
    units = steps(i.units)
    assert plan.count("Exchange") == units.count("Exchange") and plan.count("Join") == units.count("Join")
    assert steps(i.postings).count("Exchange") == units.count("Exchange")


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    from pagewright.operators import match

    texts = [f"page {k} of the handbook about topic{k % 3} and word{k % 5} or more" for k in range(30)]
    i = corpus(spark, texts + texts)  # ties
    q = ask(spark, "topic1 handbook", "topic2 word3 word3", "word4", "nothing known", "handbook page página")
    asks = (lambda: retrieve.bm25_search(q, i, 3), lambda: retrieve.bm25_search_admitted(q, i, 3), lambda: retrieve.hybrid_search(q, i, 3), lambda: retrieve.no_evidence(q, i))
    show = lambda df: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    want = [show(a()) for a in asks]
    assert all(want)
    monkeypatch.setattr(match, "BLOCK_QUERIES", 2)
    assert [show(a()) for a in asks] == want


def test_pieces_of_words_are_hashed_without_a_loop_over_them():
    import sys

    words = ["palabra", "ñandú", "🙂🙂🙂🙂", "a", "é", "bc", "x" * 300]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(1))
    try:
        many = V.word_vectors(words * 100, 128)
    finally:
        sys.setprofile(None)
    assert np.array_equal(many, np.tile(V.word_vectors(words, 128), (100, 1))) and len(calls) < 20_000
    texts = ["uno dos tres", None, "", "tres " * 30_000, "dos dos"] * 3
    assert np.allclose(V.embed_texts(texts), [V.embed_texts([t])[0] for t in texts])
