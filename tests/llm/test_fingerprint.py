import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

import pagewright.llm.fingerprint as fp


def canon(text):
    n = lambda s: unicodedata.normalize("NFKC", s)
    return re.sub(r"\s+", " ", n(n(text or "").casefold())).strip(" ")


def brute(rows):
    ids = sorted({i for i, _ in rows if i is not None}, reverse=True)
    follows = {i: ids[(k + 1) % len(ids)] for k, i in enumerate(ids)}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t or "")
    out = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 3
        after = texts[follows[i]] if i is not None else ""
        edited = t[: len(t) - k] + after[:k]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(canon(t) == canon(edited)), float(i is not None and canon(t) == canon(after))))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    pieces = ["ﬁne", "Straße", "ÉÈ", "é", "  ", "\n", " ", "🙂", "abc", "ABC", "①", "word "]
    rows = [(i * 7, "".join(r.choices(pieces, k=r.choice([0, 1, 2, 5, 30])))) for i in range(150)]
    rows += [(5000 + i, rows[r.randrange(150)][1].swapcase() if i % 2 else rows[r.randrange(150)][1]) for i in range(40)]
    return rows + [(9001, None), (9002, ""), (9003, " \t"), (None, "no id here"), (9004, "long text ué " * 90_000)]


def test_against_a_plain_version(spark):
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(5)
    got = fp.edited_fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(rows)
    own = {r.doc_id: r.fingerprint for r in got}
    by = {}
    for i, t in rows:
        by.setdefault(canon(t), set()).add(own[i])
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert all((r.edited_fingerprint == r.fingerprint) == (r.near_edited == 1.0) for r in got)
    known = {c: next(iter(x)) for c, x in by.items()}
    assert {r.fingerprint for r in fp.fingerprints(df).collect()} == set(known.values())


def test_repeated_ids_and_small_tables(spark):
    rows = [(3, "abcdef"), (3, "abcdef"), (1, "xyz123"), (1, "xyz123"), (2, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = fp.edited_fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got), key=str) == brute(rows)
    one = fp.edited_fingerprints(spark.createDataFrame([(4, "abcabc")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcaab").hexdigest()
    assert fp.edited_fingerprints(df.limit(0)).count() == 0
    both = spark.createDataFrame([(1, "abcdef"), (1, "uvwxyz"), (2, "ghi")], "doc_id long, text string")
    assert fp.edited_fingerprints(both).count() == 3


def test_equal_digests_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(fp, "digest", lambda c: F.substring(F.hex(F.xxhash64(c)), 1, 1))
    rows = [(i, f"text {i % 40}") for i in range(120)]
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 40 and all(got[i] == got[i + 40] for i in range(80))


def test_plan_is_built_in(spark):
    df = fp.edited_fingerprints(spark.createDataFrame([(4, "abcabc")], "doc_id long, text string"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
