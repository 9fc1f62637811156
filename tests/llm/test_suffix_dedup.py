import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pagewright.llm.suffix_dedup import LENGTH, cut_texts, multikey_quicksort, sliding_least, without_repeats


def brute(rows, LENGTH=LENGTH):  # noqa: N803
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + LENGTH] for _, b in texts for s in range(len(b) - LENGTH + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - LENGTH + 1):
            if seen[b[s : s + LENGTH]] > 1:
                gone[s : s + LENGTH] = True
        gone = gone[:-1]
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, parts=6, length=LENGTH):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").repartition(parts)
    return sorted((tuple(r) for r in without_repeats(df, length).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    letters = "ab" if seed == 3 else "abcdé fgh\n"
    make = lambda n: "".join(r.choices(letters, k=n))
    passages = [make(n) for n in (150, 390, 399, 400, 401, 450, 700, 1200)]
    rows = []
    for i in range(90):
        text = make(r.choice([0, 10, 300, 900]))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.4:
                a = r.randrange(len(p))
                p = p[a : a + r.randint(1, len(p))]
            if r.random() < 0.3:
                a = r.randrange(len(p) + 1)
                p = p[:a] + "#" + p[a + 1 :]
            text += p + make(r.choice([0, 1, 20, 500]))
        rows.append((i, text))
    rows += [(i + 500, t) for i, t in rows[:7]] + [(rows[3][0], rows[3][1])]
    assert run(spark, rows) == brute(rows)
    if seed == 2:
        assert run(spark, rows, length=256) == brute(rows, 256)


def test_odd_rows(spark):
    long = "".join(random.Random(9).choices("abcdefgh ", k=2_300_000))
    rows = [(1, None), (2, ""), (3, "a" * 399), (4, "a" * 401), (5, "ab" * 700), (6, "x" * 400), (6, "y" * 30 + "x" * 400), (None, "z" * 400), (None, "q" + "z" * 400)]
    assert run(spark, rows) == brute(rows)
    at = len(long) // 2
    got = dict((r[0], r[1:4]) for r in run(spark, [(1, long), (2, "?" + long[at : at + 1000] + "?"), (3, "short")], 2))
    assert got == {1: (len(long), 1000, 1), 2: (1002, 1000, 1), 3: (5, 0, 0)}
    assert run(spark, []) == []


def test_cut_texts_have_whole_code_points(spark):
    both = "é" * 250
    df = spark.createDataFrame([(1, "aaa" + both, 7), (2, both + "bbb", None), (3, "ok", 1), (4, None, 2)], "doc_id int, text string, spans int")
    out = cut_texts(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect())) == [(1, "aaa", 7), (2, "bbb", None), (3, "ok", 1), (4, None, 2)]


def test_parts():
    r = np.random.default_rng(1)
    x = r.integers(0, 50, 1000).astype(np.uint64)
    assert (sliding_least(x, 7) == [x[i : i + 7].min() for i in range(994)]).all()
    w = r.integers(0, 3, (5000, 6)).astype(np.uint64)
    o = multikey_quicksort(w)
    assert sorted(o) == list(range(5000)) and (w[o] == np.array(sorted(w.tolist()), np.uint64)).all()


def test_shorter_passages_are_told(spark):
    r = random.Random(5)
    make = lambda n: "".join(r.choices("abcdé fgh\n", k=n))
    passages = [make(n) for n in (200, 255, 256, 300, 399, 400, 900)]
    rows = [(i, make(r.choice([0, 50, 700])) + "".join(r.choice(passages) + make(r.choice([0, 9, 400])) for _ in range(r.randint(0, 3)))) for i in range(80)]
    rows += [(None, rows[1][1]), (None, rows[2][1]), (7, rows[8][1]), (200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in without_repeats(df, passage=256).collect()), key=str)
    short = sorted(brute(rows, 256), key=lambda x: str((x[0], x[1])))
    assert [g[:5] for g in got] == brute(rows)
    assert sorted((str(g[0]), g[1], g[5]) for g in got) == sorted((str(s[0]), s[1], s[2]) for s in short)


def test_a_core_over_many_ranges(spark):
    """One passage in many different texts, sorted in several ranges: windows that one range has once are found in others."""
    r = random.Random(6)
    make = lambda n: "".join(r.choices("abcdefgh ", k=n))
    core = make(420)
    rows = [(i, make(40) + ("x" if i % 3 else "y") + core + ("p" if i % 2 else "q") + make(r.choice([5, 90]))) for i in range(120)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert run(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_clashing_names_in_cut_texts(spark):
    both = "ab" * 150 + "c" * 200
    df = spark.createDataFrame([(1, both + "!", "a", 1, 2, 3), (2, both, "b", 1, 2, 3)], "doc_id long, text string, spans string, own_id int, Own_row int, own_spans int")
    assert sorted(map(tuple, cut_texts(df).collect())) == [(1, "!", "a", 1, 2, 3), (2, "", "b", 1, 2, 3)]
    assert cut_texts(df.limit(0)).collect() == []
