import itertools
import random

import pytest

from pagewright.llm.minhash import estimate, near_duplicates, shingle_sets, signatures


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def corpus(seed, n=220):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 6))) for _ in range(400)]
    passage = r.choices(vocabulary, k=30)
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.5 and rows:
            w = words(r.choice(rows)[1])
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w += r.choices(vocabulary, k=r.randint(0, 20))
        elif kind < 0.65:
            w = passage + r.choices(vocabulary, k=r.randint(5, 25))
        else:
            w = r.choices(vocabulary, k=r.choice([0, 1, 3, 5, 20, 60, 150]))
        rows.append((i * 3 + 1, r.choice([" ", "\n", "\t "]).join(x.upper() if r.random() < 0.1 and x.isascii() else x for x in w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, component_id string").repartition(5)
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == brute(rows)


def test_blocks_of_a_large_bucket(spark, monkeypatch):
    import pagewright.llm.minhash as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 4)
    rows = corpus(5, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d e f"), (4, "a b c d e f"), (5, "A b\nc d e f"), (5, "other words stand here in this one"), (6, "other words stand here in this one"), (7, "w " * 50_000), (8, "one"), (9, "ONE"), (9, "ONE")]
    got = sorted((tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 2, None, True), (4, 2, 4, True), (5, 2, 4, False), (5, 3, 4, False), (6, 3, 4, False), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False), (9, 1, 8, False)], key=str)
    empty = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "n_shingles", "component_id", "kept"] and empty.count() == 0


def test_estimate_is_corrected(spark):
    import numpy as np

    r = np.random.default_rng(3)
    common = r.integers(0, 1 << 62, 600, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8):
        k = int(400 * 2 * share / (1 + share))
        a, b = np.unique(np.concatenate([common[:k], r.integers(0, 1 << 62, 400 - k, dtype=np.uint64)])), np.unique(np.concatenate([common[:k], r.integers(0, 1 << 62, 400 - k, dtype=np.uint64)]))
        _, bits = signatures([a, b])
        df = spark.createDataFrame([(bits[0].tolist(), bits[1].tolist())], "a array<long>, b array<long>")
        got = df.select(estimate(df.a, df.b)).first()[0]
        assert abs(got - share) < 0.16


def test_words_do_not_cross_documents():
    import numpy as np

    one = np.frombuffer(b"a b c d e", np.uint8)
    both = np.frombuffer(b"a b c d ea b c d e", np.uint8)
    (x,) = shingle_sets(one, np.array([0, 9]))
    y, z = shingle_sets(both, np.array([0, 9, 18]))
    assert list(x) == list(y) == list(z) and len(x) == 1
