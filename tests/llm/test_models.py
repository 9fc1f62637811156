import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import langid_crf, quality_mil, sampling, toxicity

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{ROOT}/labels.parquet")


ODD = [(None, "text without id"), (5, None), (6, ""), (7, "  123 !! "), (8, "word"), (8, "word"), (9, "Wort und " * 60_000), (10, "\n\n"), (11, "日本語 テキスト")]


def test_forward_backward_against_all_paths():
    r = np.random.default_rng(1)
    scores, between, lengths = r.normal(size=(3, 5, 3)), r.normal(size=(3, 3)), np.array([5, 3, 1])
    got, expected = langid_crf.forward_backward(scores, lengths, between)
    moves = np.zeros((3, 3))
    for i, n in enumerate(lengths):
        total, want, own = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[i, t, k] for t, k in enumerate(path)) + sum(between[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for t, k in enumerate(path):
                want[t, k] += p
            for a, b in itertools.pairwise(path):
                own[a, b] += p
        assert np.allclose(got[i, :n], want / total)
        moves += own / total
    assert np.allclose(expected, moves)
    r = np.random.default_rng(2)
    scores, lengths = r.normal(size=(40, 9, 4)), r.integers(1, 10, 40)
    between = r.normal(size=(4, 4))
    slow, fast = langid_crf.forward_backward(scores, lengths, between)[0], langid_crf.marginals_of(scores.transpose(1, 0, 2).astype(np.float32), lengths, between)
    for i, n in enumerate(lengths):
        assert np.allclose(slow[i, :n], fast[:n, i], atol=1e-4)


def test_language_of_held_out_documents(spark, docs):
    model = langid_crf.train(docs)
    got = langid_crf.predict(docs, model).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.97
    odd = {(r.doc_id, r.lang_pred if r.doc_id not in (None, 8, 11) else "") for r in langid_crf.predict(spark.createDataFrame([(*x, 1) for x in ODD], "doc_id long, text string, score int"), model).collect()}
    assert {(5, "und"), (6, "und"), (7, "und"), (10, "und"), (9, "de")} <= odd
    assert langid_crf.predict(docs.limit(0), model).count() == 0
    nothing = langid_crf.train(docs.limit(0))
    assert {r.lang_pred for r in langid_crf.predict(docs.limit(3), nothing).collect()} == {"und"}
    lists = {lang: [w for r in docs.filter(docs.lang == lang).limit(5).collect() for w in langid_crf.words(r.text)][:400] for lang in ("en", "de")}
    mixed = " ".join(lists["en"][:40] + lists["de"][:40])
    tags = [t for _, t, _ in langid_crf.label_words([mixed, ""], model)[0]]
    assert tags[:35].count("en") > 28 and tags[-35:].count("de") > 28


def test_quality_of_held_out_documents(spark, docs, labels):
    model = quality_mil.train(docs, labels)
    got = quality_mil.score(docs, model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in out]) > 0.93
    odd = quality_mil.score(spark.createDataFrame([(*x, 1) for x in ODD], "doc_id long, text string, score int"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert quality_mil.score(docs.limit(0), model).count() == 0
    assert quality_mil.train(docs, labels.limit(0)) is None
    assert {r.score for r in quality_mil.score(docs.limit(2), None).collect()} == {0.5}


def test_passages_do_not_depend_on_their_neighbours():
    r = random.Random(2)
    texts = ["", " ", "one", *(" ".join("".join(r.choices("aB1|$. é\n", k=r.randint(1, 7))) for _ in range(r.randint(1, 300))) for _ in range(60))]
    x, begins = quality_mil._bags(texts)
    for i, t in enumerate(texts):
        alone, b = quality_mil._bags([t])
        assert len(alone) == b[-1] == begins[i + 1] - begins[i] and np.allclose(alone, x[begins[i] : begins[i + 1]])
    assert x.shape[1] == quality_mil.FEATURES


def test_slopes_of_the_attention_model():
    r = np.random.default_rng(5)
    x, begins = r.normal(size=(40, quality_mil.FEATURES)), np.array([0, 3, 10, 11, 40])
    x[[1, 5, 10], 0] += 8
    model = quality_mil.fit(x, begins, np.array([1.0, 1, 1, 0]), epochs=200)
    assert (model.scores(x, begins) > 0.5).tolist() == [True, True, True, False]
    assert np.allclose(np.add.reduceat(model.forward(x, begins)["a"], begins[:-1]), 1)


def test_toxic_documents(spark, docs, labels):
    model = toxicity.train(docs, labels)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == 1000 and all(abs(r.p_toxic - 0) <= 1 and 0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in got.values())
    wrong = [d for d, y in truth.items() if got[d].toxic != bool(y)]
    assert len(wrong) < 0.06 * len(truth)
    assert np.mean([got[d].severity for d, y in truth.items() if y]) > 5 * np.mean([got[d].severity for d, y in truth.items() if not y])
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if not r.toxic}
    odd = toxicity.grade(spark.createDataFrame([(*x, 1) for x in ODD], "doc_id long, text string, grade int"), model).collect()
    assert len(odd) == len(ODD) and not any(r.toxic for r in odd)
    assert toxicity.grade(docs.limit(0), model).count() == 0 and toxicity.train(docs, labels.limit(0)) is None
    assert {r.severity for r in toxicity.grade(docs.limit(2), None).collect()} == {0.0}


def test_grades_are_ordered():
    rows = [("fine words here", 0)] * 400 + [("bad words here", 1)] * 400 + [("bad awful words", 2)] * 400 + [("bad awful vile", 3)] * 400
    model = toxicity.fit(rows)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 3
    above = model.above([model.row(t) for t in ("fine words here", "bad words here", "bad awful words", "bad awful vile")])
    severity = above.sum(axis=1)
    assert (np.diff(severity) > 0.3).all() and severity[0] < 0.5 and severity[-1] > 2.5


def test_numbers_are_no_letters(spark, docs):
    assert [langid_crf.words(t) for t in ("½", "²³ 12", "①② Ⅳ ٣", "x² = ½ y", "一二 三")] == [[], [], [], ["x", "y"], ["一二", "三"]]
    model = langid_crf.train(docs.limit(200))
    rows = [(1, "½"), (2, "²³ 12"), (3, "①②"), (4, "_-_ 7"), (5, "Ⅳ")]
    assert {r.lang_pred for r in langid_crf.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()} == {"und"}


def test_parts_of_long_texts_hang_together():
    """Marginals of parts with their margins against the recursions over the whole text."""
    r = np.random.default_rng(4)
    rows = [(" ".join("".join(r.choice(list(alphabet), 5)) for _ in range(60)), lang) for lang, alphabet in (("aa", "abcdefg"), ("bb", "defghij"), ("cc", "ghijkla")) for _ in range(30)]
    model = langid_crf.fit(rows, steps=40)
    model.between = model.between * 3
    texts = [[w for t, _ in (rows[int(k)] for k in r.integers(0, len(rows), 8)) for w in langid_crf.words(t)[: int(r.integers(5, 60))]] for _ in range(6)] + [["abc"], [], rows[0][0].split()]
    for t, got in zip(texts, model.marginals(texts), strict=True):
        assert len(got) == len(t)
        if t:
            want = langid_crf.forward_backward(model.emissions(t)[None].astype(float), np.array([len(t)]), model.between)[0][0]
            assert np.allclose(got, want, atol=2e-3)


def test_repeated_texts_do_not_crowd_out_others(spark):
    one = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(100_000, 100_300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.expr("CASE WHEN id % 3 = 0 THEN 'de' WHEN id % 3 = 1 THEN 'fr' ELSE 'en' END").alias("lang"))
    got = sampling.sample(one.union(rest), "lang", 50)
    assert len(set(got)) == len(got) and all(50 <= sum(lang == x for _, lang in got) <= 60 for x in ("de", "en", "fr"))
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), (F.col("id") % 500).cast("string").alias("lang"))
    assert len({lang for _, lang in sampling.sample(many, "lang", 50)}) == 500
    long = spark.createDataFrame([(1, "x" * 200_000, "en"), (2, None, "en"), (3, "y", None), (None, "z", "en")], "doc_id long, text string, lang string")
    assert [len(t) for t, _ in sampling.sample(long, "lang", 50)] == [200_000]
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (7, 1), (None, 1)], "doc_id long, toxic int")
    copies = spark.createDataFrame([(1, "a")] * 50 + [(1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    assert len(sampling.sample_labelled(copies, labels, "toxic", 10)) == 2


def _forward(model, bag):
    """The score of one bag, number by number."""
    p, h, e = model.weights, [], []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for row in bag:
        x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(row, model.mean, model.spread, strict=True)]
        code = [np.tanh(sum(x[i] * p["encode"][i, j] for i in range(len(x))) + p["encode0"][j]) for j in range(p["encode"].shape[1])]
        gates = [np.tanh(sum(c * p["v"][i, k] for i, c in enumerate(code))) * sigmoid(sum(c * p["u"][i, k] for i, c in enumerate(code))) for k in range(len(p["w"]))]
        h.append(code)
        e.append(sum(g * w for g, w in zip(gates, p["w"], strict=True)))
    total = sum(np.exp(v) for v in e)
    return sigmoid(sum(np.exp(v) / total * sum(c * w for c, w in zip(code, p["out"], strict=True)) for v, code in zip(e, h, strict=True)) + p["out0"])


def test_attention_model_against_plain_sums_and_differences():
    r = np.random.default_rng(8)
    x, begins, y = r.normal(size=(12, 5)), np.array([0, 1, 4, 12]), np.array([1.0, 0, 1])
    model = quality_mil.begun(x, 4, 3, r)
    assert np.allclose(model.scores(x, begins), [_forward(model, x[a:b]) for a, b in itertools.pairwise(begins)])

    def loss():
        s = model.scores(x, begins)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    got = quality_mil.slopes(model, x, begins, y)
    for name, w in model.weights.items():
        for place in np.ndindex(w.shape):
            old, both = w[place], []
            for step in (1e-5, -1e-5):
                model.weights[name] = w.copy() if w.shape else np.array(old)
                model.weights[name][place] = old + step
                both.append(loss())
            model.weights[name] = w
            assert abs((both[0] - both[1]) / 2e-5 - np.asarray(got[name])[place]) < 1e-7, name


def test_ordinal_slopes_against_a_plain_likelihood():
    r = np.random.default_rng(9)
    score, thresholds, grade = r.normal(size=30) * 2, np.array([-1.0, 0.2, 1.5]), r.integers(0, 4, 30)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def likelihood(i, score, t):
        above = [1.0, *(sigmoid(score[i] - x) for x in t), 0.0]
        return np.log(above[grade[i]] - above[grade[i] + 1])

    by_score, by_threshold = toxicity.slopes(score, thresholds, grade)
    for i in range(30):
        a, b = score.copy(), score.copy()
        a[i] += 1e-5
        b[i] -= 1e-5
        assert abs((likelihood(i, a, thresholds) - likelihood(i, b, thresholds)) / 2e-5 - by_score[i]) < 1e-6
    for k in range(3):
        a, b = thresholds.copy(), thresholds.copy()
        a[k] += 1e-5
        b[k] -= 1e-5
        assert abs(sum(likelihood(i, score, a) - likelihood(i, score, b) for i in range(30)) / 2e-5 - by_threshold[k]) < 1e-5


def test_grades_against_plain_sums(spark, docs, labels):
    model = toxicity.train(docs, labels)
    rows = docs.limit(60).collect()
    for r, got in zip(rows, toxicity.grade(docs.sparkSession.createDataFrame(rows, docs.schema).coalesce(1), model).collect(), strict=True):
        times = {}
        for w in "".join(c if c.isalpha() else " " for c in r.text.lower()).split():
            for x in [w] + [w[:n] + "-" for n in (4, 5, 6, 7) if len(w) > n]:
                if x in model.places:
                    times[x] = times.get(x, 0) + 1
        value = sum(model.weights[model.places[x]] * np.log(1 + n) for x, n in times.items())
        assert got.severity == pytest.approx(sum(1 / (1 + np.exp(t - value)) for t in model.thresholds), abs=1e-9)


def test_words_tell_passages_apart():
    """Texts of the same shape, told apart by their words alone."""
    r = random.Random(1)
    good, bad = ["aabb", "ccdd", "eeff"], ["ghgh", "ijij", "klkl"]
    texts = [" ".join(r.choices(good if i % 2 else bad, k=40)) for i in range(80)]
    x, begins = quality_mil._bags(texts)
    model = quality_mil.fit(x, begins, np.arange(80) % 2 * 1.0, epochs=60)
    assert ((model.scores(x, begins) > 0.5) == (np.arange(80) % 2 == 1)).all()
