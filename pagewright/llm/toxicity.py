"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade > k) is a sigmoid of w · x - t[k]: one weight vector for all thresholds t[0] <= t[1] <= ..., so grades are ordered. x holds how often (as
log(1 + n)) a text has each selected word and word beginning; features are selected by how clearly their document frequency differs between rejected and
other documents. The output is the expected grade and its probabilities.

Labels that only say toxic or not are graded: 0 for others, 1 for toxic documents with fewer selected features of the toxic side than their median, and
2 for the rest. Labels with more than two values are grades already.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample_labelled

#: Labelled documents of each grade that a model is fitted on, about.
PER_CLASS = 2000
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6, 7)
#: Standard errors that a selected feature's shares are apart, and features at most.
CLEAR = 4.0
SELECTED = 3000
LEAST_DOCUMENTS = 5
REMEMBERED = 80_000
_WORD = re.compile(r"[^\W\d_]+")


def names(word: str) -> list[str]:
    """The features of a word: itself, and its beginnings, marked by a hyphen."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def counts(text: str | None) -> Counter:
    """How often a text has each word, in lower case."""
    return Counter(_WORD.findall(text.lower())) if text else Counter()


class Model:
    """Weights of the selected features, and thresholds; weights[i] belongs to the name with place i."""

    def __init__(self, places: dict[str, int], weights: np.ndarray, thresholds: np.ndarray):
        self.places, self.weights, self.thresholds = places, weights, thresholds
        self._known: dict[str, tuple[int, ...]] = {}

    def __getstate__(self):
        return {"places": self.places, "weights": self.weights, "thresholds": self.thresholds}

    def __setstate__(self, state):
        self.__init__(**state)

    def row(self, text: str | None) -> dict[int, float]:
        """The selected features of a text."""
        known, out = self._known, {}
        for word, n in counts(text).items():
            own = known.get(word)
            if own is None:
                if len(known) > REMEMBERED:
                    known.clear()
                own = known[word] = tuple(self.places[x] for x in names(word) if x in self.places)
            for i in own:
                out[i] = out.get(i, 0) + n
        return out

    def above(self, rows: list[dict[int, float]]) -> np.ndarray:
        """P(grade > k) for each row and threshold."""
        value = np.array([sum(self.weights[i] * np.log1p(n) for i, n in r.items()) for r in rows]).reshape(-1, 1)
        return 1 / (1 + np.exp(-np.clip(value - self.thresholds[None, :], -40, 40)))


def _clear(a: int, n: int, b: int, m: int) -> float:
    """The square root of the likelihood ratio of two shares, a of n and b of m: in standard errors, but right also where one of them is 0."""
    share = (a + b) / (n + m)
    cells = ((a, n * share), (n - a, n * (1 - share)), (b, m * share), (m - b, m * (1 - share)))
    return max(0.0, 2 * sum(x * np.log(x / e) for x, e in cells if x)) ** 0.5


def _select(texts: list[str], bad: np.ndarray) -> list[tuple[str, float]]:
    """The names whose document frequency tells the two sides apart most clearly, with their log odds.

    A first pass counts documents by a hash of the name, so that only names which can be in LEAST_DOCUMENTS of them are counted by themselves."""
    rough = np.zeros(1 << 22, np.uint32)
    place = lambda x: zlib.crc32(x.encode()) & ((1 << 22) - 1)
    for t in texts:
        rough[np.unique([place(x) for w in counts(t) for x in names(w)] or [0])] += 1
    frequency = [Counter(), Counter()]
    for t, y in zip(texts, bad, strict=True):
        frequency[int(y)].update({x for w in counts(t) for x in names(w) if rough[place(x)] >= LEAST_DOCUMENTS})
    n0, n1 = (~bad).sum() + 1, bad.sum() + 1
    found = []
    for x in set(frequency[0]) | set(frequency[1]):
        a, b = frequency[1][x] + 0.5, frequency[0][x] + 0.5
        if frequency[1][x] + frequency[0][x] < LEAST_DOCUMENTS:
            continue
        odds = np.log(a / (n1 - a + 1)) - np.log(b / (n0 - b + 1))
        clear = _clear(frequency[1][x], int(bad.sum()), frequency[0][x], int((~bad).sum()))
        if clear > CLEAR:
            found.append((-clear, x, odds))
    return [(x, odds) for _, x, odds in sorted(found)[:SELECTED]]


def slopes(score: np.ndarray, thresholds: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the log-likelihood of each row's grade grows with its score, and that of all rows with each threshold."""
    cum = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -40, 40)))
    # likelihood of the grade itself: the difference of neighbouring cumulative probabilities
    edge = np.ones((len(score), 1))
    upper, lower = np.concatenate([edge, cum], axis=1), np.concatenate([cum, 0 * edge], axis=1)
    here = np.maximum(np.take_along_axis(upper - lower, grade[:, None], 1)[:, 0], 1e-9)
    slope, dens, rows = np.zeros_like(cum), cum * (1 - cum), np.arange(len(score))
    has = grade > 0
    slope[rows[has], grade[has] - 1] += dens[rows[has], grade[has] - 1] / here[has]
    has = grade < len(thresholds)
    slope[rows[has], grade[has]] -= dens[rows[has], grade[has]] / here[has]
    return slope.sum(axis=1), -slope.sum(axis=0)


def fit(rows: list[tuple[str, int]], steps: int = 1200) -> Model:
    """A model from (text, label) rows, with at least two labels."""
    texts = [t for t, _ in rows]
    label = np.array([y for _, y in rows])
    chosen = _select(texts, label > 0)
    places = {x: i for i, (x, _) in enumerate(chosen)}
    model = Model(places, np.zeros(len(places)), np.zeros(1))
    found = [model.row(t) for t, _ in rows]
    worse = {i for i, (_, odds) in enumerate(chosen) if odds > 0}
    if label.max() <= 1:
        load = np.array([sum(n for i, n in r.items() if i in worse) for r in found])
        middle = np.median(load[label > 0])
        label = np.where(label > 0, 1 + (load >= max(middle, 1)), 0)
    levels = np.unique(label)
    grade = np.searchsorted(levels, label)
    top = len(levels) - 1
    at = np.array([k for k, r in enumerate(found) for _ in r], np.int64)
    place = np.array([i for r in found for i in r], np.int64)
    value = np.log1p(np.array([n for r in found for n in r.values()], float))
    weights, thresholds = model.weights, np.array([np.log((np.mean(grade <= k) + 1e-3) / (np.mean(grade > k) + 1e-3)) for k in range(top)])
    m = [np.zeros_like(weights), np.zeros_like(thresholds)]
    v = [np.zeros_like(weights), np.zeros_like(thresholds)]
    for step in range(1, steps + 1):
        by_score, by_threshold = slopes(np.bincount(at, weights[place] * value, len(found)), thresholds, grade)
        g = [np.bincount(place, by_score[at] * value, len(weights)) / len(found) - 1e-6 * weights, by_threshold / len(found)]
        for x, d, a, b in zip((weights, thresholds), g, m, v, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            x += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        thresholds.sort()
    return Model(places, weights, thresholds)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from labelled documents; labels has doc_id and toxic (0: not toxic). None if fewer than two labels occur."""
    rows = sample_labelled(docs, labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic >= 0"), "toxic", per_class)
    return fit(rows) if len({y for _, y in rows}) > 1 else None


def grade(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic) for each row of docs(doc_id, text), whole texts; other columns are not read.

    severity is the expected grade, p_toxic the probability of a grade above 0, grade the likeliest one, and toxic whether p_toxic reaches threshold.
    Null and empty texts have no features and are graded by the thresholds alone. Without a model all are 0. Rows may repeat, and doc_id may be null.
    An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                above = m.above([m.row(t) for t in part.column("text").to_pylist()]) if m else np.zeros((len(part), 1))
                each = np.concatenate([np.ones((len(part), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(part), 1))], axis=1)
                cols = [part.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0].copy()), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(above[:, 0] >= threshold)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, whose text is not toxic by grade().

    Null and empty texts have no features, so they stay unless the thresholds alone make everything toxic. Without a model all rows stay. Rows that repeat
    are judged each by itself, and doc_id is not read. An empty table gives no rows.
    """
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None:
                yield batch
                continue
            texts = batch.column(at).cast(pa.string())
            keep = np.concatenate([m.above([m.row(t) for t in texts.slice(a, 500).to_pylist()])[:, 0] < threshold for a in range(0, len(batch), 500)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
