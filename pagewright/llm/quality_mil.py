"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of up to 64 words; only the document has a label. Every passage becomes counts of its bytes' classes and of the steps
between classes, word lengths and repetitions, and of its words by a hash; a layer encodes it. Gated attention (a tanh and a sigmoid branch) gives each passage a weight, learned
from the document labels alone, and the weighted sum of the encodings is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ByteHashes, mixed, text_pieces
from .sampling import sample_labelled

PASSAGE_WORDS = 64
#: Labelled documents of each class that a model is fitted on, about.
PER_CLASS = 1500
THRESHOLD = 0.3
# classes of bytes: 0 lower-case letter, 1 capital, 2 digit, 3 space, 4 line feed, 5 sentence mark, 6 comma and the like, 7 bar, 8 quotes and brackets,
# 9 other sign, 10 control, 11 first byte of a longer character, 12 further byte
_CLASSES = 13
_CLASS = np.full(256, 9, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[46, 63]] = 5
_CLASS[[44, 58, 59, 45]] = 6
_CLASS[124] = 7
_CLASS[[34, 39, 40, 41, 91, 93, 123, 125]] = 8
_CLASS[[*range(9), 11, 12, *range(14, 32), 127]] = 10
_CLASS[192:] = 11
_CLASS[128:192] = 12
_SHAPES = 2 * _CLASSES + 8
#: Words of a passage are counted in so many classes, by a hash of their bytes.
WORD_CLASSES = 64
FEATURES = _SHAPES + WORD_CLASSES
_EXP = 40.0


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the passages of some texts, and for each text where its passages begin; a text without a word is one passage."""
    n_texts = len(offsets) - 1
    kind = _CLASS[data] if len(data) else np.zeros(0, np.uint8)
    space = (kind == 3) | (kind == 4)
    text_start = np.zeros(len(data) + 1, bool)
    text_start[offsets[:-1]] = True
    first = np.flatnonzero(~space & (np.concatenate([[True], space[:-1]]) | text_start[: len(data)]))
    last = np.flatnonzero(~space & (np.concatenate([space[1:], [True]]) | text_start[1 : len(data) + 1])) + 1
    if len(last) < len(first):
        last = np.append(last, len(data))
    word_text = np.searchsorted(offsets, first, side="right") - 1
    before = np.searchsorted(word_text, np.arange(n_texts))  # first word of each text
    counts = np.diff(np.append(before, len(first)))
    per_text = np.maximum(1, -(-counts // PASSAGE_WORDS))
    begins = np.concatenate([[0], np.cumsum(per_text)])
    word_passage = begins[word_text] + (np.arange(len(first)) - before[word_text]) // PASSAGE_WORDS
    n = int(begins[-1])
    # bytes go with the last passage that has begun in their text
    new = np.flatnonzero(np.concatenate([[True], word_passage[1:] != word_passage[:-1]])) if len(first) else np.zeros(0, np.int64)
    starts = np.empty(n, np.int64)
    starts[begins[:-1]] = offsets[:-1]
    inner = word_passage[new] if len(first) else new
    later = ~np.isin(inner, begins[:-1])
    starts[inner[later]] = first[new[later]]
    size = np.diff(np.append(starts, len(data)))
    of = np.repeat(np.arange(n), size)
    out = np.zeros((n, FEATURES))
    total = np.maximum(1, size)[:, None]
    out[:, :_CLASSES] = np.bincount(of * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES) / total
    if len(data) > 1:
        step = (kind[1:] != kind[:-1]) & (of[1:] == of[:-1])
        out[:, _CLASSES : 2 * _CLASSES] = np.bincount(of[1:][step] * _CLASSES + kind[1:][step], minlength=n * _CLASSES).reshape(n, _CLASSES) / total
    if len(first):
        length = last - first
        words = np.bincount(word_passage, minlength=n)
        some = np.maximum(1, words)
        hashes = ByteHashes(data).of(first, last)
        seen = np.lexsort((hashes, word_passage))
        repeat = np.concatenate([[False], (hashes[seen][1:] == hashes[seen][:-1]) & (word_passage[seen][1:] == word_passage[seen][:-1])])
        extra = [
            np.bincount(word_passage, length, n) / some / 10,
            np.bincount(word_passage, length <= 3, n) / some,
            np.bincount(word_passage, length >= 12, n) / some,
            np.bincount(word_passage[seen], repeat, n) / some,
            np.bincount(word_passage, kind[last - 1] == 9, n) / some,
            np.bincount(word_passage, kind[first] == 1, n) / some,
            np.bincount(word_passage, (kind[first] == 1) & (kind[last - 1] == 1), n) / some,
            np.log1p(words) / 5,
        ]
        out[:, 2 * _CLASSES : _SHAPES] = np.stack(extra, axis=1)
        which = (mixed(hashes) % U64(WORD_CLASSES)).astype(np.int64)
        out[:, _SHAPES:] = np.bincount(word_passage * WORD_CLASSES + which, minlength=n * WORD_CLASSES).reshape(n, WORD_CLASSES) / some[:, None]
    return np.sqrt(out), begins


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, begins[:-1], axis=0)


class Model:
    """encode: tanh of a layer; attention: a softmax within the bag of w · (tanh(V h) * sigmoid(U h)); score: a sigmoid of the weighted encoding."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, spread: np.ndarray):
        self.weights, self.mean, self.spread = weights, mean, spread

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ p["encode"] + p["encode0"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.clip((t * g) @ p["w"], -_EXP, _EXP)
        size = np.diff(begins)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins[:-1]), size))
        a = e / np.repeat(_sums(e, begins), size)
        z = _sums(a[:, None] * h, begins)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["out"] + p["out0"], -_EXP, _EXP)))}

    def scores(self, x: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.forward(x, begins)["score"]


def slopes(model: Model, x: np.ndarray, begins: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """How the mean cross-entropy of some bags grows with each weight."""
    p, size = model.weights, np.diff(begins)
    f = model.forward(x, begins)
    d = (f["score"] - y) / len(y)
    g = {"out": f["z"].T @ d, "out0": d.sum()}
    dz = np.repeat(d[:, None] * p["out"], size, axis=0)
    da = (dz * f["h"]).sum(axis=1)
    de = f["a"] * (da - np.repeat(_sums(f["a"] * da, begins), size))
    tg = f["t"] * f["g"]
    g["w"] = tg.T @ de
    dtg = de[:, None] * p["w"]
    dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
    g["v"], g["u"] = f["h"].T @ dt, f["h"].T @ dg
    dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
    g["encode"], g["encode0"] = f["x"].T @ dh, dh.sum(axis=0)
    return g


def begun(x: np.ndarray, hidden: int, gate: int, r: np.random.Generator) -> Model:
    """A model with random weights for passages like x."""
    shape = {"encode": (x.shape[1], hidden), "encode0": (hidden,), "v": (hidden, gate), "u": (hidden, gate), "w": (gate,), "out": (hidden,), "out0": ()}
    p = {k: r.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k not in ("encode0", "out0") else np.zeros(s) for k, s in shape.items()}
    return Model(p, x.mean(axis=0), x.std(axis=0) + 1e-3)


def fit(x: np.ndarray, begins: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, epochs: int = 30, seed: int = 3) -> Model:
    """A model from the passages of bags with labels 0 and 1; the class priors of the sample are undone by weights given with y's mean left as it is."""
    r = np.random.default_rng(seed)
    model = begun(x, hidden, gate, r)
    p = model.weights
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    size = np.diff(begins)
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(order), 128):
            bags = order[at : at + 128]
            rows = np.concatenate([np.arange(begins[b], begins[b + 1]) for b in bags])
            g = slopes(model, x[rows], np.concatenate([[0], np.cumsum(size[bags])]), y[bags])
            step += 1
            for k in p:
                slope = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * slope
                v[k] = 0.999 * v[k] + 0.001 * slope**2
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    x, begins = [], [np.zeros(1, np.int64)]
    for _, _, data, offsets in text_pieces(pa.array(texts, pa.string())):
        f, b = passages(data, offsets)
        x.append(f)
        begins.append(b[1:] + begins[-1][-1])
    return np.concatenate(x), np.concatenate(begins)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from the labelled documents that aren't held out (null without any). labels has doc_id and quality; a doc_id with several labels counts with each."""
    own = held_out(labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")).filter("NOT held_out")
    rows = sample_labelled(docs, own, "quality", per_class)
    if not rows:
        return None
    x, begins = _bags([t for t, _ in rows])
    return fit(x, begins, np.array([q for _, q in rows], float))


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: whether crc32 of doc_id as text is divisible by 5 (false without a doc_id)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text), whole texts; other columns are not read.

    score is the probability of label 1 (0.5 without a model); null and empty texts are scored as one passage without words. predicted is 1 where score is at least
    threshold. Rows may repeat, and doc_id may be null. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("text")):
                got = shared.value.scores(*passages(data, offsets)) if shared.value else np.full(b - a, 0.5)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
