"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are hashed affixes, character n-grams and the word itself, and lexicon features: which languages have it among their frequent words.
Emission weights of these and transition weights between languages are learned by gradient ascent on the likelihood of label sequences; training
sequences are put together from stretches of several documents, so switches occur in them. Texts are labelled word by word with marginal probabilities
from the forward-backward recursions, and a text's language is the one with the largest sum of them.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import sample

HASHED = 1 << 15
#: Words of a sequence that is labelled at once, and how many further ones it reads on both sides, so that transitions hold across its borders too.
LENGTH = 64
MARGIN = 16
#: Labelled documents of each language that a model is fitted on, about.
PER_LANGUAGE = 250
#: Words that are in a language's lexicon at most.
LEXICON = 300
REMEMBERED = 200_000
_WIDTH = 40


def _numbers() -> str:
    """Character ranges of numbers that are no decimal digits (fractions, exponents, circled and Roman ones): Python's word characters have them, letters don't."""
    codes = [c for c in range(sys.maxunicode + 1) if chr(c).isnumeric() and not chr(c).isdecimal() and not chr(c).isalpha()]
    have = set(codes)
    starts, ends = [c for c in codes if c - 1 not in have], [c for c in codes if c + 1 not in have]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


#: Longer runs of letters, as where words are not parted by spaces, are successive words.
_WORD = re.compile(rf"[^\W\d_{_numbers()}]{{1,{_WIDTH - 2}}}")


def words(text: str | None) -> list[str]:
    """The runs of letters, in lower case, in pieces of at most 38."""
    return _WORD.findall(text.lower()) if text else []


_random = np.random.default_rng(411)
_PLACE = _random.integers(1, 1 << 62, _WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = _random.integers(1, 1 << 62, 16, dtype=np.uint64)


def features(words_: list[str]) -> np.ndarray:
    """Places in the weight table of the hashed features of some words, a row for each; HASHED stands for none.

    Words have at most 38 letters. Codes of all words are one matrix, so that n-grams are hashed in whole columns.
    """
    codes = np.frombuffer("".join(f"^{w}$".ljust(_WIDTH, "\0") for w in words_).encode("utf-32-le"), np.uint32).reshape(len(words_), _WIDTH).astype(np.uint64)
    size = np.array([len(w) for w in words_])[:, None] + 2

    def place(x: np.ndarray, tag: int) -> np.ndarray:
        x = (x + _TAG[tag]) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(49)).astype(np.int64) % HASHED

    out = [place((codes * _PLACE).sum(axis=1, dtype=np.uint64)[:, None], 0)]
    for n in (1, 2, 3):
        inside = np.arange(n) < size - 2
        out.append(place((np.where(inside, codes[:, 1 : n + 1], 0) * _PLACE[:n]).sum(axis=1, dtype=np.uint64)[:, None], n))
        last = np.take_along_axis(codes, np.maximum(size - 1 - np.arange(1, n + 1), 0), 1)
        out.append(place((np.where(inside, last, 0) * _PLACE[:n]).sum(axis=1, dtype=np.uint64)[:, None], 3 + n))
    for n in (2, 3):
        grams = sum(codes[:, i : _WIDTH - n + 1 + i] * _PLACE[i] for i in range(n))
        out.append(np.where(np.arange(_WIDTH - n + 1) + n <= size, place(grams, 6 + n), HASHED))
    return np.concatenate(out, axis=1)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (sequence, word, label) and expected transitions for emission scores of padded sequences; works in scaled probabilities."""
    n, width, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    local[np.arange(width)[None, :] >= lengths[:, None]] = 1.0
    move = np.exp(between - between.max())
    ahead, back = np.empty_like(local), np.empty_like(local)
    scale = np.empty((n, width))
    ahead[:, 0] = local[:, 0]
    scale[:, 0] = ahead[:, 0].sum(axis=1)
    ahead[:, 0] /= scale[:, :1]
    for t in range(1, width):
        x = (ahead[:, t - 1] @ move) * local[:, t]
        scale[:, t] = x.sum(axis=1)
        ahead[:, t] = x / scale[:, t, None]
    # padding stands after the last word and must not bear on it: the backward message begins anew there
    back[:, width - 1] = 1.0
    expected = np.zeros((labels, labels))
    for t in range(width - 2, -1, -1):
        inside = (t + 1 < lengths)[:, None]
        right = local[:, t + 1] * back[:, t + 1]
        x = right @ move.T / scale[:, t + 1, None]
        back[:, t] = np.where(inside, x, 1.0)
        expected += np.einsum("na,nb->ab", np.where(inside, ahead[:, t], 0.0), right / scale[:, t + 1, None]) * move
    marginals = ahead * back
    marginals /= marginals.sum(axis=2, keepdims=True)
    return marginals, expected


def marginals_of(scores: np.ndarray, lengths: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The marginals of forward_backward() alone, for scores laid out as (word, sequence, label): steps over words touch adjacent memory, in single precision."""
    width, n, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(between - between.max()).astype(scores.dtype)
    # padding adds nothing: all labels alike, and messages from behind begin anew at each sequence's last word
    ahead = np.empty_like(local)
    ahead[0] = local[0] / local[0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        x = (ahead[t - 1] @ move) * local[t]
        x /= x.sum(axis=1, keepdims=True)
        ahead[t] = x
    back = np.ones((n, labels), scores.dtype)
    turned = np.ascontiguousarray(move.T)
    for t in range(width - 2, -1, -1):
        back = (local[t + 1] * back) @ turned
        back /= back.sum(axis=1, keepdims=True)
        back[t + 1 >= lengths] = 1.0
        ahead[t] *= back
    ahead /= ahead.sum(axis=2, keepdims=True)
    return ahead


class Model:
    def __init__(self, labels: list[str], lexicon: dict[str, list[int]], weights: np.ndarray, between: np.ndarray):
        self.labels, self.lexicon, self.weights, self.between = labels, lexicon, weights, between
        self._known: dict[str, int] = {}
        self._rows = np.zeros((1024, len(labels)), np.float32)

    def __getstate__(self):
        return {"labels": self.labels, "lexicon": self.lexicon, "weights": self.weights, "between": self.between}

    def __setstate__(self, state):
        self.__init__(**state)

    def emissions(self, found: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = list(set(found).difference(known))
        while len(self._rows) < len(known) + len(new):
            self._rows = np.concatenate([self._rows, np.zeros_like(self._rows)])
        for at in range(0, len(new), 2000):
            part = new[at : at + 2000]
            first = len(known)
            known.update(zip(part, range(first, first + len(part)), strict=True))
            self._rows[first : first + len(part)] = self.weights[features(part)].sum(axis=1)
            for i, w in enumerate(part):
                for label in self.lexicon.get(w, ()):
                    self._rows[first + i] += self.weights[HASHED + 1 + label]
        return self._rows[np.fromiter(map(known.__getitem__, found), np.int64, len(found))]

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the marginal probabilities (word, label)."""
        if not any(texts):
            return [np.zeros((0, len(self.labels)))] * len(texts)
        sizes = np.array([len(t) for t in texts])
        flat = self.emissions([w for t in texts for w in t])
        starts = np.cumsum([0, *sizes[:-1]])
        # (first word, end) of each part of a text, and the same with the words around it
        parts = [(at, min(at + LENGTH, s + n), s, s + n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) for at in range(s, s + n, LENGTH)]
        first, end, low, high = np.array(parts).T
        begin = np.maximum(low, first - MARGIN)
        length = np.minimum(high, end + MARGIN) - begin
        width = LENGTH + 2 * MARGIN
        out = np.empty_like(flat)
        for a in range(0, len(begin), 512):
            b, n = begin[a : a + 512], length[a : a + 512]
            place = b[None, :] + np.arange(width)[:, None]
            got = marginals_of(flat[np.minimum(place, len(flat) - 1)], n, self.between)
            own = (place >= first[a : a + 512]) & (place < end[a : a + 512])
            out[place[own]] = got[own]
        return [out[s : s + n] for s, n in zip(starts, sizes, strict=True)]


def fit(rows: list[tuple[str, str]], steps: int = 160, seed: int = 7) -> Model:
    """A model from (text, language) rows."""
    labels = sorted({lang for _, lang in rows})
    if not rows:
        return Model([], {}, np.zeros((HASHED + 1, 0), np.float32), np.zeros((0, 0)))
    texts = [(words(t), labels.index(lang)) for t, lang in rows]
    counts = [Counter() for _ in labels]
    for w, k in texts:
        counts[k].update(w)
    lexicon: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon.setdefault(w, []).append(k)
    n = len(labels)
    weights, between = np.zeros((HASHED + 1 + n, n)), np.zeros((n, n))
    model = Model(labels, lexicon, weights, between)
    r = np.random.default_rng(seed)
    by = [[w for w, k in texts if k == label and w] for label in range(n)]
    by = [x if x else [[""]] for x in by]
    cache: dict[str, list[int]] = {}
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(between), np.zeros_like(between)]
    for step in range(1, steps + 1):
        batch, gold = [], []
        for _ in range(96):
            w, y = [], []
            while len(w) < LENGTH // 2:
                k = int(r.integers(n))
                own = by[k][int(r.integers(len(by[k])))]
                size = int(r.integers(4, 24))
                at = int(r.integers(max(1, len(own) - size)))
                w += own[at : at + size]
                y += [k] * len(own[at : at + size])
            batch.append(w[:LENGTH])
            gold.append(y[:LENGTH])
        lengths = np.array([len(w) for w in batch])
        places, rows_ = [], []
        new = list({word for w in batch for word in w}.difference(cache))
        for word, own in zip(new, features(new) if new else (), strict=True):
            cache[word] = [*own[own < HASHED].tolist(), *(HASHED + 1 + label for label in lexicon.get(word, ()))]
        for i, w in enumerate(batch):
            for t, word in enumerate(w):
                f = cache[word]
                places += f
                rows_ += [i * LENGTH + t] * len(f)
        places, rows_ = np.array(places), np.array(rows_)
        scores = np.stack([np.bincount(rows_, weights[places, k], len(batch) * LENGTH) for k in range(n)], axis=1).reshape(len(batch), LENGTH, n)
        got, expected = forward_backward(scores, lengths, between)
        inside = np.arange(LENGTH)[None, :] < lengths[:, None]
        truth, moves = np.zeros_like(got), np.zeros_like(between)
        for i, y in enumerate(gold):
            truth[i, np.arange(len(y)), y] = 1
            np.add.at(moves, (y[:-1], y[1:]), 1)
        slope = np.where(inside[:, :, None], truth - got, 0.0).reshape(-1, n)
        up = np.stack([np.bincount(places, slope[rows_, k], len(weights)) for k in range(n)], axis=1) - 1e-2 * weights
        up_between = moves - expected - 0.5 * between
        for x, g, m, v, rate in ((weights, up, moments[0], moments[1], 0.05), (between, up_between, moments[2], moments[3], 0.05)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, lexicon, weights.astype(np.float32), between)


def held_out(docs: DataFrame) -> DataFrame:
    """docs with held_out: whether crc32 of doc_id as text leaves 2 modulo 4 (false without a doc_id)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from documents with a language that aren't held out; rows without a doc_id are not learned from."""
    rows = held_out(docs.filter("doc_id IS NOT NULL")).filter("NOT held_out").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return fit(sample(rows, "lang", per_language))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of docs(doc_id, text), whole texts; other columns are not read.

    lang_pred is `und` with score 0 where a text is null or has no letter, or where no language was learned; score is the mean marginal probability of
    the predicted language over the words (ties: the first language in order). Rows may repeat. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                found = [words(t) for t in part.column("text").to_pylist()]
                lang, score = [], []
                for w, p in zip(found, m.marginals(found) if m.labels else [None] * len(found), strict=True):
                    if not w or not m.labels:
                        lang.append("und")
                        score.append(0.0)
                    else:
                        mean = p.mean(axis=0)
                        k = int(np.argmax(mean))
                        lang.append(m.labels[k])
                        score.append(min(1.0, float(mean[k])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = held_out(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(texts: list[str], model: Model) -> list[list[tuple[str, str, float]]]:
    """For each text, its words with the likeliest label and its probability: the labels of code-switched text."""
    found = [words(t) for t in texts]
    return [[(w, model.labels[int(k)], float(p[k])) for w, p, k in zip(ws, m, m.argmax(axis=1), strict=True)] if ws else [] for ws, m in zip(found, model.marginals(found), strict=True)]
