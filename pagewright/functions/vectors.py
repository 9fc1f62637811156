"""Deterministic subword vectors and cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 128
#: Words whose vectors a worker keeps, about; 30 MB.
REMEMBERED = 30_000
#: Texts are taken together until they have so many words.
TOGETHER = 10_000
# The constants of 64-bit FNV-1a and of the finalizer that mixes its result.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x00000100000001B3
FINAL_1 = 0xFF51AFD7ED558CCD
FINAL_2 = 0xC4CEB9FE1A85EC53
# What a word and its 3- and 4-grams weigh.
WORD_WEIGHT, THREE_WEIGHT, FOUR_WEIGHT = 2.0, 1.0, 1.2


def hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The mixed FNV-1a hashes of some stretches of bytes, all stretches a byte at a time; longer ones come last, so each step takes the rest of them."""
    order = np.argsort(size, kind="stable")
    at, ends = start[order], np.searchsorted(size[order], np.arange(int(size.max()) + 1) if len(size) else [0], "right")
    h = np.full(len(start), FNV_OFFSET, np.uint64)
    for k in range(len(ends) - 1):
        first = ends[k]
        h[first:] = (h[first:] ^ raw[at[first:] + k]) * np.uint64(FNV_PRIME)
    h ^= h >> np.uint64(33)
    h *= np.uint64(FINAL_1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(FINAL_2)
    h ^= h >> np.uint64(33)
    out = np.empty_like(h)
    out[order] = h
    return out


def word_vectors(words: list[str], dimension: int) -> np.ndarray:
    """The vectors of single words, not normalised."""
    if not words:
        return np.zeros((0, dimension))
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    chars = np.array([len(w) for w in words], np.int64)
    # where each character begins, and the end
    begin = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))
    first = np.cumsum(chars) - chars
    owner, start, size, weight = [np.arange(len(words))], [begin[first]], [begin[first + chars] - begin[first]], [np.full(len(words), WORD_WEIGHT)]
    word = np.repeat(np.arange(len(words)), chars)
    left = (first + chars)[word] - np.arange(len(word))
    for n, x in ((3, THREE_WEIGHT), (4, FOUR_WEIGHT)):
        at = np.flatnonzero(left >= n)
        owner.append(word[at])
        start.append(begin[at])
        size.append(begin[at + n] - begin[at])
        weight.append(np.full(len(at), x))
    h = hashes(raw, np.concatenate(start), np.concatenate(size))
    signed = np.where(h >> np.uint64(63) == 0, 1.0, -1.0) * np.concatenate(weight)
    place = np.concatenate(owner) * dimension + (h % np.uint64(dimension)).astype(np.int64)
    return np.bincount(place, signed, len(words) * dimension).reshape(len(words), dimension)


class WordTable:
    """The vectors of words met so far; forgotten when there are more than REMEMBERED."""

    def __init__(self, dimension: int):
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, dimension))

    def places(self, words: list[str]) -> np.ndarray:
        """Where the rows of some words are."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        while len(self.rows) < len(self.known) + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(new), 2000):
            part, first = new[at : at + 2000], len(self.known)
            self.rows[first : first + len(part)] = word_vectors(part, self.rows.shape[1])
            self.known.update(zip(part, range(first, first + len(part)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def embed_texts(texts: list[str | None], dimension: int = DIMENSION, table: WordTable | None = None) -> np.ndarray:
    """A vector of length 1 for each text (zeros without words). Words are looked up for several texts together."""
    table = table or WordTable(dimension)
    out = np.zeros((len(texts), dimension))
    some: list[str] = []
    ends = [0]

    def add(first: int) -> None:
        places = table.places(some)
        for i, (a, z) in enumerate(zip(ends, ends[1:])):
            if a < z:
                own, times = np.unique(places[a:z], return_counts=True)
                out[first + i] = times @ table.rows[own]

    for i, t in enumerate(texts):
        some += (t or "").lower().split()
        ends.append(len(some))
        if len(some) >= TOGETHER or i + 1 == len(texts):
            add(i + 2 - len(ends))
            some, ends = [], [0]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def embedding(dimension: int = DIMENSION):
    """A pandas function from texts to vectors."""
    dimension = max(dimension, 64)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = WordTable(dimension)
        for texts in batches:
            yield pd.Series(list(embed_texts(texts.tolist(), dimension, table).astype(np.float32)))

    return embed


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, y: s + y)


def norm(a: Column) -> Column:
    """The length of a vector."""
    return F.sqrt(_total(F.transform(a, lambda y: y.cast("double") * y.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity between 0 and 1; 0 for empty vectors or different lengths. Lengths that are known already needn't be taken anew for each pair."""
    dot = _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot / F.greatest(size, F.lit(1e-9))))).otherwise(F.lit(0.0))
