"""Byte-level BPE: encoding and decoding without merge loops.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds every token in a piece of text in one pass. From each
place the longest token is tried first; a token may follow another only if the merges, run on the two tokens' bytes together, would leave exactly these
two. That compatibility of neighbours is worked out from the merge that made each token and memoised. Where no token fits, the last one is taken back and
its place is marked, so no place fails twice: the work is linear in the piece. The result is that of merging by rank.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces and neighbours that a worker remembers before it forgets all of them.
REMEMBERED = 80_000


class Encoder:
    """Token ids of bytes under the ranks of a .tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.length = [len(b) for b in self.bytes]
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, np.ndarray] = {}
        self.parts = [(i, i) for i in range(size)]
        reachable = []
        for b, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(b) == 1 or self._made(b, i):
                reachable.append(i)
        self._fits.clear()
        self.automaton = ahocorasick.Automaton()
        there = {self.bytes[i] for i in reachable}
        self.shorter = [-1] * size  # the longest token that begins another one
        for i in reachable:
            b = self.bytes[i]
            self.automaton.add_word(b.decode("latin-1"), i)
            self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in there), -1)
        self.automaton.make_automaton()

    def _made(self, b: bytes, i: int) -> bool:
        """Finds the two tokens whose merge makes token i; false if the merges never make it."""
        for n in range(1, len(b)):
            x, y = self.ranks.get(b[:n], i), self.ranks.get(b[n:], i)
            if x < i and y < i and self._compatible(x, y, i):
                self.parts[i] = (x, y)
                return True
        return False

    def _compatible(self, x: int, y: int, limit: int) -> bool:
        """Whether the merges of ranks below limit keep the border between neighbours x and y: their merges are undone, latest first, to look for one across it."""
        while True:
            across = self.ranks.get(self.bytes[x] + self.bytes[y])
            if across is not None and across < limit:
                return False
            a, b = self.parts[x][1], self.parts[y][0]
            if x > y:
                if a != x:
                    limit, x = min(limit, x), a
                elif b != y:
                    limit, y = min(limit, y + 1), b
                else:
                    return True
            elif b != y:
                limit, y = min(limit, y + 1), b
            elif a != x:
                limit, x = min(limit, x), a
            else:
                return True

    def fits(self, x: int, y: int) -> bool:
        key = (x, y)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            known = self._fits[key] = self._compatible(x, y, 1 << 62)
        return known

    def piece(self, b: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        n = len(b)
        longest = [-1] * (n + 1)
        length = self.length
        for end, i in self.automaton.iter(b.decode("latin-1")):
            at = end + 1 - length[i]
            if longest[at] < 0 or length[longest[at]] < length[i]:
                longest[at] = i
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_[end] and (last < 0 or self.fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    out.pop()
                    at, token = at - length[last], last
                    break
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self._known, []
        for p in self.pattern.findall(text):
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[p] = tuple(self.piece(p.encode()))
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and where each begins."""
    with open(path, "rb") as f:
        tokens = dict((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
    rows = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs(doc_id, text): the token ids of the whole text, without special tokens, as merging by rank gives them.

    path is a .tiktoken rank file that each executor can open; each match of pattern is encoded on its own. A null or empty text has no ids. Rows may
    repeat and doc_id may be null; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                ids = [np.array(e.encode(t), np.int32) if t else np.zeros(0, np.int32) for t in part.column(1).to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of encoded(ids array<int>, ...) and decoded: the bytes of the tokens in a row. Null ids: null; an id that the file lacks stands for no bytes.

    Rows may repeat; no ids make no bytes. A column named decoded is replaced. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts = _vocabulary(path)
        tokens = [data[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for batch in batches:
            out = []
            for ids in batch.column("ids"):
                if not ids.is_valid:
                    out.append(None)
                    continue
                own = ids.values.to_numpy()
                out.append(b"".join([tokens[i] for i in own[(own >= 0) & (own < len(tokens))].tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructType

    return encoded.mapInArrow(run, StructType([*(f for f in encoded.schema.fields if f.name != "decoded"), *StructType().add("decoded", BinaryType()).fields]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids that encode() gives and the bytes that decode() makes of them again, as digests.

    Both run over a text in one go, so ids don't travel. Rows are as for encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        tokens, names = e.bytes, [str(i) for i in range(len(e.bytes))]
        for batch in batches:
            sizes, ids_digests, decoded = [], [], []
            for text in batch.column(1):
                ids = e.encode(text.as_py()) if text.is_valid else []
                sizes.append(len(ids))
                ids_digests.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join([tokens[i] for i in ids])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
