"""Token counts of documents from the frequencies of their pre-tokens.

Blocks of documents are split into pre-tokens once; a block keeps its vocabulary, and for each document which entries it has and how often, packed. The
entries of all blocks meet by pre-token, where each distinct pre-token is encoded once to count its pieces; the counts return to their blocks, and a
document's tokens are the sum of its frequencies times these counts. No list of token ids is made, and what moves is a row for each pre-token of a block,
not for each one of a document.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import holding, stored

#: Bytes of text that make a block (it ends with the document that reaches them).
BLOCK_BYTES = 32 << 20
#: Counts that a task gathers before it sends them to their blocks.
SENT_ROWS = 2_000_000
_FREQUENCIES = "block long, doc_ids array<long>, n_bytes array<long>, packed binary, vocabulary array<string>"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: str, pattern: regex.Pattern, special: regex.Pattern | None) -> list[str]:
    """The pre-tokens of a text; strings of special tokens are pre-tokens of their own."""
    if special is None or not special.search(text):
        return pattern.findall(text)
    out, at = [], 0
    for m in special.finditer(text):
        out += pattern.findall(text[at : m.start()])
        out.append(m[0])
        at = m.end()
    return out + pattern.findall(text[at:])


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses well if most are small."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view(np.uint32).reshape(-1).astype(np.int64)


def _steps(values: np.ndarray) -> np.ndarray:
    """Ascending numbers as the first one and differences."""
    return np.diff(values, prepend=0)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(map(_planes, arrays)))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, k, 8).tolist(), 8 + 8 * k, []
    for n in sizes:
        out.append(_from_planes(raw, at, n))
        at += 4 * n
    return out


class _Block:
    def __init__(self):
        self.doc_ids, self.n_bytes, self.sizes = [], [], []
        self.entries, self.times = [], []
        self.vocabulary: dict[str, int] = {}
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, counts: Counter) -> None:
        v = self.vocabulary
        self.doc_ids.append(doc_id)
        self.n_bytes.append(n := len(text.encode()))
        self.bytes += n
        self.sizes.append(len(counts))
        entries = np.array([v.setdefault(p, len(v)) for p in counts], np.int64)
        order = np.argsort(entries)
        self.entries.append(_steps(entries[order]))
        self.times.append(np.fromiter(counts.values(), np.int64, len(counts))[order])

    def packed(self) -> bytes:
        """Numbers of distinct pre-tokens of the documents, their places in the vocabulary as steps, and how often they occur. Places follow first occurrence, so frequent pre-tokens have small ones."""
        return _pack(np.array(self.sizes), np.concatenate(self.entries), np.concatenate(self.times))

    def row(self) -> pa.RecordBatch:
        key = uuid.uuid4().int >> 65
        cols = [pa.array([key], pa.int64()), pa.array([self.doc_ids], pa.list_(pa.int64())), pa.array([self.n_bytes], pa.list_(pa.int64())), pa.array([self.packed()], pa.binary()), pa.array([list(self.vocabulary)], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(cols, ["block", "doc_ids", "n_bytes", "packed", "vocabulary"])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the documents, and entries and times of all of them in a row."""
    sizes, steps, times = _unpack(data)
    sums = np.concatenate([[0], np.cumsum(steps)])
    starts = np.cumsum(sizes) - sizes
    return sizes, sums[1:] - np.repeat(sums[starts], sizes), times


def _split(pattern: str, specials: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(pattern)
        special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                block.add(doc_id, text, Counter(pre_tokens(text, words, special)))
                if block.bytes >= BLOCK_BYTES:
                    yield block.row()
                    block = _Block()
        if block.doc_ids:
            yield block.row()

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        last, n = None, 0  # rows are sorted: a pre-token's rows stand together, also over the end of a batch
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            block, entry, pieces = (np.concatenate(c) for c in zip(*waiting, strict=True))
            order = np.lexsort((entry, block))
            block, entry, pieces = block[order], entry[order], pieces[order]
            new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            rows = [_pack(_steps(entry[a:b]), pieces[a:b]) for a, b in zip(new, [*new[1:], len(block)], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[new]), pa.array(rows, pa.binary())], ["block", "counts"])

        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            new = [p for p, before in zip(pieces, [last, *pieces[:-1]], strict=True) if p != before]
            counts = []
            for at in range(0, len(new), 2000):
                counts += [len(e.ids) for e in tokenizer.encode_batch(new[at : at + 2000], add_special_tokens=False)]
            counts = iter(counts)
            out = np.empty(len(pieces), np.int64)
            for i, p in enumerate(pieces):
                if p != last:
                    last, n = p, next(counts)
                out[i] = n
            waiting.append((batch.column("block").to_numpy(), batch.column("entry").to_numpy(), out))
            if sum(len(w[0]) for w in waiting) > SENT_ROWS:
                yield packed()
                waiting.clear()
        if waiting:
            yield packed()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_ids, n_bytes, packed, counts in zip(*(batch.column(c) for c in ("doc_ids", "n_bytes", "packed", "counts")), strict=True):
            sizes, entries, times = _unpacked(packed.as_py())
            of = np.zeros(int(entries.max()) + 1 if len(entries) else 0, np.int64)
            for c in counts.as_py() or ():
                steps, pieces = _unpack(c)
                of[np.cumsum(steps)] = pieces
            total = np.concatenate([[0], np.cumsum(of[entries] * times)])
            ends = np.cumsum(sizes, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([doc_ids.values, n_bytes.values, pa.array(total[ends] - total[ends - sizes])], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512, specials: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text): tokens of the whole text under the byte-level BPE of a tokenizers file.

    path is the .json file, which each executor can open, and pattern what it splits texts with before the merges; specials are the strings of its added
    tokens, each of which is one token wherever it stands. No tokens are added and nothing is cut off. A null text counts as empty, with no tokens.
    Rows may repeat and doc_id may be null; other columns are not read. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stored(docs.mapInArrow(_split(pattern, specials or []), _FREQUENCIES))
    entries = blocks.select("block", F.posexplode("vocabulary").alias("entry", "piece"))
    counted = entries.repartition("piece").sortWithinPartitions("piece").mapInArrow(_count(path), "block long, counts binary")
    back = counted.groupBy("block").agg(F.collect_list("counts").alias("counts"))
    sums = blocks.drop("vocabulary").join(back, "block", "left").mapInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
    return holding(sums.withColumn("over_limit", F.col("n_tokens") > limit), blocks)


def added_tokens(path: str) -> list[str]:
    """The strings of the added tokens of a tokenizers file."""
    import json

    with open(path) as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]
