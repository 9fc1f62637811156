"""Removal of long byte strings that occur more than once, by a distributed sort of suffixes.

A string of LENGTH bytes at one place is a window. A byte goes if it lies in a window whose string starts anywhere else too.

1. Each window has an anchor: the place of its smallest hash of a gram (145 bytes of 400; the leftmost, if several). Equal windows have their anchors at equal
   distances, and about one place in 128 is an anchor. An anchor whose gram occurs once can't lie in a repeated window; these go at once, which leaves the parts of
   the corpus that are repeated or nearly so.
2. The windows of one anchor are neighbours and together a span. Spans with equal contents are counted as one; a span that occurs twice is repeated
   from end to end.
3. What is left are grams with several different spans. Blocks of 32 neighbouring windows share a core of LENGTH - 31 bytes. Cores whose hash is unique
   go. The suffixes that start with the others are sorted: sampled splitters deal them to ranges by their leading bytes, each range is sorted by multikey
   quicksort over 8-byte words, and equal neighbours are found; the different windows of runs that touch the edge of a range are compared across ranges by a grouping.
   Within a run of equal cores a window is told by the 31 bytes that it has beside its core.

Nothing depends on how often a string occurs: counts are pre-aggregated, rows of very frequent keys stay where they are, and a core that fills many ranges is
grouped again by its different windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, ByteHashes, holding, hot_join, mixed, released, stored, text_pieces, unused

LENGTH = 400
#: Bytes of a repeated passage that is told of though it needn't go: few stretches of more than fifty words are shorter.
PASSAGE = 256
#: Windows to a block.
BLOCK = 32
_BESIDE = BLOCK - 1


@dataclass(frozen=True)
class Shape:
    """The bytes of a window and what follows from them: an anchor lies less than reach bytes behind its window's start."""

    length: int = LENGTH

    def __post_init__(self):
        if self.length < 160:
            raise ValueError("windows have at least 160 bytes")

    @property
    def reach(self) -> int:
        return 256 if self.length >= 384 else 128

    @property
    def gram(self) -> int:
        return self.length - self.reach + 1

    @property
    def core(self) -> int:
        return self.length - BLOCK + 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width values."""
    n = len(values)
    pad = -n % width
    full = np.concatenate([values, np.full(pad, np.iinfo(np.uint64).max, U64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    back = np.minimum.accumulate(full, axis=1).reshape(-1)
    return np.minimum(ahead[: n - width + 1], back[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(text, anchor, first window, last window, hash of the gram) for each anchor of some texts; places count from the start of data."""
    n = len(data)
    nothing = np.zeros(0, np.int64)
    if n < shape.length:
        return nothing, nothing, nothing, nothing, nothing
    grams = mixed(ByteHashes(data).of(slice(0, n - shape.gram + 1), slice(shape.gram, n + 1)))
    low = U64(31)  # bits for the place; the same for all pieces, as ties in the others must fall alike
    place = np.arange(len(grams), dtype=U64)
    least = sliding_least((grams >> low << low) | place, shape.reach)
    anchor = (least & ((U64(1) << low) - U64(1))).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), side="right") - 1
    start = np.flatnonzero(offsets[text + 1] >= np.arange(len(anchor)) + shape.length)
    if not len(start):
        return nothing, nothing, nothing, nothing, nothing
    anchor, text = anchor[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(start)]]) - 1
    return text[new], anchor[new], start[new], start[last], grams[anchor[new]].view(np.int64)


def _anchors(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """place packs the first window's start, the anchor's distance from it and the number of further windows."""
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch.column("data")):
                text, anchor, first, last, gram = anchors(data, offsets, shape)
                if not len(text):
                    continue
                view = memoryview(np.ascontiguousarray(data))
                span = [xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(first.tolist(), (last + shape.length).tolist(), strict=True)]
                place = ((first - offsets[text]) << 16) | ((anchor - first) << 8) | (last - first)
                own = [batch.column(c).slice(a, b - a).take(pa.array(text)) for c in _ROW]
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(np.array(span, U64).view(np.int64)), *own, pa.array(place)], ["gram", "span", *_ROW, "place"])

    return run


def _spans(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the spans of a text, with the anchor's distance from the first window; spans that aren't this text's own (hashes may collide) go."""
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = text.as_py()
                for s in spans.as_py():
                    start, distance, more = s["place"] >> 16, s["place"] >> 8 & 255, s["place"] & 255
                    bytes_ = data[start : start + more + shape.length]
                    if len(bytes_) == more + shape.length and xxhash.xxh3_64_intdigest(bytes_) == s["span"] & 0xFFFFFFFFFFFFFFFF:
                        for column, v in zip(out, (s["gram"], s["span"], distance, bytes_), strict=True):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["gram", "span", "distance", "data"])

    return run


def _blocks(distance: int, windows: int) -> range:
    """The blocks of window distances that a span has part in: its windows have distances from distance - windows + 1 to distance."""
    return range((distance - windows + 1) // BLOCK, distance // BLOCK + 1)


def _core_hashes(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for gram, span, distance, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "distance", "data")), strict=True):
                for k in _blocks(distance, len(data) - shape.length + 1):
                    start = distance - k * BLOCK  # of the core: the block's latest window
                    for column, v in zip(out, (gram, span, k, xxhash.xxh3_64_intdigest(data[start : start + shape.core]) - (1 << 63)), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64())], ["gram", "span", "block", "hash"])

    return run


def _cut_cores(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block: its core, what stands before and after it (filled up with zeros where the text ends), and the windows of the block that the span has."""
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for gram, span, distance, data, blocks in zip(*(batch.column(c).to_pylist() for c in ("gram", "span", "distance", "data", "blocks")), strict=True):
                for k in blocks:
                    start = distance - k * BLOCK
                    before = data[max(0, start - _BESIDE) : max(0, start)].rjust(_BESIDE, b"\0")
                    after = data[start + shape.core : start + shape.core + _BESIDE].ljust(_BESIDE, b"\0")
                    least = max(0, distance - (len(data) - shape.length) - k * BLOCK)
                    most = min(BLOCK - 1, distance - k * BLOCK)
                    for column, v in zip(out, (gram, span, k, least, most, data[start : start + shape.core], before + after), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["gram", "span", "block", "least", "most", "core", "beside"])

    return run


def multikey_quicksort(words: np.ndarray, small: int = 32) -> np.ndarray:
    """The order of rows of 64-bit words, compared word by word from the left: three-way partition at one word, then the next word for the equal part."""
    order = np.empty(len(words), np.int64)
    todo = [(np.arange(len(words)), 0, 0)]  # rows, the word they are parted by, where they begin in the order
    width = words.shape[1]
    while todo:
        rows, depth, at = todo.pop()
        if not len(rows):
            continue
        if len(rows) <= small or depth == width:
            if depth < width:
                rows = np.array(sorted(rows.tolist(), key=lambda r: words[r, depth:].tolist()))
            order[at : at + len(rows)] = rows
            continue
        here = words[rows, depth]
        pivot = np.partition(here, len(here) // 2)[len(here) // 2]
        less, equal = here < pivot, here == pivot
        a, b = int(less.sum()), int(equal.sum())
        todo += [(rows[less], depth, at), (rows[equal], depth + 1, at + a), (rows[~(less | equal)], depth, at + a + b)]
    return order


def _as_words(values: list[bytes], width: int) -> np.ndarray:
    whole = -(-width // 8) * 8
    return np.frombuffer(b"".join(v.ljust(whole, b"\0") for v in values), ">u8").reshape(len(values), whole // 8)


def _repeated_windows(run: np.ndarray, beside: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For rows with cores of the given runs: a bit for each window (by its distance within the block) that another row of the run has too."""
    bits = np.zeros(len(run), np.int64)
    for d in range(BLOCK):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if len(rows) < 2:
            continue
        key = np.zeros((len(rows), 5), np.uint64)
        key[:, 0] = run[rows]
        key[:, 1:].view(np.uint8).reshape(len(rows), 32)[:, :_BESIDE] = beside[rows][:, _BESIDE - d : 2 * _BESIDE - d]
        _, which, count = np.unique(key.view("V40").reshape(-1), return_inverse=True, return_counts=True)
        bits[rows[count[which] > 1]] |= 1 << d
    return bits


#: What tells rows apart: doc_id, a hash of the text (a doc_id may repeat or be null), and where in it the bytes begin.
_ROW = ["doc_id", "row", "base"]
_ROW_DDL = "doc_id long, row long, base long"
_SORTED = "gram long, span long, block int, bits long, key binary, single boolean"


def _edge_keys(rows: np.ndarray, run: np.ndarray, cores: pa.ChunkedArray, beside: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, int]]:
    """(row, digest, whether no other row of these has it, distance) for each distinct window among some rows with few different cores."""
    named = {r: xxhash.xxh3_128_digest(cores[int(rows[i])].as_py()) for r, i in zip(*np.unique(run[rows], return_index=True), strict=True)}
    for d in range(BLOCK):
        here = rows[(least[rows] <= d) & (d <= most[rows])]
        if not len(here):
            continue
        key = np.zeros((len(here), 5), np.uint64)
        key[:, 0] = run[here]
        key[:, 1:].view(np.uint8).reshape(len(here), 32)[:, :_BESIDE] = beside[here][:, _BESIDE - d : 2 * _BESIDE - d]
        _, first, count = np.unique(key.view("V40").reshape(-1), return_index=True, return_counts=True)
        at = here[first]
        yield at, [xxhash.xxh3_128_digest(named[run[i]] + bytes([d]) + beside[i, _BESIDE - d : 2 * _BESIDE - d].tobytes()) for i in at], count == 1, d


def _sort_range(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorts the suffixes of a range: (gram, span, block, bits) for blocks with windows that the range has twice. Its first and last run may go on in other
        ranges: each of their different windows comes out once, by a key, with one place of it and whether that is its only one here."""
        tables = [b for b in batches if len(b)]
        if not tables:
            return
        table = pa.Table.from_batches(tables)
        words = _as_words(table.column("core").to_pylist(), shape.core)
        order = multikey_quicksort(words)
        ranked = words[order]
        run = np.concatenate([[0], np.cumsum((ranked[1:] != ranked[:-1]).any(axis=1))])
        table = table.take(pa.array(order))
        least, most = table.column("least").to_numpy(), table.column("most").to_numpy()
        beside = np.frombuffer(b"".join(table.column("beside").to_pylist()), np.uint8).reshape(len(table), 2 * _BESIDE)
        bits = _repeated_windows(run, beside, least, most)
        names = ["gram", "span", "block", "bits", "key", "single"]
        own = table.select(["gram", "span", "block"]).combine_chunks()

        def rows(at: np.ndarray, bits: np.ndarray, key: list, single: list) -> Iterator[pa.RecordBatch]:
            part = own.take(pa.array(at))
            cols = [part.column(c).combine_chunks() for c in names[:3]]
            out = pa.Table.from_arrays([*cols, pa.array(bits, pa.int64()), pa.array(key, pa.binary()), pa.array(single, pa.bool_())], names)
            yield from out.to_batches(max_chunksize=10_000)

        decided = np.flatnonzero(bits)
        yield from rows(decided, bits[decided], [None] * len(decided), [None] * len(decided))
        edge = np.flatnonzero((run == 0) | (run == run[-1]))
        for at, key, single, d in _edge_keys(edge, run, table.column("core"), beside, least, most):
            yield from rows(at, np.full(len(at), 1 << d), key, single)

    return run


def _rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, data) for the texts of docs(doc_id, text)."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.lit(0).cast("long").alias("base"), F.coalesce(text.cast("binary"), F.lit(b"")).alias("data"))


def _same_row(a: DataFrame, b: DataFrame, names: list[str]):
    """A row with a null doc_id is a document too."""
    match = a["doc_id"].eqNullSafe(b["doc_id"])
    for c in names[1:]:
        match &= a[c] == b[c]
    return match


def repeated_windows(rows: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """(doc_id, row, base, spans: array of (place, span, bits)) for those of rows(doc_id, row, base, data) that have anchors in repeated strings.

    bits has, for each window of the span from the last to the first, whether its string starts elsewhere too (null: all of them). Rows with equal
    (doc_id, row, base) have equal data; each counts.
    """
    found = stored(rows.mapInArrow(_anchors(shape), f"gram long, span long, {_ROW_DDL}, place long"))
    n = found.count()
    often = stored(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"))
    shared = stored(hot_join(found, often, ["gram"], "n", n, "left_semi"))
    released(found, often)
    spans = stored(shared.groupBy("gram", "span").agg(F.count("*").alias("n"), F.min(F.struct(*_ROW, "place")).alias("at")))
    several = stored(spans.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1"))
    fetch = hot_join(spans, several, ["gram"], "k", spans.count(), "left_semi").select("at.doc_id", "at.row", "at.base", F.struct("gram", "span", F.col("at.place").alias("place")).alias("s"))
    fetch = fetch.groupBy(_ROW).agg(F.collect_list("s").alias("spans"))
    texts = rows.join(fetch, _same_row(rows, fetch, _ROW)).select(rows["data"], "spans")
    cut = stored(texts.mapInArrow(_spans(shape), "gram long, span long, distance int, data binary").dropDuplicates(["gram", "span"]))
    hashes = stored(cut.mapInArrow(_core_hashes(shape), "gram long, span long, block int, hash long"))
    twice = stored(hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1"))
    left = hot_join(hashes, twice, ["hash"], "n", hashes.count(), "left_semi").groupBy("gram", "span").agg(F.collect_list("block").alias("blocks"))
    cores = stored(cut.join(left, ["gram", "span"]).mapInArrow(_cut_cores(shape), "gram long, span long, block int, least int, most int, core binary, beside binary"))
    released(several, cut, hashes, twice)
    # the rest of the key only parts equal suffixes
    ranges = cores.repartitionByRange("core", "gram", "span")
    ranked = stored(ranges.mapInArrow(_sort_range(shape), _SORTED))
    released(cores)
    inside = ranked.filter("key IS NULL").select("gram", "span", "block", "bits")
    # a range sends a window once, so a key has at most as many rows as there are ranges
    edges = ranked.filter("key IS NOT NULL")
    again = edges.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    across = edges.filter("single").join(again, "key", "left_semi").select("gram", "span", "block", "bits")
    blocks = inside.union(across).groupBy("gram", "span", "block").agg(F.bit_or("bits").alias("bits"))
    parts = blocks.groupBy("gram", "span").agg(F.collect_list(F.struct("block", "bits")).alias("blocks"))
    decided = spans.join(parts, ["gram", "span"], "left").filter("n > 1 OR blocks IS NOT NULL").select("gram", "span", "n", F.when(F.col("n") == 1, F.col("blocks")).alias("blocks"))
    decided = stored(decided)
    out = hot_join(shared, decided, ["gram", "span"], "n", shared.count()).groupBy(_ROW).agg(F.collect_set(F.struct("place", "span", "blocks")).alias("spans"))
    out = stored(out)
    released(shared, spans, ranked, decided)
    return out


def _starts(data: bytes, spans: list[dict], shape: Shape) -> np.ndarray:
    """Where repeated windows start."""
    starts = np.zeros(max(0, len(data) - shape.length + 1), bool)
    for s in spans:
        start, distance, more = s["place"] >> 16, s["place"] >> 8 & 255, s["place"] & 255
        if start + more + shape.length > len(data) or xxhash.xxh3_64_intdigest(data[start : start + more + shape.length]) != s["span"] & 0xFFFFFFFFFFFFFFFF:
            continue  # of another text with this hash
        if s["blocks"] is None:
            starts[start : start + more + 1] = True
            continue
        for b in s["blocks"]:
            for d in range(BLOCK):
                if b["bits"] >> d & 1:
                    starts[start + distance - (b["block"] * BLOCK + d)] = True
    return starts


def _covered(data: bytes, spans: list[dict], shape: Shape) -> np.ndarray:
    """The bytes that lie in repeated windows."""
    change = np.zeros(len(data) + 1, np.int64)
    at = np.flatnonzero(_starts(data, spans, shape))
    change[at] += 1
    change[at + shape.length] -= 1
    return np.cumsum(change[:-1]) > 0


def _left(data: bytes, gone: np.ndarray | None) -> tuple[int, int, bytes]:
    """How many bytes go, in how many runs, and what is left."""
    if gone is None or not gone.any():
        return 0, 0, data
    return int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()


_DIGEST = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "n_passage": pa.int64()}
_DIGEST_DDL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long"


def _digest(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = text.as_py()
                removed, runs, left = _left(data, _covered(data, spans.as_py(), shape) if spans.is_valid else None)
                for column, v in zip(out, (len(data), removed, runs, hashlib.sha256(left).hexdigest()), strict=True):
                    column.append(v)
            passage = batch.column("n_passage") if "n_passage" in batch.schema.names else pa.array(out[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip((*out, passage), _DIGEST.values(), strict=True))], ["doc_id", *_DIGEST])

    return run


def _passages(shape: Shape, length: int):
    """What is known of a text from its repeated strings of shape.length bytes: the digest, if no string of length bytes can be repeated, or else its bytes and the
    runs (place, size) that such strings can lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for text, spans in zip(batch.column("data"), batch.column("spans"), strict=True):
                data = text.as_py()
                starts = _starts(data, spans.as_py(), shape) if spans.is_valid else np.zeros(0, bool)
                change = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
                pieces = [{"base": int(a), "size": int(b - a) + shape.length - 1} for a, b in change.reshape(-1, 2)]
                passage = sum(int(b - a) for a, b in _union([(p["base"], p["base"] + p["size"]) for p in pieces]))
                pieces = [p for p in pieces if p["size"] >= length]
                sha = None if pieces else hashlib.sha256(data).hexdigest()
                for column, v in zip(out, (len(data), 0, 0, sha, passage, data if pieces else None, pieces or None), strict=True):
                    column.append(v)
            kinds = [*_DIGEST.values(), pa.binary(), pa.list_(pa.struct([("base", pa.int64()), ("size", pa.int64())]))]
            own = [batch.column("doc_id"), batch.column("row")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], ["doc_id", "row", *_DIGEST, "data", "pieces"])

    return run


def _union(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted spans (start, end), without the parts that an earlier one has."""
    at = 0
    for a, b in spans:
        yield max(a, at), max(b, at)
        at = max(b, at)


def without_repeats(docs: DataFrame, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs(doc_id, text), and n_passage if passage is given; other columns are not read.

    A byte goes if a string of length bytes that covers it also starts anywhere else, in the same text or another; overlaps count, and strings are judged on
    the input. Every occurrence goes. n_passage counts, by the same rule, the bytes in repeated strings of passage bytes (at most length), which needn't go:
    shorter repeated passages are told, not removed. Null and short texts lose nothing (null: no bytes). Rows that repeat a
    doc_id are documents of their own, and so are rows without a doc_id. An empty table gives no rows.
    """
    rows = _rows_of(docs)
    shape = Shape(length)
    if passage is None or passage == length:
        spans = repeated_windows(rows, shape)
        both = rows.join(spans, _same_row(rows, spans, _ROW), "left").select(rows["doc_id"], rows["data"], "spans")
        out = both.mapInArrow(_digest(shape), f"doc_id long, {_DIGEST_DDL}")
        return holding(out if passage else out.drop("n_passage"), spans)
    if passage > length:
        raise ValueError("passages are at most as long as the strings that go")
    # equal strings of length bytes consist of equal strings of passage bytes, so only runs of these are searched for them
    short = Shape(passage)
    spans = repeated_windows(rows, short)
    both = rows.join(spans, _same_row(rows, spans, _ROW), "left").select(rows["doc_id"], rows["row"], rows["data"], "spans")
    known = stored(both.mapInArrow(_passages(short, length), f"doc_id long, row long, {_DIGEST_DDL}, data binary, pieces array<struct<base:long,size:long>>"))
    released(spans)
    open_ = known.filter("pieces IS NOT NULL")
    pieces = open_.select("doc_id", "row", "data", F.explode("pieces").alias("p")).select("doc_id", "row", "p.base", F.expr("substring(data, cast(p.base AS int) + 1, cast(p.size AS int)) AS data"))
    long = repeated_windows(pieces, shape)
    moved = long.select("doc_id", "row", F.expr("transform(spans, s -> struct(s.place + shiftleft(base, 16) AS place, s.span AS span, s.blocks AS blocks)) AS spans"))
    moved = moved.groupBy("doc_id", "row").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    both = open_.join(moved, _same_row(open_, moved, ["doc_id", "row"]), "left").select(open_["doc_id"], "data", "spans", "n_passage")
    closed = known.filter("pieces IS NULL").select("doc_id", *_DIGEST)
    return holding(closed.unionByName(both.mapInArrow(_digest(shape), f"doc_id long, {_DIGEST_DDL}")), known, long)


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of docs with all their columns, whatever their names; text has lost what without_repeats() removes, and code points that lost some of their bytes.

    Null texts stay null, empty and short ones as they are. Rows that repeat a doc_id, or have none, are documents of their own: their copies are repeats. An
    empty table gives no rows.
    """
    shape = Shape(length)
    own = {c: unused(c, docs) for c in ("own_id", "own_row", "own_spans")}
    spans = repeated_windows(_rows_of(docs), shape)
    named = spans.select(F.col("doc_id").alias(own["own_id"]), F.col("row").alias(own["own_row"]), F.col("spans").alias(own["own_spans"]))
    match = docs["doc_id"].cast("long").eqNullSafe(F.col(own["own_id"])) & (F.xxhash64(docs["text"].cast("string")) == F.col(own["own_row"]))
    both = docs.join(named, match, "left").drop(own["own_id"], own["own_row"])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, spans_ in enumerate(batch.column(batch.num_columns - 1)):
                if texts[i] and spans_.is_valid:
                    data = texts[i].encode()
                    removed, _, left = _left(data, _covered(data, spans_.as_py(), shape))
                    if removed:
                        texts[i] = left.decode(errors="ignore")
            cols = [pa.array(texts, batch.schema.field(i).type) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    return holding(both.mapInArrow(run, docs.schema), spans)
