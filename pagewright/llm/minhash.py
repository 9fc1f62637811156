"""Near-duplicate documents by b-bit MinHash.

Every document becomes the set of its distinct word 5-grams. 128 minima over this set give 32 band keys of four minima each, and a signature that
retains only the low four bits of each minimum, packed into eight 64-bit words. Documents that share a band key are candidates; bit counts over the
packed signatures estimate their similarity, corrected for the chance of 1 in 16 that low bits agree by accident; candidates whose estimate is far
below the threshold go, and every other one is confirmed on the full sets.

No step lists all pairs of a bucket. First each member is compared with the bucket's smallest member only. Members that this leaves in different
groups are then compared by their signatures in blocks of bounded size, in the first bucket that two of them share; those that pass are compared by
longer signatures of 1024 minima, and only pairs that pass these too leave the block. So what leaves it are links and pairs close below the threshold.

A pair at the threshold of 0.75 shares no band key with a probability of (1 - 0.75**4)**32 = 5e-6, and fails one of the estimates (4.5 standard
deviations below the threshold) with one of 7e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, ByteHashes, held, holding, lists, mixed, released, sorted_groups, stored, text_pieces
from .components import components

WORDS = 5
MINIMA = 128
BAND_ROWS = 4
BITS = 4
#: Minima of the longer signatures that documents get which stay in question after the first comparison.
LONG_MINIMA = 1024
#: Rows of one side of a block in which signatures are compared.
BLOCK_ROWS = 1024
_LANES = MINIMA * BITS // 64
_random = np.random.default_rng(20240229)
_MULTIPLY = _random.integers(1, 1 << 63, LONG_MINIMA, dtype=U64) * U64(2) + U64(1)
_ADD = _random.integers(0, 1 << 63, LONG_MINIMA, dtype=U64)
_PLACE = _random.integers(1, 1 << 63, WORDS, dtype=U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text, the sorted distinct 64-bit hashes of its word 5-grams (of the whole text if it has fewer words)."""
    n = len(offsets) - 1
    low = np.empty(len(data) + 2, np.uint8)
    low[0] = low[-1] = 32
    low[1:-1] = _LOWER[data]
    space = _SPACE[low]
    first = np.flatnonzero(space[:-1] & ~space[1:])  # in data, where words begin
    last = np.flatnonzero(~space[:-1] & space[1:])
    # a word ends where the next text begins
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    inside = cuts[~space[cuts] & ~space[cuts + 1]]
    if len(inside):
        first, last = np.sort(np.concatenate([first, inside])), np.sort(np.concatenate([last, inside]))
    words = mixed(ByteHashes(low[1:-1]).of(first, last) + (last - first).astype(U64))
    of = np.searchsorted(first, offsets)  # word offsets of the texts
    grams = np.zeros(0, U64)
    if len(words) >= WORDS:
        grams = mixed(sum(words[i : len(words) - WORDS + 1 + i] * _PLACE[i] for i in range(WORDS)))
    out = []
    for i in range(n):
        a, b = int(of[i]), int(of[i + 1])
        if b - a >= WORDS:
            out.append(np.unique(grams[a : b - WORDS + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum(dtype=U64) + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """For each of some non-empty sets, the minima under n hash functions, mixed so that their low bits are as good as any."""
    grams = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((n, len(sets)), U64)
    for k in range(n):
        least[k] = np.minimum.reduceat(grams * _MULTIPLY[k] + _ADD[k], starts)
    return np.ascontiguousarray(mixed(least).T)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 16 to a word."""
    low = (least & U64((1 << BITS) - 1)).reshape(len(least), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=U64) * U64(BITS))).sum(axis=2, dtype=U64).view(np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows of 32) and packed low bits (rows of 8) of non-empty sets."""
    least = minima(sets, MINIMA)
    bands = least.reshape(len(sets), -1, BAND_ROWS)
    keys = mixed((bands * _PLACE[:BAND_ROWS]).sum(axis=2, dtype=U64) + np.arange(bands.shape[1], dtype=U64) * _ADD[0])
    return keys.view(np.int64), packed(least)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for a, b, data, offsets in text_pieces(texts):
            sets = shingle_sets(data, offsets)
            full = [s for s in sets if len(s)]
            keys, bits = signatures(full) if full else (np.zeros((0, MINIMA // BAND_ROWS), np.int64), np.zeros((0, _LANES), np.int64))
            there = np.array([len(s) > 0 for s in sets])
            at = np.where(there, np.cumsum(there) - 1, -1)
            take = pa.array(at, mask=~there)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(a, b - a),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pc.take(lists(bits), take),
                    pc.take(lists(keys), take),
                ],
                ["doc_id", "n_shingles", "set_key", "bits", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_pieces(batch.column(1)):
            sets = shingle_sets(data, offsets)
            offs = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offs), values)], ["id", "grams"])


def _long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 100):
            part = batch.slice(at, 100)
            bits = packed(minima([np.asarray(g.values).view(U64) for g in part.column("grams")], LONG_MINIMA))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists(bits)], ["id", "long"])


def _alike(x: np.ndarray, minima_: int) -> np.ndarray:
    """The estimate for signatures whose words differ by x (its last axis is used up)."""
    x |= x >> U64(1)
    x |= x >> U64(2)
    differ = np.bitwise_count(x & U64(0x1111111111111111)).sum(axis=-1, dtype=np.int64)
    return 1 - differ / minima_ / (1 - 2.0**-BITS)


def estimate(a: Column, b: Column) -> Column:
    """The similarity that two packed signatures suggest: the share of equal low bits, less what chance alone gives."""
    differ = []
    for i in range(_LANES):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ.append(F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return 1 - reduce(lambda x, y: x + y, differ) / F.lit(MINIMA) / F.lit(1 - 2.0**-BITS)


def least_estimate(threshold: float, minima_: int = MINIMA) -> float:
    """4.5 standard deviations of the estimate below the threshold."""
    p = threshold + (1 - threshold) * 2.0**-BITS
    return threshold - 4.5 * (p * (1 - p) / minima_) ** 0.5 / (1 - 2.0**-BITS)


def _across(threshold: float):
    """Pairs of a block whose groups differ, whose signatures are alike enough and that share no earlier bucket."""
    least, least_long = least_estimate(threshold), least_estimate(threshold, LONG_MINIMA)

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return np.asarray(table.column(name).combine_chunks().flatten()).view(U64).reshape(len(table), -1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, ["key", "i", "j"]):
            col = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "block", "id", "part")}
            bits, long, bands = (matrix(table, c) for c in ("bits", "long", "bands"))
            new = np.flatnonzero(np.concatenate([[True], (col["key"][1:] != col["key"][:-1]) | (col["i"][1:] != col["i"][:-1]) | (col["j"][1:] != col["j"][:-1])]))
            for a, b in zip(new, [*new[1:], len(table)], strict=True):
                ids, part, block, key = col["id"][a:b], col["part"][a:b], col["block"][a:b], col["key"][a : a + 1].view(U64)[0]
                if len(ids) < 2 or (part == part[0]).all():
                    continue
                left = np.flatnonzero(block == col["i"][a])
                right = left if col["i"][a] == col["j"][a] else np.flatnonzero(block == col["j"][a])
                for at in range(0, len(left), 64):
                    rows = left[at : at + 64]
                    near = (_alike(bits[a:b][rows][:, None, :] ^ bits[a:b][right][None, :, :], MINIMA) >= least) & (part[rows][:, None] != part[right][None, :])
                    near &= (ids[rows][:, None] < ids[right][None, :]) if right is left else (ids[rows][:, None] != ids[right][None, :])
                    r, c = np.nonzero(near)
                    for k in range(0, len(r), 10_000):
                        x, y = rows[r[k : k + 10_000]] + a, right[c[k : k + 10_000]] + a
                        same = bands[x] == bands[y]
                        first = same.any(axis=1) & (bands[x, same.argmax(axis=1)] == key)
                        x, y = x[first], y[first]
                        alike = _alike(long[x] ^ long[y], LONG_MINIMA) >= least_long
                        u, v = col["id"][x[alike]], col["id"][y[alike]]
                        if len(u):
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["a", "b"])

    return pairs


def _confirmed(pairs: DataFrame, sets: DataFrame, reps: DataFrame, percent: int, least: float) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    size = reps.select("id", "n_shingles", "bits")
    near = (
        pairs.join(size.select(F.col("id").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a")), "a")
        .join(size.select(F.col("id").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b")), "b")
        .filter((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (estimate(F.col("bits_a"), F.col("bits_b")) >= least))
        .select("a", "b")
    )
    both = near.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("grams_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("grams").alias("grams_a")), "a")
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    return both.withColumn("shared", shared).filter(100 * F.col("shared") >= percent * (F.size("grams_a") + F.size("grams_b") - F.col("shared"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text); other columns are not read.

    Documents whose sets have an intersection of at least percent/100 of their union are linked; component_id is the smallest doc_id reachable over
    links, kept marks the document that bears it. Null and empty texts, and texts of white space only, have an empty set, which is linked with nothing.
    Rows that repeat a doc_id are one document with several texts: each row is returned, all in one component. A null doc_id is linked with nothing,
    its component is null and it is kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(docs.mapInArrow(_sign, "doc_id long, n_shingles long, set_key binary, bits array<long>, bands array<long>"))
    least = least_estimate(percent / 100)
    full = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one document from here on: the smallest doc_id stands for them
    classes = stored(full.groupBy("set_key").agg(F.min("doc_id").alias("id")))
    reps = stored(full.join(classes.withColumnRenamed("id", "doc_id"), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"]).select(F.col("doc_id").alias("id"), "n_shingles", "bits", "bands"))
    keyed = reps.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("most"), F.count("*").alias("n")).filter("pivot < most").drop("most")
    members = stored(keyed.join(shared, "key"))
    stars = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    taken = stored(members.select("id").distinct())
    texts = docs.withColumnRenamed("doc_id", "id").join(taken, "id", "left_semi")
    grams = stored(texts.mapInArrow(_sets, "id long, grams array<long>"))
    # repeated rows of a doc_id may have several sets; their union of links is that document's
    linked = stored(_confirmed(stars, grams, reps, percent, least))
    part = linked.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("part"))
    part = part.join(part.select(F.col("id").alias("part"), F.col("part").alias("next")), "part", "left").select("id", F.coalesce("next", "part").alias("part"))
    rest = members.filter("n > 2 AND id <> pivot").join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    mixed_keys = rest.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count("*").alias("m")).filter("x < y").select("key", F.ceil(F.col("m") / BLOCK_ROWS).cast("int").alias("blocks"))
    rest = rest.select("key", "id", "part").join(mixed_keys, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "id", "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = rest_rows = stored(rest)
    long = grams.join(rest.select("id").distinct(), "id", "left_semi").mapInArrow(_long, "id long, long array<long>")
    rest = rest.join(reps.select("id", "bits", "bands").join(long, "id"), "id")
    dealt = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    crossed = dealt.mapInArrow(_across(percent / 100), "a long, b long").distinct()
    more = _confirmed(crossed, grams, reps, percent, least)
    links = linked.union(more)
    # all rows of a class, and all rows of a doc_id, belong together
    same = full.select("set_key", "doc_id").join(classes, "set_key").filter("doc_id <> id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    groups = components(links.select(F.col("b").alias("u"), F.col("a").alias("v")).union(same))
    released(members, taken, grams, linked, classes, reps, rest_rows)
    out = signed.select("doc_id", "n_shingles").join(groups.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left")
    kept = F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True))
    return holding(out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), kept.alias("kept")), signed, *held(groups))
