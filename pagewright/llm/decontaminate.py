"""Benchmark leaks found through templates, in built-in functions only.

Tokens of documents and benchmark items are made canonical: numbers, names (capitalised words within a sentence) and units (known words after a number,
and currency and percent signs) become typed placeholders, other words lose their case. Windows of five template tokens are joined by hash. A
re-parameterised question has the template of the original and other values in its slots; its values must still be used consistently: along one
alignment of document and item, each value of the item must stand for a single value of the document. An item has leaked into a document that has at
least 75 of 100 of its distinct windows on consistent alignments.

A document that lacks at most 25 of an item's 100 windows has at least five of any 30. So documents are first searched for the rarest so many windows of each
item, and those with five of them are candidates: templates that many items share count only where an item has nothing else. Whole windows with their
slots are compared for candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held, holding, stored, unused

WINDOW = 5
PERCENT = 75
#: Windows that a candidate must have of an item's rarest ones (fewer where fewer are enough for a leak).
HITS = 5
#: Rows of two or three numbers that are broadcast at most, and bytes of whole windows; larger tables are joined by shuffling.
BROADCAST_WINDOWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Scripts that don't part words by spaces: each letter is a token.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
TOKEN = rf"[.!?\n]|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[\p{{L}}&&[{UNSPACED}]]\p{{M}}*|" + r"[0-9]+(?:[.,][0-9]+)*|[%€$£°]"
ENDS = [".", "!", "?", "\n"]
SIGNS = ["%", "€", "$", "£", "°"]
#: Words for units after a number.
UNITS = "km m cm mm mi miles mile kg g mg t lb lbs l ml h hr hrs hour hours min mins minute minutes s sec secs second seconds day days week weeks month months year years euro euros dollar dollars cent cents percent degree degrees gb mb kb tb hz khz mhz ghz w kw v".split()
NAME, NUMBER, UNIT = "<name>", "<number>", "<unit>"


def tokens(rows: DataFrame) -> DataFrame:
    """rows with text replaced by tokens: an array of (canonical hash, surface, whether it is a slot)."""
    raw = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn("raw", raw).drop("text")
    # a column of its own: inside the function below it would be made anew for each token
    rows = rows.withColumn("before", F.concat(F.array(F.lit(None).cast("string")), F.slice("raw", 1, F.greatest(F.size("raw") - 1, F.lit(0)))))

    def is_number(x: Column) -> Column:
        return (x >= "0") & (x < ":")

    def one(x: Column, before: Column) -> Column:
        low = F.lower(x)
        capital = (low != x) & (F.length(x) > 1) & (x == F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
        canon = (
            F.when(is_number(x), F.lit(NUMBER))
            .when(x.isin(SIGNS) | (before.isNotNull() & is_number(before) & low.isin(UNITS)), F.lit(UNIT))
            .when(capital & before.isNotNull() & ~before.isin(ENDS), F.lit(NAME))
            .otherwise(low)
        )
        return F.struct(canon.alias("canon"), x.alias("surface"))

    kept = F.filter(F.zip_with("raw", "before", one), lambda t: t["surface"].isNotNull() & ~t["surface"].isin(ENDS))
    hashed = F.transform(kept, lambda t: F.struct(F.xxhash64(t["canon"]).alias("h"), t["surface"].alias("surface"), t["canon"].isin(NAME, NUMBER, UNIT).alias("slot")))
    return rows.withColumn("tokens", hashed).drop("raw", "before")


def windows(rows: DataFrame, key: str, sizes: list[int]) -> DataFrame:
    """(key, tokens, at, size, window) for each window of some numbers of tokens of the column tokens; at counts from 0."""
    # a place and a size (below 8) are one number, so that places are sequences, made in generated code; a filter on the size would be pushed down and make the tokens twice
    n = F.size("tokens")
    each = [F.when(n >= k, F.sequence(F.lit(k), (n - k) * 8 + k, F.lit(8))).otherwise(F.array().cast("array<int>")) for k in sizes]
    at = rows.select(key, "tokens", F.explode(F.flatten(F.array(*each)) if len(each) > 1 else each[0]).alias("p"))
    at = at.select(key, "tokens", F.shiftright("p", 3).alias("at"), F.col("p").bitwiseAND(7).alias("size"))

    def window(k: int) -> Column:
        return F.xxhash64(F.lit(k), *(F.get("tokens", F.col("at") + i)["h"] for i in range(k)))

    return at.withColumn("window", window(sizes[0]) if len(sizes) == 1 else F.coalesce(*(F.when(F.col("size") == k, window(k)) for k in sizes)))


def _cut() -> Column:
    """The tokens of a window."""
    return F.slice("tokens", F.col("at") + 1, F.col("size"))


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows): items of benchmark(item_id, text) that have leaked into documents of docs(doc_id, text), whole texts each.

    n_windows counts the item's distinct template windows, n_matched those of them that the document has on consistent alignments;
    100 * n_matched >= percent * n_windows. An item with fewer than five template tokens is one window of its own length; null and empty texts match nothing. Rows that
    repeat a doc_id or item_id count as one document or item with all their texts; rows without an id are left out. Empty tables give no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL")
    items = tokens(items)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    # an item of fewer tokens is one window of its own length; at most five lengths reach the driver
    own = F.least(F.size("tokens"), F.lit(WINDOW))
    sizes = sorted(r["n"] for r in items.select(own.alias("n")).filter("n > 0").distinct().collect())
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_matched long, n_windows long")
    wanted = windows(items.withColumn("own", own), "item_id", sizes) if len(sizes) == 1 else None
    for k in sizes if wanted is None else ():
        part = windows(items.filter(own == k), "item_id", [k])
        wanted = part if wanted is None else wanted.unionByName(part)
    wanted = stored(wanted.select("item_id", "window", F.col("at").alias("item_at"), _cut().alias("item_tokens")))
    totals = wanted.groupBy("item_id").agg(F.countDistinct("window").alias("n_windows"))
    # of what a document can lack and HITS more, it has HITS at least
    different = wanted.select("item_id", "window").distinct()
    shared = different.groupBy("window").agg(F.count("*").alias("n_items"))
    rarest = Window.partitionBy("item_id").orderBy("n_items", "window")
    probes = different.join(shared, "window").withColumn("rank", F.row_number().over(rarest)).join(totals, "item_id")
    enough = F.ceil(F.lit(percent) * F.col("n_windows") / 100)
    probes = probes.withColumn("hits", F.least(enough, F.lit(HITS)).cast("int")).filter(F.col("rank") <= F.col("n_windows") - enough + F.col("hits"))
    probes = stored(probes.select("window", "item_id", "hits"))
    there = windows(tokens(rows), "doc_id", sizes).select("doc_id", "window")
    near = F.broadcast(probes) if _few(probes, broadcast_windows) else probes
    met = there.join(near, "window").groupBy("doc_id", "item_id", "hits").agg(F.countDistinct("window").alias("n"))
    candidates = stored(met.filter("n >= hits").select("doc_id", "item_id"))
    ids = candidates.select("doc_id").distinct()
    some = rows.join(F.broadcast(ids) if _few(ids, broadcast_windows) else ids, "doc_id", "left_semi")
    weight = wanted.agg(F.sum(F.length(F.to_json("item_tokens")) + 64).alias("n")).first()["n"]
    pairs = candidates.join(F.broadcast(wanted) if broadcast_windows and weight <= BROADCAST_BYTES else wanted, "item_id")
    # a document's tokens are cut to the window before they travel
    met = windows(tokens(some), "doc_id", sizes).withColumn("doc_tokens", _cut()).select("doc_id", "window", "at", "doc_tokens").join(pairs, ["doc_id", "window"])
    # candidates first: only these are worth a look at the slots
    matched = stored(met.select("doc_id", "item_id", "window", (F.col("at") - F.col("item_at")).alias("shift"), _slots("item_tokens", "doc_tokens").alias("slots")))
    counts = matched.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("n")).join(totals, "item_id").filter(100 * F.col("n") >= percent * F.col("n_windows"))
    likely = matched.join(counts.select("doc_id", "item_id"), ["doc_id", "item_id"])
    filled = likely.select("doc_id", "item_id", "shift", F.explode("slots").alias("slot"))
    values = filled.groupBy("doc_id", "item_id", "shift", "slot.item_value").agg((F.min("slot.doc_value") != F.max("slot.doc_value")).alias("bad"))
    wrong = values.filter("bad").select("doc_id", "item_id", "shift").distinct()
    good = likely.join(wrong, ["doc_id", "item_id", "shift"], "left_anti")
    sure = good.groupBy("doc_id", "item_id").agg(F.countDistinct("window").alias("n_matched")).join(totals, "item_id")
    sure = sure.filter(100 * F.col("n_matched") >= percent * F.col("n_windows")).select("doc_id", "item_id", "n_matched", "n_windows")
    return holding(sure, wanted, probes, candidates, matched)


def _slots(item: str, doc: str) -> Column:
    """The values of a window's slots, of the item's and the document's."""
    both = F.zip_with(item, doc, lambda x, y: F.when(x["slot"], F.struct(F.lower(x["surface"]).alias("item_value"), F.lower(y["surface"]).alias("doc_value"))))
    return F.filter(both, lambda p: p.isNotNull())


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, into which no item has leaked.

    Null and empty texts and rows without a doc_id stay. Rows that repeat a doc_id go or stay together. An empty table gives no rows; without items all stay.
    """
    own = unused("leaked_doc_id", docs)
    leaked = leaks(docs, benchmark, percent)
    found = leaked.select(F.col("doc_id").alias(own)).distinct()
    return holding(docs.join(found, docs["doc_id"].cast("long") == F.col(own), "left_anti"), *held(leaked))
