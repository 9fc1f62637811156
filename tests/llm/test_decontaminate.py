import random

from pagewright.llm.decontaminate import leaks, without_leaks

ITEM = "A train leaves Berlin at noon and drives 120 km to meet Anna, who paid 15 dollars for the long ride there."


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    return sorted((r.doc_id, r.item_id) for r in leaks(d, b, **more).collect())


def test_copies_and_new_parameters(spark):
    docs = [
        (1, "Some words before. " + ITEM + " And some after."),
        (2, ITEM.upper().replace("A TRAIN", "a train").lower()),
        (3, ITEM.replace("120", "95").replace("Berlin", "Paris").replace("Anna", "Peter").replace("km", "miles").replace("15 dollars", "3 euros")),
        (4, "A train leaves early and drives somewhere to meet people, who paid for the ride."),
        (5, "nothing of the kind stands here at all, as far as one can see"),
        (6, ITEM.split(" km")[0]),
        (7, None),
        (8, ""),
        (None, ITEM),
    ]
    items = [(1, ITEM), (2, "too few words"), (3, None), (None, ITEM), (4, "")]
    got = found(spark, docs, items)
    assert (1, 1) in got and (3, 1) in got and {d for d, _ in got} <= {1, 2, 3} and all(i == 1 for _, i in got)
    assert found(spark, docs, items, broadcast_windows=0) == got
    kept = without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in got})


def test_values_must_be_used_consistently(spark):
    item = "Give 7 apples to Tom and then take 7 pears from Tom so that 7 plums are left for Tom in the end"
    same = item.replace("7", "12").replace("Tom", "Eve")
    mixed = "Give 12 apples to Eve and then take 3 pears from Max so that 4 plums are left for Ina in the end"
    assert found(spark, [(1, same), (2, mixed)], [(5, item)]) == [(1, 5)]


def test_repeated_rows_and_empty_tables(spark):
    assert found(spark, [(1, ITEM), (1, ITEM), (1, "other text"), (2, (ITEM + "\n") * 500)], [(1, ITEM), (1, ITEM)]) == [(1, 1), (2, 1)]
    assert found(spark, [], [(1, ITEM)]) == [] and found(spark, [(1, ITEM)], []) == []


def test_shares_near_the_threshold(spark):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(44)]
    item = " ".join(words)  # 40 windows
    docs = [(k, " ".join(words[:k])) for k in range(20, 45)]
    assert [d for d, _ in found(spark, docs, [(1, item)])] == [k for k, _ in docs if 100 * (k - 4) >= 75 * 40]


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, ITEM, 1, "a"), (2, "fine text", 2, "b"), (None, ITEM, 3, "c")], "doc_id long, text string, leaked_doc_id long, _LEAKED_doc_id string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(without_leaks(docs, items).collect(), key=str) == sorted([(2, "fine text", 2, "b"), (None, ITEM, 3, "c")], key=str)
    assert without_leaks(docs, items.limit(0)).count() == 3 and without_leaks(docs.limit(0), items).count() == 0


def test_common_templates(spark):
    """Items that share nearly all their windows, against a plain search for their words."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(60)]
    items = [(k, " ".join(words[:16] + [words[20 + k]] + words[16:20])) for k in range(30)]
    docs = []
    for k in range(60):
        base = items[r.randrange(30)][1].split()
        cut = r.choice([0, 0, 3, 8])
        docs.append((k, "so " + " ".join(base[cut:]) + " " + " ".join(r.choices(words, k=5))))

    def grams(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = sorted((d, i) for d, t in docs for i, x in items if 100 * len(grams(t) & grams(x)) >= 75 * len(grams(x)))
    assert want and found(spark, docs, items) == want and found(spark, docs, items, broadcast_windows=0) == want
