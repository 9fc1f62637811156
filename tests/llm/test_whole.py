"""Training-data operators read whole texts, in any script."""

from pagewright.llm import decontaminate, langid_crf


def test_all_letters_of_unspaced_texts_are_words():
    run = "".join(chr(0x4E00 + k) for k in range(200))
    got = langid_crf.words(f"{run} and {'Ab' * 19}")
    assert "".join(got[:-2]) == run and got[-2:] == ["and", "ab" * 19] and max(map(len, got)) == 38
    a, b = (langid_crf.features(langid_crf.words(t)) for t in (run, run[:90] + "x" + run[91:]))
    assert a.shape == b.shape and (a != b).any()


def test_short_items_leak(spark):
    docs = [(1, "One asks: too few words? And more."), (2, "few words only, too"), (3, "他问今天天气怎么样然后走了"), (4, "今天怎么样天气很好"), (5, "Pay 12 dollars now to all of them")]
    items = [(1, "too few words"), (2, "今天天气怎么样"), (3, "天气"), (4, "pay 7 euros"), (5, "..."), (6, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 1), (3, 2), (3, 3), (4, 3), (5, 4)]
    for most in (1_000_000, 0):
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(d, b, broadcast_windows=most).collect()) == want
