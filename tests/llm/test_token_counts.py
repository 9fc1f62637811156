import public_tokenizers as P
from test_bpe import texts
from tokenizers import Tokenizer

from pagewright.llm import token_counts as tc

PATH = P.path("byte_bpe_50k.json")


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, block string").repartition(parts)
    return sorted((tuple(r) for r in tc.token_counts(df, PATH, P.PATTERN, specials=tc.added_tokens(PATH)).collect()), key=str)


def want(rows):
    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for i, t in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > 512))
    return sorted(out, key=str)


def test_against_the_library(spark):
    rows = list(enumerate(texts(11, 2500)))
    rows += [(9000, None), (9001, "a <|endoftext|> b<|endoftext|><|endoftext|>  c"), (None, "no id"), (7, "twice"), (7, "twice"), (9002, "word and word " * 40_000)]
    assert run(spark, rows) == want(rows)


def test_blocks(spark, monkeypatch):
    import inspect

    rows = list(enumerate(texts(3, 300)))
    block = tc._Block()
    for i, t in rows:
        block.add(i, t, tc.Counter(tc.pre_tokens(t, tc.regex.compile(P.PATTERN), None)))
    sizes, entries, times = tc._unpacked(block.packed())
    assert list(sizes) == block.sizes and int(times.sum()) == sum(len(tc.regex.findall(P.PATTERN, t)) for _, t in rows)
    assert entries.max() == len(block.vocabulary) - 1
    assert inspect.signature(tc.token_counts).parameters["limit"].default == 512


def test_empty_table(spark):
    df = tc.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN)
    assert df.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and df.count() == 0
    assert run(spark, [(1, ""), (2, None)]) == [(1, 0, 0, False), (2, 0, 0, False)]
