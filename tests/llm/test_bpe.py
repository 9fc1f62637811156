import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from pagewright.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed=4, n=3000):
    r = random.Random(seed)
    with open(PATH, "rb") as f:
        tokens = [t for t in (base64.b64decode(line.split()[0]).decode(errors="ignore") for line in f) if t]
    alphabets = ["abc", "aeioust", "éèñüß ", "0123456789", " \n\t\r", "!?.,$%&*#|", "日本語中文кириллицаالعربية", "🙂👩‍👩‍👧‍️", "".join(map(chr, range(1, 700)))]
    out = ["", " ", "  ", "\n\n a", "a" * 3000, "ab" * 2000, "<|endoftext|>", "it's we'll", "\x1c\x1d\x85  x"]
    for _ in range(n):
        kind = r.random()
        if kind < 0.5:
            out.append("".join(r.choices(tokens, k=r.randint(1, 12))))
        else:
            out.append("".join("".join(r.choices(r.choice(alphabets), k=r.randint(1, 9))) for _ in range(r.randint(1, 8))))
    return out


def test_against_the_library(library):
    e = bpe.encoder(PATH, P.PATTERN)
    for t in texts():
        assert e.encode(t) == library.encode_ordinary(t), t


def test_every_token_and_pairs_of_tokens(library):
    e = bpe.encoder(PATH, P.PATTERN)
    r = random.Random(1)
    every = [b for b in e.bytes if b]
    for b in every[::7]:
        assert e.piece(b) == library._encode_single_piece(b)
    for _ in range(8000):
        b = b"".join(r.choices(every, k=r.randint(2, 4)))
        assert e.piece(b) == library._encode_single_piece(b), b


def test_round_trip_and_digests(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(8, 200))] + [(1000, None), (None, "null id"), (5, "again"), (5, "again"), (2000, "long é " * 60_000)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in rows], "doc_id long, text string, ids array<int>").repartition(3)
    got = sorted((tuple(x) for x in bpe.digests(df, PATH, P.PATTERN).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((t or "").encode() for _, t in rows) and sum(len(r.ids) for r in back) == sum(w[1] for w in want)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([99999999, -1],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, PATH).collect()] == [None, b"", b""]
