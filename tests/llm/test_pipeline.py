import base64
import hashlib

import duckdb
import public_tokenizers as P
import pytest
import tiktoken
from test_minhash import brute as near

import corpus_pipeline as cp
from pagewright.llm import decontaminate, toxicity


def cut(rows):
    seen = {}
    for _, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - cp.REPEATED_BYTES + 1):
            seen[b[s : s + cp.REPEATED_BYTES]] = seen.get(b[s : s + cp.REPEATED_BYTES], 0) + 1
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - cp.REPEATED_BYTES + 1):
            if seen[b[s : s + cp.REPEATED_BYTES]] > 1:
                gone[s : s + cp.REPEATED_BYTES] = b"\1" * cp.REPEATED_BYTES
        out.append((i, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore") if t is not None else None))
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    src = "/root/testdata/sf0.01"
    passage = "x ".join(f"shared{i}" for i in range(70))
    duckdb.sql(f"""COPY (
        SELECT * FROM '{src}/documents.parquet' WHERE doc_id < 400
        UNION ALL SELECT doc_id + 10000, text || ' extra', lang, source, n_chars FROM '{src}/documents.parquet' WHERE doc_id < 40
        UNION ALL SELECT doc_id + 20000, text || ' {passage} ' || doc_id, lang, source, n_chars FROM '{src}/documents.parquet' WHERE doc_id BETWEEN 400 AND 420
        UNION ALL SELECT 30000 + item_id, 'Before it. ' || text || ' After it.', 'en', 's', 1 FROM '{src}/benchmark.parquet' WHERE item_id < 9
        UNION ALL SELECT 40000, NULL, NULL, NULL, NULL UNION ALL SELECT 40001, '', NULL, NULL, 0) TO '{where}/documents.parquet' (FORMAT parquet)""")
    for t in ("benchmark", "labels"):
        duckdb.sql(f"COPY (SELECT * FROM '{src}/{t}.parquet') TO '{where}/{t}.parquet' (FORMAT parquet)")
    return str(where)


def test_against_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [r for r in rows if model.above([model.row(r[1])])[0, 0] < 0.5]
    kept = {i for i, _, _, k in near(rows) if k}
    rows = cut([r for r in rows if r[0] in kept])
    leaked = {r.doc_id for r in decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert len(leaked) >= 9
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        if i not in leaked:
            ids = library.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(want)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "byte_bpe"]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert sorted(out.columns) == sorted(docs.columns)
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_stages_against_what_is_known(spark, folder):
    """Labels and planted items, not models, as the truth."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    left = {r.doc_id for r in cp.drop_toxic(spark, docs, folder).collect()}
    there = {r.doc_id: r.text for r in docs.collect()}
    rejected = [i in left for i, y in toxic.items() if y and i in there]
    clean = [i in left for i, y in toxic.items() if not y and i in there]
    assert len(rejected) > 5 and sum(rejected) <= 0.5 * len(rejected) and sum(clean) >= 0.98 * len(clean)
    items = [r.text.lower().split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in items]
    left = {r.doc_id for r in cp.drop_leaks(spark, docs, folder).collect()}
    for i, t in there.items():
        w = (t or "").lower().split()
        own = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
        share = max((len(own & g) / len(g) for g in grams if g), default=0)
        assert (i in left) or share > 0.3  # what goes has much of an item, word by word
        assert not (i in left and share == 1)  # a whole item goes


def test_odd_rows(spark, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    words = " ".join(f"word{k}" for k in range(40))
    rows = [(1, words, "b"), (1, words, "a"), (1, "another text of the same document", "a"), (2, words, "c"), (3, None, "c"), (3, None, "c"), (None, words, "d"), (None, words, "d"), (4, "", None)]
    docs = spark.createDataFrame([(i, t, x, "en", "s", len(t or ""), 1, 2, 3) for i, t, x in rows], "doc_id long, text string, n string, lang string, source string, n_chars long, own_spans int, leaked_doc_id int, spans int")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted(((r.doc_id, r.text, r.n) for r in out.collect()), key=str)
        want = [r for r in rows if r not in ((1, words, "b"), (2, words, "c"))] if name == "near_duplicates" else rows
        if name == "near_duplicates":
            want = list(dict.fromkeys(r for r in want if r[0] is not None)) + [r for r in want if r[0] is None]
        if name != "suffix_dedup":
            assert got == sorted(want, key=str), name
        else:
            assert len(got) == len(rows) and all(t in (None, "", "another text of the same document") for _, t, _ in got)
    assert len(cp.encode(spark, docs, str(tmp_path)).collect()) == len(rows)
