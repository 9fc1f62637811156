"""The registered queries of the training-data operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_template, decontaminate, fingerprint, langid_crf, minhash, quality_mil, suffix_dedup, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, 512, token_counts.added_tokens(path))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(_table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_template.digests(chat_template.format_conversations(turns.unionByName(extra)))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, _table(spark, sf_dir, "labels")))


def op9_langid_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid_crf.predict(docs, langid_crf.train(docs))


def op10_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


QUERIES: dict[str, Query] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_template_decontamination": op3_template_decontamination,
    "op4_canonical_fingerprint": op4_canonical_fingerprint,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_format": op7_chat_format,
    "op8_quality_mil": op8_quality_mil,
    "op9_langid_crf": op9_langid_crf,
    "op10_toxicity_ordinal": op10_toxicity_ordinal,
}

def _op3_sql() -> str:
    """The template join as DuckDB SQL; windows are compared as strings."""
    quoted = lambda xs: ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs)
    d = decontaminate

    def template(table: str, key: str) -> str:
        return f"""
raw_{key} AS (SELECT {key}, regexp_extract_all(coalesce(text, ''), '[.!?' || chr(10) || ']|[\\p{{L}}\\p{{M}}]+|[0-9]+(?:[.,][0-9]+)*|[%€$£°]') AS r FROM {table} WHERE {key} IS NOT NULL),
each_{key} AS (SELECT {key}, unnest(r) AS x, unnest(range(1, len(r) + 1)) AS i, unnest(list_prepend(NULL, r[1:len(r)-1])) AS before FROM raw_{key} WHERE len(r) > 0),
kept_{key} AS (SELECT {key}, i, x, CASE
  WHEN x >= '0' AND x < ':' THEN '{d.NUMBER}'
  WHEN x IN ({quoted(d.SIGNS)}) OR (before >= '0' AND before < ':' AND lower(x) IN ({quoted(d.UNITS)})) THEN '{d.UNIT}'
  WHEN before IS NOT NULL AND before NOT IN ({quoted(d.ENDS)}) AND lower(x) <> x AND length(x) > 1 AND x = upper(x[1]) || lower(x[2:]) THEN '{d.NAME}'
  ELSE lower(x) END AS c FROM each_{key} WHERE x NOT IN ({quoted(d.ENDS)})),
at_{key} AS (SELECT {key}, x, c, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS p FROM kept_{key}),
win_{key} AS (SELECT * FROM (SELECT {key}, p, list(c) OVER w AS t, list(x) OVER w AS v FROM at_{key} WINDOW w AS (PARTITION BY {key} ORDER BY p ROWS BETWEEN CURRENT ROW AND {d.WINDOW - 1} FOLLOWING)) WHERE len(t) = {d.WINDOW}),"""

    return f"""
WITH {template("documents", "doc_id")}{template("benchmark", "item_id")}
totals AS (SELECT item_id, count(DISTINCT t) AS n_windows FROM win_item_id GROUP BY item_id),
found AS (SELECT a.doc_id, b.item_id, a.p - b.p AS shift, a.t, a.v AS dv, b.v AS iv FROM win_doc_id a JOIN win_item_id b ON a.t = b.t),
likely AS (SELECT f.* FROM found f JOIN (SELECT doc_id, item_id FROM found JOIN totals USING (item_id) GROUP BY doc_id, item_id, n_windows HAVING 100 * count(DISTINCT t) >= {d.PERCENT} * n_windows) USING (doc_id, item_id)),
slots AS (SELECT doc_id, item_id, shift, lower(unnest(iv)) AS a, lower(unnest(dv)) AS b, unnest(t) AS c FROM likely),
wrong AS (SELECT DISTINCT doc_id, item_id, shift FROM (SELECT doc_id, item_id, shift FROM slots WHERE c IN ('{d.NAME}', '{d.NUMBER}', '{d.UNIT}') GROUP BY doc_id, item_id, shift, a HAVING count(DISTINCT b) > 1)),
good AS (SELECT l.* FROM likely l ANTI JOIN wrong USING (doc_id, item_id, shift))
SELECT doc_id, item_id, count(DISTINCT t) AS n_matched, n_windows FROM good JOIN totals USING (item_id) GROUP BY doc_id, item_id, n_windows HAVING 100 * count(DISTINCT t) >= {d.PERCENT} * n_windows
"""


SQL: dict[str, str] = {
    "op3_template_decontamination": _op3_sql(),
    "op1_minhash_near_dedup": r"""
WITH RECURSIVE
words AS (SELECT doc_id, list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda w: w) AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS id, a AS r FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, coalesce(least.c, d.doc_id) AS component_id, d.doc_id = coalesce(least.c, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.id = d.doc_id
""",
    "op7_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(regexp_replace(regexp_replace(text, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) AS n,
    length(regexp_replace(regexp_replace(role, '(<)(\\*)(/?s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(/?INST\]|/?ROLE\]|/TURN\])', '\1\\\2\3', 'g')) AS m FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 23 + m END))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
""",
}
