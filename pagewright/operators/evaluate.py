"""Evaluation: budgets, benchmark questions, labelled questions."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import kept
from . import context, retrieve
from .index import Index

#: name -> (tokens, hits, compacted)
BUDGETS = {"aggressive": (400, 3, True), "balanced": (1000, 5, True), "exhaustive": (2000, 8, False)}
LEAST_REDUCTION, LEAST_RECALL = 50.0, 0.33


def corpus_tokens(pages: DataFrame) -> DataFrame:
    """One row: the tokens of all pages, at least 1."""
    return pages.agg(F.greatest(F.lit(1), F.coalesce(F.sum(T.estimate_tokens(F.col("text"))), F.lit(0))).alias("corpus_tokens"))


def measure(questions: DataFrame, retrieved: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, retrieved_tokens, reduction, matched, expected, recall, provenance, passed) for questions(query_id, expected_concepts, requires_provenance) and retrieved(query_id, text)."""
    rows = questions.join(retrieved, "query_id", "left").withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(corpus_tokens(pages)), how="cross")
    rows = rows.withColumn("retrieved_tokens", T.estimate_tokens(F.col("text")))
    rows = rows.withColumn("reduction", (1 - F.least(F.lit(1.0), F.col("retrieved_tokens") / F.col("corpus_tokens"))) * 100)
    none = F.coalesce(F.size("expected_concepts"), F.lit(0)) <= 0
    low = F.lower("text")
    rows = rows.withColumn("matched", F.when(none, 1).otherwise(F.size(F.filter("expected_concepts", lambda c: F.contains(low, F.lower(c)))))).withColumn("expected", F.when(none, 1).otherwise(F.size("expected_concepts")))
    rows = rows.withColumn("recall", F.col("matched") / F.col("expected"))
    cited = F.contains("text", F.lit("[Source:")) | F.contains("text", F.lit("p.")) | F.contains("text", F.lit("Página"))
    rows = rows.withColumn("provenance", ~F.coalesce("requires_provenance", F.lit(True)) | cited)
    passed = (F.col("reduction") >= LEAST_REDUCTION) & (F.col("recall") >= LEAST_RECALL) & F.col("provenance")
    return rows.select("query_id", "retrieved_tokens", "reduction", "matched", "expected", "recall", "provenance", passed.alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """One row: averages and how many questions passed."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.agg(F.count("*").alias("questions"), F.count_if("passed").alias("passed"), zero(F.avg("reduction")).alias("average_reduction"), zero(F.avg("recall")).alias("average_recall"), zero(F.avg("retrieved_tokens")).alias("average_tokens"))


def run_suite(questions: DataFrame, index: Index, sections: DataFrame, pages: DataFrame, budget: str = "balanced", observers: list[Callable[[str, object], None]] = ()) -> DataFrame:
    """measure() for questions(query_id, query, expected_concepts, target_tool, requires_provenance), all in one plan; observers are told of start and end."""
    tokens, chunks, compacted = BUDGETS.get(budget, BUDGETS["balanced"])
    for o in observers:
        o("started", budget)
    began = time.time()
    hits = retrieve.hybrid_search(questions.select("query_id", "query"), index, 2 * chunks)
    wide = F.col("target_tool") == "document_get_context"
    ask = questions.select("query_id", "query", "target_tool")
    packed = context.pack_evidence(hits.join(ask.filter(~wide).select("query_id"), "query_id", "left_semi"), tokens, chunks, compacted)
    evidence = context.evidence_markdown(packed).withColumnRenamed("markdown", "text")
    around = ask.filter(wide)
    broad = context.conceptual_context(around.select("query_id", "query"), hits.join(around.select("query_id"), "query_id", "left_semi"), sections, pages, tokens, chunks, compacted)
    out = measure(questions, evidence.unionByName(broad), pages)
    for o in observers:
        o("completed", time.time() - began)
    return out


def markdown_report(results: DataFrame) -> str:
    """A Markdown table of all results, a row for each question, and their summary. The text is made on the driver, a partition at a time; summary() serves for very many questions."""
    s = summary(results).first()
    head = f"# Benchmark\n\n{s['passed']}/{s['questions']} passed, reduction {s['average_reduction']:.2f} %, recall {s['average_recall'] * 100:.1f} %\n\n"
    rows = results.orderBy("query_id").toLocalIterator()
    table = "".join(f"| {r['query_id']} | {r['retrieved_tokens']} | {r['reduction']:.1f} % | {r['recall'] * 100:.0f} % | {'yes' if r['passed'] else 'no'} |\n" for r in rows)
    return head + "| Question | Tokens | Reduction | Recall | Passed |\n|---|---|---|---|---|\n" + table


def labelled_evaluation(questions: DataFrame, hits: DataFrame, titles: DataFrame) -> DataFrame:
    """One row of counts for questions(query_id, answerable, paraphrased, document_title, page_start, page_end): how many answerable ones are found among
    the first three hits(query_id, rank, title, page), how many wrongly got none, how many unanswerable ones rightly got none. Questions about documents that titles(title) lacks are skipped."""
    # the few titles that are asked for are looked up among all
    wanted = kept(questions.select(F.col("document_title").alias("title")).distinct(), "wanted")
    there = titles.select("title").join(F.broadcast(wanted) if retrieve.few(wanted) else wanted, "title", "left_semi").distinct()
    known = questions.join(there.select(F.col("title").alias("document_title")), "document_title", "left_semi").unionByName(questions.filter("NOT answerable")).dropDuplicates(["query_id"])
    top = hits.filter("rank <= 3").join(known.select("query_id", "page_start", "page_end"), "query_id")
    found = top.groupBy("query_id").agg(F.bool_or(F.col("page").between(F.col("page_start"), F.col("page_end"))).alias("found"), F.lit(True).alias("any"))
    rows = known.join(found, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(False))).withColumn("any", F.coalesce("any", F.lit(False)))
    a = F.col("answerable")
    return rows.agg(
        F.count_if(a).alias("answerable"),
        F.count_if(a & F.col("found")).alias("found"),
        F.count_if(a & F.col("found") & F.col("paraphrased")).alias("found_paraphrased"),
        F.count_if(a & ~F.col("any")).alias("wrongly_refused"),
        F.count_if(~a).alias("unanswerable"),
        F.count_if(~a & ~F.col("any")).alias("rightly_refused"),
    )


def skipped_questions(questions: DataFrame, titles: DataFrame) -> DataFrame:
    """(document_title, skipped): answerable questions about documents that aren't indexed."""
    return questions.filter("answerable").join(titles.select(F.col("title").alias("document_title")), "document_title", "left_anti").groupBy("document_title").agg(F.count("*").alias("skipped"))


def threshold_quality(scores: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: true and false positives and negatives of a score against a label of 0 and 1."""
    yes, is_one = F.col(score) >= threshold, F.col(label) == 1
    return scores.agg(F.count_if(yes & is_one).alias("tp"), F.count_if(yes & ~is_one).alias("fp"), F.count_if(~yes & is_one).alias("fn"), F.count_if(~yes & ~is_one).alias("tn"))
