"""Scoring of answers and citations, and comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_answer
from .ranges import running_sums

METRICS = ("answer_correctness", "citation_precision", "citation_completeness", "hallucination_rate", "version_awareness", "cross_language_score")


def score_cases(rows: DataFrame) -> DataFrame:
    """One row per case and answer; ``expected`` and ``given`` are citation arrays."""
    expected, given = F.array_distinct("expected"), F.array_distinct("given")
    right = F.size(F.array_intersect("expected", "given")).cast("double")
    correct = F.contains(normalize_answer(F.col("answer")), normalize_answer(F.col("expected_answer"))).cast("double")
    complete = F.when(F.size(expected) > 0, right / F.greatest(F.size(expected), F.lit(1)))
    claimed = F.exists("forbidden_claims", lambda c: F.contains(F.lower("answer"), F.lower(c)))
    invalid = F.size(F.array_except("given", "expected")) > 0
    return rows.select(
        "case_id", "run_id", "latency_ms",
        correct.alias("answer_correctness"),
        F.when(F.size(given) > 0, right / F.greatest(F.size(given), F.lit(1))).otherwise(0.0).alias("citation_precision"),
        complete.alias("citation_completeness"),
        (F.coalesce(claimed, F.lit(False)) | invalid).cast("double").alias("hallucination_rate"),
        F.when(F.col("category") == "version_awareness", complete).alias("version_awareness"),
        F.when(~F.array_contains("document_languages", F.col("question_language")), correct).alias("cross_language_score"),
    )


def aggregate(scored: DataFrame) -> DataFrame:
    """``run_id, metric, value``: means over the cases that have the metric; a metric without any is left out."""
    means = scored.groupBy("run_id").agg(*(F.round(F.avg(m), 4).alias(m) for m in METRICS), F.round(F.avg("latency_ms"), 2).alias("latency_mean_ms"))
    stacked = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in (*METRICS, "latency_mean_ms")))
    out = means.select("run_id", F.inline(stacked)).where("value is not null")
    p = latency_percentiles(scored.select(F.col("run_id").alias("key"), F.col("latency_ms").alias("value")))
    extra = F.array(F.struct(F.lit("latency_p50_ms").alias("metric"), F.col("p50").alias("value")), F.struct(F.lit("latency_p95_ms").alias("metric"), F.col("p95").alias("value")))
    return out.unionByName(p.select(F.col("key").alias("run_id"), F.inline(extra)))


def latency_percentiles(rows: DataFrame) -> DataFrame:
    """``key, n, p50, p95`` as the sorted values at (n - 1) // 2 and min(n - 1, int(n * 0.95)).

    Values are counted first, and keys cut into ranges of values: a hot key is split.
    """
    by = rows.where("value is not null").groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sums(by, ["key"], [F.col("value")], ["c"]).withColumnRenamed("c_all", "n")
    low, high = F.floor((F.col("n") - 1) / 2), F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    at = lambda i: F.min(F.when(F.col("c_upto") > i, F.col("value")))
    return ranked.groupBy("key", "n").agg(at(low).cast("double").alias("p50"), at(high).cast("double").alias("p95"))


def compare(scored: DataFrame, one: str, other: str) -> DataFrame:
    """Cases on which two runs differ in correctness."""
    a = scored.where(F.col("run_id") == one).select("case_id", F.col("answer_correctness").alias("first"))
    b = scored.where(F.col("run_id") == other).select("case_id", F.col("answer_correctness").alias("second"))
    return a.join(b, "case_id").where("first <> second")
