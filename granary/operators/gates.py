"""Evidence and protocol gates, training aggregates, and decisions over ordered runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Results are ranked only among rows that agree on these.
COMPARABLE = ("language", "prompt_set", "version", "method", "scope")


def class_weight(rows: DataFrame, *by: str) -> DataFrame:
    """``real, synthetic, weight``: how many real rows stand against one synthetic; null without synthetic rows."""
    real, synthetic = F.count_if(F.col("label") == "real"), F.count_if(F.col("label") == "synthetic")
    return rows.groupBy(*by).agg(real.alias("real"), synthetic.alias("synthetic"), (real / F.nullif(synthetic, F.lit(0))).alias("weight"))


def weighted_mean(rows: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    """A mean of batch means, each counted by its batch's size."""
    total = F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))
    return rows.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.nullif(total, F.lit(0))).alias("mean"))


def call_summary(calls: DataFrame, *by: str) -> DataFrame:
    """Latencies, successes and the distinct models and digests that answered, of calls ``latency_ms, ok, model_id, model_sha256``."""
    ms = "latency_ms"
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("succeeded"), F.min(ms).alias("min_ms"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"),
        F.array_sort(F.collect_set("model_id")).alias("models"), F.array_sort(F.collect_set("model_sha256")).alias("digests"),
    )


def protected_gate(rows: DataFrame, heldout: list[str], least: int = 50) -> DataFrame:
    """``synthetic, real, ready``: whether gated rows suffice for a test on generators that training never saw."""
    passing = F.coalesce(F.col("quality_gate") == "pass", F.lit(False))
    synthetic = F.count_if((F.col("label") == "synthetic") & passing & F.coalesce(F.col("generator_id").isin(heldout), F.lit(False)))
    real = F.count_if((F.col("label") == "real") & passing)
    out = rows.agg(synthetic.alias("synthetic"), real.alias("real"))
    return out.withColumn("ready", (F.col("synthetic") >= least) & (F.col("real") >= least))


def comparable_ranks(results: DataFrame, metric: str, keys: tuple[str, ...] = COMPARABLE) -> DataFrame:
    """Ranks, best first, inside groups that are equal in every key."""
    return results.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(metric))))


def same_partition(jobs: DataFrame, role: str = "intended_role") -> DataFrame:
    """``partitions, single``: training and validation roles are one partition; a plan may have one only."""
    kind = F.when(F.col(role).isin("train", "validation"), "training").otherwise(F.col(role))
    return jobs.agg(F.count_distinct(kind).alias("partitions")).withColumn("single", F.col("partitions") == 1)


def until_failure(results: DataFrame, order: str, policy: str) -> DataFrame:
    """What a run keeps: everything under ``continue``, the rows up to the first failed one under ``stop``."""
    if policy not in ("continue", "stop"):
        raise ValueError(f"unknown failure policy {policy!r}")
    if policy == "continue":
        return results
    first = results.where("status = 'failed'").agg(F.min(order)).scalar()
    return results.where(first.isNull() | (F.col(order) <= first))


def uncovered_reviews(jobs: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """``key, problem``: valid jobs without a review, and reviews of no valid job."""
    a, b = jobs.select(key).distinct().withColumn("_a", F.lit(1)), reviews.select(key).distinct().withColumn("_b", F.lit(1))
    problem = F.when(F.col("_b").isNull(), "unreviewed").when(F.col("_a").isNull(), "unknown_job")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def evidence_rules() -> dict[str, Column]:
    """V14 on ``evidence_type, value, source``."""
    kind = F.col("evidence_type")
    return {
        "V14_asserts": (kind == "not_evaluated") & ~F.coalesce(F.col("value").isin("not_evaluated", "planned"), F.lit(False)),
        "V14_source": (kind == "human_review") & (F.coalesce("source", F.lit("")) == ""),
    }


def repeats(values: Column) -> Column:
    """V17: true for a list that names a value twice."""
    return F.coalesce(F.size(F.array_distinct(values)) < F.size(values), F.lit(False))


def fixture_rules() -> dict[str, Column]:
    """V11 of single-speaker and fixture generators."""
    listed = F.try_element_at("speaker_map", F.col("generator_speaker_name"))
    fixture, infrastructure = F.col("adapter") == "fake_sine", F.coalesce("infrastructure_only", F.lit(False))
    return {
        "V11_speaker": F.col("generator_speaker_name").isNotNull() & ~listed.eqNullSafe(F.col("generator_speaker_id")),
        "V11_fixture": F.coalesce(fixture, F.lit(False)) != infrastructure,
    }


def training_rules(heldout: list[str], sample_rate: int) -> dict[str, Column]:
    """Before training: every row has a split, no held-out generator in train or val, one sample rate."""
    return {
        "split_missing": F.col("split").isNull(),
        "unseen_leak": F.coalesce(F.col("split").isin("train", "val") & F.col("generator_id").isin(heldout), F.lit(False)),
        "sample_rate": F.coalesce(F.col("sample_rate") != sample_rate, F.lit(False)),
    }
