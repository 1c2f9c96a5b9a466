"""Dataset reports, job plans, resume decisions and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import hash_u64
from ..session import Scratch
from .runs import digests
from .skew import with_groups


def distribution(rows: DataFrame, *columns: str) -> DataFrame:
    """``field, value, n`` of several columns in one pass; null, '' and 0 are ``unknown``."""
    value = lambda c: F.coalesce(F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")), F.lit("unknown"))
    stacked = F.array(*(F.struct(F.lit(c).alias("field"), value(c).alias("value")) for c in columns))
    return rows.select(F.inline(stacked).alias("field", "value")).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(rows: DataFrame, digest: str, key: str) -> DataFrame:
    own = rows.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.array_sort(F.collect_list(key)).alias("ids"), F.count(F.lit(1)).alias("n"))
    return own.where("n > 1")


def duplicate_members(rows: DataFrame, digest: str, key: str) -> DataFrame:
    """The rows of groups that share a digest, a row each: ``digest, key, first`` (the group's least key) and ``n``; no group is gathered."""
    with Scratch(rows.sparkSession) as scratch:
        own = scratch.cut(rows.select(digest, key))
        return scratch.keep(with_groups(own, digest, own.count(), scratch, least=2, first=F.min(key)).select(digest, key, "first", F.col("size").alias("n")))


def missing_metadata(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, n``: the greater of rows that name the field as missing and rows whose field is null."""
    counts = [F.greatest(F.count_if(F.array_contains("missing_metadata", f)), F.count_if(F.col(f).isNull())).alias(f) for f in fields]
    return rows.agg(*counts).select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields))))


def known_speakers(rows: DataFrame) -> DataFrame:
    """``speakers``: distinct ones of rows that don't name the speaker as missing."""
    named = ~F.coalesce(F.array_contains("missing_metadata", "speaker_id"), F.lit(False))
    return rows.agg(F.count_distinct(F.when(named, F.col("speaker_id"))).alias("speakers"))


def dimension_counts(rows: DataFrame, dimensions: dict[str, Column], amount: Column) -> DataFrame:
    """Counts and sums by each single dimension, in one pass; null is ``default``."""
    stacked = F.array(*(F.struct(F.lit(k).alias("dimension"), F.coalesce(v.cast("string"), F.lit("default")).alias("value")) for k, v in dimensions.items()))
    out = rows.select(F.inline(stacked).alias("dimension", "value"), amount.alias("amount")).groupBy("dimension", "value")
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("amount", F.lit(0))).alias("amount"))


def job_plan(texts: DataFrame, generators: DataFrame, fields: list[str], accepts: Column) -> DataFrame:
    """Texts times generators times voices where languages and roles agree; id and seed from canonical JSON.

    ``fields``: payload columns in key order. Generators are configuration, a few rows by nature.
    """
    voices = generators.withColumn("voice_id", F.explode_outer("voices"))
    jobs = texts.join(voices, F.array_contains(voices["languages"], texts["language"]) & accepts)
    payload = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return jobs.withColumn("payload", payload).withColumn("job_id", F.concat(F.lit("job_"), F.substring(F.sha2("payload", 256), 1, 24))).withColumn("seed", hash_u64(F.col("payload")))


def resume_actions(plan: DataFrame, outputs: DataFrame, key: str, policy: str) -> DataFrame:
    """``action`` per job under skip, fail or regenerate; ``outputs`` has ``valid``. Results outside the plan are ``unplanned``."""
    joined = plan.select(key, F.lit(True).alias("planned")).join(outputs.select(key, "valid"), key, "full_outer")
    exists = F.col("valid").isNotNull()
    act = {
        "skip": F.when(~exists, "run").when(F.col("valid"), "skip").otherwise("error_invalid"),
        "fail": F.when(~exists, "run").otherwise("error_exists"),
        "regenerate": F.when(exists, "redo").otherwise("run"),
    }[policy]
    return joined.select(key, F.when(F.col("planned").isNull(), "unplanned").otherwise(act).alias("action"))


def generation_totals(plan: DataFrame, results: DataFrame, key: str = "job_id") -> DataFrame:
    """One row: jobs planned, completed and skipped with a valid output, failed (failed results and invalid outputs), and distinct texts generated.

    ``plan``: key, text_id. ``results``: key, status (completed, skipped, failed), valid.
    """
    own = plan.join(results.select(key, "status", "valid"), key, "left")
    good = F.coalesce(F.col("valid"), F.lit(False)) & F.col("status").isin("completed", "skipped")
    bad = (F.col("status") == "failed") | (F.col("status").isin("completed", "skipped") & ~F.coalesce(F.col("valid"), F.lit(False)))
    return own.agg(
        F.count(F.lit(1)).alias("planned"), F.count_if(good & (F.col("status") == "completed")).alias("completed"), F.count_if(good & (F.col("status") == "skipped")).alias("skipped"),
        F.count_if(bad).alias("failed"), F.count_distinct(F.when(good, F.col("text_id"))).alias("texts"),
    )


def gates_by_generator(reviews: DataFrame, jobs: DataFrame) -> DataFrame:
    """The quality gate of each generator, over the reviews of samples (``synth_<job id>``) that its jobs made."""
    made = jobs.select(F.concat(F.lit("synth_"), "job_id").alias("sample_id"), "generator_id")
    return quality_gate(reviews.join(made, "sample_id"), "generator_id")


def run_status(jobs: Column, failed: Column, done: Column) -> Column:
    return F.when(done + failed < jobs, "incomplete").when(failed > 0, "complete_with_failures").otherwise("complete")


def quality_gate(reviews: DataFrame, *by: str) -> DataFrame:
    """fail > pending > warning > passed; a group without reviews counts as passed, and nothing holds for all of it."""
    own = reviews.groupBy(*by) if by else reviews.groupBy()
    gate = F.when(F.count_if(F.col("gate") == "fail") > 0, "fail").when(F.count_if(F.col("gate") == "pending") > 0, "pending").when(F.count_if(F.col("gate") == "warning") > 0, "warning").otherwise("passed")
    no = F.lit(False)
    return own.agg(
        gate.alias("gate"), F.coalesce(F.bool_and("eligible"), no).alias("all_eligible"), F.coalesce(F.bool_and("diagnostic"), no).alias("all_diagnostic"),
        F.coalesce(F.bool_or("candidate"), no).alias("any_candidate"), F.count(F.lit(1)).alias("n"),
    )


def best_epoch(epochs: DataFrame, patience: int) -> DataFrame:
    """The epoch with the greatest auc, then the least loss, then the first, among those before early stopping.

    Epochs are a training log: a few rows by nature, hence the window over all of them.
    """
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    marked = epochs.withColumn("better", F.coalesce(F.col("auc") > F.max("auc").over(before), F.lit(True)))
    marked = marked.withColumn("since", F.col("epoch") - F.max(F.when(F.col("better"), F.col("epoch"))).over(upto))
    marked = marked.withColumn("stopped", F.coalesce(F.max(F.col("since") >= patience).over(before), F.lit(False)))
    return marked.where(~F.col("stopped")).orderBy(F.desc("auc"), "loss", "epoch").limit(1).select("epoch", "auc", "loss")


def dataset_hash(rows: DataFrame, name: str, order: list[str], content: Column, separator: str = "") -> DataFrame:
    """``dataset_hash, files``: sha256 over each file's name followed by its content, files in order of their names; one row per piece of content.

    A file's pieces, in ``order`` (unique within a file), are joined by ``separator``. The bytes go through one task after
    another (``digests``), as one digest over all of them demands; nothing is gathered. Rows without a name are left out.
    """
    with Scratch(rows.sparkSession) as scratch:
        pieces = rows.select(F.col(name).alias("name"), F.struct(*order).alias("at"), content.cast("string").alias("piece"))
        led = with_groups(pieces, "name", pieces.count(), scratch, first=F.min("at"))
        value = F.concat(F.when(F.col("at") == F.col("first"), F.col("name")).otherwise(F.lit(separator)), F.coalesce("piece", F.lit("")))
        digest = digests(led, [], [F.col("name"), F.col("at")], value, name="dataset_hash")
        return scratch.keep(digest.withColumn("files", F.lit(pieces.where("name is not null").agg(F.count_distinct("name")).first()[0])))
