"""Binary detection metrics per slice, as running sums over distinct scores.

Input: ``kind, key, y`` (1 positive), ``score``. The sums by score are combined before the shuffle; then slices are
cut into ranges of scores, so that neither a hot slice nor a million distinct scores meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranges import running_sums

SLICE = ("kind", "key")


def slices(scored: DataFrame, *columns: str) -> DataFrame:
    """Each row once under ``overall`` and once under each column's value."""
    stacked = [F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("key"))]
    stacked += [F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("key")) for c in columns]
    return scored.select(F.inline(F.array(*stacked)).alias("kind", "key"), "y", "score")


def score_problems(rows: DataFrame) -> DataFrame:
    """``kind, key, problem, n``: labels other than 0 and 1, and scores that are null, NaN or infinite. Metrics need a table without any."""
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    problem = F.when(~F.coalesce(F.col("y").isin(0, 1), F.lit(False)), "label").when(~finite, "score")
    return rows.select(*SLICE, problem.alias("problem")).where("problem is not null").groupBy(*SLICE, "problem").agg(F.count(F.lit(1)).alias("n"))


def roc_points(rows: DataFrame) -> DataFrame:
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    by_score = rows.groupBy(*SLICE, "score").agg(F.sum(weight * F.col("y")).alias("p"), F.sum(weight * (1 - F.col("y"))).alias("n"), F.lit(1).alias("one"))
    points = running_sums(by_score, list(SLICE), [F.desc("score")], ["p", "n", "one"])
    points = points.withColumnsRenamed({"p_upto": "tp", "n_upto": "fp", "p_all": "pos", "n_all": "neg", "one_all": "unique_scores"})
    # divided only where both classes exist: ANSI mode has no x / 0
    share = lambda part, whole: F.try_divide(part.cast("double"), F.col(whole))
    before = {"tpr0": share(F.col("tp") - F.col("p"), "pos"), "fpr0": share(F.col("fp") - F.col("n"), "neg")}
    return points.withColumns({"tpr": share(F.col("tp"), "pos"), "fpr": share(F.col("fp"), "neg"), **before})


def detection_metrics(rows: DataFrame) -> DataFrame:
    """``kind, key, n, status, roc_auc, eer, fpr_at_tpr95, unique_scores, score_min, score_max``."""
    points = roc_points(rows)
    d, d0 = F.col("fpr") + F.col("tpr") - 1, F.col("fpr0") + F.col("tpr0") - 1
    at_eer = F.when(d == 0, F.col("fpr")).otherwise(F.col("fpr0") + (F.col("fpr") - F.col("fpr0")) * F.try_divide(-d0, d - d0))
    at_95 = F.when(F.col("tpr") == F.col("tpr0"), F.col("fpr")).otherwise(F.col("fpr0") + (F.col("fpr") - F.col("fpr0")) * F.try_divide(0.95 - F.col("tpr0"), F.col("tpr") - F.col("tpr0")))
    out = points.groupBy(*SLICE).agg(
        F.first("pos").alias("pos"), F.first("neg").alias("neg"), F.first("unique_scores").alias("unique_scores"), F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.sum((F.col("fpr") - F.col("fpr0")) * (F.col("tpr") + F.col("tpr0")) / 2).alias("auc"),
        # tpr and fpr only grow: the first crossing is the one with the highest score
        F.max_by(at_eer, F.when(d >= 0, F.col("score"))).alias("eer"), F.max_by(at_95, F.when(F.col("tpr") >= 0.95, F.col("score"))).alias("fpr95"),
    )
    single = (F.col("pos") == 0) | (F.col("neg") == 0)
    status = F.when(single, "undefined_single_class").when(F.col("unique_scores") == 1, "degenerate_constant_scores").otherwise("ok")
    out = out.withColumn("status", status)
    ok = F.col("status") == "ok"
    return out.select(
        *SLICE, (F.col("pos") + F.col("neg")).cast("long").alias("n"), "status",
        F.when(ok, F.round("auc", 6)).alias("roc_auc"), F.when(ok, F.round("eer", 6)).alias("eer"), F.when(ok, F.round("fpr95", 6)).alias("fpr_at_tpr95"),
        *(F.when(~single, F.col(c)).alias(c) for c in ("unique_scores", "score_min", "score_max")),
    )


def shared_negative_ranks(scored: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The positives of each slice by ``column`` as ``key, score, p``, with ``above`` and ``upto`` (negatives with a higher score, and with one as high or higher), and the negatives' counts by score.

    An as-of join by ranges of scores: each negative score stands once before and once behind the positives with
    that score, so two running sums give both ranks. No negative is repeated for a slice.
    """
    own = scored.where("y = 1").groupBy(F.col(column).cast("string").alias("key"), "score").agg(F.count(F.lit(1)).alias("p"))
    negatives = cut(scored.where("y = 0").groupBy("score").agg(F.count(F.lit(1)).alias("n")))
    zero = F.lit(0).cast("long")
    stand = lambda side, first, last: F.struct(F.lit(side).alias("side"), first.alias("upto"), last.alias("above"))
    both = negatives.select("score", F.inline(F.array(stand(0, F.col("n"), zero), stand(2, zero, F.col("n")))))
    both = both.select(F.lit(None).cast("string").alias("key"), "score", zero.alias("p"), "side", "upto", "above")
    rows = both.unionByName(own.select("key", "score", "p", F.lit(1).alias("side"), zero.alias("upto"), zero.alias("above")))
    ranked = running_sums(rows, [], [F.desc("score"), F.col("side"), F.col("key")], ["upto", "above"])
    return ranked.where("side = 1").select("key", "score", "p", F.col("above_upto").alias("above"), F.col("upto_upto").alias("upto")), negatives


def shared_negative_metrics(scored: DataFrame, column: str) -> DataFrame:
    """``detection_metrics`` of the slices by a column of the positives, each against every negative row.

    The work is that of the positives and the negatives, not of slices times negatives: between two positive scores the
    rate of true positives stands still, so a curve is known from its positive scores and the ranks of those among the negatives.
    """
    ranks, negatives = shared_negative_ranks(scored, column)
    neg, neg_scores, neg_min, neg_max = negatives.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n"), F.min("score"), F.max("score")).first()  # one row
    points = running_sums(ranks.withColumn("one", F.lit(1)), ["key"], [F.desc("score")], ["p"])
    share = lambda part, whole: F.try_divide(part.cast("double"), whole)
    pos, all_neg = F.col("p_all"), F.lit(neg)
    points = points.withColumns(
        {"tpr": share(F.col("p_upto"), pos), "tpr0": share(F.col("p_upto") - F.col("p"), pos), "fpr": share(F.col("upto"), all_neg), "fpr0": share(F.col("above"), all_neg)}
    )
    # either the curve crosses while it runs along the negatives before this score, or at the score itself
    d, d0 = F.col("fpr") + F.col("tpr") - 1, F.col("fpr0") + F.col("tpr0") - 1
    step = F.col("fpr") - F.col("fpr0")
    at_eer = F.when(d0 >= 0, 1 - F.col("tpr0")).when(d == 0, F.col("fpr")).otherwise(F.col("fpr0") + step * F.try_divide(-d0, d - d0))
    at_95 = F.col("fpr0") + step * F.try_divide(0.95 - F.col("tpr0"), F.col("tpr") - F.col("tpr0"))
    out = points.groupBy("key").agg(
        F.first("p_all").alias("pos"), F.sum(F.col("p") * (neg - F.col("upto")) + F.col("p") * (F.col("upto") - F.col("above")) / 2).alias("won"),
        F.count_if(F.col("upto") == F.col("above")).alias("own_scores"), F.min("score").alias("lo"), F.max("score").alias("hi"),
        F.max_by(at_eer, F.when((d >= 0) | (d0 >= 0), F.col("score"))).alias("eer"), F.max_by(at_95, F.when(F.col("tpr") >= 0.95, F.col("score"))).alias("fpr95"),
    )
    unique = F.col("own_scores") + neg_scores
    status = F.lit("undefined_single_class") if not neg else F.when(unique == 1, "degenerate_constant_scores").otherwise("ok")
    ok = F.col("status") == "ok"
    both = F.lit(neg > 0)
    lowest, highest = (F.least("lo", F.lit(neg_min)), F.greatest("hi", F.lit(neg_max))) if neg else (F.col("lo"), F.col("hi"))
    return out.withColumn("status", status).select(
        F.lit(column).alias("kind"), "key", (F.col("pos") + neg).cast("long").alias("n"), "status",
        F.when(ok, F.round(F.col("won") / F.col("pos") / F.lit(max(neg, 1)), 6)).alias("roc_auc"), F.when(ok, F.round("eer", 6)).alias("eer"), F.when(ok, F.round("fpr95", 6)).alias("fpr_at_tpr95"),
        F.when(both, unique).alias("unique_scores"), F.when(both, lowest).alias("score_min"), F.when(both, highest).alias("score_max"),
    )


def eer_threshold(rows: DataFrame) -> DataFrame:
    """The score with the least |fpr - (1 - tpr)|, the highest of equal ones; slices without two classes and two scores give none."""
    gap = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    points = roc_points(rows).where("pos > 0 AND neg > 0 AND unique_scores > 1").withColumn("gap", gap)
    best = points.groupBy(*SLICE).agg(F.min_by(F.struct("score", "fpr", "tpr"), F.struct("gap", (-F.col("score")).alias("s"))).alias("b"))
    return best.select(*SLICE, F.col("b.score").alias("threshold"), F.round("b.fpr", 6).alias("fpr"), F.round("b.tpr", 6).alias("tpr"))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    said = F.col("score") >= threshold
    return rows.groupBy(*SLICE).agg(
        F.count_if((F.col("y") == 0) & ~said).alias("tn"), F.count_if((F.col("y") == 0) & said).alias("fp"),
        F.count_if((F.col("y") == 1) & ~said).alias("fn"), F.count_if((F.col("y") == 1) & said).alias("tp"),
    )


def coverage(expected: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Violations of exact coverage: missing, extra and duplicate keys, and scores that aren't finite."""
    e = expected.groupBy(key).agg(F.count(F.lit(1)).alias("e"))
    finite = F.coalesce(~F.isnan("score") & (F.abs("score") < float("inf")), F.lit(False))
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("p"), F.bool_and(finite).alias("finite"))
    both = e.join(p, key, "full_outer")
    problem = F.when(F.col("p").isNull(), "missing").when(F.col("e").isNull(), "extra").when(F.col("p") > 1, "duplicate").when(~F.col("finite"), "not_finite")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def protocol_slices(scored: DataFrame, generator: str, unseen: list[str]) -> DataFrame:
    """Metrics of all rows and of the seen and unseen generators, each against every negative; a slice without rows is ``empty``."""
    known = F.coalesce(F.col(generator).isin(unseen), F.lit(False))
    kind = F.lit("protocol").alias("kind")
    names = F.when(F.col("y") == 0, F.array(F.lit("overall"), F.lit("test_seen"), F.lit("test_unseen"))).otherwise(F.array(F.lit("overall"), F.when(known, "test_unseen").otherwise("test_seen")))
    found = detection_metrics(scored.select(kind, F.explode(names).alias("key"), "y", "score"))
    wanted = scored.sparkSession.createDataFrame([("overall",), ("test_seen",), ("test_unseen",)], "key string")  # three rows
    out = F.broadcast(wanted).join(found.drop("kind"), "key", "left")
    return out.select(kind, "key", *(F.coalesce(c, F.lit("empty")).alias(c) if c == "status" else F.coalesce(c, F.lit(0)).alias(c) if c == "n" else F.col(c) for c in found.columns if c not in ("kind", "key")))
