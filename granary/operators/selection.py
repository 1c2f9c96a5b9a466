"""Filters, eligibility, budgets and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch
from .ranges import running_sums
from .rules import RuleError, duplicate_keys, require_none
from .skew import with_groups

ALLOWED = ("language", "label", "speaker_id", "source_id", "generator_id")


def canonical_filter(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    if bad := sorted(set(wanted) - set(ALLOWED)):
        raise ValueError(f"no filter on {bad}")
    for name, values in wanted.items():
        rows = rows.where(F.coalesce(F.col(name), F.lit("")).isin(values))
    return rows


def compose_eligible() -> Column:
    """Synthetic rows for a composed corpus: three-valued flags are compared null-safely."""
    c = F.col
    return (c("label") == "synthetic") & c("quality_gate").eqNullSafe(F.lit("pass")) & c("training_eligible").eqNullSafe(F.lit(True)) & c("diagnostic_only").eqNullSafe(F.lit(False)) & c("intended_role").eqNullSafe(F.lit("train"))


def training_eligible() -> Column:
    """Real rows, and eligible synthetic ones of a passing or warning gate that aren't known to be diagnostic."""
    c = F.col
    gate = F.coalesce(c("quality_gate").isin("pass", "warning"), F.lit(False))
    return (c("label") == "real") | (c("training_eligible").eqNullSafe(F.lit(True)) & gate & ~c("diagnostic_only").eqNullSafe(F.lit(True)))


def compose(real: DataFrame, synthetic: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Real rows and eligible synthetic ones of ``languages``, splits reset and paths by id.

    A real table with other labels, no real or no eligible row left, and ids that occur twice are errors.
    """
    if not real.where("label <> 'real' or label is null").isEmpty():
        raise RuleError("the real table must hold real rows only")
    if languages:
        real, synthetic = (t.where(F.col("language").isin(languages)) for t in (real, synthetic))
    eligible = synthetic.where(compose_eligible())
    for name, part in (("real", real), ("eligible synthetic", eligible)):
        if part.isEmpty():
            raise RuleError(f"no {name} row is left")
    both = real.unionByName(eligible, allowMissingColumns=True)
    require_none(duplicate_keys(both), "composed corpus")
    suffix = F.regexp_extract("path", "(\\.[^./]+)?\\z", 1)
    return both.withColumns({"split": F.lit(None).cast("string"), "path": F.concat(F.lit("audio/"), "sample_id", suffix)})


def first_sorted(rows: DataFrame, order: str, k: int) -> DataFrame:
    """The first k rows in ``order``: each task keeps k at the most before they are merged."""
    return rows.orderBy(order).limit(k)


def limits(rows: DataFrame, by: str, order: str, per_group: int, total: int) -> DataFrame:
    """At most ``per_group`` rows of each group, then at most ``total`` of all, both in ``order``."""
    return first_sorted(top_k(rows, by, order, per_group).drop("rn"), order, total)


def budget(rows: DataFrame, amount: str, order: str, limit: float, by: str | None = None) -> DataFrame:
    """The prefix in ``order`` whose running sum stays within ``limit``, with ``running``; null amounts count 0, negative ones are not meant.

    With ``by``, a prefix per group. The rows are written in ranges (see ``running_sums``): select the columns that matter before.
    """
    own = rows.withColumn("_amount", F.coalesce(F.col(amount), F.lit(0)))
    found = running_sums(own, [by] if by else [], [F.col(order)], ["_amount"]).withColumnRenamed("_amount_upto", "running")
    return found.where(F.col("running") <= limit).select(*rows.columns, "running")


def composed(rows: DataFrame, amount: str, order: str, by: str, limits: DataFrame, total_rows: int | None = None, total_amount: float | None = None) -> DataFrame:
    """First each group's limits, then those of the whole: in both, the first rows in ``order`` up to a number, and of these the prefix whose sum of ``amount`` stays within a bound.

    ``limits`` has ``by``, ``max_rows`` and ``max_amount`` (null: none), a row for each group that is wanted, few by nature.
    Amounts are not negative; nulls count 0. ``order`` is unique.
    """

    def within(part: DataFrame, keys: list[str], most_rows: Column, most: Column) -> DataFrame:
        marked = part.withColumns({"_one": F.lit(1), "_amount": F.coalesce(F.col(amount), F.lit(0))})
        sums = running_sums(marked, keys, [F.col(order)], ["_one", "_amount"])
        fits = F.coalesce(F.col("_one_upto") <= most_rows, F.lit(True)) & F.coalesce(F.col("_amount_upto") <= most, F.lit(True))
        return sums.where(fits).select(*part.columns)

    few = limits.select(by, F.col("max_rows").alias("_rows"), F.col("max_amount").alias("_most"))
    own = within(rows.join(F.broadcast(few), by), [by], F.col("_rows"), F.col("_most")).select(*rows.columns)
    if total_rows is None and total_amount is None:
        return own
    return within(own, [], F.lit(total_rows).cast("long"), F.lit(total_amount).cast("double"))


def top_k(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first k rows per group; Spark cuts each task's groups to k before the shuffle."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("rn") <= k)


def text_filter(rows: DataFrame, languages: list[str], most: int, sources: list[str] | None = None) -> DataFrame:
    out = rows.where(F.col("language").isin(languages) & (F.char_length("text") <= most))
    return out.where(F.col("source").isin(sources)) if sources else out


def inventory(rows: DataFrame, ordinal: str) -> DataFrame:
    """One item per text id: the first row's values, all sample ids in order, and whether rows disagree on the split."""
    first = F.min_by(F.struct("normalized_text", "language", "split"), ordinal)
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("sample_id").alias("s")))), lambda x: x["s"])
    out = rows.groupBy("text_id").agg(first.alias("f"), ids.alias("source_sample_ids"), (F.count_distinct(F.coalesce("split", F.lit("\0"))) > 1).alias("conflict"))
    return out.select("text_id", "f.normalized_text", "f.language", "f.split", "source_sample_ids", "conflict")


def first_wins(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The membership of ``inventory``'s items, a row each instead of a list: the rows with ``first`` (the ordinal that won), ``rows`` (of the item) and ``conflict``."""
    with Scratch(rows.sparkSession) as scratch:
        own = scratch.cut(rows)
        found = with_groups(own, key, own.count(), scratch, first=F.min(ordinal), conflict=F.count_distinct(F.coalesce("split", F.lit("\0"))) > 1)
        return scratch.keep(found.withColumnRenamed("size", "rows"))


def extract_new(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows that an append-only target lacks."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")
