"""Row and table rules: each yields violations ``rule, key``; strict mode raises on the first ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import lineage

# Columns that describe a generator and must be null on real rows.
GENERATOR_COLUMNS = [
    "generator_id", "generator_family", "generator_version", "generator_model", "generator_runtime", "voice_id", "generator_speaker_id",
    "generator_speaker_name", "generation_seed", "generation_params", "intended_role", "quality_gate", "training_eligible", "diagnostic_only",
]
LANGUAGES = ("kk", "ru", "kk_ru", "other")
ROLES = {"train": ("train",), "val": ("train", "validation"), "test": ("train", "validation", "unseen_test")}


class RuleError(ValueError):
    pass


def row_rules(columns: list[str], languages: tuple[str, ...] = LANGUAGES) -> dict[str, Column]:
    """Rule name -> true where a row breaks it. Rules on absent columns are left out."""
    c, has = F.col, set(columns).issuperset
    synthetic = c("label") == "synthetic"
    blank = lambda name: F.coalesce(F.trim(name), F.lit("")) == ""
    rules = {
        "id_pattern": ({"sample_id"}, ~F.coalesce(c("sample_id").rlike("^[a-zA-Z0-9_-]+\\z"), F.lit(False))),
        "label": ({"label"}, ~F.coalesce(c("label").isin("real", "synthetic"), F.lit(False))),
        "language": ({"language"}, ~F.coalesce(c("language").isin(*languages), F.lit(False))),
        "V1": ({"label", "generator_id"}, (synthetic & blank("generator_id")) | ((c("label") == "real") & c("generator_id").isNotNull())),
        "V3": ({"source_text_id", "text_id"}, F.coalesce(c("source_text_id") != c("text_id"), F.lit(False))),
        "V4": ({"sample_id", "parent_sample_id"}, F.coalesce(c("sample_id") == c("parent_sample_id"), F.lit(False))),
        "V5": ({"related_speaker_ids"}, F.coalesce(F.exists("related_speaker_ids", lambda s: (F.trim(s) == "") | (F.trim(s) != s)), F.lit(False))),
        "V6": ({"usage_permission", "license", "rights_reference", "path"}, ~c("usage_permission").eqNullSafe(F.lit("approved")) | blank("license") | blank("rights_reference") | blank("path")),
        "V10": ({"license"}, F.coalesce(F.upper(F.trim("license")).startswith("TODO"), F.lit(False))),
        "V16": ({"path"}, F.coalesce(c("path").startswith("/") | F.contains(c("path"), F.lit(":\\")), F.lit(False))),
        "duration": ({"duration_sec"}, F.coalesce(~((c("duration_sec") > 0) & ~F.isnan("duration_sec") & (c("duration_sec") < float("inf"))), F.lit(False))),
    }
    own = [x for x in GENERATOR_COLUMNS if x in columns and x != "generator_id"]
    if own and has({"label"}):
        rules["V2"] = ({"label"}, (c("label") == "real") & reduce(lambda a, b: a | b, (c(x).isNotNull() for x in own)))
    return {name: F.coalesce(rule, F.lit(False)) for name, (needs, rule) in rules.items() if has(needs)}


def generator_rules() -> dict[str, Column]:
    """V11 to V13 on generator configurations or reviews."""
    c = F.col
    yes = lambda name: F.coalesce(c(name), F.lit(False))
    return {
        "V11_gate": yes("training_eligible") & ~c("quality_gate").eqNullSafe(F.lit("pass")),
        "V11_eligible_diagnostic": yes("training_eligible") & yes("diagnostic_only"),
        "V11_candidate_diagnostic": yes("candidate") & yes("diagnostic_only"),
        "V12_license": (F.coalesce(c("license_status"), F.lit("needs_review")) != "resolved") & ~yes("license_acknowledged") & ~yes("infrastructure_only"),
    }


def violations(rows: DataFrame, rules: dict[str, Column], key: str = "sample_id") -> DataFrame:
    """One scan: the names of a row's broken rules, exploded."""
    names = F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())))
    return rows.select(F.explode(names).alias("rule"), F.col(key).cast("string").alias("key"))


def unknown_columns(rows: DataFrame, allowed: list[str]) -> list[str]:
    return sorted(set(rows.columns) - set(allowed))


def duplicate_keys(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(F.lit("V8").alias("rule"), F.col(key).cast("string").alias("key"))


def lineage_violations(rows: DataFrame, key: str = "sample_id", parent: str = "parent_sample_id") -> DataFrame:
    found = lineage(rows.select(F.col(key).alias("id"), F.col(parent).alias("parent")))
    return found.where("status <> 'ok'").select(F.concat(F.lit("V9_"), "status").alias("rule"), F.col("id").cast("string").alias("key"))


def missing_references(rows: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """V15: values that don't resolve."""
    wanted = rows.select(F.col(column).alias("key")).where("key is not null").distinct()
    return wanted.join(known.select(F.col(key).alias("key")).distinct(), "key", "left_anti").select(F.lit("V15").alias("rule"), F.col("key").cast("string").alias("key"))


def role_problem(role: Column, split: Column) -> Column:
    """True where a role may not stand in a split; rows without a role may stand anywhere."""
    allowed = F.create_map(*(x for s, roles in ROLES.items() for x in (F.lit(s), F.array(*map(F.lit, roles)))))
    return F.when(role.isNull(), False).when(role == "external_challenge", True).otherwise(~F.coalesce(F.array_contains(F.try_element_at(allowed, split), role), F.lit(False)))


def role_accepts_split(role: Column, split: Column) -> Column:
    """Train texts serve any role of training; others only what is held out as far as they are."""
    return F.when(role == "train", True).when(role == "validation", split.isin("val", "test")).when(role.isin("unseen_test", "external_challenge"), split == "test").otherwise(False)


def require_none(found: DataFrame, what: str, show: int = 20) -> None:
    first = [tuple(r) for r in found.limit(show).collect()]
    if first:
        raise RuleError(f"{what}: {first}")


# The roles that a research partition accepts.
PARTITION_ROLES = {"train": ("train", "validation"), "protected_test": ("unseen_test",), "external_challenge": ("external_challenge",)}


def partition_violations(rows: DataFrame, partition: str) -> DataFrame:
    """``generator_id, role`` of synthetic rows whose role the partition doesn't accept, each pair once.

    Rows that carry neither a role nor a source text nor a family are passed over; a missing role is ``missing_role``.
    """
    c = F.col
    carries = c("intended_role").isNotNull() | (F.coalesce("source_text_id", F.lit("")) != "") | (F.coalesce("generator_family", F.lit("")) != "")
    accepted = F.coalesce(c("intended_role").isin(*PARTITION_ROLES[partition]), F.lit(False))
    bad = rows.where((c("label") == "synthetic") & carries & ~accepted)
    return bad.select("generator_id", F.coalesce(F.nullif("intended_role", F.lit("")), F.lit("missing_role")).alias("role")).distinct()
