"""Operators and sinks that no query runs: plans, predictions, reports, rules, features."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import audio, text
from granary.operators import gates, rules, workers
from granary.sources import adapters, manifests

JOBS = "job_id string, text_id string, seed decimal(20,0)"


def test_plans_are_written_once_and_checked(spark, tmp_path):
    jobs = spark.createDataFrame([(f"j{k:02d}", f"t{k}", None if k == 3 else k) for k in range(20)], "job_id string, text_id string, seed long").repartition(4)
    folder = str(tmp_path / "plan")
    digest = adapters.write_plan(jobs, folder, {"policy": "skip"})
    back, metadata = adapters.read_plan(spark, folder, JOBS)
    assert metadata == {"policy": "skip", "generation_jobs_sha256": digest} and back.count() == 20 and back.where("seed is null").count() == 1
    lines = [x for f in sorted((tmp_path / "plan" / "generation_jobs").glob("part-*")) for x in f.read_text().splitlines()]
    assert [json.loads(x)["job_id"] for x in lines] == [f"j{k:02d}" for k in range(20)] and lines[3] == '{"job_id":"j03","seed":null,"text_id":"t3"}'
    with pytest.raises(FileExistsError):
        adapters.write_plan(jobs, folder, {})
    for bad in (jobs.limit(0), jobs.union(jobs)):
        with pytest.raises(rules.RuleError):
            adapters.write_plan(bad, str(tmp_path / "other"), {})
    changed = next(f for f in (tmp_path / "plan" / "generation_jobs").glob("part-*") if f.read_text())
    changed.write_text(changed.read_text().replace('"t', '"u', 1))
    next(tmp_path.glob(f"plan/generation_jobs/.{changed.name}.crc")).unlink()
    with pytest.raises(rules.RuleError, match="have changed"):
        adapters.read_plan(spark, folder, JOBS)
    with pytest.raises(rules.RuleError, match="no metadata"):
        adapters.read_plan(spark, str(tmp_path / "none"), JOBS)


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", 1 / 3)], "sample_id string, synthetic_score double")
    manifests.write_predictions(df, str(tmp_path / "p.csv"))
    assert {tuple(r) for r in manifests.read_predictions(spark, str(tmp_path / "p.csv")).collect()} == {("a", 0.5), ("b", 0.3333333333)}
    (tmp_path / "bad.csv").write_text("id,score\na,1\n")
    with pytest.raises(ValueError, match="header"):
        manifests.read_predictions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "odd.csv").write_text("sample_id,synthetic_score,decision\na,x,real\n")
    assert manifests.read_predictions(spark, str(tmp_path / "odd.csv")).first()["synthetic_score"] is None
    assert {tuple(r) for r in adapters.decisions(df, 0.5).collect()} == {("a", "0.5000000000", "synthetic"), ("b", "0.3333333333", "real")}


def test_scores_are_written_by_their_exact_values(spark, tmp_path):
    scores = {"below": 0.66780231735, "even": 0.50048828125, "odd": 0.50146484375, "least": 5e-324, "none": None}
    df = spark.createDataFrame(list(scores.items()), "sample_id string, synthetic_score double")
    want = {k: None if x is None else f"{x:.10f}" for k, x in scores.items()}
    assert (want["below"], want["even"]) == ("0.6678023173", "0.5004882812")
    assert {r["sample_id"]: r["synthetic_score"] for r in adapters.decisions(df, 0.5).collect()} == want
    manifests.write_predictions(df, str(tmp_path / "p.csv"))
    assert {r["sample_id"]: r["synthetic_score"] for r in spark.read.csv(str(tmp_path / "p.csv"), header=True).collect()} == want


def test_reports_are_new_and_finite(tmp_path):
    manifests.write_report({"b": 1, "a": "é"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": "é", "b": 1}
    with pytest.raises(FileExistsError):
        manifests.write_report({}, str(tmp_path / "r.json"))
    with pytest.raises(ValueError):
        manifests.write_report({"x": float("nan")}, str(tmp_path / "n.json"))


def test_generator_and_reference_rules(spark):
    columns = "sample_id string, training_eligible boolean, quality_gate string, diagnostic_only boolean, candidate boolean, license_status string, license_acknowledged boolean, infrastructure_only boolean"
    rows = [("ok", True, "pass", False, False, "resolved", None, None), ("gate", True, "warning", False, False, "resolved", None, None), ("both", True, "pass", True, True, "resolved", None, None), ("pending", False, None, None, None, None, None, None), ("known", False, None, None, None, None, True, None)]
    df = spark.createDataFrame(rows, columns)
    assert {tuple(r) for r in rules.violations(df, rules.generator_rules()).collect()} == {("V11_gate", "gate"), ("V11_eligible_diagnostic", "both"), ("V11_candidate_diagnostic", "both"), ("V12_license", "pending")}
    assert rules.unknown_columns(df, columns.replace(" string", "").replace(" boolean", "").split(", ")[1:]) == ["sample_id"]
    known = spark.createDataFrame([("m",)], "model_id string")
    wanted = spark.createDataFrame([("m",), ("x",), ("x",), (None,)], "model string")
    assert [tuple(r) for r in rules.missing_references(wanted, "model", known, "model_id").collect()] == [("V15", "x")]
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone"), ("d", "e"), ("e", "d")], "sample_id string, parent_sample_id string")
    assert {tuple(r) for r in rules.lineage_violations(chain).collect()} == {("V9_orphan", "c"), ("V9_cycle", "d"), ("V9_cycle", "e")}


def test_training_rules(spark):
    df = spark.createDataFrame([("a", "train", "g1", 16000), ("b", None, "g1", 16000), ("c", "val", "held", 16000), ("d", "test", "held", 8000)], "sample_id string, split string, generator_id string, sample_rate int")
    assert {tuple(r) for r in rules.violations(df, gates.training_rules(["held"], 16000)).collect()} == {("split_missing", "b"), ("unseen_leak", "c"), ("sample_rate", "d")}


def test_hot_parents(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") > 0, F.when(F.col("id") < 1500, 0).otherwise(F.col("id") - 1)).alias("parent"))
    from granary.operators.graph import lineage

    found = {r["id"]: (r["root"], r["depth"], r["status"]) for r in lineage(rows).collect()}
    assert found[0] == (0, 0, "ok") and found[700] == (0, 1, "ok") and found[1999] == (0, 501, "ok") and len(found) == 2000


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, 10, 0), (2.0, 1000, 1), (-40.0, 0, 2)], "x double, chars int, turn int")
    got = df.select(audio.sigmoid(F.col("x")).alias("s"), text.token_cap(F.col("chars"), 0.5, 10, 20, 100).alias("cap"), text.retry_seed(F.lit("18446744073709551615").cast("decimal(20,0)"), F.col("turn"), 3).alias("seed")).collect()
    assert [r["cap"] for r in got] == [20, 100, 20] and [int(r["seed"]) for r in got] == [2**64 - 1, 2, 5]
    assert [r["s"] for r in got] == pytest.approx([0.5, 1 / (1 + np.exp(-2)), 1 / (1 + np.exp(40))])


def test_log_mel_as_an_operator(spark):
    wave = [float(np.sin(k / 5)) for k in range(4000)]
    df = spark.createDataFrame([(1, wave, 16000), (2, [], 16000)], "id int, samples array<float>, rate int")
    found = {r["id"]: r for r in workers.apply_worker(df, workers.LogMel, "id", "bands int, frames int, features array<float>").collect()}
    own = audio.log_mel(np.array(wave, np.float32), 16000)
    assert (found[1]["bands"], found[1]["frames"]) == own.shape and np.allclose(found[1]["features"], own.ravel(), atol=1e-5)
    assert found[2]["error"] == "ValueError: no samples"
