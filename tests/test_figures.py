"""Metrics with shared negatives, exact quantiles, moments and streaming digests against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import audio
from granary.operators import graph, metrics, quantiles, reports, runs
from granary.session import Scratch

COLUMNS = "key n status roc_auc eer fpr_at_tpr95 unique_scores score_min score_max".split()


def replicated(scored, column):
    """The slices with every negative repeated in each, as the definition has it."""
    keys = scored.where("y = 1").select(F.col(column).alias("key")).distinct()
    negatives = keys.crossJoin(scored.where("y = 0").select("y", "score"))
    own = scored.where("y = 1").select(F.col(column).alias("key"), "y", "score").unionByName(negatives)
    return metrics.detection_metrics(own.withColumn("kind", F.lit(column)))


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_shared_negatives_equal_replicated_ones(spark, digits):
    draw = random.Random(digits)
    rows = [(draw.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"]), int(draw.random() < 0.4), round(draw.random() * 0.8 + 0.1, digits)) for _ in range(400)]
    rows += [("one", 1, 0.05), ("top", 1, 2.0), ("low", 1, -1.0), ("same", 1, 0.5), ("same", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, score double")
    sort = lambda d: sorted(map(tuple, d.select(COLUMNS).collect()), key=str)
    assert sort(metrics.shared_negative_metrics(df, "g")) == sort(replicated(df, "g"))


def test_shared_negatives_without_a_class_or_a_second_score(spark):
    schema = "g string, y int, score double"
    only = spark.createDataFrame([("a", 1, 0.4), ("b", 1, 0.6)], schema)
    assert {(r["key"], r["status"], r["n"], r["roc_auc"]) for r in metrics.shared_negative_metrics(only, "g").collect()} == {("a", "undefined_single_class", 1, None), ("b", "undefined_single_class", 1, None)}
    flat = spark.createDataFrame([("a", 1, 0.5), (None, 0, 0.5), (None, 0, 0.5)], schema)
    assert [(r["status"], r["unique_scores"], r["eer"]) for r in metrics.shared_negative_metrics(flat, "g").collect()] == [("degenerate_constant_scores", 1, None)]
    assert metrics.shared_negative_metrics(flat.where("y = 0"), "g").count() == 0 == metrics.shared_negative_metrics(flat.limit(0), "g").count()


def test_many_slices_cost_positives_and_negatives(spark):
    """500 slices, 3,000 negatives: the ranks have one row for each positive score and two for each negative one."""
    rows = spark.range(4000).select(F.concat(F.lit("g"), F.col("id") % 500).alias("g"), (F.col("id") < 1000).cast("int").alias("y"), (F.xxhash64("id") / 2.0**64).alias("score"))
    ranks, negatives = metrics.shared_negative_ranks(rows, "g")
    assert (ranks.count(), negatives.count()) == (1000, 3000)
    assert metrics.shared_negative_metrics(rows, "g").count() == 500


@pytest.mark.parametrize("p", [0.0, 0.5, 0.9, 1.0])
def test_quantiles_of_hot_groups(spark, monkeypatch, p):
    monkeypatch.setattr(quantiles, "SMALL", 20)
    monkeypatch.setattr(quantiles, "HOT", 10)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    draw = random.Random(1)
    groups = {
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.uniform(-300, 300) for _ in range(300)], "even": [draw.random() for _ in range(301)], "ties": [float(draw.randrange(3)) for _ in range(200)],
        "same": [7.0] * 150, "small": [3.0, 1.0], "outlier": [1e308, -1e308, *(draw.random() for _ in range(200))], None: [float(k) for k in range(99)], "close": [1 + k * 2.0**-52 for k in range(64)],
    }
    rows = [(g, x) for g, v in groups.items() for x in v] + [("small", None), ("none", None)]
    found = {r["g"]: r["q"] for r in quantiles.quantiles(spark.createDataFrame(rows, "g string, x double").repartition(5), "g", "x", p, "q").collect()}
    assert found.keys() == groups.keys()
    for g, v in groups.items():
        low, high = np.sort(v)[[int(np.floor((len(v) - 1) * p)), int(np.ceil((len(v) - 1) * p))]]
        part = (len(v) - 1) * p % 1
        assert found[g] == pytest.approx((1 - part) * low + part * high, rel=1e-14)


def test_quantile_of_a_group_of_distinct_values(spark):
    """3,000,000 distinct values of one group, over the bound of plain aggregation: what meets in a task are counts of ranges."""
    n = 3_000_000
    rows = spark.range(0, n, 1, 16).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("x"))
    assert quantiles.quantiles(rows, "g", "x", 0.5).first()["value"] == (n - 1) / 2


def test_moments_equal_numpy(spark):
    draw = random.Random(3)
    arrays = [[1.0, 2.0, 4.0], [1e8 + 1, 1e8 + 2, 1e8 + 4], [5.0], [], [None, 3.0, 5.0], [draw.gauss(1e8, 1) for _ in range(500)], [0.0] * 9, None]
    df = spark.createDataFrame([(k, k % 2, a) for k, a in enumerate(arrays)], "id int, g int, v array<double>")
    for r in df.select("id", audio.mean_std(F.col("v")).alias("m")).collect():
        own = [x for x in arrays[r["id"]] or [] if x is not None]
        assert r["m"]["mean"] == (pytest.approx(np.mean(own), rel=1e-14) if own else None)
        assert r["m"]["std"] == (pytest.approx(np.std(own, ddof=1), rel=1e-9, abs=1e-12) if len(own) > 1 else None)
    a, b = (F.col("v").getItem(0), F.col("v").getItem(1))
    both = df.where("id in (1, 5)").agg(F.collect_list("v").alias("v")).select(audio.merged(audio.moments(a), audio.moments(b)).alias("m"), audio.moments(F.flatten("v")).alias("w")).first()
    assert both["m"]["n"] == both["w"]["n"] == 503 and both["m"]["m2"] == pytest.approx(both["w"]["m2"], rel=1e-9)
    pooled = {r["g"]: (r["n"], r["mean"], r["std"]) for r in audio.pooled(df, "g", "v").collect()}
    for g in (0, 1):
        every = [x for k, v in enumerate(arrays) if k % 2 == g for x in v or [] if x is not None]
        assert pooled[g] == (len(every), pytest.approx(np.mean(every), rel=1e-12), pytest.approx(np.std(every, ddof=1), rel=1e-9))


def test_digests_of_groups(spark):
    rows = [(1, 3, "c"), (1, 1, "ä"), (1, 2, None), (None, 1, "x"), (2, 1, "")]
    df = spark.createDataFrame(rows, "g int, at int, v string")
    found = {r["g"]: r["sha256"] for r in runs.digests(df, ["g"], [F.col("at")], F.col("v"), b"|", prefix=b"42:").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {1: sha("42:ä||c"), None: sha("42:x"), 2: sha("42:")}
    whole = runs.digests(df.where("g = 1"), [], [F.col("at")], F.col("v"), name="d", algorithm="md5").collect()
    assert [r["d"] for r in whole] == [hashlib.md5("äc".encode()).hexdigest()]
    assert runs.digests(df.limit(0), ["g"], [F.col("at")], F.col("v")).count() == 0


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_long_groups_are_digested_part_by_part(spark, monkeypatch, algorithm):
    monkeypatch.setattr(runs, "PART_BYTES", 5000)
    streamed, sizes = runs._streamed, []

    def watched(narrow, keys, *rest):
        sizes.extend(r[-1] for r in narrow.groupBy(*keys).agg(F.coalesce(F.sum(F.octet_length("_value")), F.lit(0))).collect())
        return streamed(narrow, keys, *rest)

    monkeypatch.setattr(runs, "_streamed", watched)
    rows = [("even", k, f"{k}ä" * 5) for k in range(500)] + [("long", k, "xyzé" * (3000 if k == 7 else k)) for k in range(20)] + [(None, k, "n" * 300 if k % 3 else None) for k in range(40)]
    rows += [("tied", 1, "0123456789" * 400)] * 3 + [("short", k, "s") for k in range(5)] + [("", 0, None)]
    df = spark.createDataFrame(rows, "g string, at int, v string").repartition(5)
    want = {}
    for g, _, v in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append(v or "")
    digest = lambda values: hashlib.new(algorithm, ("42:" + "||".join(values)).encode()).hexdigest()
    found = {r["g"]: r["d"] for r in runs.digests(df, ["g"], [F.col("at")], F.col("v"), b"||", "d", prefix=b"42:", algorithm=algorithm).collect()}
    assert found == {g: digest(v) for g, v in want.items()}
    assert sorted(sizes) == [0, 5]  # what went through one task
    whole = runs.digests(df, [], [F.col("g"), F.col("at")], F.col("v"), b"||", "d", prefix=b"42:", algorithm=algorithm).collect()
    in_order = [v for g in sorted(want, key=lambda g: (g is not None, g or "")) for v in want[g]]
    assert [r["d"] for r in whole] == [digest(in_order)]
    assert len(sizes) == 2


def test_split_of_a_component_of_a_million(spark):
    n = 1_000_000
    rows = spark.range(0, n, 1, 8).select(F.format_string("s%07d", "id").alias("sample_id"), F.when(F.col("id") == n - 1, "alone").otherwise("giant").alias("component"))
    found = graph.assign_splits(rows, seed=42, train=0.4, validation=0.3).groupBy("component", "split").count().collect()

    def split(ids):
        at = int(hashlib.sha256(("42:" + "|".join(ids)).encode()).hexdigest()[:16], 16) / 2**64
        return "train" if at < 0.4 else "val" if at < 0.7 else "test"

    giant = split(f"s{k:07d}" for k in range(n - 1))
    assert {tuple(r) for r in found} == {("giant", giant, n - 1), ("alone", split([f"s{n - 1:07d}"]), 1)}


def test_dataset_hash_goes_over_names_and_contents(spark):
    files = {"b.jsonl": ["1", "2", "3"], "a.jsonl": ["x"]}
    df = spark.createDataFrame([(n, k, p) for n, v in files.items() for k, p in enumerate(v)], "name string, k int, piece string")
    want = hashlib.sha256(("a.jsonl" + "x" + "b.jsonl" + "1\n2\n3").encode()).hexdigest()
    assert [tuple(r) for r in reports.dataset_hash(df, "name", ["k"], F.col("piece"), "\n").collect()] == [(want, 2)]


def test_group_samples_with_a_hot_token(spark):
    tokens = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("sample_id"), F.explode(F.array(F.lit("hot"), F.concat(F.lit("own"), F.col("id")))).alias("token"))
    found = graph.group_samples(tokens.select("sample_id").distinct(), tokens).groupBy("component").count().collect()
    assert [tuple(r) for r in found] == [("s0", 3000)]


def test_scratch_tables_go(spark):
    with Scratch(spark) as scratch:
        cut = scratch.cut(spark.range(3))
        path = cut.inputFiles()[0]
    assert path and not __import__("os").path.exists(path.removeprefix("file://"))
