import datetime
import hashlib
import json
import random
import unicodedata
import wave
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import audio, text
from granary.operators import graph, metrics, rag, reports, rules, selection
from granary.sources import manifests
from granary.streaming.upsert import ResultStore, RunStore, stream_upsert


def scored(spark, labels, scores):
    return spark.createDataFrame([("overall", "all", int(y), float(s)) for y, s in zip(labels, scores, strict=True)], "kind string, key string, y int, score double")


@pytest.mark.parametrize(
    ("labels", "scores", "want"),
    # worked out by hand: of six pairs of a positive and a negative, three or five are in order
    [
        ([1, 0, 1, 0, 1], [0.9, 0.7, 0.6, 0.3, 0.2], ("ok", 0.5, 0.5, 1)),
        ([1, 1, 0, 1, 0], [0.95, 0.6, 0.55, 0.5, 0.1], ("ok", 0.833333, 0.333333, 0.5)),
        ([1, 0, 1], [0.25, 0.25, 0.25], ("degenerate_constant_scores", None, None, None)),
        ([1, 1, 1], [0.2, 0.3, 0.4], ("undefined_single_class", None, None, None)),
    ],
)
def test_metric_goldens(spark, labels, scores, want):
    r = metrics.detection_metrics(scored(spark, labels, scores)).first()
    assert (r["status"], r["roc_auc"], r["eer"], r["fpr_at_tpr95"]) == want


def test_threshold_and_coverage(spark):
    r = metrics.eer_threshold(scored(spark, [1, 1, 0, 1, 0], [0.95, 0.6, 0.55, 0.5, 0.1])).first()
    assert (r["threshold"], r["fpr"], r["tpr"]) == (0.55, 0.5, 0.666667)
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    p = spark.createDataFrame([("a", 0.1), ("b", float("nan")), ("d", 0.2), ("a", 0.1)], "id string, score double")
    assert {tuple(x) for x in metrics.coverage(e, p, "id").collect()} == {("a", "duplicate"), ("b", "not_finite"), ("c", "missing"), ("d", "extra")}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_splits_and_order(spark):
    cols = "sample_id string, label string, speaker_id string, related_speaker_ids array<string>, source_id string, parent_sample_id string, source_sha256 string, source_text_id string, text_id string"
    rows = [("a", "real", "s1", ["s2"], "x1", None, None, None, None), ("b", "real", "s2", None, "x2", None, None, None, "t"), ("c", "synthetic", "s9", None, "x3", None, None, "t", None), ("d", "synthetic", "s1", None, "x4", None, None, None, None), ("e", "synthetic", "q", None, "x5", "d", None, None, None)]
    one = {tuple(r) for r in graph.group_samples(spark.createDataFrame(rows, cols)).collect()}
    other = {tuple(r) for r in graph.group_samples(spark.createDataFrame(rows[::-1], cols)).collect()}
    assert one == other == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}
    g = spark.createDataFrame([(f"s{i}", f"c{i // 2}", f"g{i % 5}") for i in range(60)], "sample_id string, component string, generator_id string")
    s = graph.assign_splits(g, seed=1, train=0.6, validation=0.2, holdout=F.col("generator_id") == "g3").toPandas()
    assert s.groupby("component").split.nunique().max() == 1 and set(s.split) == {"train", "val", "test"}
    assert set(s[s.sample_id.isin([f"s{i}" for i in range(60) if i % 5 == 3])].split) == {"test"}
    with pytest.raises(ValueError):
        graph.assign_splits(g, seed=1, train=0.9, validation=0.2)


def test_lineage(spark):
    rows = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "x"), ("p", "q"), ("q", "p"), ("r", "p")], "id string, parent string")
    got = {r["id"]: (r["root"], r["depth"], r["status"]) for r in graph.lineage(rows).collect()}
    assert got["c"] == ("a", 2, "ok") and got["a"] == ("a", 0, "ok") and got["y"][2] == got["x"][2] == "orphan"
    assert got["p"][2] == got["q"][2] == got["r"][2] == "cycle"


def test_text_functions(spark):
    df = spark.createDataFrame([("  Straße\u2003Ä ", "kk")], "t string, lang string")
    r = df.select(text.normalize_text("t").alias("a"), text.normalize_text_exact("t").alias("b"), text.sentence_form(F.lit("«привет")).alias("s"), text.retry_seed(F.lit(str(2**64 - 1)).cast("decimal(20,0)"), F.lit(1), 2).alias("seed")).first()
    assert r["a"] == r["b"] == "strasse ä" and r["s"] == "«Привет." and r["seed"] == 1
    paths = {"a/b": True, "../a": False, "a/../../b": False, "/a": False, "C:\\x": False, "a/../b": True}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text.contained_path(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths
    urls = {"https://example.com/x": True, "http://example.com": False, "https://localhost/": False, "https://10.0.0.1/": False, "https://172.20.1.1": False, "https://8.8.8.8": True, "x": False}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", text.public_endpoint(F.col("u")).alias("ok")).collect()
    assert {r["u"]: r["ok"] for r in got} == urls


def test_eligibility_three_valued(spark):
    rows = [("real", None, None, None, None), ("synthetic", "pass", True, False, "train"), ("synthetic", "pass", True, None, "train"), ("synthetic", "warning", True, False, "train"), ("synthetic", "pass", None, False, "train"), ("synthetic", "pass", True, True, "train")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, label string, quality_gate string, training_eligible boolean, diagnostic_only boolean, intended_role string")
    assert [r.i for r in df.where(selection.compose_eligible()).collect()] == [1]
    assert [r.i for r in df.where(selection.training_eligible()).collect()] == [0, 1, 2, 3]


def test_budget_is_a_prefix(spark):
    df = spark.createDataFrame([(f"{i:03}", float(i % 7 + 1)) for i in range(200)], "id string, d double")
    got = sorted(r["id"] for r in selection.budget(df, "d", "id", 100.0).collect())
    total, want = 0.0, []
    for i in range(200):
        total += i % 7 + 1
        if total > 100:
            break
        want.append(f"{i:03}")
    assert got == want


def test_budget_of_hot_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.choice([None, 1, 2, 3])) for i in range(900)]
    got = {(r["i"], r["running"]) for r in selection.budget(spark.createDataFrame(rows, "i long, g string, n long"), "n", "i", 70, by="g").collect()}
    total, want = {}, set()
    for i, g, n in rows:
        total[g] = total.get(g, 0) + (n or 0)
        if total[g] <= 70:
            want.add((i, total[g]))
    assert got == want
    assert selection.budget(spark.createDataFrame([], "i long, g string, n long"), "n", "i", 70, by="g").count() == 0


def test_rules_and_strict_mode(spark):
    df = spark.createDataFrame([("a", "real", "g", "rel", "real"), ("b c", "synthetic", None, "/x", "cc"), ("a\n", "real", None, "x", "TODO")], "sample_id string, label string, generator_id string, path string, license string")
    got = {tuple(r) for r in rules.violations(df, rules.row_rules(df.columns)).collect()}
    assert got == {("V1", "a"), ("V1", "b c"), ("id_pattern", "b c"), ("V16", "b c"), ("id_pattern", "a\n"), ("V10", "a\n")}
    with pytest.raises(rules.RuleError):
        rules.require_none(rules.violations(df, rules.row_rules(df.columns)), "manifest")


def test_reports(spark):
    empty = spark.createDataFrame([], "gate string, eligible boolean, diagnostic boolean, candidate boolean")
    assert tuple(reports.quality_gate(empty).first()) == ("passed", False, False, False, 0)
    plan, out = spark.createDataFrame([("a",), ("b",), ("c",)], "j string"), spark.createDataFrame([("a", True), ("b", False), ("z", True)], "j string, valid boolean")
    for policy, want in {"skip": "skip error_invalid run unplanned", "fail": "error_exists error_exists run unplanned", "regenerate": "redo redo run unplanned"}.items():
        assert [r.action for r in reports.resume_actions(plan, out, "j", policy).orderBy("j").collect()] == want.split()


def test_latency_percentiles(spark):
    df = spark.createDataFrame([("k", float(i)) for i in range(20)], "key string, value double")
    assert tuple(rag.latency_percentiles(df).first()) == ("k", 20, 9.0, 19.0)


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text('\ufefffile,speaker\na.wav,"k""1"\nb.wav\n', encoding="utf-8")
    assert [tuple(r) for r in manifests.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("a.wav", 'k"1'), ("b.wav", None)]
    (tmp_path / "p.txt").write_text("# x\nLA1 u1 c - - bonafide\nLA2 u2 c s A07 spoof\nLA3 u3 c - spoof\n")
    assert [tuple(r)[1:4] for r in manifests.read_protocol(spark, str(tmp_path / "p.txt")).collect()] == [("u1", "real", None), ("u2", "synthetic", "A07"), ("u3", "synthetic", "asvspoof_unknown_attack")]
    (tmp_path / "s.tsv").write_text('1\tf\t"r\tt\tc\t3\tm\n1\t2\n')
    assert [r["bad"] for r in manifests.read_seven_columns(spark, str(tmp_path / "s.tsv")).collect()] == [False, True]
    m = manifests.conform(spark.createDataFrame([("a", Decimal(2**64 - 1))], "sample_id string, generation_seed decimal(20,0)"))
    for kind in ("jsonl", "parquet"):
        path = str(tmp_path / f"m.{kind}")
        manifests.write_manifest(m, path)
        assert manifests.read_manifest(spark, path).first()["generation_seed"] == 2**64 - 1
        with pytest.raises(Exception):
            manifests.write_manifest(m, path)
    with pytest.raises(ValueError):
        manifests.conform(spark.createDataFrame([(1,)], "nonsense int"))
    with pytest.raises(ValueError):
        manifests.reader("nope")


def test_audio(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.zeros(1600, "<i2").tobytes())
    (tmp_path / "a.txt").write_text(" hello ")
    (tmp_path / "b.wav").write_bytes(b"RIFFxx")
    tree = {r["path"].rsplit("/", 1)[1]: r for r in manifests.read_audio_tree(spark, str(tmp_path)).collect()}
    assert tree["a.wav"]["transcript"] == "hello" and tree["b.wav"]["transcript"] is None and tree["a.wav"]["extension"] == ".wav"
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio.probe(files).collect()}
    assert got["a.wav"]["duration_sec"] == 0.1 and got["b.wav"]["error"]
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],)], "a array<float>").select(audio.crop_pad(F.col("a"), 2).alias("c"))
    assert [r["c"] for r in df.collect()] == [[2.0, 3.0], [1.0, 0.0]]
    assert audio.log_mel(np.zeros(4000, np.float32), 16000).shape[0] == 64


def test_stream_upsert(spark, tmp_path):
    schema = "job string, status string, t timestamp"
    src = tmp_path / "in"
    store = ResultStore(spark, str(tmp_path / "store"), "job", schema)
    for k, rows in enumerate([[("a", "running"), ("b", "done")], [("a", "done"), ("c", "running")]]):
        spark.createDataFrame([(*r, datetime.datetime(2024, 1, 1)) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(src))
        stream_upsert(spark.readStream.schema(schema).parquet(str(src)), store, str(tmp_path / "ck")).awaitTermination()
    assert {r["job"]: r["status"] for r in store.read().collect()} == {"a": "done", "b": "done", "c": "running"}
    store.finish("c", "failed")
    store.finish("b", "failed")
    spark.createDataFrame([("d", "running", datetime.datetime(2024, 1, 1))], schema).coalesce(1).write.mode("append").parquet(str(src))
    stream_upsert(spark.readStream.schema(schema).parquet(str(src)), store, str(tmp_path / "ck")).awaitTermination()
    assert [r["status"] for r in store.find("d").collect()] == ["running"]
    other = spark.createDataFrame([("d", "failed", datetime.datetime(2024, 1, 2)), ("d", "done", datetime.datetime(2024, 1, 3))], schema)
    with pytest.raises(ValueError, match="repeated"):
        store.upsert(other)
    store.upsert(other, "x-1", "t")
    store.upsert(other.withColumn("status", F.lit("again")), "x-1", "t")  # the same batch again
    assert [r["status"] for r in store.find("d").collect()] == ["done"]
    store.upsert(store.read().limit(0))
    store.upsert(spark.createDataFrame([("d", "failed", datetime.datetime(2024, 1, 2))], schema).limit(0), "x-1")
    assert {r["job"]: r["status"] for r in store.read().collect()} == {"a": "done", "b": "done", "c": "failed", "d": "done"}


def test_run_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), [("t1", "first", "1", "2024-01-01"), ("t0", "second", "1", "2024-01-02")])
    RunStore(spark, str(tmp_path / "runs"), [("t1", "changed", "2", "2025-01-01")])
    assert [(r["id"], r["name"]) for r in store.list_targets().collect()] == [("t1", "first"), ("t0", "second")]
    for k in (1, 2):
        store.create(f"r{k}", "t1", "1", {"b": 1, "a": "é"}, f"2024-02-0{k}")
    results = [{"case_id": "c2", "text": "é", "n": 1}, {"case_id": "c1", "ok": True}]
    store.finish("r1", results, {"accuracy": 0.5}, "2024-03-01")
    store.finish("r1", [], {"accuracy": 0.9}, "2024-03-02")  # not running any more
    runs = store.list_runs().collect()
    want = hashlib.sha256(b'{"case_id": "c2", "n": 1, "text": "\xc3\xa9"}\n{"case_id": "c1", "ok": true}').hexdigest()
    assert [(r["id"], r["status"], r["result_hash"]) for r in runs] == [("r2", "running", None), ("r1", "completed", want)]
    assert [r["case_id"] for r in store.list_results("r1").collect()] == ["c1", "c2"] and store.metrics.read().first()["value"] == 0.5
    assert store.runs.find("none").isEmpty()
    assert json.loads(store.list_results("r1").first()["result_json"]) == {"case_id": "c1", "ok": True}
    assert [r["result_json"] for r in store.list_results("r1").collect()][1] == '{"case_id": "c2", "text": "é", "n": 1}'  # as it came


def test_run_store_columns(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "runs"), [{"id": "t", "name": "T", "version": "1", "created_at": "2024", "languages": ["ru"], "endpoint": "https://x"}])
    assert store.list_targets().first().asDict() == {"id": "t", "name": "T", "adapter_type": "mock", "endpoint": "https://x", "version": "1", "languages": ["ru"], "visibility": "public", "created_at": "2024"}
    known = {"benchmark_id": "b", "benchmark_version": "0.1", "dataset_hash": "00", "evaluator_version": "0.1.0", "git_commit": "c", "limitations": ["synthetic"]}
    store.create("r", "t", "1", {}, "2024-01-01", **known)
    run = store.runs.find("r").first().asDict()
    assert {k: run[k] for k in known} == known and (run["visibility"], run["status"]) == ("private", "running")
    store.finish("r", [], {"recall": (None, "not_evaluated"), "accuracy": 1.0}, "2024-01-02")
    assert [tuple(r) for r in store.list_metrics("r").collect()] == [("accuracy", 1.0, "computed"), ("recall", None, "not_evaluated")]
    with pytest.raises(ValueError, match="unknown fields"):
        store.create("x", "t", "1", {}, "2024", other=1)


def test_many_batches_keep_few_folders(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "s"), "job", "job string, n int")
    row = lambda k: spark.createDataFrame([("a", k)], store.schema)
    for k in range(7):
        store.upsert(row(k), f"one-{k}")
        store.upsert(row(100 + k), f"two-{k}")
    for k in range(7):
        store.upsert(row(-1), f"one-{k}")  # all of them again
    assert store.read().first()["n"] == 106
    assert len(list((tmp_path / "s").glob("v*"))) == 3 == len(list((tmp_path / "s" / "applied").glob("*.json")))
    with pytest.raises(ValueError):
        store.upsert(row(0), "nameless")


def test_compose(spark):
    def rows(label, ids, **more):
        return spark.createDataFrame([(i, label, "kk", f"x/{i}.wav", "train") for i in ids], "sample_id string, label string, language string, path string, split string").withColumns({"quality_gate": F.lit("pass"), "training_eligible": F.lit(True), "diagnostic_only": F.lit(False), "intended_role": F.lit("train")})

    got = {r["sample_id"]: (r["path"], r["split"]) for r in selection.compose(rows("real", "ab"), rows("synthetic", "c"), ["kk"]).collect()}
    assert got == {i: (f"audio/{i}.wav", None) for i in "abc"}
    for real, made, languages in ((rows("real", "ab"), rows("synthetic", "b"), None), (rows("synthetic", "a"), rows("synthetic", "b"), None), (rows("real", "a"), rows("synthetic", "b"), ["ru"]), (rows("real", "a"), rows("real", "b"), None)):
        with pytest.raises(rules.RuleError):
            selection.compose(real, made, languages)


def test_text_identity_is_exact(spark):
    odd = [None, "", " A\tB ", "Straße", "ﬁne", "ＡＢＣ", "é", "é", "İ", "ΣΑΣ", "x\x1cy", "\u2003a\u3000b ", "½", "Қазақ", "ǅ"]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", text.normalize_text("t").alias("n"))
    for r in df.collect():
        assert r["n"] == (None if r["t"] is None else " ".join(unicodedata.normalize("NFKC", r["t"]).split()).casefold())


def test_markdown_has_every_row(spark):
    lines = manifests.markdown(spark.range(10_500).withColumn("x", F.lit(0.5)), ["id", "x"]).splitlines()
    assert len(lines) == 10_502 and lines[-1].endswith("| 0.500000 |")


def test_split_exports(spark, tmp_path):
    rows = manifests.conform(spark.createDataFrame([("a", "train"), ("b", "test"), ("c", None)], "sample_id string, split string"))
    assert manifests.write_splits(rows, str(tmp_path)) == {"train": 1, "val": 0, "test": 1}
    assert manifests.read_manifest(spark, str(tmp_path / "manifest.split.parquet")).count() == 3
    with pytest.raises(FileExistsError):
        manifests.write_splits(rows, str(tmp_path))


@pytest.mark.parametrize("bound", [100_000, 40])
def test_components_with_and_without_star_rounds(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "IN_ONE_TASK", bound)
    rng = random.Random(5)
    links = [(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)] + [(7, 7), (None, 3)]
    want = {}
    for a, b in links:
        if a is not None and a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            both = x | y
            for node in both:
                want[node] = both
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {node: min(group) for node, group in want.items()}


def test_components_set_hanging_nodes_aside(spark, monkeypatch):
    """Clusters around a few hubs, a chain and loose pairs: only links between what is not settled yet go into the rounds of stars."""
    monkeypatch.setattr(graph, "IN_ONE_TASK", 60)
    star, rounds = graph._star, []
    monkeypatch.setattr(graph, "_star", lambda edges, large, n, scratch: rounds.append(n) or star(edges, large, n, scratch))
    rng = random.Random(5)
    chain = rng.sample(range(10_000, 10_300), 300)
    links = [(k, k // 8 * 8) for k in range(3000)] + [(k, k % 40) for k in range(0, 3000, 8)] + list(zip(chain, chain[1:], strict=False)) + [(20_000 + k, 30_000 + k) for k in range(200)] + [(7, 7)]
    rng.shuffle(links)
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)
    found = [tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()]
    assert len(found) == len(dict(found)) and dict(found) == {x: find(x) for x in up}
    assert max(rounds, default=0) < len(links) / 4
