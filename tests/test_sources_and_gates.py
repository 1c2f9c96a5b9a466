import hashlib
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.functions import audio
from granary.operators import gates, generation, metrics, rules
from granary.sources import adapters


def wav(path, samples, rate, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())


def test_resample_keeps_tones_and_lengths():
    t = np.arange(8000) / 8000
    out = audio.resample(np.sin(2 * np.pi * 440 * t), 8000, 12_000)
    want = np.sin(2 * np.pi * 440 * np.arange(12_000) / 12_000)
    assert len(out) == 12_000 and np.abs(out - want)[200:-200].max() < 2e-3
    assert len(audio.resample(np.ones(7), 44_100, 16_000)) == 3 and len(audio.resample(np.zeros(0), 8000, 16_000)) == 0


def test_resample_equals_the_full_convolution():
    rng = np.random.default_rng(1)
    for rate, to, n in ((8000, 16_000, 300), (44_100, 16_000, 500), (16_000, 8000, 77), (48_000, 16_000, 2)):
        x = rng.normal(size=n)
        up, down = to // np.gcd(rate, to), rate // np.gcd(rate, to)
        half = 10 * max(up, down)
        h = np.sinc(np.arange(-half, half + 1) / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
        fine = np.zeros(n * up)
        fine[::up] = x
        want = np.convolve(fine, h * up / h.sum())[half::down][: -(-n * up // down)]
        assert np.allclose(audio.resample(x, rate, to), want, atol=1e-5)


def test_preprocess_limits(spark, tmp_path):
    wav(tmp_path / "a.wav", np.full(1600, 0.25), 8000)
    wav(tmp_path / "long.wav", np.zeros(16_000), 8000)
    wav(tmp_path / "none.wav", [], 8000)
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))
    got = {r["path"].rsplit("/", 1)[1]: r for r in audio.preprocess(files, sample_rate=16_000, max_seconds=1.0, max_bytes=100_000).collect()}
    a = got["a.wav"]
    assert a["error"] is None and (a["sample_rate"], a["duration_sec"]) == (16_000, 0.2) and len(a["wav"]) == 44 + 4 * 3200 and a["wav"][20:22] == b"\x03\x00"
    assert got["long.wav"]["error"] == "duration limit" and got["none.wav"]["error"] == "empty" and got["bad.wav"]["error"]
    small = audio.preprocess(files, sample_rate=8000, max_seconds=9.0, max_bytes=10).collect()
    assert {r["error"] for r in small if "bad" not in r["path"]} == {"file size limit"}


def test_tones(spark):
    jobs = spark.createDataFrame([("j", "t1", None, 7), ("k", "t1", "v", None)], "job_id string, text_id string, voice_id string, seed long")
    for r, key in zip(audio.tones(jobs).orderBy("job_id").collect(), (b"t1\0None\x007", b"t1\0v\0None"), strict=True):
        hz = 220 + int.from_bytes(hashlib.sha256(key).digest()[:2], "big") % 440
        assert r["frequency_hz"] == hz and len(r["samples"]) == 1280
        assert np.allclose(r["samples"], 0.05 * np.sin(2 * np.pi * hz * np.arange(1280) / 16_000), atol=1e-6)


def test_canonical_defaults_and_filters(spark):
    rows = [("d/x.wav", None, None, "ru", " Т ", "1"), ("y.wav", "p", "id1", "Kazakh", None, "1"), ("", "p", "i", "xx", "", "1"), ("z.wav", "p", "i", "ru", "", None)]
    df = spark.createDataFrame(rows, "path string, speaker_id string, source_id string, language string, transcript string, keep string")
    got = adapters.canonical(df, "src", filters={"keep": ["1"]}, languages={"Kazakh": "kk"}).orderBy("path").collect()
    ident = lambda record: "src_" + hashlib.sha256(f"src\0{record}".encode()).hexdigest()[:20]
    assert [r["bad"] for r in got] == ["path", None, None] and got[1]["sample_id"] == ident("d/x") and got[2]["sample_id"] == ident("id1")
    assert got[1]["speaker_id"] == "unknown_" + ident("d/x") and got[1]["missing_metadata"] == ["speaker_id"] and got[1]["transcript"] == "Т"
    assert got[2]["language"] == "kk" and got[2]["missing_metadata"] == []
    assert adapters.canonical(df.select("path"), "src").count() == 4 and adapters.canonical(df.select("path"), "src", filters={"keep": ["1"]}).count() == 0


def test_protocol_join_takes_the_last_of_equal_stems(spark, tmp_path):
    (tmp_path / "p.txt").write_text("S u1 c - - bonafide\nS u2 c s A07 spoof\n")
    files = spark.createDataFrame([("/a/u1.flac",), ("/b/u1.flac",)], "path string")
    got = {r["utterance"]: (r["path"], r["missing"]) for r in adapters.protocol_samples(spark, str(tmp_path / "p.txt"), files).collect()}
    assert got == {"u1": ("/b/u1.flac", False), "u2": (None, True)}


def test_embedded_audio_is_appended_once(spark, tmp_path):
    rows = [(17, (b"RIFFxx", "a.wav"), "r\tw", "t\nx", 3, "m"), (18, (b"????", "b"), "r", "t", 3, None)]
    spark.createDataFrame(rows, "id long, audio struct<bytes binary, path string>, raw_transcription string, transcription string, num_samples int, gender string").write.parquet(str(tmp_path / "in"))
    got = adapters.embedded_audio(spark, str(tmp_path / "in"), "train")
    first = {r["extension"]: r for r in got.collect()}
    assert first[".wav"]["record_id"].startswith("train_17_") and (first[".wav"]["raw"], first[".wav"]["text"]) == ("r w", "t x") and None in first
    for _ in range(2):
        adapters.append_new(got, str(tmp_path / "out"), "record_id")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError):
        adapters.embedded_audio(spark, str(tmp_path / "out"), "train")


def test_pinned_texts(spark, tmp_path):
    data = "".join(f"{i}\tf\tr\t{'' if i == 1 else f'Text {i}'}\tc\t1\tm\n" for i in range(9)).encode()
    (tmp_path / "t.tsv").write_bytes(data)
    got = adapters.pinned_texts(spark, str(tmp_path / "t.tsv"), "ru", hashlib.sha256(data).hexdigest())
    assert [r["id"] for r in got.orderBy("ordinal").collect()] == ["0", "2", "3", "4", "5"]
    for digest, k in (("0", 5), (hashlib.sha256(data).hexdigest(), 9)):
        with pytest.raises(rules.RuleError):
            adapters.pinned_texts(spark, str(tmp_path / "t.tsv"), "ru", digest, k)


def test_keyed_scan_snapshot_artifacts_config(spark, tmp_path):
    for name, lines in {"ok": ['{"id":"a"}', '{"id":"b"}'], "twice": ['{"id":"a"}', '{"id":"a"}'], "empty": []}.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    assert adapters.read_keyed(spark, str(tmp_path / "ok.jsonl"), "id string", "id").count() == 2
    for name in ("twice", "empty"):
        with pytest.raises(rules.RuleError):
            adapters.read_keyed(spark, str(tmp_path / f"{name}.jsonl"), "id string", "id")
    models, samples = spark.createDataFrame([("m",), ("m",)], "model_id string"), spark.createDataFrame([("s", "m"), ("t", "gone"), ("u", None)], "sample_id string, model_id string")
    assert {tuple(r) for r in adapters.snapshot_problems(models, samples).collect()} == {("V8", "m"), ("V15", "gone")}
    digests = adapters.write_artifacts(str(tmp_path / "run"), {"run.json": {"b": 1, "a": "ё"}})
    assert (tmp_path / "run" / "sha256.txt").read_text() == f"{digests['run.json']}  run.json\n" and json.loads((tmp_path / "run" / "run.json").read_text())["a"] == "ё"
    with pytest.raises(FileExistsError):
        adapters.write_artifacts(str(tmp_path / "run"), {"run.json": {}})
    (tmp_path / "c.json").write_text("[]")
    with pytest.raises(ValueError):
        adapters.read_config(str(tmp_path / "c.json"))
    assert adapters.enabled_sources([{"n": 1}, {"n": 2, "enabled": False}, {"n": 3, "role": "external"}]) == [{"n": 1}]


def test_voice_options(spark):
    names = "generator_id string, voice_id string, voices array<string>, entry_voices array<string>, params map<string,string>, entry_params map<string,string>"
    rows = [("fixed", "v", ["v", "w"], None, {"a": "1"}, {"a": "2", "b": "3"}), ("entry", None, ["v", "w"], ["w", "q"], None, None), ("own", None, ["v", "w"], None, {"a": "1"}, None), ("none", None, None, None, None, None)]
    got = {}
    for r in generation.voice_options(spark.createDataFrame(rows, names)).collect():
        got.setdefault(r["generator_id"], []).append((r["voice_id"], r["unknown"], dict(r["params"])))
    assert got["fixed"] == [("v", [], {"a": "2", "b": "3"})] and got["none"] == [(None, [], {})]
    assert [x[0] for x in got["entry"]] == ["w", "q"] and got["entry"][0][1] == ["q"] and [x[0] for x in got["own"]] == ["v", "w"]


def test_gates(spark):
    df = spark.createDataFrame([(1, "completed"), (2, "failed"), (3, "completed")], "i int, status string")
    assert [r["i"] for r in gates.until_failure(df, "i", "stop").collect()] == [1, 2] and gates.until_failure(df, "i", "continue").count() == 3
    assert gates.until_failure(df.where("i <> 2"), "i", "stop").count() == 2
    with pytest.raises(ValueError):
        gates.until_failure(df, "i", "maybe")
    ev = spark.createDataFrame([("a", "not_evaluated", "planned", None), ("b", "not_evaluated", "0.9", None), ("c", "human_review", "1", ""), ("d", None, None, None)], "k string, evidence_type string, value string, source string")
    assert {tuple(r) for r in rules.violations(ev, gates.evidence_rules(), "k").collect()} == {("V14_asserts", "b"), ("V14_source", "c")}
    reps = spark.createDataFrame([(["a", "a"],), (["a"],), (None,)], "x array<string>").select(gates.repeats(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in reps] == [True, False, False]
    names = "k string, adapter string, infrastructure_only boolean, generator_speaker_name string, generator_speaker_id int, speaker_map map<string,int>"
    fx = spark.createDataFrame([("a", "fake_sine", True, None, None, None), ("b", "fake_sine", None, None, None, None), ("c", "x", False, "n", 2, {"n": 1}), ("d", "x", True, "n", 1, {"n": 1})], names)
    assert {tuple(r) for r in rules.violations(fx, gates.fixture_rules(), "k").collect()} == {("V11_fixture", "b"), ("V11_speaker", "c"), ("V11_fixture", "d")}
    tr = spark.createDataFrame([("a", None, None, 8000), ("b", "val", "g", 8000), ("c", "test", "g", 16_000), ("d", "train", None, None)], "sample_id string, split string, generator_id string, sample_rate int")
    assert {tuple(r) for r in rules.violations(tr, gates.training_rules(["g"], 8000)).collect()} == {("split_missing", "a"), ("unseen_leak", "b"), ("sample_rate", "c")}
    means = gates.weighted_mean(spark.createDataFrame([(1.0, 1), (4.0, 2), (None, 9)], "v double, n int"), "v", "n").first()
    assert means["mean"] == 3.0 and gates.weighted_mean(spark.createDataFrame([], "v double, n int"), "v", "n").first()["mean"] is None


def test_empty_protocol_slices(spark):
    rows = spark.createDataFrame([(0, "real", 0.1), (1, "g", 0.9)], "y int, gen string, score double")
    got = {r["key"]: (r["status"], r["n"]) for r in metrics.protocol_slices(rows, "gen", ["other"]).collect()}
    assert got == {"overall": ("ok", 2), "test_seen": ("ok", 2), "test_unseen": ("undefined_single_class", 1)}
    none = {r["key"]: (r["status"], r["n"]) for r in metrics.protocol_slices(rows.limit(0), "gen", ["other"]).collect()}
    assert none == {k: ("empty", 0) for k in got}
