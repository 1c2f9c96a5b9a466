"""Files against their records, and sketches of append-only targets."""

import hashlib
import resource
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.sources import membership, verify


def wav(path, frames=100, rate=8000):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(b"\1\0" * frames)
    return hashlib.sha256(path.read_bytes()).hexdigest()


def test_missing_truncated_and_changed_files_are_told_apart(spark, tmp_path):
    good = wav(tmp_path / "a/good.wav")
    short, changed = wav(tmp_path / "short.wav"), wav(tmp_path / "changed.wav")
    (tmp_path / "short.wav").write_bytes((tmp_path / "short.wav").read_bytes()[:-10])  # less than its header says
    (tmp_path / "changed.wav").write_bytes((tmp_path / "changed.wav").read_bytes()[:-1] + b"\7")
    (tmp_path / "cut.bin").write_bytes(b"12345")
    (tmp_path / "long.bin").write_bytes(b"1234567")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = [
        ("good", "a/good.wav", good, None), ("short", "short.wav", short, None), ("changed", "changed.wav", changed, None), ("gone", "b.wav", good, None), ("none", None, good, None),
        ("cut", "cut.bin", sha(b"123456"), 6), ("long", "long.bin", sha(b"123456"), 6), ("up", "../x", good, None), ("folder", "a", good, None), ("nodigest", "cut.bin", None, 5), ("same", "a/good.wav", good, 244),
    ]
    df = spark.createDataFrame(rows, "sample_id string, path string, source_sha256 string, size long")
    found = {r["sample_id"]: r["problem"] for r in verify.verify_files(df, str(tmp_path), size="size").collect()}
    assert found == {"short": "truncated", "changed": "changed", "gone": "missing", "none": "missing", "cut": "truncated", "long": "changed", "up": "outside", "folder": "missing", "nodigest": "changed"}
    assert verify.verify_files(df.limit(0), str(tmp_path)).count() == 0


def test_facts_come_from_headers(spark, tmp_path):
    wav(tmp_path / "a.wav", 123, 16_000)
    wav(tmp_path / "empty.wav", 0)
    (tmp_path / "f.flac").write_bytes(b"fLaC\x80\0\0\x22" + b"\0" * 10 + ((44_100 << 44) | (1 << 41) | (15 << 36) | 98_765).to_bytes(8, "big") + b"\0" * 16)
    (tmp_path / "junk.wav").write_bytes(b"RIFF" + struct.pack("<I", 4) + b"WAVE")
    paths = spark.createDataFrame([("a.wav",), ("empty.wav",), ("f.flac",), ("junk.wav",), ("a.wav",)], "path string")
    found = {r["path"]: (r["frames"], r["sample_rate"]) for r in verify.file_facts(paths, str(tmp_path)).collect()}
    assert found == {"a.wav": (123, 16_000), "empty.wav": (0, 8000), "f.flac": (98_765, 44_100), "junk.wav": (None, None)}
    digest = {n: hashlib.sha256((tmp_path / n).read_bytes()).hexdigest() for n in ("a.wav", "empty.wav", "junk.wav")}
    results = [("ok", "a.wav", digest["a.wav"]), ("empty", "empty.wav", digest["empty.wav"]), ("junk", "junk.wav", digest["junk.wav"]), ("other", "a.wav", "00"), ("null", "a.wav", None), ("gone", "x.wav", "00")]
    valid = verify.valid_outputs(spark.createDataFrame(results, "job_id string, output_relative_path string, output_sha256 string"), str(tmp_path))
    assert {r["job_id"]: r["valid"] for r in valid.collect()} == {"ok": True, **dict.fromkeys(("empty", "junk", "other", "null", "gone"), False)}


def test_snapshot_files(spark, tmp_path):
    digest = wav(tmp_path / "s.wav")
    rows = [("s.wav", 244, digest), ("gone.wav", 1, digest)]
    samples = spark.createDataFrame(rows, "audio_path string, bytes long, sha256 string")
    assert [tuple(r) for r in verify.snapshot_file_problems(samples, str(tmp_path)).collect()] == [("gone.wav", "missing public audio")]
    for size, sha, problem in ((243, digest, "byte count mismatch"), (244, "00", "SHA-256 mismatch")):
        one = spark.createDataFrame([("s.wav", size, sha)], samples.schema)
        assert [r["problem"] for r in verify.snapshot_file_problems(one, str(tmp_path)).collect()] == [problem]


def test_a_file_of_three_gigabytes(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
    state, piece = hashlib.sha256(), bytes(1 << 24)
    for _ in range(size // len(piece)):
        state.update(piece)
    rows = spark.createDataFrame([("x", "sparse.bin", state.hexdigest(), size)], "sample_id string, path string, source_sha256 string, size long")
    assert verify.verify_files(rows, str(tmp_path), size="size").count() == 0
    assert verify.PIECE <= 8 << 20 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 2 << 20  # KB: the driver read nothing of it


# --- sketches


def test_sketches_lose_nothing():
    draw = np.random.default_rng(1)
    for n in (1, 15, 1000, 100_000):
        own = draw.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sketch = membership.sketch_of(own)
        assert all(membership.may_hold(sketch, own[k : k + 1]) for k in range(0, n, max(1, n // 300)))
        other = draw.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
        assert sum(membership.may_hold(sketch, other[k : k + 1]) for k in range(2000)) < 60


def test_appends_read_candidate_files_only(spark, tmp_path):
    target = str(tmp_path / "t")
    part = lambda a, b: spark.range(a, b, 1, 1).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    for k in range(5):
        assert membership.append_unknown(part(1000 * k, 1000 * (k + 1)), target, "key") == {"added": 1000, "files": k, "read": 0} or k  # false hits are rare, not absent
    known = membership.append_unknown(part(2000, 2010), target, "key")
    assert known["added"] == 0 and known["files"] == 5 and 1 <= known["read"] <= 2
    mixed = membership.append_unknown(part(4990, 5020), target, "key")
    assert mixed["added"] == 20 and mixed["read"] < 5
    assert spark.read.parquet(target).count() == 5020 == spark.read.parquet(target).select("key").distinct().count()
    assert membership.append_unknown(part(0, 5020), target, "key")["added"] == 0
    assert membership.append_unknown(part(0, 0), target, "key")["added"] == 0


def test_a_file_without_a_sketch_is_a_candidate(spark, tmp_path):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([("a",), (None,)], "key string")
    membership.append_unknown(rows, target, "key")
    spark.createDataFrame([("b",)], "key string").write.mode("append").parquet(target)  # cut off before its sketch
    found = membership.append_unknown(spark.createDataFrame([("b",), ("c",)], "key string"), target, "key")
    assert found["added"] == 1 and found["read"] >= 1


@pytest.mark.parametrize("many", [0, 3])
def test_many_keys_read_all_files(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(membership, "MANY", many)
    target = str(tmp_path / "t")
    for k in range(2):
        membership.append_unknown(spark.range(10 * k, 10 * k + 10, 1, 1), target, "id")
    assert membership.append_unknown(spark.range(0, 10, 1, 1), target, "id") == {"added": 0, "files": 2, "read": 2}
