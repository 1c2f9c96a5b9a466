"""Line files cut into ranges, and early stops over Parquet files."""

import hashlib
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.operators import selection
from granary.sources import adapters, formats, manifests


def line_files(folder):
    draw = random.Random(4)
    (folder / "sub").mkdir(parents=True)
    files = {
        "a.txt": "".join("x" * draw.randrange(0, 40) + draw.choice(["\n", "\r\n", "\n\n"]) for _ in range(300)), "b.txt": "no end", "c.txt": "", "sub/d.txt": "ä" * 500 + "\nю\n" + "z" * 300 + "\n",
        "e.txt": "\n\n\n", "_hidden.txt": "no\n", "f.txt": "﻿marked\nplain\n",
    }
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    return {n: t for n, t in files.items() if not n.startswith("_")}


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_numbers_equal_line_numbers(spark, tmp_path, monkeypatch, size):
    files = line_files(tmp_path / "in")
    want, ordinal = [], 0
    for name in sorted(files):
        lines = files[name].removeprefix("﻿").replace("\r\n", "\n").split("\n")
        for k, value in enumerate(lines[:-1] if lines[-1] == "" else lines):
            want.append((name, k + 1, ordinal, value))
            ordinal += 1
    if size == 1:  # every byte a range: only the short files
        for name in ("a.txt", "sub/d.txt"):
            (tmp_path / "in" / name).write_bytes(b"")
        want = [w for w in want if w[0] not in ("a.txt", "sub/d.txt")]
        want = [(*w[:2], k, w[3]) for k, w in enumerate(want)]
    rows = formats.numbered_lines(spark, str(tmp_path / "in"), size).collect()
    assert sorted((r["ordinal"], r["file"].split("/in/")[1], r["line"], r["value"]) for r in rows) == [(o, f, n, v) for f, n, o, v in want]


def test_ranges_read_in_small_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "t.txt").write_text("".join(f"line {k}\n" for k in range(2000)))
    monkeypatch.setattr(formats, "PIECE", 11)  # the reader itself, without tasks
    for size in (50, 1000, 10**6):
        reader = formats.LineReader({"path": str(tmp_path / "t.txt"), "rangeBytes": size}, counts=False)
        got = [v for p in reader.partitions() for b in reader.read(p) for v in b.column(3).to_pylist()]
        assert got == [f"line {k}" for k in range(2000)]
        counts = formats.LineReader({"path": str(tmp_path / "t.txt"), "rangeBytes": size}, counts=True)
        assert sum(b.column(2)[0].as_py() for p in counts.partitions() for b in counts.read(p)) == 2000


def test_readers_name_rows(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("1\ta\tr\tt\tc\t1\tm\n\n2\ttoo\tfew\n3\tb\tr\tt\tc\t1\tm\n")
    rows = manifests.read_seven_columns(spark, str(tmp_path / "s.tsv"))
    assert [(r["id"], r["line"], r["bad"], r["fields"]) for r in rows.orderBy("line").collect()] == [("1", 1, False, 7), ("2", 3, True, 3), ("3", 4, False, 7)]
    digest = hashlib.sha256((tmp_path / "s.tsv").read_bytes()).hexdigest()
    with pytest.raises(Exception, match="row 3 has 3 fields"):
        adapters.pinned_texts(spark, str(tmp_path / "s.tsv"), "ru", digest, 1)
    (tmp_path / "bad.tsv").write_bytes(b"a\n\xff\n")
    with pytest.raises(PySparkException, match="bad.tsv: not UTF-8"):
        formats.numbered_lines(spark, str(tmp_path / "bad.tsv")).collect()
    with pytest.raises(PySparkException, match="missing.tsv"):
        formats.numbered_lines(spark, str(tmp_path / "missing.tsv")).collect()


def test_first_row_in_file_order_wins(spark, tmp_path):
    texts = [("t1", "kk"), ("t2", "ru"), ("t1", "ru"), ("t2", "ru"), ("t1", "kk")]
    for name, part in (("2.jsonl", texts[3:]), ("1.jsonl", texts[:3])):
        (tmp_path / name).write_text("".join(json.dumps({"sample_id": f"{name}{k}", "text_id": t, "normalized_text": f"{name}{k}", "language": lang}) + "\n" for k, (t, lang) in enumerate(part)))
    items = selection.inventory(manifests.read_numbered_manifest(spark, str(tmp_path)), "ordinal").collect()
    assert {(r["text_id"], r["normalized_text"], r["language"], tuple(r["source_sample_ids"])) for r in items} == {
        ("t1", "1.jsonl0", "kk", ("1.jsonl0", "1.jsonl2", "2.jsonl1")), ("t2", "1.jsonl1", "ru", ("1.jsonl1", "2.jsonl0")),
    }
    (tmp_path / "3.jsonl").write_text('{"sample_id": "x"}\n{broken\n')
    with pytest.raises(PySparkException, match=r"3.jsonl, line 2"):
        manifests.read_numbered_manifest(spark, str(tmp_path)).collect()


EMBEDDED = pa.schema([("id", pa.int64()), ("audio", pa.struct([("bytes", pa.binary()), ("path", pa.string())])), ("raw_transcription", pa.string()), ("transcription", pa.string()), ("num_samples", pa.int64()), ("gender", pa.string())])


def embedded_files(folder, files=4, rows=50):
    folder.mkdir()
    for f in range(files):
        own = [{"id": f * rows + k, "audio": {"bytes": b"RIFF%d" % (f * rows + k), "path": None}, "raw_transcription": "r\tw", "transcription": "t\nx", "num_samples": k, "gender": None} for k in range(rows)]
        pq.write_table(pa.Table.from_pylist(own, EMBEDDED), folder / f"{f}.parquet", row_group_size=20)


def test_embedded_records(spark, tmp_path):
    embedded_files(tmp_path / "in")
    assert set(formats.register(spark)) == {"granary_lines", "granary_line_counts", "granary_embedded"}
    read = spark.read.format("granary_embedded").option("split", "train")
    rows = read.load(str(tmp_path / "in"))
    assert rows.rdd.getNumPartitions() == 12  # a row group each
    first = rows.orderBy("ordinal").first()
    name = "train_0_" + hashlib.sha256(b"RIFF0").hexdigest()[:12]
    assert tuple(first)[:7] == (0, name, name + ".wav", "r w", "t x", 0, "None")
    some = read.option("skip", 45).option("maximum", 30).load(str(tmp_path / "in"))
    assert [r["ordinal"] for r in some.orderBy("ordinal").collect()] == list(range(45, 75))


def test_what_lies_behind_the_maximum_stays_unread(spark, tmp_path):
    embedded_files(tmp_path / "in")
    for f in (2, 3):
        (tmp_path / "in" / f"{f}.parquet").write_bytes(b"not Parquet at all")  # opening it would be an error
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    assert formats.extract_embedded(spark, source, target, "train", maximum=30, at_once=10) == 30
    assert formats.extract_embedded(spark, source, target, "train", maximum=40, at_once=10) == 40  # the first 30 are known and don't count
    assert sorted(r[0] for r in spark.read.parquet(target).select("ordinal").collect()) == list(range(70))
    with pytest.raises(PySparkException):
        formats.extract_embedded(spark, source, target, "train", maximum=60, at_once=10)
    for f in (2, 3):
        (tmp_path / "in" / f"{f}.parquet").unlink()
    assert [formats.extract_embedded(spark, source, target, "train") for _ in range(2)] == [100 - spark.read.parquet(target).count(), 0] or spark.read.parquet(target).count() == 100


def test_embedded_errors_name_file_and_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    pq.write_table(pa.table({"id": [1]}), tmp_path / "a" / "x.parquet")
    with pytest.raises(PySparkException, match=r"x.parquet: columns are missing: \['audio'"):
        spark.read.format("granary_embedded").option("split", "s").load(str(tmp_path / "a")).collect()
    (tmp_path / "b").mkdir()
    rows = [{"id": k, "audio": {"bytes": b"RIFFx" if k < 2 else b"????", "path": None}} for k in range(3)]
    pq.write_table(pa.Table.from_pylist(rows, EMBEDDED), tmp_path / "b" / "y.parquet")
    with pytest.raises(PySparkException, match=r"y.parquet, row 3 of the source: an unknown audio container"):
        spark.read.format("granary_embedded").option("split", "s").load(str(tmp_path / "b")).collect()


def test_filters_read_null_as_none(spark):
    df = spark.createDataFrame([("a.wav", None), ("b.wav", "x")], "path string, keep string")
    assert [r["path"] for r in adapters.canonical(df, "src", filters={"keep": ["None"]}).collect()] == ["a.wav"]
    assert adapters.canonical(df, "src", filters={"lacking": [""]}).where(F.col("bad").isNull()).count() == 2
