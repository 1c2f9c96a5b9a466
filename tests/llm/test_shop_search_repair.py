"""Late overwrites, exact top-k search and conversation repair against plain versions."""

import datetime as dt
import hashlib
import heapq
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granary.llm import conversations, late_overwrite, queries, top_k
from granary.session import Scratch

EPOCH = dt.datetime(1970, 1, 1)
MICRO = dt.timedelta(microseconds=1)
CUTOFF = dt.datetime(2024, 3, 20)
SALES = pa.schema(
    [("sale_id", pa.int64()), ("client_id", pa.int64()), ("status", pa.string()), ("total", pa.float64()), ("sold_at", pa.timestamp("us")), ("arrived_at", pa.timestamp("us")), ("priority", pa.int32())]
)


# --- late overwrites


def plain_layouts(rows, cutoff=CUTOFF):
    """Both layouts as {(day, file_no): rows}, and the days that are written again."""
    size = 1 + len(rows) // 1100
    day = lambda r: -1 if r["sold_at"] is None else (r["sold_at"] - EPOCH).days
    crc = lambda r: zlib.crc32(str(r["sale_id"]).encode())
    every = list(rows)
    for r in rows:
        if r["sale_id"] is not None and crc(r) % 3 == 0 and day(r) % 4 == 0:
            moved = None if r["arrived_at"] is None else r["arrived_at"] + dt.timedelta(days=1 + crc(r) % 97)
            every.append({**r, "total": None if r["total"] is None else r["total"] + 1, "sold_at": r["sold_at"] + dt.timedelta(days=crc(r) % 2), "arrived_at": moved})
    is_late = lambda r: r["arrived_at"] is None or r["arrived_at"] >= cutoff

    def layout(some):
        kept = {}
        for r in some:
            old = kept.get(r["sale_id"])
            rank = lambda x: ((x["arrived_at"] is not None, x["arrived_at"] or EPOCH), (x["sold_at"] is not None, x["sold_at"] or EPOCH))
            if old is None or rank(r) >= rank(old):
                kept[r["sale_id"]] = r
        files = {}
        by_day = {}
        for r in kept.values():
            by_day.setdefault(day(r), []).append(r)
        for d, found in by_day.items():
            found.sort(key=lambda x: (x["sold_at"] is not None, x["sold_at"] or EPOCH, x["sale_id"] is not None, x["sale_id"] or 0))
            for k in range(0, len(found), size):
                files[d, k // size] = found[k : k + size]
        return kept, files

    start_kept, start = layout([r for r in every if not is_late(r)])
    kept, final = layout(every)
    again = set()
    for key, r in kept.items():
        if is_late(r):
            again |= {day(r)} | ({day(start_kept[key])} if key in start_kept else set())
    return start, final, again


def check_report(found, final, again, columns):
    us = lambda t: "" if t is None else str((t - EPOCH) // MICRO)
    assert {(r["day"], r["file_no"]) for r in found} == set(final) and len(found) == len(final)
    for r in found:
        rows = final[r["day"], r["file_no"]]
        ids = ",".join("" if x["sale_id"] is None else str(x["sale_id"]) for x in rows)
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert (r["n_rows"], r["rewritten"], r["columns"]) == (len(rows), r["day"] in again, ",".join(columns))
        assert r["cents"] == sum(0 if x["total"] is None else int(np.floor(100 * x["total"] + 0.5)) for x in rows)
        assert r["rows_crc"] == sum(zlib.crc32(":".join(["" if x["sale_id"] is None else str(x["sale_id"]), us(x["sold_at"]), us(x["arrived_at"])]).encode()) for x in rows)
        assert pq.ParquetFile(r["path"].removeprefix("file://")).read().to_pylist() == rows  # content, columns and order


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_late_overwrite_query_equals_plain(spark, zone):
    folder = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{folder}/sales.parquet").to_pylist()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = queries.op11_late_overwrite(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    _, final, again = plain_layouts(rows)
    check_report(found, final, again, SALES.names)
    assert 0 < len(again) < len({d for d, _ in final})
    root = Path(found[0]["path"].removeprefix("file://")).parents[2]
    assert len([p for p in root.rglob("*.parquet")]) == len(found)  # no further data files


def odd_sales(n=700):
    """Repeated sales, one with a third of all rows, null ids, times and totals, days that vanish or shrink, and a clashing column."""
    draw = random.Random(5)
    rows = []
    for i in range(n):
        sale = 11 if i % 3 == 0 else None if i % 50 == 1 else draw.randrange(120)
        sold = None if i % 41 == 2 else dt.datetime(2024, 3, 1) + dt.timedelta(seconds=draw.randrange(40 * 86_400))
        arrived = None if i % 37 == 3 else dt.datetime(2024, 3, 1, microsecond=i) + dt.timedelta(minutes=draw.randrange(40 * 1440))
        rows.append({"sale_id": sale, "day": i, "total": None if i % 29 == 4 else draw.randrange(10_000) / 100, "sold_at": sold, "arrived_at": arrived})
    return rows


def test_late_overwrite_leaves_other_files_alone(spark, tmp_path):
    schema = pa.schema([("sale_id", pa.int64()), ("day", pa.int64()), ("total", pa.float64()), ("sold_at", pa.timestamp("us")), ("arrived_at", pa.timestamp("us"))])
    rows = odd_sales()
    early = dt.datetime(2024, 4, 8)  # few are late: most days stay
    plain = [r for r in rows if r["sale_id"] is None or zlib.crc32(str(r["sale_id"]).encode()) % 3 or r["sold_at"] is None or (r["sold_at"] - EPOCH).days % 4]
    pq.write_table(pa.Table.from_pylist(plain, schema), tmp_path / "sales.parquet", row_group_size=50)
    root = f"{tmp_path}/out"
    with Scratch(spark) as scratch:
        source = late_overwrite.source_rows(spark.read.parquet(f"{tmp_path}/sales.parquet"))
        late = F.col("arrived") >= (early - EPOCH) // MICRO
        job = late_overwrite.LateOverwrite(source, late_overwrite.Names("sale_id", "sold_at", "arrived_at"), 1 + len(plain) // 1100, late, root, scratch)
        job.write_start()
        before = {p: p.read_bytes() for p in Path(root).rglob("*.parquet")}
        start, final, again = plain_layouts(plain, early)
        assert len(before) == len(start)
        job.overwrite()
        after = {p: p.read_bytes() for p in Path(root).rglob("*.parquet")}
        report = job.report(cents=F.sum(F.coalesce(F.floor(F.col("row").total * 100 + 0.5), F.lit(0))), rows_crc=F.lit(0)).drop("rows_crc").collect()
    assert {(r["day"], r["file_no"]) for r in report} == set(final) and len(after) == len(final)
    day = lambda p: int(p.parent.parent.name.split("=")[1])
    assert {p for p in before if day(p) not in again} == {p for p in after if day(p) not in again} != set()
    assert all(after[p] == before[p] for p in before if day(p) not in again)
    assert not {p for p in before if day(p) in again} & set(after)  # all files of the other days are new
    assert {k for k in start if k not in final}  # some files are gone
    assert all(r["columns"] == ",".join(schema.names) and r["rewritten"] == (r["day"] in again) for r in report)


def test_late_overwrite_of_odd_and_empty_tables(spark, tmp_path):
    odd = [{"client_id": 1, "status": None, "priority": None, **{k: v for k, v in r.items() if k != "day"}} for r in odd_sales()]
    for name, rows in (("odd", odd), ("none", [])):
        (tmp_path / name).mkdir()
        pq.write_table(pa.Table.from_pylist(rows, SALES), tmp_path / name / "sales.parquet")
        _, final, again = plain_layouts([{c: r[c] for c in SALES.names} for r in rows])
        check_report(queries.op11_late_overwrite(spark, str(tmp_path / name)).collect(), final, again, SALES.names)


# --- top-k search


def plain_top(rows, k, scale=256):
    fine = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if i % 50 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in fine if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k_equals_plain(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # one common vector: ties
    rows += [(50, [0.5] * 8), (60, [0.5] * 8), (60, [0.5] * 8), (None, [1.0] * 8), (500, None), (501, [None] * 8), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [0.25] * 3), (550, [])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, block int").repartition(5)
    monkeypatch.setattr(top_k, "GROUP_ROWS", 4)
    monkeypatch.setattr(top_k, "SHARD_ROWS", 40)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    with Scratch(spark) as scratch:
        for k in (1, 5):
            assert sorted(map(tuple, top_k.top_k(df, F.col("id") % 50 == 0, k, scratch).collect())) == plain_top(rows, k)
        assert top_k.top_k(df.limit(0), F.col("id") % 50 == 0, 5, scratch).count() == 0
        few = top_k.top_k(df.where("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0, 5, scratch)
        assert sorted(map(tuple, few.collect())) == plain_top([r for r in rows if r[0] in (0, 1, 2)], 5)


def test_top_k_of_large_components(spark):
    draw = random.Random(4)
    rows = [(i, [float(np.float32(draw.choice([1e3, 1e7, 1e12]) * draw.uniform(-1, 1))) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with Scratch(spark) as scratch:
        assert sorted(map(tuple, top_k.top_k(df, F.col("id") % 50 == 0, 5, scratch).collect())) == plain_top(rows, 5)


# --- conversations


def plain_damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        said = {1: "", 2: "".join(c for c in text if c not in ".!?")}.get(kind, text)
        yield from [(conv, turn, "user" if kind == 4 else role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def plain_repair(rows):
    """Figures, and the cheapest edits by a search over (place, roles so far) that may insert anything anywhere."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    faults, seen = [], set()
    for _, _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    may = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, last, said = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            break
        if (at, last) in done:  # the first one out is the cheapest with the least audit
            continue
        done.add((at, last))
        for new in may[last].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", at, new, (*said, {"u": "user:", "a": "assistant:"}[new])))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, last, said))
            if faults[at] in ("", "truncated"):
                more = 3 * (faults[at] == "truncated")
                if role[:1] and role[:1] in may[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[:1], (*said, f"{role}:{text}")))
                for new in may[last].replace("s", ""):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, new, (*said, {"u": "user:", "a": "assistant:"}[new] + text)))
    count = lambda k: faults.count(k)
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def odd_turns(n=60, long=300):
    draw = random.Random(9)
    rows = []
    for conv in range(n):
        for turn in range(long if conv == 7 else draw.randrange(1, 12)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown", "sys"])
            text = draw.choice(["a.", "b!", "c", " \t", "", "d? \n", None, "e.e", f"{turn}."])
            rows.append((None if conv == 8 else conv, draw.choice([turn, turn, turn, turn * 2, None]), role, text))
    return rows


@pytest.mark.parametrize("segment", [128, 3])
def test_repair_equals_plain(spark, monkeypatch, tmp_path, segment):
    monkeypatch.setattr(conversations, "SEGMENT", segment)
    rows = odd_turns()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, seg int")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversations(spark, str(tmp_path)).collect()}
    hurt = list(plain_damage(rows))
    assert found == {conv: plain_repair([r for r in hurt if r[0] == conv]) for conv in {r[0] for r in rows}}
    assert any(f[6] == "" and f[7] == hashlib.sha256(b"").hexdigest() for f in found.values()) and any("I" in f[6] for f in found.values())


def test_repair_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_conversations(spark, str(tmp_path)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "x.")], "conv_id long, turn long, role string, text string")
    with Scratch(spark) as scratch:
        found = conversations.repair_report(conversations.damaged(one), one, scratch).collect()
    assert [tuple(r) for r in found] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns_follow_the_grammar(spark):
    rows = odd_turns(30, 200)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    with Scratch(spark) as scratch:
        job = conversations.Repair(df, scratch)
        roles = job.repaired.orderBy("pos", "sub").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", F.substring("role", 1, 1).alias("r")))).alias("r"))
        said = ["".join(x["r"] for x in r["r"]) for r in roles.collect()]
    import re

    assert said and all(re.fullmatch("(s?(ua)+)?", s) for s in said)
