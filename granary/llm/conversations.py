"""Repair of conversation structure: the cheapest edits that make the roles follow ``(s?(ua)+)?``.

A turn is kept, given another role or deleted, and empty turns may be inserted; blank and repeated turns must go. The
search is a recursive query of DuckDB inside hash-partitioned batches: each recursion advances one turn in all of a
batch's conversations at once and keeps, for each state of the grammar, the least cost and its least audit.

A conversation of any length is cut into segments of ``SEGMENT`` turns, each searched from every state in its own task;
a second recursion joins a conversation's segments, one per step. That loses nothing: an audit that is a proper
prefix of another one for the same turns is cheaper (the other one only adds insertions), so least audits stay least
when they are extended. At most one insertion stands before a turn, or at the end: two in a row cost 6 and leave the
grammar where it was, and after a lone ``s`` at the end, deleting that (4) is cheaper than adding two.

Edges: nulls in role and text are one space, a null id is one conversation. Turns go by number, nulls first, then by
role and text; equal rows are repetitions. A role without a first letter, or with another one than s, u or a, can't
be kept. A conversation of which nothing is left has no turns and an empty audit. Texts stream, whatever their length:
only the audit of a conversation, which is a cell of the result, is in memory as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.ranges import running_sums
from ..operators.runs import PART_BYTES, digests, run_starts, sorted_by, whole_groups
from ..session import Scratch, ship

#: Turns of a segment; rows that one recursive query takes at least.
SEGMENT, BATCH = 128, 20_000
#: The white space of the contract.
BLANK = " \t\n\x0b\x0c\r"
RENAME, DELETE, INSERT, UNFINISHED = 3, 4, 3, 3
FINE, CUT, DROP = 0, 1, 2
#: States of the grammar: nothing yet, after s, after u, after a; what each may be followed by.
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def moves() -> list[tuple[str, int, int, int, int, str]]:
    """All (initial, fault, from, to, cost, letters) of one turn, with or without an insertion before it."""
    found = []
    for initial in ("s", "u", "a", ""):
        for fault in (FINE, CUT, DROP):
            for source in NEXT:
                inserted = [(to, INSERT, "I") for letter, to in NEXT[source].items() if letter != "s"]
                for at, cost, letters in [(source, 0, ""), *inserted]:
                    found.append((initial, fault, source, at, cost + DELETE, letters + "D"))
                    for letter, to in NEXT[at].items() if fault != DROP else ():
                        more = UNFINISHED * (fault == CUT)
                        if letter == initial:
                            found.append((initial, fault, source, to, cost + more, letters + "K"))
                        if letter != "s":
                            found.append((initial, fault, source, to, cost + more + RENAME, letters + "R"))
    return found


#: One recursion a turn of all segments in the batch. ``segments`` (id, seg), ``turns`` (id, place from 1, initial, fault).
WALK = """
WITH RECURSIVE walk(id, entry, place, state, best) USING KEY (id, entry, state) AS (
    SELECT id, s.state, 0, s.state, {'cost': 0, 'audit': ''} FROM segments, (VALUES (0), (1), (2), (3)) s(state) WHERE seg > 0 OR s.state = 0
    UNION
    SELECT w.id, w.entry, t.place, m.target, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters})
    FROM walk w JOIN turns t ON t.id = w.id AND t.place = w.place + 1 JOIN moves m ON m.initial = t.initial AND m.fault = t.fault AND m.source = w.state
    GROUP BY ALL
)
SELECT id, entry, state, best.cost AS cost, best.audit AS audit FROM walk JOIN segments USING (id) WHERE place = n
"""

#: One recursion a segment of all conversations in the batch. ``parts`` (id, seg, entry, state, cost, audit), ``whole`` (id, n segments).
JOIN = """
WITH RECURSIVE walk(id, place, state, best, path) USING KEY (id, state) AS (
    SELECT id, 0, 0, {'cost': 0, 'audit': ''}, '0' FROM whole
    UNION
    SELECT id, place, state, best.a, best.b FROM (
        SELECT w.id, p.seg + 1 AS place, p.state, min({'a': {'cost': w.best.cost + p.cost, 'audit': w.best.audit || p.audit}, 'b': w.path || p.state}) AS best
        FROM walk w JOIN parts p ON p.id = w.id AND p.seg = w.place AND p.entry = w.state
        GROUP BY ALL
    )
), ended AS (
    SELECT id, CASE WHEN state = 2 THEN {'cost': best.cost + 3, 'audit': best.audit || 'I'} ELSE best END AS best, path
    FROM walk JOIN whole USING (id) WHERE place = n AND state <> 1
)
SELECT id, best.a.cost AS cost, best.a.audit AS audit, best.b AS path FROM (SELECT id, min({'a': best, 'b': path}) AS best FROM ended GROUP BY id)
"""


def connection():
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    db.execute("CREATE TABLE moves (initial VARCHAR, fault INTEGER, source INTEGER, target INTEGER, cost BIGINT, letters VARCHAR)")
    db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    return db


def numbered(table: pa.Table, keys: list[str]) -> tuple[pa.Table, list[int]]:
    """The table with ``id``, the number of the run of equal keys, and the runs' starts."""
    table = table.combine_chunks()
    starts = run_starts(table.to_batches()[0], keys).tolist()
    ends = [*starts[1:], table.num_rows]
    ids = [k for k, (a, b) in enumerate(zip(starts, ends, strict=True)) for _ in range(b - a)]
    return table.append_column("id", pa.array(ids, pa.int64())), starts


def segment_costs(turns: DataFrame) -> DataFrame:
    """The least cost and audit of each segment, from each state that it may be entered in to each that it may be left in.

    ``turns`` has conv_id, seg, pos, initial and fault, sorted by segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connection()
        for group in whole_groups(batches, ["conv_id", "seg"], BATCH):
            rows, starts = numbered(group, ["conv_id", "seg"])
            ends = [*starts[1:], rows.num_rows]
            segs = rows.column("seg").to_pylist()
            db.register("segments", pa.table({"id": range(len(starts)), "seg": [segs[a] for a in starts], "n": [b - a for a, b in zip(starts, ends, strict=True)]}))
            at = [j for a, b in zip(starts, ends, strict=True) for j in range(1, b - a + 1)]
            db.register("turns", rows.select(["id", "initial", "fault"]).append_column("place", pa.array(at, pa.int32())))
            found = db.sql(WALK).to_arrow_table()
            own = rows.select(["conv_id", "seg"]).take(pa.array(starts)).take(found.column("id"))
            yield from pa.table(
                {"conv_id": own.column(0), "seg": own.column(1), "entry": found.column("entry").cast(pa.int32()), "state": found.column("state").cast(pa.int32()), "cost": found.column("cost").cast(pa.int64()), "audit": found.column("audit").cast(pa.string())}
            ).combine_chunks().to_batches()

    ship(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(run, f"conv_id {kind}, seg long, entry int, state int, cost long, audit string")


def joined_costs(parts: DataFrame) -> DataFrame:
    """Each conversation's cost, audit and ``path``, the states at the segments' borders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = connection()
        for group in whole_groups(batches, ["conv_id"], BATCH):
            rows, starts = numbered(group, ["conv_id"])
            segs = rows.column("seg").to_pylist()
            db.register("whole", pa.table({"id": range(len(starts)), "n": [segs[b - 1] + 1 for b in [*starts[1:], rows.num_rows]]}))
            db.register("parts", rows.drop_columns(["conv_id"]))
            found = db.sql(JOIN).to_arrow_table()
            own = rows.column("conv_id").take(pa.array(starts)).take(found.column("id"))
            yield from pa.table({"conv_id": own, "cost": found.column("cost").cast(pa.int64()), "audit": found.column("audit").cast(pa.string()), "path": found.column("path").cast(pa.string())}).combine_chunks().to_batches()

    ship(parts.sparkSession)
    kind = parts.schema["conv_id"].dataType.simpleString()
    return sorted_by(parts, ["conv_id"], [F.col("seg")]).mapInArrow(run, f"conv_id {kind}, cost long, audit string, path string")


def applied(rows: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, pos (place among the damaged turns), sub (0: inserted before it, 1: itself, 2: after it), role and text.

    ``rows`` are sorted by segment and place and have ``entry`` (state), ``audit`` (the segment's, or null where the row isn't its first one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, state = iter(()), 0
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if r["letters"] is not None:
                    letters, state = iter(r["letters"]), r["entry"]
                letter = next(letters)
                if letter == "I":
                    state = 3 if state == 2 else 2
                    out.append((r["conv_id"], r["pos"], 0, "assistant" if state == 3 else "user", ""))
                    letter = next(letters)
                if letter != "D":
                    state = 1 if letter == "K" and state == 0 and r["initial"] == "s" else 3 if state == 2 else 2
                    out.append((r["conv_id"], r["pos"], 1, r["role"] if letter == "K" else "assistant" if state == 3 else "user", r["text"]))
                if r["is_last"] and next(letters, "") == "I":
                    out.append((r["conv_id"], r["pos"], 2, "assistant", ""))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow, strict=True)], schema=arrow)

    kind = rows.schema["conv_id"].dataType.simpleString()
    out_type = StructType.fromDDL(f"conv_id {kind}, pos long, sub int, role string, text string")
    arrow = to_arrow_schema(out_type)
    ship(rows.sparkSession)
    return rows.mapInArrow(run, out_type)


class Repair:
    """The repair of ``turns`` (conv_id, turn, role, text; any type of id).

    ``audits``: conv_id, cost, audit. ``figures``: conv_id, gaps, blank, duplicate, truncated, illegal. ``repaired``: the
    turns after the repair, with pos and sub as their order. Conversations without turns are in none of them.
    """

    def __init__(self, turns: DataFrame, scratch: Scratch) -> None:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), F.lit(1).alias("one"))
        order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
        placed = running_sums(plain, ["conv_id"], order, ["one"])
        self.rows = scratch.keep(placed.select("conv_id", "turn", "role", "text", F.col("one_upto").alias("pos"), F.col("one_all").alias("n")).withColumn("seg", F.floor((F.col("pos") - 1) / SEGMENT)))
        self._judge()
        self._search(scratch)

    def _judge(self) -> None:
        """Sets ``turns``: narrow rows with their fault, sorted by segment, and ``figures``."""
        end = F.rtrim(F.col("text"), F.lit(BLANK))
        narrow = self.rows.select(
            "conv_id", "seg", "pos", "turn", F.substring("role", 1, 1).alias("first"), (end == "").alias("empty"), F.substring(end, -1, 1).isin(".", "!", "?").alias("whole"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("same"),
        )
        firsts = narrow.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"))
        known = narrow.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
        fault = F.when(F.col("empty"), "blank").when(F.col("_p").isNull(), "duplicate").when(~F.col("whole"), "truncated")
        marked = known.select("conv_id", "seg", "pos", "turn", "first", fault.alias("kind"))
        # the last turn of a segment goes to the next one too, as the turn before its first
        carried = marked.withColumn("seg", F.explode(F.when(F.col("pos") % SEGMENT == 0, F.array("seg", F.col("seg") + 1)).otherwise(F.array("seg"))))
        before = Window.partitionBy("conv_id", "seg").orderBy("pos")
        pair = F.concat(F.lag("first").over(before), F.col("first"))
        seen = carried.select("*", (~pair.isin("su", "ua", "au")).alias("odd"), F.lag("turn").over(before).alias("turn_before"))
        seen = seen.where(F.floor((F.col("pos") - 1) / SEGMENT) == F.col("seg"))
        self.turns = seen.select(
            "conv_id", "seg", "pos", F.when(F.col("first").isin("s", "u", "a"), F.col("first")).otherwise("").alias("initial"),
            F.when(F.col("kind").isin("blank", "duplicate"), DROP).when(F.col("kind") == "truncated", CUT).otherwise(FINE).alias("fault"),
        )
        is_new = F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False))
        count = lambda c: F.count(F.when(c, 1))
        self.figures = seen.groupBy("conv_id").agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - count(is_new), F.lit(0)).alias("gaps"),
            *(count(F.col("kind") == k).alias(k) for k in ("blank", "duplicate", "truncated")), count(F.col("odd")).alias("illegal"),
        )

    def _search(self, scratch: Scratch) -> None:
        parts = scratch.cut(segment_costs(self.turns.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos")))
        whole = scratch.keep(joined_costs(parts))
        self.audits = whole.select("conv_id", "cost", "audit")
        # the states at the borders name each segment's own part of the audit
        chosen = whole.select(F.col("conv_id").alias("_c"), "path", F.posexplode(F.split("path", "")).alias("_s", "_entry")).where("_s < length(path) - 1")
        chosen = chosen.select("_c", F.col("_s").cast("long").alias("_s"), F.col("_entry").cast("int").alias("_entry"), F.substring(F.col("path"), F.col("_s") + 2, F.lit(1)).cast("int").alias("_left"))
        own = parts.join(chosen, parts.conv_id.eqNullSafe(F.col("_c")) & (parts.seg == F.col("_s")) & (parts.entry == F.col("_entry")) & (parts.state == F.col("_left")))
        self.chosen = scratch.keep(own.select(parts.conv_id.alias("_c"), F.col("_s"), "_left", F.col("_entry").alias("entry"), F.col("audit").alias("letters")))

    @property
    def repaired(self) -> DataFrame:
        """The turns after the repair: conv_id, pos, sub (their order), role and text."""
        rows = self.rows.join(self.chosen, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("seg") == F.col("_s")))
        is_last = F.floor((F.col("n") - 1) / SEGMENT) == F.col("seg")
        letters = F.when(is_last & (F.col("_left") == 2), F.concat("letters", F.lit("I"))).otherwise(F.col("letters"))
        rows = rows.select(
            "conv_id", "seg", "pos", "role", "text", F.substring("role", 1, 1).alias("initial"), "entry",
            F.when(F.col("pos") == F.col("seg") * SEGMENT + 1, letters).alias("letters"), (F.col("pos") == F.col("n")).alias("is_last"),
        )
        return applied(rows.repartition("conv_id", "seg").sortWithinPartitions("conv_id", "seg", "pos"))

    def digests(self, name: str = "repaired_sha256") -> DataFrame:
        """The digest of each conversation's repaired ``role:text``, joined by newlines."""
        # a turn grows by a role's name, and an empty turn may stand before it: a bound that needs no repair
        size = F.octet_length("text").cast("long") + F.octet_length("role") + 32
        short = self.rows.groupBy("conv_id").agg(F.sum(size).alias("size")).where(F.col("size") > PART_BYTES).isEmpty()
        return digests(self.repaired, ["conv_id"], [F.col("pos"), F.col("sub")], F.concat(F.col("role"), F.lit(":"), F.col("text")), b"\n", name, short=short)


def repair_report(turns: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """One row for each conversation of ``ids`` (column conv_id): figures, cost, audit and the digest of its repaired turns."""
    job = Repair(turns, scratch)
    report = ids.select(F.col("conv_id").alias("_id")).distinct()
    for k, part in enumerate((job.figures, job.audits, job.digests())):
        part = part.withColumnRenamed("conv_id", f"_c{k}")
        report = report.join(part, F.col("_id").eqNullSafe(F.col(f"_c{k}")), "left").drop(f"_c{k}")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return report.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of ``conv_id:turn`` (nulls are one space)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20).alias("kind")
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind).where("kind <> 0")
    role: Column = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    said: Column = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), said.alias("text"), F.explode(times).alias("_")).drop("_")
