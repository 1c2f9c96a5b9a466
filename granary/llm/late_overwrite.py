"""Late-arrival partition overwrite by late materialisation.

A layout keeps the latest row of each key and cuts each day, in order, into files of a fixed number of rows. Everything
is decided on narrow keys with pointers to source rows (file, row within it, copy): deduplication, ranks within days,
the map from pointers to output files, and which days have to be written again. The payload is read once for each
write and joined to the map by pointer, so each file's rows are brought together once.

Edges: a null order value belongs to day -1, a null key is one key, a null arrival ranks before all others and is late.
Ties of arrival go to the later order value, then the copy, then the greater pointer; rows repeated as a whole leave
one. An empty table leaves an empty folder and no report rows. Columns may have any name: the payload is one struct.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, TimestampNTZType

from ..operators.ranges import running_sums
from ..operators.runs import digests
from ..session import Scratch, file_system

POINTER = ["file", "at", "copy"]
DAY_MICROS = 86_400_000_000


def micros(value: Column, ntz: bool) -> Column:
    """Microseconds since 1970 in UTC; a timestamp without a zone is taken as UTC, whatever the session's zone is."""
    if not ntz:
        return F.unix_micros(value)
    seconds = F.unix_date(value.cast("date")).cast("long") * 86_400 + F.hour(value) * 3600 + F.minute(value) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")


def days_later(value: Column, days: Column, ntz: bool) -> Column:
    """``value`` moved by whole days of 24 hours."""
    return value + F.make_dt_interval(days=days) if ntz else F.timestamp_micros(F.unix_micros(value) + days.cast("long") * DAY_MICROS)


def source_rows(table: DataFrame, copies: Column | None = None, changed: dict[str, Callable[[Callable[[str], Column]], Column]] | None = None) -> DataFrame:
    """A Parquet table's rows as a struct ``row`` with their pointers: a 64-bit hash of the file's path, the row's number in it, and a copy number.

    ``copies`` is an array of copy numbers for each row ([0]: the row alone); ``changed`` gives, by column, what a copy
    other than 0 has instead, from a function that gives the source row's columns.
    """
    meta = table.metadataColumn("_metadata")
    names = {c: f"_c{k}" for k, c in enumerate(table.columns)}
    flat = table.select(
        F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"), (F.lit(0) if copies is None else F.explode(copies)).alias("copy"), *(F.col(f"`{c}`").alias(n) for c, n in names.items())
    )
    get = lambda c: F.col(names[c])
    now = lambda c: F.when(F.col("copy") == 0, get(c)).otherwise(changed[c](get)) if changed and c in changed else get(c)
    return flat.select(*POINTER, F.struct(*(now(c).alias(c) for c in table.columns)).alias("row"))


@dataclass(frozen=True)
class Names:
    """The columns that a layout goes by."""

    key: str
    order: str
    arrived: str


class LateOverwrite:
    """Writes the layout of the early rows, then overwrites what the late rows change.

    ``rows`` has the pointer columns and ``row`` (see ``source_rows``) and must give the same rows whenever it is read.
    ``late`` is a condition on ``arrived`` (as microseconds; null is late).
    """

    def __init__(self, rows: DataFrame, names: Names, rows_per_file: int, late: Column, root: str, scratch: Scratch) -> None:
        self.rows, self.names, self.size, self.root, self.scratch = rows, names, rows_per_file, root, scratch
        self.spark = rows.sparkSession
        self.schema: StructType = rows.schema["row"].dataType
        self.ntz = isinstance(self.schema[names.order].dataType, TimestampNTZType)
        self.day_col, self.file_col = (self._free(n) for n in ("day", "file_no"))
        self._plan(late)

    def _free(self, name: str) -> str:
        taken = {c.lower() for c in self.schema.names}
        while name in taken:
            name += "_"
        return name

    def _plan(self, late: Column) -> None:
        """Sets ``best`` (each key's start and final row), ``touched`` (days to write again) and ``plan`` (pointer to file)."""
        row = F.col("row")
        arrived_ntz = isinstance(self.schema[self.names.arrived].dataType, TimestampNTZType)
        narrow = self.rows.select(
            row[self.names.key].alias("key"), row[self.names.order].alias("order"), micros(row[self.names.arrived], arrived_ntz).alias("arrived"), *POINTER
        )
        found = F.struct("arrived", "order", "copy", "file", "at")
        is_late = F.coalesce(late, F.lit(True))
        best = narrow.groupBy("key").agg(F.max(F.when(~is_late, found)).alias("start"), F.max(found).alias("final"), F.max(F.when(is_late, found)).alias("latest"))
        day = lambda s: F.coalesce(F.floor(micros(F.col(f"{s}.order"), self.ntz) / DAY_MICROS), F.lit(-1)).cast("long")
        self.best = self.scratch.cut(
            best.select("key", "start", "final", (F.col("final") == F.col("latest")).alias("won"), F.when(F.col("start").isNotNull(), day("start")).alias("start_day"), day("final").alias("final_day"))
        )
        changed = self.best.where(F.coalesce("won", F.lit(False)))
        self.touched = self.scratch.keep(changed.select(F.explode(F.array("start_day", "final_day")).alias("day")).where("day is not null").distinct())
        layout = lambda k, s: F.struct(F.lit(k).alias("layout"), F.col(f"{s}_day").alias("day"), F.col(s).alias("row"))
        layouts = F.array(layout(0, "start"), layout(1, "final"))
        placed = self.best.select("key", F.inline(layouts)).where(F.col("row").isNotNull()).select("layout", "day", "key", "row.order", *(f"row.{p}" for p in POINTER), F.lit(1).alias("one"))
        # days are calendar days: some 3.7 million at most, however long the table is
        marked = placed.join(F.broadcast(self.touched.select("day", F.lit(True).alias("again"))), "day", "left").where("layout = 0 or again").withColumn("again", F.coalesce("again", F.lit(False)))
        ranked = running_sums(marked, ["layout", "day"], [F.col("order").asc_nulls_first(), F.col("key").asc_nulls_first()], ["one"])
        self.plan = self.scratch.cut(ranked.select("layout", "day", F.floor((F.col("one_upto") - 1) / self.size).alias("file_no"), "key", "order", "again", *POINTER))

    def _write(self, plan: DataFrame, dynamic: bool) -> None:
        """Rejoins the payload by pointer and writes one file for each (day, file_no)."""
        to = plan.select(F.col("day").alias("_day"), F.col("file_no").alias("_file_no"), F.col("key").alias("_key"), F.col("order").alias("_order"), *POINTER)
        full = self.rows.join(to.hint("merge"), POINTER)
        placed = full.select(F.col("_day"), F.col("_file_no"), F.col("_order"), F.col("_key"), "row").repartition("_day", "_file_no")
        placed = placed.sortWithinPartitions("_day", "_file_no", F.col("_order").asc_nulls_first(), F.col("_key").asc_nulls_first())
        out = placed.select("row.*", F.col("_day").alias(self.day_col), F.col("_file_no").alias(self.file_col)).write.partitionBy(self.day_col, self.file_col)
        out.mode("overwrite").option("maxRecordsPerFile", 0).option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(self.root)

    def write_start(self) -> None:
        """The layout of the early rows, in a new folder."""
        self._write(self.plan.where("layout = 0"), dynamic=False)

    def overwrite(self) -> None:
        """Makes the folder the layout of all rows: writes the touched days' files, then removes those that they no longer have."""
        self._write(self.plan.where("layout = 1"), dynamic=True)
        files = self.plan.where("again").groupBy("day", "file_no").agg(F.max("layout").alias("kept"))  # layout 1 has the file, or 0 alone
        for r in files.where("kept = 0").select("day", "file_no").toLocalIterator():  # names of stale files only, as a commit of Spark's has them
            at, fs = file_system(self.spark, f"{self.root}/{self.day_col}={r[0]}/{self.file_col}={r[1]}")
            fs.delete(at, True)

    def written(self) -> DataFrame:
        """The folder's rows with ``day``, ``file_no``, ``path``, ``at`` (place in the file) and the payload as ``row``."""
        schema = StructType([*self.schema.fields]).add(self.day_col, "long").add(self.file_col, "long")
        table = self.spark.read.schema(schema).parquet(self.root)
        meta = table.metadataColumn("_metadata")
        path = F.regexp_replace(meta["file_path"], "^file:/+", "file:///")
        return table.select(F.col(self.day_col).alias("day"), F.col(self.file_col).alias("file_no"), path.alias("path"), meta["row_index"].alias("at"), F.struct(*(F.col(f"`{c}`") for c in self.schema.names)).alias("row"))

    def columns(self) -> list[str]:
        """The columns of the files, merged from the footers of all of them by a job."""
        found = self.spark.read.option("mergeSchema", True).parquet(self.root).columns
        return [c for c in found if c not in (self.day_col, self.file_col)]

    def report(self, **figures: Column) -> DataFrame:
        """One row per file: day, file_no, n_rows, ``figures`` over ``row``, path, columns, the digest of the keys in file order, and whether it was rewritten."""
        rows = self.written()
        files = rows.groupBy("day", "file_no").agg(F.count(F.lit(1)).alias("n_rows"), *(v.alias(k) for k, v in figures.items()), F.min("path").alias("path"))
        keys = digests(rows, ["day", "file_no"], [F.col("at")], F.col("row")[self.names.key].cast("string"), b",", "ids_sha256", short=True)  # a file's rows are bounded by the layout
        columns = ",".join(self.columns()) if rows.select("day").head(1) else ""
        again = self.touched.select("day", F.lit(True).alias("rewritten"))
        return files.join(keys, ["day", "file_no"]).join(F.broadcast(again), "day", "left").withColumn("columns", F.lit(columns)).withColumn("rewritten", F.coalesce("rewritten", F.lit(False)))


def late_overwrite(rows: DataFrame, names: Names, rows_per_file: int, late: Column, root: str, scratch: Scratch) -> LateOverwrite:
    """Writes both layouts of ``rows`` below ``root``, one over the other."""
    job = LateOverwrite(rows, names, rows_per_file, late, root, scratch)
    job.write_start()
    job.overwrite()
    return job
