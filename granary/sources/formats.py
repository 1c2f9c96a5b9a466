"""Python data sources, registered by name: line files by byte range, and Parquet with embedded audio by row group.

``register(spark)`` makes ``granary_lines``, ``granary_line_counts`` and ``granary_embedded`` readable with
``spark.read.format``. Ranges depend on the files alone, not on the cluster, so a file read twice is cut the same way
twice; that is what line numbers over split files rest on (``numbered_lines``). Files are opened by pyarrow's file
systems (local, HDFS, S3 and so on, by the path's scheme), only those that a task reads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ranges import running_sums
from ..session import Scratch, ship

#: Bytes of a range of lines, and of what is read at a time; splits up to which their offsets are broadcast.
RANGE, PIECE, FEW_SPLITS = 64 << 20, 4 << 20, 100_000
MARK = b"\xef\xbb\xbf"


def open_files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The file system, and the files of a file or folder in order of their paths; names with a leading ``_`` or ``.`` are left out."""
    fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [info]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    hidden = lambda f: any(p[:1] in ("_", ".") for p in f.path[len(at) :].strip("/").split("/"))
    return fs, sorted((f for f in found if f.type == pafs.FileType.File and not hidden(f)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class LineReader(DataSourceReader):
    def __init__(self, options: dict, counts: bool) -> None:
        self.path, self.counts = options["path"], counts
        self.size = int(options.get("rangeBytes", RANGE))

    def partitions(self) -> list[Range]:
        return [Range(f.path, at, min(f.size, at + self.size)) for f in open_files(self.path)[1] for at in range(0, f.size, self.size)]

    def _pieces(self, part: Range) -> Iterator[list[bytes]]:
        """The lines that begin within the range, a piece of the file at a time; the rest of the last one lies beyond it."""
        fs = open_files(self.path)[0]
        with fs.open_input_file(part.file) as f:
            at = max(0, part.start - 1)  # a line begins at the range's start if the byte before ends one
            f.seek(at)
            held, skip = b"", part.start > 0
            while True:
                piece = f.read(PIECE)
                held += piece
                if skip:
                    cut = held.find(b"\n")
                    if cut < 0:
                        at, held = at + len(held), b""
                        if not piece or at >= part.end:
                            return
                        continue
                    at, held, skip = at + cut + 1, held[cut + 1 :], False
                lines = held.split(b"\n")
                rest = lines.pop()
                if not piece and rest:
                    lines, rest = [*lines, rest], b""
                own = 0
                while own < len(lines) and at < part.end:
                    at += len(lines[own]) + 1
                    own += 1
                yield lines[:own]
                if at >= part.end or not piece:
                    return
                held = rest

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        n = 0
        for lines in self._pieces(part):
            if lines and not self.counts:
                lines = [x[:-1] if x.endswith(b"\r") else x for x in lines]
                if n == 0 == part.start and lines[0].startswith(MARK):
                    lines[0] = lines[0][len(MARK) :]
                try:
                    values = pa.array([x.decode("utf-8") for x in lines], pa.string())
                except UnicodeDecodeError as e:
                    raise ValueError(f"{part.file}: not UTF-8 in the lines that begin in bytes {part.start} to {part.end}: {e}") from e
                names = pa.array([part.file] * len(lines), pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array([part.start] * len(lines), pa.int64()), pa.array(range(n, n + len(lines)), pa.int64()), values], ["file", "start", "number", "value"])
            n += len(lines)
        if self.counts:
            yield pa.RecordBatch.from_pydict({"file": [part.file], "start": [part.start], "n": [n]})


class Lines(DataSource):
    """``file, start`` (of the range), ``number`` (from 0 within the range) and ``value``. Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "granary_lines"

    def schema(self) -> str:
        return "file string, start long, number long, value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options, counts=False)


class LineCounts(DataSource):
    """``file, start, n``: the lines of each range, without their texts. Options as for ``granary_lines``."""

    @classmethod
    def name(cls) -> str:
        return "granary_line_counts"

    def schema(self) -> str:
        return "file string, start long, n long"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options, counts=True)


# The columns of a table with embedded audio, and the first bytes of the containers.
EMBEDDED = ("id", "audio", "raw_transcription", "transcription", "num_samples", "gender")
CONTAINERS = {b"RIFF": ".wav", b"fLaC": ".flac", b"OggS": ".ogg"}


@dataclass
class Group(InputPartition):
    file: str
    group: int
    skip: int
    rows: int
    ordinal: int


class EmbeddedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], options["split"]
        self.skip, self.most = int(options.get("skip", 0)), int(options["maximum"]) if "maximum" in options else None

    def partitions(self) -> list[Group]:
        """A partition a row group, from row ``skip`` to the ``maximum``-th one after it; files behind that are not opened, not even for their footers."""
        fs, files = open_files(self.path)
        found, at = [], 0
        end = None if self.most is None else self.skip + self.most
        for f in files:
            if end is not None and at >= end:
                break
            with fs.open_input_file(f.path) as opened:
                table = pq.ParquetFile(opened)
                if lacking := sorted(set(EMBEDDED) - set(table.schema_arrow.names)):
                    raise ValueError(f"{f.path}: columns are missing: {lacking}")
                for g in range(table.num_row_groups):
                    n = table.metadata.row_group(g).num_rows
                    first, last = max(0, self.skip - at), n if end is None else min(n, end - at)
                    if first < last:
                        found.append(Group(f.path, g, first, last - first, at + first))
                    at += n
        return found

    def read(self, part: Group) -> Iterator[tuple]:
        fs = open_files(self.path)[0]
        with fs.open_input_file(part.file) as opened:
            seen = 0
            for batch in pq.ParquetFile(opened).iter_batches(batch_size=32, row_groups=[part.group], columns=list(EMBEDDED)):
                for row in batch.to_pylist():
                    seen += 1
                    if part.skip < seen <= part.skip + part.rows:
                        yield self._record(row, part, part.ordinal + seen - part.skip - 1)
                if seen >= part.skip + part.rows:
                    return

    def _record(self, row: dict, part: Group, ordinal: int) -> tuple:
        where = f"{part.file}, row {ordinal + 1} of the source"
        content = (row["audio"] or {}).get("bytes")
        if not content:
            raise ValueError(f"{where}: no embedded audio bytes")
        if content[:4] not in CONTAINERS:
            raise ValueError(f"{where}: an unknown audio container")
        name = f"{self.split}_{row['id']}_{hashlib.sha256(content).hexdigest()[:12]}"
        clean = lambda v: str(v).replace("\t", " ").replace("\n", " ")
        return ordinal, name, name + CONTAINERS[content[:4]], clean(row["raw_transcription"]), clean(row["transcription"]), row["num_samples"], str(row["gender"]), content


class Embedded(DataSource):
    """Records of Parquet tables with audio inside, in file order. Options: path, split, skip, maximum."""

    @classmethod
    def name(cls) -> str:
        return "granary_embedded"

    def schema(self) -> str:
        return "ordinal long, record_id string, filename string, raw string, text string, num_samples long, gender string, content binary"

    def reader(self, schema) -> EmbeddedReader:
        if "split" not in self.options:
            raise ValueError("the option split is required")
        return EmbeddedReader(self.options)


FORMATS = (Lines, LineCounts, Embedded)


def register(spark: SparkSession) -> list[str]:
    """Makes the formats known to a session; their names."""
    ship(spark)
    for f in FORMATS:
        spark.dataSource.register(f)
    return [f.name() for f in FORMATS]


def numbered_lines(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``file, line`` (from 1 within the file), ``ordinal`` (from 0 over all files by path) and ``value``, of files that are cut into ranges.

    Two passes: lines are counted by range, the counts summed up to an offset for each range, and the offset added to a
    line's own number. No range waits for another one, and no line is sorted. Lines end with LF or CR LF; a byte order
    mark at a file's start is left out.
    """
    register(spark)
    source = lambda name: spark.read.format(name).option("rangeBytes", range_bytes).load(path)
    with Scratch(spark) as scratch:
        counts = scratch.cut(source("granary_line_counts"))
        local = running_sums(counts, ["file"], [F.col("start")], ["n"]).select("file", "start", "n", (F.col("n_upto") - F.col("n")).alias("lines_before"))
        offsets = scratch.keep(running_sums(local, [], [F.col("file"), F.col("start")], ["n"]).select("file", "start", "lines_before", (F.col("n_upto") - F.col("n")).alias("before")))
        small = offsets.count() <= FEW_SPLITS
    rows = source("granary_lines").join(F.broadcast(offsets) if small else offsets, ["file", "start"])
    return rows.select("file", (F.col("number") + F.col("lines_before") + 1).alias("line"), (F.col("number") + F.col("before")).alias("ordinal"), "value")


def extract_embedded(spark: SparkSession, path: str, target: str, split: str, maximum: int | None = None, at_once: int = 10_000) -> int:
    """Appends the records that ``target`` (a Parquet folder) lacks, in file order, until ``maximum`` new ones are written; how many were.

    With a maximum the source is read from its start in pieces of rows, each as long as what is still wanted (at least
    ``at_once``), and files behind the last piece stay unread. Written records are known by their ids; repeated ids
    within the source are written once.
    """
    from .adapters import append_new

    register(spark)
    source = spark.read.format("granary_embedded").option("split", split)
    seen = written = 0
    while maximum is None or written < maximum:
        step = None if maximum is None else max(at_once, maximum - written)
        rows = source.option("skip", seen)
        rows = (rows if step is None else rows.option("maximum", step)).load(path)
        with Scratch(spark) as scratch:
            rows = scratch.cut(rows)
            n = rows.count()
            first = rows.groupBy("record_id").agg(F.min("ordinal").alias("ordinal"))
            written += append_new(rows.join(first, ["record_id", "ordinal"], "left_semi"), target, "record_id", None if maximum is None else maximum - written, "ordinal")
        seen += n
        if step is None or n < step:
            break
    return written
