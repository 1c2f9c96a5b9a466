"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps"
).split()


def local_session(cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below the shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``; only where the session has
    none (tests, local mode) is a folder of the local machine used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/granary-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_and_read(df: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """``by``: columns whose values get folders of their own."""
    df.write.partitionBy(*by or []).parquet(path)
    at, fs = file_system(df.sparkSession, path)
    fs.deleteOnExit(at)  # with the driver's JVM, if nobody deletes it before
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write and reread: ends the lineage in storage that survives lost executors. The table lives as long as the application."""
    return write_and_read(df, shared_dir(df.sparkSession))


class Scratch:
    """Tables that are cut within a ``with`` block and deleted at its end, unless they are kept: what the result reads must be."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for _, path in self.paths:
            self._delete(path)

    def _delete(self, path: str) -> None:
        at, fs = file_system(self.spark, path)
        fs.delete(at, True)

    def cut(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        path = shared_dir(self.spark)
        out = write_and_read(df, path, by)
        self.paths.append((out, path))
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """Cuts ``df`` into a table that outlives the block."""
        return cut(df)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table before the block ends."""
        for k, (known, path) in enumerate(self.paths):
            if known is df:
                self._delete(path)
                del self.paths[k]
                return


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_granary_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.TemporaryDirectory()  # of the driver, which serves the file; removed when the driver ends
    file = os.path.join(os.path.realpath(folder.name), "granary_package.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(file)
    sc._granary_shipped = folder
