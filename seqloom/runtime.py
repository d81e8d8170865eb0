"""Session-level helpers: the shared folder, written intermediates, size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the cluster names it in spark.checkpoint.dir.

    Without that setting, a temporary folder is chosen and set if the master is local (tests, a single machine); on
    a cluster, where executors don't see each other's disks, it is an error.
    """
    told = spark.conf.get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        told = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", told)
    return told.rstrip("/")


#: Removes the shuffle files of a query once it has ended; the names of Spark 4.1 and 4.0.
_CLEANUP = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.shuffleDependency.fileCleanup.enabled")


def written(df: DataFrame, label: str, partition_by: list[str] | None = None, drop_shuffles: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts lineage like checkpoint(), but keeps columns, compression and partition pruning, and
    survives the loss of any executor. drop_shuffles: the shuffle files of the write are removed when it
    ends; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = {name: spark.conf.get(name, None) for name in _CLEANUP * drop_shuffles}
    try:
        for name in before:
            spark.conf.set(name, "true")
        writer.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that written() left, as soon as nothing reads it any more."""
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(spark: SparkSession) -> None:
    """Remove all tables that written() left in the shared folder; no DataFrame that reads them may be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/seqloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_plain(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """broadcast(df) if it is shown to have at most max_rows rows, else df for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for those that haven't got it installed."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = Path(__file__).resolve().parent
    file = Path(tempfile.mkdtemp(prefix="seqloom-"), "seqloom.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    context.addPyFile(str(file))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def pieces_for(df: DataFrame, bytes_per_row: float, rows: int | None = None, target: float = 64e6, least: int = 8) -> int:
    """Number of hash partitions so that each holds about target bytes."""
    rows = df.count() if rows is None else rows
    return max(least, int(rows * bytes_per_row / target) + 1)
