"""Files as tables: listings, emptiness, lanes of one library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, contains: str = "", recursive: bool = True) -> DataFrame:
    """(path, bytes, modified) of a folder's files; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")).where(F.col("path").contains(contains))


def is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a (compressed) text has no first line or an empty one."""
    first = spark.read.text(path).limit(1).collect()
    return not first or not first[0][0]


def lanes(files: DataFrame) -> DataFrame:
    """(library, part, paths): files named like x_L001_y, those of equal x and y together."""
    p = r"([^/]*)(_L[0-9]{3}_)([^/]*)$"
    rows = files.where(F.col("path").rlike(p)).select("path", F.regexp_extract("path", p, 1).alias("library"), F.regexp_extract("path", p, 3).alias("part"))
    return rows.groupBy("library", "part").agg(F.array_sort(F.collect_list("path")).alias("paths"))  # the lanes of one library
