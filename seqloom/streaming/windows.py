"""Streams: tables that arrive in files, counted in event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(df: DataFrame, time: str, keys: list[str], value: str, late: str = "1 hour", size: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, keys, n, total) for each window; rows later than the watermark are left out in append mode."""
    when = F.window(time, size, slide) if slide else F.window(time, size)
    out = df.withWatermark(time, late).groupBy(when.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def deduplicated(df: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark, with bounded state."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_to_end(df: DataFrame, path: str, state: str) -> None:
    """Run an aggregating stream over all that has arrived; path then holds its whole result. State and result lie in the shared folder."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    df.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def closed_windows(df: DataFrame, path: str, state: str) -> None:
    """Append a stream's windows to path as the watermark passes them; rows later than it are left out."""
    df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
