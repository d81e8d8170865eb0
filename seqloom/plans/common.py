"""The driver's tables in the shapes that operators take, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.sequence import cleaned
from seqloom.runtime import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "seq_reads").where("seq is not null")
    return t.select("rowid", "name", cleaned(F.col("seq")).alias("seq"), F.coalesce("cnt", F.lit(1.0)).alias("cnt"), "sample", "meta")


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Reads with a quality for each letter, as stored."""
    t = table(spark, d, "seq_reads").where("seq is not null and qual is not null and size(qual) = length(seq)")
    return t.select("rowid", "name", F.upper("seq").alias("seq"), "qual", F.coalesce("cnt", F.lit(1.0)).alias("cnt"))


def refs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ref_seqs").where("ref_seq is not null")
    return t.select("rowid", "name", cleaned(F.col("ref_seq")).alias("seq"), "target")


def contigs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "genome").where("seq is not null")
    return t.select("chrom", F.upper(F.regexp_replace("seq", "[^A-Za-z]", "")).alias("seq"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Intervals made of events: chrom is the type, start follows the time, length the value."""
    t = table(spark, d, "events").where("ts is not null and event_type is not null")
    start = (F.unix_seconds(F.col("ts").cast("timestamp")) % 1_000_000).cast("bigint")
    return t.select(F.col("event_type").alias("chrom"), start.alias("start"), (start + 20 + F.col("event_id") % 400).alias("end"), F.concat(F.lit("e"), F.col("event_id") % 5000).alias("name"), F.round(F.coalesce("value", F.lit(0.0)), 3).alias("score"), F.when(F.col("event_id") % 3 == 0, "-").otherwise("+").alias("strand"), F.col("event_id").alias("rowid"))


def targets(spark: SparkSession, d: str) -> DataFrame:
    """A second set of intervals: around the first event of each user and type, from all events."""
    users = table(spark, d, "events").select(F.col("event_id").alias("rowid"), "user_id")
    first = regions(spark, d).join(users, "rowid").groupBy("chrom", "user_id").agg(F.min(F.struct("rowid", "start", "end", "strand")).alias("e"))
    return first.select("chrom", (F.col("e.start") - 50).alias("start"), (F.col("e.end") + 100).alias("end"), F.concat(F.lit("t"), "e.rowid").alias("name"), "e.strand", "e.rowid")


READS = r"reads AS (SELECT rowid, name, upper(regexp_replace(seq, '[-\s]', '', 'g')) AS seq, coalesce(cnt, 1.0) AS cnt, sample, meta FROM seq_reads WHERE seq IS NOT NULL)"
SCORED = "scored AS (SELECT rowid, name, upper(seq) AS seq, qual, coalesce(cnt, 1.0) AS cnt FROM seq_reads WHERE seq IS NOT NULL AND qual IS NOT NULL AND len(qual) = length(seq))"
REFS = r"refs AS (SELECT rowid, name, upper(regexp_replace(ref_seq, '[-\s]', '', 'g')) AS seq, target FROM ref_seqs WHERE ref_seq IS NOT NULL)"
CONTIGS = "contigs AS (SELECT chrom, upper(regexp_replace(seq, '[^A-Za-z]', '', 'g')) AS seq FROM genome WHERE seq IS NOT NULL)"
REGIONS = """regions AS (SELECT event_type AS chrom, CAST(floor(epoch(ts)) AS BIGINT) % 1000000 AS "start", CAST(floor(epoch(ts)) AS BIGINT) % 1000000 + 20 + event_id % 400 AS "end", 'e' || (event_id % 5000) AS name, round(coalesce(value, 0.0), 3) AS score, CASE WHEN event_id % 3 = 0 THEN '-' ELSE '+' END AS strand, event_id AS rowid FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL)"""
TARGETS = """targets AS (SELECT chrom, "start" - 50 AS "start", "end" + 100 AS "end", 't' || rowid AS name, strand, rowid FROM (SELECT regions.*, user_id FROM regions JOIN events ON rowid = event_id) QUALIFY row_number() OVER (PARTITION BY chrom, user_id ORDER BY rowid) = 1)"""
BOTH_REGIONS = f"{REGIONS}, {TARGETS}"
