"""Operators over aligned sequences (rowid, name, seq of equal length, gaps as '-').

A multiple alignment is taken as given; nothing here runs an aligner. Columns are counted by one
exploded aggregation. Null sequences are left out; shorter ones end with gaps; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators.info import with_fraction


def cells(df: DataFrame) -> DataFrame:
    return df.where("seq is not null").select("rowid", F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))


def column_scores(df: DataFrame) -> DataFrame:
    """(position, top, score, gaps): the commonest symbol (least on ties), its share, and the share of gaps."""
    p = with_fraction(cells(df).groupBy("position", "base").agg(F.count("*").alias("n")), by=["position"])
    best = F.min(F.struct((-F.col("n")).alias("o"), "base", "fraction"))
    return p.groupBy("position").agg(best.alias("b"), F.coalesce(F.sum(F.when(F.col("base") == "-", F.col("fraction"))), F.lit(0.0)).alias("gaps")).select("position", F.col("b.base").alias("top"), F.col("b.fraction").alias("score"), "gaps")


def _islands(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    island = F.col("position") - F.row_number().over(Window.partitionBy(*keys).orderBy("position")) if keys else F.col("position") - F.row_number().over(Window.orderBy("position"))
    runs = df.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("position").alias("start"), (F.max("position") + 1).alias("end")).drop("_i")
    return runs.where(F.col("end") - F.col("start") >= least)


def streaks(df: DataFrame, share: float, least: int) -> DataFrame:
    """(start, end): runs of at least so many columns in which a letter other than a gap has at least the share."""
    return _islands(column_scores(df).where((F.col("score") >= share) & (F.col("top") != "-")), [], least)  # one row a column


def trimmed_to_streaks(df: DataFrame, share: float, least: int) -> DataFrame:
    """Sequences from the first streak's start to the last one's end, gaps removed; on is false without a streak."""
    span = streaks(df, share, least).agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    part = F.regexp_replace(F.expr("substring(seq, _a + 1, _b - _a)"), "-", "")
    both = df.join(F.broadcast(span)).withColumn("on", F.col("_a").isNotNull())
    return both.withColumn("seq", F.when(F.col("on"), part).otherwise(F.regexp_replace("seq", "-", ""))).drop("_a", "_b")


def _span() -> tuple[Column, Column]:
    return F.length(F.regexp_extract("seq", "^-*", 0)), F.length(F.regexp_replace("seq", "-+$", ""))


def trimmed_to_core(df: DataFrame) -> DataFrame:
    """Sequences from the latest start to the earliest end of all, gaps removed."""
    a, b = _span()
    core = df.where("seq is not null").agg(F.max(a).alias("_a"), F.min(b).alias("_b"))
    part = F.when(F.col("_b") > F.col("_a"), F.expr("substring(seq, _a + 1, _b - _a)")).otherwise(F.lit(""))
    return df.join(F.broadcast(core)).withColumn("seq", F.regexp_replace(part, "-", "")).drop("_a", "_b")


def trimmed_to_references(df: DataFrame, refs: DataFrame) -> DataFrame:
    """Sequences cut to the columns that the references of the same alignment span."""
    a, b = _span()
    span = refs.where("seq is not null").agg(F.min(a).alias("_a"), F.max(b).alias("_b"))
    return df.join(F.broadcast(span)).withColumn("seq", F.regexp_replace(F.expr("substring(seq, _a + 1, greatest(_b - _a, 0))"), "-", "")).drop("_a", "_b")


def agreement(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(rowid, ref_id, position, same): whether a sequence has a reference's symbol; references are few and joined by column."""
    r = cells(refs).select(F.col("rowid").alias("ref_id"), "position", F.col("base").alias("_r"))
    return cells(df).join(r, "position").select("rowid", "ref_id", "position", (F.col("base") == F.col("_r")).cast("int").alias("same"))


def agreement_segments(df: DataFrame, refs: DataFrame, least: int) -> DataFrame:
    """(rowid, ref_id, start, end): runs of agreement of at least so many columns."""
    return _islands(agreement(df, refs).where("same = 1"), ["rowid", "ref_id"], least)


def outlier_scores(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(rowid, score): the mean share that a sequence's symbols have in the references' columns."""
    p = with_fraction(cells(refs).groupBy("position", "base").agg(F.count("*").alias("n")), by=["position"]).select("position", "base", "fraction")
    return cells(df).join(p, ["position", "base"], "left").groupBy("rowid").agg(F.avg(F.coalesce("fraction", F.lit(0.0))).alias("score"))


def real_positions(df: DataFrame) -> DataFrame:
    """(rowid, column, position): alignment columns and the position on the ungapped sequence; null at gaps."""
    upto = F.length(F.regexp_replace(F.expr("substring(seq, 1, position + 1)"), "-", ""))
    rows = df.where("seq is not null").select("rowid", "seq", F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))
    return rows.select("rowid", F.col("position").alias("column"), F.when(F.col("base") != "-", upto - 1).alias("position"))


def hamming_pairs(counts: DataFrame, most: int, column: str = "seq") -> DataFrame:
    """(a, b, distance) of distinct equal-length values that differ in 1 to `most` letters.

    Values are cut into most + 1 parts; two that differ in so few letters agree in a part (pigeonhole),
    so the join is one of equality on (length, part number, part).
    """
    values = counts.select(F.col(column).alias("v")).where("v is not null").distinct()
    size = F.length("v")
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.substring("v", F.floor(size * k / (most + 1)).cast("int") + 1, F.floor(size * (k + 1) / (most + 1)).cast("int") - F.floor(size * k / (most + 1)).cast("int")).alias("p")) for k in range(most + 1)])
    keyed = values.select("v", size.alias("n"), F.inline(parts))
    pairs = keyed.join(keyed.withColumnRenamed("v", "w"), ["n", "k", "p"]).where("v < w").select(F.col("v").alias("a"), F.col("w").alias("b")).distinct()
    return pairs.withColumn("distance", S.hamming(F.col("a"), F.col("b"))).where(F.col("distance") <= most)
