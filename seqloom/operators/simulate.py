"""Seeded generators: random sequences, mutations, amplification, mixtures.

Every random number is a hash of (seed, row, position), so a row's result depends on nothing else:
the same on any partitioning, and again after a lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) for the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) / float(1 << 40)


def drawn(seed: int, weights: list[tuple[str, float]], *keys: Column) -> Column:
    """A letter by weight."""
    total, upto = sum(w for _, w in weights), 0.0
    u, out = uniform(seed, *keys), None
    for letter, w in weights[:-1]:
        upto += w / total
        out = F.when(u < upto, letter) if out is None else out.when(u < upto, letter)
    return F.lit(weights[-1][0]) if out is None else out.otherwise(weights[-1][0])


def random_sequences(spark: SparkSession, n: int, least: int, most: int, seed: int, weights: list[tuple[str, float]] | None = None) -> DataFrame:
    """(rowid, name, seq, qual): n sequences with lengths in [least, most]."""
    weights = weights or [(b, 1.0) for b in "ACGT"]
    rows = spark.range(n).withColumnRenamed("id", "rowid").withColumn("_n", (least + F.floor(uniform(seed, F.col("rowid"), F.lit("n")) * (most - least + 1))).cast("int"))
    spots = F.when(F.col("_n") > 0, F.sequence(F.lit(1), "_n")).otherwise(F.array().cast("array<int>"))
    seq = F.array_join(F.transform(spots, lambda i: drawn(seed, weights, F.col("rowid"), i)), "")
    qual = F.transform(spots, lambda i: (20 + F.floor(uniform(seed + 1, F.col("rowid"), i) * 21)).cast("int"))
    return rows.select("rowid", F.concat(F.lit("seq."), "rowid").alias("name"), seq.alias("seq"), qual.alias("qual"))


def composition(df: DataFrame) -> list[tuple[str, float]]:
    """Letters of a table with their counts, as weights for random_sequences(); one row a letter."""
    return [(r[0], float(r[1])) for r in df.select(F.explode(S.letters(F.col("seq"))).alias("l")).groupBy("l").count().orderBy("l").collect()]


def mutated(df: DataFrame, rate: float, seed: int, key: str = "rowid") -> DataFrame:
    """seq with each A, C, G or T replaced by another with the given chance; column changes counts them."""

    def change(x: Column, i: Column) -> Column:
        other = F.when(x == "A", F.lit("CGT")).when(x == "C", F.lit("AGT")).when(x == "G", F.lit("ACT")).when(x == "T", F.lit("ACG"))
        pick = F.substring(other, (F.floor(uniform(seed + 1, F.col(key), i) * 3) + 1).cast("int"), F.lit(1))
        return F.when(other.isNotNull() & (uniform(seed, F.col(key), i) < rate), pick).otherwise(x)

    return df.withColumn("_o", F.col("seq")).withColumn("seq", F.array_join(F.transform(S.letters(F.col("seq")), change), "")).withColumn("changes", F.coalesce(S.hamming(F.col("_o"), F.col("seq")), F.lit(0))).drop("_o")


def known_variants(df: DataFrame, changes: list[tuple[int, str]]) -> DataFrame:
    """seq with given letters at given positions (from 0); those beyond the end are ignored."""
    seq = F.col("seq")
    for at, base in changes:
        seq = F.when(F.length(seq) > at, F.overlay(seq, F.lit(base), at + 1, 1)).otherwise(seq)
    return df.withColumn("seq", seq)


def all_single_mutants(df: DataFrame) -> DataFrame:
    """(rowid, position, base, seq): every sequence one substitution away."""
    spots = df.where(F.length("seq") > 0).select("rowid", "seq", F.posexplode(S.letters(F.col("seq"))).alias("position", "_x"))
    every = spots.select("*", F.explode(F.array(*[F.lit(b) for b in "ACGT"])).alias("base")).where(F.col("base") != F.col("_x"))
    return every.select("rowid", "position", "base", F.expr("overlay(seq placing base from position + 1 for 1)").alias("seq"))


def amplification_errors(spark: SparkSession, start: float, length: int, rounds: int, rate: float) -> DataFrame:
    """(round, amount, unchanged): amount * (1 + (1 - rate)^length) of unchanged copies, twice of all, per round."""
    rows = spark.range(rounds + 1).select(F.col("id").cast("int").alias("round"))
    keep = (1 - rate) ** length
    return rows.select("round", (start * F.pow(F.lit(2.0), F.col("round"))).alias("amount"), (start * F.pow(F.lit(1 + keep), F.col("round"))).alias("unchanged"))


def amplified(df: DataFrame, rounds: int, rate: float, seed: int, reads: int) -> DataFrame:
    """reads sampled from templates (rowid, seq, cnt) in proportion to cnt, each with the errors of its rounds."""
    total = df.agg(F.sum("cnt").alias("_t"))
    share = df.join(F.broadcast(total)).withColumn("copies", F.floor(F.col("cnt") / F.col("_t") * reads).cast("int")).where("copies > 0")
    copies = share.select("rowid", "seq", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")).withColumn("_k", F.xxhash64("rowid", "copy"))
    return mutated(copies, 1 - (1 - rate) ** rounds, seed, "_k").drop("_k")


def fractions(df: DataFrame, mixture: str, amount: str) -> DataFrame:
    """fraction: an amount's share of its mixture."""
    total = df.groupBy(mixture).agg(F.sum(amount).alias("_t"))
    return df.join(total, mixture).withColumn("fraction", F.col(amount) / F.col("_t")).drop("_t")


def shared_offsets(a: Column, b: Column, k: int) -> Column:
    """Offsets (from 0) at which two sequences hold the same k letters."""
    n = F.least(F.length(a), F.length(b)) - k
    spots = F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))
    return F.filter(spots, lambda i: F.substring(a, i + 1, F.lit(k)) == F.substring(b, i + 1, F.lit(k)))
