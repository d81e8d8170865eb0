"""Graphs of k-mers and of sequence ends, and neighbours of k-mers and haplotypes, as tables of edges.

All are joins or aggregations on equality; a k-mer's neighbours are listed instead of compared. Null
sequences and those shorter than k have no edge; equal edges are counted; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import msa as X


def de_bruijn(df: DataFrame, k: int) -> DataFrame:
    """(a, b, n): k-mers as edges from their first to their last k - 1 letters, with their number of places."""
    kmers = df.where(F.length("seq") >= k).select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return kmers.select(F.substring("kmer", 1, k - 1).alias("a"), F.substring("kmer", 2, k - 1).alias("b"), "n")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, outgoing, incoming, out_weight, in_weight): a graph whose weights are balanced at each node, or at all but two, has an Eulerian walk."""
    out = edges.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("outgoing"), F.sum("n").alias("out_weight"))
    into = edges.groupBy(F.col("b").alias("node")).agg(F.count("*").alias("incoming"), F.sum("n").alias("in_weight"))
    return out.join(into, "node", "full").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("outgoing", "incoming", "out_weight", "in_weight")])


def overlaps(df: DataFrame, size: int) -> DataFrame:
    """(a, b): distinct sequences, by their least rowid, of which the last `size` letters of a are the first of b."""
    u = df.where(F.length("seq") >= size).groupBy("seq").agg(F.min("rowid").alias("id"))
    ends = u.select(F.col("id").alias("a"), F.expr(f"right(seq, {size})").alias("e"))
    fronts = u.select(F.col("id").alias("b"), F.expr(f"left(seq, {size})").alias("e"))
    return ends.join(fronts, "e").where("a <> b").select("a", "b")


def fuzzy_counts(df: DataFrame, k: int) -> DataFrame:
    """(kmer, n, near): places of each k-mer of A, C, G and T, and of all k-mers that differ from it in at most one letter."""
    counts = df.where(F.length("seq") >= k).select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).where(F.col("kmer").rlike("^[ACGT]*$")).groupBy("kmer").agg(F.count("*").alias("n"))
    others = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.transform(F.array(*[F.lit(x) for x in "ACGT"]), lambda x: F.overlay("kmer", x, i, F.lit(1)))))
    near = counts.select(F.explode(F.array_distinct(others)).alias("kmer"), "n").groupBy("kmer").agg(F.sum("n").alias("near"))
    return counts.join(near, "kmer")


def snp_pairs(df: DataFrame) -> DataFrame:
    """(a, b, position, base_a, base_b): distinct sequences of equal length that differ in one letter."""
    pairs = X.hamming_pairs(df, 1).drop("distance")
    at = F.expr("filter(sequence(1, length(a)), i -> substring(a, i, 1) <> substring(b, i, 1))[0]")
    return pairs.withColumn("_i", at).select("a", "b", (F.col("_i") - 1).alias("position"), F.expr("substring(a, _i, 1)").alias("base_a"), F.expr("substring(b, _i, 1)").alias("base_b"))
