"""Counts and summaries of reads: letters, lengths, qualities, k-mers, composition.

Everything is one aggregation with partial sums on the map side; wide intermediate rows (a read's
letters or k-mers) are exploded right before it, so they don't cross a shuffle. Null sequences are
left out; empty ones have no letters. An empty table gives no rows, or one row of zeros and nulls
where a single summary row is promised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import sequence as S


def with_fraction(df: DataFrame, count: str = "n", by: list[str] | None = None) -> DataFrame:
    """fraction: count by the sum over all rows, or those of equal keys. Meant for aggregated tables."""
    if by:
        return df.withColumn("fraction", F.col(count) / F.sum(count).over(Window.partitionBy(*by)))
    total = df.agg(F.sum(count).alias("_total"))
    return df.join(F.broadcast(total)).withColumn("fraction", F.col(count) / F.col("_total")).drop("_total")


def summary(df: DataFrame, value: str) -> DataFrame:
    """One row: n, min, max, mean, median, sd and sum of a column."""
    c = F.col(value)
    return df.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.stddev_samp(c).alias("sd"), F.sum(c).alias("sum"))


def letter_counts(df: DataFrame, weight: str | None = None) -> DataFrame:
    """(letter, n, fraction) over all reads."""
    one = F.col(weight) if weight else F.lit(1)
    rows = df.select(F.explode(S.letters(F.col("seq"))).alias("letter"), one.alias("w"))
    return with_fraction(rows.groupBy("letter").agg(F.sum("w").alias("n")))


def portions(df: DataFrame, size: int, position: int = 0, back: bool = False, more_than: int = 0) -> DataFrame:
    """(portion, n, fraction) of substrings at one place; fractions are of all reads, also those left out by the cut-off."""
    seq = F.col("seq")
    start = F.length(seq) - size - position + 1 if back else F.lit(position + 1)
    long = df.where((F.length(seq) >= size + position))
    counts = with_fraction(long.groupBy(F.substring(seq, start, F.lit(size)).alias("portion")).agg(F.count("*").alias("n")))
    return counts.where(F.col("n") > more_than)


def length_distribution(df: DataFrame) -> DataFrame:
    return df.where("seq is not null").groupBy(F.length("seq").alias("length")).agg(F.sum("cnt").alias("n"))


def homopolymer_counts(df: DataFrame) -> DataFrame:
    """(base, run, n, fraction): runs of a letter by their length; fractions within a letter."""
    runs = df.select(F.explode(S.homopolymers(F.col("seq"))).alias("r"))
    counts = runs.groupBy(F.substring("r", 1, 1).alias("base"), F.length("r").alias("run")).agg(F.count("*").alias("n"))
    return with_fraction(counts, by=["base"])


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    """(kmer, n): k-mers weighted by the rounded count of their read."""
    rows = df.select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer"), F.round("cnt").cast("bigint").alias("w"))
    return rows.groupBy("kmer").agg(F.sum("w").alias("n"))


def kmer_statistics(df: DataFrame, k: int) -> DataFrame:
    """(kmer, n, fraction, expected, ratio): expected is the product of the letters' fractions over all k-mers."""
    counts = with_fraction(kmer_counts(df, k))
    letter = letter_counts(df, "cnt").agg(F.map_from_entries(F.collect_list(F.struct("letter", "fraction"))).alias("_p"))  # one entry a letter of the alphabet
    expected = F.aggregate(S.letters(F.col("kmer")), F.lit(1.0), lambda s, x: s * F.coalesce(F.try_element_at("_p", x), F.lit(0.0)))
    return counts.join(F.broadcast(letter)).withColumn("expected", expected).withColumn("ratio", F.col("fraction") / F.col("expected")).drop("_p")


def quality_counts(df: DataFrame, by_base: bool = False, by_position: bool = False) -> DataFrame:
    """(base, position, quality, n) weighted by cnt; a column that isn't asked for is null."""
    rows = df.select("cnt", F.posexplode(F.arrays_zip(S.letters(F.col("seq")).alias("l"), F.col("qual").alias("q"))).alias("pos", "x"))
    base = F.col("x.l") if by_base else F.lit(None).cast("string")
    pos = F.col("pos") if by_position else F.lit(None).cast("int")
    return rows.groupBy(base.alias("base"), pos.alias("position"), F.col("x.q").alias("quality")).agg(F.sum("cnt").alias("n"))


def quality_cube(df: DataFrame) -> DataFrame:
    """All four groupings of quality_counts() in one pass, by grouping sets; grouped says which (bit 1: base, bit 0: position left out)."""
    rows = df.select("cnt", F.posexplode(F.arrays_zip(S.letters(F.col("seq")).alias("l"), F.col("qual").alias("q"))).alias("position", "x"))
    rows = rows.select("cnt", "position", F.col("x.l").alias("base"), F.col("x.q").alias("quality"))
    sets = [["base", "position", "quality"], ["base", "quality"], ["position", "quality"], ["quality"]]
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], "base", "position", "quality").agg(F.sum("cnt").alias("n"), F.grouping_id("base", "position", "quality").alias("grouped")).withColumn("grouped", F.shiftright("grouped", 1))


def quality_profile(df: DataFrame, size: int, check: int) -> DataFrame:
    """(window, n): histogram of floored window means; the window that ends with the read isn't counted."""
    means = df.select(F.explode(S.window_means(F.col("qual"), size, 1, last=False)).alias("w"))
    return means.groupBy(F.floor("w.mean").alias("window")).agg(F.count("*").alias("n"))


def fraction_above(df: DataFrame, check: int) -> DataFrame:
    """(rowid, fraction) of qualities of at least check; null without qualities."""
    return df.select("rowid", F.when(F.size("qual") > 0, F.size(F.filter("qual", lambda q: q >= check)) / F.size("qual")).alias("fraction"))


def sliding_quality_means(df: DataFrame, size: int = 10, step: int = 5) -> DataFrame:
    return df.select("rowid", "name", F.inline(S.window_means(F.col("qual"), size, step)))


def read_fractions(df: DataFrame) -> DataFrame:
    return with_fraction(df.select("rowid", "name", "cnt"), "cnt")


def column_counts(aligned: DataFrame, ignore: str = "") -> DataFrame:
    """(position, base, n, fraction) of aligned sequences' columns with more than one symbol."""
    rows = aligned.select(F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))
    if ignore:
        rows = rows.where(~F.col("base").isin(*ignore))
    counts = with_fraction(rows.groupBy("position", "base").agg(F.count("*").alias("n")), by=["position"])
    return counts.withColumn("_k", F.count("*").over(Window.partitionBy("position"))).where("_k > 1").drop("_k")


def column_entropy(aligned: DataFrame) -> DataFrame:
    """(position, entropy) in bits."""
    rows = aligned.select(F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))
    p = with_fraction(rows.groupBy("position", "base").agg(F.count("*").alias("n")), by=["position"])
    return p.groupBy("position").agg(F.sum(-F.col("fraction") * F.log2("fraction")).alias("entropy"))


def consensus(aligned: DataFrame) -> DataFrame:
    """One row: per position the symbol with the largest summed cnt (least symbol on ties), gaps dropped."""
    rows = aligned.select("cnt", F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))
    votes = rows.groupBy("position", "base").agg(F.sum("cnt").alias("n"))
    best = votes.groupBy("position").agg(F.min(F.struct((-F.col("n")).alias("o"), "base")).alias("b")).select("position", "b.base")
    return best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "base"))), lambda x: x["base"]), "").alias("c")).select(F.regexp_replace("c", "-", "").alias("seq"))  # one element a column


def degenerate_string(aligned: DataFrame) -> DataFrame:
    """One row: the IUPAC letter of the bases of each position."""
    table = F.create_map(*[F.lit(x) for c, b in S.IUPAC.items() for x in (b, c)])
    sets = aligned.select(F.posexplode(S.letters(F.col("seq"))).alias("position", "base")).where(F.col("base").isin(*"ACGT")).groupBy("position").agg(F.array_join(F.array_sort(F.collect_set("base")), "").alias("b"))
    return sets.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.try_element_at(table, F.col("b")).alias("l")))), lambda x: x["l"]), "").alias("seq"))


def residue_ranks(aligned: DataFrame, gaps_zero: bool = False) -> DataFrame:
    """(rowid, position, rank): each symbol as its rank by frequency in its column, rarest first, then by letter."""
    rows = aligned.select("rowid", F.posexplode(S.letters(F.col("seq"))).alias("position", "base"))
    counts = rows.groupBy("position", "base").agg(F.count("*").alias("n"))
    rank = counts.withColumn("rank", F.row_number().over(Window.partitionBy("position").orderBy("n", "base"))).drop("n")
    out = rows.join(rank, ["position", "base"])
    return out.withColumn("rank", F.when(F.col("base") == "-", 0).otherwise(F.col("rank")) if gaps_zero else F.col("rank")).select("rowid", "position", "rank")


# --- diversity


def haplotypes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(…, seq, n, fraction): summed counts of equal sequences and their share (of each group)."""
    return with_fraction(df.where("seq is not null").groupBy(*(by or []), "seq").agg(F.sum("cnt").alias("n")), by=by)


def diversity(haps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Haplotypes, singlets, doublets, expected heterozygosity, effective number, entropy (natural log) and its exponential."""
    p = F.col("fraction")
    entropy = F.sum(-p * F.log(p))
    return haps.groupBy(*(by or [])).agg(F.count("*").alias("haplotypes"), F.sum("n").alias("reads"), F.count_if(F.col("n") == 1).alias("singlets"), F.count_if(F.col("n") == 2).alias("doublets"), (1 - F.sum(p * p)).alias("he"), (1 / F.sum(p * p)).alias("effective"), entropy.alias("entropy"), F.exp(entropy).alias("exp_entropy"))


def frequency_table(haps: DataFrame, pop: str) -> DataFrame:
    """(seq, pop, fraction, size) of populations' haplotypes."""
    total = haps.groupBy(pop).agg(F.sum("n").alias("size"))
    return haps.join(F.broadcast(total), pop).select("seq", F.col(pop).alias("pop"), (F.col("n") / F.col("size")).alias("fraction"), "size")


def _measures(freq: DataFrame, groups: list[str], true_factor: bool) -> DataFrame:
    """Nei's Hs, Ht, Gst, Gst' and Jost's D of the populations in each group, with sample-size corrections.

    Populations count equally; a haplotype that a population lacks has frequency 0 there. Jost's factor
    is n / (n - 1) for n populations; with true_factor off it is the whole-number quotient (2 for two
    populations, else 1), for results that must equal tools which divide whole numbers.
    """
    pops = freq.select(*groups, "pop", "size").distinct().groupBy(*groups).agg(F.count("*").alias("k"), (F.count("*") / F.sum(1 / F.col("size"))).alias("harmonic"))
    within = freq.groupBy(*groups).agg(F.sum(F.col("fraction") * F.col("fraction")).alias("squares"))
    means = freq.groupBy(*groups, "seq").agg(F.sum("fraction").alias("f")).groupBy(*groups).agg(F.sum(F.col("f") * F.col("f")).alias("f2"))
    join = (lambda a, b: a.join(b, groups)) if groups else (lambda a, b: a.crossJoin(F.broadcast(b)))
    t = join(join(pops, within), means)
    hs, ht = 1 - F.col("squares") / F.col("k"), 1 - F.col("f2") / (F.col("k") * F.col("k"))
    t = t.select(*groups, "k", "harmonic", hs.alias("hs"), ht.alias("ht"))
    h = F.col("harmonic")
    t = t.withColumn("hs_est", F.when(h > 1, h / (h - 1) * F.col("hs"))).withColumn("ht_est", F.col("ht") + F.col("hs_est") / (h * F.col("k")))
    factor = F.col("k") / (F.col("k") - 1) if true_factor else F.floor(F.col("k") / (F.col("k") - 1)).cast("double")

    def gst(s: str, a: str) -> Column:
        return F.when(F.col(a) > 0, (F.col(a) - F.col(s)) / F.col(a))

    def jost(s: str, a: str) -> Column:
        return F.when((F.col("k") > 1) & (F.col(s) < 1), factor * (F.col(a) - F.col(s)) / (1 - F.col(s)))

    return t.select(*groups, F.col("k").alias("populations"), "hs", "ht", gst("hs", "ht").alias("gst"), jost("hs", "ht").alias("jost_d"), "hs_est", "ht_est", gst("hs_est", "ht_est").alias("gst_est"), jost("hs_est", "ht_est").alias("jost_d_est"))


def differentiation(haps: DataFrame, pop: str, true_factor: bool = True) -> DataFrame:
    """One row of measures over all populations."""
    return _measures(frequency_table(haps, pop), [], true_factor)


def pairwise_differentiation(haps: DataFrame, pop: str, true_factor: bool = True) -> DataFrame:
    """(pop_a, pop_b, measures) of each two populations. Populations are few; each row goes to its partners by a join on their list."""
    freq = frequency_table(haps, pop)
    pops = freq.select(F.col("pop").alias("x")).distinct()
    pairs = pops.join(F.broadcast(pops.withColumnRenamed("x", "y")), F.col("x") < F.col("y"))
    sides = pairs.select(F.col("x").alias("pop_a"), F.col("y").alias("pop_b"), F.explode(F.array("x", "y")).alias("pop"))
    return _measures(freq.join(F.broadcast(sides), "pop"), ["pop_a", "pop_b"], true_factor)


def top_haplotypes(df: DataFrame, by: list[str]) -> DataFrame:
    """(…, seq, fraction): each group's most frequent sequence (the least on ties) and its share."""
    best = F.min(F.struct((-F.col("fraction")).alias("f"), "seq"))
    return haplotypes(df, by).groupBy(*by).agg(best.alias("b")).select(*by, "b.seq", (-F.col("b.f")).alias("fraction"))


def counts_by_name_part(df: DataFrame, separator: str, part: int) -> DataFrame:
    """(part, n): reads by a part of their names, as of runs and wells; parts count from 1."""
    return df.where("name is not null").groupBy(F.split_part(F.col("name"), F.lit(separator), F.lit(part)).alias("part")).agg(F.count("*").alias("n"))


def strand_biased(df: DataFrame, forward: str, complement: str, repeated: str, bias: float = 0.75, least: float = 0.2) -> DataFrame:
    """Rows whose shares on the two strands differ by more than the bias and that enough repeats hold."""
    return df.where((F.abs(F.col(forward) - F.col(complement)) > bias) & (F.col(repeated) > least))
