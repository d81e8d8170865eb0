"""Alignments and pileups: reads of alignments, per-position counts, coverage, the variant rule.

Alignments: name, chrom, pos (0-based), cigar (string), seq, qual, mapq, reverse, primary, mapped, and
for pairs mate_chrom, mate_mapped, insert_size. Pileups are long tables (chrom, pos, strand, hq, base,
n), from one exploded aggregation with partial sums.

Defined results: unmapped or null-position alignments have no positions; a base count of zero never
gives a fraction (the strand bias of a base that high-quality reads lack is null, and it is no
variant); depth must be strictly above its cut-off, fractions strictly above theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = "ACGTN"


def operations(df: DataFrame) -> DataFrame:
    """One row per CIGAR operation: op, size, and where it begins on reference (ref_at) and read (read_at)."""
    parts = F.regexp_extract_all("cigar", F.lit(r"([0-9]+[MIDNSHP=X])"), 1)
    zero = F.struct(F.col("pos").cast("bigint").alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<op:string,size:int,ref_at:bigint,read_at:int>>").alias("all"))

    def step(acc: Column, p: Column) -> Column:
        op, size = F.substring(p, -1, 1), F.regexp_extract(p, "[0-9]+", 0).cast("int")
        row = F.struct(op.alias("op"), size.alias("size"), acc["r"].alias("ref_at"), acc["q"].alias("read_at"))
        return F.struct((acc["r"] + F.when(op.isin(*"MDN=X"), size).otherwise(0)).alias("r"), (acc["q"] + F.when(op.isin(*"MIS=X"), size).otherwise(0)).alias("q"), F.concat(acc["all"], F.array(row)).alias("all"))

    return df.where("mapped and pos is not null and cigar is not null").select("*", F.inline(F.aggregate(parts, zero, step, lambda a: a["all"])))


def aligned_length(cigar: Column) -> Column:
    sizes = F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[MDN=X]"), 1)
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x.cast("int"))


def to_bed(df: DataFrame, unmapped: bool = False) -> DataFrame:
    size = aligned_length(F.col("cigar"))
    rows = df if unmapped else df.where("mapped")
    return rows.select(F.when(F.col("mapped"), F.col("chrom")).otherwise("*").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + size).alias("end"), "name", size.cast("double").alias("score"), F.when(F.col("reverse"), "-").otherwise("+").alias("strand"))


def pileup(df: DataFrame, quality: int = 20, mapq: int = 0, primary_only: bool = True) -> DataFrame:
    """(chrom, pos, strand, hq, base, n) of aligned bases; base I and D count insertions before and deletions at a position."""
    rows = df.where((F.col("mapq") >= mapq) & (F.col("primary") | F.lit(not primary_only)))
    ops = operations(rows)
    strand = F.when(F.col("reverse"), "-").otherwise("+").alias("strand")
    cells = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("ref_at") + i).alias("pos"), F.substring("seq", F.col("read_at") + i + 1, F.lit(1)).alias("base"), (F.get("qual", F.col("read_at") + i) >= quality).alias("hq")))
    gap = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("ref_at") + i).alias("pos"), F.lit("D").alias("base"), F.lit(True).alias("hq")))
    extra = F.array(F.struct(F.col("ref_at").alias("pos"), F.lit("I").alias("base"), F.lit(True).alias("hq")))
    every = F.when(F.col("op").isin("M", "=", "X"), cells).when(F.col("op") == "D", gap).when(F.col("op") == "I", extra)
    flat = ops.where(F.col("op").isin(*"M=XDI")).select("chrom", strand, F.explode(every).alias("c"))
    return flat.groupBy("chrom", "c.pos", "strand", F.coalesce("c.hq", F.lit(True)).alias("hq"), F.upper("c.base").alias("base")).agg(F.count("*").alias("n"))


def depth_summary(piles: DataFrame) -> DataFrame:
    depth = piles.where("base <> 'I'").groupBy("chrom", "pos").agg(F.sum("n").alias("depth"))
    return depth.groupBy("chrom").agg(F.min("depth").alias("min"), F.max("depth").alias("max"), F.avg("depth").alias("mean"), F.percentile("depth", F.lit(0.5)).alias("median"), F.stddev_samp("depth").alias("sd"), F.count("*").alias("positions"))


def variants(piles: DataFrame, reference: DataFrame, depth: int = 10, fraction: float = 0.01, bias: float = 0.2, biallelic: bool = False) -> DataFrame:
    """(chrom, pos, ref, alt, n, depth, fraction, forward): bases other than the reference (chrom, pos, ref) by the variant rule.

    A base is a variant if depth and fraction are strictly above their cut-offs and the forward share
    of its high-quality counts is strictly inside (bias, 1 - bias).
    """
    high = piles.where(F.col("hq") & F.col("base").isin(*"ACGTNDI"))
    at = high.where(F.col("base") != "I").groupBy("chrom", "pos").agg(F.sum("n").alias("depth"))
    own = high.groupBy("chrom", "pos", F.col("base").alias("alt")).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("strand") == "+", F.col("n"))), F.lit(0)).alias("f"))
    both = own.join(at, ["chrom", "pos"]).join(reference, ["chrom", "pos"]).where((F.col("alt") != F.col("ref")) & (F.col("alt") != "N"))
    share = F.when(F.col("n") > 0, F.col("f") / F.col("n"))
    rows = both.withColumns({"fraction": F.col("n") / F.col("depth"), "forward": share})
    rows = rows.where((F.col("depth") > depth) & (F.col("fraction") > fraction) & (F.col("forward") > bias) & (F.col("forward") < 1 - bias))
    rows = rows.select("chrom", "pos", "ref", "alt", "n", "depth", "fraction", "forward")
    if biallelic:
        single = rows.groupBy("chrom", "pos").agg(F.count("*").alias("_k")).where("_k = 1").drop("_k")
        rows = rows.join(single, ["chrom", "pos"], "left_semi")
    return rows


def at_places(piles: DataFrame, places: DataFrame, width: int = 10_000) -> DataFrame:
    """Pileup totals at every position of regions (name, chrom, start, end), zero where there are none."""
    spots = places.select("name", "chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    sums = piles.groupBy("chrom", "pos").pivot("base", list(BASES)).agg(F.sum("n"))
    return spots.join(sums, ["chrom", "pos"], "left").select("name", "chrom", "pos", *[F.coalesce(b, F.lit(0)).alias(b) for b in BASES])


def place_coverage(piles: DataFrame, places: DataFrame) -> DataFrame:
    """(name, min, max, mean, median) of depth over a region's positions that are present."""
    depth = piles.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"))
    spots = places.select("name", "chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return spots.join(depth, ["chrom", "pos"]).groupBy("name").agg(F.min("depth").alias("min"), F.max("depth").alias("max"), F.avg("depth").alias("mean"), F.percentile("depth", F.lit(0.5)).alias("median"))


def read_profile(df: DataFrame, mapq: int = 0) -> DataFrame:
    """Counts by chromosome, position and size at once (grouping sets), with the share of forward reads."""
    rows = df.where("mapped").where(F.col("mapq") > mapq).withColumn("size", aligned_length(F.col("cigar")))
    sets = [[F.col("chrom")], [F.col("chrom"), F.col("pos")], [F.col("chrom"), F.col("size")]]
    return rows.groupingSets(sets, "chrom", "pos", "size").agg(F.count("*").alias("n"), F.avg(F.when(F.col("reverse"), 0.0).otherwise(1.0)).alias("forward"))


def insert_sizes(df: DataFrame) -> DataFrame:
    return df.where("mapped and mate_mapped and insert_size is not null").groupBy(F.abs("insert_size").alias("size")).agg(F.count("*").alias("n"))


def mate_status(df: DataFrame) -> DataFrame:
    concordant = F.coalesce(F.col("mapped") & F.col("mate_mapped") & (F.col("chrom") == F.col("mate_chrom")), F.lit(False))
    return df.groupBy(concordant.alias("concordant"), "mapped", "mate_mapped").agg(F.count("*").alias("n"))


def soft_clips(df: DataFrame) -> DataFrame:
    left, right = F.regexp_extract("cigar", r"^(?:[0-9]+H)?([0-9]+)S", 1), F.regexp_extract("cigar", r"[MIDNP=X]([0-9]+)S(?:[0-9]+H)?$", 1)
    return df.where("mapped").withColumns({"left_clip": F.coalesce(left.try_cast("int"), F.lit(0)), "right_clip": F.coalesce(right.try_cast("int"), F.lit(0))}).where("left_clip > 0 or right_clip > 0")


def flag_statistics(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_if(F.col("mapped")).alias("mapped"), F.count_if(~F.col("primary")).alias("secondary"), F.count_if(F.col("mate_mapped") & F.col("mapped")).alias("both_mapped"), F.count_if(F.col("mapped") & F.col("mate_mapped") & (F.col("chrom") != F.col("mate_chrom"))).alias("mates_apart"))


def error_profile(df: DataFrame, reference: DataFrame) -> DataFrame:
    """(read_pos, ref, base, n, rate): base substitutions by position on the read; rate within (read_pos, ref)."""
    ops = operations(df.where("primary")).where(F.col("op").isin("M", "=", "X"))
    cells = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.struct((F.col("ref_at") + i).alias("pos"), (F.col("read_at") + i).alias("read_pos"), F.substring("seq", F.col("read_at") + i + 1, F.lit(1)).alias("base")))
    flat = ops.select("chrom", F.inline(cells)).join(reference, ["chrom", "pos"])
    counts = flat.groupBy("read_pos", "ref", "base").agg(F.count("*").alias("n"))
    total = counts.groupBy("read_pos", "ref").agg(F.sum("n").alias("_t"))
    return counts.join(total, ["read_pos", "ref"]).withColumn("rate", F.col("n") / F.col("_t")).drop("_t")


def per_position(df: DataFrame, places: DataFrame, what: str) -> DataFrame:
    """(name, chrom, pos, value, n): histogram of an alignment column at each position of regions; value null and n 0 where there are none."""
    from seqloom.operators.intervals import overlapping

    spots = places.select("name", "chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    bed = to_bed(df.withColumn("name", F.col(what).cast("string")))
    pairs = overlapping(places.select("name", "chrom", "start", "end"), bed)
    inside = pairs.select("name", "chrom", F.explode(F.sequence(F.greatest("start", "start_b"), F.least("end", "end_b") - 1)).alias("pos"), F.col("name_b").alias("value"))
    counts = inside.groupBy("name", "chrom", "pos", "value").agg(F.count("*").alias("n"))
    return spots.join(counts, ["name", "chrom", "pos"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def paired(df: DataFrame) -> DataFrame:
    """(name, seq_1, qual_1, seq_2, qual_2): primary alignments of a name side by side, turned to how they were read."""
    from seqloom.functions.sequence import reverse_complement

    rows = df.where("primary").select("name", F.struct(F.coalesce("rowid", F.lit(0)).alias("o"), F.when(F.col("reverse"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(F.col("reverse"), F.reverse("qual")).otherwise(F.col("qual")).alias("qual")).alias("r"))
    both = rows.groupBy("name").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count("*").alias("n"))
    two = F.col("n") > 1
    return both.select("name", F.col("a.seq").alias("seq_1"), F.col("a.qual").alias("qual_1"), F.when(two, F.col("b.seq")).alias("seq_2"), F.when(two, F.col("b.qual")).alias("qual_2"))


def is_sorted(df: DataFrame) -> DataFrame:
    """One row: whether alignments (in the order of rowid) go up by position within runs of a chromosome that don't come back."""
    from pyspark.sql import Window

    order = Window.partitionBy("chrom").orderBy("rowid")
    rows = df.where("chrom is not null").select("chrom", "rowid", "pos", F.lag("pos").over(order).alias("before"))
    spans = rows.groupBy("chrom").agg(F.min("rowid").alias("a"), F.max("rowid").alias("b"), F.max((F.col("pos") < F.col("before")).cast("int")).alias("bad"))
    clash = F.lag("b").over(Window.orderBy("a"))  # one row a chromosome
    return spans.withColumn("clash", clash).agg(F.coalesce(F.max(F.coalesce("bad", F.lit(0))) + F.max(F.coalesce((F.col("clash") > F.col("a")).cast("int"), F.lit(0))), F.lit(0)).alias("x")).select((F.col("x") == 0).alias("sorted"))


def flag_chromosomes(df: DataFrame, chroms: list[str]) -> DataFrame:
    """include: false for alignments of names of which every aligned mate lies on one of these chromosomes."""
    bad = df.groupBy("name").agg(F.min(F.coalesce(F.col("chrom").isin(*chroms), F.lit(False)).cast("int")).alias("_bad"))
    return df.join(bad, "name").withColumn("include", F.col("_bad") == 0).drop("_bad")


def pair_statistics(df: DataFrame, places: DataFrame, longest: int) -> DataFrame:
    """(name, total, proper, mate_unmapped, discordant) of alignments in each region; zeros where there are none."""
    from seqloom.operators.intervals import overlapping

    apart = F.coalesce(F.col("chrom") != F.col("mate_chrom"), F.lit(False)) | (F.abs("insert_size") > longest)
    kind = F.when(~F.col("mate_mapped"), "mate_unmapped").when(apart, "discordant").otherwise("proper")
    pairs = overlapping(places.select("name", "chrom", "start", "end"), to_bed(df.withColumn("name", kind)))
    counts = pairs.groupBy("name").agg(F.count("*").alias("total"), *[F.count_if(F.col("name_b") == k).alias(k) for k in ("proper", "mate_unmapped", "discordant")])
    return places.select("name").join(counts, "name", "left").na.fill(0)


def mate_distances(df: DataFrame) -> DataFrame:
    """(distance, n): how far the mates of a name lie apart in the order of rowid."""
    two = df.groupBy("name").agg(F.min("rowid").alias("a"), F.max("rowid").alias("b"), F.count("*").alias("k")).where("k = 2")
    return two.groupBy((F.col("b") - F.col("a")).alias("distance")).agg(F.count("*").alias("n"))
