"""Annotation records (GFF3-like): seqid, type, start, end (1-based, closed), strand, attributes map, rowid.

Counts are single aggregations; hierarchies are walked by joins of the found ids with their children,
level by level, so that the number of rounds is the depth of the hierarchy, not its size. Records
without an attribute count under 'none'; null attributes have none; cycles end where no new id is
found; parents that don't exist give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.intervals import overlapping
from seqloom.runtime import written


def attribute(key: str) -> Column:
    return F.try_element_at("attributes", F.lit(key))


def counted(df: DataFrame, what: Column) -> DataFrame:
    return df.groupBy(F.coalesce(what, F.lit("none")).alias("level")).agg(F.count("*").alias("n"))


def attribute_keys(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("attributes")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def to_bed(df: DataFrame) -> DataFrame:
    """(chrom, start, end, name, score, strand, rowid): 0-based half-open; name from ID, then Name, then the place."""
    name = F.coalesce(attribute("ID"), attribute("Name"), F.concat_ws("-", "seqid", "start", "end"))
    return df.select(F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", name.alias("name"), (F.col("end") - F.col("start") + 1).cast("double").alias("score"), F.coalesce("strand", F.lit("+")).alias("strand"), "rowid", "type", "attributes")


def to_json(df: DataFrame) -> DataFrame:
    return df.select("rowid", F.to_json(F.struct("seqid", "type", "start", "end", "strand", "attributes")).alias("json"))


def with_descendants(df: DataFrame, ids: list[str], most_depth: int = 1000) -> DataFrame:
    """Records with one of these ids, and all records below them, with their depth."""
    links = df.select(attribute("ID").alias("id"), F.explode(F.split(attribute("Parent"), ",")).alias("parent"))
    found = df.where(attribute("ID").isin(*ids)).select(attribute("ID").alias("id")).distinct().withColumn("depth", F.lit(0))
    level, depth, rows = found, 0, df.where(attribute("ID").isin(*ids)).withColumn("depth", F.lit(0))
    while depth < most_depth:
        depth += 1
        parents = level.select(F.col("id").alias("_p")).distinct()
        kids = df.withColumn("_parent", F.explode(F.split(attribute("Parent"), ","))).join(parents, F.col("_parent") == F.col("_p"), "left_semi").drop("_parent").dropDuplicates(["rowid"])
        kids = written(kids.join(rows.select("rowid"), "rowid", "left_anti").withColumn("depth", F.lit(depth)).select(rows.columns), "level")
        if not kids.limit(1).count():
            break
        rows = rows.unionByName(kids)
        level = kids.select(attribute("ID").alias("id")).where("id is not null")
    del links, found
    return rows


def children_counted(df: DataFrame, parent_type: str, child_type: str) -> DataFrame:
    """(id, n): children of one type of each record of another type; zero where there are none."""
    own = df.where(F.col("type") == parent_type).select(attribute("ID").alias("id"))
    kids = df.where(F.col("type") == child_type).select(F.explode(F.split(attribute("Parent"), ",")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return own.join(kids, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def numbered_parts(df: DataFrame, type_: str) -> DataFrame:
    """(parent, number, start, end): the distinct parts of each parent, numbered along the strand."""
    parts = df.where(F.col("type") == type_).select(F.explode(F.split(attribute("Parent"), ",")).alias("parent"), "start", "end", "strand").distinct()
    order = Window.partitionBy("parent").orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")), "end")
    return parts.select("parent", F.row_number().over(order).alias("number"), "start", "end")


def intersecting(regions: DataFrame, df: DataFrame, types: list[str] | None = None, least: int = 1) -> DataFrame:
    """Pairs of regions (chrom, start, end, …) and records of these types."""
    bed = to_bed(df.where(F.col("type").isin(*types)) if types else df)
    return overlapping(regions, bed, least)


def regions_clipped(regions: DataFrame, df: DataFrame, types: list[str], key: str = "rowid") -> DataFrame:
    """(key, start, end): regions cut to the common part of the records that they intersect."""
    pairs = intersecting(regions, df, types)
    return pairs.groupBy(key).agg(F.greatest(F.first("start"), F.max("start_b")).alias("start"), F.least(F.first("end"), F.min("end_b")).alias("end"))


def regions_oriented(regions: DataFrame, df: DataFrame, types: list[str], key: str = "rowid") -> DataFrame:
    """regions with the strand of the last record (by rowid) that they intersect; as they are without one."""
    last = intersecting(regions, df, types).groupBy(key).agg(F.max_by("strand_b", "rowid_b").alias("_s"))
    return regions.join(last, key, "left").withColumn("strand", F.coalesce("_s", "strand")).drop("_s")


def coding_positions(df: DataFrame, one_based: bool = True) -> DataFrame:
    """(parent, part_start, part_end, before, strand): each coding part with the coding letters before it."""
    parts = df.where(F.col("type") == "CDS").select(F.explode(F.split(attribute("Parent"), ",")).alias("parent"), F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("start"), "end", "strand").distinct()
    order = Window.partitionBy("parent").orderBy(F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start")))
    before = F.coalesce(F.sum(F.col("end") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("before", before)


def amino_acids_to_bed(df: DataFrame, positions: DataFrame, one_based: bool = True) -> DataFrame:
    """(id, aa, chrom, start, end, strand): the span of the codon of an amino-acid position (id, aa), over its coding parts."""
    parts = coding_positions(df)
    want = positions.select("id", "aa", ((F.col("aa") - (1 if one_based else 0)) * 3).alias("at"))
    size = F.col("end") - F.col("start")
    hit = want.join(parts, F.col("id") == F.col("parent")).where((F.col("at") < F.col("before") + size) & (F.col("at") + 3 > F.col("before")))
    a, b = F.greatest(F.col("at") - F.col("before"), F.lit(0)), F.least(F.col("at") + 3 - F.col("before"), size)
    start = F.when(F.col("strand") == "-", F.col("end") - b).otherwise(F.col("start") + a)
    end = F.when(F.col("strand") == "-", F.col("end") - a).otherwise(F.col("start") + b)
    return hit.groupBy("id", "aa", "chrom", "strand").agg(F.min(start).alias("start"), F.max(end).alias("end"))


def coding_sequences(df: DataFrame, genome: DataFrame) -> DataFrame:
    """(parent, cdna, protein): the coding parts of each parent joined along the strand, and their translation."""
    from seqloom.functions import sequence as S

    parts = coding_positions(df).join(genome.select("chrom", F.col("seq").alias("_s")), "chrom")
    text = F.expr("substring(_s, int(start + 1), int(end - start))")
    piece = F.when(F.col("strand") == "-", S.reverse_complement(text)).otherwise(text)
    whole = parts.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("before", piece.alias("t")))), lambda x: x["t"]), "").alias("cdna"))  # the parts of one transcript
    return whole.withColumn("protein", S.translated(F.col("cdna")))


def position_table(df: DataFrame) -> DataFrame:
    """(parent, cdna_pos, chrom, pos, strand): every coding letter's place on the transcript and the chromosome, from 0."""
    size = F.col("end") - F.col("start")
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), size - 1)).alias("k")
    rows = coding_positions(df).where("end > start").select("parent", "chrom", "start", "end", "before", "strand", at)
    place = F.when(F.col("strand") == "-", F.col("end") - 1 - F.col("k")).otherwise(F.col("start") + F.col("k"))
    return rows.select("parent", (F.col("before") + F.col("k")).alias("cdna_pos"), "chrom", place.alias("pos"), "strand")


def transcript_span(df: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, chrom, start, end, strand): the place on the chromosome of transcript positions [cdna_start, cdna_end) of spans."""
    rows = position_table(df).join(spans, F.col("parent") == F.col("id")).where("cdna_pos >= cdna_start and cdna_pos < cdna_end")
    return rows.groupBy("id", "cdna_start", "cdna_end", "chrom", "strand").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def elements_without_others(df: DataFrame, pattern: str) -> DataFrame:
    """Spans (chrom, region_id, start, end) of the regions that have a matching element, and whether another region's element starts inside."""
    hit = df.where(F.col("element").rlike(f"^(?:{pattern})$")).select("chrom", "region_id").distinct()
    spans = df.join(hit, ["chrom", "region_id"], "left_semi").groupBy("chrom", "region_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    starts = df.select("chrom", "start", (F.col("start") + 1).alias("end"), "region_id")
    inside = overlapping(spans, starts).where((F.col("region_id_b") != F.col("region_id"))).select("chrom", "region_id").distinct().withColumn("intervened", F.lit(True))
    return spans.join(inside, ["chrom", "region_id"], "left").withColumn("intervened", F.coalesce("intervened", F.lit(False)))
