"""Readers and writers of text formats: FASTA, FASTQ, BED, GFF3, tables, and the outputs of search tools.

Records of many lines are cut by Spark's own record delimiter, so a file is split over tasks; rowid
follows the order within a file's splits (file, offset order), stable for a given input. A record that
a format doesn't allow gives nulls, not a failure; empty files give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select("value", F.monotonically_increasing_id().alias("rowid"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("rowid"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, name, seq): name is the whole header line; line breaks in sequences are removed."""
    rows = _records(spark, path, "\n>").where(F.trim("value") != "")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    return rows.select("rowid", F.regexp_extract(text, r"^([^\n]*)", 1).alias("name"), F.regexp_replace(F.regexp_replace(text, r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def write_fasta(df: DataFrame, path: str, width: int | None = None, gzip: bool = False) -> None:
    seq = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("seq")
    df.where("seq is not null").select(F.concat(F.lit(">"), F.coalesce("name", F.lit("")), F.lit("\n"), seq)).write.option("compression", "gzip" if gzip else "none").text(path)


def read_fastq(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """(rowid, name, seq, qual): records of four lines; a record starts at a line with @ whose third line starts with +.

    Lines are numbered within a file over its splits, so records may cross splits.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.input_file_name().alias("_f"), F.monotonically_increasing_id().alias("_i"))
    part = F.shiftright("_i", 33)
    sizes = lines.groupBy("_f", part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = lines.withColumn("_p", part).join(F.broadcast(before.drop("_n")), ["_f", "_p"]).withColumn("_l", F.col("_before") + F.col("_i") - F.col("_first"))
    record = numbered.groupBy("_f", F.floor(F.col("_l") / 4).alias("_r")).agg(F.min("_i").alias("rowid"), *[F.max(F.when(F.col("_l") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("name", "seq", "_plus", "_q"))])
    qual = F.transform(F.split("_q", ""), lambda c: F.ascii(c) - offset)
    return record.where(F.col("name").startswith("@") & F.col("_plus").startswith("+")).select("rowid", F.substring("name", F.lit(2), F.length("name")).alias("name"), "seq", F.when(F.length("_q") > 0, qual).otherwise(F.array().cast("array<int>")).alias("qual"))


def write_fastq(df: DataFrame, path: str, offset: int = 33, gzip: bool = False) -> None:
    q = F.array_join(F.transform("qual", lambda x: F.chr(F.least(F.greatest(x, F.lit(0)), F.lit(93)) + offset)), "")
    df.where("seq is not null and qual is not null").select(F.concat(F.lit("@"), F.coalesce("name", F.lit("")), F.lit("\n"), "seq", F.lit("\n+\n"), q)).write.option("compression", "gzip" if gzip else "none").text(path)


def read_table(spark: SparkSession, path: str, header: bool = True, sep: str = "\t") -> DataFrame:
    """All columns as strings, with rowid."""
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False).withColumn("rowid", F.monotonically_increasing_id())


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.option("header", True).option("sep", "\t").option("emptyValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, chrom, start, end, name, score, strand, extra) of three or more columns; comments and track lines are skipped."""
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    c = F.split("value", "\t")
    get = lambda k: F.try_element_at(c, F.lit(k + 1))
    return rows.select("rowid", get(0).alias("chrom"), get(1).try_cast("bigint").alias("start"), get(2).try_cast("bigint").alias("end"), get(3).alias("name"), get(4).try_cast("double").alias("score"), get(5).alias("strand"), F.slice(c, 7, 1000).alias("extra"))


def write_bed(df: DataFrame, path: str) -> None:
    score = F.when(F.col("score") == F.floor("score"), F.col("score").cast("bigint").cast("string")).otherwise(F.col("score").cast("string"))
    df.select(F.concat_ws("\t", "chrom", "start", "end", F.coalesce("name", F.lit(".")), F.coalesce(score, F.lit("0")), F.coalesce("strand", F.lit("+")))).write.text(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, seqid, source, type, start, end, score, strand, phase, attributes): comments skipped, nothing after ##FASTA."""
    lines = _lines(spark, path)
    end = lines.where(F.col("value").startswith("##FASTA")).agg(F.min("rowid").alias("_end"))
    rows = lines.join(F.broadcast(end)).where((F.col("_end").isNull() | (F.col("rowid") < F.col("_end"))) & ~F.col("value").rlike(r"^(#|\s*$)"))
    c = F.split("value", "\t")
    get = lambda k: F.try_element_at(c, F.lit(k + 1))
    pairs = F.filter(F.split(F.coalesce(get(8), F.lit("")), ";"), lambda p: p.contains("="))
    none = F.create_map().cast("map<string,string>")
    attributes = F.aggregate(pairs, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != F.trim(F.substring_index(p, "=", 1))), F.create_map(F.trim(F.substring_index(p, "=", 1)), F.url_decode(F.regexp_replace(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p)), r"\+", "%2B")))))
    return rows.select("rowid", get(0).alias("seqid"), get(1).alias("source"), get(2).alias("type"), get(3).try_cast("bigint").alias("start"), get(4).try_cast("bigint").alias("end"), get(5).try_cast("double").alias("score"), get(6).alias("strand"), get(7).alias("phase"), attributes.alias("attributes"))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, json): the elements of files that hold one array each, as texts."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.monotonically_increasing_id().alias("_f"), F.posexplode(F.from_json("value", "array<variant>")).alias("rowid", "v")).select("_f", "rowid", F.to_json("v").alias("json"))


def read_sam(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    """Alignments of a SAM text in the shape of operators.pileup."""
    c = F.split("value", "\t")
    get = lambda k: F.try_element_at(c, F.lit(k + 1))
    rows = _lines(spark, path).where(~F.col("value").startswith("@") & (F.col("value") != ""))
    flag = get(1).try_cast("int")
    bit = lambda b: flag.bitwiseAND(b) != 0
    mate = F.when(get(6) == "=", get(2)).otherwise(get(6))
    qual = F.when(get(10) != "*", F.transform(F.split(get(10), ""), lambda x: F.ascii(x) - offset))
    return rows.select("rowid", get(0).alias("name"), F.when(get(2) != "*", get(2)).alias("chrom"), (get(3).try_cast("bigint") - 1).alias("pos"), get(4).try_cast("int").alias("mapq"), F.when(get(5) != "*", get(5)).alias("cigar"), F.when(mate != "*", mate).alias("mate_chrom"), (get(7).try_cast("bigint") - 1).alias("mate_pos"), get(8).try_cast("int").alias("insert_size"), get(9).alias("seq"), qual.alias("qual"), (~bit(4)).alias("mapped"), (bit(1) & ~bit(8)).alias("mate_mapped"), bit(16).alias("reverse"), (~bit(256) & ~bit(2048)).alias("primary"), bit(1).alias("paired"), bit(2).alias("proper"))


def sam_references(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, chrom, length) of the header's @SQ lines, in their order."""
    rows = _lines(spark, path).where(F.col("value").startswith("@SQ"))
    order = F.row_number().over(Window.orderBy("rowid")) - 1  # a header has one line a chromosome
    return rows.select(order.alias("ref_id"), F.regexp_extract("value", r"\tSN:([^\t]*)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:([0-9]+)", 1).try_cast("bigint").alias("length"))


#: The columns of tabular BLAST output and of HMMER's domain table.
BLAST = "query subject identity length mismatches gap_opens query_start query_end subject_start subject_end evalue bit_score".split()
DOMAINS = "target target_accession target_length query query_accession query_length evalue score bias domain of c_evalue i_evalue domain_score domain_bias hmm_from hmm_to ali_from ali_to env_from env_to accuracy".split()


def _typed(value: Column, name: str) -> Column:
    return value.alias(name) if name.startswith(("query", "subject", "target")) and not name.endswith(("start", "end", "length")) else value.try_cast("double").alias(name)


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|\s*$)"))
    return rows.select("rowid", *[_typed(F.try_element_at(F.split("value", "\t"), F.lit(k + 1)), n) for k, n in enumerate(BLAST)])


def read_hmmer_domains(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|\s*$)"))
    c = F.split(F.trim("value"), r"\s+", 23)
    return rows.select("rowid", *[_typed(F.try_element_at(c, F.lit(k + 1)), n) for k, n in enumerate(DOMAINS)], F.try_element_at(c, F.lit(23)).alias("description"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, name, seq): aligned sequences, the blocks of a name joined in order; annotation lines are left out."""
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^(#|//|\s*$)"))
    parts = rows.select("rowid", F.regexp_extract("value", r"^(\S+)\s+(\S+)", 1).alias("name"), F.regexp_extract("value", r"^(\S+)\s+(\S+)", 2).alias("s")).where("name <> ''")
    return parts.groupBy("name").agg(F.min("rowid").alias("rowid"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rowid", "s"))), lambda x: x["s"]), "").alias("seq"))  # the blocks of one record


def stockholm_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, kind, key, value) of #=GF and #=GC lines."""
    rows = _lines(spark, path).where(F.col("value").rlike(r"^#=G[FC]"))
    p = r"^#=(G[FC])\s+(\S+)\s+(.*)$"
    return rows.select("rowid", *[F.regexp_extract("value", p, k + 1).alias(n) for k, n in enumerate(("kind", "key", "value"))])


def read_repeat_masker(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, score, chrom, start, end, strand, element, family, region_id): start from 0."""
    rows = _lines(spark, path).withColumn("c", F.split(F.trim("value"), r"\s+")).where(F.try_element_at("c", F.lit(1)).rlike("^[0-9]+$"))
    get = lambda k: F.try_element_at("c", F.lit(k))
    return rows.select("rowid", get(1).try_cast("int").alias("score"), get(5).alias("chrom"), (get(6).try_cast("bigint") - 1).alias("start"), get(7).try_cast("bigint").alias("end"), F.when(get(9) == "C", "-").otherwise("+").alias("strand"), get(10).alias("element"), get(11).alias("family"), get(15).alias("region_id"))


def repeats_of_element(repeats: DataFrame, pattern: str) -> DataFrame:
    """All elements of the regions that have one whose name the pattern matches whole."""
    hit = repeats.where(F.col("element").rlike(f"^(?:{pattern})$")).select("chrom", "region_id").distinct()
    return repeats.join(hit, ["chrom", "region_id"], "left_semi")


def read_tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, score, strand) of a repeat finder's .dat file; each row belongs to the Sequence line before it."""
    rows = _records(spark, path, "Sequence:").where(F.col("rowid") >= 0)
    lines = rows.select(F.trim(F.regexp_extract("value", r"^([^\n]*)", 1)).alias("chrom"), F.explode(F.split("value", "\n")).alias("l"))
    c = F.split(F.trim("l"), r"\s+")
    ok = lines.where(F.col("l").rlike(r"^[0-9]+ [0-9]+ [0-9]+ "))
    return ok.select("chrom", (c[0].cast("bigint") - 1).alias("start"), c[1].cast("bigint").alias("end"), F.concat(c[13], F.lit("_x"), c[3]).alias("name"), c[7].cast("double").alias("score"), F.lit("+").alias("strand"))


def read_primer3(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, record): the key=value lines of each block (closed by a line =) as a map."""
    rows = _records(spark, path, "\n=\n").where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: x.contains("=") & ~x.startswith("="))
    none = F.create_map().cast("map<string,string>")
    return rows.select("rowid", F.aggregate(lines, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != F.substring_index(p, "=", 1)), F.create_map(F.substring_index(p, "=", 1), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))))).alias("record"))


def primer3_to_bed(records: DataFrame, most: int = 1000) -> DataFrame:
    """(rowid, chrom, start, end, name, score, strand) of the left and right primers; places as start,length."""
    entries = records.select("rowid", F.try_element_at("record", F.lit("SEQUENCE_ID")).alias("chrom"), F.explode("record").alias("k", "v")).where(F.col("k").rlike(r"^PRIMER_(LEFT|RIGHT)_[0-9]+$"))
    at, size = F.split("v", ",")[0].try_cast("bigint"), F.split("v", ",")[1].try_cast("bigint")
    right = F.col("k").contains("RIGHT")
    return entries.select("rowid", "chrom", F.when(right, at - size + 1).otherwise(at).alias("start"), F.when(right, at + 1).otherwise(at + size).alias("end"), F.col("k").alias("name"), size.cast("double").alias("score"), F.when(right, "-").otherwise("+").alias("strand"))


def read_embl(spark: SparkSession, path: str) -> DataFrame:
    """(record, type, start, end, strand, locus_tag): features with a locus tag; spans and complements are resolved."""
    rows = _records(spark, path, "\n//").where(F.col("value").contains("\nFT"))
    name = F.regexp_extract("value", r"(?m)^ID\s+([^;\s]+)", 1)
    table = F.array_join(F.regexp_extract_all("value", F.lit(r"(?m)^FT(.*)$"), 1), "\n")
    features = rows.select(name.alias("record"), F.explode(F.split(F.concat(F.lit("\n"), table), r"\n(?=   [A-Za-z])")).alias("f")).where("f <> ''")
    place = F.regexp_replace(F.regexp_extract("f", r"(?s)^\s*\S+\s+(.*?)(?=\n\s+/|$)", 1), r"\s", "")
    numbers = F.transform(F.regexp_extract_all(place, F.lit("([0-9]+)"), 1), lambda x: x.cast("bigint"))
    out = features.select("record", F.regexp_extract("f", r"^\s*(\S+)", 1).alias("type"), F.array_min(numbers).alias("start"), F.array_max(numbers).alias("end"), F.when(place.contains("complement"), "-").otherwise("+").alias("strand"), F.regexp_extract("f", r'/locus_tag="([^"]*)"', 1).alias("locus_tag"), F.regexp_extract_all(place, F.lit(r"([0-9]+\.\.[<>]?[0-9]+)"), 1).alias("spans"))
    return out.where("locus_tag <> ''")


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(id_a, id_b, distance) of lines 'a -- b distance'."""
    p = r"^\s*(.+?)\s+--\s+(.+?)\s+([0-9.eE+-]+)\s*$"
    rows = _lines(spark, path).where(F.col("value").rlike(p))
    return rows.select(F.regexp_extract("value", p, 1).alias("id_a"), F.regexp_extract("value", p, 2).alias("id_b"), F.regexp_extract("value", p, 3).try_cast("double").alias("distance"))


#: The header of the VCF files written.
VCF_HEAD = (
    "##fileformat=VCFv4.0",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="depth">',
    '##INFO=<ID=AC,Number=1,Type=Integer,Description="count">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
)


def write_vcf(variants: DataFrame, path: str) -> None:
    """Variants (chrom, pos from 0, ref, alt, n, depth) as VCF 4.0, sorted over the files of path in their order; the first one has the header, so the file is what they make together."""
    info = F.concat(F.lit("DP="), "depth", F.lit(";AC="), "n")
    row = F.concat_ws("\t", "chrom", (F.col("pos") + 1).cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info)
    rows = variants.select(F.lit(1).alias("o"), "chrom", "pos", row.alias("value"))
    head = variants.sparkSession.createDataFrame([(0, "", k, line) for k, line in enumerate(VCF_HEAD)], "o int, chrom string, pos long, value string")
    head.unionByName(rows).orderBy("o", "chrom", "pos", "value").select("value").write.text(path)


def read_named_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rowid, name, seq) of lines 'name sequence', separated by white space; a line of one word has no name."""
    words = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.trim("value") != "").select("rowid", words.alias("w"))
    return rows.select("rowid", F.when(F.size("w") > 1, F.col("w")[0]).alias("name"), F.element_at("w", -1).alias("seq"))


def write_named_lines(df: DataFrame, path: str, name_after: bool = False) -> None:
    """Sequences as lines with their names before or after them."""
    columns = ["seq", "name"] if name_after else ["name", "seq"]
    df.where("seq is not null").select(F.concat_ws(" ", *columns)).write.text(path)


def read_interleaved(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of lines 'name part' whose parts follow each other over the file, points taken out."""
    rows = read_named_lines(spark, path).where("name is not null")
    parts = rows.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rowid", "seq"))).alias("p"))
    return parts.select("name", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["seq"]), ""), r"\.", "").alias("seq"))
