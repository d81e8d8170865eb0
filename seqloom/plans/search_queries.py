"""Queries of target search, primers, k-mer graphs, text formats and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from seqloom.operators import graphs as D
from seqloom.operators import info as I
from seqloom.operators import search as Q
from seqloom.plans.common import CONTIGS, READS, REFS, REGIONS, SCORED, contigs, reads, refs, regions, scored
from seqloom.runtime import shared_dir, table
from seqloom.sources import text as T
from seqloom.streaming import windows as W

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=READS):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


def folder(spark):
    return f"{shared_dir(spark)}/seqloom/files-{uuid.uuid4().hex}"


# --- a target in reads: the commonest 20 letters at their fronts, and at their backs


def common(s, d, side):
    ends = reads(s, d).where("length(seq) >= 40 and seq rlike '^[ACGT]*$'").select(F.expr(f"{side}(seq, 20)").alias("t"))
    row = ends.groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").select("t").first()
    return row[0] if row else "ACGTACGTACGTACGTACGT"


add("find_target", lambda s, d: Q.located(reads(s, d), common(s, d, "left"), True).select("rowid", "score", "start", "end", "identity", "coverage", "reverse"))
add("extract_by_target", lambda s, d: Q.holding(reads(s, d), common(s, d, "left"), 0.85, 0.85, 30, True).select("rowid", "start", "end"))
add("trim_before_target", lambda s, d: Q.trimmed_before(reads(s, d), common(s, d, "left")).select("rowid", "on", "seq"))
add("trim_from_target", lambda s, d: Q.trimmed_from(reads(s, d), common(s, d, "right"), keep=False).select("rowid", "on", "seq"))
add("trim_between_targets", lambda s, d: Q.trimmed_between(reads(s, d), common(s, d, "left"), common(s, d, "right"), keep=False).select("rowid", "on", "seq"))
_HIT = "SELECT chrom, i - 1 AS a, i + {n} - 1 AS b, '{s}' AS strand FROM (SELECT chrom, seq, unnest(range(1, length(seq) - {n} + 2)) AS i FROM contigs WHERE length(seq) >= {n}) WHERE substr(seq, i, {n}) = '{m}'"
add("primer_products", lambda s, d: Q.primer_pairs(contigs(s, d), "GATTC", "CCTGA", 400), ", f AS (" + _HIT.format(n=5, s="+", m="GATTC") + " UNION ALL " + _HIT.format(n=5, s="-", m="GAATC") + "), r AS (" + _HIT.format(n=5, s="+", m="CCTGA") + " UNION ALL " + _HIT.format(n=5, s="-", m="TCAGG") + """)
SELECT f.chrom AS id, CAST(least(f.a, r.a) AS INTEGER) AS start, CAST(greatest(f.b, r.b) AS INTEGER) AS "end", f.strand, CAST(greatest(f.b, r.b) - least(f.a, r.a) AS INTEGER) AS insert FROM f JOIN r ON f.chrom = r.chrom AND f.strand <> r.strand AND (CASE WHEN f.strand = '+' THEN f.b <= r.a ELSE r.b <= f.a END) AND greatest(f.b, r.b) - least(f.a, r.a) <= 400""", CONTIGS)

# --- graphs of k-mers and of ends

_K = "SELECT rowid, substr(seq, i, {k}) AS kmer FROM (SELECT rowid, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {t} WHERE length(seq) >= {k})"
add("de_bruijn_edges", lambda s, d: D.de_bruijn(reads(s, d), 9), f"SELECT left(kmer, 8) AS a, right(kmer, 8) AS b, count(*) AS n FROM ({_K.format(k=9, t='reads')}) GROUP BY kmer")
add("de_bruijn_paths", lambda s, d: D.degrees(D.de_bruijn(refs(s, d), 9)), f", e AS (SELECT left(kmer, 8) AS a, right(kmer, 8) AS b, count(*) AS n FROM ({_K.format(k=9, t='refs')}) GROUP BY kmer), o AS (SELECT a AS node, count(*) AS outgoing, CAST(sum(n) AS BIGINT) AS out_weight FROM e GROUP BY a), j AS (SELECT b AS node, count(*) AS incoming, CAST(sum(n) AS BIGINT) AS in_weight FROM e GROUP BY b) SELECT node, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(out_weight, 0) AS out_weight, coalesce(in_weight, 0) AS in_weight FROM o FULL JOIN j USING (node)", REFS)
add("overlap_edges", lambda s, d: D.overlaps(reads(s, d), 12), ", u AS (SELECT min(rowid) AS rowid, seq FROM reads WHERE length(seq) >= 12 GROUP BY seq) SELECT a.rowid AS a, b.rowid AS b FROM u a JOIN u b ON right(a.seq, 12) = left(b.seq, 12) AND a.rowid <> b.rowid")
add("fuzzy_kmer_counts", lambda s, d: D.fuzzy_counts(reads(s, d), 6), f", k AS (SELECT kmer, count(*) AS n FROM ({_K.format(k=6, t='reads')}) WHERE regexp_matches(kmer, '^[ACGT]*$') GROUP BY kmer) SELECT a.kmer, any_value(a.n) AS n, CAST(sum(b.n) AS BIGINT) AS near FROM k a JOIN k b ON hamming(a.kmer, b.kmer) <= 1 GROUP BY a.kmer")
add("snp_pairs", lambda s, d: D.snp_pairs(reads(s, d)), ", v AS (SELECT DISTINCT seq AS v FROM reads), p AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON length(a.v) = length(b.v) AND a.v < b.v WHERE a.v <> '' AND hamming(a.v, b.v) = 1) SELECT a, b, CAST(i - 1 AS INTEGER) AS position, a[i] AS base_a, b[i] AS base_b FROM (SELECT *, unnest(range(1, length(a) + 1)) AS i FROM p) WHERE a[i] <> b[i]")
add("highest_fraction_haplotypes", lambda s, d: I.top_haplotypes(reads(s, d).where("sample is not null and cnt > 0"), ["sample"]), ", h AS (SELECT sample, seq, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY sample) AS fraction FROM reads WHERE sample IS NOT NULL AND cnt > 0 GROUP BY sample, seq) SELECT sample, seq, fraction FROM h QUALIFY row_number() OVER (PARTITION BY sample ORDER BY fraction DESC, seq) = 1")
add("run_counts", lambda s, d: I.counts_by_name_part(reads(s, d), "_", 1), "SELECT split_part(name, '_', 1) AS part, count(*) AS n FROM reads WHERE name IS NOT NULL GROUP BY 1")
add("strand_biased_rows", lambda s, d: I.strand_biased(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).cast("double").alias("f"), (F.col("l_tax") * 10).cast("double").alias("c"), (F.col("l_quantity") / 50).cast("double").alias("r")), "f", "c", "r", 0.35, 0.2).select("l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem, one WHERE abs(CAST(l_discount * 10 AS DOUBLE) - CAST(l_tax * 10 AS DOUBLE)) > 0.35 AND CAST(l_quantity / 50 AS DOUBLE) > 0.2", "one AS (SELECT 1)")

# --- tables written in a text format and read again


def _fasta(s, d):
    path = folder(s)
    T.write_fasta(reads(s, d).where("seq <> ''").withColumn("name", F.col("rowid").cast("string")), path, 60)
    return T.read_fasta(s, path).select(F.col("name").cast("bigint").alias("rowid"), "seq")


def _fastq(s, d):
    """The format has no place for the line breaks that some stored sequences hold."""
    path = folder(s)
    T.write_fastq(scored(s, d).where(r"seq rlike '^\\S+$'").withColumn("name", F.col("rowid").cast("string")), path)
    return T.read_fastq(s, path).select(F.col("name").cast("bigint").alias("rowid"), "seq", F.array_join("qual", ",").alias("qual"))


def _bed(s, d):
    path = folder(s)
    T.write_bed(regions(s, d), path)
    return T.read_bed(s, path).select("chrom", "start", "end", "name", F.col("score").cast("double").alias("score"), "strand")


def _names_and_lines(s, d):
    path = folder(s)
    T.write_named_lines(reads(s, d).where("seq <> ''").withColumn("name", F.col("rowid").cast("string")), path)
    return T.read_named_lines(s, path).select(F.col("name").cast("bigint").alias("rowid"), "seq")


add("fasta_round_trip", _fasta, "SELECT rowid, seq FROM reads WHERE seq <> ''")
add("fastq_round_trip", _fastq, "SELECT rowid, seq, array_to_string(qual, ',') AS qual FROM scored WHERE regexp_full_match(seq, '\\S+')", SCORED)
add("bed_round_trip", _bed, 'SELECT chrom, "start", "end", name, score, strand FROM regions', REGIONS)
add("named_lines_round_trip", _names_and_lines, "SELECT rowid, seq FROM reads WHERE seq <> ''")


def _streamed(s, d):
    """Events that arrive in several files, counted by a stream until all have come."""
    path = folder(s)
    events = table(s, d, "events").where("ts is not null").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartitionByRange(4, "ts").write.parquet(f"{path}/in")
    stream = W.read_stream(s, f"{path}/in", "event_id bigint, ts timestamp, event_type string, value double", 1)
    W.run_to_end(W.windowed(stream, "ts", ["event_type"], "value", size="1 hour"), f"{path}/out", f"{path}/state")
    return s.read.parquet(f"{path}/out").select(F.unix_seconds("start").alias("start"), "event_type", "n", "total")


add("streamed_windows", _streamed, "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, sum(value) AS total FROM events, one WHERE ts IS NOT NULL GROUP BY 1, 2", "one AS (SELECT 1)")
