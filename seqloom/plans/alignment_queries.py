"""Queries of alignments, pileups, networks and clusters, on alignments made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import align as A
from seqloom.operators import kmers as K
from seqloom.operators import networks as N
from seqloom.operators import pileup as P
from seqloom.operators import reads as R
from seqloom.plans.common import READS, reads, refs
from seqloom.runtime import table, written

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes or ALNS}{sql}" if sql.startswith(",") else f"WITH {ctes or ALNS} {sql}"


def alignments(s, d):
    """Reads with a quality, placed by their id: 5 letters clipped, 20 matched, 2 deleted, the rest matched."""
    t = table(s, d, "seq_reads").where("seq is not null and qual is not null and size(qual) = length(seq) and length(seq) >= 60")
    r = F.col("rowid")
    return t.select(F.concat(F.lit("a"), r).alias("name"), F.concat(F.lit("c"), r % 4).alias("chrom"), (r * 7 % 500).cast("bigint").alias("pos"), F.concat(F.lit("5S20M2D"), F.length("seq") - 25, F.lit("M")).alias("cigar"), F.upper("seq").alias("seq"), "qual", (r % 60).cast("int").alias("mapq"), (r % 3 == 0).alias("reverse"), (r % 11 != 0).alias("primary"), (r % 13 != 0).alias("mapped"), F.concat(F.lit("c"), r % 5).alias("mate_chrom"), (r % 17 != 0).alias("mate_mapped"), (r % 300 - 150).cast("int").alias("insert_size"), "rowid")


ALNS = """alns AS (SELECT 'a' || rowid AS name, 'c' || (rowid % 4) AS chrom, rowid * 7 % 500 AS pos, upper(seq) AS seq, qual, rowid % 60 AS mapq, rowid % 3 = 0 AS reverse, rowid % 11 <> 0 AS "primary", rowid % 13 <> 0 AS mapped, 'c' || (rowid % 5) AS mate_chrom, rowid % 17 <> 0 AS mate_mapped, rowid % 300 - 150 AS insert_size, rowid, length(seq) - 25 AS rest
FROM seq_reads WHERE seq IS NOT NULL AND qual IS NOT NULL AND len(qual) = length(seq) AND length(seq) >= 60)"""
PILE = """, cell AS (SELECT chrom, reverse, pos + i AS pos, substr(seq, CAST(i + 6 AS INTEGER), 1) AS base, qual[i + 6] >= 20 AS hq FROM (SELECT *, unnest(range(0, 20)) AS i FROM alns WHERE mapped AND "primary" AND mapq >= 10)
UNION ALL SELECT chrom, reverse, pos + 20 + i, 'D', true FROM (SELECT *, unnest(range(0, 2)) AS i FROM alns WHERE mapped AND "primary" AND mapq >= 10)
UNION ALL SELECT chrom, reverse, pos + 22 + i, substr(seq, CAST(i + 26 AS INTEGER), 1), qual[i + 26] >= 20 FROM (SELECT *, unnest(range(0, rest)) AS i FROM alns WHERE mapped AND "primary" AND mapq >= 10)),
pile AS (SELECT chrom, pos, CASE WHEN reverse THEN '-' ELSE '+' END AS strand, hq, base, count(*) AS n FROM cell GROUP BY ALL)"""


def _pile(s, d):
    return P.pileup(alignments(s, d), 20, 10)


def _pile_and_ref(s, d):
    """The pileup, written once as it is read three times, and the commonest letters as the reference."""
    piles = written(_pile(s, d), "pileup")
    return piles, piles.where("base in ('A', 'C', 'G', 'T')").groupBy("chrom", "pos", "base").agg(F.sum("n").alias("n")).groupBy("chrom", "pos").agg(F.min(F.struct((-F.col("n")).alias("o"), "base")).alias("b")).select("chrom", "pos", F.col("b.base").alias("ref"))


def _ref(s, d):
    return _pile_and_ref(s, d)[1]


REF = PILE + ", ref AS (SELECT chrom, pos, base AS ref FROM pile WHERE base IN ('A', 'C', 'G', 'T') GROUP BY chrom, pos, base QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY sum(n) DESC, base) = 1)"
add("pileup", _pile, PILE + " SELECT chrom, pos, strand, hq, base, n FROM pile")
add("pileup_depth", lambda s, d: P.depth_summary(_pile(s, d)), PILE + ", t AS (SELECT chrom, pos, sum(n) AS depth FROM pile GROUP BY ALL) SELECT chrom, min(depth)::BIGINT AS min, max(depth)::BIGINT AS max, avg(depth) AS mean, quantile_cont(depth, 0.5)::DOUBLE AS median, stddev_samp(depth) AS sd, count(*) AS positions FROM t GROUP BY chrom")
_VAR = REF + """, h AS (SELECT * FROM pile WHERE hq AND base IN ('A', 'C', 'G', 'T', 'N', 'D')), t AS (SELECT chrom, pos, sum(n) AS depth FROM h GROUP BY ALL), o AS (SELECT chrom, pos, base AS alt, sum(n) AS n, coalesce(sum(n) FILTER (strand = '+'), 0) AS f FROM h GROUP BY ALL),
v AS (SELECT chrom, pos, ref, alt, n::BIGINT AS n, depth::BIGINT AS depth, n / depth AS fraction, f / n AS forward FROM o JOIN t USING (chrom, pos) JOIN ref USING (chrom, pos) WHERE alt <> ref AND alt <> 'N' AND depth > 10 AND n / depth > 0.05 AND f / n > 0.2 AND f / n < 0.8)"""
add("variants", lambda s, d: P.variants(*_pile_and_ref(s, d), 10, 0.05, 0.2), _VAR + " SELECT * FROM v")
add("variants_biallelic", lambda s, d: P.variants(*_pile_and_ref(s, d), 10, 0.05, 0.2, biallelic=True), _VAR + " SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY chrom, pos) = 1")


def _places(s, d):
    return s.createDataFrame([("p1", "c0", 10, 60), ("p2", "c1", 480, 520), ("p3", "c9", 0, 5)], "name string, chrom string, start long, end long")


_PL = ", pl AS (SELECT * FROM (VALUES ('p1', 'c0', 10, 60), ('p2', 'c1', 480, 520), ('p3', 'c9', 0, 5)) t(name, chrom, a, b)), spot AS (SELECT name, chrom, unnest(range(a, b)) AS pos FROM pl)"
add("pileup_at_places", lambda s, d: P.at_places(_pile(s, d), _places(s, d)), PILE + _PL + " SELECT name, chrom, pos, " + ", ".join(f"coalesce(sum(n) FILTER (base = '{b}'), 0)::BIGINT AS {b}" for b in "ACGTN") + " FROM spot LEFT JOIN pile USING (chrom, pos) GROUP BY ALL")
add("coverage_at_places", lambda s, d: P.place_coverage(_pile(s, d), _places(s, d)), PILE + _PL + ", t AS (SELECT chrom, pos, sum(n) AS depth FROM pile GROUP BY ALL) SELECT name, min(depth)::BIGINT AS min, max(depth)::BIGINT AS max, avg(depth) AS mean, quantile_cont(depth, 0.5)::DOUBLE AS median FROM spot JOIN t USING (chrom, pos) GROUP BY name")
add("alignments_to_bed", lambda s, d: P.to_bed(alignments(s, d)).select("name", "chrom", "start", "end", "strand"), """SELECT name, chrom, pos AS start, pos + 22 + rest AS "end", CASE WHEN reverse THEN '-' ELSE '+' END AS strand FROM alns WHERE mapped""")
add("read_profile", lambda s, d: P.read_profile(alignments(s, d), 20), "SELECT chrom, pos, CAST(size AS INTEGER) AS size, count(*) AS n, avg((NOT reverse)::INT) AS forward FROM (SELECT *, 22 + rest AS size FROM alns WHERE mapped AND mapq > 20) GROUP BY GROUPING SETS ((chrom), (chrom, pos), (chrom, size))")
add("insert_sizes", lambda s, d: P.insert_sizes(alignments(s, d)), "SELECT CAST(abs(insert_size) AS INTEGER) AS size, count(*) AS n FROM alns WHERE mapped AND mate_mapped GROUP BY 1")
add("mate_status", lambda s, d: P.mate_status(alignments(s, d)), "SELECT mapped AND mate_mapped AND chrom = mate_chrom AS concordant, mapped, mate_mapped, count(*) AS n FROM alns GROUP BY ALL")
add("soft_clips", lambda s, d: P.soft_clips(alignments(s, d)).select("name", "left_clip", "right_clip"), "SELECT name, 5 AS left_clip, 0 AS right_clip FROM alns WHERE mapped")
add("flag_statistics", lambda s, d: P.flag_statistics(alignments(s, d)), 'SELECT count(*) AS total, count(*) FILTER (mapped) AS mapped, count(*) FILTER (NOT "primary") AS secondary, count(*) FILTER (mapped AND mate_mapped) AS both_mapped, count(*) FILTER (mapped AND mate_mapped AND chrom <> mate_chrom) AS mates_apart FROM alns')
add("error_profile", lambda s, d: P.error_profile(alignments(s, d), _ref(s, d)), None)


def _haplotypes(s, d):
    return R.collapsed(refs(s, d).withColumn("cnt", F.lit(1.0))).select("rowid", "seq", "cnt", F.concat(F.lit("h"), "rowid").alias("name"))


def _edges(s, d):
    return A.compared(_haplotypes(s, d), None, 16, 0.02)


add("compare_all_by_all", _edges)
add("map_reads", lambda s, d: A.best_matches(reads(s, d), refs(s, d), 16, 0.3, ties="first").select("id_a", "id_b", "identity", "mismatches"))
add("compare_to_reference", lambda s, d: A.best_matches(reads(s, d), refs(s, d), 16, 0.3, ties="all").select("id_a", "id_b", "identity", "mismatches"))
add("trim_to_reference", lambda s, d: A.trimmed_to_reference(reads(s, d), refs(s, d), k=20))
add("single_linkage", lambda s, d: N.linked(_haplotypes(s, d), _edges(s, d).where("identity >= 0.97")))
add("connected_groups", lambda s, d: N.components(_sample_edges(s, d)), f", e AS (SELECT rowid AS a, r AS b FROM (SELECT rowid, min(rowid) OVER (PARTITION BY sample) AS r FROM reads WHERE sample IS NOT NULL) WHERE rowid <> r) SELECT a AS node, b AS component FROM e UNION SELECT b, b FROM e", READS)


def _sample_edges(s, d):
    """A chain through the reads of each sample, in the order of their ids."""
    from pyspark.sql import Window

    order = Window.partitionBy("sample").orderBy("rowid")
    return reads(s, d).where("sample is not null").select("rowid", F.lag("rowid").over(order).alias("before")).where("before is not null").select(F.col("rowid").alias("id_a"), F.col("before").alias("id_b"))


add("minimum_tree", lambda s, d: N.minimum_tree(_sample_edges(s, d).withColumn("distance", F.col("id_a") - F.col("id_b"))), ", e AS (SELECT rowid AS id_a, lag(rowid) OVER (PARTITION BY sample ORDER BY rowid) AS id_b FROM reads WHERE sample IS NOT NULL) SELECT id_a, id_b, id_a - id_b AS distance FROM e WHERE id_b IS NOT NULL", READS)
add("greedy_clusters", lambda s, d: N.greedy_clusters(reads(s, d), K.similarities(reads(s, d), 24, least=0.5)))
add("haplotype_network", lambda s, d: N.nearest_events(_edges(s, d)))
add("collapse_tandems", lambda s, d: N.tandems_collapsed(reads(s, d), K.similarities(reads(s, d), 24, least=0.5)))
add("mark_chimeras", lambda s, d: N.chimeras(reads(s, d)), ", x AS (SELECT rowid AS n, cnt, left(seq, 30) AS f, right(seq, 30) AS b FROM reads WHERE length(seq) >= 60), p AS (SELECT f, n AS pn, cnt AS pc FROM x QUALIFY row_number() OVER (PARTITION BY f ORDER BY cnt DESC, n) = 1), q AS (SELECT b, n AS qn, cnt AS qc FROM x QUALIFY row_number() OVER (PARTITION BY b ORDER BY cnt DESC, n) = 1) SELECT n AS rowid, pn AS front_parent, qn AS back_parent FROM x JOIN p USING (f) JOIN q USING (b) WHERE pc >= 2 * cnt AND qc >= 2 * cnt AND pn <> qn", READS)
