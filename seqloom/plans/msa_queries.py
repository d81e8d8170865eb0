"""Queries of operators over aligned sequences, per-position alignment counts and further tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import align as A
from seqloom.operators import features as G
from seqloom.operators import info as I
from seqloom.operators import intervals as V
from seqloom.operators import kmers as K
from seqloom.operators import msa as X
from seqloom.operators import pileup as P
from seqloom.plans.alignment_queries import ALNS, alignments
from seqloom.plans.common import BOTH_REGIONS, READS, REFS, reads, refs, regions, targets
from seqloom.plans.info_queries import ENDS, ends
from seqloom.plans.table_queries import FEATURES, features

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=ENDS):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


_CONS = ", v AS (SELECT position, base, row_number() OVER (PARTITION BY position ORDER BY sum(cnt) DESC, base) AS k FROM cols GROUP BY position, base), r AS (SELECT CAST(0 AS BIGINT) AS ref_id, position, base AS rb FROM v WHERE k = 1)"
_SCORE = ", s0 AS (SELECT CAST(position AS INTEGER) AS position, base, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY position) AS f FROM cols GROUP BY position, base), score AS (SELECT position, arg_min(base, (-n, base)) AS top, max(f) AS score, coalesce(sum(f) FILTER (base = '-'), 0.0) AS gaps FROM s0 GROUP BY position)"
add("alignment_column_scores", lambda s, d: X.column_scores(ends(s, d)), _SCORE + " SELECT * FROM score")
_STREAK = _SCORE + ", i AS (SELECT position, position - row_number() OVER (ORDER BY position) AS g FROM score WHERE score >= 0.27 AND top <> '-'), k AS (SELECT CAST(min(position) AS INTEGER) AS start, CAST(max(position) + 1 AS INTEGER) AS \"end\" FROM i GROUP BY g HAVING count(*) >= 2)"
add("alignment_streaks", lambda s, d: X.streaks(ends(s, d), 0.27, 2), _STREAK + " SELECT * FROM k")
add("trim_to_alignment_streaks", lambda s, d: X.trimmed_to_streaks(ends(s, d), 0.27, 2).select("rowid", "seq", "on"), _STREAK + ', e AS (SELECT min(start) AS a, max("end") AS b FROM k) SELECT rowid, CASE WHEN a IS NULL THEN seq ELSE substr(seq, a + 1, b - a) END AS seq, a IS NOT NULL AS "on" FROM ends, e')
add("trim_to_core", lambda s, d: X.trimmed_to_core(_gapped(s, d)).select("rowid", "seq"), ", g AS (SELECT rowid, repeat('-', CAST(rowid % 4 AS INTEGER)) || seq || repeat('-', CAST(3 - rowid % 4 AS INTEGER)) AS seq FROM ends), e AS (SELECT max(length(seq) - length(ltrim(seq, '-'))) AS a, min(length(rtrim(seq, '-'))) AS b FROM g) SELECT rowid, CASE WHEN b > a THEN replace(substr(seq, a + 1, b - a), '-', '') ELSE '' END AS seq FROM g, e")
add("alignment_agreement", lambda s, d: X.agreement(ends(s, d), _consensus(s, d)), _CONS + " SELECT rowid, ref_id, CAST(position AS INTEGER) AS position, (base = rb)::INT AS same FROM cols JOIN r USING (position)")
add("alignment_agreement_segments", lambda s, d: X.agreement_segments(ends(s, d), _consensus(s, d), 5), _CONS + ", a AS (SELECT rowid, ref_id, position, position - row_number() OVER (PARTITION BY rowid, ref_id ORDER BY position) AS g FROM cols JOIN r USING (position) WHERE base = rb) SELECT rowid, ref_id, CAST(min(position) AS INTEGER) AS start, CAST(max(position) + 1 AS INTEGER) AS \"end\" FROM a GROUP BY rowid, ref_id, g HAVING count(*) >= 5")
add("alignment_outliers", lambda s, d: X.outlier_scores(ends(s, d), refs(s, d)), f", {REFS}, p AS (SELECT position, base, count(*) / sum(count(*)) OVER (PARTITION BY position) AS f FROM (SELECT i - 1 AS position, substr(seq, i, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM refs)) GROUP BY position, base) SELECT rowid, avg(coalesce(f, 0)) AS score FROM cols LEFT JOIN p USING (position, base) GROUP BY rowid")
add("alignment_real_positions", lambda s, d: X.real_positions(_gapped(s, d)), ", g AS (SELECT rowid, repeat('-', CAST(rowid % 4 AS INTEGER)) || seq || repeat('-', CAST(3 - rowid % 4 AS INTEGER)) AS seq FROM ends), c AS (SELECT rowid, i, substr(seq, i, 1) AS base FROM (SELECT rowid, seq, unnest(range(1, length(seq) + 1)) AS i FROM g)) SELECT rowid, CAST(i - 1 AS INTEGER) AS \"column\", CASE WHEN base <> '-' THEN CAST(sum((base <> '-')::INT) OVER (PARTITION BY rowid ORDER BY i) - 1 AS INTEGER) END AS position FROM c")
add("hamming_graph", lambda s, d: X.hamming_pairs(reads(s, d), 2), ", v AS (SELECT DISTINCT seq AS v FROM reads), p AS (SELECT a.v AS a, b.v AS b FROM v a JOIN v b ON length(a.v) = length(b.v) AND a.v < b.v) SELECT a, b, CAST(hamming(a, b) AS INTEGER) AS distance FROM p WHERE a <> '' AND hamming(a, b) <= 2", READS)
add("table_count_to_reads", lambda s, d: reads(s, d).where("sample is not null").groupBy("sample").agg(F.count("*").alias("cnt")), "SELECT sample, count(*) AS cnt FROM reads WHERE sample IS NOT NULL GROUP BY sample", READS)


def _gapped(s, d):
    return ends(s, d).withColumn("seq", F.concat(F.expr("repeat('-', int(rowid % 4))"), "seq", F.expr("repeat('-', int(3 - rowid % 4))")))


def _consensus(s, d):
    """The reference of the alignment: its consensus."""
    return I.consensus(ends(s, d)).select(F.lit(0).cast("bigint").alias("rowid"), "seq")


def _places(s, d):
    return s.createDataFrame([("p1", "c0", 10, 60), ("p2", "c1", 480, 520), ("p3", "c9", 0, 5)], "name string, chrom string, start long, end long")


_PL = ", pl AS (SELECT * FROM (VALUES ('p1', 'c0', 10, 60), ('p2', 'c1', 480, 520), ('p3', 'c9', 0, 5)) t(name, chrom, a, b)), hit AS (SELECT pl.name, pl.chrom, a, b, alns.* EXCLUDE (name, chrom), pos + 22 + rest AS e FROM pl JOIN alns ON mapped AND pl.chrom = alns.chrom AND pos < b AND a < pos + 22 + rest)"
_PER = _PL + ", spot AS (SELECT name, chrom, unnest(range(a, b)) AS pos FROM pl), c AS (SELECT name, chrom, p AS pos, CAST({} AS VARCHAR) AS value, count(*) AS n FROM (SELECT *, unnest(range(greatest(a, pos), least(b, e))) AS p FROM hit) GROUP BY ALL) SELECT name, chrom, pos, value, coalesce(n, 0) AS n FROM spot LEFT JOIN c USING (name, chrom, pos)"
add("map_quality_by_position", lambda s, d: P.per_position(alignments(s, d), _places(s, d), "mapq"), _PER.format("mapq"), ALNS)
add("insert_size_by_position", lambda s, d: P.per_position(alignments(s, d), _places(s, d), "insert_size"), _PER.format("insert_size"), ALNS)
add("mate_status_by_position", lambda s, d: P.per_position(alignments(s, d), _places(s, d), "mate_mapped"), _PER.format("mate_mapped"), ALNS)
add("pair_statistics", lambda s, d: P.pair_statistics(alignments(s, d), _places(s, d), 100), _PL + ", k AS (SELECT name, CASE WHEN NOT mate_mapped THEN 'u' WHEN chrom <> mate_chrom OR abs(insert_size) > 100 THEN 'd' ELSE 'p' END AS kind FROM hit) SELECT pl.name, count(kind) AS total, count(*) FILTER (kind = 'p') AS proper, count(*) FILTER (kind = 'u') AS mate_unmapped, count(*) FILTER (kind = 'd') AS discordant FROM pl LEFT JOIN k ON pl.name = k.name GROUP BY pl.name", ALNS)
add("alignments_sorted", lambda s, d: P.is_sorted(alignments(s, d)), "SELECT false AS sorted", ALNS)
add("alignments_off_chromosomes", lambda s, d: P.flag_chromosomes(alignments(s, d), ["c1", "c2"]).select("name", "include"), "SELECT name, chrom NOT IN ('c1', 'c2') AS include FROM alns", ALNS)
add("pairs_to_reads", lambda s, d: P.paired(alignments(s, d).withColumn("name", F.concat(F.lit("p"), F.floor(F.col("rowid") / 2)))).select("name", F.length("seq_1").alias("first"), F.length("seq_2").alias("second")), """, p AS (SELECT 'p' || (rowid // 2) AS name, rowid, rest + 25 AS n FROM alns WHERE "primary") SELECT name, CAST(arg_min(n, rowid) AS INTEGER) AS first, CASE WHEN count(*) > 1 THEN CAST(arg_max(n, rowid) AS INTEGER) END AS second FROM p GROUP BY name""", ALNS)
add("mate_distances", lambda s, d: P.mate_distances(alignments(s, d).withColumn("name", F.col("rowid") % 1500)), "SELECT distance, count(*) AS n FROM (SELECT max(rowid) - min(rowid) AS distance FROM alns GROUP BY rowid % 1500 HAVING count(*) = 2) GROUP BY distance", ALNS)
add("primer_arms", lambda s, d: V.spanning(regions(s, d), targets(s, d), 101, 499).select("chrom", "name_a", "name_b", "length"), """SELECT r.chrom, r.name AS name_a, t.name AS name_b, t."end" - r."start" AS length FROM regions r JOIN targets t ON r.chrom = t.chrom AND t."start" >= r."start" AND t."end" - r."start" BETWEEN 101 AND 499 AND r.strand <> t.strand""", BOTH_REGIONS)
add("non_unique_arms", lambda s, d: regions(s, d).groupBy("name", "strand").agg(F.count("*").alias("n")).where("n >= 2"), "SELECT name, strand, count(*) AS n FROM regions GROUP BY ALL HAVING count(*) >= 2", BOTH_REGIONS)
add("stitch_pairs", lambda s, d: A.stitched(reads(s, d).where("length(seq) >= 60").select("rowid", F.expr("substring(seq, 1, length(seq) - 20)").alias("r1"), F.expr("substring(seq, 26)").alias("r2")), 15, 0.0).select("rowid", "seq", "status"), ", m AS (SELECT rowid, substr(seq, 1, length(seq) - 20) AS a, substr(seq, 26) AS b FROM reads WHERE length(seq) >= 60), o AS (SELECT *, list_filter(range(least(length(a), length(b)), 14, -1), lambda k: right(a, k) = left(b, k))[1] AS k FROM m) SELECT rowid, CASE WHEN k IS NOT NULL THEN a || substr(b, k + 1) END AS seq, CASE WHEN k IS NULL THEN 'no_overlap' ELSE 'joined' END AS status FROM o", READS)
add("kmer_counts_in_both", lambda s, d: K.counts_in_both(reads(s, d), refs(s, d), 9), ", a AS (SELECT substr(seq, i, 9) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 7)) AS i FROM reads WHERE length(seq) >= 9) GROUP BY 1), b AS (SELECT substr(seq, i, 9) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(1, length(seq) - 7)) AS i FROM refs WHERE length(seq) >= 9) GROUP BY 1) SELECT coalesce(a.kmer, b.kmer) AS kmer, coalesce(a.n, 0) AS in_reads, coalesce(b.n, 0) AS in_regions FROM a FULL JOIN b ON a.kmer = b.kmer", f"{READS}, {REFS}")
add("transcript_positions", lambda s, d: G.position_table(features(s, d).withColumn("strand", F.lit("+"))), ", p AS (SELECT DISTINCT parent, seqid AS chrom, \"start\" - 1 AS a, \"end\" AS b FROM feat WHERE type = 'CDS'), q AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY parent ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM p) SELECT parent, bef + k AS cdna_pos, chrom, a + k AS pos, '+' AS strand FROM (SELECT *, unnest(range(0, b - a)) AS k FROM q)", FEATURES)
add("called_variants", lambda s, d: A.called_variants(reads(s, d), refs(s, d), 2.0, 0.005, k=16))
add("call_variants_by_sample", lambda s, d: A.called_variants(reads(s, d).where("sample is not null"), refs(s, d), 2.0, 0.005, "sample", k=16))
add("called_variants_in_region", lambda s, d: A.called_variants(reads(s, d), refs(s, d), 2.0, 0.005, k=16).where("position >= 20 and position < 120"))
