"""Queries of counts, summaries and diversity measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import info as I
from seqloom.plans.common import READS, REFS, SCORED, reads, refs, scored

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=READS):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


def ends(spark, d):
    """Whole reads, aligned at their starts, for the column operators."""
    return reads(spark, d).where("seq <> ''")


ENDS = READS + ", ends AS (SELECT rowid, seq, cnt FROM reads WHERE seq <> ''), cols AS (SELECT rowid, cnt, i - 1 AS position, substr(seq, i, 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS i FROM ends))"
_SUM = "count({0}) AS n, min({0}) AS min, max({0}) AS max, avg({0}) AS mean, quantile_cont({0}, 0.5) AS median, stddev_samp({0}) AS sd, sum({0}) AS sum"

add("count_seqs", lambda s, d: reads(s, d).agg(F.count("*").alias("n"), F.sum("cnt").alias("cnt")), "SELECT count(*) AS n, sum(cnt) AS cnt FROM reads")
add("count_all_seqs", lambda s, d: reads(s, d).rollup("sample").agg(F.count("*").alias("n"), F.grouping("sample").cast("int").alias("total")), "SELECT sample, count(*) AS n, CAST(grouping(sample) AS INTEGER) AS total FROM reads GROUP BY ROLLUP (sample)")
add("print_names", lambda s, d: reads(s, d).select("rowid", "name"), "SELECT rowid, name FROM reads")
add("print_seqs", lambda s, d: reads(s, d).select("rowid", "seq"), "SELECT rowid, seq FROM reads")
add("read_lengths", lambda s, d: reads(s, d).select("rowid", "name", F.length("seq").alias("length")), "SELECT rowid, name, length(seq) AS length FROM reads")
add("gc_content", lambda s, d: reads(s, d).select("rowid", S.gc_fraction(F.col("seq")).alias("gc")), "SELECT rowid, len(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(len(regexp_replace(seq, '[^ACGTN]', '', 'g')), 0) AS gc FROM reads")
add("length_info", lambda s, d: I.summary(reads(s, d).select(F.length("seq").alias("v")), "v"), f"SELECT {_SUM.format('v')} FROM (SELECT length(seq) AS v FROM reads)")
add("length_distribution", lambda s, d: I.length_distribution(reads(s, d)), "SELECT length(seq) AS length, sum(cnt) AS n FROM reads GROUP BY 1")
add("count_letters", lambda s, d: I.letter_counts(reads(s, d)), "SELECT letter, count(*) AS n, count(*) / sum(count(*)) OVER () AS fraction FROM (SELECT unnest(string_split(seq, '')) AS letter FROM reads WHERE seq <> '') GROUP BY letter")
for _n, _kw, _e in (("front", {}, "substr(seq, 1, 8)"), ("back", {"back": True}, "right(seq, 8)"), ("position", {"position": 20}, "substr(seq, 21, 8)")):
    _least = 28 if _n == "position" else 8
    add(f"count_portions_{_n}", lambda s, d, kw=_kw: I.portions(reads(s, d), 8, more_than=2, **kw), f"SELECT portion, n, fraction FROM (SELECT {_e} AS portion, count(*) AS n, count(*) / sum(count(*)) OVER () AS fraction FROM reads WHERE length(seq) >= {_least} GROUP BY 1) WHERE n > 2")
add("homopolymer_runs", lambda s, d: I.homopolymer_counts(reads(s, d)), ", l AS (SELECT rowid, i, substr(seq, i, 1) AS base FROM (SELECT rowid, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads)), g AS (SELECT rowid, base, i - row_number() OVER (PARTITION BY rowid, base ORDER BY i) AS k FROM l), r AS (SELECT base, CAST(count(*) AS INTEGER) AS run FROM g GROUP BY rowid, base, k) SELECT base, run, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY base) AS fraction FROM r GROUP BY base, run")
_K = "SELECT rowid, CAST(round(cnt) AS BIGINT) AS w, substr(seq, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS i FROM reads WHERE length(seq) >= {k})"
add("count_kmers", lambda s, d: I.kmer_counts(reads(s, d), 5), f"SELECT kmer, CAST(sum(w) AS BIGINT) AS n FROM ({_K.format(k=5)}) GROUP BY kmer")
add("kmer_statistics", lambda s, d: I.kmer_statistics(reads(s, d), 3), f""", k AS (SELECT kmer, CAST(sum(w) AS BIGINT) AS n, sum(w) / sum(sum(w)) OVER () AS fraction FROM ({_K.format(k=3)}) GROUP BY kmer),
l AS (SELECT letter, sum(cnt) / sum(sum(cnt)) OVER () AS p FROM (SELECT cnt, unnest(string_split(seq, '')) AS letter FROM reads WHERE seq <> '') GROUP BY letter)
SELECT kmer, n, fraction, a.p * b.p * c.p AS expected, fraction / (a.p * b.p * c.p) AS ratio FROM k JOIN l a ON a.letter = kmer[1] JOIN l b ON b.letter = kmer[2] JOIN l c ON c.letter = kmer[3]""")
_Q = "SELECT rowid, cnt, CAST(i - 1 AS INTEGER) AS position, substr(seq, i, 1) AS base, qual[i] AS quality FROM (SELECT *, unnest(range(1, len(qual) + 1)) AS i FROM scored)"
add("quality_counts", lambda s, d: I.quality_counts(scored(s, d)), f"SELECT CAST(NULL AS VARCHAR) AS base, CAST(NULL AS INTEGER) AS position, quality, sum(cnt) AS n FROM ({_Q}) GROUP BY quality", SCORED)
add("quality_counts_by_base", lambda s, d: I.quality_counts(scored(s, d), by_base=True), f"SELECT base, CAST(NULL AS INTEGER) AS position, quality, sum(cnt) AS n FROM ({_Q}) GROUP BY base, quality", SCORED)
add("quality_counts_by_position", lambda s, d: I.quality_counts(scored(s, d), by_position=True), f"SELECT CAST(NULL AS VARCHAR) AS base, position, quality, sum(cnt) AS n FROM ({_Q}) GROUP BY position, quality", SCORED)
add("quality_grouping_sets", lambda s, d: I.quality_cube(scored(s, d)), f"SELECT base, position, quality, sum(cnt) AS n, CAST(grouping(base, position) AS BIGINT) AS grouped FROM ({_Q}) GROUP BY GROUPING SETS ((base, position, quality), (base, quality), (position, quality), (quality))", SCORED)
add("quality_profile", lambda s, d: I.quality_profile(scored(s, d), 20, 25), 'SELECT CAST(floor(list_sum(qual[i + 1 : i + 20]) / 20.0) AS BIGINT) AS "window", count(*) AS n FROM (SELECT qual, unnest(range(0, len(qual) - 20)) AS i FROM scored WHERE len(qual) > 20) GROUP BY 1', SCORED)
add("quality_fraction_above", lambda s, d: I.fraction_above(scored(s, d), 25), "SELECT rowid, len(list_filter(qual, lambda q: q >= 25)) / nullif(len(qual), 0) AS fraction FROM scored", SCORED)
add("sliding_quality_means", lambda s, d: I.sliding_quality_means(scored(s, d)), "SELECT rowid, name, CAST(5 * i AS INTEGER) AS pos, list_sum(qual[5 * i + 1 : 5 * i + 10]) / 10.0 AS mean FROM (SELECT *, unnest(range(0, (len(qual) - 10) // 5 + 1)) AS i FROM scored WHERE len(qual) >= 10)", SCORED)
add("read_fractions", lambda s, d: I.read_fractions(reads(s, d)), "SELECT rowid, name, cnt, cnt / sum(cnt) OVER () AS fraction FROM reads")
add("variable_sites", lambda s, d: I.column_counts(ends(s, d), "N"), "SELECT position, base, n, fraction FROM (SELECT CAST(position AS INTEGER) AS position, base, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY position) AS fraction, count(*) OVER (PARTITION BY position) AS k FROM cols WHERE base <> 'N' GROUP BY position, base) WHERE k > 1", ENDS)
add("column_entropy", lambda s, d: I.column_entropy(ends(s, d)), ", p AS (SELECT position, count(*) / sum(count(*)) OVER (PARTITION BY position) AS f FROM cols GROUP BY position, base) SELECT CAST(position AS INTEGER) AS position, sum(-f * log2(f)) AS entropy FROM p GROUP BY position", ENDS)
add("consensus", lambda s, d: I.consensus(ends(s, d)), ", v AS (SELECT position, base, row_number() OVER (PARTITION BY position ORDER BY sum(cnt) DESC, base) AS k FROM cols GROUP BY position, base) SELECT string_agg(base, '' ORDER BY position) AS seq FROM v WHERE k = 1", ENDS)
_LETTERS = ", ".join(f"('{b}', '{c}')" for b, c in {b: c for c, b in S.IUPAC.items()}.items())
add("degenerate_string", lambda s, d: I.degenerate_string(refs(s, d)), f", sets AS (SELECT i, string_agg(DISTINCT base, '' ORDER BY base) AS b FROM (SELECT i, substr(seq, i, 1) AS base FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS i FROM refs)) WHERE base IN ('A', 'C', 'G', 'T') GROUP BY i) SELECT string_agg(l, '' ORDER BY i) AS seq FROM sets JOIN (VALUES {_LETTERS}) t(b, l) USING (b)", REFS)
add("residue_ranks", lambda s, d: I.residue_ranks(ends(s, d)), ", r AS (SELECT position, base, CAST(row_number() OVER (PARTITION BY position ORDER BY count(*), base) AS INTEGER) AS rank FROM cols GROUP BY position, base) SELECT rowid, CAST(position AS INTEGER) AS position, rank FROM cols JOIN r USING (position, base)", ENDS)
_H = ", h AS (SELECT {by} seq, sum(cnt) AS n, sum(cnt) / sum(sum(cnt)) OVER ({over}) AS fraction FROM reads {where} GROUP BY {by} seq)"
_D = "count(*) AS haplotypes, sum(n) AS reads, count(*) FILTER (n = 1) AS singlets, count(*) FILTER (n = 2) AS doublets, 1 - sum(fraction * fraction) AS he, 1 / sum(fraction * fraction) AS effective, sum(-fraction * ln(fraction)) AS entropy, exp(sum(-fraction * ln(fraction))) AS exp_entropy"
add("haplotype_information", lambda s, d: I.diversity(I.haplotypes(reads(s, d).where("cnt > 0"))), _H.format(by="", over="", where="WHERE cnt > 0") + f" SELECT {_D} FROM h")
add("haplotype_information_by_sample", lambda s, d: I.diversity(I.haplotypes(reads(s, d).where("cnt > 0"), ["sample"]), ["sample"]), _H.format(by="sample,", over="PARTITION BY sample", where="WHERE cnt > 0") + f" SELECT sample, {_D} FROM h GROUP BY sample")
_P = """, f AS (SELECT seq, substr(sample, 1, 3) AS pop, sum(cnt) AS n FROM reads WHERE sample IS NOT NULL AND cnt > 0 GROUP BY ALL), q AS (SELECT seq, pop, n / sum(n) OVER (PARTITION BY pop) AS p, sum(n) OVER (PARTITION BY pop) AS size FROM f)"""
_M = """, t AS (SELECT {g} k, harmonic, 1 - squares / k AS hs, 1 - f2 / (k * k) AS ht FROM (SELECT {g} count(*) AS k, count(*) / sum(1 / size) AS harmonic FROM (SELECT DISTINCT {g} pop, size FROM q) {by}) {j}
 (SELECT {g} sum(p * p) AS squares FROM q {by}) {u} {j} (SELECT {g} sum(f * f) AS f2 FROM (SELECT {g} seq, sum(p) AS f FROM q GROUP BY {g} seq) {by}) {u}),
e AS (SELECT *, harmonic / (harmonic - 1) * hs AS hs_est, ht + harmonic / (harmonic - 1) * hs / (harmonic * k) AS ht_est FROM t)
SELECT {g} k AS populations, hs, ht, (ht - hs) / ht AS gst, k / (k - 1) * (ht - hs) / (1 - hs) AS jost_d, hs_est, ht_est, (ht_est - hs_est) / ht_est AS gst_est, k / (k - 1) * (ht_est - hs_est) / (1 - hs_est) AS jost_d_est FROM e"""


def _pops(s, d):
    return I.haplotypes(reads(s, d).where("sample is not null and cnt > 0").withColumn("pop", F.substring("sample", 1, 3)), ["pop"])


add("differentiation", lambda s, d: I.differentiation(_pops(s, d), "pop"), _P + _M.format(g="", by="", j=",", u=""))
add("pairwise_differentiation", lambda s, d: I.pairwise_differentiation(_pops(s, d), "pop"), _P.replace(", q AS", ", q0 AS") + ", q AS (SELECT a.pop AS pop_a, b.pop AS pop_b, q0.* FROM (SELECT DISTINCT pop FROM q0) a JOIN (SELECT DISTINCT pop FROM q0) b ON a.pop < b.pop JOIN q0 ON q0.pop IN (a.pop, b.pop))" + _M.format(g="pop_a, pop_b,", by="GROUP BY pop_a, pop_b", j="JOIN", u="USING (pop_a, pop_b)"))
