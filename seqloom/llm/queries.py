"""Queries of the corpus operators and, where SQL can express them on whole tables, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.llm import chop, near, pack, passages, reading, spans, tokens
from seqloom.runtime import table


def p1_pieces(spark, d):
    return chop.pieces(table(spark, d, "genome"), table(spark, d, "chop_pars"), with_text=True)


def p1_found(spark, d):
    return chop.pieces(table(spark, d, "genome"), table(spark, d, "chop_pars")).where("piece = 0").select("pars_id", "chrom")


def _sequences(spark, d):
    refs = table(spark, d, "ref_seqs").select("rowid", F.col("ref_seq").alias("seq"))
    return table(spark, d, "seq_reads").select("rowid", "seq").unionByName(refs)


def p3_found(spark, d):
    return spans.shared_spans(_sequences(spark, d))


def p3_passages(spark, d):
    return passages.passages(_sequences(spark, d))


def _reads_and_mutants(spark, d):
    return table(spark, d, "seq_reads").select("rowid", "seq").unionByName(table(spark, d, "mutants").select("rowid", "seq"))


def p4_found(spark, d):
    return near.similar_pairs(_reads_and_mutants(spark, d))


def p4_groups(spark, d):
    return near.groups(_reads_and_mutants(spark, d))


def p6_ids(spark, d):
    return tokens.encoded(table(spark, d, "documents"))


def p6_round_trip(spark, d):
    """Documents whose ids don't decode to their text: none."""
    docs = table(spark, d, "documents")
    back = tokens.back_to_text(tokens.encoded(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where(F.coalesce("text", F.lit("")) != F.col("back")).select("doc_id")


def p7_packed(spark, d):
    return pack.packed(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_limits(spark, d):
    """All three limits bind: at most 32 documents a container, and at most 3 of 4 tokens loss-bearing."""
    return pack.packed(table(spark, d, "documents"), table(spark, d, "pack_specs"), segments=32, loss_share=0.75)


def p7_unused(spark, d):
    specs = table(spark, d, "pack_specs")
    return pack.containers(pack.packed(table(spark, d, "documents"), specs), specs)


def p7_broken(spark, d):
    """Containers that break a limit: none."""
    specs = table(spark, d, "pack_specs")
    every = pack.packed(table(spark, d, "documents"), specs, segments=32, loss_share=0.75)
    return pack.broken(every, specs, 32, 0.75).unionByName(pack.broken(p7_packed(spark, d), specs))


def p8_levels(spark, d):
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_found(spark, d):
    docs = table(spark, d, "documents").where(F.lower("lang").startswith("en"))
    return reading.reading_levels(docs, table(spark, d, "reading_labels")).where("level >= 3.5").select("doc_id")


QUERIES = {q.__name__: q for q in (p1_found, p1_pieces, p3_found, p3_passages, p4_found, p4_groups, p6_ids, p6_round_trip, p7_packed, p7_limits, p7_unused, p7_broken, p8_found, p8_levels)}
SQL = {
    "p1_found": """SELECT p.pars_id, g.chrom FROM chop_pars p JOIN genome g ON p.genome_fnp = g.genome_fnp
WHERE length(regexp_replace(g.seq, '[^A-Za-z]', '', 'g')) > coalesce(p.window_length, 100)""",
    "p1_pieces": """WITH RECURSIVE u AS (SELECT genome_fnp, chrom, s, upper(s) AS t, length(s) AS n FROM (SELECT genome_fnp, chrom, regexp_replace(seq, '[^A-Za-z]', '', 'g') AS s FROM genome WHERE genome_fnp IS NOT NULL AND seq IS NOT NULL)),
nat AS (SELECT chrom, list(e ORDER BY e) AS nat FROM (SELECT chrom, t, unnest(range(1, n)) AS e FROM u) WHERE t[e] = 'N' AND (t[e + 1] = 'N' OR e = 1 OR t[e - 1] <> 'N') GROUP BY chrom),
job AS (SELECT pars_id, chrom, s, n, coalesce(nat, []) AS nat, lim, least(greatest(0, lim - step), lim - 1) AS overlap FROM (SELECT pars_id, genome_fnp, coalesce(window_length, 100) AS raw, greatest(1, coalesce(window_length, 100)) AS lim, coalesce(window_step, 10) AS step FROM chop_pars) JOIN u USING (genome_fnp) LEFT JOIN nat USING (chrom) WHERE n > raw),
cut AS (SELECT pars_id, chrom, 0 AS piece, 0::BIGINT AS st, CASE WHEN lim >= n THEN n ELSE coalesce(list_last(list_filter(nat, lambda x: x > overlap AND x <= lim)), lim) END AS en FROM job
UNION ALL SELECT pars_id, chrom, piece + 1, en - overlap, CASE WHEN en - overlap + lim >= n THEN n ELSE coalesce(list_last(list_filter(nat, lambda x: x > en AND x <= en - overlap + lim)), en - overlap + lim) END FROM cut JOIN job USING (pars_id, chrom) WHERE en < n)
SELECT pars_id, chrom, piece, st AS start, en AS "end", en < n AND upper(s[en]) = 'N' AS at_n, substr(s, st + 1, en - st) AS text FROM cut JOIN job USING (pars_id, chrom)""",
    "p3_found": r"""WITH recs AS (SELECT rowid, upper(regexp_replace(s, '[-\s]', '', 'g')) AS s FROM (SELECT rowid, seq AS s FROM seq_reads UNION ALL SELECT rowid, ref_seq FROM ref_seqs)),
w AS (SELECT rowid, i, substr(s, i, 64) AS k FROM (SELECT rowid, s, unnest(range(1, length(s) - 62)) AS i FROM recs WHERE length(s) >= 64)),
shared AS (SELECT k FROM w GROUP BY k HAVING count(DISTINCT rowid) > 1),
hits AS (SELECT rowid, i, lag(i) OVER (PARTITION BY rowid ORDER BY i) AS p FROM w SEMI JOIN shared USING (k))
SELECT rowid, CAST(sum(CASE WHEN p IS NULL THEN 64 ELSE least(64, i - p) END) AS INTEGER) AS shared_letters FROM hits GROUP BY rowid""",
    "p4_found": r"""WITH recs AS (SELECT rowid, upper(regexp_replace(s, '[-\s]', '', 'g')) AS s FROM (SELECT rowid, seq AS s FROM seq_reads UNION ALL SELECT rowid, seq FROM mutants)),
grams AS (SELECT rowid, length(s) - 9 AS n, substr(s, i, 10) AS k FROM (SELECT rowid, s, unnest(range(1, length(s) - 8)) AS i FROM recs WHERE length(s) >= 10)),
counts AS (SELECT rowid, n, k, count(*) AS c FROM grams GROUP BY ALL)
SELECT a.rowid AS rowid_a, b.rowid AS rowid_b FROM counts a JOIN counts b ON a.k = b.k AND a.rowid < b.rowid
GROUP BY a.rowid, b.rowid, a.n, b.n HAVING 10 * sum(least(a.c, b.c)) >= 7 * greatest(a.n, b.n)""",
    "p7_broken": "SELECT spec_id, CAST(NULL AS BIGINT) AS container FROM pack_specs WHERE false",
    "p4_groups": r"""WITH RECURSIVE recs AS (SELECT rowid, s, min(rowid) OVER (PARTITION BY s) AS rep, length(s) - 9 AS n FROM (SELECT rowid, upper(regexp_replace(s, '[-\s]', '', 'g')) AS s FROM (SELECT rowid, seq AS s FROM seq_reads UNION ALL SELECT rowid, seq FROM mutants)) WHERE length(s) >= 10),
counts AS (SELECT rowid, n, k, count(*) AS c FROM (SELECT rowid, n, substr(s, unnest(range(1, n + 1)), 10) AS k FROM recs WHERE rowid = rep) GROUP BY ALL),
link AS (SELECT a.rowid AS a, b.rowid AS b FROM counts a JOIN counts b ON a.k = b.k AND a.rowid <> b.rowid GROUP BY a.rowid, b.rowid, a.n, b.n HAVING 10 * sum(least(a.c, b.c)) >= 7 * greatest(a.n, b.n)),
reach AS (SELECT rowid AS node, rowid AS other FROM recs WHERE rowid = rep UNION SELECT reach.node, link.b FROM reach JOIN link ON link.a = reach.other),
part AS (SELECT node, min(other) AS group_id FROM reach GROUP BY node)
SELECT rowid, group_id, (SELECT count(*) FROM link WHERE link.a = rep) AS links FROM recs JOIN part ON node = rep""",
    "p6_round_trip": "SELECT doc_id FROM documents WHERE false",
}
