"""Queries of the k-mer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import kmers as K
from seqloom.plans.common import CONTIGS, READS, REFS, contigs, reads, refs

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes or BOTH}{sql}" if sql.startswith(",") else f"WITH {ctes or BOTH} {sql}"


BOTH = f"{READS}, {REFS}"


def prof(source, k, alias="p", key="rowid"):
    return f", {alias} AS (SELECT {key} AS id, kmer, length(seq) - {k - 1} AS size, count(*) AS n FROM (SELECT {key}, seq, substr(seq, unnest(range(1, length(seq) - {k - 2})), {k}) AS kmer FROM {source} WHERE length(seq) >= {k}) GROUP BY ALL)"


SIM = "SELECT a.id AS id_a, b.id AS id_b, CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared, sum(least(a.n, b.n)) / least(a.size, b.size) AS similarity FROM {a} a JOIN {b} b ON a.kmer = b.kmer {on} GROUP BY a.id, b.id, a.size, b.size"
OWN = SIM.format(a="p", b="p", on="AND a.id > b.id")
TO_REFS = SIM.format(a="p", b="r", on="")
add("kmer_similarity_refs", lambda s, d: K.similarities(refs(s, d), 10), prof("refs", 10) + " " + OWN)
add("kmer_similarity_to_refs", lambda s, d: K.similarities(reads(s, d), 12, refs(s, d)), prof("reads", 12) + prof("refs", 12, "r") + " " + TO_REFS)
add("kmer_over_lengths", lambda s, d: K.over_lengths(refs(s, d), [8, 10, 12]).select("id_a", "id_b", "k", "similarity"), prof("refs", 8, "p8") + prof("refs", 10, "p10") + prof("refs", 12, "p12") + " " + " UNION ALL ".join(f"SELECT id_a, id_b, {k} AS k, similarity FROM ({SIM.format(a=f'p{k}', b=f'p{k}', on='AND a.id > b.id')})" for k in (8, 10, 12)))
add("kmer_decay", lambda s, d: K.decay(refs(s, d), [8, 10, 12]), prof("refs", 8, "p8") + prof("refs", 10, "p10") + prof("refs", 12, "p12") + ", e AS (" + " UNION ALL ".join(f"SELECT id_a, id_b, {k} AS k, similarity FROM ({SIM.format(a=f'p{k}', b=f'p{k}', on='AND a.id > b.id')})" for k in (8, 10, 12)) + "), f AS (SELECT id_a, id_b, coalesce(max(similarity) FILTER (k = 8), 0) AS a, coalesce(max(similarity) FILTER (k = 10), 0) AS b, coalesce(max(similarity) FILTER (k = 12), 0) AS c FROM e GROUP BY id_a, id_b) SELECT id_a, id_b, (abs(b - a) + abs(c - b)) / 2 AS decay FROM f")
_BEST = prof("reads", 12) + prof("refs", 12, "r") + f", s AS ({TO_REFS})"
add("best_kmer_reference", lambda s, d: K.best_reference(reads(s, d), refs(s, d), 12), _BEST + ", b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY similarity DESC, id_b) = 1) SELECT rowid AS id, id_b AS ref_id, similarity FROM reads LEFT JOIN b ON rowid = id_a")
add("best_kmer_reference_ties", lambda s, d: K.best_reference(reads(s, d), refs(s, d), 12, ties=True), _BEST + ", b AS (SELECT * FROM s QUALIFY rank() OVER (PARTITION BY id_a ORDER BY similarity DESC) = 1) SELECT rowid AS id, id_b AS ref_id, similarity FROM reads LEFT JOIN b ON rowid = id_a")
add("kmer_both_strands", lambda s, d: K.similarities_both_strands(reads(s, d), 14, refs(s, d)), ", turned AS (SELECT rowid, reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) AS seq FROM reads)" + prof("reads", 14) + prof("turned", 14, "t") + prof("refs", 14, "r") + f", f AS ({TO_REFS}), g AS ({SIM.format(a='t', b='r', on='')}) SELECT coalesce(f.id_a, g.id_a) AS id_a, coalesce(f.id_b, g.id_b) AS id_b, coalesce(f.similarity, 0.0) AS forward, coalesce(g.similarity, 0.0) AS reverse FROM f FULL JOIN g ON f.id_a = g.id_a AND f.id_b = g.id_b")
add("similar_by_kmers", lambda s, d: K.similar_to_any(reads(s, d), refs(s, d), 12, 0.2).select("rowid", "similar"), _BEST + " SELECT rowid, rowid IN (SELECT id_a FROM s WHERE similarity >= 0.2) AS similar FROM reads")
add("reorient_reads", lambda s, d: K.reoriented(reads(s, d), refs(s, d), 14).select("rowid", "turned", "seq"), SQL["kmer_both_strands"][len(f"WITH {BOTH}"):].replace("SELECT coalesce(f.id_a", ", v AS (SELECT coalesce(f.id_a") + """), o AS (SELECT id_a, count(*) FILTER (reverse > forward) > count(*) FILTER (forward > reverse) AS t FROM v GROUP BY id_a)
SELECT rowid, coalesce(t, false) AS turned, CASE WHEN t THEN reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) ELSE seq END AS seq FROM reads LEFT JOIN o ON rowid = id_a""")
add("scanning_kmer_similarity", lambda s, d: K.scanning(refs(s, d), refs(s, d), 12, 100, 50), ", w AS (SELECT rowid || ':' || st AS rowid, substr(seq, CAST(st AS INTEGER) + 1, 100) AS seq FROM (SELECT rowid, seq, unnest(range(0, length(seq) - 99, 50)) AS st FROM refs WHERE length(seq) >= 100))" + prof("w", 12) + prof("refs", 12, "r") + f", s AS ({TO_REFS}) SELECT CAST(split_part(id_a, ':', 1) AS BIGINT) AS id_a, CAST(split_part(id_a, ':', 2) AS INTEGER) AS start, id_b, similarity FROM s")
add("kmer_presence", lambda s, d: K.presence(reads(s, d), 14, 5), prof("reads", 14) + " SELECT id, kmer FROM p WHERE kmer IN (SELECT kmer FROM p GROUP BY kmer HAVING count(*) >= 5)")
add("unique_kmers_between", lambda s, d: K.unique_between(reads(s, d), refs(s, d), 7), prof("reads", 7) + prof("refs", 7, "r") + ", x AS (SELECT kmer, CAST(sum(n) AS BIGINT) AS places FROM p GROUP BY kmer), y AS (SELECT kmer, CAST(sum(n) AS BIGINT) AS places FROM r GROUP BY kmer) SELECT kmer, places, 'a' AS side FROM x ANTI JOIN y USING (kmer) UNION ALL SELECT kmer, places, 'b' AS side FROM y ANTI JOIN x USING (kmer)")
add("kmers_absent_from", lambda s, d: K.absent_from(refs(s, d), reads(s, d), 8), prof("refs", 8) + prof("reads", 8, "r") + ", o AS (SELECT kmer FROM r UNION SELECT reverse(translate(kmer, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) FROM r) SELECT id, kmer FROM p ANTI JOIN o USING (kmer) QUALIFY row_number() OVER (PARTITION BY id ORDER BY kmer) <= 10")
add("smallest_unique_k", lambda s, d: s.range(1).select(F.lit(K.smallest_unique_k(refs(s, d))).cast("int").alias("k")))
_STREAK = """, q AS (SELECT rowid AS id, false AS reverse, seq FROM refs UNION ALL SELECT rowid, true, reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) FROM refs),
qk AS (SELECT id, reverse, i - 1 AS qpos, substr(seq, i, 15) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 13)) AS i FROM q WHERE length(seq) >= 15)),
gk AS (SELECT chrom, i - 1 AS pos, substr(seq, i, 15) AS kmer FROM (SELECT *, unnest(range(1, length(seq) - 13)) AS i FROM contigs WHERE length(seq) >= 15)),
h AS (SELECT id, reverse, chrom, qpos, pos, qpos - row_number() OVER (PARTITION BY id, reverse, chrom, pos - qpos ORDER BY qpos) AS g FROM qk JOIN gk USING (kmer))
SELECT id, chrom, reverse, CAST(min(qpos) AS INTEGER) AS query_start, CAST(min(pos) AS INTEGER) AS start, count(*) + 14 AS size FROM h GROUP BY id, reverse, chrom, pos - qpos, g HAVING count(*) + 14 >= 20"""
add("exact_streaks", lambda s, d: K.exact_streaks(refs(s, d), contigs(s, d), 15, 20), _STREAK, f"{REFS}, {CONTIGS}")
add("shared_kmer_blocks", lambda s, d: K.shared_blocks(reads(s, d), refs(s, d), 12, 0.99), prof("reads", 12) + ", o AS (SELECT kmer, count(*) AS sequences FROM p WHERE n = 1 GROUP BY kmer HAVING count(*) >= (SELECT count(*) FROM reads) * (1 - CAST(0.99 AS DOUBLE))), u AS (SELECT id, kmer, min(pos) AS pos FROM (SELECT rowid AS id, i - 1 AS pos, substr(seq, i, 12) AS kmer FROM (SELECT rowid, seq, unnest(range(1, length(seq) - 10)) AS i FROM refs WHERE length(seq) >= 12)) GROUP BY id, kmer HAVING count(*) = 1), g AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS g FROM u JOIN o USING (kmer)) SELECT id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) + 12 AS INTEGER) AS \"end\", min(sequences) AS sequences FROM g GROUP BY id, g", BOTH)
_MOT = ", {h} AS (SELECT chrom AS id, i - 1 AS start, i + {n} - 1 AS \"end\", strand, e AS errors FROM (SELECT chrom, i, '+' AS strand, {f} AS e FROM l UNION ALL SELECT chrom, i, '-', {r} FROM l) WHERE e <= {m})"


def _errors(form):
    from seqloom.functions.sequence import IUPAC

    return " + ".join("(substr(seq, i + {}, 1) NOT IN ({}))::INT".format(k, ", ".join(f"'{x}'" for x in sorted({*IUPAC[c], c}))) for k, c in enumerate(form))


def _motif(form, turned, most):
    n = len(form)
    return f", l AS (SELECT rowid AS chrom, seq, CAST(unnest(range(1, length(seq) - {n} + 2)) AS INTEGER) AS i FROM refs WHERE length(seq) >= {n})" + _MOT.format(h="h", n=n, f=_errors(form), r=_errors(turned), m=most)


add("motif_places", lambda s, d: K.motif_places(refs(s, d), "GATNTCCA", 1, key="rowid"), _motif("GATNTCCA", "TGGANATC", 1) + ' SELECT id, start, "end", strand, errors FROM h', REFS)
add("tandem_motifs", lambda s, d: K.tandem_motifs(refs(s, d), "AT", 3, key="rowid"), _motif("AT", "AT", 0) + ', g AS (SELECT *, start - 2 * row_number() OVER (PARTITION BY id, strand, start % 2 ORDER BY start) AS g FROM h) SELECT id, strand, min(start) AS start, max("end") AS "end", count(*) AS repeats, sum(errors) AS errors FROM g GROUP BY id, strand, g HAVING count(*) >= 3', REFS)
_SAT = " UNION ALL ".join(f"SELECT id, CAST(min(pos) AS INTEGER) AS start, min(pos) + count(*) * {k} AS \"end\", kmer AS unit, count(*) AS repeats FROM (SELECT *, pos - {k} * row_number() OVER (PARTITION BY id, kmer, pos % {k} ORDER BY pos) AS g FROM (SELECT chrom AS id, i - 1 AS pos, substr(seq, i, {k}) AS kmer FROM (SELECT chrom, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM contigs WHERE length(seq) >= {k})) WHERE replace(kmer, kmer[1], '') <> ''" + (f" AND kmer[1:{k // 2}] <> kmer[{k // 2 + 1}:]" if k == 4 else "") + f") GROUP BY id, kmer, g HAVING count(*) >= 3 AND count(*) * {k} >= 6" for k in (2, 3, 4, 5))
add("microsatellites", lambda s, d: K.microsatellites(contigs(s, d)), _SAT, CONTIGS)
add("trim_to_probable_kmer", lambda s, d: K.trimmed_at_probable(reads(s, d), 100, 10, 6).select("rowid", "cut", "seq"))
add("most_common_kmer", lambda s, d: K.most_common_near(reads(s, d), 0, 5, 8), ", o AS (SELECT rowid, seq, unnest(range(0, 6)) AS i FROM reads WHERE length(seq) >= 13) SELECT kmer, count(*) AS reads FROM (SELECT DISTINCT rowid, substr(seq, CAST(i AS INTEGER) + 1, 8) AS kmer FROM o) GROUP BY kmer ORDER BY reads DESC, kmer LIMIT 1")
add("trim_at_common_kmer", lambda s, d: K.trimmed_at_common(reads(s, d), 0, 5, 8, keep_front=False).select("rowid", "seq"), ", o AS (SELECT rowid, seq, unnest(range(0, 6)) AS i FROM reads WHERE length(seq) >= 13), t AS (SELECT kmer, count(*) AS n FROM (SELECT DISTINCT rowid, substr(seq, CAST(i AS INTEGER) + 1, 8) AS kmer FROM o) GROUP BY kmer ORDER BY n DESC, kmer LIMIT 1) SELECT rowid, CASE WHEN strpos(seq, kmer) > 0 THEN substr(seq, strpos(seq, kmer)) ELSE seq END AS seq FROM reads, t")
