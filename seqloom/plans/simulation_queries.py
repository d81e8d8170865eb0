"""Queries of seeded generators, windows over time and literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import simulate as X
from seqloom.plans.common import READS, REFS, reads, refs
from seqloom.runtime import table
from seqloom.streaming.windows import windowed

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


add("random_sequences", lambda s, d: X.random_sequences(s, 500, 50, 120, 7))
add("random_like_input", lambda s, d: X.random_sequences(s, 200, 80, 80, 7, X.composition(reads(s, d))).select("rowid", "seq"))
add("mutate_reads", lambda s, d: X.mutated(refs(s, d), 0.02, 3).select("rowid", "seq", "changes"))
add("known_variants", lambda s, d: X.known_variants(refs(s, d), [(3, "A"), (10, "G")]).select("rowid", "seq"), f"WITH {REFS} SELECT rowid, CASE WHEN length(s) > 10 THEN s[1:10] || 'G' || s[12:] ELSE s END AS seq FROM (SELECT rowid, CASE WHEN length(seq) > 3 THEN seq[1:3] || 'A' || seq[5:] ELSE seq END AS s FROM refs)")
add("single_mutants", lambda s, d: X.all_single_mutants(refs(s, d)).groupBy("rowid").agg(F.count("*").alias("mutants"), F.countDistinct("seq").alias("distinct")), f"WITH {REFS} SELECT rowid, sum(3 + (b NOT IN ('A', 'C', 'G', 'T'))::INT)::BIGINT AS mutants, sum(3 + (b NOT IN ('A', 'C', 'G', 'T'))::INT)::BIGINT AS \"distinct\" FROM (SELECT rowid, unnest(string_split(seq, '')) AS b FROM refs WHERE seq <> '') GROUP BY rowid")
add("amplification_errors", lambda s, d: X.amplification_errors(s, 100.0, 200, 30, 1e-4), "SELECT CAST(r AS INTEGER) AS round, 100.0 * pow(2.0, r) AS amount, 100.0 * pow(1 + pow(1 - 1e-4, 200), r) AS unchanged FROM range(31) t(r)")
add("amplified_reads", lambda s, d: X.amplified(refs(s, d).withColumn("cnt", F.lit(1.0)), 20, 1e-4, 5, 1000).select("rowid", "copy", "seq"))
add("abundance_fractions", lambda s, d: X.fractions(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("amount")), "l_returnflag", "amount"), "SELECT *, amount / sum(amount) OVER (PARTITION BY l_returnflag) AS fraction FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL)")
add("chimera_offsets", lambda s, d: refs(s, d).select("rowid", F.explode(X.shared_offsets(F.col("seq"), F.reverse("seq"), 4)).alias("offset")), f"WITH {REFS} SELECT rowid, CAST(i AS INTEGER) AS \"offset\" FROM (SELECT rowid, seq, unnest(range(0, length(seq) - 3)) AS i FROM refs WHERE length(seq) >= 4) WHERE substr(seq, CAST(i AS INTEGER) + 1, 4) = substr(reverse(seq), CAST(i AS INTEGER) + 1, 4)")
add("windowed_events", lambda s, d: windowed(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", size="1 hour").select(F.unix_seconds("start").alias("start"), "event_type", "n", "total"), "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, sum(value) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
add("quality_characters", lambda s, d: s.range(0, 94).select(F.col("id").alias("quality"), F.chr(F.col("id") + 33).alias("letter")), "SELECT r AS quality, chr(CAST(r + 33 AS INTEGER)) AS letter FROM range(94) t(r)")
add("degenerate_bases", lambda s, d: s.createDataFrame(sorted(S.IUPAC.items()), "letter string, bases string"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(S.IUPAC.items())) + ") t(letter, bases)")
add("amino_acids", lambda s, d: s.createDataFrame(sorted(S.CODONS.items()), "codon string, acid string").groupBy("acid").agg(F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons")), "SELECT acid, string_agg(codon, ',' ORDER BY codon) AS codons FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(S.CODONS.items())) + ") t(codon, acid) GROUP BY acid")
