"""Queries of the operators over single reads: trimming, changing, splitting, choosing."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.functions import sequence as S
from seqloom.operators import reads as R
from seqloom.plans.common import READS, REFS, SCORED, reads, refs, scored
from seqloom.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_reads(name, change, sql, columns=("rowid", "seq"), source=reads):
    add(name, lambda spark, d: change(source(spark, d)).select(*columns), f"WITH {SCORED if source is scored else READS} {sql}")


on_reads("trim_front", lambda r: R.trim_front(r, 7), "SELECT rowid, substr(seq, 8) AS seq FROM reads")
on_reads("trim_end", lambda r: R.trim_end(r, 9), "SELECT rowid, substr(seq, 1, greatest(length(seq) - 9, 0)) AS seq FROM reads")
on_reads("trim_edges", lambda r: R.trim_edges(r, 5, 6), "SELECT rowid, substr(seq, 6, greatest(length(seq) - 11, 0)) AS seq FROM reads")
on_reads("trim_to_length", lambda r: R.trim_to_length(r, 150), 'SELECT rowid, substr(seq, 1, 150) AS seq, length(seq) >= 150 AS "on" FROM reads', ("rowid", "seq", "on"))
on_reads("trim_to_positions", lambda r: R.trim_to_positions(r, 20, 120), 'SELECT rowid, substr(seq, 21, 100) AS seq, length(seq) >= 120 AS "on" FROM reads', ("rowid", "seq", "on"))
on_reads("trim_at_first_base", lambda r: R.trim_at_first(r, "N"), "SELECT rowid, CASE WHEN strpos(seq, 'N') > 0 THEN substr(seq, 1, strpos(seq, 'N') - 1) ELSE seq END AS seq FROM reads")
on_reads("trim_at_last_base", lambda r: R.trim_at_last(r, "G"), "SELECT rowid, CASE WHEN strpos(seq, 'G') > 0 THEN substr(seq, 1, length(seq) - strpos(reverse(seq), 'G')) ELSE seq END AS seq FROM reads")
on_reads("trim_strip_base", lambda r: R.strip_base(r, "A", "T"), "SELECT rowid, CASE WHEN ltrim(seq, 'A') = '' THEN '' ELSE rtrim(ltrim(seq, 'A'), 'T') END AS seq FROM reads")
on_reads("trim_lstrip_base", lambda r: R.strip_base(r, left="C"), "SELECT rowid, ltrim(seq, 'C') AS seq FROM reads")
on_reads("trim_rstrip_base", lambda r: R.strip_base(r, right="G"), "SELECT rowid, rtrim(seq, 'G') AS seq FROM reads")
on_reads("trim_at_first_quality", lambda r: R.trim_at_first_quality(r, 12), "SELECT rowid, CASE WHEN p > 0 THEN substr(seq, 1, p - 1) ELSE seq END AS seq FROM (SELECT *, coalesce(list_position(list_transform(qual, lambda q: q <= 12), true), 0) AS p FROM scored)", source=scored)
on_reads("trim_lstrip_quality", lambda r: R.strip_quality(r, left=20), "SELECT rowid, CASE WHEN p > 0 THEN substr(seq, p) ELSE '' END AS seq FROM (SELECT *, coalesce(list_position(list_transform(qual, lambda q: q >= 20), true), 0) AS p FROM scored)", source=scored)
on_reads("trim_rstrip_quality", lambda r: R.strip_quality(r, right=20), "SELECT rowid, CASE WHEN p > 0 THEN substr(seq, 1, length(seq) - p + 1) ELSE '' END AS seq FROM (SELECT *, coalesce(list_position(list_transform(list_reverse(qual), lambda q: q >= 20), true), 0) AS p FROM scored)", source=scored)
on_reads("trim_strip_quality", lambda r: R.strip_quality(r, left=20, right=25), "SELECT rowid, CASE WHEN a > 0 AND b > 0 THEN substr(seq, a, greatest(length(seq) - a - b + 2, 0)) ELSE '' END AS seq FROM (SELECT *, coalesce(list_position(list_transform(qual, lambda q: q >= 20), true), 0) AS a, coalesce(list_position(list_transform(list_reverse(qual), lambda q: q >= 25), true), 0) AS b FROM scored)", source=scored)
add("trim_sliding_quality", lambda spark, d: R.trim_sliding_quality(scored(spark, d), 10, 5, 25.0, 2).select("rowid", "seq"), f"""WITH {SCORED},
w AS (SELECT rowid, i * 5 AS pos, list_sum(qual[i * 5 + 1 : i * 5 + 10]) / 10.0 <= 25 AS bad FROM (SELECT rowid, qual, unnest(range(0, (len(qual) - 10) // 5 + 1)) AS i FROM scored WHERE len(qual) >= 10)),
c AS (SELECT rowid, min(pos) AS cut FROM (SELECT rowid, pos, bad AND coalesce(lead(bad) OVER (PARTITION BY rowid ORDER BY pos), false) AS two FROM w) WHERE two GROUP BY rowid)
SELECT rowid, CASE WHEN cut IS NULL THEN seq ELSE substr(seq, 1, cut) END AS seq FROM scored LEFT JOIN c USING (rowid)""")
add("trim_to_named_positions", lambda spark, d: R.trim_to_named_positions(refs(spark, d), refs(spark, d).select("name", (F.col("rowid") % 50).cast("int").alias("start"), (F.col("rowid") % 50 + 60).cast("int").alias("end"))).select("rowid", "seq"), f"WITH {REFS} SELECT a.rowid, substr(a.seq, CAST(b.rowid % 50 + 1 AS INTEGER), 60) AS seq FROM refs a JOIN refs b ON a.name = b.name")
add("break_at_pattern", lambda spark, d: R.break_at_pattern(reads(spark, d), "N+").groupBy("rowid").agg(F.count("*").alias("parts"), F.sum(F.length("seq")).alias("letters"), F.max("end").alias("last")), f"WITH {READS} SELECT rowid, CAST(len(p) AS BIGINT) AS parts, CAST(list_sum(list_transform(p, lambda x: length(x))) AS BIGINT) AS letters, CAST(length(rtrim(seq, 'N')) AS INTEGER) AS last FROM (SELECT rowid, seq, list_filter(string_split_regex(seq, 'N+'), lambda x: x <> '') AS p FROM reads) WHERE len(p) > 0")
on_reads("change_case", lambda r: R.change_case(r, 3, 10), "SELECT rowid, substr(seq, 1, 3) || lower(substr(seq, 4, 10)) || substr(seq, 14) AS seq FROM reads")
on_reads("change_case_back", lambda r: R.change_case(r, 0, 8, back=True, how="swap"), "SELECT rowid, substr(seq, 1, greatest(length(seq) - 8, 0)) || lower(CASE WHEN length(seq) >= 8 THEN substr(seq, length(seq) - 7) ELSE seq END) AS seq FROM reads")
on_reads("append_reads", lambda r: R.add_sequence(r, "ACRT"), "SELECT rowid, seq || unnest(['ACAT', 'ACGT']) AS seq FROM reads")
on_reads("prepend_reads", lambda r: R.add_sequence(r, "GYA", front=True), "SELECT rowid, unnest(['GCA', 'GTA']) || seq AS seq FROM reads")
on_reads("reverse_complement", R.reverse_complemented, "SELECT rowid, reverse(translate(seq, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd')) AS seq FROM reads")
on_reads("remove_low_quality", lambda r: R.remove_low_quality(r, 15), "SELECT rowid, coalesce(list_aggregate([seq[i] FOR i IN range(1, len(qual) + 1) IF qual[i] > 15], 'string_agg', ''), '') AS seq FROM scored", source=scored)
on_reads("increase_quality", lambda r: R.raise_quality(r, 3).withColumn("total", F.aggregate("qual", F.lit(0), lambda s, x: s + x)), "SELECT rowid, CAST(coalesce(list_sum(list_transform(qual, lambda q: q + 3)), 0) AS INTEGER) AS total FROM scored", ("rowid", "total"), scored)
_CODE = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in S.CODONS.items()) + "}"


def _protein(seq, frame=0):
    return f"coalesce(list_aggregate([coalesce({_CODE}[substr({seq}, 3 * i + 1 + {frame}, 3)], 'X') FOR i IN range(0, (length({seq}) - {frame}) // 3)], 'string_agg', ''), '')"


on_reads("translate", lambda r: r.withColumn("protein", S.translated(F.col("seq"))), f"SELECT rowid, {_protein('seq')} AS protein FROM reads", ("rowid", "protein"))
on_reads("translate_frame2_reverse", lambda r: r.withColumn("protein", F.regexp_replace(S.translated(S.reverse_complement(F.col("seq")), 2), r"\*$", "")), f"SELECT rowid, regexp_replace({_protein('s', 2)}, '\\*$', '') AS protein FROM (SELECT rowid, reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) AS s FROM reads)", ("rowid", "protein"))
on_reads("guess_protein", R.longest_protein, f"""SELECT rowid, protein, frame FROM (SELECT rowid, p AS protein, frame, row_number() OVER (PARTITION BY rowid ORDER BY length(p) DESC, frame, p DESC) AS k FROM (
SELECT rowid, 0 AS frame, unnest(string_split({_protein('seq')}, '*')) AS p FROM reads UNION ALL SELECT rowid, 1, unnest(string_split({_protein('seq', 1)}, '*')) FROM reads UNION ALL SELECT rowid, 2, unnest(string_split({_protein('seq', 2)}, '*')) FROM reads)) WHERE k = 1""", ("rowid", "protein", "frame"))
on_reads("open_frame", R.open_frame, f"""SELECT rowid, CASE WHEN NOT contains(regexp_replace(a, '\\*$', ''), '*') THEN a WHEN NOT contains(regexp_replace(b, '\\*$', ''), '*') THEN b WHEN NOT contains(regexp_replace(c, '\\*$', ''), '*') THEN c END AS protein FROM (SELECT rowid, {_protein('seq')} AS a, {_protein('seq', 1)} AS b, {_protein('seq', 2)} AS c FROM reads)""", ("rowid", "protein"))
on_reads("prepend_names", lambda r: r.withColumn("name", F.concat(F.lit("x_"), "name")), "SELECT rowid, 'x_' || name AS name FROM reads", ("rowid", "name"))
on_reads("append_names", lambda r: r.withColumn("name", F.concat("name", F.lit("_y"))), "SELECT rowid, name || '_y' AS name FROM reads", ("rowid", "name"))
on_reads("name_to_white_space", lambda r: r.withColumn("name", F.regexp_extract("name", r"^\S*", 0)), "SELECT rowid, regexp_extract(name, '^\\S*') AS name FROM reads", ("rowid", "name"))
on_reads("rename_reads", lambda r: R.renamed(r, "seq"), "SELECT rowid, 'seq.' || lpad(CAST(row_number() OVER (ORDER BY rowid) - 1 AS VARCHAR), 6, '0') AS name, name AS old_name FROM reads", ("rowid", "name", "old_name"))
on_reads("dereplicate", R.replicated, "SELECT rowid, name || '_' || copy AS name, CAST(copy AS INTEGER) AS copy FROM (SELECT rowid, name, unnest(range(0, CAST(round(cnt) AS BIGINT))) AS copy FROM reads)", ("rowid", "name", "copy"))
add("collapse_to_unique", lambda spark, d: R.collapsed(reads(spark, d)).select("rowid", "seq", "records", "cnt"), f"WITH {READS} SELECT min(rowid) AS rowid, seq, count(*) AS records, sum(cnt) AS cnt FROM reads GROUP BY seq")
add("collapsed_members", lambda spark, d: R.members(reads(spark, d)), f"WITH {READS} SELECT min(rowid) OVER (PARTITION BY seq) AS rep, rowid, name FROM reads")
add("collapse_within_meta", lambda spark, d: R.collapsed(reads(spark, d), by=["sample"]).select("sample", "rowid", "records", "cnt"), f"WITH {READS} SELECT sample, min(rowid) AS rowid, count(*) AS records, sum(cnt) AS cnt FROM reads GROUP BY sample, seq")
add("expand_collapsed", lambda spark, d: R.uncollapsed(R.collapsed(reads(spark, d)), R.members(reads(spark, d))), f"WITH {READS} SELECT rowid, name, seq FROM reads")
on_reads("sort_by_composition", lambda r: r.orderBy(S.gc_fraction(F.col("seq")), "seq"), "SELECT rowid, seq FROM reads")
for _name, _change, _sql in (
    ("split_length_below", lambda r: R.flag_length(r, least=200), "length(seq) >= 200"),
    ("split_length_above", lambda r: R.flag_length(r, most=250), "length(seq) <= 250"),
    ("split_length_between", lambda r: R.flag_length(r, 150, 250), "length(seq) BETWEEN 150 AND 250"),
    ("split_length_within", lambda r: R.flag_length(r, 230 - 25, 230 + 25), "abs(length(seq) - 230) <= 25"),
    ("split_name_contains", lambda r: R.flag_name(r, "amp0"), "NOT coalesce(contains(name, 'amp0'), false)"),
    ("split_seq_contains", lambda r: R.flag_contains(r, "AA", 8), "len([i FOR i IN range(1, length(seq)) IF substr(seq, i, 2) = 'AA']) < 8"),
):
    on_reads(_name, _change, f"SELECT rowid, {_sql} AS include FROM reads", ("rowid", "include"))
on_reads("split_quality_window", lambda r: R.flag_quality_windows(r, 20, 5, 25.0), "SELECT rowid, NOT coalesce(list_bool_or([list_sum(qual[5 * i + 1 : 5 * i + 20]) / 20.0 < 25 FOR i IN range(0, (len(qual) - 20) // 5 + 1) IF len(qual) >= 20]), false) AS include FROM scored", ("rowid", "include"), scored)
_COMP = f"""WITH {READS}, p AS (SELECT rowid, {', '.join(f"length(seq) - length(replace(seq, '{b}', '')) AS n{b}" for b in 'ACGT')} FROM reads),
t AS (SELECT {', '.join(f'sum(n{b}) AS t{b}' for b in 'ACGT')} FROM p),
f AS (SELECT rowid, CASE WHEN nA + nC + nG + nT > 0 THEN {' + '.join(f'abs(n{b} / (nA + nC + nG + nT) - t{b} / (tA + tC + tG + tT))' for b in 'ACGT')} END AS distance FROM p, t)"""
on_reads("composition_distance", R.composition_distance, "", ("rowid", "distance"))
SQL["composition_distance"] = _COMP + " SELECT rowid, distance FROM f"
on_reads("split_composition", R.flag_composition, "", ("rowid", "include"))
SQL["split_composition"] = _COMP + " SELECT rowid, coalesce(distance <= (SELECT avg(distance) + 2 * stddev_samp(distance) FROM f), false) AS include FROM f"
on_reads("starts_with_motif", lambda r: R.starting_with(r, "ATG", 1), "SELECT rowid FROM reads WHERE length(seq) >= 3 AND (substr(seq, 1, 1) <> 'A')::INT + (substr(seq, 2, 1) <> 'T')::INT + (substr(seq, 3, 1) <> 'G')::INT <= 1", ("rowid",))
on_reads("ends_with_motif", lambda r: R.ending_with(r, "TRC", 1), "SELECT rowid FROM reads WHERE length(seq) >= 3 AND (substr(seq, -3, 1) <> 'T')::INT + (substr(seq, -2, 1) NOT IN ('A', 'G', 'R'))::INT + (substr(seq, -1, 1) <> 'C')::INT <= 1", ("rowid",))
on_reads("starts_and_ends_with", lambda r: R.ending_with(R.starting_with(r, "AT"), "GC"), "SELECT rowid FROM reads WHERE seq LIKE 'AT%' AND seq LIKE '%GC'", ("rowid",))
on_reads("extract_on_length", lambda r: r.where(F.length("seq").between(100, 200)), "SELECT rowid, seq FROM reads WHERE length(seq) BETWEEN 100 AND 200")


def _mutated(spark, d):
    """Names of the reads that have mutants."""
    parents = table(spark, d, "mutants").select(F.col("parent_rowid").alias("rowid")).distinct()
    return reads(spark, d).join(parents, "rowid", "left_semi").select("name")


add("extract_by_name", lambda spark, d: R.by_name(reads(spark, d), _mutated(spark, d)).select("rowid"), f"WITH {READS} SELECT rowid FROM reads WHERE name IN (SELECT name FROM reads WHERE rowid IN (SELECT parent_rowid FROM mutants) AND name IS NOT NULL)")
add("exclude_by_name", lambda spark, d: R.by_name(reads(spark, d), _mutated(spark, d), excluding=True).select("rowid"), f"WITH {READS} SELECT rowid FROM reads WHERE name IS NULL OR name NOT IN (SELECT name FROM reads WHERE rowid IN (SELECT parent_rowid FROM mutants) AND name IS NOT NULL)")
add("extract_same_seqs", lambda spark, d: reads(spark, d).join(table(spark, d, "mutants").select(F.upper(F.regexp_replace("seq", r"[-\s]", "")).alias("seq")).where("seq is not null").distinct(), "seq", "left_semi").select("rowid"), f"WITH {READS} SELECT rowid FROM reads WHERE seq IN (SELECT upper(regexp_replace(seq, '[-\\s]', '', 'g')) FROM mutants WHERE seq IS NOT NULL)")
on_reads("split_up_file", lambda r: R.in_chunks(r, 500), "SELECT rowid, (row_number() OVER (ORDER BY rowid) - 1) // 500 AS chunk FROM reads", ("rowid", "chunk"))
on_reads("reads_at_position", lambda r: r.orderBy("rowid").offset(100).limit(50), "SELECT rowid, seq FROM reads ORDER BY rowid LIMIT 50 OFFSET 100")
add("random_sample", lambda spark, d: R.sampled(reads(spark, d), 200, 42).select("rowid"))
add("even_out_complement", lambda spark, d: R.balanced(reads(spark, d), F.coalesce(F.col("name").contains("_t1"), F.lit(False)), 42).groupBy(F.coalesce(F.col("name").contains("_t1"), F.lit(False)).alias("marked")).agg(F.count("*").alias("reads")), f"WITH {READS}, c AS (SELECT coalesce(contains(name, '_t1'), false) AS marked, count(*) AS n FROM reads GROUP BY 1) SELECT marked, (SELECT min(n) FROM c) AS reads FROM c")
add("demultiplex", lambda spark, d: R.demultiplexed(reads(spark, d), refs(spark, d).select(F.col("rowid").alias("id"), F.substring("seq", 1, 8).alias("barcode")), 1).groupBy("barcode_id", "reverse").agg(F.count("*").alias("reads")), f"WITH {READS}, {REFS}, bc AS (SELECT rowid AS id, left(seq, 8) AS b FROM refs), p AS (SELECT rowid, false AS reverse, seq AS s FROM reads UNION ALL SELECT rowid, true, reverse(translate(seq, 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) FROM reads), h AS (SELECT rowid, reverse, id FROM p JOIN bc ON CASE WHEN length(s) >= length(b) THEN hamming(left(s, length(b)), b) ELSE 9 END <= 1 QUALIFY row_number() OVER (PARTITION BY rowid ORDER BY CASE WHEN length(s) >= length(b) THEN hamming(left(s, length(b)), b) ELSE 9 END, reverse, id) = 1) SELECT id AS barcode_id, reverse, count(*) AS reads FROM reads LEFT JOIN h USING (rowid) GROUP BY ALL")
