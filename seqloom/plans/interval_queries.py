"""Queries of the interval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import intervals as V
from seqloom.plans.common import CONTIGS, REGIONS, TARGETS, contigs, regions, targets

QUERIES: dict = {}
SQL: dict = {}
BOTH = f"{REGIONS}, {TARGETS}"
PLACE = ("rowid", "chrom", "start", "end")
P = 'rowid, chrom, "start", "end"'


def add(name, query, sql=None, ctes=BOTH):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


def on_regions(name, change, sql, columns=PLACE):
    add(name, lambda s, d: change(regions(s, d)).select(*columns), sql)


OVER = 'r.chrom = t.chrom AND r."start" < t."end" AND t."start" < r."end" AND r."start" < r."end" AND t."start" < t."end"'
SHARED = 'least(r."end", t."end") - greatest(r."start", t."start")'
add("bed_overlaps", lambda s, d: V.overlap_lists(regions(s, d), targets(s, d), 30).select("rowid", "hits"), f"SELECT r.rowid, string_agg(t.name, ',' ORDER BY t.name) AS hits FROM regions r JOIN targets t ON {OVER} AND {SHARED} >= 30 GROUP BY r.rowid")
add("bed_overlaps_contained", lambda s, d: V.overlapping(regions(s, d), targets(s, d), 0).select("rowid", "rowid_b"), f'SELECT r.rowid, t.rowid AS rowid_b FROM regions r JOIN targets t ON {OVER} AND {SHARED} = least(r."end" - r."start", t."end" - t."start")')
add("bed_non_overlapping", lambda s, d: V.overlapping(regions(s, d), targets(s, d), how="left_anti").select(*PLACE), f"SELECT {P} FROM regions r WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE {OVER})")
add("bed_contained_in_features", lambda s, d: V.containing(regions(s, d), targets(s, d)).select("rowid", "rowid_b"), f'SELECT r.rowid, t.rowid AS rowid_b FROM regions r JOIN targets t ON {OVER} AND r."start" >= t."start" AND r."end" <= t."end"')
on_regions("bed_extend", lambda r: V.extended(r, 100, 50), 'SELECT rowid, chrom, greatest("start" - 100, 0) AS "start", "end" + 50 AS "end", CAST("end" + 50 - greatest("start" - 100, 0) AS DOUBLE) AS score FROM regions', (*PLACE, "score"))
on_regions("bed_extend_upstream", lambda r: V.extended_stream(r, 75, True), """SELECT rowid, chrom, CASE WHEN strand = '-' THEN "start" ELSE greatest("start" - 75, 0) END AS "start", CASE WHEN strand = '-' THEN "end" + 75 ELSE "end" END AS "end" FROM regions""")
on_regions("bed_extend_downstream", lambda r: V.extended_stream(r, 75, False), """SELECT rowid, chrom, CASE WHEN strand = '-' THEN greatest("start" - 75, 0) ELSE "start" END AS "start", CASE WHEN strand = '-' THEN "end" ELSE "end" + 75 END AS "end" FROM regions""")
on_regions("bed_upstream_region", lambda r: V.stream_region(r, 60, 10, True), """SELECT rowid, chrom, CASE WHEN strand = '-' THEN greatest("end" - 10, 0) ELSE greatest("start" - 60, 0) END AS "start", CASE WHEN strand = '-' THEN "end" + 60 ELSE "start" + 10 END AS "end" FROM regions""")
on_regions("bed_downstream_region", lambda r: V.stream_region(r, 60, 10, False), """SELECT rowid, chrom, CASE WHEN strand = '-' THEN greatest("start" - 60, 0) ELSE greatest("end" - 10, 0) END AS "start", CASE WHEN strand = '-' THEN "start" + 10 ELSE "end" + 60 END AS "end" FROM regions""")
on_regions("bed_toggle_strand", V.toggled, "SELECT rowid, CASE WHEN strand = '-' THEN '+' ELSE '-' END AS strand FROM regions", ("rowid", "strand"))
on_regions("bed3_to_bed6", lambda r: V.to_bed6(r.select("rowid", "chrom", "start", "end")), """SELECT rowid, chrom || '-' || "start" || '-' || "end" AS name, CAST("end" - "start" AS DOUBLE) AS score, '+' AS strand FROM regions""", ("rowid", "name", "score", "strand"))
on_regions("bed_rename_with_coords", V.named_by_place, """SELECT rowid, chrom || '-' || "start" || '-' || "end" || CASE WHEN strand = '-' THEN '-rev' ELSE '-for' END AS name, name AS old_name FROM regions""", ("rowid", "name", "old_name"))
on_regions("bed_score_to_length", V.with_length_score, 'SELECT rowid, CAST("end" - "start" AS DOUBLE) AS score FROM regions', ("rowid", "score"))
on_regions("bed_filter_length", lambda r: r.where((F.col("end") - F.col("start")).between(100, 200)), f'SELECT {P} FROM regions WHERE "end" - "start" BETWEEN 100 AND 200')
on_regions("bed_coord_sort", lambda r: r.orderBy("chrom", "start", "end", "rowid"), f"SELECT {P} FROM regions")
on_regions("bed_coord_sort_strand", lambda r: r.orderBy("chrom", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")).desc(), "rowid"), f"SELECT {P} FROM regions")
on_regions("bed_with_name", lambda r: r.where(F.col("name").isin("e5", "e17", "e99")), f"SELECT {P} FROM regions WHERE name IN ('e5', 'e17', 'e99')")
on_regions("bed_to_chrom_start", lambda r: r.withColumn("start", F.lit(0).cast("bigint")), 'SELECT rowid, chrom, CAST(0 AS BIGINT) AS "start", "end" FROM regions')
add("bed_to_chrom_end", lambda s, d: V.to_chrom_end(regions(s, d), regions(s, d).groupBy("chrom").agg(F.max("end").alias("length"))).select(*PLACE), 'SELECT rowid, chrom, "start", max("end") OVER (PARTITION BY chrom) AS "end" FROM regions')
add("bed_rename_chroms", lambda s, d: V.chroms_renamed(regions(s, d), regions(s, d).select(F.col("chrom").alias("old"), F.concat(F.lit("chr_"), "chrom").alias("new")).distinct()).select(*PLACE), """SELECT rowid, 'chr_' || chrom AS chrom, "start", "end" FROM regions""")
add("bed_unique", lambda s, d: V.unique(regions(s, d).withColumn("start", F.floor(F.col("start") / 2000)).withColumn("end", F.col("start") + 1)), """SELECT chrom, "start" // 2000 AS "start", "start" // 2000 + 1 AS "end", strand, string_agg(name, '-' ORDER BY name) AS name, count(*) AS records FROM regions GROUP BY ALL""")
on_regions("bed_rename_repeats", V.repeats_renamed, """SELECT rowid, CASE WHEN k > 0 THEN name || '.' || lpad(CAST(k AS VARCHAR), 3, '0') ELSE name END AS name FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rowid) - 1 AS k FROM regions)""", ("rowid", "name"))
on_regions("bed_tile", lambda r: V.tiled(r, 100, 100), """SELECT rowid, chrom, "start" + a AS "start", "start" + b AS "end" FROM (
SELECT *, 100 * i AS a, CASE WHEN i = m - 1 AND n - 100 * m <= 50 THEN n ELSE least(100 * i + 100, n) END AS b FROM (SELECT *, unnest(range(0, m + (n > 100 * m AND n - 100 * m > 50)::INT)) AS i FROM (SELECT *, "end" - "start" AS n, greatest(("end" - "start") // 100, 1) AS m FROM regions)))""")
add("bed_close_regions", lambda s, d: V.near_first(regions(s, d), targets(s, d), 5000).select("rowid", "distance"), """, t AS (SELECT * FROM targets ORDER BY rowid LIMIT 1) SELECT r.rowid, least(abs(r."start" - t."start"), abs(r."start" - t."end"), abs(r."end" - t."start"), abs(r."end" - t."end")) AS distance FROM regions r JOIN t ON r.chrom = t.chrom WHERE distance <= 5000""")
add("bed_spanning_regions", lambda s, d: V.spanning(regions(s, d), targets(s, d), 200, 900).select("chrom", "start", "end", "name_a", "name_b", "length"), """SELECT r.chrom, r."start", t."end" AS "end", r.name AS name_a, t.name AS name_b, t."end" - r."start" AS length FROM regions r JOIN targets t ON r.chrom = t.chrom AND t."start" >= r."start" AND t."end" - r."start" BETWEEN 200 AND 900 AND r.strand <> t.strand""")
_MERGE = """, m AS (SELECT {k}, "start", "end", CASE WHEN "start" <= max("end") OVER (PARTITION BY {k} ORDER BY "start", "end", rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new, rowid FROM regions),
i AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY "start", "end", rowid ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT {k}, min("start") AS "start", max("end") AS "end", count(*) AS records FROM i GROUP BY {k}, g"""
add("bed_merge", lambda s, d: V.merged(regions(s, d), width=1 << 12), _MERGE.format(k="chrom"))
add("bed_merge_by_strand", lambda s, d: V.merged(regions(s, d), by_strand=True), _MERGE.format(k="chrom, strand"))
_COV = """, x AS (SELECT chrom, p, sum(d) AS d FROM (SELECT chrom, "start" AS p, 1 AS d FROM regions UNION ALL SELECT chrom, "end", -1 FROM regions) GROUP BY chrom, p HAVING sum(d) <> 0),
c AS (SELECT chrom, p AS "start", lead(p) OVER w AS "end", CAST(sum(d) OVER (PARTITION BY chrom ORDER BY p ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM x WINDOW w AS (PARTITION BY chrom ORDER BY p))"""
add("coverage_steps", lambda s, d: V.coverage_steps(regions(s, d)), _COV + ' SELECT chrom, "start", "end", depth FROM c WHERE "end" IS NOT NULL AND depth > 0')
add("best_covered_region", lambda s, d: V.best_covered(regions(s, d)), _COV + ', t AS (SELECT chrom, max(depth) AS depth FROM c GROUP BY chrom) SELECT chrom, depth, min("start") AS "start", max("end") AS "end" FROM c JOIN t USING (chrom, depth) GROUP BY chrom, depth')
_PIV = ["+", "-"]
add("region_counts", lambda s, d: V.counts_in(targets(s, d), regions(s, d), "strand", _PIV).select("rowid", F.col("+").alias("forward"), F.col("-").alias("reverse")), f"SELECT t.rowid, count(r.rowid) FILTER (r.strand = '+') AS forward, count(r.rowid) FILTER (r.strand = '-') AS reverse FROM targets t LEFT JOIN regions r ON {OVER} GROUP BY t.rowid")
add("region_base_counts", lambda s, d: V.counts_in(targets(s, d), regions(s, d), bases=True), f"SELECT t.rowid, coalesce(CAST(sum({SHARED}) AS BIGINT), 0) AS n FROM targets t LEFT JOIN regions r ON {OVER} GROUP BY t.rowid")


def _lengths(s, d):
    return regions(s, d).groupBy("chrom").agg(F.max("end").alias("length"))


add("covered_windows", lambda s, d: V.covered_windows(_lengths(s, d), regions(s, d), "strand", 2, 5000, 1000, 2), f""", w AS (SELECT chrom, unnest(range(0, l - 5000, 1000)) AS "start" FROM (SELECT chrom, max("end") AS l FROM regions GROUP BY chrom)), t2 AS (SELECT chrom, "start", "start" + 5000 AS "end" FROM w),
n AS (SELECT t.chrom, t."start", t."end", r.strand, count(*) AS n FROM t2 t JOIN regions r ON {OVER} GROUP BY ALL HAVING count(*) >= 2) SELECT chrom, "start", "end", min(n) AS coverage FROM n GROUP BY chrom, "start", "end" HAVING count(*) = 2""")
add("refined_regions", lambda s, d: V.refined(targets(s, d), regions(s, d)).select("rowid", "start", "end", "reverse_share"), f"""SELECT t.rowid, greatest(t."start", min(r."start")) AS "start", least(t."end", max(r."end")) AS "end", avg((r.strand = '-')::INT) AS reverse_share FROM targets t JOIN regions r ON {OVER} GROUP BY t.rowid, t."start", t."end" """)
add("reoriented_regions", lambda s, d: V.reoriented(targets(s, d), regions(s, d)).select("rowid", "strand"), f"SELECT t.rowid, CASE WHEN avg((r.strand = '-')::INT) > 0.5 THEN '-' ELSE '+' END AS strand FROM targets t LEFT JOIN regions r ON {OVER} GROUP BY t.rowid")
add("first_region_per_chrom", lambda s, d: V.extreme_per_chrom(regions(s, d)), f'SELECT {P} FROM regions QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY "start", "end" DESC, rowid) = 1')
add("last_region_per_chrom", lambda s, d: V.extreme_per_chrom(regions(s, d), last=True), f'SELECT {P} FROM regions QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY "start" DESC, "end" DESC, rowid) = 1')


def _parts(s, d):
    c = contigs(s, d).where(F.length("seq") >= 300)
    return c.select("chrom", F.lit(100).cast("bigint").alias("start"), F.lit(300).cast("bigint").alias("end"), F.when(F.crc32(F.col("chrom").cast("binary")) % 2 == 0, "-").otherwise("+").alias("strand"), F.col("chrom").alias("name"))


add("sequence_of_regions", lambda s, d: V.sequences_of(_parts(s, d).withColumn("strand", F.when(F.col("chrom") > "ctg00_000030", "-").otherwise("+")), contigs(s, d)).select("chrom", "seq"), "SELECT chrom, CASE WHEN chrom > 'ctg00_000030' THEN reverse(translate(substr(seq, 101, 200), 'ACGTRYKMBVDH', 'TGCAYRMKVBHD')) ELSE substr(seq, 101, 200) END AS seq FROM contigs WHERE length(seq) >= 300", CONTIGS)
add("gc_of_regions", lambda s, d: V.sequences_of(_parts(s, d), contigs(s, d)).select("chrom", (F.length("seq") - F.length(F.regexp_replace("seq", "[GC]", ""))).alias("gc")), "SELECT chrom, CAST(len(regexp_replace(substr(seq, 101, 200), '[^GC]', '', 'g')) AS INTEGER) AS gc FROM contigs WHERE length(seq) >= 300", CONTIGS)
add("best_non_overlapping", lambda s, d: V.best_non_overlapping(regions(s, d)))
add("best_non_overlapping_top", lambda s, d: V.best_non_overlapping(regions(s, d), 10, top=50))
add("plot_rows", lambda s, d: V.plot_rows(regions(s, d)))
