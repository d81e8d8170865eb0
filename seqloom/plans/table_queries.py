"""Queries of metadata, table, JSON and annotation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqloom.operators import features as G
from seqloom.operators import meta as M
from seqloom.plans.common import READS, REGIONS, TARGETS, reads, regions, targets
from seqloom.runtime import table

QUERIES: dict = {}
SQL: dict = {}


def add(name, query, sql=None, ctes=READS):
    QUERIES[name] = query
    if sql:
        SQL[name] = f"WITH {ctes}{sql}" if sql.startswith(",") else f"WITH {ctes} {sql}"


add("add_meta_by_sample", lambda s, d: M.joined(reads(s, d), table(s, d, "sample_meta"), "sample", F.col("sample")).select("rowid", M.get("site").alias("site"), M.get("host_age").alias("host_age")), ", m AS (SELECT * FROM sample_meta WHERE sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample ORDER BY site NULLS FIRST, collection_year NULLS FIRST, host_age NULLS FIRST, barcode NULLS FIRST) = 1) SELECT rowid, coalesce(meta['site'], site) AS site, coalesce(meta['host_age'], host_age) AS host_age FROM reads LEFT JOIN m ON reads.sample = m.sample")
add("add_meta_by_field", lambda s, d: M.joined(reads(s, d), table(s, d, "sample_meta"), "sample", M.get("sample"), overwrite=True).select("rowid", M.get("site", "NA").alias("site")), ", m AS (SELECT * FROM sample_meta WHERE sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample ORDER BY site NULLS FIRST, collection_year NULLS FIRST, host_age NULLS FIRST, barcode NULLS FIRST) = 1) SELECT rowid, coalesce(m.site, meta['site'], 'NA') AS site FROM reads LEFT JOIN m ON meta['sample'] = m.sample")
add("exclude_numeric_meta", lambda s, d: M.flag_numeric(reads(s, d), "lane", 2).select("rowid", "include"), "SELECT rowid, coalesce(try_cast(trim(meta['lane']) AS DOUBLE) > 2, true) AS include FROM reads")
add("exclude_matching_meta", lambda s, d: M.flag_matching(reads(s, d), "target", ["amp01", "amp02"]).select("rowid", "include"), "SELECT rowid, NOT coalesce(meta['target'] IN ('amp01', 'amp02'), false) AS include FROM reads")
add("select_meta_fields", lambda s, d: M.selected(reads(s, d), ["target", "lane"]).select("rowid", M.get("target").alias("target"), M.get("lane").alias("lane")), "SELECT rowid, coalesce(meta['target'], 'NA') AS target, coalesce(meta['lane'], 'NA') AS lane FROM reads")
add("split_by_meta", lambda s, d: M.groups(reads(s, d), ["target", "lane"]).groupBy("part").agg(F.count("*").alias("reads")), "SELECT coalesce(meta['target'], 'NA') || '_' || coalesce(meta['lane'], 'NA') AS part, count(*) AS reads FROM reads GROUP BY 1")
add("split_by_external_meta", lambda s, d: M.groups(M.joined(reads(s, d), table(s, d, "sample_meta"), "sample", F.col("sample"), True), ["site"]).groupBy("part").agg(F.count("*").alias("reads")), ", m AS (SELECT * FROM sample_meta WHERE sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample ORDER BY site NULLS FIRST, collection_year NULLS FIRST, host_age NULLS FIRST, barcode NULLS FIRST) = 1) SELECT coalesce(m.site, meta['site'], 'NA') AS part, count(*) AS reads FROM reads LEFT JOIN m ON reads.sample = m.sample GROUP BY 1")
add("table_from_seqs", lambda s, d: M.as_table(reads(s, d), ["sample", "target"]), "SELECT rowid, name, coalesce(meta['sample'], 'NA') AS sample, coalesce(meta['target'], 'NA') AS target, seq FROM reads")
add("meta_fields", lambda s, d: M.keys_of(reads(s, d)), "SELECT DISTINCT unnest(map_keys(meta)) AS key FROM reads")
add("meta_from_name", lambda s, d: M.from_name(reads(s, d).drop("meta")).select("rowid", "name", M.get("sample").alias("sample"), M.get("target").alias("target")), r"SELECT rowid, regexp_replace(name, '\[[^\[\]]*=[^\[\]]*\]', '', 'g') AS name, CASE WHEN regexp_matches(name, '[\[;]sample=') THEN regexp_extract(name, '[\[;]sample=([^;\]]*)', 1) END AS sample, CASE WHEN regexp_matches(name, '[\[;]target=') THEN regexp_extract(name, '[\[;]target=([^;\]]*)', 1) END AS target FROM reads")
add("meta_to_name", lambda s, d: M.to_name(reads(s, d)).select("rowid", "name"), "SELECT rowid, CASE WHEN cardinality(meta) > 0 THEN name || '[' || list_aggregate(list_transform(list_sort(map_keys(meta)), lambda k: k || '=' || coalesce(meta[k], 'NA')), 'string_agg', ';') || ']' ELSE name END AS name FROM reads")
add("shared_lines", lambda s, d: M.shared_lines(reads(s, d), table(s, d, "seq_reads").where("qual is not null"), "name", "sample"), ", a AS (SELECT name AS key, min(sample) AS v FROM reads WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT name AS key, min(sample) AS v FROM seq_reads WHERE qual IS NOT NULL AND name IS NOT NULL GROUP BY 1) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'only_first' WHEN a.key IS NULL THEN 'only_second' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.key = b.key")
add("separate_column", lambda s, d: M.separated(table(s, d, "sample_meta").where("barcode is not null").select("sample", "barcode"), "barcode", "A", "<", ">"), "SELECT sample, CASE WHEN i > 1 THEN '<' ELSE '' END || l[i] || CASE WHEN i < len(l) THEN '>' ELSE '' END AS barcode, CAST(i - 1 AS INTEGER) AS part FROM (SELECT sample, string_split(barcode, 'A') AS l, unnest(range(1, len(string_split(barcode, 'A')) + 1)) AS i FROM sample_meta WHERE barcode IS NOT NULL)", "one AS (SELECT 1)")
add("presence_matrix", lambda s, d: M.presence_matrix(table(s, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("q")), "l_returnflag", "l_linestatus", "q", 100.0), """, q AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY ALL HAVING sum(l_quantity) >= 100), w AS (SELECT l_returnflag, max((l_linestatus = 'F')::BIGINT) AS l_linestatus_F, max((l_linestatus = 'O')::BIGINT) AS l_linestatus_O FROM q GROUP BY 1) SELECT * FROM w UNION ALL SELECT 'total', sum(l_linestatus_F)::BIGINT, sum(l_linestatus_O)::BIGINT FROM w""")
add("highest_fraction_rows", lambda s, d: reads(s, d).where("sample is not null").groupBy("sample").agg(F.min(F.struct((-F.col("cnt")).alias("c"), "rowid")).alias("b")).select("sample", F.col("b.rowid").alias("rowid"), (-F.col("b.c")).alias("cnt")), "SELECT sample, rowid, cnt FROM reads WHERE sample IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample ORDER BY cnt DESC, rowid) = 1")
add("json_field", lambda s, d: M.json_field(table(s, d, "events"), "props", "k").select("event_id", "value"), "SELECT event_id, CASE WHEN json_valid(props) THEN (CASE WHEN json_valid(props) THEN props END)::JSON ->> '$.k' END AS value FROM events", "one AS (SELECT 1)")
add("biosample_missing_counts", lambda s, d: _samples(s, d).agg(F.count_if(F.col("accession").isNull()).alias("no_accession"), F.count_if(F.col("id").isNull()).alias("no_id"), F.count_if(F.col("title").isNull()).alias("no_title"), F.count("*").alias("samples")))
add("biosample_attribute_names", lambda s, d: _kind(s, d, "Attribute").select("attribute_name").where("attribute_name is not null").distinct())
add("biosample_strains", lambda s, d: _samples(s, d).join(_kind(s, d, "Attribute").where("attribute_name = 'strain'").groupBy("raw_id", "sample_pos").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("strain")), ["raw_id", "sample_pos"], "left").select("raw_id", "sample_pos", F.coalesce("id", F.lit("NA")).alias("id"), F.coalesce("accession", F.lit("NA")).alias("accession"), F.coalesce("title", F.lit("NA")).alias("title"), F.coalesce("strain", F.lit("NA")).alias("strain")))


def _kind(s, d, kind):
    from seqloom.operators.nested import flat_tables

    return flat_tables(table(s, d, "biosample_raw"))[kind]


def _samples(s, d):
    return _kind(s, d, "BioSample")


def features(s, d):
    """Records of three levels made of regions, nations and customers."""
    r, n, c = (table(s, d, t) for t in ("region", "nation", "customer"))
    shape = "seqid string, type string, start bigint, end bigint, strand string, rowid bigint"

    def rec(df, id_, parent, name, type_, start, size, seqid, rowid):
        m = F.map_filter(F.create_map(F.lit("ID"), id_, F.lit("Parent"), parent, F.lit("Name"), name), lambda _, v: v.isNotNull())
        return df.select(F.concat(F.lit("s"), seqid).alias("seqid"), F.lit(type_).alias("type"), start.cast("bigint").alias("start"), (start + size).cast("bigint").alias("end"), F.when(rowid % 2 == 0, "+").otherwise("-").alias("strand"), m.alias("attributes"), rowid.cast("bigint").alias("rowid"))

    del shape
    none = F.lit(None).cast("string")
    cn = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    genes = rec(r, F.concat(F.lit("r"), "r_regionkey"), none, F.col("r_name"), "gene", F.lit(1), 100000, F.col("r_regionkey"), F.col("r_regionkey"))
    rnas = rec(n, F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), F.col("n_name"), "mRNA", F.col("n_nationkey") * 3000 + 1, 4000, F.col("n_regionkey"), F.col("n_nationkey") + 100)
    cds = rec(cn, F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "n_nationkey"), none, "CDS", F.col("n_nationkey") * 3000 + F.col("c_custkey") % 4000 + 1, 120, F.col("n_regionkey"), F.col("c_custkey") + 1000)
    return genes.unionByName(rnas).unionByName(cds)


FEATURES = """gff AS (SELECT 's' || r_regionkey AS seqid, 'gene' AS type, 1::BIGINT AS "start", 100001::BIGINT AS "end", r_regionkey::BIGINT AS rowid, 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region
UNION ALL SELECT 's' || n_regionkey, 'mRNA', n_nationkey * 3000 + 1, n_nationkey * 3000 + 4001, n_nationkey + 100, 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
UNION ALL SELECT 's' || n_regionkey, 'CDS', n_nationkey * 3000 + c_custkey % 4000 + 1, n_nationkey * 3000 + c_custkey % 4000 + 121, c_custkey + 1000, 'c' || c_custkey, 'n' || n_nationkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey),
feat AS (SELECT *, CASE WHEN rowid % 2 = 0 THEN '+' ELSE '-' END AS strand FROM gff)"""


def _gff_regions(s, d):
    r = regions(s, d)
    return r.withColumn("chrom", F.concat(F.lit("s"), F.col("rowid") % 5)).withColumns({"start": F.col("start") % 100000, "end": F.col("start") % 100000 + (F.col("end") - F.col("start"))})


GREG = f"""{FEATURES}, {REGIONS}, reg AS (SELECT rowid, 's' || (rowid % 5) AS chrom, "start" % 100000 AS "start", "start" % 100000 + ("end" - "start") AS "end", strand FROM regions)"""
_ON = 'r.chrom = f.seqid AND r."start" < f."end" AND f."start" - 1 < r."end"'
add("gff_feature_count", lambda s, d: G.counted(features(s, d), F.col("type")), "SELECT type AS level, count(*) AS n FROM feat GROUP BY type", FEATURES)
add("gff_attribute_count", lambda s, d: G.counted(features(s, d), G.attribute("Name")), "SELECT coalesce(name, 'none') AS level, count(*) AS n FROM feat GROUP BY 1", FEATURES)
add("gff_attribute_keys", lambda s, d: G.attribute_keys(features(s, d)), "SELECT 'ID' AS key, count(id) AS n FROM feat UNION ALL SELECT 'Parent', count(parent) FROM feat UNION ALL SELECT 'Name', count(name) FROM feat", FEATURES)
add("gff_extract_feature", lambda s, d: features(s, d).where("type = 'mRNA'").select("rowid", "seqid", "start", "end"), """SELECT rowid, seqid, "start", "end" FROM feat WHERE type = 'mRNA'""", FEATURES)
add("gff_to_bed", lambda s, d: G.to_bed(features(s, d)).select("rowid", "chrom", "start", "end", "name", "strand"), 'SELECT rowid, seqid AS chrom, "start" - 1 AS "start", "end", id AS name, strand FROM feat', FEATURES)
add("gff_to_bed_by_attribute", lambda s, d: G.to_bed(features(s, d).where(G.attribute("Parent") == "r1")).select("rowid", "name"), "SELECT rowid, id AS name FROM feat WHERE parent = 'r1'", FEATURES)
add("gff_to_json_by_id", lambda s, d: G.to_json(features(s, d).where(G.attribute("ID") == "n7")).select("rowid"), "SELECT rowid FROM feat WHERE id = 'n7'", FEATURES)
add("gff_with_children", lambda s, d: G.with_descendants(features(s, d), ["r2"]).select("rowid", "depth"), ", x AS (SELECT rowid, 0 AS depth FROM feat WHERE id = 'r2' UNION ALL SELECT rowid, 1 FROM feat WHERE parent = 'r2' UNION ALL SELECT c.rowid, 2 FROM feat c JOIN feat p ON c.parent = p.id WHERE p.parent = 'r2') SELECT rowid, depth FROM x", FEATURES)
add("gff_transcripts_per_gene", lambda s, d: G.children_counted(features(s, d), "gene", "mRNA"), "SELECT g.id, count(m.id) AS n FROM feat g LEFT JOIN feat m ON m.parent = g.id AND m.type = 'mRNA' WHERE g.type = 'gene' GROUP BY g.id", FEATURES)
add("gff_numbered_parts", lambda s, d: G.numbered_parts(features(s, d).withColumn("strand", F.lit("+")), "CDS"), """SELECT parent, CAST(row_number() OVER (PARTITION BY parent ORDER BY "start", "end") AS INTEGER) AS number, "start", "end" FROM (SELECT DISTINCT parent, "start", "end" FROM feat WHERE type = 'CDS')""", FEATURES)
add("bed_genes_in_gff", lambda s, d: G.intersecting(_gff_regions(s, d), features(s, d), ["mRNA"]).select("rowid", "name_b"), f"SELECT r.rowid, f.id AS name_b FROM reg r JOIN feat f ON {_ON} AND f.type = 'mRNA'", GREG)
add("bed_clip_to_genes", lambda s, d: G.regions_clipped(_gff_regions(s, d), features(s, d), ["mRNA"]), f"""SELECT r.rowid, greatest(r."start", max(f."start" - 1)) AS "start", least(r."end", min(f."end")) AS "end" FROM reg r JOIN feat f ON {_ON} AND f.type = 'mRNA' GROUP BY r.rowid, r."start", r."end" """, GREG)
add("bed_orient_to_genes", lambda s, d: G.regions_oriented(_gff_regions(s, d), features(s, d), ["mRNA"]).select("rowid", "strand"), f"SELECT r.rowid, coalesce(arg_max(f.strand, f.rowid), r.strand) AS strand FROM reg r LEFT JOIN feat f ON {_ON} AND f.type = 'mRNA' GROUP BY r.rowid, r.strand", GREG)
add("amino_acids_to_bed", lambda s, d: G.amino_acids_to_bed(features(s, d), features(s, d).where("type = 'mRNA'").select(G.attribute("ID").alias("id"), F.lit(41).alias("aa"))))
