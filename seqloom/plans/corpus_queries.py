"""Queries of the general operators for corpora (wide tables, nested records) and their SQL."""

from __future__ import annotations

from seqloom.operators import nested, wide
from seqloom.runtime import table


def _wide_inputs(spark, d):
    return table(spark, d, "biosample_attributes"), table(spark, d, "attribute_types"), table(spark, d, "missing_words")


def p2_found(spark, d):
    return wide.filled_cells(*_wide_inputs(spark, d))


def p2_wide(spark, d):
    return wide.wide_table(*_wide_inputs(spark, d))


def p5_found(spark, d):
    return nested.object_keys(table(spark, d, "biosample_raw")).select("raw_id", "sample_pos", "kind", "parent_pos", "child_pos")


def _flat(kind):
    return lambda spark, d: nested.flat_tables(table(spark, d, "biosample_raw"))[kind]


QUERIES = {"p2_found": p2_found, "p2_wide": p2_wide, "p5_found": p5_found} | {f"p5_table_{k.lower()}": _flat(k) for k in nested.KINDS}

_FLAT = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
_NUM = r"'[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)(\.[0-9]+)?\s*[\p{L}%/°]*'"
_INT = r"'[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)\s*[\p{L}%/°]*'"
_CELLS = rf"""
WITH names AS (SELECT DISTINCT {_FLAT.format('attribute')} AS k, attribute, value_type FROM attribute_types),
words AS (SELECT DISTINCT {_FLAT.format('word')} AS w FROM missing_words),
base AS (
  SELECT upper(trim(accession, E' \t\n\r')) AS accession, attribute, value_type, trim(t_value, E' \t\n\r') AS v, loaded_at, attr_id
  FROM biosample_attributes JOIN names ON {_FLAT.format('attribute_name')} = k
  WHERE {_FLAT.format('t_value')} <> '' AND {_FLAT.format('t_value')} NOT IN (SELECT w FROM words)
),
day AS (
  SELECT *, CASE
    WHEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') THEN try_strptime(v, '%Y-%m-%d')
    WHEN regexp_full_match(v, '[0-9]{{4}}/[0-9]{{1,2}}/[0-9]{{1,2}}') THEN try_strptime(v, '%Y/%m/%d')
    WHEN regexp_full_match(v, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.[0-9]{{4}}') THEN try_strptime(v, '%d.%m.%Y')
    WHEN regexp_full_match(v, '[0-9]{{1,2}}[- ][A-Za-z]{{3}}[- ][0-9]{{4}}') THEN try_strptime(replace(v, '-', ' '), '%d %b %Y') END AS dt
  FROM base WHERE accession <> ''
),
best AS (
  SELECT * FROM day
  WHERE CASE value_type WHEN 'double' THEN regexp_full_match(v, {_NUM}) WHEN 'int' THEN regexp_full_match(v, {_INT}) WHEN 'date' THEN dt IS NOT NULL ELSE true END
  QUALIFY row_number() OVER (PARTITION BY accession, attribute ORDER BY loaded_at DESC NULLS LAST, attr_id DESC) = 1
)
"""
#: The attributes of attribute_types with their types.
TYPES = dict(strain="text", isolate="text", host="text", collection_date="date", geo_loc_name="text", latitude="double", longitude="double", depth="double", elevation="int", temp="double", ph="double", sample_volume="int", host_age="int", host_sex="text", tissue="text", passage_number="int", library_size="int", culture_id="text", treatment="text", dose="double", extraction_date="date", replicate="int", collected_by="text", salinity="double")


def _wide_sql() -> str:
    number = r"replace(regexp_extract(v, '^[+-]?[0-9,]+(\.[0-9]+)?'), ',', '')"
    read = {"text": "v", "double": f"TRY_CAST({number} AS DOUBLE)", "int": f"TRY_CAST({number} AS BIGINT)", "date": "CAST(dt AS DATE)"}
    cells = ", ".join(f"max({read[t]}) FILTER (attribute = '{a}') AS {a}" for a, t in TYPES.items())
    return _CELLS + f", own AS (SELECT accession, {cells} FROM best GROUP BY accession) SELECT * FROM (SELECT DISTINCT upper(trim(accession, E' \\t\\n\\r')) AS accession FROM biosample_attributes) LEFT JOIN own USING (accession) WHERE accession <> ''"


def _p5_ctes() -> str:
    def parts(j: str, path: str) -> str:
        return f"CASE json_type({j}, '{path}') WHEN 'ARRAY' THEN json_extract({j}, '{path}[*]') WHEN 'OBJECT' THEN [json_extract({j}, '{path}')] ELSE CAST([] AS JSON[]) END"

    def level(source: str, keep: str, path: str) -> str:
        return f"SELECT {keep}, u.v AS v, u.i AS i FROM (SELECT {keep}, unnest(list_transform(l, lambda x, k: {{'v': x, 'i': k - 1}})) AS u FROM (SELECT {keep}, {parts('v', path)} AS l FROM {source})) WHERE json_type(u.v) = 'OBJECT'"

    kinds = {k: p for k, (p, _) in nested.CHILDREN.items()}
    ctes = ", ".join(f"t{k} AS ({level('s2', 'raw_id, sample_pos', p)})" for k, p in kinds.items())
    return f"""
WITH once AS (SELECT raw_id, CASE WHEN json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc END) = 'VARCHAR' THEN (CASE WHEN json_valid(doc) THEN doc END)::JSON ->> '$' ELSE doc END AS t FROM biosample_raw),
d AS (SELECT raw_id, CAST(t AS JSON) AS v FROM (SELECT raw_id, CASE WHEN json_valid(t) THEN t END AS t FROM once) WHERE t IS NOT NULL),
s AS ({level('d', 'raw_id', '$.BioSampleSet.BioSample')}),
s2 AS (SELECT raw_id, i AS sample_pos, v FROM s),
{ctes},
a2 AS (SELECT raw_id, sample_pos, i AS parent_pos, v FROM tAttribute),
e AS ({level('a2', 'raw_id, sample_pos, parent_pos', '$.Evidence')})"""


def _p5_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT raw_id, sample_pos, '{k}' AS kind, sample_pos AS parent_pos, i AS child_pos FROM t{k}" for k in nested.CHILDREN)
    return f"""{_p5_ctes()}
SELECT raw_id, CAST(sample_pos AS INTEGER) AS sample_pos, kind, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(child_pos AS INTEGER) AS child_pos FROM (
SELECT raw_id, sample_pos, 'BioSample' AS kind, -1 AS parent_pos, sample_pos AS child_pos FROM s2 UNION ALL {rows}
UNION ALL SELECT raw_id, sample_pos, 'Evidence' AS kind, parent_pos, i AS child_pos FROM e)"""


def _p5_table_sql(kind: str) -> str:
    source, parent, child = {"BioSample": ("s2", "-1", "sample_pos"), "Evidence": ("e", "parent_pos", "i")}.get(kind, (f"t{kind}", "sample_pos", "i"))
    fields = nested.SAMPLE if kind == "BioSample" else nested.EVIDENCE if kind == "Evidence" else nested.CHILDREN[kind][1]
    members = ", ".join("json_extract_string(v, '{}') AS {}".format(path.replace("['$t']", '."$t"'), name) for name, path in fields.items())
    return f"{_p5_ctes()} SELECT raw_id, CAST(sample_pos AS INTEGER) AS sample_pos, CAST({parent} AS INTEGER) AS parent_pos, CAST({child} AS INTEGER) AS child_pos, {members} FROM {source}"


SQL = {"p2_found": _CELLS + "SELECT accession, attribute, attr_id FROM best", "p2_wide": _wide_sql(), "p5_found": _p5_sql()} | {f"p5_table_{k.lower()}": _p5_table_sql(k) for k in nested.KINDS}
