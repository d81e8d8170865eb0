"""Metadata of reads (map<string,string>) and plain tables.

A read without metadata, or without a key, has NA at sinks and null inside. Key tables are broadcast
if shown to be small and joined by shuffle otherwise; repeated keys in them give repeated rows unless
said otherwise. Column names that clash are prefixed. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import small_or_plain


def get(key: str, default: str | None = None) -> Column:
    value = F.try_element_at("meta", F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


def from_name(df: DataFrame) -> DataFrame:
    """meta: the [key=value;…] part of the name, over what meta holds already; name without it."""
    inner = F.regexp_extract("name", r"\[([^\[\]]*=[^\[\]]*)\]", 1)
    pairs = F.filter(F.split(F.regexp_replace(inner, ";+$", ""), ";"), lambda p: p.contains("="))
    none = F.create_map().cast("map<string,string>")

    def put(m: Column, p: Column) -> Column:
        key, value = F.substring_index(p, "=", 1), F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))
        return F.map_concat(F.map_filter(m, lambda k, v: k != key), F.create_map(key, value))

    base = F.coalesce("meta", none) if "meta" in df.columns else none
    df = df.withColumns({"_base": base, "_own": F.aggregate(pairs, none, put)})  # as columns: a lambda inside another one's lambda would capture its variables
    kept = F.map_filter("_base", lambda k, v: ~F.array_contains(F.map_keys("_own"), k))
    both = df.withColumns({"meta": F.map_concat(kept, "_own"), "name": F.regexp_replace("name", r"\[[^\[\]]*=[^\[\]]*\]", "")})
    return both.withColumn("meta", F.coalesce("meta", "_base")).drop("_base", "_own")


def to_name(df: DataFrame) -> DataFrame:
    """name with its metadata as [key=value;…], keys in order."""
    entries = F.transform(F.array_sort(F.map_keys("meta")), lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("meta", k), F.lit("NA"))))
    return df.withColumn("name", F.when(F.size("meta") > 0, F.concat("name", F.lit("["), F.array_join(entries, ";"), F.lit("]"))).otherwise(F.col("name")))


def joined(df: DataFrame, table: DataFrame, table_key: str, key: Column, overwrite: bool = False) -> DataFrame:
    """meta with the other columns of the row of a key table; of several rows of a key one with the least values."""
    others = [c for c in table.columns if c != table_key]
    rows = table.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias("_k")).agg(F.min(F.struct(*[F.col(c).cast("string").alias(c) for c in others])).alias("_r"))
    extra = F.map_filter(F.create_map(*[x for c in others for x in (F.lit(c), F.col("_r")[c])]), lambda _, v: v.isNotNull())
    base = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    low, high = (base, extra) if overwrite else (extra, base)
    kept = F.map_filter(low, lambda k, _: ~F.array_contains(F.map_keys(high), k))
    both = df.withColumn("_k", key).join(small_or_plain(rows), "_k", "left")
    return both.withColumn("meta", F.when(F.col("_r").isNull(), base).otherwise(F.map_concat(kept, high))).drop("_k", "_r")


def flag_numeric(df: DataFrame, key: str, value: float, above: bool = False) -> DataFrame:
    """include: the number is above the value (or below it, with above); without one the read is included."""
    n = get(key).try_cast("double")
    return df.withColumn("include", F.coalesce(n < value if above else n > value, F.lit(True)))


def flag_matching(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.withColumn("include", ~F.coalesce(get(key).isin(*values), F.lit(False)))


def selected(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("meta", F.create_map(*[x for k in keys for x in (F.lit(k), get(k, "NA"))]))


def groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """part: the values of keys joined by _, the column to partition a sink by."""
    return df.withColumn("part", F.concat_ws("_", *[get(k, "NA") for k in keys]))


def as_table(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select("rowid", "name", *[get(k, "NA").alias(k) for k in keys], "seq")


def keys_of(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.map_keys("meta")).alias("key")).distinct()


# --- tables


def shared_lines(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): only_first, only_second, same or different; rows without a key are left out."""
    x, y = (t.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(value).alias(n)) for t, n in ((a, "va"), (b, "vb")))
    x, y = x.withColumn("ia", F.lit(True)), y.withColumn("ib", F.lit(True))
    status = F.when(F.col("ib").isNull(), "only_first").when(F.col("ia").isNull(), "only_second").when(F.col("va").eqNullSafe(F.col("vb")), "same").otherwise("different")
    return x.join(y, "key", "full").select("key", status.alias("status"))


def separated(df: DataFrame, column: str, sep: str, prepend: str = "", append: str = "") -> DataFrame:
    """One row per part of a column; prepend goes before all but the first, append after all but the last."""
    parts = F.split(F.col(column), f"\\Q{sep}\\E")
    rows = df.withColumn("_m", F.size(parts)).select("*", F.posexplode(parts).alias("_k", "_p"))
    text = F.concat(F.when(F.col("_k") > 0, F.lit(prepend)).otherwise(F.lit("")), "_p", F.when(F.col("_k") < F.col("_m") - 1, F.lit(append)).otherwise(F.lit("")))
    return rows.withColumn(column, text).withColumnRenamed("_k", "part").drop("_m", "_p")


def presence_matrix(df: DataFrame, row: str, column: str, value: str, cutoff: float, most: int = 5000) -> DataFrame:
    """0/1 columns (column_value) for each value of a column whose rows reach the cut-off, and a last row 'total' of sums."""
    kept = df.where(F.col(value) >= cutoff)
    names = [r[0] for r in kept.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} values can't be columns")
    wide = kept.groupBy(F.col(row).cast("string").alias(row)).pivot(column, names).agg(F.first(F.lit(1)))
    wide = wide.toDF(row, *[f"{column}_{n}" for n in names])
    names = wide.columns[1:]
    wide = wide.select(row, *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("bigint").alias(n) for n in names])
    total = wide.agg(*[F.coalesce(F.sum(f"`{n}`"), F.lit(0)).alias(n) for n in names]).select(F.lit("total").alias(row), *[F.col(f"`{n}`") for n in names])
    return wide.unionByName(total)


def json_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """value: a member of each JSON text; null where the text or the member is missing or broken."""
    return df.withColumn("value", F.try_variant_get(F.try_parse_json(column), f"$.{field}", "string"))


def json_matching(df: DataFrame, column: str, field: str, values: list[str]) -> DataFrame:
    return json_field(df, column, field).where(F.col("value").isin(*values)).drop("value")
