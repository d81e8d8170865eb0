"""Entity, attribute, value rows into one typed row per entity.

The rows are read once, resolved to (entity, attribute, readable value) and written partitioned by
attribute. Each attribute then is a narrow typed table, hash-partitioned by entity, reduced to its
latest readable row per entity. The narrow tables are combined by left outer joins onto the spine of
all entities, in groups of fan_in, and the groups by a balanced tree of joins. Left and inner joins
keep the hash partitioning of the entity, so that no result of a join is shuffled again; a full
outer join would lose it at each level.

Defined results: a null or blank entity is no entity; rows of attributes outside the list are left
out; a null or unreadable value never fills a cell; an entity without any filled cell has a row of
nulls; of equal loaded_at the largest row id wins, null loaded_at counts as the earliest; repeated
rows change nothing; an empty input gives an empty table with all columns; other columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.runtime import small_or_plain, written

#: Three-letter English months in order.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()

NUMBER = r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?)\s*[\p{L}%/°]*$"
WHOLE = r"^([+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+))\s*[\p{L}%/°]*$"
SPARK_TYPE = {"text": "string", "double": "double", "int": "bigint", "date": "date"}


def letters_digits(c: Column) -> Column:
    """Only the letters and digits of a text, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def as_number(text: Column, pattern: str, kind: str) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), "[,+]", "")
    return F.when(digits != "", digits).try_cast(kind)


def as_date(text: Column) -> Column:
    """year-month-day, year/month/day, day.month.year or day, month name and year; null if no such day exists."""
    ymd = F.coalesce(*[
        F.when(text.rlike(p), F.array(*[F.regexp_extract(text, p, k) for k in order]))
        for p, order in (
            (r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", (1, 2, 3)),
            (r"^([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})$", (1, 2, 3)),
            (r"^([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4})$", (3, 2, 1)),
            (r"^([0-9]{1,2})[- ]([A-Za-z]{3})[- ]([0-9]{4})$", (3, 2, 1)),
        )
    ])
    months = F.array(*[F.lit(m) for m in MONTHS])
    month = F.when(ymd[1].rlike("^[0-9]+$"), ymd[1]).otherwise(F.array_position(months, F.lower(ymd[1])).cast("string"))
    return F.concat(ymd[0], F.lit("-"), F.lpad(month, 2, "0"), F.lit("-"), F.lpad(ymd[2], 2, "0")).try_cast("date")


def typed(text: Column, kind: str) -> Column:
    """The value of a trimmed, non-missing text as kind; null if it can't be read so."""
    if kind == "double":
        return as_number(text, NUMBER, "double")
    if kind == "int":
        return as_number(text, WHOLE, "bigint")
    return as_date(text) if kind == "date" else text


def readable(text: Column, kind: Column) -> Column:
    """Whether the text can be read as the type named by kind. Numbers beyond the type's range count as read."""
    return (
        F.when(kind == "double", text.rlike(NUMBER))
        .when(kind == "int", text.rlike(WHOLE))
        .when(kind == "date", as_date(text).isNotNull())
        .otherwise(F.lit(True))
    )


def attribute_list(types: DataFrame, max_attributes: int = 2000) -> list[tuple[str, str, str]]:
    """(key, attribute, type) of the wide table's columns, a list that must fit a table's width."""
    rows = types.where(F.col("attribute").isNotNull()).select("attribute", "value_type").limit(max_attributes + 1).collect()
    if len(rows) > max_attributes:
        raise ValueError(f"more than {max_attributes} attributes can't be columns of one table")
    found: dict[str, tuple[str, str, str]] = {}
    for r in sorted(rows, key=lambda r: (r["attribute"], r["value_type"] or "")):
        key = "".join(ch for ch in r["attribute"] if ch.isalnum()).lower()
        found.setdefault(key, (key, r["attribute"], r["value_type"] if r["value_type"] in SPARK_TYPE else "text"))
    return list(found.values())


def resolved(rows: DataFrame, listed: list[tuple[str, str, str]], missing: DataFrame, entity: str, name: str, value: str, latest: str, row_id: str) -> DataFrame:
    """(entity, attribute, value, latest, row_id) of the rows that can fill a cell."""
    spark = rows.sparkSession
    names = spark.createDataFrame([*listed], "key string, attribute string, kind string")
    words = missing.select(letters_digits(F.col("word")).alias("flat")).where("flat is not null").distinct()
    text = trimmed(F.col(value))
    cells = (
        rows.select(F.upper(trimmed(F.col(entity))).alias("entity"), letters_digits(F.col(name)).alias("key"), text.alias("value"), letters_digits(F.col(value)).alias("flat"), F.col(latest).alias("latest"), F.col(row_id).alias("row_id"))
        .where("entity <> '' and flat <> ''")
        .join(F.broadcast(names), "key")
        .where(readable(F.col("value"), F.col("kind")))
        .join(small_or_plain(words), "flat", "left_anti")
    )
    return cells.select("entity", "value", "latest", "row_id", "attribute")


def wide_table(rows: DataFrame, types: DataFrame, missing: DataFrame, entity: str = "accession", name: str = "attribute_name", value: str = "t_value", latest: str = "loaded_at", row_id: str = "attr_id", provenance: bool = False, fan_in: int = 4) -> DataFrame:
    """One row per entity with one typed column per listed attribute.

    With provenance each attribute has a second column, its name followed by __row, with the id of
    the row that its cell is taken from.
    """
    listed = attribute_list(types)
    spine = rows.select(F.upper(trimmed(F.col(entity))).alias("entity")).where("entity <> ''").distinct()
    best = F.max_by(F.struct("value", "row_id"), F.struct("latest", "row_id"))
    one = resolved(rows, listed, missing, entity, name, value, latest, row_id).groupBy("entity", "attribute").agg(best.alias("best"))
    cells = written(one.hint("rebalance", "attribute"), "cells", ["attribute"])  # few files an attribute, large attributes split

    def narrow(attribute: str, kind: str) -> DataFrame:
        row = [F.col("best.row_id").alias(f"{attribute}__row")] if provenance else []
        return cells.where(F.col("attribute") == attribute).select("entity", typed(F.col("best.value"), kind).alias(attribute), *row)

    groups = []
    for k in range(0, len(listed), fan_in):
        group = spine
        for _, attribute, kind in listed[k : k + fan_in]:
            group = group.join(narrow(attribute, kind), "entity", "left")
        groups.append(group)
    while len(groups) > 1:
        groups = [groups[k].join(groups[k + 1], "entity") if k + 1 < len(groups) else groups[k] for k in range(0, len(groups), 2)]
    return (groups[0] if groups else spine).withColumnRenamed("entity", entity)


def filled_cells(rows: DataFrame, types: DataFrame, missing: DataFrame, **names: str) -> DataFrame:
    """(entity, attribute, row id) of each filled cell of the wide table."""
    entity, row_id = names.get("entity", "accession"), names.get("row_id", "attr_id")
    wide = wide_table(rows, types, missing, provenance=True, **names)
    attributes = [a for _, a, _ in attribute_list(types)]
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"`{a}__row`").alias(row_id)) for a in attributes])
    return wide.select(entity, F.inline(pairs)).where(F.col(row_id).isNotNull())
