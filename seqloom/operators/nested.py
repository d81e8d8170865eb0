"""Deeply nested JSON texts into related flat tables.

A text is parsed once into a VARIANT. One projection of nested transform calls attaches the document
id, the positions of all ancestors and the object's own position to each object; flatten combines
the arrays of arrays; each target table is one inline over its array. No row is shuffled.

Defined results: a null, empty, incomplete or otherwise invalid text gives no row; a text that is a
JSON string holding JSON is read as the JSON it holds; an object that stands
alone instead of in an array has position 0; elements that aren't objects give no row but count for
positions; a member of another shape than expected is null; repeated texts give repeated rows under
their own document id; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table name: (path below the sample, fields as (column, path below the object)).
CHILDREN = {
    "Id": ("$.Ids.Id", {"db": "$.db", "db_label": "$.db_label", "is_primary": "$.is_primary", "value": "$['$t']"}),
    "Contact": ("$.Owner.Contacts.Contact", {"first_name": "$.Name.First", "last_name": "$.Name.Last", "lab": "$.lab", "email": "$.email"}),
    "Link": ("$.Links.Link", {"type": "$.type", "label": "$.label", "target": "$.target", "value": "$['$t']"}),
    "Attribute": ("$.Attributes.Attribute", {"attribute_name": "$.attribute_name", "harmonized_name": "$.harmonized_name", "display_name": "$.display_name", "value": "$['$t']"}),
}
SAMPLE = {"id": "$.id", "accession": "$.accession", "access": "$.access", "submission_date": "$.submission_date", "title": "$.Description.Title", "taxonomy_id": "$.Description.Organism.taxonomy_id", "taxonomy_name": "$.Description.Organism.taxonomy_name", "owner_name": "$.Owner.Name", "status": "$.Status.status"}
EVIDENCE = {"source": "$.source", "value": "$['$t']"}
KINDS = ("BioSample", *CHILDREN, "Evidence")


def alone(text: Column) -> Column:
    """The text as VARIANT if it is one JSON value. What follows a value is ignored by try_parse_json(),
    so the text is read as the only element of an array."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(F.try_variant_get(listed, "$[1]", "variant").isNull(), F.try_variant_get(listed, "$[0]", "variant"))


def opened(df: DataFrame) -> DataFrame:
    """df's column doc (text) as column json (VARIANT), null unless doc is one JSON object, or a JSON string that holds one.

    A stray closing bracket could end the array of alone() early: an object's last letter must be a
    brace, and where a bracket precedes it the text must also be readable as an object's only member.
    """
    text = F.regexp_replace("doc", r"^\s+|\s+$", "")
    df = df.select("*", text.alias("trim")).drop("doc")
    inner = F.regexp_replace(F.try_variant_get(alone(F.col("trim")), "$", "string"), r"^\s+|\s+$", "")
    df = df.withColumn("doc", F.when(F.startswith("trim", F.lit('"')), inner).otherwise(F.col("trim"))).drop("trim")
    member = F.try_parse_json(F.concat(F.lit('{"v":'), F.col("doc"), F.lit("}"))).isNotNull()
    whole = F.col("doc").rlike(r"(?s)^\{.*\}$") & (~F.col("doc").rlike(r'\][^\[\]{}"]*\}$') | member)
    return df.withColumn("json", F.when(whole, alone(F.col("doc"))))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<>").isNotNull()  # reads no member


def objects(value: Column, path: str) -> Column:
    """array<struct<pos, v>> of the JSON objects at path, in an array or standing alone."""
    many = F.try_variant_get(value, path, "array<variant>")
    one = F.try_variant_get(value, path, "variant")
    every = F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))
    placed = F.transform(every, lambda v, i: F.struct(i.alias("pos"), v.alias("v")))
    return F.filter(placed, lambda x: is_object(x["v"]))


def fields(value: Column, wanted: dict[str, str], members: bool) -> list[Column]:
    if not members:
        return []
    return [F.try_variant_get(value, path, "string").alias(name) for name, path in wanted.items()]


def projected(df: DataFrame, doc: str = "doc", doc_id: str = "raw_id", members: bool = True) -> DataFrame:
    """doc_id and one array column per target table, each element with its ancestors' positions and, on request, its members."""
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # of equal members the last counts, as in other readers
    texts = df.select(F.col(doc_id), F.col(doc).alias("doc")).where("doc is not null")
    # the explode of one element keeps the parsed value from being put into each place that reads it, and parsed there again
    whole = opened(texts).select(doc_id, F.explode(F.array("json")).alias("json")).where("json is not null")
    samples = whole.select(doc_id, objects(F.col("json"), "$.BioSampleSet.BioSample").alias("samples"))

    def children(path: str, wanted: dict[str, str], keep: bool) -> Column:
        def of_sample(s: Column) -> Column:
            def row(c: Column) -> Column:
                return F.struct(s["pos"].alias("sample_pos"), s["pos"].alias("parent_pos"), c["pos"].alias("child_pos"), *fields(c["v"], wanted, members), *([c["v"].alias("v")] if keep else []))

            return F.transform(objects(s["v"], path), row)

        return F.flatten(F.transform("samples", of_sample))

    def evidence(a: Column) -> Column:
        def row(e: Column) -> Column:
            return F.struct(a["sample_pos"].alias("sample_pos"), a["child_pos"].alias("parent_pos"), e["pos"].alias("child_pos"), *fields(e["v"], EVIDENCE, members))

        return F.transform(objects(a["v"], "$.Evidence"), row)

    own = F.transform("samples", lambda s: F.struct(s["pos"].alias("sample_pos"), F.lit(-1).alias("parent_pos"), s["pos"].alias("child_pos"), *fields(s["v"], SAMPLE, members)))
    tables = samples.select(doc_id, own.alias("BioSample"), *[children(p, f, k == "Attribute").alias(k) for k, (p, f) in CHILDREN.items()])
    return tables.withColumn("Evidence", F.flatten(F.transform("Attribute", evidence)))


def flat_tables(df: DataFrame, doc: str = "doc", doc_id: str = "raw_id") -> dict[str, DataFrame]:
    """A flat table per kind; (doc_id, sample_pos, parent_pos) link a row to its parent."""
    arrays = projected(df, doc, doc_id)
    return {k: arrays.select(doc_id, F.inline(k)).drop("v") for k in KINDS}


def object_keys(df: DataFrame, doc: str = "doc", doc_id: str = "raw_id") -> DataFrame:
    """(doc_id, sample_pos, kind, parent_pos, child_pos) of every object of all target tables, in one pass."""
    arrays = projected(df, doc, doc_id, members=False)

    def key(kind: str):
        return lambda x: F.struct(x["sample_pos"].alias("sample_pos"), F.lit(kind).alias("kind"), x["parent_pos"].alias("parent_pos"), x["child_pos"].alias("child_pos"))

    return arrays.select(doc_id, F.inline(F.concat(*[F.transform(k, key(k)) for k in KINDS])))
