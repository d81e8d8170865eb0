import datetime
import json

import pytest
from pyspark.sql import functions as F

from seqloom.operators import nested, wide

ATTR = "attr_id long, accession string, attribute_name string, t_value string, loaded_at timestamp, entity string, value string"
T = [datetime.datetime(2024, 1, d) for d in range(1, 10)]


@pytest.fixture(scope="module")
def lists(spark):
    types = spark.createDataFrame([("host", "text"), ("host_age", "int"), ("depth", "double"), ("collection_date", "date"), ("odd", None)], "attribute string, value_type string")
    return types, spark.createDataFrame([("n/a",), ("missing",), (None,)], "word string")


def rows(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], ATTR)


def test_cells_take_the_latest_readable_row(spark, lists):
    data = rows(spark, [
        (1, " sb1 ", "Host", "cow", T[0]), (2, "SB1", "ho-st", "pig", T[3]), (3, "SB1", "HOST", "N.A.", T[5]), (4, "SB1", "host", "hen", T[3]),
        (5, "SB1", "hostAge", "1,200 yr", T[0]), (6, "SB1", "host age", "12.5", T[4]), (7, "SB1", "depth", "-3.5 m/s", T[0]), (8, "SB1", "depth", "3.5 4", T[2]),
        (9, "SB1", "collection date", "29-feb-2024", T[0]), (10, "SB1", "collection date", "30.02.2024", T[1]), (11, "SB2", "nothing", "x", T[0]),
        (12, None, "host", "x", T[0]), (13, "  ", "host", "x", T[0]), (14, "sb3", None, "x", T[0]), (15, "sb3", "host", None, T[0]), (16, "sb3", "host", "late", None), (16, "sb3", "host", "late", None),
    ])
    found = {(r.accession, r.attribute, r.attr_id) for r in wide.filled_cells(data, *lists).collect()}
    assert found == {("SB1", "host", 4), ("SB1", "host_age", 5), ("SB1", "depth", 7), ("SB1", "collection_date", 9), ("SB3", "host", 16)}
    table = {r.accession: r for r in wide.wide_table(data, *lists).collect()}
    assert set(table) == {"SB1", "SB2", "SB3"}
    assert (table["SB1"].host, table["SB1"].host_age, table["SB1"].depth, table["SB1"].collection_date) == ("hen", 1200, -3.5, datetime.date(2024, 2, 29))
    assert table["SB2"].host is None and table["SB3"].host == "late"


@pytest.mark.parametrize("text, kind, ok", [("1,234,567", "int", True), ("12,34", "int", False), ("+5%", "int", True), ("5 ° C", "double", False), ("5°C", "double", True), ("2024/2/9", "date", True), ("2024-02/09", "date", False), ("9 Foo 2024", "date", False), ("1.2.24", "date", False), ("3.", "double", False)])
def test_reading(spark, text, kind, ok):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(wide.readable(F.col("t"), F.col("k"))).first()[0] is ok


def test_wide_of_nothing(spark, lists):
    empty = rows(spark, [])
    assert wide.wide_table(empty, *lists).count() == 0
    assert set(wide.wide_table(empty, *lists).columns) == {"accession", "host", "host_age", "depth", "collection_date", "odd"}


def brute(doc):
    def objects(v):
        return [(0, v)] if isinstance(v, dict) else [(i, x) for i, x in enumerate(v) if isinstance(x, dict)] if isinstance(v, list) else []

    def get(v, *path):
        for p in path:
            v = v.get(p) if isinstance(v, dict) else None
        return v

    out = []
    for i, s in objects(get(doc, "BioSampleSet", "BioSample")):
        out.append((i, "BioSample", -1, i))
        for kind, path in (("Id", ("Ids", "Id")), ("Contact", ("Owner", "Contacts", "Contact")), ("Link", ("Links", "Link")), ("Attribute", ("Attributes", "Attribute"))):
            for c, o in objects(get(s, *path)):
                out.append((i, kind, i, c))
                out += [(i, "Evidence", c, e) for e, _ in objects(o.get("Evidence"))] if kind == "Attribute" else []
    return out


def test_nested_shapes(spark):
    docs = [
        {"BioSampleSet": {"BioSample": [{"id": 1, "Ids": {"Id": [{"$t": "a"}, 5, None, {"$t": 7}]}, "Attributes": {"Attribute": {"$t": "x", "Evidence": [{"source": "s"}, "no", {}]}}}, "no", [], {"Links": {"Link": None}, "Owner": []}]}},
        {"BioSampleSet": {"BioSample": {"Attributes": {"Attribute": [{"Evidence": {"$t": "e"}}, {"Evidence": 3}]}}}},
        {"BioSampleSet": []}, [], None, {"BioSampleSet": {"BioSample": []}}, {"BioSampleSet": {"BioSample": {}}},
    ]
    texts = [json.dumps(d) for d in docs] + [json.dumps(json.dumps(docs[0])), json.dumps(docs[0], indent=3) + "\n", json.dumps(docs[0])[:-3], json.dumps(docs[0]) + "]", json.dumps(docs[0]) + " x", "", None, '{"BioSampleSet": {"BioSample": {"id": 1, "id": 2}}}']
    expected = [brute(d) for d in docs] + [brute(docs[0]), brute(docs[0]), [], [], [], [], [], [(0, "BioSample", -1, 0)]]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "raw_id long, doc string, json string")
    found = sorted((r.raw_id, r.sample_pos, r.kind, r.parent_pos, r.child_pos) for r in nested.object_keys(df).collect())
    assert found == sorted((k, *row) for k, rows_ in enumerate(expected) for row in rows_)
    tables = nested.flat_tables(df)
    assert [r.value for r in tables["Id"].where("raw_id = 0").orderBy("child_pos").collect()] == ["a", "7"]
    assert tables["BioSample"].where("raw_id = 14").first().id == "2"
    assert nested.object_keys(df.limit(0)).count() == 0
