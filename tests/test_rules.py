"""Rules that the driver tables never meet: pairs by alias, synthetic keys,
ambiguous flags, name clashes, chart pages and orders."""

from pyspark.sql import functions as F

from starloom.operators import build as bd
from starloom.operators import charts as ch
from starloom.operators import enrich as en
from starloom.operators import graph as gr
from starloom.operators import links as lk
from starloom.operators import overlap as ov


def test_pairs_by_alias(spark):
    fields = spark.createDataFrame(
        [(0, "A", 0, "cust", "IDENTIFIER", "Client", 3), (1, "B", 0, "buyer", "ATTRIBUTE", "Client", 2), (2, "C", 0, "x", "MEASURE", "Client", 2),
         (3, "D", 0, "who", "IDENTIFIER", "Client", 1)],
        "tidx int, table string, pos int, field string, type string, alias string, distinctCount long",
    )
    cells = [(0, 0, "1"), (0, 0, "2"), (0, 0, "3"), (1, 0, "2"), (1, 0, "9"), (2, 0, "2"), (3, 0, "7")]
    values = spark.createDataFrame(cells, "tidx int, pos int, value string")
    none = spark.createDataFrame([], "tableA string, fieldA string, tableB string, fieldB string")
    got = ov.alias_overlap(values, fields, none).collect()
    assert [(r.tableA, r.tableB, r.intersectionCount, r.overlapRatioB, r.discoveredBy) for r in got] == [("A", "B", 1, 0.5, "AI_INTENT")]
    known = spark.createDataFrame([("B", "buyer", "A", "cust")], none.schema)
    assert ov.alias_overlap(values, fields, known).isEmpty()


def test_synthetic_keys(spark):
    rows = [(0, "A", "x"), (0, "A", "y"), (1, "B", "x"), (1, "B", "y"), (2, "C", "x"), (2, "C", "z")]
    got = gr.synthetic_keys(spark.createDataFrame(rows, "tidx int, table string, field string")).collect()
    assert [(r.tableA, r.tableB, r.fieldSet) for r in got] == [("A", "B", "x|y")]


def test_ambiguous_flags(spark):
    rows = [("M", "paid", "x", "t"), ("F", "open", "y", "u")]
    meta = en.live_metadata({"t": spark.createDataFrame(rows, "gender string, status string, id string, more string")})
    assert {r.field for r in en.flag_candidates(meta).collect()} == {"status", "id"}  # y is a flag value
    assert {r.field for r in en.ambiguous_flags(meta).collect()} == {"gender", "more"}


def test_clashing_names_are_numbered(spark):
    rows = [("T", 0, "Name"), ("T", 1, "name"), ("T", 2, "name_1"), ("T", 3, "NAME"), ("U", 0, "name")]
    got = lk.dedupe_names(spark.createDataFrame(rows, "table string, pos int, canonical string")).collect()
    assert sorted((r.table, r.pos, r.canonical) for r in got) == [
        ("T", 0, "Name"), ("T", 1, "name_1"), ("T", 2, "name_1_1"), ("T", 3, "NAME_2"), ("U", 0, "name"),
    ]


def test_chart_page_and_order(spark):
    df = spark.createDataFrame([("b", 1), ("a", 5), ("c", 5), ("d", None), (None, 9)], "k string, v int")
    total = {"v": F.sum("v")}
    assert [r.k for r in ch.bar(df, ["k"], total).collect()] == ["a", "b", "c", "d"]
    assert [tuple(r) for r in ch.bar(df, ["k"], total, order_by="measure", page=2).collect()] == [("a", 5), ("c", 5)]
    wide = {f"m{i}": F.sum("v") for i in range(20)}
    assert len(ch.bar(df, ["k"], wide, max_columns=None).columns) == 21
    try:
        ch.bar(df, ["k"], wide)
        raise AssertionError("a page of 17 columns was passed")
    except ValueError as e:
        assert "17" in str(e)


def test_dropped_fields_and_distinct_grains(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, ""), ("", None)], "x string, y string")
    assert bd.drop_fields(df, ["y", "nothing"]).columns == ["x"]
    keyed = bd.composite_keys({"f": df}, {"f": ["x", "y"]}, mode="hash")["f"]
    assert keyed.select("`%Key_f`").distinct().count() == 4
