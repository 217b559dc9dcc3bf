"""Model building: keys, link table, bridge, calendar, concatenation."""

import datetime as dt

from pyspark.sql import functions as F

from starloom.operators import build as bd


def test_two_facts_same_grain_get_different_keys(spark):
    a = spark.createDataFrame([(1, 2), (1, 3)], "custkey int, partkey int")
    b = spark.createDataFrame([(1, 2)], "custkey int, partkey int")
    keyed = bd.composite_keys({"A": a, "B": b}, {"A": ["custkey", "partkey"], "B": ["custkey", "partkey"]})
    ka = {r["%Key_A"] for r in keyed["A"].collect()}
    kb = {r["%Key_B"] for r in keyed["B"].collect()}
    assert len(ka) == 2 and len(kb) == 1 and not (ka & kb)
    assert ka | kb == {1, 2, 3}


def test_link_table_does_not_multiply(spark):
    dup = spark.createDataFrame([(1, 1, 5.0, "x"), (1, 1, 7.0, "x"), (2, 1, 1.0, "y")], "k1 int, k2 int, amount double, d1 string")
    other = spark.createDataFrame([(1, 9)], "k1 int, z int")
    keyed = bd.composite_keys({"F": dup, "G": other}, {"F": ["k1", "k2"], "G": ["k1"]})
    link = bd.link_table(keyed, ["k1"])
    assert link.where(F.col("%LinkTable_SourceTable") == "F").count() == 2  # distinct, not 3
    assert set(link.columns) == {"%LinkTable_SourceTable", "%Key_F", "%DateBridgeKey", "k1", "%Key_G"}


def test_bridge_drops_null_keys_and_reads_facts(spark):
    f = spark.createDataFrame([(1, dt.date(2022, 1, 1)), (None, dt.date(2022, 1, 2))], "id int, d date")
    keyed = {"F": f.withColumn("%Key_F", F.col("id"))}
    br = bd.date_bridge(keyed, [("F", "d")])
    rows = br.collect()
    assert len(rows) == 1 and rows[0]["DateType"] == "d" and rows[0]["CanonicalDate"] == dt.date(2022, 1, 1)


def test_calendar_edges(spark):
    days = [dt.date(2022, 1, 1), dt.date(2022, 1, 2), dt.date(2022, 1, 30), dt.date(2000, 2, 29),
            dt.date(2000, 3, 31), dt.date(2000, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "CanonicalDate date")
    cal = bd.relative_deltas(bd.master_calendar(df), "2022-01-30")
    r = {x["CanonicalDate"]: x for x in cal.collect()}
    assert r[dt.date(2022, 1, 1)]["Week"] == 1  # Saturday: first, broken week
    assert r[dt.date(2022, 1, 2)]["Week"] == 2  # Sunday starts week 2
    assert r[dt.date(2022, 1, 30)]["Week"] == 6
    assert r[dt.date(2022, 1, 30)]["Week Diff"] == 0
    assert r[dt.date(2000, 12, 31)]["Quarter"] == "Q4"
    assert r[dt.date(2000, 2, 29)]["MonthYear"] == "Feb-2000"
    assert r[dt.date(2022, 1, 1)]["Date Diff"] == -29
    assert r[dt.date(2000, 3, 31)]["Month Diff"] == (2000 - 2022) * 12 + (3 - 1)


def test_concatenate_pads_and_tags(spark):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2,)], "k int")
    u = bd.concatenate({"a": a, "b": b}, "%T_SourceTable")
    rows = sorted(u.collect(), key=lambda r: r["k"])
    assert rows[1]["s"] is None and rows[1]["%T_SourceTable"] == "b"
