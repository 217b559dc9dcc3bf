"""Cases that earlier rules cut short or failed on."""

import pytest
from pyspark.sql import functions as F

from starloom.functions.values import numeric_value
from starloom.operators.analytics import as_of_table
from starloom.operators.charts import associate, bar
from starloom.operators.classify import table_roles
from starloom.operators.graph import connected_components
from starloom.operators.links import dedupe_names


def names_of(spark, names):
    rows = [("t", 0, k, n) for k, n in enumerate(names)]
    out = dedupe_names(spark.createDataFrame(rows, "table string, tidx int, pos int, canonical string"))
    assert out.columns == ["table", "tidx", "pos", "canonical"]
    return [r.canonical for r in out.orderBy("pos").collect()]


def test_dedupe_names_takes_the_next_free_number(spark):
    assert names_of(spark, ["a", "a_1", "a"]) == ["a", "a_1", "a_2"]
    assert names_of(spark, ["a", "A", "b"]) == ["a", "A_1", "b"]
    many = names_of(spark, ["a", "a", "a_1", "a_1_1", "a_1_1_1", "a_1_1_1_1"])
    assert len({n.lower() for n in many}) == len(many)


def test_components_of_a_long_chain(spark):
    n = 12
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(n)], "node string")
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(n - 1)], "a string, b string")
    assert {r.component for r in connected_components(nodes, edges).collect()} == {"n000"}


def test_long_hex_and_bad_dates_do_not_fail(spark):
    df = spark.createDataFrame([("0xFFFFFFFFFFFFFFFFFFFF",), ("0x10",), ("1e3",), ("x",)], "v string")
    assert [r[0] for r in df.select(numeric_value(F.col("v"))).collect()] == [float(16**20), 16.0, 1000.0, None]
    dates = spark.createDataFrame([("31/12/2020",), ("2020-12-31",)], "d string")
    assert as_of_table(dates, "d", 1).where("`Period Type` = 'Current Day'").count() == 1


def test_unlinked_tables_and_pages(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        associate([a, b])
    wide = spark.range(700).withColumnRenamed("id", "k")
    assert bar(wide, ["k"], {"n": F.count("*")}).count() == 700
    assert bar(wide, ["k"], {"n": F.count("*")}, page=500).count() == 500


def test_fact_rows_is_an_argument():
    assert "fact_rows" in table_roles.__annotations__


def test_conform_group_takes_the_links_of_its_slices(spark, monkeypatch):
    from tests.conftest import SF_SMALL
    from starloom.operators import links as lk
    from starloom.plans import queries as q

    seen, normalize = [], lk.normalize_names
    monkeypatch.setattr(lk, "normalize_names", lambda fields, links: seen.append(links.count()) or normalize(fields, links))
    rows = q.q_conform_group(spark, SF_SMALL).collect()
    assert seen and seen[-1] > 0
    names = {(r["table"], r["field"]): r["canonical"] for r in rows}
    shared = {f for t, f in names if t == "orders_late"}
    assert shared and all(names["orders_early", f] == names["orders_late", f] for f in shared)
