"""Join paths of a model and charts asked of it."""

import pytest
from pyspark.sql import functions as F

from starloom.operators import charts as ch
from starloom.operators.association import ChartModel, Graph, Measure


@pytest.fixture(scope="module")
def model(spark):
    """Orders with lines, two ways from a line to a nation, an island."""
    make = spark.createDataFrame
    return ChartModel({
        "line": make([(1, "p1", "s1", 10), (1, "p2", "s1", 20), (1, "p1", "s2", 5), (2, "p1", "s2", 7), (3, None, "s2", 1), (None, "p2", "s1", 2)],
                     "ord int, part string, sup string, price int"),
        "orders": make([(1, "c1", 100), (2, "c2", 200), (3, "c1", 300), (4, "c3", 400), (5, None, 50)], "ord int, cust string, total int"),
        "customer": make([("c1", 1, "x"), ("c2", 2, "y"), ("c3", None, "z")], "cust string, nat int, cname string"),
        "supplier": make([("s1", 2), ("s2", 1)], "sup string, nat int"),
        "nation": make([(1, "N1"), (2, "N2")], "nat int, nname string"),
        "part": make([("p1", "red"), ("p2", "red"), ("p3", "blue")], "part string, colour string"),
        "island": make([("i",)], "alone string"),
    })


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_staged_sums_along_the_smallest_tree(model):
    price = {"price": Measure("sum", "price"), "n": Measure("count", table="line")}
    assert rows(ch.bar(model, ["nname"], price)) == [("N1", 13, 3), ("N2", 32, 3)]  # by the supplier
    assert rows(ch.bar(model, ["nname"], price, via=["customer", "orders"])) == [("N1", 36, 4), ("N2", 7, 1)]
    assert rows(ch.bar(model, ["cname"], {"total": Measure("sum", "total")})) == [("x", 400), ("y", 200), ("z", 400)]
    # a linking field as dimension, and one that the measure's table has
    assert rows(ch.bar(model, ["cust"], {"t": Measure("max", "total")})) == [("c1", 300), ("c2", 200), ("c3", 400)]
    assert rows(ch.bar(model, ["part"], {"n": Measure("count", "price")})) == [("p1", 3), ("p2", 2)]


def test_a_row_counts_once_for_a_value(model):
    """Order 1 has three lines, two parts, one colour."""
    total = {"total": Measure("sum", "total"), "n": Measure("count", table="orders")}
    assert rows(ch.bar(model, ["colour"], total)) == [("red", 300, 2)]
    assert rows(ch.bar(model, ["part"], total)) == [("p1", 300, 2), ("p2", 100, 1)]
    assert rows(ch.table_view(model, ["colour", "cname"], total)) == [("red", "x", 100, 1), ("red", "y", 200, 1)]
    # customers by colour: through orders and lines, both many to one customer
    assert rows(ch.bar(model, ["colour"], {"customers": Measure("count", table="customer")}, via=["orders"])) == [("red", 2)]


def test_all_kinds_of_measures(model):
    found = rows(ch.table_view(model, ["nname"], {
        "low": Measure("min", "price"), "high": Measure("max", "price"), "mean": Measure("avg", "price"),
        "parts": Measure("count_distinct", "part", "line"), "twice": Measure("sum", F.col("price") * 2, "line"),
    }))
    assert found == [("N1", 1, 7, 13 / 3, 1, 26), ("N2", 2, 20, 32 / 3, 2, 64)]


def test_measures_of_several_tables(model):
    found = rows(ch.bar(model, ["cust"], {"total": Measure("sum", "total"), "price": Measure("sum", "price")}))
    assert found == [("c1", 400, 36), ("c2", 200, 7), ("c3", 400, None)]
    one = ch.kpi(model, {"total": Measure("sum", "total"), "lines": Measure("count", table="line"), "parts": Measure("count_distinct", "part", "line"),
                         "mean": Measure("avg", "price")}).collect()
    assert [tuple(r) for r in one] == [(1050, 6, 2, 45 / 6)]


def test_line_of_a_model(model):
    found = rows(ch.line(model, "cname", {"total": Measure("sum", "total")}, series="nname", max_lines=1).select("cname", "nname", "total"))
    assert found == [("x", "N1", 400)]


def test_refusals(model):
    price = {"price": Measure("sum", "price")}
    with pytest.raises(ValueError, match="two paths are equally good"):
        ch.bar(model, ["colour"], {"customers": Measure("count", table="customer")})
    with pytest.raises(ValueError, match="customer is not between"):  # it hangs on the nearer path
        ch.bar(model, ["nname"], price, via=["customer"])
    with pytest.raises(ValueError, match="no path links"):
        ch.bar(model, ["alone"], price)
    with pytest.raises(ValueError, match="no table has"):
        ch.bar(model, ["nothing"], price)
    with pytest.raises(ValueError, match="is not between"):
        ch.bar(model, ["cname"], {"t": Measure("sum", "total")}, via=["part"])
    with pytest.raises(ValueError, match="name the measure's table"):
        ch.bar(model, ["cname"], {"n": Measure("count", "part")})
    with pytest.raises(ValueError, match="needs its table"):
        Measure("sum", F.lit(1))
    with pytest.raises(ValueError, match="a measure is one of"):
        Measure("median", "price")


def test_smallest_trees():
    graph = Graph({"f": ["a", "b", "m"], "x": ["a", "u"], "y": ["b", "v"], "z": ["u", "v", "d"], "w": ["d", "e"]})
    tables = lambda ends: {t for (_, t), _ in graph.smallest_tree(ends)}
    assert tables([("table", "f"), graph.node("m")]) == set()
    assert tables([("table", "f"), graph.node("u")]) == {"f", "x"}
    assert tables([("table", "x"), graph.node("e")]) == {"x", "z", "w"}
    with pytest.raises(ValueError, match="equally good"):
        graph.smallest_tree([("table", "f"), graph.node("d")])
    assert tables([("table", "f"), ("table", "x"), graph.node("d")]) == {"f", "x", "z"}
    # three tables of one field have one tree, not three
    star = Graph({"a": ["k", "p"], "b": ["k", "q"], "c": ["k", "r"]})
    assert len(star.smallest_tree([star.node("p"), star.node("q"), star.node("r")])) == 3
