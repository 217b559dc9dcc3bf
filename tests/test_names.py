"""Name tokens and link scoring rules."""

from pyspark.sql import functions as F

from starloom.functions.names import name_tokens, token_subset
from starloom.operators import links as lk


def _tokens(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return {r["n"]: r["t"] for r in df.select("n", name_tokens(F.col("n")).alias("t")).collect()}


def test_tokens(spark):
    t = _tokens(spark, ["CustomerID", "Lorry_Type", "ID", "Categories", "class", "Order Number", "part-keys"])
    assert t["CustomerID"] == ["customer"]
    assert t["Lorry_Type"] == ["lorry", "type"]
    assert t["ID"] == ["id"]
    assert t["Categories"] == ["category"]
    assert t["class"] == ["class"]
    assert t["Order Number"] == ["order"]
    assert t["part-keys"] == ["part"]


def test_token_subset(spark):
    df = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "c"], ["a", "b"]), ([], ["a"])], "x array<string>, y array<string>")
    got = [r[0] for r in df.select(token_subset(F.col("x"), F.col("y"))).collect()]
    assert got == [True, False, False]


def test_scores(spark):
    fields = spark.createDataFrame(
        [
            ("Customers", "ID", "IDENTIFIER", "ID"),
            ("Orders", "Customer ID", "IDENTIFIER", "Customer ID"),
            ("Orders", "Amount", "MEASURE", "Amount"),
            ("Parts", "Amount", "ATTRIBUTE", "Amount"),
            ("o", "o_custkey", "IDENTIFIER", "Customer"),
            ("c", "c_custkey", "IDENTIFIER", "Customer"),
            ("p", "p_partkey", "IDENTIFIER", "p_partkey"),
        ],
        "table string, field string, type string, alias string",
    )
    ov = spark.createDataFrame(
        [
            ("Customers", "ID", "Orders", "Customer ID", 100, 1.0, 1.0),
            ("Orders", "Amount", "Parts", "Amount", 100, 1.0, 1.0),
            ("o", "o_custkey", "c", "c_custkey", 100, 1.0, 1.0),
            ("o", "o_custkey", "p", "p_partkey", 100, 1.0, 1.0),
        ],
        "tableA string, fieldA string, tableB string, fieldB string, intersectionCount long, "
        "overlapRatioA double, overlapRatioB double",
    )
    got = {(r["fieldA"], r["fieldB"]): r["confidence"] for r in lk.score_links(ov, fields, min_score=-1000).collect()}
    # Customers.ID vs Orders."Customer ID": ids, table entity match
    assert got[("ID", "Customer ID")] >= 70
    # a measure never links
    assert got[("Amount", "Amount")] == 0
    # prefixed keys link only through the shared alias: 0.10 + 0.50 - 0.50 + 0.80
    assert got[("o_custkey", "c_custkey")] == 90
    # dense surrogate keys overlap but must not link (false friends)
    assert got[("o_custkey", "p_partkey")] == 10
