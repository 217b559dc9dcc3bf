"""Enrichment as transactions on a saved model."""

import tempfile

import pytest
from pyspark.sql import functions as F

from starloom.operators import enrich as en
from starloom.sources import ModelStore


@pytest.fixture()
def store(spark):
    make = spark.createDataFrame
    out = ModelStore(spark, tempfile.mkdtemp(prefix="starloom-store-"))
    out.save({
        "sales": make([(1, "a", "yes", 5.0), (1, "b", "no", 7.0), (2, "a", "yes", 1.0)], "Order int, Product string, paid string, amount double"),
        "product": make([("a", "x"), ("b", "y")], "Product string, label string"),
    })
    return out


def test_versions(spark, store):
    assert store.versions() == [1] and list(store.read()) == ["sales", "product"]
    entries = store.manifest()
    assert entries["sales"][1] == 3
    store.commit({"sales": entries["sales"]})
    assert store.versions() == [1, 2] and list(store.read()) == ["sales"] and list(store.read(1)) == ["sales", "product"]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # another writer was first
        store.commit(entries, base=1)
    assert ModelStore(spark, store.root + "/nothing").versions() == [] and ModelStore(spark, store.root + "/nothing").read() == {}


def test_a_step_is_taken_in_or_leaves_no_trace(store):
    def step(name, make, needs=None):
        return en.Step(name, needs or {}, make)

    good = step("totals", lambda m: m["sales"].groupBy("Product").agg(F.sum("amount").alias("total")), {"sales": ["Product", "amount"]})
    assert en.add_to_store(store, good) == {"tool": "totals", "status": "added", "reason": "", "rows": 2}
    assert store.versions() == [1, 2] and store.read()["totals"].count() == 2
    refused = {
        "gone": (step("gone", lambda m: m["sales"], {"nothing": ["x"]}), "rejected", "missing table nothing"),
        "field": (step("field", lambda m: m["sales"], {"sales": ["x"]}), "rejected", "missing fields ['x'] in sales"),
        "twice": (step("twice", lambda m: m["sales"].select("Product", "Order")), "rejected", "closes a cycle by twice"),
        "none": (step("none", lambda m: m["sales"].where("false").select("Product")), "rejected", "no rows"),
        "loose": (step("loose", lambda m: m["product"].select(F.lit("zz").alias("Product"))), "rejected", "no value of Product is in the model"),
        "late": (step("late", lambda m: m["sales"].select("Product", F.raise_error(F.lit("stop")).cast("int").alias("y"))), "error", "stop"),
        "early": (step("early", lambda m: m["sales"].select("no_such")), "error", "no_such"),
    }
    for made, status, reason in refused.values():
        report = en.add_to_store(store, made)
        assert report["status"] == status and reason in report["reason"], report
    assert store.versions() == [1, 2] and list(store.read()) == ["sales", "product", "totals"]


def test_catalog_steps(spark, store):
    reports = {r["tool"]: r for r in en.enrich(store, facts=["sales"])}
    assert reports["Flag_sales_paid"]["status"] == "added"
    assert reports["Basket_Product"] == {"tool": "Basket_Product", "status": "added", "reason": "", "rows": 2}
    made = store.read()
    assert sorted(map(tuple, made["Flag_sales_paid"].collect())) == [("no", 1), ("yes", 2)]
    assert sorted(map(tuple, made["Basket_Product"].collect())) == [("a", "b", 1), ("b", "a", 1)]


def test_gate_of_the_basket(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "a"), (None, "b"), (3, None), (3, "c")], "i int, x string")
    assert not en.is_one_to_many(rows, "i", "x")
    assert en.is_one_to_many(rows.union(spark.createDataFrame([(2, "c")], rows.schema)), "i", "x")
