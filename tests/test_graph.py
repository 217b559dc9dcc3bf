"""Model validation: islands, cycles, synthetic keys."""

from starloom.operators import graph as gr
from starloom.operators import profile as pr


def _check(spark, tables):
    model = {n: spark.createDataFrame([tuple(range(len(cols)))], ", ".join(f"{c} int" for c in cols))
             for n, cols in tables.items()}
    cat = pr.catalog(model).select("tidx", "table", "field")
    return gr.validate_model(cat.select("table").distinct(), cat).first()


def test_island_fixture(spark):
    r = _check(spark, {
        "FactA": ["FactID_A", "DimKey1", "ValueA"],
        "Dim1": ["DimKey1", "DimDesc1"],
        "FactB": ["FactID_B", "DimKey2", "ValueB"],
        "Dim2": ["DimKey2", "DimDesc2"],
    })
    assert (r["n_tables"], r["n_edges"], r["n_islands"]) == (4, 2, 2)
    assert not r["has_cycle"] and r["n_synthetic_keys"] == 0
    assert r["success"]  # two islands are a warning only
    assert r["warnings"] == ["2 disconnected groups"]


def test_triangle_is_a_cycle(spark):
    r = _check(spark, {"A": ["x", "y"], "B": ["y", "z"], "C": ["z", "x"]})
    assert r["has_cycle"] and not r["success"] and r["n_islands"] == 1


def test_two_shared_fields_make_a_synthetic_key(spark):
    r = _check(spark, {"A": ["x", "y", "a"], "B": ["x", "y", "b"]})
    assert r["n_synthetic_keys"] == 1 and not r["has_cycle"] and not r["success"]


def test_components_chain(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "a string, b string")
    comp = {r["node"]: r["component"] for r in gr.connected_components(nodes, edges).collect()}
    assert comp == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}


def test_components_of_a_long_chain(spark):
    names = [f"n{i:03d}" for i in range(300)]
    nodes = spark.createDataFrame([(n,) for n in names] + [("alone",)], "node string")
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    got = {r["node"]: r["component"] for r in gr.connected_components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(names, "n000"), "alone": "alone"}
