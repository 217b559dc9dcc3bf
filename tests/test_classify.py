"""Classification rules on the four profiles of the surveyed unit test."""

import pytest

from starloom.operators import classify as cl

PROFILE_SCHEMA = (
    "tidx int, table string, pos int, field string, dtype string, rowCount long, "
    "uniquenessRatio double, isNumeric boolean, distinctCount long"
)


def _fields(spark, table, tidx, rows, n):
    return [
        (tidx, table, pos, name, "string", n, u, num, d)
        for pos, (name, u, num, d) in enumerate(rows)
    ]


PART = [
    ("Part ID", 1.0, False, 389), ("Part Barcode", 0.671, False, 261), ("Part Name", 1.0, False, 389),
    ("Brand Des", 0.0129, False, 5), ("Category Level 1", 0.018, False, 7), ("Category Level 2", 0.0566, False, 22),
    ("Units in Carton", 0.0514, True, 20), ("Cost", 0.0308, True, 12),
]
CITIES = [
    ("City ID", 1.0, True, 169), ("City", 1.0, False, 169), ("latitude", 0.9822, True, 166),
    ("longitude", 0.9822, True, 166), ("Region ID", 0.0473, True, 8),
]
ORDERS = [
    ("Order Number", 0.0154, False, 960), ("Order Line", 0.0036, True, 226), ("Date", 0.0066, False, 413),
    ("Customer ID", 0.0154, True, 960), ("Part ID", 0.0061, True, 379), ("Qnt", 0.0272, True, 1701),
    ("Price", 0.0061, True, 379), ("Total Amount", 0.2554, True, 15972),
]
LORRIES = [("Lorry_Type", 1.0, False, 4), ("Cost", 1.0, True, 4)]


@pytest.fixture(scope="module")
def classified(spark):
    rows = (
        _fields(spark, "Part", 0, PART, 389)
        + _fields(spark, "Cities", 1, CITIES, 169)
        + _fields(spark, "CustomerOrders", 2, ORDERS, 62525)
        + _fields(spark, "LorriesCost", 3, LORRIES, 4)
    )
    prof = spark.createDataFrame(rows, PROFILE_SCHEMA)
    fields = cl.classify_fields(prof)
    types = {(r["table"], r["field"]): r["type"] for r in fields.collect()}
    roles = {r["table"]: r for r in cl.table_roles(fields).collect()}
    return types, roles


def test_field_classes(classified):
    types, _ = classified
    assert types[("Part", "Part ID")] == "IDENTIFIER"
    assert types[("Part", "Part Name")] == "ATTRIBUTE"
    assert types[("Part", "Cost")] == "ATTRIBUTE"
    assert types[("Cities", "City ID")] == "IDENTIFIER"
    assert types[("Cities", "City")] == "ATTRIBUTE"
    assert types[("Cities", "latitude")] == "ATTRIBUTE"
    assert types[("Cities", "Region ID")] == "IDENTIFIER"
    assert types[("CustomerOrders", "Date")] == "DATE"
    assert types[("CustomerOrders", "Customer ID")] == "IDENTIFIER"
    assert types[("CustomerOrders", "Price")] == "MEASURE"
    assert types[("CustomerOrders", "Total Amount")] == "MEASURE"
    assert types[("LorriesCost", "Cost")] == "ATTRIBUTE"


def test_roles_and_grain(classified):
    _, roles = classified
    assert roles["Part"]["role"] == "DIMENSION"
    assert "Part ID" in roles["Part"]["primaryKey"]
    assert roles["Cities"]["role"] == "DIMENSION"
    assert roles["CustomerOrders"]["role"] == "FACT"
    assert {"Customer ID", "Part ID"} <= set(roles["CustomerOrders"]["foreignKeys"])
    assert roles["LorriesCost"]["role"] == "DIMENSION"
    assert roles["LorriesCost"]["grainDescription"] == "Unknown"


def test_overrides_win(spark):
    prof = spark.createDataFrame(_fields(spark, "T", 0, [("Code", 1.0, False, 3)], 3), PROFILE_SCHEMA)
    ov = spark.createDataFrame([("T", "Code", "ATTRIBUTE", "Thing")], "table string, field string, type string, alias string")
    r = cl.classify_fields(prof, ov).first()
    assert r["type"] == "ATTRIBUTE" and r["alias"] == "Thing"
