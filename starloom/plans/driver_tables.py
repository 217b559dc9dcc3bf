"""Schemas of the driver's test tables (fixed values, as documented in
TESTDATA.md / FIXTURES.md), used to spell out the oracle SQL column by
column.  Spark queries never rely on these lists: they read the schema from
the parquet files."""

from __future__ import annotations

# Table -> ordered column list.
DRIVER_SCHEMAS: dict[str, list[str]] = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}

# Two slices of orders by year, the later one without a column: similar facts.
ORDER_SLICES = {
    "orders_early": DRIVER_SCHEMAS["orders"],
    "orders_late": [c for c in DRIVER_SCHEMAS["orders"] if c != "o_orderpriority"],
}
SLICED = "_".join(ORDER_SLICES)
SLICED_COLUMNS = [*DRIVER_SCHEMAS["orders"], f"%{SLICED}_SourceTable"]

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
ALL_TABLES = list(DRIVER_SCHEMAS)

# Columns whose parquet type is text (empty text counts as missing there).
STRING_COLUMNS = {
    "r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type",
    "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "event_type", "props",
    "text", "lang", "source", "url", "html", "role",
}

# Parameters of the model queries: semantic aliases for the key columns of
# the star tables (the role an analyst's override table plays; without them
# prefixed keys such as o_custkey / c_custkey score too low to link).
DRIVER_ALIASES: list[tuple[str, str, str | None, str | None]] = [
    ("region", "r_regionkey", None, "Region"),
    ("nation", "n_regionkey", None, "Region"),
    ("nation", "n_nationkey", None, "Nation"),
    ("customer", "c_nationkey", None, "Nation"),
    ("supplier", "s_nationkey", None, "Nation"),
    ("customer", "c_custkey", None, "Customer"),
    ("orders", "o_custkey", None, "Customer"),
    ("supplier", "s_suppkey", None, "Supplier"),
    ("lineitem", "l_suppkey", None, "Supplier"),
    ("part", "p_partkey", None, "Part"),
    ("lineitem", "l_partkey", None, "Part"),
    ("orders", "o_orderkey", None, "Order"),
    ("lineitem", "l_orderkey", None, "Order"),
]
