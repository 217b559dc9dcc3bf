"""Sources, strategy, enrichment rules and chart shapes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from starloom.operators import charts as ch
from starloom.operators import enrich as en
from starloom.operators import structure as st
from starloom.sources import common_prefix, load_folder, qualify, save_model, read_model, table_names, unqualify


def test_prefix_and_names():
    files = ["Sales Data - Orders.csv", "Sales Data - Customers.csv"]
    assert common_prefix(files) == "Sales Data - "
    assert table_names(files) == {"Sales Data - Orders.csv": "Orders", "Sales Data - Customers.csv": "Customers"}
    assert common_prefix(["only.csv"]) == ""
    assert table_names(["CustomerRecord1.csv", "CustomerRecord2.csv"]) == {
        "CustomerRecord1.csv": "CustomerRecord1.csv"[:-4].replace("CustomerRecord", "", 1),
        "CustomerRecord2.csv": "2",
    }


def test_load_folder_reads_raw_text_and_multiline(spark):
    d = tempfile.mkdtemp(prefix="starloom-src-")
    with open(os.path.join(d, "shop_orders.csv"), "w", encoding="utf-8") as f:
        f.write('id,note,amount\n1,"two\nlines",007\n2,,1.5\n')
    with open(os.path.join(d, "shop_items.csv"), "w", encoding="utf-8") as f:
        f.write("id,name\n1,a\n")
    model = load_folder(spark, d)
    assert set(model) == {"orders", "items"}
    rows = model["orders"].orderBy("id").collect()
    assert rows[0]["note"] == "two\nlines" and rows[0]["amount"] == "007"  # text kept as is
    assert dict(model["orders"].dtypes)["amount"] == "string"


def test_missing_folder_raises(spark):
    with pytest.raises(FileNotFoundError):
        load_folder(spark, "/no/such/folder/anywhere")


def test_qualify_and_save_roundtrip(spark):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    q = qualify(df, "T")
    assert q.columns == ["T.k", "T.v"] and unqualify(q, "T").columns == ["k", "v"]
    out = save_model({"T": df, "%U": df}, tempfile.mkdtemp(prefix="starloom-save-"))
    back = read_model(spark, out)
    assert back["T"].count() == 1 and back["%U"].columns == ["k", "v"]


def _canon(spark, rows):
    return spark.createDataFrame(rows, "tidx int, table string, pos int, field string, type string, canonical string")


def _roles(spark, rows):
    return spark.createDataFrame(rows, "tidx int, table string, role string")


def test_strategies(spark):
    roles = _roles(spark, [(0, "F1", "FACT"), (1, "F2", "FACT"), (2, "D", "DIMENSION")])
    one_key = _canon(spark, [
        (0, "F1", 0, "k", "IDENTIFIER", "Cust"), (0, "F1", 1, "m", "MEASURE", "F1_m"),
        (1, "F2", 0, "k", "IDENTIFIER", "Cust"), (1, "F2", 1, "m", "MEASURE", "F2_m"),
    ])
    bp = st.blueprint(one_key, roles)
    assert bp.strategy == "MULTI_FACT_STAR" and bp.shared == ["Cust"] and not bp.date_bridge
    two = _canon(spark, [
        (0, "F1", 0, "k", "IDENTIFIER", "Cust"), (0, "F1", 1, "d", "DATE", "F1_d"),
        (1, "F2", 0, "k", "IDENTIFIER", "Cust"), (1, "F2", 1, "d", "DATE", "F2_d"),
    ])
    bp = st.blueprint(two, roles)
    assert bp.strategy == "LINK_TABLE" and bp.date_bridge and set(bp.shared) == {"Cust", "F1_d", "F2_d"}
    single = st.blueprint(one_key, _roles(spark, [(0, "F1", "FACT"), (1, "F2", "DIMENSION")]))
    assert single.strategy == "SINGLE_FACT" and single.shared == []
    forced = st.blueprint(one_key, roles, force="LINK_TABLE")
    assert forced.strategy == "LINK_TABLE" and forced.shared == ["Cust"]


def test_relationship_cardinality(spark):
    h = spark.createDataFrame([(1,), (2,)], "k int")
    d = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert st.relationship_cardinality(h, d, "k").first()["cardinality"] == "1:n"
    assert st.relationship_cardinality(d, d, "k").first()["cardinality"] == "n:m"


def _meta(spark, rows):
    return spark.createDataFrame(
        [(i, t, i, f, tags, False, d, s) for i, (t, f, tags, d, s) in enumerate(rows)],
        "tidx int, table string, pos int, field string, tags array<string>, isKey boolean, "
        "distinctCount long, sampleValues array<string>",
    )


def test_flag_rules(spark):
    meta = _meta(spark, [
        ("T", "IsActive", ["$text"], 2, ["no", "yes"]),            # name and values
        ("T", "State", ["$text"], 2, ["Active", "Inactive"]),      # values (active/inactive)
        ("T", "Grade", ["$text"], 2, ["A", "B"]),                  # ambiguous
        ("T", "Tri", ["$text"], 3, ["a", "b", "c"]),               # 3 values: neither
        ("T", "%Hidden", ["$text"], 2, ["y", "n"]),                # hidden
        ("T", "Year", ["$text"], 2, ["2020", "2021"]),             # calendar
        ("T", "Num", ["$numeric", "$integer"], 2, ["0", "1"]),     # numeric
    ])
    flags = {r["field"] for r in en.flag_candidates(meta).collect()}
    amb = {r["field"] for r in en.ambiguous_flags(meta).collect()}
    assert flags == {"IsActive", "State"} and amb == {"Grade"}


def test_chart_shapes_and_null_suppression(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), (None, "x", 5), ("b", "x", 2)], "d1 string, d2 string, m int")
    b = ch.bar(df, ["d1"], {"s": F.sum("m")}).collect()
    assert [r["d1"] for r in b] == ["a", "b"] and b[0]["s"] == 1  # null dimension dropped
    with pytest.raises(ValueError):
        ch.bar(df, ["d1", "d2"], {"s": F.sum("m"), "c": F.count("m")})
    lines = spark.createDataFrame([(t, f"s{s}", s) for t in range(3) for s in range(20)], "t int, s string, v int")
    out = ch.line(lines, "t", {"v": F.sum("v")}, series="s", max_lines=12)
    kept = {r["s"] for r in out.collect()}
    assert len(kept) == 12 and "s19" in kept and "s0" not in kept
    assert ch.kpi(df, {"total": F.sum("m")}).first()["total"] == 8


def test_fact_groups_greedy_chain(spark):
    # A~B and B~C are similar, A and C are not: the greedy takes B into A's
    # group, so C is not taken by anyone and stays alone.
    cols = {
        "A": ["k", "x1", "x2", "x3"],
        "B": ["k", "x1", "x2", "y3"],
        "C": ["k", "x1", "y2", "y3"],
        "D": ["q", "r", "s", "t"],
    }
    rows = [(ti, t, pos, f) for ti, (t, fs) in enumerate(cols.items()) for pos, f in enumerate(fs)]
    fields = spark.createDataFrame(rows, "tidx int, table string, pos int, field string")
    roles = spark.createDataFrame([(i, t, "FACT") for i, t in enumerate(cols)], "tidx int, table string, role string")
    got = {(r["group"], r["table"], r["member_pos"]) for r in st.fact_groups(fields, roles, threshold=0.7).collect()}
    assert got == {("A_B", "A", 0), ("A_B", "B", 1)}
