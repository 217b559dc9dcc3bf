"""Types of raw text columns, and the CSV reader."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from starloom.operators import build as bd
from starloom.operators import classify as cl
from starloom.operators import profile as pr
from starloom.operators import typed as ty
from starloom.sources import list_folder, load_folder, read_csv

COLUMNS = {
    "whole": (["1", "-20", "0", "", None], "whole", "bigint"),
    "zeros": (["01", "2", "3", "", None], None, "string"),
    "money": (["1.50", "2", "-0.25", " ", None], "decimal", "double"),
    "science": (["1.0E10", "2", "3e-2", "", None], "exponent", "double"),
    "long": (["12345678901234567890", "1", "2", "", None], None, "string"),
    "exact": (["0.12345678901234567", "1", "2", "", None], None, "string"),
    "day": (["2024-02-29", "1999-12-31", "2000-01-01", "", None], "yyyy-MM-dd", "date"),
    "bad_day": (["2024-02-30", "1999-12-31", "2000-01-01", "", None], None, "string"),
    "stamp": (["2024-02-29 10:20:30", "1999-12-31T23:59:59.5Z", "2000-01-01 00:00", "", None], "timestamp", "timestamp"),
    "dotted": (["29.02.2024", "31.12.1999", "01.01.2000", "", None], "dd.MM.yyyy", "date"),
    "european": (["29/02/2024", "31/12/1999", "01/01/2000", "", None], "dd/MM/yyyy", "date"),
    "american": (["02/29/2024", "12/31/1999", "01/01/2000", "", None], "MM/dd/yyyy", "date"),
    "either": (["01/02/2024", "03/04/1999", "01/01/2000", "", None], None, "string"),
    "mixed": (["2024-02-29", "7", "x", "", None], None, "string"),
    "empty": ([None, "", " ", "", None], None, "string"),
}


@pytest.fixture(scope="module")
def raw(spark):
    rows = list(zip(*(v for v, _, _ in COLUMNS.values())))
    return {"t": spark.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS)), "u": spark.createDataFrame([(1, 2.0)], "i int, d double")}


def test_narrowest_surviving_type(spark, raw):
    got = {r["field"]: (r["format"], r["type"], r["rejects"]) for r in ty.column_types(raw).where("table = 't'").collect()}
    assert got == {c: (f, t, 0) for c, (_, f, t) in COLUMNS.items()}
    other = {r["field"]: r["type"] for r in ty.column_types(raw).where("table = 'u'").collect()}
    assert other == {"i": "int", "d": "double"}
    assert ty.column_types({"u": raw["u"]}).count() == 2
    empty = ty.column_types({"t": raw["t"].where("false")})
    assert {r["type"] for r in empty.collect()} == {"string"}


def test_values_of_the_types(raw):
    t = ty.typed_model(raw)["t"]
    assert [d for c, d in t.dtypes] == [t for _, _, t in COLUMNS.values()]
    first = t.first()
    assert (first["whole"], first["money"], first["science"], str(first["day"])) == (1, 1.5, 1e10, "2024-02-29")
    assert str(first["european"]) == str(first["american"]) == str(first["dotted"]) == "2024-02-29"
    for c in ("whole", "money", "day"):  # missing and blank cells
        assert t.where(F.col(c).isNull()).count() == 2
    assert t.where("zeros = '01'").count() == 1


def test_rejects_and_day_first(spark):
    cells = [str(i) for i in range(99)] + ["n/a"]
    model = {"t": spark.createDataFrame([(c, "01/02/2024") for c in cells], "n string, d string")}
    strict, types = ty.load_typed(model, 0.0, True)
    assert {r["field"]: (r["type"], r["rejects"]) for r in types.collect()} == {"n": ("string", 0), "d": ("date", 0)}
    assert str(strict["t"].first()["d"]) == "2024-02-01"
    loose, types = ty.load_typed(model, 0.01, False)
    assert {r["field"]: (r["type"], r["rejects"]) for r in types.collect()} == {"n": ("bigint", 1), "d": ("date", 0)}
    assert loose["t"].where("n is null").count() == 1 and str(loose["t"].first()["d"]) == "2024-01-02"


def test_dates_by_values(spark):
    """A date-like name on other values is no DATE; dates are, by any name."""
    rows = [(f"k{i}", "soon", f"2024-01-{i + 1:02d}", i) for i in range(20)]
    raw = {"t": spark.createDataFrame(rows, "t_key string, daytime string, since string, n int")}
    types = ty.column_types(raw)
    prof = pr.profile(raw, samples=0)
    by_values = {r["field"]: r["type"] for r in cl.classify_fields(prof, types=types).collect()}
    by_name = {r["field"]: r["type"] for r in cl.classify_fields(prof).collect()}
    assert (by_values["daytime"], by_values["since"]) == ("ATTRIBUTE", "DATE")
    assert (by_name["daytime"], by_name["since"]) == ("DATE", "ATTRIBUTE")


def test_folder_listing_and_csv_splits(spark):
    d = tempfile.mkdtemp(prefix="starloom-csv-")
    spark.range(100).select(F.col("id").cast("string"), F.lit('a "b", c').alias("t")).repartition(3).write.option("header", True).option("escape", '"').csv(
        f"{d}/x_parts.csv"
    )
    with open(os.path.join(d, "x_odd.csv"), "w", encoding="utf-8") as f:
        f.write('id,note\n1,"two\nlines"\n2,"quoted ""word"""\n')
    with open(os.path.join(d, "x_plain [1]*.csv"), "w", encoding="utf-8") as f:
        f.write("id\n7\n")
    with open(os.path.join(d, "x_notes.md"), "w", encoding="utf-8") as f:
        f.write("no table")
    assert list_folder(spark, d) == ["x_notes.md", "x_odd.csv", "x_parts.csv", "x_plain [1]*.csv"]
    assert list_folder(spark, f"file://{d}/") == list_folder(spark, d)
    model = load_folder(spark, d)
    assert sorted(model) == ["odd", "parts", "plain [1]*"]
    assert model["plain [1]*"].first()["id"] == "7"
    assert model["parts"].where("t = 'a \"b\", c'").count() == 100
    assert sorted(r["note"] for r in model["odd"].collect()) == ['quoted "word"', "two\nlines"]
    # files without line ends in cells are split, others are read whole
    big = f"{d}/big.csv"
    spark.range(200000).select(F.col("id"), F.lit("x" * 50).alias("t")).coalesce(1).write.option("header", True).csv(big)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    assert read_csv(spark, big).rdd.getNumPartitions() > 5 and read_csv(spark, big, True).rdd.getNumPartitions() == 1
    assert read_csv(spark, big).count() == 200000
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    with pytest.raises(FileNotFoundError):
        list_folder(spark, f"{d}/nothing")


def test_types_and_counts_from_one_look_at_the_texts(spark, monkeypatch, raw):
    """Each distinct text votes and is typed once; types, rows and counts are
    those of the cells themselves."""
    rows = [("-0", "1.0", " " * 70, "x" * 80), ("0", "1", "7", "x" * 80), ("0.0", None, "", "y" * 80), (None, "1.00", "7", "1" * 70)]
    model = raw | {"v": spark.createDataFrame(rows, "zero string, one string, wide string, text string")}
    types = ty.column_types(model).collect()
    want = ty.typed_model(model)
    counted = sorted(map(str, pr.value_counts(want).collect()))
    made, whole = [], ty.value_counts
    monkeypatch.setattr(ty, "value_counts", lambda m: made.append(m) or whole(m))
    got, counts = ty.counted_model(model)
    assert made == [model]
    assert sorted(map(str, counts.collect())) == counted
    assert {n: (df.dtypes, sorted(map(str, df.collect()))) for n, df in got.items()} == {n: (df.dtypes, sorted(map(str, df.collect()))) for n, df in want.items()}
    assert "rlike" not in got["v"]._jdf.queryExecution().analyzed().toString().lower()
    told = ty.column_types(model, counts=ty.value_counts(model))
    assert sorted(map(str, told.collect())) == sorted(map(str, types))
    loose = [sorted(map(str, ty.column_types(model, 0.3, counts=c).collect())) for c in (None, ty.value_counts(model))]
    assert loose[0] == loose[1]


def test_key_numbers_travel_as_bytes(spark):
    facts = {n: spark.createDataFrame([(i,) for i in range(40)] + [(None,), (3,)], "k int") for n in ("a", "b")}
    keyed = bd.composite_keys(facts, {"a": ["k"], "b": ["k"]})
    rows = {(n, r["k"]): r[f"%Key_{n}"] for n, df in keyed.items() for r in df.collect()}
    hashed = {(n, r["k"]): r[f"%Key_{n}"] for n, df in bd.composite_keys(facts, {"a": ["k"], "b": ["k"]}, mode="hash").items() for r in df.collect()}
    assert rows == {x: i + 1 for i, x in enumerate(sorted(hashed, key=hashed.get))}
    assert "unhex" in keyed["a"]._jdf.queryExecution().analyzed().toString()
