"""Link groups (D20) against taking links one by one; pair candidates
against comparing all names."""

import random

import pytest
from pyspark.sql import functions as F

from starloom.operators import links as lk
from starloom.operators import overlap as ov

FIELDS = "tidx int, table string, pos int, field string"


def _groups(spark, fields, links):
    f = spark.createDataFrame(fields, FIELDS)
    ls = spark.createDataFrame(links, "tableA string, fieldA string, tableB string, fieldB string, confidence int")
    out = {}
    for r in lk.link_groups(ls, f).collect():
        out.setdefault(r["group"], set()).add((r["table"], r["field"]))
    return sorted(map(sorted, out.values()))


def _one_by_one(fields, links):
    place = {(t, c): (i, p) for i, t, p, c in fields}
    group = {n: {n} for n in place}
    order = sorted(links, key=lambda x: (-x[4], *sorted((place[x[0], x[1]], place[x[2], x[3]]))))
    for ta, ca, tb, cb, _ in order:
        a, b = group[ta, ca], group[tb, cb]
        if a is not b and not {t for t, _ in a} & {t for t, _ in b}:
            a |= b
            for n in b:
                group[n] = a
    found = {id(g): g for g in group.values() if len(g) > 1}
    return sorted(map(sorted, found.values()))


def test_bridge_link_is_refused_not_its_columns(spark):
    """a - b, b - c and c - a2: the weakest would put table A in twice."""
    fields = [(0, "A", 0, "a"), (0, "A", 1, "a2"), (1, "B", 0, "b"), (2, "C", 0, "c"), (3, "D", 0, "d")]
    links = [("A", "a", "B", "b", 90), ("B", "b", "C", "c", 85), ("C", "c", "A", "a2", 80), ("A", "a2", "D", "d", 75)]
    want = [[("A", "a"), ("B", "b"), ("C", "c")], [("A", "a2"), ("D", "d")]]
    assert _groups(spark, fields, links) == want
    # the other way round: the bridge is the strongest, so C goes with a2
    links = [("A", "a", "B", "b", 90), ("B", "b", "C", "c", 70), ("C", "c", "A", "a2", 95)]
    assert _groups(spark, fields, links) == [[("A", "a"), ("B", "b")], [("A", "a2"), ("C", "c")]]


def test_shared_key_of_many_tables(spark, monkeypatch):
    """A key of forty tables is merged in a few rounds."""
    fields = [(i, f"T{i}", 0, "key") for i in range(40)]
    links = [(f"T{i}", "key", f"T{j}", "key", 90) for i in range(40) for j in range(i + 1, 40)]
    rounds = []
    taken = lk._taken
    monkeypatch.setattr(lk, "_taken", lambda *a: rounds.append(1) or taken(*a))
    assert _groups(spark, fields, links) == [sorted((f"T{i}", "key") for i in range(40))]
    assert len(rounds) <= 3


@pytest.mark.parametrize("seed", range(4))
def test_groups_equal_one_by_one(spark, seed):
    rng = random.Random(seed)
    fields = [(t, f"T{t}", p, f"c{p}") for t in range(7) for p in range(3)]
    names = [(f"T{t}", f"c{p}") for t in range(7) for p in range(3)]
    links = set()
    while len(links) < 25:
        a, b = rng.sample(names, 2)
        if a[0] != b[0] and (*b, *a) not in {x[:4] for x in links} and (*a, *b) not in {x[:4] for x in links}:
            links.add((*a, *b, rng.choice([70, 80, 85, 90, 95])))
    assert _groups(spark, fields, list(links)) == _one_by_one(fields, list(links))


def _fields(spark, names, sizes=None):
    rows = [(i // 5, f"T{i // 5}", i % 5, n, (sizes or {}).get(i, 3)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, FIELDS + ", distinctCount long")


def test_name_pairs_equal_all_pairs(spark):
    names = ["id", "Customer ID", "customer_id", "name", "Customer Name", "n", "_", "order", "Order_Date", "x", "date", "orderdate", "Key2"]
    got = {(r.tableA, r.fieldA, r.tableB, r.fieldB) for r in ov.candidate_pairs(_fields(spark, names)).collect()}
    squash = [n.lower().replace("_", "").replace(" ", "") for n in names]
    want = set()
    for i, a in enumerate(squash):
        for j in range(i + 1, len(squash)):
            b = squash[j]
            if a == b or (a and b and (a in b or b in a)):
                want.add((f"T{i // 5}", names[i], f"T{j // 5}", names[j]))
    assert got == want
    assert ov.candidate_pairs(_fields(spark, names, {3: 0})).where("fieldA = 'name' or fieldB = 'name'").isEmpty()


def test_id_columns_meet_by_values_and_none_by_nested_loop(spark):
    fields = _fields(spark, ["a_id", "b_key", "c_num", "d_code", "plain", "another"])
    cells = [(0, 0, "1"), (0, 0, "2"), (0, 1, "2"), (0, 2, "9"), (0, 3, "1"), (0, 3, "2"), (0, 4, "1"), (1, 0, "1")]
    values = spark.createDataFrame(cells, "tidx int, pos int, value string")
    held = ov.held_sets(values, ov.gate_columns(fields))
    pairs = ov.candidate_pairs(fields, held)
    assert {(r.fieldA, r.fieldB) for r in pairs.collect()} == {("a_id", "b_key"), ("a_id", "d_code"), ("b_key", "d_code")}
    counts = {(r.fieldA, r.fieldB): r.intersectionCount for r in ov.intersections_of(held, pairs).collect()}
    assert counts == {("a_id", "b_key"): 1, ("a_id", "d_code"): 2, ("b_key", "d_code"): 1}
    for plan in (pairs, held):
        text = plan._jdf.queryExecution().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_twenty_thousand_columns(spark):
    """Names and values of 20,000 columns in one run; each shares its values
    with the one other column of its pair."""
    n = 20000
    fields = spark.range(n).select(
        (F.col("id") / 10).cast("int").alias("tidx"), F.concat(F.lit("T"), (F.col("id") / 10).cast("int")).alias("table"),
        (F.col("id") % 10).cast("int").alias("pos"), F.concat(F.lit("c"), F.hex(F.col("id") + 1_000_000), F.lit("_key")).alias("field"),
        F.lit(20).cast("long").alias("distinctCount"),
    )
    values = fields.select(
        "tidx", "pos", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
    ).select("tidx", "pos", F.concat_ws("-", ((F.col("tidx") * 10 + F.col("pos")) / 2).cast("int"), "k").alias("value"))
    held = ov.held_sets(values, ov.gate_columns(fields)).transform(lambda d: d.checkpoint())
    pairs = ov.candidate_pairs(fields, held)
    found = ov.intersections_of(held, pairs).agg(F.count("*"), F.min("intersectionCount"), F.max("intersectionCount")).first()
    assert tuple(found) == (n // 2, 20, 20)


def test_sketches_and_counts_accept_the_same_pairs(spark):
    """Columns beyond a sketch's 4,096 values, with overlaps on both sides of
    the bar and close to it, and small columns within large ones."""
    from starloom.plans import model as md

    def column(lo, hi):
        return spark.range(lo, hi).select(F.col("id").cast("string").alias("v"))

    tables = {}
    for name, lo, hi in (("a", 0, 20000), ("b", 10000, 30000), ("c", 17990, 38000), ("d", 18200, 38200), ("e", 19970, 20030), ("f", 500000, 520000), ("g", 0, 12)):
        tables[name] = column(lo, hi).withColumnRenamed("v", f"{name}_key")
    columns = ["tableA", "fieldA", "tableB", "fieldB"]
    exact = {tuple(r) for r in md.discover(tables).overlap.select(columns).collect()}
    approx = {tuple(r) for r in md.discover(tables, approx=True).overlap.select(columns).collect()}
    assert exact == approx and len(exact) > 5
    told = ov.sketch_bounds(ov.column_sketches(tables), md.discover(tables, approx=True).pairs)
    assert 0 < told.where("clear").count() < told.count()
