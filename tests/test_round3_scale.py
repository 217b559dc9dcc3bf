"""What the queries over larger star tables do once, or in bounded parts."""

import tempfile

from starloom.operators import analytics as an
from starloom.operators import build as bd
from starloom.operators import enrich as en
from starloom.operators import overlap as ov
from starloom.operators import profile as pr
from starloom.operators.association import ChartModel, Measure
from starloom.plans import model as md
from starloom.sources import ModelStore


def _plan(df):
    return df._jdf.queryExecution().toString()


def _model(spark):
    return {
        "sales": spark.createDataFrame([(1, "a", "yes", 5.0), (1, "b", "no", 7.5), (None, "a", None, None)], "Order int, Product string, paid string, amount double"),
        "product": spark.createDataFrame([("a", "x"), ("b", "")], "Product string, label string"),
    }


def test_metadata_reads_the_counts_of_the_discovery(spark, monkeypatch):
    model = _model(spark)
    own = sorted(map(str, en.live_metadata(model).collect()))
    made = []
    whole = pr.value_counts
    monkeypatch.setattr(pr, "value_counts", lambda *a, **k: made.append(1) or whole(*a, **k))
    d = md.discover(model, scan_columns=2)
    assert sorted(map(str, en.live_metadata(model, counts=d.counts).collect())) == own
    assert len(made) == 1


def test_enrichment_reads_the_counts_of_the_discovery(spark, monkeypatch):
    store = ModelStore(spark, tempfile.mkdtemp(prefix="starloom-store-"))
    store.save(_model(spark))
    counts = pr.value_counts(store.read(), 2).checkpoint()
    monkeypatch.setattr(pr, "value_counts", None)  # a second aggregation would fail
    told = {r["tool"]: r["status"] for r in en.enrich(store, None, ["sales"], counts=counts)}
    assert told["Basket_Product"] == "added" and told["Flag_sales_paid"] == "added"


def test_basket_parts_grow_with_its_rows(spark):
    rows = [(i % 700, (i * 7919) % 90) for i in range(6000)] + [(9000, x) for x in range(90)]
    df = spark.createDataFrame(rows, "id int, item int")
    fine = an.market_basket(df, "id", "item", cell_items=20, task_rows=100)
    assert "REPARTITION_BY_NUM" in _plan(fine)
    n = df.distinct().count()
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in _plan(fine)
    a, b = df.toDF("id", "a"), df.toDF("id", "b")
    plain = a.join(b, "id").where("a <> b").groupBy("a", "b").count()
    assert sorted(map(tuple, fine.collect())) == sorted(map(tuple, plain.collect()))


def test_column_sets_of_many_columns(spark):
    """More columns than one long has bits, and none of them in a list while
    values are grouped."""
    cells = [(0, p, "all") for p in range(70)] + [(0, 3, "two"), (0, 69, "two"), (0, 5, "one"), (0, 61, "pair"), (0, 62, "pair")]
    cells += [(1, 0, "two"), (0, 80, "all"), (0, 81, "two")]  # the last two columns are not asked for
    values = spark.createDataFrame(cells, "tidx int, pos int, value string")
    columns = spark.createDataFrame([(p,) for p in range(70)] + [(1_000_000,)], "col long")
    held = ov.held_sets(values, columns)
    got = {tuple(r["cols"]): r["n"] for r in held.collect()}
    assert got == {tuple(range(70)): 1, (3, 69, 1_000_000): 1, (61, 62): 1}
    assert "collect_set" not in _plan(held) and "SortAggregate" not in _plan(held)
    assert ov.held_sets(values, columns.limit(0)).isEmpty()


def test_links_are_made_distinct_without_copies(spark):
    facts = {
        "a": spark.createDataFrame([(1, "k1"), (1, "k1"), (None, None)], "Order int, `%Key_a` string"),
        "b": spark.createDataFrame([(1, "k2", "2020-01-01"), (1, "k2", "2020-01-01"), (1, None, "x")], "Order int, `%Key_b` string, day string"),
    }
    link = bd.link_table(facts, ["Order", "day"])
    assert link.columns == [bd.LINK_SOURCE, "%Key_a", bd.BRIDGE_KEY, "Order", "%Key_b", "day"]
    got = sorted(map(str, map(tuple, link.collect())))
    assert got == sorted(map(str, [
        ("a", "k1", "k1", 1, None, None), ("a", None, None, None, None, None),
        ("b", None, "k2", 1, "k2", "2020-01-01"), ("b", None, None, 1, None, "x"),
    ]))
    bridge = bd.date_bridge(facts, [("b", "day"), ("b", "day")])
    assert [(r[0], r[1], str(r[2]), r[3]) for r in bridge.collect()] == [("b", "k2", "2020-01-01", "day")]
    for df in (link, bridge):
        keys = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
        assert keys and not any("SourceTable" in line or bd.BRIDGE_KEY in line and "%Key" in line for line in keys)


def test_linking_tables_are_not_measured(spark, monkeypatch):
    tables = {
        "fact": spark.createDataFrame([("k", 1.0), ("k", 2.0), ("m", 5.0), (None, 9.0)], "key string, amount double"),
        "link": spark.createDataFrame([("k", "p"), ("k", "q"), ("m", "p"), ("m", None)], "key string, bridge string"),
        "dates": spark.createDataFrame([("p", 1), ("p", 1), ("q", 1), ("q", 2)], "bridge string, Year int"),
    }
    ask = {"total": Measure("sum", "amount", "fact"), "rows": Measure("count", table="fact")}
    want = sorted(map(tuple, ChartModel(tables).aggregate(["Year"], ask).collect()))
    assert want == [(1, 8.0, 3), (2, 3.0, 2)]
    model = ChartModel(tables, linking=["link", "dates"])
    assert sorted(map(tuple, model.aggregate(["Year"], ask).collect())) == want
    assert not model._unique


def _built(spark, key_mode):
    """Two facts with a shared field and dates; grains repeat and are null."""
    orders = [(1, "2020-01-05", 10.0), (2, "2021-02-06", 20.0), (2, "2021-02-06", 5.0), (None, "2020-07-01", 1.0), (3, None, 9.0)]
    lines = [(1, 1, "2020-02-01", 3.0), (1, 2, "2021-02-01", 4.0), (1, 2, "2022-02-01", 4.0), (7, 1, None, 6.0), (None, None, "2021-01-01", 2.0)]
    renamed = {
        "orders": spark.createDataFrame(orders, "Order int, ordered string, total double"),
        "lines": spark.createDataFrame(lines, "Order int, line int, shipped string, price double"),
    }
    facts, shared, dates = list(renamed), ["Order"], [("orders", "ordered"), ("lines", "shipped")]
    keyed = bd.composite_keys(renamed, {"orders": ["Order"], "lines": ["Order", "line"]}, mode=key_mode)
    tables = {f: bd.drop_fields(keyed[f], shared) for f in facts} | {
        "LinkTable": bd.link_table(keyed, shared), "CanonicalDateBridge": bd.date_bridge(keyed, dates),
        "MasterCalendar": bd.master_calendar(bd.calendar_dates(renamed, dates)),
    }
    light = {
        "LinkTable": lambda columns: bd.link_table(bd.short_keys(keyed), shared, columns=columns),
        "CanonicalDateBridge": lambda columns: bd.date_bridge(bd.short_keys(keyed), dates).select(*columns),
    }
    return md.BuiltModel(tables, None, keyed, None, plain=set(facts), light=light if key_mode == "hash" else {})


def test_charts_read_what_they_need_of_link_tables(spark, monkeypatch):
    """Neither table is written whole, hashes are bytes on the way, and what the
    bridge says of years is written once for both facts."""
    from starloom.operators import association

    ask = {"ordered": Measure("sum", "total", "orders"), "rows": Measure("count", table="lines"), "least": Measure("min", "%Key_lines", "lines")}
    written, whole, kept = [], md.resident, association.stage
    monkeypatch.setattr(md, "resident", lambda df: written.append(df.columns) or whole(df))
    monkeypatch.setattr(association, "stage", lambda df, tag: written.append((tag, df.dtypes)) or kept(df, tag))
    built = _built(spark, "hash")
    plain = ChartModel(built.tables)
    want = {tuple(dims): sorted(map(str, plain.aggregate(dims, ask).collect())) for dims in (["Year"], ["%Key_orders"])}
    assert want["Year",]
    written.clear()
    model = built.charts()
    assert len(written) == 1 and written[0][0] == bd.CANONICAL_DATE  # the calendar
    for dims, rows in want.items():
        assert sorted(map(str, model.aggregate(list(dims), ask).collect())) == rows
    mappings = [w[1] for w in written if w[0] == "mapping"]
    assert mappings.count([(bd.BRIDGE_KEY, "binary"), ("Year", "int")]) == 1
    numbered = _built(spark, "number").charts().aggregate(["Year"], {k: m for k, m in ask.items() if k != "least"})
    both = plain.aggregate(["Year"], {k: m for k, m in ask.items() if k != "least"})
    assert sorted(map(str, numbered.collect())) == sorted(map(str, both.collect()))


def test_staged_rows_leave_no_shuffle_files(spark):
    from starloom.session import stage

    option = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(option, None)
    status = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    staged = stage(spark.range(1000).repartition(7).groupBy("id").count(), "test")
    assert staged.count() == 1000 and spark.conf.get(option, None) == before
    shuffles = status.shuffleStatuses().size()
    stage(spark.range(1000).repartition(7, "id").distinct(), "test")
    assert status.shuffleStatuses().size() <= shuffles
