"""Model metadata and enrichment candidates (SURVEY 2.4 A13/A14,
2.9 M13-M18).

``live_metadata`` is the one data-scale step (it profiles the model); the
candidate rules are filters over its catalog rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.operators import analytics as an
from starloom.operators import graph as gr
from starloom.operators import profile as pr
from starloom.operators.cycles import closing_fields
from starloom.session import materialize
from starloom.sources.versions import ModelStore

# The flag and calendar vocabularies of the enrichment rules.
FLAG_NAME_PATTERN = r"(?i)(flag|status|yes|no|active|valid|binary|imported|return)"
FLAG_VALUES = ["yes", "no", "y", "n", "1", "0", "true", "false", "active", "inactive"]
CALENDAR_NAME_PATTERN = r"(?i)^(Year|Month|Quarter|Week|Day|WeekDay|MonthYear|Date_Diff|Month_Diff|Year_Diff|Date|Time|Timestamp)$"
BASKET_ID_PATTERN = r"(?i)(order|trans|basket|header)"
BASKET_ITEM_PATTERN = r"(?i)(product|item|article)"
MODEL_TABLES = ["LinkTable", "MasterCalendar", "CanonicalDateBridge"]


def _tags_for(dtype: T.DataType) -> list[str]:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return ["$numeric", "$integer"]
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return ["$numeric"]
    if isinstance(dtype, T.DateType):
        return ["$date"]
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return ["$timestamp"]
    if isinstance(dtype, T.StringType):
        return ["$text"]
    return []


def schema_tags(model: dict[str, DataFrame]) -> DataFrame:
    """``(tidx, table, pos, field, tags)`` from the schemas (metadata only)."""
    spark = next(iter(model.values())).sparkSession
    rows = [
        (ti, name, pos, f.name, _tags_for(f.dataType))
        for ti, (name, df) in enumerate(model.items())
        for pos, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, "tidx int, table string, pos int, field string, tags array<string>")


def live_metadata(
    model: dict[str, DataFrame],
    samples: int = 5,
    approx: bool = False,
    counts: DataFrame | None = None,
    scan_columns: int | None = None,
) -> DataFrame:
    """Per table x field: ``tags`` (schema tags plus ``$key`` for fields
    held by more than one table), ``isKey``, ``distinctCount`` and up to
    ``samples`` sample values.  ``counts`` are the model's value counts where
    they were made before (``Discovery.counts``); ``scan_columns`` as in
    :func:`~starloom.operators.profile.value_counts`."""
    tags = schema_tags(model)
    keys = gr.shared_fields(tags.select("tidx", "table", "field")).select("field").withColumn("isKey", F.lit(True))
    prof = pr.profile(model, approx=approx, samples=samples, counts=counts, scan_columns=scan_columns).select("tidx", "pos", "distinctCount", "sampleValues")
    meta = tags.join(prof, ["tidx", "pos"]).join(keys, "field", "left")
    is_key = F.coalesce(F.col("isKey"), F.lit(False))
    return meta.select(
        "tidx", "table", "pos", "field",
        F.when(is_key, F.concat(F.col("tags"), F.array(F.lit("$key")))).otherwise(F.col("tags")).alias("tags"),
        is_key.alias("isKey"),
        "distinctCount",
        "sampleValues",
    )


def data_dictionary(meta: DataFrame, samples: int = 3, width: int = 20) -> DataFrame:
    """``table, field, distinctCount, tags, samples`` with ``samples``
    sample values cut to ``width`` characters."""
    return meta.select(
        "table", "field", "distinctCount", "tags",
        F.transform(F.slice("sampleValues", 1, samples), lambda s: F.substring(s, 1, width)).alias("samples"),
    )


def _flag_base(meta: DataFrame) -> DataFrame:
    tags = F.col("tags")
    numeric = F.array_contains(tags, "$numeric") | F.array_contains(tags, "$integer")
    calendar = (
        F.col("field").rlike(CALENDAR_NAME_PATTERN) | F.array_contains(tags, "$date") | F.array_contains(tags, "$timestamp")
    )
    return meta.where(
        ~F.col("field").startswith("%")
        & ~numeric
        & ~calendar
        & (F.col("distinctCount") == 2)
        & (F.size("sampleValues") == 2)
    )


def _flag_hit() -> Column:
    name = F.col("field").rlike(FLAG_NAME_PATTERN)
    vocab = F.array(*[F.lit(v) for v in FLAG_VALUES])
    values = F.exists("sampleValues", lambda v: F.array_contains(vocab, F.lower(v)))
    return name | values


def flag_candidates(meta: DataFrame) -> DataFrame:
    """Two-valued text fields that look like flags by name or by value;
    source-tag fields are skipped unless named as a flag.  ``values`` are the
    two values (the ``Match`` list of :func:`encode_flag`)."""
    base = _flag_base(meta).where(
        ~(F.col("field").contains("SourceTable") & ~F.lower(F.col("field")).contains("flag"))
    )
    return base.where(_flag_hit()).select("tidx", "table", "pos", "field", F.col("sampleValues").alias("values"))


def ambiguous_flags(meta: DataFrame) -> DataFrame:
    """Two-valued text fields that fail both flag tests (left for a
    person to decide); the exact complement of the flag tests."""
    return _flag_base(meta).where(~_flag_hit()).select(
        "tidx", "table", "pos", "field", F.col("sampleValues").alias("values")
    )


def as_of_candidate(meta: DataFrame) -> DataFrame:
    """``CanonicalDate`` of the first table holding it, else the first
    ``$date``/``$timestamp`` field in model order; zero or one row."""
    tags = F.col("tags")
    is_date = F.array_contains(tags, "$date") | F.array_contains(tags, "$timestamp")
    prio = F.when(F.col("field") == "CanonicalDate", 0).when(is_date, 1)
    c = meta.withColumn("_prio", prio).where(F.col("_prio").isNotNull())
    return c.orderBy("_prio", "tidx", "pos").limit(1).select(
        F.col("table").alias("sourceTable"), F.col("field").alias("dateField")
    )


def _first_by(df: DataFrame, part: str, order: Sequence[str], out: str, value: str) -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).select(part, F.col(value).alias(out))


def pareto_candidates(meta: DataFrame, fields: DataFrame | None = None, link_table: str = "LinkTable") -> DataFrame:
    """``factTable, linkTable, keyField, dimensionField, measureField``.

    Facts: tables (not the link, bridge or calendar) with a numeric field
    that is neither hidden (``%``) nor a key; the first such is the measure.
    With a link table holding ``%Key_<fact>``: its first visible field other
    than ``OrderID`` without ``source``/``id`` in the name (else the first).
    Without: the fact's first ATTRIBUTE (types from ``fields``) with more
    than 10 values and no ``date``/``id`` in the name.
    """
    tags = F.col("tags")
    measure_ok = F.array_contains(tags, "$numeric") & ~F.col("field").startswith("%") & ~F.array_contains(tags, "$key")
    m = meta.where(~F.col("table").isin(*MODEL_TABLES) & measure_ok)
    measures = _first_by(m, "table", ["pos"], "measureField", "field")
    link = meta.where(F.col("table") == link_table)
    link_dims = link.where(~F.col("field").startswith("%") & (F.col("field") != "OrderID"))
    plain = ~F.lower(F.col("field")).contains("source") & ~F.lower(F.col("field")).contains("id")
    best = link_dims.select(
        F.lit(1).alias("_one"), F.when(plain, 0).otherwise(1).alias("_p"), "pos", "field"
    )
    best_dim = _first_by(best, "_one", ["_p", "pos"], "linkDim", "field")
    link_keys = link.where(F.col("field").startswith("%Key_")).select(
        F.regexp_replace("field", "^%Key_", "").alias("table"), F.lit(True).alias("_linked")
    )
    out = measures.join(link_keys, "table", "left").withColumn("linkDim", best_dim.select("linkDim").scalar())
    if fields is not None:
        attrs = fields.where(
            (F.col("type") == "ATTRIBUTE")
            & (F.col("distinctCount") > 10)
            & ~F.lower(F.col("field")).contains("date")
            & ~F.lower(F.col("field")).contains("id")
        )
        self_dim = _first_by(attrs, "table", ["pos"], "selfDim", "field")
        out = out.join(self_dim, "table", "left")
    else:
        out = out.withColumn("selfDim", F.lit(None).cast("string"))
    linked = F.col("_linked") & F.col("linkDim").isNotNull()
    res = out.select(
        F.col("table").alias("factTable"),
        F.when(linked, F.lit(link_table)).alias("linkTable"),
        F.when(linked, F.concat(F.lit("%Key_"), F.col("table"))).alias("keyField"),
        F.when(linked, F.col("linkDim")).otherwise(F.col("selfDim")).alias("dimensionField"),
        "measureField",
    )
    return res.where(F.col("dimensionField").isNotNull())


def basket_candidate(meta: DataFrame, facts: DataFrame, link_table: str = "LinkTable") -> DataFrame:
    """On the link table, or else the first fact (``facts``: ``tidx,
    table``), the first field named like an order/transaction/basket/header
    and the first named like a product/item/article: ``table, idField,
    itemField`` (zero or one row)."""
    has_link = meta.where(F.col("table") == link_table).select("table").distinct()
    first_fact = facts.withColumn("_r", F.row_number().over(Window.orderBy("tidx"))).where(F.col("_r") == 1).select("table")
    target = has_link.unionByName(first_fact)
    w_target = Window.orderBy(F.when(F.col("table") == link_table, 0).otherwise(1))
    target = target.withColumn("_r", F.row_number().over(w_target)).where(F.col("_r") == 1).select("table")
    f = meta.join(target, "table")
    ids = f.where(F.col("field").rlike(BASKET_ID_PATTERN)).withColumn("_one", F.lit(1))
    items = f.where(F.col("field").rlike(BASKET_ITEM_PATTERN)).withColumn("_one", F.lit(1))
    id_pick = _first_by(ids, "_one", ["pos"], "idField", "field")
    item_pick = _first_by(items, "_one", ["pos"], "itemField", "field")
    row = target.select(
        "table", id_pick.select("idField").scalar().alias("idField"), item_pick.select("itemField").scalar().alias("itemField")
    )
    return row.where(F.col("idField").isNotNull() & F.col("itemField").isNotNull())


def is_one_to_many(df: DataFrame, id_col: str, item: str) -> bool:
    """A11 as a gate: whether an id has two different items.  The least and the
    greatest item of each id are kept map-side, so a hot id is one row a task."""
    both = df.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{item}`").isNotNull())
    ends = both.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.min(f"`{item}`").alias("_low"), F.max(f"`{item}`").alias("_high"))
    return not ends.where(F.col("_low") != F.col("_high")).isEmpty()


@dataclass(frozen=True)
class Step:
    """A derived table: its name, the fields it needs by table, and how it is
    made (a built-in operator or any user callable over the model)."""

    name: str
    needs: Mapping[str, Sequence[str]]
    make: Callable[[dict[str, DataFrame]], DataFrame]


def _columns(model: dict[str, DataFrame]) -> dict[str, list[str]]:
    return {t: df.columns for t, df in model.items()}


def _refusal(model: dict[str, DataFrame], step: Step, derived: DataFrame) -> str:
    """Why a derived table may not be added, as far as its schema tells: it
    would close a cycle or make a synthetic key that the model does not have."""
    before = set(closing_fields(_columns(model), {}))
    after = closing_fields(_columns(model | {step.name: derived}), {})
    new = [f"{t}.{c}" for t, c in after if (t, c) not in before]
    return f"closes a cycle by {', '.join(new)}" if len(after) > len(before) else ""


def _missing(model: dict[str, DataFrame], step: Step) -> str:
    for table, cols in step.needs.items():
        if table not in model:
            return f"missing table {table}"
        gone = [c for c in cols if c not in model[table].columns]
        if gone:
            return f"missing fields {gone} in {table}"
    return ""


def _loose(model: dict[str, DataFrame], table: DataFrame) -> str:
    """Why a table's rows do not hang on the model: a linking field without a
    value that the other tables have."""
    for c in table.columns:
        others = [df.select(F.col(f"`{c}`").alias("_v")) for df in model.values() if c in df.columns]
        if others:
            held = others[0]
            for o in others[1:]:
                held = held.unionByName(o)
            own = table.select(F.col(f"`{c}`").alias("_v")).where("_v IS NOT NULL").distinct()
            if own.join(held.distinct(), "_v", "left_semi").isEmpty():
                return f"no value of {c} is in the model"
    return ""


def add_checked(
    model: dict[str, DataFrame],
    name: str,
    step: Callable[[dict[str, DataFrame]], DataFrame],
    needs: Mapping[str, Sequence[str]] | None = None,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """M18 on schemas alone: add one derived table only if its inputs exist and
    it closes no cycle and makes no synthetic key that the model does not have
    (a model with a cycle can still take a table that hangs off it).  Returns
    the (possibly extended) model and a report ``{tool, status, reason}``."""
    made = Step(name, needs or {}, step)
    reason = _missing(model, made)
    if not reason:
        try:
            derived = step(model)
        except Exception as e:  # noqa: BLE001 - report, do not crash the model
            return model, {"tool": name, "status": "rejected", "reason": f"{type(e).__name__}: {e}"}
        reason = _refusal(model, made, derived)
    if reason:
        return model, {"tool": name, "status": "rejected", "reason": reason}
    return model | {name: derived}, {"tool": name, "status": "added", "reason": ""}


def add_to_store(store: ModelStore, step: Step) -> dict[str, str]:
    """M18 as a transaction: the derived table is written, checked on its rows
    (it has some, and each linking field has values of the model) and taken into
    the next version of the saved model, or left out of it.  A step that fails
    while it runs leaves the model as it was.  The report is ``{tool, status,
    reason, rows}``."""
    report = {"tool": step.name, "status": "rejected", "reason": "", "rows": 0}
    model = store.read()
    report["reason"] = _missing(model, step)
    if report["reason"]:
        return report
    try:
        derived = step.make(model)
        report["reason"] = _refusal(model, step, derived)
        if report["reason"]:
            return report
        path, rows = store.write_table(step.name, derived)
        written = store.spark.read.parquet(path)
        report["reason"] = "no rows" if not rows else _loose(model, written)
        if report["reason"]:
            return report
        store.commit(store.manifest() | {step.name: (path, rows)})
    except Exception as e:  # noqa: BLE001 - report, the saved model is as it was
        first = str(e).strip().splitlines()
        return report | {"status": "error", "reason": f"{type(e).__name__}: {first[0] if first else ''}"}
    return report | {"status": "added", "rows": rows}


def enrichment_steps(model: dict[str, DataFrame], meta: DataFrame, fields: DataFrame | None = None, facts: Sequence[str] = ()) -> list[Step]:
    """The catalog's steps for a model: as-of table (M15), flags (M13), Pareto
    tables (M16) and the market basket (M17, if its ids have several items,
    A11).  ``meta`` is :func:`live_metadata`; what is read of it on the driver
    are names, a row a candidate."""
    steps: list[Step] = []
    for r in as_of_candidate(meta).collect():
        table, date = r["sourceTable"], r["dateField"]
        steps.append(Step("AsOf_Table", {table: [date]}, lambda m, t=table, d=date: an.as_of_table(m[t].withColumn(d, F.col(f"`{d}`").try_cast("date")), d)))
    for r in flag_candidates(meta).orderBy("tidx", "pos").collect():
        table, name, values = r["table"], r["field"], list(r["values"])
        steps.append(Step(f"Flag_{table}_{name}", {table: [name]}, lambda m, t=table, f=name, v=values: an.encode_flag(
            m[t].select(F.col(f"`{f}`")).where(F.col(f"`{f}`").isNotNull()).distinct(), f, v)))
    for r in pareto_candidates(meta, fields).orderBy("factTable").collect():
        fact, link, key, dim, measure = (r[c] for c in ("factTable", "linkTable", "keyField", "dimensionField", "measureField"))
        if link:
            steps.append(Step(f"Pareto_{fact}", {fact: [key, measure], link: [key, dim]}, lambda m, f=fact, n=link, k=key, d=dim, x=measure: an.pareto(
                m[f], m[n].where(F.col(f"`{k}`").isNotNull()), k, d, x, flag=f"{f}_pareto").withColumnsRenamed(_own(f))))
        else:
            steps.append(Step(f"Pareto_{fact}", {fact: [dim, measure]}, lambda m, f=fact, d=dim, x=measure: an.pareto_self(
                m[f], d, x, flag=f"{f}_pareto").withColumnsRenamed(_own(f))))
    first = [(i, t) for i, t in enumerate(model) if t in facts]
    frame = meta.sparkSession.createDataFrame(first, "tidx int, table string")
    for r in basket_candidate(meta, frame).collect():
        table, id_col, item = r["table"], r["idField"], r["itemField"]
        if is_one_to_many(model[table], id_col, item):
            steps.append(Step(f"Basket_{item}", {table: [id_col, item]}, lambda m, t=table, i=id_col, x=item: an.market_basket(m[t], i, x)))
    return steps


def _own(fact: str) -> dict[str, str]:
    """Pareto columns under names of their own, so that two Pareto tables
    share no field but their dimension."""
    return {"measure_sum": f"{fact}_measure_sum", "cum_share": f"{fact}_cum_share"}


def enrich(
    store: ModelStore, fields: DataFrame | None = None, facts: Sequence[str] = (), counts: DataFrame | None = None
) -> list[dict[str, str]]:
    """Add all steps of the catalog to a saved model, one transaction each, and
    report each; ``fields`` are classified fields (M16), ``counts`` the saved
    model's value counts where they were made before."""
    model = store.read()
    meta = live_metadata(model, counts=counts).transform(materialize)
    return [add_to_store(store, s) for s in enrichment_steps(model, meta, fields, facts)]
