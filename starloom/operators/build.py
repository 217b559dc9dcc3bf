"""Building the star / link-table model (SURVEY 2.2 P1-P5, 2.7 U1,
2.9 M1-M5, D23).

All operators are projections, unions, one dense numbering and distincts:
no join between facts is ever needed to build the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import calendar as cal
from starloom.functions.values import hash_bytes, key_hash
from starloom.operators.ordered import number_distinct

LINK_SOURCE = "%LinkTable_SourceTable"
BRIDGE_SOURCE = "%CanonicalDateBridge_SourceTable"
BRIDGE_KEY = "%DateBridgeKey"
CANONICAL_DATE = "CanonicalDate"
DATE_TYPE = "DateType"


def fact_key_name(fact: str) -> str:
    return f"%Key_{fact}"


# ---------------------------------------------------------------- P2-P5, U1
def drop_fields(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``DROP FIELD .. FROM ..``."""
    return df.drop(*[c for c in cols if c in df.columns])


def concatenate(members: dict[str, DataFrame], source_col: str | None = None) -> DataFrame:
    """U1 (with P2, P3): bag union by column name, nulls for missing columns,
    each row tagged with its member name in ``source_col``."""
    out = None
    for name, df in members.items():
        d = df.withColumn(source_col, F.lit(name)) if source_col else df
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def collapse_facts(model: dict[str, DataFrame], groups: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Each group of similar facts is replaced by one concatenated table
    named after the group, tagged ``%<group>_SourceTable``; profile the
    result again rather than merging statistics."""
    out = {}
    grouped = {m for ms in groups.values() for m in ms}
    for name, df in model.items():
        if name not in grouped:
            out[name] = df
    for g, members in groups.items():
        out[g] = concatenate({m: model[m] for m in members}, f"%{g}_SourceTable")
    return out


# ---------------------------------------------------------------- M1
def composite_keys(
    facts: dict[str, DataFrame],
    grains: dict[str, Sequence[str]],
    partitions: int | None = None,
    mode: str = "number",
) -> dict[str, DataFrame]:
    """M1: ``AutoNumber(Hash128(a & '|' & b ..)) AS [%Key_<fact>]``.

    The hash covers the fact name too, so equal grains of two facts never
    share a key; the integers are numbered once over the union of all facts'
    hashes (sorted hash order), so a key names one fact row-grain only.
    ``mode="hash"`` leaves the 128-bit hash itself as the key: a projection,
    without a shuffle.
    """
    if mode not in ("number", "hash"):
        raise ValueError(f"mode is number or hash, not {mode}")
    hashed = {
        n: df.withColumn("_sl_h", key_hash([F.col(f"`{c}`") for c in grains[n]], prefix=n))
        for n, df in facts.items()
    }
    if mode == "hash":
        return {n: d.withColumnRenamed("_sl_h", fact_key_name(n)) for n, d in hashed.items()}
    # the hash travels as 16 bytes, which sort as its hexadecimal text does
    hashed = {n: d.withColumn("_sl_h", hash_bytes(F.col("_sl_h"), False)) for n, d in hashed.items()}
    all_h = None
    for d in hashed.values():
        h = d.select("_sl_h")
        all_h = h if all_h is None else all_h.unionByName(h)
    ids = number_distinct(all_h.distinct(), ["_sl_h"], "_sl_id", partitions)
    out = {}
    for n, d in hashed.items():
        keyed = d.join(ids, "_sl_h", "left")
        out[n] = keyed.select(*[F.col(f"`{c}`") for c in facts[n].columns], F.col("_sl_id").alias(fact_key_name(n)))
    return out


# ---------------------------------------------------------------- M2
def link_table(
    keyed_facts: dict[str, DataFrame],
    shared: Sequence[str],
    header: str | None = None,
    detail: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """M2: per fact holding a shared field: source tag, its key, the same key
    as ``%DateBridgeKey``, and the shared fields it has; union by name;
    distinct (a link row repeated would multiply joins).  The source tag keeps
    two facts' rows apart, so each fact's are made distinct by themselves,
    before tag, copied key and missing columns are added.

    With ``header`` and ``detail`` (from :func:`header_keys`) a detail row also
    carries its header's key and shared fields, and the bridge key of both is
    the header's; headers without a detail row have rows of their own.

    ``columns``: those of the link table that are asked for; each fact's rows are
    distinct in them and in its key."""
    parts = {}
    for n, df in keyed_facts.items():
        have = [s for s in shared if s in df.columns]
        if not have:
            continue
        k = fact_key_name(n)
        bridge, keys = k, [k]
        if n == detail:
            bridge = fact_key_name(header)
            keys.append(bridge)
        elif n == header:
            df = df.where(~F.col(HAS_DETAIL))
        have = [s for s in have if columns is None or s in columns]
        rows = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *have])]).distinct()
        parts[n] = rows.select(
            F.lit(n).alias(LINK_SOURCE),
            *[F.col(f"`{c}`") for c in keys],
            F.col(f"`{bridge}`").alias(BRIDGE_KEY),
            *[F.col(f"`{s}`") for s in have],
        )
    out = concatenate(parts)
    return out if columns is None else out.select(*[F.col(f"`{c}`") for c in columns])


def short_keys(keyed_facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The facts, whose keys are hashes, with the keys as 16 bytes."""
    keys = {n: fact_key_name(n) for n in keyed_facts}
    return {n: df.withColumn(keys[n], hash_bytes(F.col(f"`{keys[n]}`"), df.schema[keys[n]].nullable)) for n, df in keyed_facts.items()}


HAS_DETAIL = "%HasDetail"


def header_keys(keyed_facts: dict[str, DataFrame], header: str, detail: str, link: str) -> dict[str, DataFrame]:
    """The facts, where each row of ``detail`` has the key and the other
    fields of the ``header`` row with the same ``link`` value, and each header
    row says whether a detail row has its value.  ``link`` is unique in the
    header, so no row is multiplied."""
    key = fact_key_name(header)
    top, low = keyed_facts[header], keyed_facts[detail]
    own = set(low.columns)
    carried = [c for c in top.columns if c == link or c not in own]
    joined = low.join(top.select(*[F.col(f"`{c}`") for c in carried]), link, "left")
    met = low.select(link).where(F.col(f"`{link}`").isNotNull()).distinct().withColumn(HAS_DETAIL, F.lit(True))
    marked = top.join(met, link, "left").withColumn(HAS_DETAIL, F.coalesce(HAS_DETAIL, F.lit(False)))
    return keyed_facts | {detail: joined, header: marked.select(*[F.col(f"`{c}`") for c in [*top.columns, HAS_DETAIL]])}


# ---------------------------------------------------------------- M3
def date_bridge(
    keyed_facts: dict[str, DataFrame],
    dates: Sequence[tuple[str, str]],
    header: str | None = None,
    detail: str | None = None,
) -> DataFrame:
    """M3: one row per (fact key, date field): source, key, ``CanonicalDate``
    (as date), ``DateType`` (the field name); null keys dropped; distinct.
    Dates are read from the facts themselves, so a bridge exists even when
    the strategy made no link table.  Source and type keep the parts apart,
    so each is made distinct by itself.  With ``header`` and ``detail`` (from
    :func:`header_keys`) the dates of both hang on the header's key."""
    parts = []
    for fact, field in dict.fromkeys(dates):
        df = keyed_facts[fact]
        k = fact_key_name(header if fact == detail else fact)
        rows = df.select(
            F.col(f"`{k}`").alias(BRIDGE_KEY), F.col(f"`{field}`").try_cast("date").alias(CANONICAL_DATE)
        ).where(F.col(BRIDGE_KEY).isNotNull())
        parts.append(rows.distinct().select(F.lit(fact).alias(BRIDGE_SOURCE), BRIDGE_KEY, CANONICAL_DATE, F.lit(field).alias(DATE_TYPE)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- M4 / M5
def calendar_dates(facts: dict[str, DataFrame], dates: Sequence[tuple[str, str]]) -> DataFrame:
    """The distinct dates of the ``(fact, field)`` list, as ``CanonicalDate``,
    read from the facts without their keys."""
    out = None
    for fact, field in dates:
        part = facts[fact].select(F.col(f"`{field}`").try_cast("date").alias(CANONICAL_DATE)).distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def master_calendar(dates: DataFrame, date_col: str = CANONICAL_DATE) -> DataFrame:
    """M4: one row per distinct date: Year, Quarter (``Q1``..``Q4``), Month,
    MonthName, MonthYear (``MMM-yyyy``), Week (Sunday weeks restarting on
    Jan 1), Day, WeekDay (name) and WeekDayNum (Sunday = 0)."""
    d = dates.select(F.col(f"`{date_col}`").try_cast("date").alias(date_col)).where(F.col(date_col).isNotNull()).distinct()
    c = F.col(date_col)
    return d.select(
        c,
        F.year(c).alias("Year"),
        cal.quarter_label(c).alias("Quarter"),
        F.month(c).alias("Month"),
        F.date_format(c, "MMM").alias("MonthName"),
        F.date_format(F.trunc(c, "MM"), "MMM-yyyy").alias("MonthYear"),
        cal.broken_week(c).alias("Week"),
        F.dayofmonth(c).alias("Day"),
        F.date_format(c, "EEE").alias("WeekDay"),
        (F.dayofweek(c) - 1).alias("WeekDayNum"),
    )


def relative_deltas(calendar: DataFrame, today: str | Column, date_col: str = CANONICAL_DATE) -> DataFrame:
    """M5: Date, Week, Month, Qtr and Year Diff of each date against
    ``today`` (a parameter: a literal date or a Column, never the clock)."""
    t = F.to_date(F.lit(today)) if isinstance(today, str) else today
    c = F.col(f"`{date_col}`")
    return calendar.withColumns({
        "Date Diff": F.datediff(c, t),
        "Week Diff": cal.week_diff(c, t),
        "Month Diff": cal.month_diff(c, t),
        "Qtr Diff": cal.quarter_diff(c, t),
        "Year Diff": (F.year(c) - F.year(t)),
    })
