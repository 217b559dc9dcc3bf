"""Analytic tables added on top of a model.

Every function takes and returns DataFrames; nothing is collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.operators.ordered import dense_ids, number_distinct, running_sum
from starloom.session import stage

# Labels of the Pareto flag and the as-of period types.
PARETO_TOP_LABEL = "Top 80%"
PARETO_BOTTOM_LABEL = "Bottom 20%"
CURRENT_DAY_LABEL = "Current Day"


# ---------------------------------------------------------------- A8 / A9 / A10
def sum_by(df: DataFrame, dim: str | Sequence[str], measure: str, out: str = "_SumMeasure") -> DataFrame:
    """``Sum(measure) GROUP BY dim`` (partial aggregation map-side)."""
    dims = [dim] if isinstance(dim, str) else list(dim)
    return df.groupBy(*dims).agg(F.sum(measure).alias(out))


def grand_total(df: DataFrame, measure: str, out: str = "_Total") -> DataFrame:
    """Attach the grand total of ``measure`` to every row.

    ``Peek`` of a one-row total becomes a scalar subquery: computed once
    (partial sums, then one row), no join.
    """
    return df.withColumn(out, df.agg(F.sum(measure)).scalar())


# ---------------------------------------------------------------- W1 / W2 / T1
def cumulative_share(
    df: DataFrame,
    measure: str,
    dim: str | Sequence[str],
    acc: str = "_AccMeasure",
    share: str = "cum_share",
    partitions: int | None = None,
) -> DataFrame:
    """W1 + A9 + W2: running sum of ``measure`` in descending order (dimension
    ascending breaks ties) divided by the grand total.

    Uses the range-partitioned prefix sum, never a single-partition window.
    """
    dims = [dim] if isinstance(dim, str) else list(dim)
    order = [F.col(measure).desc_nulls_last()] + [F.col(d).asc_nulls_first() for d in dims]
    res = running_sum(df, order, measure, acc, total="_Total", partitions=partitions)
    return res.withColumn(
        share,
        F.try_divide(F.col(acc).cast("double"), F.col("_Total").cast("double")),
    ).drop("_Total")


# ---------------------------------------------------------------- M8 / M9 Pareto
def pareto_self(
    fact: DataFrame,
    dim: str,
    measure: str,
    cut: float = 0.8,
    flag: str = "pareto_flag",
    partitions: int | None = None,
) -> DataFrame:
    """M9: Pareto segmentation of ``dim`` by ``measure`` inside one table.

    Output: ``dim, measure_sum, cum_share, <flag>, <flag>_num`` where the flag
    is ``Top 80%``/1 while the cumulative share is <= ``cut`` and
    ``Bottom 20%``/0 after it.
    """
    agg = sum_by(fact, dim, measure, "measure_sum")
    shared = cumulative_share(agg, "measure_sum", dim, partitions=partitions)
    top = F.col("cum_share") <= F.lit(cut)
    return shared.select(
        dim,
        "measure_sum",
        "cum_share",
        F.when(top, F.lit(PARETO_TOP_LABEL)).otherwise(F.lit(PARETO_BOTTOM_LABEL)).alias(flag),
        F.when(top, F.lit(1)).otherwise(F.lit(0)).alias(f"{flag}_num"),
    )


def left_link_join(fact: DataFrame, link: DataFrame, key: str | Sequence[str], dim: str) -> DataFrame:
    """LEFT JOIN of the link table's dimension onto fact rows by key."""
    keys = [key] if isinstance(key, str) else list(key)
    return fact.join(link.select(*keys, dim).distinct(), keys, "left")


def pareto(
    fact: DataFrame,
    link: DataFrame,
    key: str,
    dim: str,
    measure: str,
    cut: float = 0.8,
    flag: str = "pareto_flag",
    partitions: int | None = None,
) -> DataFrame:
    """M8: Pareto of a dimension that lives in a link table.

    The measure is summed per key *before* the join (sum distributes over the
    left join's row multiplication), so the shuffle carries one row per key
    instead of one per fact row.
    """
    per_key = fact.groupBy(key).agg(F.sum(measure).alias(measure))
    joined = left_link_join(per_key, link, key, dim)
    return pareto_self(joined, dim, measure, cut=cut, flag=flag, partitions=partitions)


# ---------------------------------------------------------------- M10 basket
#: rows of different (id, item) that a task joins with themselves
BASKET_TASK_ROWS = 500_000


def market_basket(
    df: DataFrame,
    id_col: str,
    item: str,
    out: str = "CoOccurrences",
    co_prefix: str = "Co_",
    cell_items: int = 2048,
    task_rows: int = BASKET_TASK_ROWS,
) -> DataFrame:
    """Ordered co-occurrence counts of two different items in one id.

    ``Count(id)`` over the self-join equals ``sum(n_a * n_b)`` over the
    pre-aggregated ``(id, item, n)`` rows, so repeats multiply as in the
    row-level join while each basket ships each distinct item once.

    Skew: a basket with ``k`` distinct items yields ``k^2`` output pairs.  To
    spread one huge basket over many tasks its items are hashed into ``s``
    chunks (``s = ceil(k / cell_items)``) and the pairs are produced on an
    ``s x s`` grid of ``(id, chunk_i, chunk_j)`` join keys; an ordinary basket
    has ``s = 1`` and is not replicated.  No row is dropped or capped.

    Memory: the ``(id, item, n)`` rows are written once, and dealt out by
    basket in as many parts as there are ``task_rows`` in them, so a task sorts
    and counts about that many rows however large the table is.
    """
    co_item = f"{co_prefix}{item}"
    base = df.select(id_col, item).where(F.col(id_col).isNotNull() & F.col(item).isNotNull())
    counted = stage(base.groupBy(id_col, item).agg(F.count(F.lit(1)).alias("_n")), "baskets")
    huge = counted.groupBy(id_col).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > cell_items)
    huge = stage(huge.select(id_col, F.ceil(F.col("_k") / F.lit(cell_items)).cast("int").alias("_s")), "huge")
    sized = counted.join(huge, id_col, "left").withColumn("_s", F.coalesce("_s", F.lit(1)))
    parts = max(1, math.ceil(counted.count() / task_rows))
    chunk = F.pmod(F.xxhash64(F.col(item)), F.col("_s").cast("long")).cast("int")
    grid = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    left = sized.select(id_col, item, "_n", chunk.alias("_ci"), grid.alias("_cj"))
    right = sized.select(
        id_col,
        F.col(item).alias(co_item),
        F.col("_n").alias("_n2"),
        grid.alias("_ci"),
        chunk.alias("_cj"),
    )
    cell = [id_col, "_ci", "_cj"]
    pairs = left.repartition(parts, *cell).join(right.repartition(parts, *cell), cell).where(F.col(item) < F.col(co_item))
    counts = pairs.groupBy(item, co_item).agg(F.sum(F.col("_n") * F.col("_n2")).alias(out))
    # the count of a pair is that of its mirror, so one direction is joined
    there = F.struct(F.col(item), F.col(co_item), F.col(out))
    back = F.struct(F.col(co_item).alias(item), F.col(item).alias(co_item), F.col(out))
    return counts.select(F.inline(F.array(there, back)))


# ---------------------------------------------------------------- M6 / M7 as-of
def as_of_table(
    df: DataFrame,
    date_col: str,
    months: int = 12,
    as_of: str = "AsOf Date",
    period: str = "Period Type",
) -> DataFrame:
    """M6: one ``Current Day`` row per distinct date plus ``months`` rows
    ``Rolling <months> Months`` with the date shifted back 0..months-1
    months (month-end clamped, like ``add_months``)."""
    dates = df.select(F.col(date_col).try_cast("date").alias("_d")).where(F.col("_d").isNotNull()).distinct()
    current = dates.select(
        F.col("_d").alias(as_of), F.col("_d").alias(date_col), F.lit(CURRENT_DAY_LABEL).alias(period)
    )
    rolling = dates.select(F.col("_d"), F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("_i")).select(
        F.col("_d").alias(as_of),
        F.add_months(F.col("_d"), -F.col("_i")).alias(date_col),
        F.lit(f"Rolling {months} Months").alias(period),
    )
    return current.unionByName(rolling)


def as_of_aggregate(
    fact: DataFrame,
    as_of: DataFrame,
    date_col: str,
    measure: str,
    out: str = "measure_sum",
    as_of_col: str = "AsOf Date",
    period: str = "Period Type",
) -> DataFrame:
    """M7: the measure per as-of date and period type.

    The fact is reduced to one row per date first, so the join never sees a
    hot date with many rows; shifted dates missing from the data drop out
    (inner join).
    """
    per_date = fact.groupBy(F.col(date_col).try_cast("date").alias(date_col)).agg(F.sum(measure).alias("_m"))
    joined = as_of.join(per_date, date_col)
    return joined.groupBy(as_of_col, period).agg(F.sum("_m").alias(out))


# ---------------------------------------------------------------- M11 / M12 / W3
def encode_flag(df: DataFrame, field: str, values: Sequence[str], out: str | None = None) -> DataFrame:
    """``Dual(f, Match(f, v1, v2, ..))``: text stays, ``<f>_Dual`` is the
    1-based position in ``values`` (case-sensitive), 0 if absent, null if null."""
    out = out or f"{field}_Dual"
    arr = F.array(*[F.lit(v) for v in values])
    pos = F.array_position(arr, F.col(field)).cast("int")
    return df.withColumn(out, F.when(F.col(field).isNull(), F.lit(None).cast("int")).otherwise(pos))


def dense_key(df: DataFrame, cols: Sequence[str], out: str, partitions: int | None = None) -> DataFrame:
    """``AutoNumber``: each distinct value (tuple) of ``cols`` gets an
    integer 1..N in sorted order."""
    return dense_ids(df, list(cols), out, partitions=partitions)


def encode_keys(model: dict[str, DataFrame], fields: Sequence[str]) -> dict[str, DataFrame]:
    """``AutoNumber f1, f2``: every listed field is replaced by an integer,
    numbered once over the union of its values in all tables so joins on the
    field still line up."""
    out = dict(model)
    for f in fields:
        holders = [n for n, d in out.items() if f in d.columns]
        if not holders:
            continue
        values = None
        for n in holders:
            v = out[n].select(F.col(f).cast("string").alias("_v"))
            values = v if values is None else values.unionByName(v)
        ids = number_distinct(values.distinct(), ["_v"], "_id")
        for n in holders:
            d = out[n]
            cols = [F.col("_id").alias(f) if c == f else F.col(c) for c in d.columns]
            d = d.withColumn("_v", F.col(f).cast("string"))
            # rows without a value keep to themselves: they would be one join key
            keyed = d.where("_v IS NOT NULL").join(ids, "_v", "left").select(*cols)
            bare = d.where("_v IS NULL").withColumn("_id", F.lit(None).cast("long")).select(*cols)
            out[n] = keyed.unionByName(bare)
    return out
