"""Chart-style aggregates.

A chart is a grouped aggregate of measures over dimensions with null
dimension values suppressed, zeros kept, a sort spec and a first page.  It is
asked of a model by field names (``association.ChartModel`` and ``Measure``),
or of one frame with measures as columns.
``rollup_through`` is the path of staged sums written by hand: it aggregates
at each grain before the next join (sum and count distribute over the joins),
so every join sees one row per key instead of one per fact row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators.association import ChartModel, Measure

# Chart page and line-chart limits.
PAGE_ROWS = 500
PAGE_COLUMNS = 17
MAX_LINES = 12
MAX_POINTS = 2000


def associate(tables: Sequence[DataFrame], how: str = "left") -> DataFrame:
    """Implicit association: each next table joins on every column name
    it shares with what is joined so far.  A table that shares none is an
    island; it has no place in the rows and is refused."""
    out = tables[0]
    for t in tables[1:]:
        on = [c for c in t.columns if c in out.columns]
        if not on:
            raise ValueError(f"no column links {t.columns} to {out.columns}")
        out = out.join(t, on, how)
    return out


@dataclass
class Hop:
    """One join step of :func:`rollup_through`: ``table`` is joined on
    ``table[key] == current grain``; ``next_key`` becomes the new grain."""

    table: DataFrame
    key: str
    next_key: str


def rollup_through(fact: DataFrame, grain: str, sums: dict[str, Column], hops: Sequence[Hop]) -> DataFrame:
    """H5 staged aggregation: ``sums`` (additive measures) are summed per
    ``grain``, carried through each hop and re-summed per the hop's
    ``next_key``.  Returns ``(last next_key, *sums)``; rows whose key finds no
    partner keep a null key (left joins)."""
    cur = fact.groupBy(grain).agg(*[e.alias(n) for n, e in sums.items()])
    for h in hops:
        right = h.table.select(F.col(h.key).alias(grain), F.col(h.next_key).alias("_nk"))
        cur = cur.join(right, grain, "left").groupBy(F.col("_nk").alias(h.next_key)).agg(
            *[F.sum(n).alias(n) for n in sums]
        )
        grain = h.next_key
    return cur


def set_sum(measure: Column, condition: Column) -> Column:
    """``Sum({<cond>} measure)``: the measure where the condition holds."""
    return F.sum(F.when(condition, measure))


Measures = dict[str, Column] | dict[str, Measure]


def _check_page(dims: Sequence[str], measures: Measures, limit: int | None) -> None:
    if limit is not None and len(dims) + len(measures) > limit:
        raise ValueError(f"a chart page holds at most {limit} columns")


def _grouped(source: DataFrame | ChartModel, dims: Sequence[str], measures: Measures, via: Sequence[str]) -> DataFrame:
    if isinstance(source, ChartModel):
        return source.aggregate(dims, measures, via)
    return source.dropna(subset=list(dims)).groupBy(*dims).agg(*[e.alias(n) for n, e in measures.items()])


def sort_spec(dims: Sequence[str], measures: Sequence[str], order_by: str = "dims") -> list[Column]:
    """T4: dimensions ascending, measures descending, in column order;
    ``order_by="measure"`` puts the first measure first."""
    d = [F.col(x).asc_nulls_last() for x in dims]
    m = [F.col(x).desc_nulls_last() for x in measures]
    return m[:1] + d + m[1:] if order_by == "measure" else d + m


def kpi(df: DataFrame | ChartModel, measures: Measures) -> DataFrame:
    """One row of measures, no dimension."""
    if isinstance(df, ChartModel):
        return df.aggregate([], measures)
    return df.agg(*[e.alias(n) for n, e in measures.items()])


def bar(
    df: DataFrame | ChartModel,
    dims: Sequence[str],
    measures: Measures,
    order_by: str = "dims",
    page: int | None = None,
    via: Sequence[str] = (),
    max_columns: int | None = PAGE_COLUMNS,
) -> DataFrame:
    """One dimension with n measures, or two dimensions with one
    measure; null dimension values suppressed, zero measures kept; sorted
    (T4), and only the first ``page`` rows if a page is asked for (T2).
    ``via``: tables of a model that the path must hold."""
    if not ((len(dims) == 1 and len(measures) >= 1) or (len(dims) == 2 and len(measures) == 1)):
        raise ValueError("bar: (1 dimension, n measures) or (2 dimensions, 1 measure)")
    _check_page(dims, measures, max_columns)
    out = _grouped(df, dims, measures, via).orderBy(*sort_spec(dims, list(measures), order_by))
    return out if page is None else out.limit(page)


def line(
    df: DataFrame | ChartModel,
    time: str,
    measures: Measures,
    series: str | None = None,
    max_lines: int | None = None,
    max_points: int | None = None,
    via: Sequence[str] = (),
    max_columns: int | None = PAGE_COLUMNS,
) -> DataFrame:
    """Measures over time (optionally per series); gaps stay gaps (no
    zero fill); if asked, at most ``max_lines`` series -- the ones with the largest
    total of the first measure, name breaking ties -- and ``max_points``
    points per series in time order (T3)."""
    dims = [time] + ([series] if series else [])
    _check_page(dims, measures, max_columns)
    g = _grouped(df, dims, measures, via)
    first = next(iter(measures))
    if series:
        if max_lines is not None:
            g = g.join(top_series(g, series, first, max_lines), series, "left_semi")
        if max_points is not None:
            wp = Window.partitionBy(series).orderBy(time)
            g = g.withColumn("_p", F.row_number().over(wp)).where(F.col("_p") <= max_points).drop("_p")
        return g
    out = g.orderBy(time)
    return out if max_points is None else out.limit(max_points)


def table_view(
    df: DataFrame | ChartModel, dims: Sequence[str], measures: Measures, order_by: str = "dims", via: Sequence[str] = ()
) -> DataFrame:
    """Any dimensions x any measures, no totals row, sorted (T4)."""
    return _grouped(df, dims, measures, via).orderBy(*sort_spec(dims, list(measures), order_by))


def top_series(df: DataFrame, series: str, measure: str, k: int = MAX_LINES) -> DataFrame:
    """T3 helper: the ``k`` series with the largest total of ``measure``
    (name breaks ties).  ``orderBy().limit(k)`` plans a distributed top-k
    (each partition keeps k rows), never a single-partition window."""
    totals = df.groupBy(series).agg(F.sum(measure).alias("_tot"))
    return totals.orderBy(F.col("_tot").desc_nulls_last(), F.col(series).asc()).limit(k).select(series)
