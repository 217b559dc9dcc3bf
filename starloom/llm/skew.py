"""Joins on keys of which one may hold a large share of all rows.

A key is heavy if it has more rows than ``total / HEAVY`` (and than
``LEAST``), so there are at most ``HEAVY`` heavy keys whatever the data; their
rows of the other table are broadcast.  All other keys are joined by a
shuffle, where no key has more rows than that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 10_000
LEAST = 500
#: rows of a narrow table that may be broadcast whole
BROADCAST_ROWS = 100_000


def split_join(rows: DataFrame, table: DataFrame, on: str, weight: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row for each value
    of ``on`` and in ``weight`` the number of its rows; ``weight`` is dropped.
    Both should be stored tables, or cheap to read from one, as they are read
    twice.  A null key meets
    nothing."""
    count, total = table.agg(F.count("*"), F.sum(weight)).first()
    if count <= broadcast_rows:
        return rows.join(F.broadcast(table.drop(weight)), on)
    cut = max(LEAST, (total or 0) // HEAVY)
    heavy = table.where(F.col(weight) > cut).drop(weight)
    light = table.where(F.col(weight) <= cut).drop(weight)
    rest = rows.join(F.broadcast(heavy.select(on)), on, "left_anti")
    return rows.join(F.broadcast(heavy), on).unionByName(rest.join(light, on))


def split_left_join(rows: DataFrame, table: DataFrame, on: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row for each value of
    ``on``.  Rows whose key is null keep to themselves, whole tables of up to
    ``broadcast_rows`` are broadcast, and of larger ones the rows of heavy keys."""
    keyed, bare = rows.where(F.col(on).isNotNull()), rows.where(F.col(on).isNull())
    if table.count() <= broadcast_rows:
        met = keyed.join(F.broadcast(table), on, "left")
    else:
        cut = max(LEAST, rows.count() // HEAVY)
        heavy = F.broadcast(keyed.groupBy(on).count().where(F.col("count") > cut).select(on))
        few = F.broadcast(table.join(heavy, on, "left_semi"))
        light = keyed.join(heavy, on, "left_anti").join(table, on, "left")
        met = keyed.join(heavy, on, "left_semi").join(few, on, "left").unionByName(light)
    return met.unionByName(bare, allowMissingColumns=True)
