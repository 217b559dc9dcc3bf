"""Globally ordered operators that must not collapse into one task.

A window without ``partitionBy`` (running sum, row numbering) plans an
``Exchange SinglePartition``: the whole input in one task.  The two
operators here keep the work spread out instead:

1. range-partition the rows on the sort key (balanced by sampling),
2. checkpoint that layout, so every later use sees the same partition
   assignment even after a lost executor forces a recomputation,
3. compute per-partition results locally (window per partition),
4. derive per-partition offsets from a table with one row per partition
   (bounded by the partition count, hence safe to broadcast),
5. add the offset back.

The sort key must be total (add a tie-breaker) for results to be
deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import materialize

_PID = "_sl_pid"
_MID = "_sl_mid"


def _range_layout(df: DataFrame, order: list[Column], partitions: int | None) -> DataFrame:
    from starloom.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may coalesce the range shuffle to the
    # data's size; it only merges adjacent ranges, so partition ids stay in
    # key order.
    ranged = df.repartitionByRange(int(partitions), *order) if partitions else df.repartitionByRange(*order)
    laid = (
        ranged
        .sortWithinPartitions(*order)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    # Reliable checkpoint: freezes the sampled range bounds and the ids.
    return laid.transform(materialize)


def _offsets(laid: DataFrame, value: Column, name: str) -> DataFrame:
    """One row per partition: exclusive prefix of ``value`` and the total."""
    per_part = laid.groupBy(_PID).agg(value.alias("_part"))
    w = Window.orderBy(_PID)
    return per_part.select(
        _PID,
        F.coalesce(
            F.sum("_part").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0).cast(per_part.schema["_part"].dataType),
        ).alias(f"{name}_offset"),
        F.sum("_part").over(Window.partitionBy(F.lit(1))).alias(f"{name}_total"),
    )


def running_sum(
    df: DataFrame,
    order: list[Column],
    value: str,
    out: str,
    total: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over all rows up to and including this
    one in the global ``order``; optionally ``total`` = the grand total."""
    laid = _range_layout(df, order, partitions)
    offs = _offsets(laid, F.sum(value), "_sl")
    w = Window.partitionBy(_PID).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    res = laid.withColumn("_sl_local", F.sum(value).over(w)).join(F.broadcast(offs), _PID)
    res = res.withColumn(out, F.col("_sl_offset") + F.col("_sl_local"))
    if total:
        res = res.withColumn(total, F.col("_sl_total"))
    return res.drop(_PID, _MID, "_sl_local", "_sl_offset", "_sl_total")


def number_distinct(keys: DataFrame, cols: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """``cols`` and ``out``: the rows of ``keys``, which are distinct in
    ``cols``, numbered 1..N in ascending sort order (nulls first)."""
    laid = _range_layout(keys.select(*cols), [F.col(c).asc_nulls_first() for c in cols], partitions)
    offs = _offsets(laid, F.count(F.lit(1)), "_sl")
    place = F.col("_sl_offset") + (F.col(_MID) - F.shiftleft(F.col(_PID).cast("long"), 33)) + 1
    return laid.join(F.broadcast(offs), _PID).select(*cols, place.cast("long").alias(out))


def dense_ids(
    df: DataFrame,
    cols: list[str],
    out: str,
    partitions: int | None = None,
) -> DataFrame:
    """Number the distinct values of ``cols`` 1..N in ascending sort order
    (nulls first) and join the number back as ``out``.

    Equivalent to ``dense_rank() OVER (ORDER BY cols)`` without funnelling
    the key set through one task.
    """
    ids = number_distinct(df.select(*cols).distinct(), cols, out, partitions)
    cond = [df[c].eqNullSafe(ids[c]) for c in cols]
    joined = df.join(ids, cond, "left")
    return joined.select(*[df[c] for c in df.columns], ids[out])
