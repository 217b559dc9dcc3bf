"""Sharding by a k-d tree over metadata, with DataFrame operations only.

Starting with all rows as one leaf, the heaviest level of leaves is split at
once: every leaf along the dimension in which its rows spread widest (spread
divided by the whole table's), at the row where half of its bytes lie before.
Leaves stop at the target size, the total divided by the shard count, so 16
shards are four levels.

A weighted median is found without moving rows.  Each pass sums bytes by leaf
and by one of ``BUCKETS`` equal steps of the value range that still holds the
median; the sums are a bounded table (leaves x buckets), the range shrinks by
that factor, and two or three passes reach a single value or a step light
enough.  Ties in the dimension are ordered by a hash of doc_id, then by the
text's checksum, so a value that holds most of the rows is split too.

A level's cuts are one expression over a row's metadata, so rows get their
shard without a shuffle.  Slots come from the rows' order within a
stored partition plus an offset per partition.

Edge cases: a null text has size 1; null dimensions are a value of their own
(the smallest); equal texts are spread like other rows; fully equal rows
cannot be told apart and stay together; an empty table gives an empty result;
input columns other than the dimensions, doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.store import stored

BUCKETS = 4096
#: a step that holds at most this share of its leaf's bytes needs no refining
LIGHT = 1 / 2048
DIMENSIONS = ("doc_id", "n_chars", "lang", "source")
TIES = ("tie", "crc")


@dataclass(frozen=True)
class Cut:
    """Rows of ``leaf`` whose key (dimension, tie, crc) is above ``bounds``
    go to the upper child; a bound of a later key holds only where all
    earlier ones are equal."""

    leaf: int
    keys: tuple[str, ...]
    bounds: tuple[int, ...]

    def above(self) -> Column:
        above = F.lit(False)
        for key, bound in reversed(list(zip(self.keys, self.bounds, strict=True))):
            above = (F.col(key) > bound) | ((F.col(key) == bound) & above)
        return above


def _number(name: str, kind: str) -> Column:
    """A dimension as a non-negative long; text by a checksum of its value."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        value = F.col(name).cast("long")
    else:
        value = F.crc32(F.col(name).cast("string").cast("binary"))
    return F.coalesce(value, F.lit(-1).cast("long")).alias(f"dim_{name}")


def metadata(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One narrow row a document: id, size, checksum and the dimensions."""
    kinds = dict(docs.dtypes)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("crc"),
        F.coalesce(F.xxhash64("doc_id"), F.lit(0).cast("long")).alias("tie"),
        *[_number(d, kinds[d]) for d in dimensions if d in kinds],
    )


def _children(cuts: list[Cut]) -> Column:
    """Leaf of a row after the cuts of one level: root 1, children 2n, 2n + 1."""
    leaf = F.col("leaf")
    for c in cuts:
        leaf = F.when(F.col("leaf") == c.leaf, 2 * c.leaf + c.above().cast("int")).otherwise(leaf)
    return leaf.cast("int")


def _widest(rows: DataFrame, dims: list[str], target: float) -> dict[int, tuple[str, int]]:
    """For each leaf over the target: its dimension and its bytes."""
    spread = [F.stddev_pop(d).alias(d) for d in dims]
    stats = rows.groupBy("leaf").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *spread).collect()
    whole = rows.agg(*spread).first()
    out = {}
    for s in stats:  # one row a leaf
        if s["bytes"] > target and s["n"] > 1:
            shares = [((s[d] or 0) / whole[d] if whole[d] else 0.0, -i, d) for i, d in enumerate(dims)]
            out[s["leaf"]] = (max(shares)[2], s["bytes"])
    return out


def _medians(rows: DataFrame, widest: dict[int, tuple[str, int]], light: float) -> list[Cut]:
    """The cut of each leaf at half its bytes, all leaves of a level together."""
    state = {
        leaf: {"keys": (dim, *TIES), "bounds": [], "need": total / 2, "total": total, "lo": None, "hi": None}
        for leaf, (dim, total) in widest.items()
    }
    open_leaves = set(state)
    while open_leaves:
        key, inside = F.lit(None).cast("long"), F.lit(False)
        for leaf in open_leaves:
            s = state[leaf]
            own = F.col("leaf") == leaf
            for k, b in zip(s["keys"], s["bounds"]):
                own = own & (F.col(k) == b)
            if s["lo"] is not None:
                own = own & F.col(s["keys"][len(s["bounds"])]).between(s["lo"], s["hi"])
            key = F.when(own, F.col(s["keys"][len(s["bounds"])])).otherwise(key)
            inside = inside | own
        fresh = [leaf for leaf in open_leaves if state[leaf]["lo"] is None]
        if fresh:
            ranges = rows.where(inside).select("leaf", key.alias("k")).groupBy("leaf").agg(F.min("k"), F.max("k"))
            for leaf, lo, hi in ranges.collect():  # one row a leaf
                if state[leaf]["lo"] is None:
                    state[leaf].update(lo=lo, hi=hi)
            continue
        width, low = F.lit(1).cast("decimal(20,0)"), F.lit(0).cast("long")
        for leaf in open_leaves:
            s = state[leaf]
            s["width"] = max(1, -(-(s["hi"] - s["lo"] + 1) // BUCKETS))
            width = F.when(F.col("leaf") == leaf, F.lit(s["width"]).cast("decimal(20,0)")).otherwise(width)
            low = F.when(F.col("leaf") == leaf, F.lit(s["lo"]).cast("long")).otherwise(low)
        offset = key.cast("decimal(20,0)") - low.cast("decimal(20,0)")
        sums = (
            rows.where(inside)
            .select("leaf", "size", F.floor(offset / width).cast("int").alias("bucket"))
            .groupBy("leaf", "bucket")
            .agg(F.sum("size").alias("bytes"))
        )
        running = Window.partitionBy("leaf").orderBy("bucket")
        found = sums.withColumn("upto", F.sum("bytes").over(running))
        need = F.lit(0.0)
        for leaf in open_leaves:
            need = F.when(F.col("leaf") == leaf, F.lit(float(state[leaf]["need"]))).otherwise(need)
        at = found.where(F.col("upto") >= need).groupBy("leaf").agg(F.min(F.struct("bucket", "bytes", "upto")).alias("b"))
        for leaf, b in at.collect():  # one row a leaf
            s = state[leaf]
            lo = s["lo"] + b["bucket"] * s["width"]
            hi = min(s["hi"], lo + s["width"] - 1)
            before = b["upto"] - b["bytes"]
            if b["bytes"] <= light * s["total"] or (lo == hi and len(s["bounds"]) + 1 == len(s["keys"])):
                # cut at the nearer side of this step
                bound = hi if b["upto"] - s["need"] <= s["need"] - before else lo - 1
                s["bounds"].append(bound)
                open_leaves.discard(leaf)
            elif lo == hi:
                s["bounds"].append(lo)
                s.update(need=s["need"] - before, lo=None, hi=None)
            else:
                s.update(need=s["need"] - before, lo=lo, hi=hi)
    return [Cut(leaf, s["keys"][: len(s["bounds"])], tuple(s["bounds"])) for leaf, s in state.items()]


def split_leaves(
    rows: DataFrame, target: float, depth: int, light: float = LIGHT
) -> tuple[DataFrame, list[Cut]]:
    """``rows`` (from ``metadata``) with their ``leaf``, and the tree's cuts:
    leaves above ``target`` bytes are split, level by level, at most
    ``depth`` deep.  Each level's leaves are stored with the narrow rows."""
    dims = [c for c in rows.columns if c.startswith("dim_")]
    rows = stored(rows.withColumn("leaf", F.lit(1)), "kd-rows")
    cuts: list[Cut] = []
    for _ in range(depth):
        widest = _widest(rows, dims, target)
        if not widest:
            break
        level = _medians(rows, widest, light)
        cuts += level
        rows = stored(rows.withColumn("leaf", _children(level)), "kd-rows")
    return rows, cuts


def shard_documents(
    docs: DataFrame, shards: int = 16, dimensions: tuple[str, ...] = DIMENSIONS
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs``
    (``shards`` a power of two)."""
    if shards & (shards - 1):
        raise ValueError("shards is a power of two")
    depth = shards.bit_length() - 1
    rows = metadata(docs, dimensions)
    total = rows.agg(F.sum("size")).first()[0] or 0
    # half a target is left: a leaf within that of the target may still be cut
    rows, _ = split_leaves(rows, 1.5 * total / shards, depth)
    leaf = F.col("leaf")
    # a leaf that closed early takes the first shard below it
    shard = F.lit(0)
    for d in range(depth + 1):
        inner = (leaf >= 1 << d) & (leaf < 2 << d)
        shard = F.when(inner, (leaf - (1 << d)) * (1 << (depth - d))).otherwise(shard)
    return number_slots(rows.select("doc_id", "size", "crc", shard.cast("int").alias("shard")))


def number_slots(rows: DataFrame) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, without a shuffle by shard:
    rows are sorted by shard inside each stored partition, where their
    position is known, and shifted by the rows of earlier partitions."""
    laid = rows.sortWithinPartitions("shard").withColumn("place", F.monotonically_increasing_id())
    laid = stored(laid, "kd-slots").withColumn("part", F.shiftright("place", 33))
    runs = laid.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = runs.select("part", "shard", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return laid.join(shift, ["part", "shard"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("place") + F.col("shift")).alias("slot")
    )
