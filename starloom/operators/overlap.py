"""Relationship discovery by distinct-value overlap (SURVEY 2.3 J4, 2.7 U2/U3,
2.8 D2-D5).

Data-scale work is one shuffle for all pairs, on ``value``:

* ``values``: distinct ``(tidx, pos, value)`` rows (from the profiler's single
  value aggregation), filtered to columns that can be in a pair;
* grouped by value to the set of columns that hold it.  A value is in a column
  once, so a group has at most one row per column of the model, whatever the
  data: there is no hot key;
* equal column sets are counted (map-side first), and only these counts
  (``held_sets``) meet the pair catalog.

Pairs of columns (D2) are found without comparing every column with every
other: names by an index of their substrings, identifier-like columns by the
column sets, so that only columns which share a value meet.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.names import ID_LIKE_PATTERN, squash_name
from starloom.functions.values import round_ratio
from starloom.operators.profile import catalog, distinct_values, value_counts
from starloom.session import stage

#: columns whose bits one long holds, and the most longs that a set is kept in
SET_BITS = 62
SET_LONGS = 8
PAIR_COLS = ["tableA", "fieldA", "tableB", "fieldB"]


def column_id(tidx: str, pos: str) -> Column:
    """One long for a column of the model: table index and position."""
    return (F.col(tidx).cast("long") * 1_000_000 + F.col(pos)).cast("long")


def _gate(fields: DataFrame) -> DataFrame:
    """The non-empty columns with what the pair gate looks at."""
    return fields.where(F.col("distinctCount") > 0).select(
        column_id("tidx", "pos").alias("col"), "table", "field", "distinctCount",
        squash_name(F.col("field")).alias("sq"),
        F.col("field").rlike(ID_LIKE_PATTERN).alias("idl"),
    )


def _name_pairs(gate: DataFrame) -> DataFrame:
    """(colA, colB), colA < colB, of columns whose squashed names are equal or
    one within the other: the distinct substrings of each name meet the whole
    names.  An empty squashed name is within no other name."""
    size = F.length("sq")
    parts = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda n: F.substring(F.col("sq"), i, n)),
        )
    )
    index = gate.select(F.col("col").alias("long"), F.explode(F.when(size > 0, F.array_distinct(parts)).otherwise(F.array(F.lit("")))).alias("sq"))
    met = index.join(gate.select(F.col("col").alias("short"), "sq"), "sq").where(F.col("long") != F.col("short"))
    return met.select(F.least("long", "short").alias("colA"), F.greatest("long", "short").alias("colB")).distinct()


def _id_pairs(gate: DataFrame, held: DataFrame) -> DataFrame:
    """(colA, colB), colA < colB, of identifier-like columns that share a value."""
    ids = gate.where("idl").select("col")
    flat = held.select("cols", F.explode("cols").alias("col")).join(ids, "col")
    sets = flat.groupBy("cols").agg(F.array_sort(F.collect_list("col")).alias("ids")).where(F.size("ids") > 1)
    one = sets.select(F.col("ids").alias("cols")).distinct().select("cols", F.explode("cols").alias("colA"))
    return one.select("colA", F.explode(F.filter("cols", lambda c: c > F.col("colA"))).alias("colB")).distinct()


def gate_columns(fields: DataFrame) -> DataFrame:
    """``col`` of the columns that can be in a pair: identifier-like ones and
    those in a pair by name."""
    gate = _gate(fields)
    named = _name_pairs(gate)
    return gate.where("idl").select("col").union(named.select("colA")).union(named.select("colB")).distinct()


def candidate_pairs(fields: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Pairs of non-empty columns worth comparing.

    ``fields`` needs ``tidx, table, pos, field, distinctCount`` (profile).
    A pair is kept when the squashed names (lowercase, no whitespace or
    ``_``) are equal or one contains the other, or when both names look like
    identifiers and, by ``held`` (:func:`held_sets`), share a value; without
    ``held`` pairs of the second kind are left out.  Pairs are ordered by (table
    index, position); same-table pairs are included (the scorer drops them).
    """
    gate = _gate(fields)
    met = _name_pairs(gate)
    if held is not None:
        met = met.union(_id_pairs(gate, held)).distinct()
    side = lambda x: gate.select(
        F.col("col").alias(f"col{x}"), F.col("table").alias(f"table{x}"), F.col("field").alias(f"field{x}"),
        F.col("distinctCount").alias(f"size{x}"),
    )
    return met.join(side("A"), "colA").join(side("B"), "colB").select(*PAIR_COLS, "sizeA", "sizeB", "colA", "colB")


def all_id_pairs(fields: DataFrame) -> DataFrame:
    """The pairs of two identifier-like columns, shared value or not, in the
    form of :func:`candidate_pairs`: for the sketch path, which has no values.
    Each column meets the sorted list of the others, one row a column."""
    gate = _gate(fields).where("idl")
    side = lambda x: gate.select(
        F.col("col").alias(f"col{x}"), F.col("table").alias(f"table{x}"), F.col("field").alias(f"field{x}"),
        F.col("distinctCount").alias(f"size{x}"),
    )
    every = gate.agg(F.array_sort(F.collect_list("col")).alias("cols")).select("cols")
    one = every.select(F.col("cols"), F.explode("cols").alias("colA"))
    met = one.select("colA", F.explode(F.filter("cols", lambda c: c > F.col("colA"))).alias("colB"))
    return met.join(side("A"), "colA").join(side("B"), "colB").select(*PAIR_COLS, "sizeA", "sizeB", "colA", "colB")


def held_sets(values: DataFrame, columns: DataFrame) -> DataFrame:
    """(cols, n): each set of two or more of ``columns`` (``col``) that hold the
    very same value, and how many values it holds.

    ``values``: ``(tidx, pos, value)`` distinct.  ``columns`` has one row per
    column of the model, whose schema the driver holds, so it is broadcast.

    While values are grouped a set is bits in a few longs, one bit a column; it
    becomes a list of columns when equal sets have been counted.  Where there are
    too many columns for that, the list itself is grouped."""
    known = sorted(r["col"] for r in columns.select("col").distinct().collect())  # one row per column of the model
    cells = values.select(column_id("tidx", "pos").alias("col"), "value")
    if len(known) > SET_BITS * SET_LONGS:
        cell = cells.join(F.broadcast(values.sparkSession.createDataFrame([(c,) for c in known], "col long")), "col", "left_semi")
        held = cell.groupBy("value").agg(F.array_sort(F.collect_set("col")).alias("cols"))
        return held.where(F.size("cols") > 1).groupBy("cols").agg(F.count(F.lit(1)).alias("n"))
    places = values.sparkSession.createDataFrame([(c, i // SET_BITS, 1 << (i % SET_BITS)) for i, c in enumerate(known)], "col long, word int, bit long")
    words = [f"_w{w}" for w in range(max(1, math.ceil(len(known) / SET_BITS)))]
    cell = cells.join(F.broadcast(places), "col")
    bits = [F.coalesce(F.bit_or(F.when(F.col("word") == w, F.col("bit"))), F.lit(0).cast("long")).alias(name) for w, name in enumerate(words)]
    held = cell.groupBy("value").agg(*bits)
    many = functools.reduce(lambda a, b: a + b, [F.bit_count(w) for w in words]) > 1
    sets = held.where(many).groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    listed = [
        F.when(F.getbit(words[i // SET_BITS], F.lit(i % SET_BITS)) == 1, F.lit(c).cast("long")) for i, c in enumerate(known)
    ]
    cols = F.array_compact(F.array(*listed)) if listed else F.array().cast("array<long>")
    return sets.select(cols.alias("cols"), "n")


def intersections_of(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """``|values(A) ∩ values(B)|`` for every pair (pairs with an
    empty intersection are absent), from :func:`held_sets` of their columns."""
    hits = held.select("cols", "n", F.explode("cols").alias("colA")).join(pairs.select(*PAIR_COLS, "colA", "colB"), "colA")
    hits = hits.where(F.array_contains("cols", F.col("colB")))
    return hits.groupBy(*PAIR_COLS).agg(F.sum("n").alias("intersectionCount"))


def intersections(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """:func:`intersections_of` from the values themselves."""
    used = pairs.select(F.explode(F.array("colA", "colB")).alias("col")).distinct()
    return intersections_of(held_sets(values, used), pairs)


def value_overlap(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """D3: pairs sharing values with ``inter/|A| > 0.1`` or ``inter/|B| > 0.1``.

    Columns: ``tableA, fieldA, tableB, fieldB, sizeA, sizeB,
    intersectionCount, overlapRatioA, overlapRatioB`` (ratios half-up to 4
    decimals).
    """
    return overlap_from(intersections(values, pairs).join(pairs, PAIR_COLS))


def overlap_from(inter: DataFrame) -> DataFrame:
    """D3 from already counted intersections (pair columns, sizes and
    ``intersectionCount``)."""
    i = F.col("intersectionCount")
    keep = (i > 0) & ((i * 10 > F.col("sizeA")) | (i * 10 > F.col("sizeB")))
    return inter.where(keep).select(
        *PAIR_COLS,
        "sizeA",
        "sizeB",
        "intersectionCount",
        round_ratio(i, F.col("sizeA"), 4).alias("overlapRatioA"),
        round_ratio(i, F.col("sizeB"), 4).alias("overlapRatioB"),
    )


def subset_links(inter: DataFrame) -> DataFrame:
    """``subset`` within ``superset``: at least 95 % of the subset's
    values occur in a strictly larger superset.  ``inter`` needs the pair
    columns, sizes and ``intersectionCount`` (all candidate pairs)."""
    i = F.col("intersectionCount")
    a_in_b = (i * 100 >= F.col("sizeA") * 95) & (F.col("sizeA") < F.col("sizeB"))
    b_in_a = (i * 100 >= F.col("sizeB") * 95) & (F.col("sizeB") < F.col("sizeA"))
    return inter.where(a_in_b | b_in_a).select(
        F.when(a_in_b, F.concat_ws(".", "tableA", "fieldA")).otherwise(F.concat_ws(".", "tableB", "fieldB")).alias("subset"),
        F.when(a_in_b, F.concat_ws(".", "tableB", "fieldB")).otherwise(F.concat_ws(".", "tableA", "fieldA")).alias("superset"),
    )


def alias_overlap(
    values: DataFrame | None,
    fields: DataFrame,
    existing: DataFrame,
    known: DataFrame | None = None,
    count: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Pairs the name gate missed but that share a semantic alias.

    ``fields``: ``tidx, table, pos, field, type, alias, distinctCount``; only
    IDENTIFIER/ATTRIBUTE fields with an alias take part, from different
    tables.  Pairs already in ``existing`` (either orientation) are skipped.
    Any shared value suffices; ratios are not rounded; ``discoveredBy`` is
    ``AI_INTENT``.  ``known`` has intersections that were already counted; the
    others are counted by ``count(pairs)``, by default :func:`intersections`.
    """
    count = count or (lambda pairs: intersections(values, pairs))
    f = fields.where(F.col("type").isin("IDENTIFIER", "ATTRIBUTE") & F.col("alias").isNotNull()).select(
        "tidx", "table", "pos", "field", "alias", "distinctCount"
    )
    a = f.select(*[F.col(c).alias(f"{c}_a") for c in f.columns])
    b = f.select(*[F.col(c).alias(f"{c}_b") for c in f.columns])
    order = (F.col("tidx_a") < F.col("tidx_b")) | (
        (F.col("tidx_a") == F.col("tidx_b")) & (F.col("pos_a") < F.col("pos_b"))
    )
    pairs = a.join(b, (F.col("alias_a") == F.col("alias_b")) & order & (F.col("table_a") != F.col("table_b"))).select(
        F.col("table_a").alias("tableA"),
        F.col("field_a").alias("fieldA"),
        F.col("table_b").alias("tableB"),
        F.col("field_b").alias("fieldB"),
        F.col("distinctCount_a").alias("sizeA"),
        F.col("distinctCount_b").alias("sizeB"),
        column_id("tidx_a", "pos_a").alias("colA"),
        column_id("tidx_b", "pos_b").alias("colB"),
    )
    ex = existing.select(*PAIR_COLS)
    ex = ex.unionByName(ex.select(
        F.col("tableB").alias("tableA"), F.col("fieldB").alias("fieldA"),
        F.col("tableA").alias("tableB"), F.col("fieldA").alias("fieldB"),
    ))
    pairs = pairs.join(ex, PAIR_COLS, "left_anti")
    if known is not None:
        # Pairs whose intersection was already counted (candidate pairs) are
        # looked up; only the others are probed against the values again.
        k = known.select(*PAIR_COLS, "intersectionCount")
        k = k.unionByName(k.select(
            F.col("tableB").alias("tableA"), F.col("fieldB").alias("fieldA"),
            F.col("tableA").alias("tableB"), F.col("fieldA").alias("fieldB"), "intersectionCount",
        ))
        seen = known.select(*PAIR_COLS)
        seen = seen.unionByName(seen.select(
            F.col("tableB").alias("tableA"), F.col("fieldB").alias("fieldA"),
            F.col("tableA").alias("tableB"), F.col("fieldA").alias("fieldB"),
        ))
        looked_up = pairs.join(k, PAIR_COLS)
        fresh = pairs.join(seen, PAIR_COLS, "left_anti")
        inter = looked_up.unionByName(count(fresh).join(fresh, PAIR_COLS))
    else:
        inter = count(pairs).join(pairs, PAIR_COLS)
    i = F.col("intersectionCount")
    return inter.where(i > 0).select(
        *PAIR_COLS,
        "sizeA",
        "sizeB",
        "intersectionCount",
        (i / F.col("sizeA")).alias("overlapRatioA"),
        (i / F.col("sizeB")).alias("overlapRatioB"),
        F.lit("AI_INTENT").alias("discoveredBy"),
    )


# ---------------------------------------------------------------- sketch path (H4)
def column_sketches(tables: dict[str, DataFrame], lg_nom_entries: int = 12) -> DataFrame:
    """``(table, field, sketch)``: a theta sketch of each column's distinct
    non-missing text values.

    One wide aggregate per table; sketches merge map-side and stay bounded
    (about ``2**lg_nom_entries`` hashes each), so no value ever crosses the
    network.  Below ``2**lg_nom_entries`` distinct values a sketch is exact.
    """
    from starloom.functions.values import is_missing

    out = None
    for name, df in tables.items():
        cols = df.columns
        aggs = []
        for i, c in enumerate(cols):
            v = df[f"`{c}`"].cast("string")
            aggs.append(F.theta_sketch_agg(F.when(~is_missing(v), v), lg_nom_entries).alias(f"s{i}"))
        rows = F.array(*[
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("field"), F.col(f"s{i}").alias("sketch"))
            for i, c in enumerate(cols)
        ])
        part = df.agg(*aggs).select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


#: deviations within which a sketch's estimate is trusted
SIGMAS = 5.0


def sketch_bounds(sketches: DataFrame, pairs: DataFrame, lg_nom_entries: int = 12) -> DataFrame:
    """The pairs with their sizes and ``|A ∩ B|`` by the sketches, and ``clear``:
    whether the bounds of these estimates leave D3's answer open to no doubt.

    A sketch of ``k = 2**lg_nom_entries`` hashes is exact up to ``k`` distinct
    values; beyond, it holds a share ``k / n`` of them at least, and a count that
    was sampled with share ``p`` has a deviation of ``sqrt(count (1 - p) / p)``."""
    k = float(1 << lg_nom_entries)
    side = lambda x: sketches.select(
        F.col("table").alias(f"table{x}"), F.col("field").alias(f"field{x}"), F.col("sketch").alias(f"_s{x}"),
        F.theta_sketch_estimate("sketch").cast("long").alias(f"size{x}"),
    )
    both = pairs.drop("sizeA", "sizeB").join(side("A"), ["tableA", "fieldA"]).join(side("B"), ["tableB", "fieldB"])
    both = both.withColumn("intersectionCount", F.theta_sketch_estimate(F.theta_intersection("_sA", "_sB")).cast("long"))
    share = F.least(F.lit(1.0), F.lit(0.9 * k) / F.greatest("sizeA", "sizeB"))
    exact = (F.col("sizeA") < k) & (F.col("sizeB") < k)
    n = F.col("intersectionCount")
    spread = F.when(exact, 0.0).otherwise(SIGMAS * F.sqrt(n * (1 - share) / share) + SIGMAS**2 / share)
    wide = lambda x: F.when(F.col(f"size{x}") < k, 0.0).otherwise(SIGMAS / k**0.5)
    sure = F.lit(False)
    never = F.lit(True)
    for x in "AB":
        size = F.col(f"size{x}")
        sure = sure | (10 * (n - spread) > size * (1 + wide(x)))
        never = never & (10 * (n + spread) <= size * (1 - wide(x)))
    return both.select(*PAIR_COLS, "sizeA", "sizeB", "intersectionCount", (exact | sure | never).alias("clear"))


def exact_of(tables: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """The pairs (by table and field names) with their sizes and intersections
    counted exactly, from a scan of the columns they name and no others."""
    names = pairs.select(F.col("tableA").alias("table"), F.col("fieldA").alias("field")).union(pairs.select("tableB", "fieldB"))
    asked: dict[str, list[str]] = {}
    for r in names.distinct().collect():  # one row per column of the model
        asked.setdefault(r["table"], []).append(r["field"])
    model = {t: df.select(*[F.col(f"`{c}`") for c in df.columns if c in asked[t]]) for t, df in tables.items() if t in asked}
    if not model:
        return pairs.select(*PAIR_COLS, F.lit(0).cast("long").alias("sizeA"), F.lit(0).cast("long").alias("sizeB"), F.lit(0).cast("long").alias("intersectionCount"))
    values = stage(distinct_values(value_counts(model)), "values")
    sizes = values.groupBy("tidx", "pos").agg(F.count("*").alias("size"))
    known = catalog(model).join(sizes, ["tidx", "pos"]).select("table", "field", column_id("tidx", "pos").alias("col"), "size")
    side = lambda x: known.withColumnsRenamed({c: f"{c}{x}" for c in known.columns})
    told = pairs.select(*PAIR_COLS).join(side("A"), ["tableA", "fieldA"]).join(side("B"), ["tableB", "fieldB"])
    told = stage(told, "pairs")
    return intersections(values, told).join(told, PAIR_COLS).select(*PAIR_COLS, "sizeA", "sizeB", "intersectionCount")


def approx_intersections(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """U2 (approximate): estimated ``|A ∩ B|`` per pair from the two columns'
    theta sketches; pairs estimated at 0 are dropped."""
    sa = sketches.select(F.col("table").alias("tableA"), F.col("field").alias("fieldA"), F.col("sketch").alias("_sa"))
    sb = sketches.select(F.col("table").alias("tableB"), F.col("field").alias("fieldB"), F.col("sketch").alias("_sb"))
    est = pairs.select(*PAIR_COLS).join(sa, ["tableA", "fieldA"]).join(sb, ["tableB", "fieldB"]).select(
        *PAIR_COLS, F.theta_sketch_estimate(F.theta_intersection("_sa", "_sb")).cast("long").alias("intersectionCount")
    )
    return est.where(F.col("intersectionCount") > 0)
