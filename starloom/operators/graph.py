"""Model validation on the association graph.

Nodes are tables, an edge joins two tables holding a field of the same
name.  Inputs are catalog DataFrames ``(tidx, table, field)`` -- one row per
column of the model -- so every step here is schema-sized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import materialize


def _side_by_side(*one_row: DataFrame) -> DataFrame:
    """One row holding every column of the given one-row aggregates, each
    evaluated as a scalar subquery (no join)."""
    spark = one_row[0].sparkSession
    cols = [d.select(c).scalar().alias(c) for d in one_row for c in d.columns]
    return spark.range(1).select(*cols)


def shared_fields(fields: DataFrame) -> DataFrame:
    """Field -> tables holding it (in model order), for fields held by
    more than one table ("native links")."""
    g = fields.groupBy("field").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tidx", "table"))), lambda s: s["table"]).alias("tables")
    )
    return g.where(F.size("tables") > 1).withColumn("n_tables", F.size("tables"))


def synthetic_keys(fields: DataFrame) -> DataFrame:
    """Table pairs sharing two or more fields, with the shared set.

    Each distinct shared field set is one synthetic key of the associative
    model (``fieldSet``)."""
    a = fields.select(F.col("tidx").alias("ta"), F.col("table").alias("tableA"), "field")
    b = fields.select(F.col("tidx").alias("tb"), F.col("table").alias("tableB"), "field")
    pairs = a.join(b, "field").where(F.col("ta") < F.col("tb"))
    return (
        pairs.groupBy("ta", "tableA", "tb", "tableB")
        .agg(F.array_sort(F.collect_list("field")).alias("fields"))
        .where(F.size("fields") >= 2)
        .withColumn("fieldSet", F.array_join("fields", "|"))
        .drop("ta", "tb")
    )


def association_graph(fields: DataFrame) -> DataFrame:
    """Undirected unique edges ``(a, b)`` with ``a < b``: for each field
    the tables holding it are chained T1-T2, T2-T3, ... in model order."""
    w = Window.partitionBy("field").orderBy("tidx", "table")
    chained = fields.select("field", "table", F.lead("table").over(w).alias("_next")).where(F.col("_next").isNotNull())
    return (
        chained.select(F.least("table", "_next").alias("a"), F.greatest("table", "_next").alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: min-label propagation until no label changes.

    ``nodes(node)``, ``edges(a, b)`` undirected.  A round takes the smallest
    label of a node and its neighbours, then the label of that label, so
    rounds grow with the logarithm of a chain's length.  Labels are
    checkpointed per round so the lineage stays flat.  The component id is the
    smallest node name in it.
    """
    und = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    labels = nodes.select(F.col("node"), F.col("node").alias("label")).distinct()
    while True:
        own = labels.select("node", "label", F.col("label").alias("_old"))
        msgs = und.join(labels, und.src == labels.node).select(
            F.col("dst").alias("node"), "label", F.lit(None).cast("string").alias("_old")
        )
        near = own.unionByName(msgs).groupBy("node").agg(F.min("label").alias("label"), F.max("_old").alias("_old"))
        # only nodes of the list carry a label of their own
        near = near.where(F.col("_old").isNotNull())
        far = near.select(F.col("node").alias("_at"), F.col("label").alias("_far"))
        jumped = near.join(far, F.col("label") == F.col("_at"), "left").select(
            "node", F.least("label", "_far").alias("label"), "_old"
        ).transform(materialize)
        labels = jumped.select("node", "label")
        if jumped.where(F.col("label") != F.col("_old")).isEmpty():
            break
    return labels.withColumnRenamed("label", "component")


def islands(tables: DataFrame, fields: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``(table, component)`` for every table of the model."""
    nodes = tables.select(F.col("table").alias("node"))
    comp = connected_components(nodes, edges if edges is not None else association_graph(fields))
    return comp.select(F.col("node").alias("table"), "component")


def circular_references(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """One row ``n_tables, n_edges, n_islands, has_cycle`` where the
    graph is cyclic iff edges > tables - components."""
    edges = association_graph(fields).transform(materialize)  # built once, read twice
    n_tables = tables.select("table").distinct().agg(F.count(F.lit(1)).alias("n_tables"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    n_isl = islands(tables, fields, edges).agg(F.count_distinct("component").alias("n_islands"))
    row = _side_by_side(n_tables, n_edges, n_isl)
    return row.withColumn(
        "has_cycle", F.col("n_edges") > (F.col("n_tables") - F.col("n_islands"))
    )


def validate_model(tables: DataFrame, fields: DataFrame) -> DataFrame:
    """One report row: counts, ``success`` (no synthetic key and no
    cycle), ``errors`` and ``warnings`` (more than one island is a warning
    only)."""
    base = circular_references(tables, fields)
    syn = synthetic_keys(fields).agg(F.count_distinct("fieldSet").alias("n_synthetic_keys"))
    row = _side_by_side(base, syn)
    errors = F.filter(
        F.array(
            F.when(
                F.col("n_synthetic_keys") > 0,
                F.format_string("%d synthetic keys", F.col("n_synthetic_keys")),
            ),
            F.when(
                F.col("has_cycle"),
                F.format_string(
                    "circular references: %d associations but only %d tables (tree limit %d)",
                    F.col("n_edges"), F.col("n_tables"), F.col("n_tables") - F.col("n_islands"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    warnings = F.filter(
        F.array(
            F.when(F.col("n_islands") > 1, F.format_string("%d disconnected groups", F.col("n_islands")))
        ),
        lambda x: x.isNotNull(),
    )
    return row.select(
        "n_tables", "n_edges", "n_islands", "n_synthetic_keys", "has_cycle",
        ((F.col("n_synthetic_keys") == 0) & ~F.col("has_cycle")).alias("success"),
        errors.alias("errors"),
        warnings.alias("warnings"),
    )
