"""Modeling strategy over catalog DataFrames (SURVEY 2.8 D18, D21, D22, D24,
D25, D27; 2.3 J5).

The strategy decides *which columns* the built tables get, i.e. the shape
of the plans built next; so :func:`blueprint` brings its one-row result to
the driver.  That row is schema metadata (table and field names), never
data rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.names import name_tokens
from starloom.functions.values import is_missing
from starloom.operators.overlap import column_id
from starloom.session import materialize


SIMILARITY = 0.7
FACT_ID = "%FactID"


def footprint(c: Column) -> Column:
    """Lowercase name without whitespace, ``_`` or ``-``."""
    return F.regexp_replace(F.lower(c), r"[\s_-]", "")


def fact_similarity(fields: DataFrame, roles: DataFrame) -> DataFrame:
    """Pairwise column-set similarity of FACT tables (i before j):
    ``matches / max(|distinct names of i|, |names of j|)`` where a match is a
    column of j whose footprint occurs in i."""
    facts = roles.where(F.col("role") == "FACT").select("tidx", "table")
    f = fields.join(facts, ["tidx", "table"]).select("tidx", "table", footprint(F.col("field")).alias("fp"))
    ni = f.select("tidx", "fp").distinct().groupBy("tidx").agg(F.count(F.lit(1)).alias("ni"))
    nj = f.groupBy("tidx").agg(F.count(F.lit(1)).alias("nj"))
    i = f.select(F.col("tidx").alias("ti"), "fp").distinct()
    j = f.select(F.col("tidx").alias("tj"), F.col("table").alias("tableJ"), "fp")
    matches = j.join(i, "fp").where(F.col("ti") < F.col("tj")).groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("m"))
    names = facts.select(F.col("tidx").alias("ti"), F.col("table").alias("tableI"))
    res = (
        matches.join(ni.withColumnRenamed("tidx", "ti"), "ti")
        .join(nj.withColumnRenamed("tidx", "tj"), "tj")
        .join(names, "ti")
        .join(names.select(F.col("ti").alias("tj"), F.col("tableI").alias("tableJ")), "tj")
    )
    return res.select(
        "ti", "tj", "tableI", "tableJ",
        (F.col("m") / F.greatest(F.col("ni"), F.col("nj"))).alias("similarity"),
    )


def fact_groups(fields: DataFrame, roles: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Groups of similar facts, ``(group, table, member_pos)``.

    Greedy as specified: in table order, a fact not yet taken seeds a group
    and takes every later untaken fact with similarity above ``threshold``.
    The seed set is the fixpoint of "a fact is a seed iff no earlier seed
    takes it", reached by iterating from "every fact is a seed"; each round
    settles at least the next fact in order, so the rounds follow the
    length of the longest take-chain, not the number of facts.  Inputs are
    one row per fact pair (catalog-sized).
    """
    sims = fact_similarity(fields, roles).where(F.col("similarity") > threshold).select("ti", "tj").transform(materialize)
    if sims.isEmpty():
        return sims.sparkSession.createDataFrame([], "group string, table string, member_pos int")
    facts = roles.where(F.col("role") == "FACT").select("tidx", "table").transform(materialize)
    seeds = facts.select("tidx")
    while True:
        taken = sims.join(seeds.withColumnRenamed("tidx", "ti"), "ti").select(F.col("tj").alias("tidx"))
        new = facts.select("tidx").join(taken, "tidx", "left_anti").transform(materialize)
        changed = new.join(seeds, "tidx", "left_anti").unionByName(seeds.join(new, "tidx", "left_anti"))
        seeds = new
        if changed.isEmpty():
            break
    seed_of = (
        sims.join(seeds.withColumnRenamed("tidx", "ti"), "ti")
        .groupBy(F.col("tj").alias("tidx"))
        .agg(F.min("ti").alias("seed"))
    )
    assigned = facts.join(seed_of, "tidx", "left").withColumn("seed", F.coalesce(F.col("seed"), F.col("tidx")))
    sizes = assigned.groupBy("seed").agg(F.count(F.lit(1)).alias("_n"))
    g = assigned.join(sizes, "seed").where(F.col("_n") > 1)
    w = Window.partitionBy("seed").orderBy("tidx")
    names = g.groupBy("seed").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tidx", "table"))), lambda x: x["table"]), "_").alias("group")
    )
    return g.join(names, "seed").select("group", "table", (F.row_number().over(w) - 1).alias("member_pos"))


def conform_group(canonical: DataFrame, groups: DataFrame) -> DataFrame:
    """Inside a fact group, every field with the same footprint takes
    the canonical name of its first occurrence (first member, then column
    order)."""
    c = canonical.join(groups.select("table", "group", "member_pos"), "table", "left").withColumn(
        "_fp", footprint(F.col("field"))
    )
    w = Window.partitionBy("group", "_fp").orderBy("member_pos", "pos")
    first = F.first("canonical").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.withColumn(
        "canonical", F.when(F.col("group").isNotNull(), first).otherwise(F.col("canonical"))
    ).drop("_fp", "group", "member_pos")


@dataclass
class Blueprint:
    strategy: str
    facts: list[str]
    shared: list[str]
    date_bridge: bool
    dates: list[tuple[str, str]] = field(default_factory=list)  # (fact table, canonical date field)


def strategy_frame(canonical: DataFrame, roles: DataFrame, force: str | None = None) -> DataFrame:
    """D25 as a one-row DataFrame: ``strategy, facts, shared, date_bridge,
    fact_dates``.

    Shared = non-MEASURE canonical names held by more than one fact, plus
    every fact date when more than one date exists in the model; two or
    more shared -> LINK_TABLE, else MULTI_FACT_STAR; one fact ->
    SINGLE_FACT.  ``force="LINK_TABLE"`` (escalation after a failed
    validation) shares the identifiers held by 2+ facts.
    """
    facts = roles.where(F.col("role") == "FACT").select("table", "tidx")
    cf = canonical.join(facts, ["table", "tidx"])
    if force == "LINK_TABLE":
        cand = cf.where(F.col("type") == "IDENTIFIER")
    else:
        cand = cf.where((F.col("type") != "MEASURE") & (F.col("canonical") != FACT_ID))
    by_name = cand.groupBy("canonical").agg(F.count_distinct("table").alias("_n")).where(F.col("_n") > 1)
    dates_all = canonical.where(F.col("type") == "DATE")
    fact_dates = cf.where(F.col("type") == "DATE").select(
        F.struct("tidx", "pos", "table", "canonical").alias("d")
    )
    n_dates = dates_all.agg(F.count(F.lit(1)).alias("n_dates"))
    shared_names = by_name.select(F.col("canonical").alias("name"))
    spark = canonical.sparkSession
    row = spark.range(1).select(
        facts.agg(F.transform(F.array_sort(F.collect_list(F.struct("tidx", "table"))), lambda x: x["table"])).scalar().alias("facts"),
        n_dates.scalar().alias("n_dates"),
        shared_names.agg(F.array_sort(F.collect_list("name"))).scalar().alias("_shared"),
        fact_dates.agg(F.array_sort(F.collect_list("d"))).scalar().alias("_fd"),
    )
    fd_names = F.transform(F.col("_fd"), lambda d: d["canonical"])
    bridge = F.col("n_dates") > 1
    shared = F.col("_shared") if force == "LINK_TABLE" else F.when(
        bridge, F.array_sort(F.array_distinct(F.concat(F.col("_shared"), fd_names)))
    ).otherwise(F.col("_shared"))
    n_facts = F.size("facts")
    strategy = (
        F.when(F.lit(force == "LINK_TABLE"), F.lit("LINK_TABLE"))
        .when(n_facts <= 1, F.lit("SINGLE_FACT"))
        .when(F.size(shared) >= 2, F.lit("LINK_TABLE"))
        .otherwise(F.lit("MULTI_FACT_STAR"))
    )
    return row.select(
        strategy.alias("strategy"),
        "facts",
        F.when(n_facts > 1, shared).otherwise(F.array().cast("array<string>")).alias("shared"),
        bridge.alias("date_bridge"),
        F.transform(F.col("_fd"), lambda d: F.struct(d["table"].alias("table"), d["canonical"].alias("field"))).alias("fact_dates"),
    )


def blueprint(canonical: DataFrame, roles: DataFrame, force: str | None = None) -> Blueprint:
    """D25 for plan building: the one metadata row on the driver."""
    r = strategy_frame(canonical, roles, force).first()
    return Blueprint(
        strategy=r["strategy"],
        facts=list(r["facts"]),
        shared=list(r["shared"]),
        date_bridge=bool(r["date_bridge"]),
        dates=[(d["table"], d["field"]) for d in r["fact_dates"]],
    )


def relationship_cardinality(left: DataFrame, right: DataFrame, left_key: str, right_key: str | None = None) -> DataFrame:
    """``left_max, right_max, cardinality`` (1:1, 1:n, n:1, n:m) of the
    key relation; null keys ignored.  Two grouped counts, one row out."""
    right_key = right_key or left_key
    lm = left.where(F.col(left_key).isNotNull()).groupBy(left_key).count().agg(F.max("count").alias("left_max"))
    rm = right.where(F.col(right_key).isNotNull()).groupBy(right_key).count().agg(F.max("count").alias("right_max"))
    row = lm.sparkSession.range(1).select(lm.scalar().alias("left_max"), rm.scalar().alias("right_max"))
    l_many = F.col("left_max") > 1
    r_many = F.col("right_max") > 1
    card = (
        F.when(~l_many & ~r_many, "1:1").when(~l_many & r_many, "1:n").when(l_many & ~r_many, "n:1").otherwise("n:m")
    )
    return row.select(F.col("left_max").cast("long"), F.col("right_max").cast("long"), card.alias("cardinality"))


def link_cardinalities(counts: DataFrame, fields: DataFrame, links: DataFrame) -> DataFrame:
    """J5 of all links at once: ``tableA, fieldA, tableB, fieldB, confidence,
    maxA, maxB, cardinality``, from the value counts ``(tidx, pos, value, n)`` of
    the profile, without another scan.  ``maxA`` is the most rows that a value
    which both columns hold has in A.

    Values are grouped to the columns that hold them (at most one row per
    column of the model in a group), and only columns of links take part."""
    place = lambda x: fields.select(
        F.col("table").alias(f"table{x}"), F.col("field").alias(f"field{x}"), column_id("tidx", "pos").alias(f"col{x}")
    )
    found = links.join(place("A"), ["tableA", "fieldA"]).join(place("B"), ["tableB", "fieldB"])
    used = found.select(F.col("colA").alias("col")).union(found.select("colB")).distinct()
    cells = counts.where(~is_missing(F.col("value"))).select(column_id("tidx", "pos").alias("col"), "value", "n")
    # schema-sized: one row per column
    held = cells.join(F.broadcast(used), "col").groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("col", "n"))).alias("at"))
    met = held.where(F.size("at") > 1).select("at", F.explode(F.map_keys("at")).alias("colA")).join(F.broadcast(found.select("colA", "colB").distinct()), "colA")
    both = met.select("colA", "colB", F.col("at")[F.col("colA")].alias("a"), F.col("at")[F.col("colB")].alias("b")).where(F.col("b").isNotNull())
    most = both.groupBy("colA", "colB").agg(F.max("a").alias("maxA"), F.max("b").alias("maxB"))
    many_a, many_b = F.col("maxA") > 1, F.col("maxB") > 1
    label = F.when(~many_a & ~many_b, "1:1").when(~many_a, "1:n").when(~many_b, "n:1").otherwise("n:m")
    return found.join(most, ["colA", "colB"]).select(
        "tableA", "fieldA", "tableB", "fieldB", "confidence", "maxA", "maxB", label.alias("cardinality")
    )


def header_detail(model: dict[str, DataFrame], a: str, b: str, key_a: str, key_b: str) -> DataFrame:
    """Classify the relation of two facts sharing a key: ``header`` and
    ``detail`` when it is 1:n (either way), else both stay peers."""
    card = relationship_cardinality(model[a], model[b], key_a, key_b)
    return card.select(
        F.lit(a).alias("tableA"),
        F.lit(b).alias("tableB"),
        "cardinality",
        F.when(F.col("cardinality") == "1:n", F.lit(a)).when(F.col("cardinality") == "n:1", F.lit(b)).alias("header"),
        F.when(F.col("cardinality") == "1:n", F.lit(b)).when(F.col("cardinality") == "n:1", F.lit(a)).alias("detail"),
    )


def validate_keys(keys: DataFrame, fields: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """Drop candidate keys ``(table, field)`` that do not exist; add the
    fields that already link tables (D9 output ``field, tables``)."""
    ok = keys.select("table", "field").join(fields.select("table", "field"), ["table", "field"], "left_semi")
    if shared is not None:
        extra = shared.select(F.explode("tables").alias("table"), "field")
        ok = ok.unionByName(extra)
    return ok.distinct()


# Words of a name that name no entity, beside the generic ones.
ENTITY_NOISE = ["pk", "fk", "idnum"]


def entity_name(c: Column) -> Column:
    """The entity of a table's or column's name: its words without generic
    ones, noise and trailing digits; the whole name in lower case if no word is
    left."""
    words = name_tokens(F.regexp_replace(c, "[0-9]+$", ""))
    left = F.filter(words, lambda w: ~w.isin(*ENTITY_NOISE))
    return F.when(F.size(left) > 0, F.array_join(left, " ")).otherwise(F.trim(F.lower(c)))


def pascal_key(entity: Column) -> Column:
    return F.regexp_replace(F.initcap(F.concat(entity, F.lit(" key"))), r"\s+", "")


def golden_keys(fields: DataFrame, roles: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """Alternative naming around entities, for the grain fields and the
    fields that link tables already (``native``: ``table, field``).  Dimension keys become
    ``<Entity>Key``; a foreign key whose entity names a dimension takes that
    dimension's key name, other keys ``<FieldEntity>Key``; date fields and
    dimension attributes are prefixed with the table; spaces removed."""
    r = roles.select("table", "role", F.col("grainFields"))
    f = fields.join(r, "table").withColumns({
        "_te": entity_name(F.col("table")),
        "_fe": entity_name(F.col("field")),
        "_cand": F.array_contains(F.col("grainFields"), F.col("field")),
    })
    if native is not None:
        linked = native.select("table", "field").distinct().withColumn("_native", F.lit(True))
        f = f.join(linked, ["table", "field"], "left").withColumn("_cand", F.col("_cand") | F.coalesce("_native", F.lit(False)))
    dims = roles.where(F.col("role") == "DIMENSION").select(entity_name(F.col("table")).alias("_fe")).distinct()
    dims = dims.withColumn("_dimkey", pascal_key(F.col("_fe")))
    f = f.join(dims, "_fe", "left")
    is_dim = F.col("role") == "DIMENSION"
    own_pk = is_dim & ((F.col("_fe") == F.col("_te")) | (F.col("_fe") == ""))
    is_date = F.col("field").rlike(r"(?i)(date|time|year|month|day)")
    prefixed = F.concat(F.col("table"), F.lit("_"), F.col("field"))
    name = (
        F.when(F.col("_cand") & own_pk, pascal_key(F.col("_te")))
        .when(F.col("_cand") & F.col("_dimkey").isNotNull(), F.col("_dimkey"))
        .when(F.col("_cand"), pascal_key(F.col("_fe")))
        .when(is_date, prefixed)
        .when(is_dim, F.when(F.col("field").startswith(F.col("table")), F.col("field")).otherwise(prefixed))
        .otherwise(F.col("field"))
    )
    return f.select("tidx", "table", "pos", "field", F.regexp_replace(name, r"\s+", "").alias("golden"))
