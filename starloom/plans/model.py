"""Model discovery: profile -> classify -> overlap -> score -> names -> roles.

``discover`` chains the operators lazily; the value aggregation that feeds
both the profile and the overlap is written once because two branches
read it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import materialize, stage

from starloom.operators import build as bd
from starloom.operators import classify as cl
from starloom.operators import collapse as co
from starloom.operators import cycles
from starloom.operators import graph as gr
from starloom.operators import links as lk
from starloom.operators import overlap as ov
from starloom.operators import profile as pr
from starloom.operators import structure as st
from starloom.operators.association import ChartModel
from starloom.sources import inline_table, resident


class Discovery:
    """The discovered model, stage by stage, each computed on first use.

    The single value aggregation feeds both the profile and the overlap, so
    it is written once to the shared checkpoint folder (nothing stays cached
    after a query).  Every catalog-sized result -- profile, fields, pairs,
    intersections, alias pairs, links, roles -- is checkpointed once when
    first asked for, so later driver-side steps (strategy, naming) never
    re-run the data-scale work, and a query pays only for the stages it
    reads.
    """

    def __init__(self, tables: dict[str, DataFrame], overrides: DataFrame | None = None,
                 approx: bool = False, scan_columns: int | None = None, types: DataFrame | None = None,
                 counts: DataFrame | None = None):
        self.tables = tables
        self.types = types
        self.overrides = overrides
        self.approx = approx
        self.scan_columns = scan_columns
        self._cache: dict[str, DataFrame] = {} if counts is None else {"counts": counts}
        self._grouped: Discovery | None = None

    def _get(self, key: str, make) -> DataFrame:
        if key not in self._cache:
            self._cache[key] = make()
        return self._cache[key]

    @property
    def counts(self) -> DataFrame:
        return self._get("counts", lambda: stage(pr.value_counts(self.tables, self.scan_columns), "values"))

    @property
    def values(self) -> DataFrame:
        return self._get("values", lambda: pr.distinct_values(self.counts))

    @property
    def profile(self) -> DataFrame:
        return self._get("profile", lambda: pr.profile(
            self.tables, approx=self.approx, counts=None if self.approx else self.counts).transform(materialize))

    @property
    def fields(self) -> DataFrame:
        return self._get("fields", lambda: cl.classify_fields(self.profile, self.overrides, self.types).transform(materialize))

    @property
    def pairs(self) -> DataFrame:
        def make():
            if self.approx:
                named = ov.candidate_pairs(self.profile)
                return named.unionByName(ov.all_id_pairs(self.profile)).distinct().transform(materialize)
            return ov.candidate_pairs(self.profile, self.held).transform(materialize)
        return self._get("pairs", make)

    @property
    def held(self) -> DataFrame:
        """Column sets that hold the same values, with their counts."""
        return self._get("held", lambda: stage(ov.held_sets(self.values, ov.gate_columns(self.profile)), "held"))

    @property
    def sketches(self) -> DataFrame:
        return self._get("sketches", lambda: ov.column_sketches(self.tables).transform(materialize))

    def _count(self, pairs: DataFrame) -> DataFrame:
        """Intersections of any pairs: from sketches under ``approx``."""
        if self.approx:
            return ov.approx_intersections(self.sketches, pairs)
        return ov.intersections(self.values, pairs)

    @property
    def intersections(self) -> DataFrame:
        def make():
            if self.approx:  # what the sketches leave open is counted
                told = ov.sketch_bounds(self.sketches, self.pairs).transform(materialize)
                clear = told.where("clear AND intersectionCount > 0").drop("clear")
                return clear.unionByName(ov.exact_of(self.tables, told.where("NOT clear"))).transform(materialize)
            found = ov.intersections_of(self.held, self.pairs)
            return found.join(self.pairs, ov.PAIR_COLS).transform(materialize)
        return self._get("inter", make)

    @property
    def overlap(self) -> DataFrame:
        return self._get("overlap", lambda: ov.overlap_from(self.intersections))

    @property
    def subsets(self) -> DataFrame:
        return self._get("subsets", lambda: ov.subset_links(self.intersections))

    @property
    def alias_pairs(self) -> DataFrame:
        return self._get("alias", lambda: ov.alias_overlap(
            None, self.fields, self.overlap, known=self.intersections, count=self._count).transform(materialize))

    @property
    def links(self) -> DataFrame:
        def make():
            cols = [*ov.PAIR_COLS, "intersectionCount", "overlapRatioA", "overlapRatioB"]
            all_overlap = self.overlap.select(*cols).unionByName(self.alias_pairs.select(*cols))
            return lk.score_links(all_overlap, self.fields).transform(materialize)
        return self._get("links", make)

    @property
    def roles(self) -> DataFrame:
        return self._get("roles", lambda: cl.table_roles(self.fields).transform(materialize))

    def canonical(self) -> DataFrame:
        """D20 names for every field."""
        return self._get("canonical", lambda: lk.normalize_names(self.fields, self.links).transform(materialize))

    @property
    def cardinalities(self) -> DataFrame:
        """J5 of every accepted link, from the value counts."""
        return self._get("cardinalities", lambda: st.link_cardinalities(
            self.counts, self.fields, self.links).transform(materialize))

    def grouped(self) -> Discovery:
        """The discovery of the model whose similar facts are one table each
        (D22-D24); itself where there are none."""
        if self._grouped is None:
            groups: dict[str, list[str]] = {}
            found = st.fact_groups(self.fields, self.roles)
            for r in _rows(found.orderBy("group", "member_pos")):  # one row a fact
                groups.setdefault(r["group"], []).append(r["table"])
            self._grouped = self._collapsed(groups) if groups else self
        return self._grouped

    def _collapsed(self, groups: dict[str, list[str]]) -> Discovery:
        plan = co.collapse(self.tables, groups)
        spark = self.fields.sparkSession
        rows = {r["table"]: r["rowCount"] for r in _rows(self.roles.select("table", "rowCount"))}
        counts = None if self.approx else stage(co.merged_counts(spark, self.counts, plan, rows), "values")
        overrides = co.moved_overrides(spark, self.overrides, plan)
        out = Discovery(plan.tables, overrides, self.approx, self.scan_columns, counts=counts)
        out._grouped = out
        return out


def overrides_frame(spark: SparkSession, rows: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """``(table, field, type, alias)`` overrides of the classification."""
    return inline_table(spark, rows, "table string, field string, type string, alias string")


def discover(
    tables: dict[str, DataFrame],
    overrides: DataFrame | None = None,
    approx: bool = False,
    scan_columns: int | None = None,
    types: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> Discovery:
    """Profile, classify, overlap and score a model (stages computed on
    first use, see :class:`Discovery`).  ``types`` are those that raw text
    columns should have (``typed.column_types``); ``counts`` the tables' value
    counts, if they are known."""
    return Discovery(tables, overrides, approx=approx, scan_columns=scan_columns, types=types, counts=counts)


def rename_canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``[orig] AS [norm]`` for each field."""
    return df.select(*[F.col(f"`{c}`").alias(mapping.get(c, c)) for c in df.columns])


# ------------------------------------------------------------------ building
@dataclass
class ModelPlan:
    """Names and strategy, before any table of the model is made."""

    renamed: dict[str, DataFrame]
    blueprint: st.Blueprint
    grains: dict[str, list[str]]
    canonical: DataFrame
    #: (table, field, new name) of the associations given up, or (fact, field,
    #: None) of fields moved to the link table, to leave no cycle
    repairs: list[tuple[str, str, str | None]] = field(default_factory=list)

    def calendar(self, today: str | None = None) -> DataFrame:
        """M4, and M5 when ``today`` is given."""
        dates = bd.calendar_dates(self.renamed, self.blueprint.dates)
        calendar = bd.master_calendar(dates)
        return bd.relative_deltas(calendar, today) if today else calendar

    def columns(self) -> dict[str, list[str]]:
        """The columns that the model's tables will have, as far as they can
        link tables."""
        bp = self.blueprint
        out = {t: list(df.columns) for t, df in self.renamed.items()}
        keys = {f: bd.fact_key_name(f) for f in bp.facts}
        if bp.strategy == "LINK_TABLE" or bp.date_bridge:
            for f, k in keys.items():
                out[f].append(k)
        if bp.strategy == "LINK_TABLE":
            own = [f for f in bp.facts if any(c in bp.shared for c in out[f])]
            held = [c for c in bp.shared if any(c in out[f] for f in own)]
            out["LinkTable"] = [bd.LINK_SOURCE, *(keys[f] for f in own), bd.BRIDGE_KEY, *held]
            for f in bp.facts:
                out[f] = [c for c in out[f] if c not in bp.shared]
        if bp.date_bridge and bp.dates:
            out["CanonicalDateBridge"] = [bd.BRIDGE_SOURCE, bd.BRIDGE_KEY, bd.CANONICAL_DATE, bd.DATE_TYPE]
            out["MasterCalendar"] = [bd.CANONICAL_DATE]
        return out

    def repaired(self, scores: dict[tuple[str, str], int]) -> ModelPlan:
        """D14 -> D25: while an association closes a cycle (or makes a
        synthetic key), the one with the worst score goes: a field that several
        facts have moves to the link table, any other is named after its table,
        so that it links no more."""
        plan = self
        while True:
            columns, bp = plan.columns(), plan.blueprint
            made = ["LinkTable", "CanonicalDateBridge", "MasterCalendar"]
            closing = cycles.closing_fields(columns, scores, bp.facts, made)
            closing = [(t, c) for t, c in closing if t not in made and not c.startswith("%")]
            if not closing:
                return plan
            table, name = closing[-1]
            holders = [f for f in bp.facts if name in columns[f]]
            if table in bp.facts and len(holders) > 1:
                shared = sorted({*bp.shared, name})
                plan = replace(plan, blueprint=replace(bp, strategy="LINK_TABLE", shared=shared), repairs=[*plan.repairs, (table, name, None)])
                continue
            new = f"{table}_{name}"
            while new in columns[table] or any(new in c for c in columns.values()):
                new += "_1"
            renamed = plan.renamed | {table: plan.renamed[table].withColumnRenamed(name, new)}
            grains = plan.grains | {table: [new if c == name else c for c in plan.grains[table]]} if table in plan.grains else plan.grains
            plan = replace(plan, renamed=renamed, grains=grains, repairs=[*plan.repairs, (table, name, new)])


@dataclass
class BuiltModel:
    tables: dict[str, DataFrame]
    blueprint: st.Blueprint
    keyed_facts: dict[str, DataFrame]
    canonical: DataFrame
    repairs: list[tuple[str, str, str | None]] = field(default_factory=list)
    #: tables that are projections of given ones: another read costs a scan
    plain: set[str] = field(default_factory=set)
    #: how the tables that link facts are made of keys of 16 bytes, given the
    #: columns asked for: distinct rows of given tables, without a join
    light: dict[str, Callable[[list[str]], DataFrame]] = field(default_factory=dict)

    def charts(self) -> ChartModel:
        """The model for charts.  Its made tables are written once, since a chart
        reads some of them several times; of the others, and of tables that link
        facts by their hashes, it reads the columns and rows that it needs."""
        tables = {n: df if n in self.plain or n in self.light else resident(df) for n, df in self.tables.items()}
        linking = [t for t in ("LinkTable", "CanonicalDateBridge") if t in tables and t not in self.plain]
        unique = {("MasterCalendar", bd.CANONICAL_DATE): True} if "MasterCalendar" not in self.plain else {}
        hashes = [*map(bd.fact_key_name, self.keyed_facts), bd.BRIDGE_KEY] if self.light else []
        return ChartModel(tables, unique, linking, self.light, hashes)

    def report(self) -> DataFrame:
        """D14 of the built tables."""
        spark = self.canonical.sparkSession
        rows = [(i, t, c) for i, (t, df) in enumerate(self.tables.items()) for c in df.columns]
        fields = spark.createDataFrame(rows, "tidx int, table string, field string")
        return gr.validate_model(fields.select("table").distinct(), fields)


def _rows(df: DataFrame) -> list:
    """Bring a catalog-sized metadata frame (names only) to the driver."""
    return df.collect()


def link_weights(d: Discovery, canonical: DataFrame) -> dict[tuple[str, str], int]:
    """The best score of the accepted links of each (table, canonical field)."""
    ends = d.links.select(F.col("tableA").alias("table"), F.col("fieldA").alias("field"), "confidence").union(
        d.links.select("tableB", "fieldB", "confidence")
    )
    best = ends.join(canonical.select("table", "field", "canonical"), ["table", "field"])
    best = best.groupBy("table", "canonical").agg(F.max("confidence").alias("score"))
    return {(r["table"], r["canonical"]): r["score"] for r in _rows(best)}


def plan_model(d: Discovery, force: str | None = None, canonical: DataFrame | None = None) -> ModelPlan:
    """Put similar facts together (D22-D24, unless names are given), rename
    every table to canonical names (P1) and choose the strategy (D25)."""
    if canonical is None:
        d = d.grouped()
    canon = canonical if canonical is not None else d.canonical()
    bp = st.blueprint(canon, d.roles, force=force)
    names = {}
    for r in _rows(canon.select("table", "field", "canonical")):
        names.setdefault(r["table"], {})[r["field"]] = r["canonical"]
    grains = {r["table"]: list(r["grainFields"]) for r in _rows(d.roles.select("table", "grainFields"))}
    renamed = {t: rename_canonical(df, names.get(t, {})) for t, df in d.tables.items()}
    fact_grains = {}
    for f in bp.facts:
        g = grains.get(f) or [c for c, _ in _id_fields(canon, f)]
        fact_grains[f] = [names[f].get(c, c) for c in g]
    return ModelPlan(renamed, bp, fact_grains, canon)


def build_model(
    d: Discovery,
    today: str | None = None,
    force: str | None = None,
    canonical: DataFrame | None = None,
    key_mode: str = "number",
    repair: bool = True,
    header_detail: bool = False,
) -> BuiltModel:
    """Put similar facts together, rename every table to canonical names (P1),
    key the facts (M1, in ``key_mode``), and add LinkTable (M2, P4),
    CanonicalDateBridge (M3) and MasterCalendar (M4, M5 when ``today`` is given)
    as the strategy (D25) asks.

    ``repair``: associations that close a cycle are given up
    (:meth:`ModelPlan.repaired`).  ``header_detail`` (D27): of two facts whose
    link is one to many, the rows of the many carry the key of the one into the
    link table, and the date bridge hangs on that key."""
    d = d.grouped() if canonical is None else d
    plan = plan_model(d, force, canonical)
    if repair:
        plan = plan.repaired(link_weights(d, plan.canonical))
    bp = plan.blueprint
    model = dict(plan.renamed)
    keyed: dict[str, DataFrame] = {}
    pair = _header_and_detail(d, plan) if header_detail else None
    if bp.strategy == "LINK_TABLE" or bp.date_bridge:
        keyed = bd.composite_keys({f: plan.renamed[f] for f in bp.facts}, plan.grains, mode=key_mode)
        model.update(keyed)
    if bp.strategy == "LINK_TABLE":
        linked = bd.header_keys(keyed, *pair) if pair else keyed
        model["LinkTable"] = bd.link_table(linked, bp.shared, *(pair[:2] if pair else ()))
        for f in bp.facts:
            model[f] = bd.drop_fields(keyed[f], bp.shared)
    if bp.date_bridge and bp.dates:
        linked = bd.header_keys(keyed, *pair) if pair else keyed
        model["CanonicalDateBridge"] = bd.date_bridge(linked, bp.dates, *(pair[:2] if pair else ()))
        model["MasterCalendar"] = plan.calendar(today)
    light: dict[str, Callable[[list[str]], DataFrame]] = {}
    if key_mode == "hash" and not pair:
        if "LinkTable" in model:
            light["LinkTable"] = lambda columns: bd.link_table(bd.short_keys(keyed), bp.shared, columns=columns)
        if "CanonicalDateBridge" in model:
            light["CanonicalDateBridge"] = lambda columns: bd.date_bridge(bd.short_keys(keyed), bp.dates).select(*[F.col(f"`{c}`") for c in columns])
    numbered = keyed if key_mode == "number" else {}
    plain = {t for t, df in plan.renamed.items() if t not in numbered and (t in keyed or model[t] is df)}
    return BuiltModel(model, bp, keyed, plan.canonical, plan.repairs, plain, light)


def _header_and_detail(d: Discovery, plan: ModelPlan) -> tuple[str, str, str] | None:
    """(header, detail, field) of the accepted link between two facts that is
    one to many, by best score, or None (catalog-sized rows)."""
    facts = plan.blueprint.facts
    names = {(r["table"], r["field"]): r["canonical"] for r in _rows(plan.canonical.select("table", "field", "canonical"))}
    both = d.cardinalities.where(F.col("tableA").isin(facts) & F.col("tableB").isin(facts))
    for r in _rows(both.orderBy(F.desc("confidence"), "tableA", "fieldA", "tableB", "fieldB")):
        name = names[r["tableA"], r["fieldA"]]
        if name == names[r["tableB"], r["fieldB"]] and r["cardinality"] in ("1:n", "n:1"):
            ends = (r["tableA"], r["tableB"]) if r["cardinality"] == "1:n" else (r["tableB"], r["tableA"])
            return (*ends, name)
    return None


def _id_fields(canon: DataFrame, table: str) -> list:
    rows = _rows(canon.where((F.col("table") == table) & (F.col("type") == "IDENTIFIER")).orderBy("pos").select("field", "type"))
    return [(r["field"], r["type"]) for r in rows]
