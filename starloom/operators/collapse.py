"""Similar facts as one table, with their profile.

The columns of the members are matched by footprint (lower case, without
blanks, ``_`` and ``-``) and named as where they occur first; the union has a
column for each of them, nulls where a member lacks one, and a source tag.

The union is not scanned to be profiled.  The members' value counts are a
mergeable state: they are re-keyed to the union's columns and added, a member
that lacks a column adds its row count to the nulls, and the tag's counts are the
members' row counts.  Only columns whose type differs between members are
counted anew, since a common type may render their values otherwise.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import profile as pr
from starloom.operators.build import concatenate


def footprint(name: str) -> str:
    """A column's name without case, blanks, ``_`` and ``-``."""
    return re.sub(r"[\s_-]", "", name.lower())


def source_tag(group: str) -> str:
    return f"%{group}_SourceTable"


def union_names(members: dict[str, list[str]]) -> dict[str, dict[str, str]]:
    """For each member its columns' names in the union.  Of several columns of
    one member with the same footprint the first is matched, the others keep
    their own names."""
    first: dict[str, str] = {}
    out: dict[str, dict[str, str]] = {}
    for member, columns in members.items():
        taken: set[str] = set()
        names: dict[str, str] = {}
        for c in columns:
            name = first.setdefault(footprint(c), c)
            names[c] = c if name in taken else name
            taken.add(names[c])
        out[member] = names
    return out


@dataclass
class Collapse:
    """A model whose groups of facts are one table each, in the place of the
    group's first member, and where each old column went."""

    tables: dict[str, DataFrame]
    members: dict[str, list[str]]
    renamed: dict[str, dict[str, str]]
    old: dict[str, DataFrame]
    recount: dict[str, list[str]] = field(default_factory=dict)

    def home(self, table: str) -> str:
        return next((g for g, ms in self.members.items() if table in ms), table)


def collapse(tables: dict[str, DataFrame], groups: dict[str, list[str]]) -> Collapse:
    """Each group of similar facts is one concatenated table, named after
    the group and tagged with the source."""
    renamed: dict[str, dict[str, str]] = {}
    unions: dict[str, DataFrame] = {}
    recount: dict[str, list[str]] = {}
    for group, members in groups.items():
        names = union_names({m: tables[m].columns for m in members})
        renamed |= names
        parts = {m: tables[m].select(*[F.col(f"`{c}`").alias(n) for c, n in names[m].items()]) for m in members}
        unions[group] = concatenate(parts, source_tag(group))
        kinds: dict[str, set[str]] = {}
        for part in parts.values():
            for c, kind in part.dtypes:
                kinds.setdefault(c, set()).add(kind)
        recount[group] = [c for c, k in kinds.items() if len(k) > 1]
    group_of = {m: g for g, ms in groups.items() for m in ms}
    out: dict[str, DataFrame] = {}
    for t, df in tables.items():
        out[group_of.get(t, t)] = unions[group_of[t]] if t in group_of else df
    return Collapse(out, groups, renamed, tables, {g: c for g, c in recount.items() if c})


def merged_counts(spark: SparkSession, counts: DataFrame, plan: Collapse, rows: dict[str, int]) -> DataFrame:
    """Value counts (tidx, pos, value, n) of the collapsed model from those of
    the old one; ``rows`` are the row counts of the members."""
    places = {t: (i, {c: p for p, c in enumerate(df.columns)}) for i, (t, df) in enumerate(plan.tables.items())}
    moves, fills = [], []
    for old_t, (table, df) in enumerate(plan.old.items()):
        home = plan.home(table)
        new_t, at = places[home]
        names = plan.renamed.get(table, {})
        for old_p, c in enumerate(df.columns):
            name = names.get(c, c)
            if name not in plan.recount.get(home, ()):
                moves.append((old_t, old_p, new_t, at[name], home in plan.members))
        if home in plan.members:
            have = set(names.values())
            fills += [
                (new_t, p, table if c == source_tag(home) else None, rows[table])
                for c, p in at.items()
                if c not in have and c not in plan.recount.get(home, ()) and rows[table]
            ]
    # one row per column of the model: schema-sized
    to = spark.createDataFrame(moves, "tidx int, pos int, new_t int, new_p int, added boolean")
    moved = counts.join(F.broadcast(to), ["tidx", "pos"])
    out = moved.select(F.col("new_t").alias("tidx"), F.col("new_p").alias("pos"), "value", "n", "added")
    more = spark.createDataFrame(fills, "tidx int, pos int, value string, n long")
    summed = out.where("added").drop("added").unionByName(more).groupBy("tidx", "pos", "value").agg(F.sum("n").alias("n"))
    out = out.where("NOT added").drop("added").unionByName(summed)
    for group, columns in plan.recount.items():
        again = pr.value_counts({group: plan.tables[group].select(*[F.col(f"`{c}`") for c in columns])})
        new_t, at = places[group]
        pos = F.element_at(F.array(*[F.lit(at[c]) for c in columns]), F.col("pos") + 1)
        out = out.unionByName(again.select(F.lit(new_t).alias("tidx"), pos.alias("pos"), "value", "n"))
    return out


def moved_overrides(spark: SparkSession, overrides: DataFrame | None, plan: Collapse) -> DataFrame | None:
    """Overrides of members' columns, as overrides of the union's: where several
    members have one for a column, that of the first member holds."""
    if overrides is None:
        return None
    where = [
        (m, c, g, n, i) for g, ms in plan.members.items() for i, m in enumerate(ms) for c, n in plan.renamed[m].items()
    ]
    to = spark.createDataFrame(where, "table string, field string, _table string, _field string, _i int")
    found = overrides.join(to, ["table", "field"], "left").select(
        F.coalesce("_table", "table").alias("table"), F.coalesce("_field", "field").alias("field"),
        F.struct(F.coalesce("_i", F.lit(0)), "type", "alias").alias("o"),
    )
    return found.groupBy("table", "field").agg(F.min("o").alias("o")).select("table", "field", "o.type", "o.alias")
