"""Aggregates asked of a model by field names.

A model is a set of tables that are associated where they share a field name.
``ChartModel`` finds the smallest tree of tables that holds a measure and the
asked dimensions.  Tables and linking fields are the nodes of the graph (its
size is that of the schema), and the tree is found by dynamic programming over
subsets of the asked nodes.  Another tree of the same size would be another
answer, so it is refused; ``via`` names tables that the tree must hold.

The tree, with the measure's table as root, becomes a plan of staged sums:
before each join the measures are summed to the join's key.  Where a key is
unique in the next table (many rows to one) the sums go on through it.  Where it
is not (one row to many), the rest of the path is first reduced to the distinct
(key, dimensions), so a row of the measure's table counts once for each
dimension value it is associated with, never once for each row on the way.
Rows that meet no dimension value have no place in a chart.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.values import hash_bytes
from starloom.session import stage

#: how partial results of a measure are combined
_COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
KINDS = ("sum", "count", "min", "max", "avg", "count_distinct")


@dataclass(frozen=True)
class Measure:
    """``kind`` of a field, or of an expression over the columns of ``table``;
    ``table`` may be left out for a field that one table alone has.  ``count``
    without a value counts the rows of ``table``."""

    kind: str
    value: str | Column | None = None
    table: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"a measure is one of {KINDS}, not {self.kind}")
        if self.table is None and not isinstance(self.value, str):
            raise ValueError("a measure over an expression or over rows needs its table")

    def column(self) -> Column:
        if self.value is None:
            return F.lit(1)
        return F.col(f"`{self.value}`") if isinstance(self.value, str) else self.value


Node = tuple[str, str]  # ("table" or "field", name)
Edge = tuple[Node, Node]  # table, field

#: a tree has as few tables as can be, then as few fields
_WEIGHT = {"table": 1000, "field": 1}


class Graph:
    """Tables and linking fields of a model."""

    def __init__(self, columns: Mapping[str, Sequence[str]]) -> None:
        holders: dict[str, list[str]] = {}
        for table, names in columns.items():
            for name in names:
                holders.setdefault(name, []).append(table)
        self.holders = holders
        self.links = {f for f, tables in holders.items() if len(tables) > 1}
        self.edges: set[Edge] = {(("table", t), ("field", f)) for f in self.links for t in holders[f]}
        self.nodes: list[Node] = [("table", t) for t in columns] + sorted(("field", f) for f in self.links)

    def node(self, field: str) -> Node:
        """Where a dimension lives: the linking field, or its one table."""
        if field not in self.holders:
            raise ValueError(f"no table has the field {field}")
        return ("field", field) if field in self.links else ("table", self.holders[field][0])

    def smallest_tree(self, wanted: Sequence[Node]) -> set[Edge]:
        """The edges of the smallest tree over the wanted nodes; refused where
        there is none or more than one."""
        cost, tree = self._search(wanted, self.edges)
        for edge in sorted(tree):
            other = self._search(wanted, self.edges - {edge}, cost)
            if other and other[0] == cost:
                ways = [" - ".join(sorted({t for (_, t), _ in way})) for way in (tree, other[1])]
                fields = [", ".join(sorted({f for _, (_, f) in way})) for way in (tree, other[1])]
                raise ValueError(
                    f"two paths are equally good: {ways[0]} by {fields[0]}; {ways[1]} by {fields[1]}; name tables in via"
                )
        return tree

    def _search(self, wanted: Sequence[Node], edges: set[Edge], limit: int | None = None):
        near: dict[Node, list[Node]] = {n: [] for n in self.nodes}
        for a, b in sorted(edges):
            near[a].append(b)
            near[b].append(a)
        ends = list(dict.fromkeys(wanted))
        whole = (1 << len(ends)) - 1
        best: dict[tuple[int, Node], int] = {}
        came: dict[tuple[int, Node], tuple] = {}
        for i, n in enumerate(ends):
            best[1 << i, n] = _WEIGHT[n[0]]
        for part in range(1, whole + 1):
            for n in self.nodes:
                sub = (part - 1) & part
                while sub:
                    a, b = best.get((sub, n)), best.get((part ^ sub, n))
                    if a is not None and b is not None and a + b - _WEIGHT[n[0]] < best.get((part, n), 1 << 60):
                        best[part, n] = a + b - _WEIGHT[n[0]]
                        came[part, n] = ("split", sub)
                    sub = (sub - 1) & part
            heap = [(best[part, n], n) for n in self.nodes if (part, n) in best]
            heapq.heapify(heap)
            while heap:
                c, n = heapq.heappop(heap)
                if c > best[part, n]:
                    continue
                for m in near[n]:
                    if c + _WEIGHT[m[0]] < best.get((part, m), 1 << 60):
                        best[part, m] = c + _WEIGHT[m[0]]
                        came[part, m] = ("from", n)
                        heapq.heappush(heap, (best[part, m], m))
        if (whole, ends[0]) not in best:
            if limit is not None:
                return None
            raise ValueError("no path links " + ", ".join(n for _, n in ends))
        tree: set[Edge] = set()
        todo = [(whole, ends[0])]
        while todo:
            part, n = todo.pop()
            how = came.get((part, n))
            if how is None:
                continue
            if how[0] == "split":
                todo += [(how[1], n), (part ^ how[1], n)]
            else:
                tree.add((n, how[1]) if n[0] == "table" else (how[1], n))
                todo.append((part, how[1]))
        return best[whole, ends[0]], tree


class ChartModel:
    """Tables of a model, associated by field names.

    ``unique``: whether a field is unique in a table, as far as it is known
    (from a profile); what is not known is measured when a path needs it.
    ``linking``: tables whose rows are distinct and do nothing but link others (a
    link table, a date bridge).  Their fields are taken as not unique, which is
    right for any table, without a measurement, and their rows are made distinct
    once, at the dimensions, not before each join too.
    ``planned``: how linking tables that are not written are made, given the
    columns that a path reads of them; what one of them says of dimensions is
    written once for all paths through another.
    ``hashes``: fields that hold 128-bit hashes, as hexadecimal text or as bytes;
    they are bytes on the way and text in a chart.
    """

    def __init__(
        self,
        tables: Mapping[str, DataFrame],
        unique: Mapping[tuple[str, str], bool] | None = None,
        linking: Iterable[str] = (),
        planned: Mapping[str, Callable[[list[str]], DataFrame]] | None = None,
        hashes: Iterable[str] = (),
    ) -> None:
        self.tables = dict(tables)
        self.linking = set(linking)
        self.planned = dict(planned or {})
        self._kept: dict[tuple, DataFrame] = {}
        self.hashes = set(hashes)
        self.graph = Graph({t: df.columns for t, df in self.tables.items()})
        self._unique = dict(unique or {})

    def _field(self, frame: DataFrame, name: str) -> Column:
        """A field of a table as it travels."""
        kind = frame.schema[name]
        text = name in self.hashes and isinstance(kind.dataType, T.StringType)
        return hash_bytes(_named(name), kind.nullable).alias(name) if text else _named(name)

    def _shown(self, frame: DataFrame, names: Iterable[str]) -> DataFrame:
        """The frame with the named hashes as text."""
        packed = [c for c in names if c in self.hashes and isinstance(frame.schema[c].dataType, T.BinaryType)]
        return frame.withColumns({c: F.lower(F.hex(_named(c))) for c in packed}) if packed else frame

    def is_unique(self, table: str, field: str) -> bool:
        """Whether no value but null is in the field twice."""
        if (table, field) not in self._unique and table in self.linking:
            return False
        if (table, field) not in self._unique:
            key = F.col(f"`{field}`")
            twice = self.tables[table].where(key.isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
            self._unique[table, field] = twice.isEmpty()
        return self._unique[table, field]

    def home(self, measure: Measure) -> str:
        """The table whose rows a measure counts."""
        if measure.table is not None:
            if measure.table not in self.tables:
                raise ValueError(f"no table {measure.table}")
            return measure.table
        holders = self.graph.holders.get(measure.value, [])
        if len(holders) != 1:
            raise ValueError(f"{measure.value} is in {holders or 'no table'}; name the measure's table")
        return holders[0]

    def path(self, home: str, dims: Sequence[str], via: Iterable[str] = ()) -> set[Edge]:
        """The tree from a measure's table to the dimensions."""
        for t in via:
            if t not in self.tables:
                raise ValueError(f"no table {t}")
        ends = [("table", home), *map(self.graph.node, dims)]
        tree = self.graph.smallest_tree([*ends, *(("table", t) for t in via)])
        degree: dict[Node, int] = {}
        for edge in tree:
            for n in edge:
                degree[n] = degree.get(n, 0) + 1
        for t in via:
            if degree.get(("table", t), 0) < 2 and ("table", t) not in ends:
                raise ValueError(f"{t} is not between {home} and {', '.join(dims)}")
        return tree

    def aggregate(self, dims: Sequence[str], measures: Mapping[str, Measure], via: Iterable[str] = ()) -> DataFrame:
        """One row for each combination of non-null dimension values that any
        measure's rows meet; measures of several tables are aggregated apart,
        each along its own path."""
        via = list(via)
        groups: dict[tuple, dict[str, Measure]] = {}
        for name, m in measures.items():
            alone = name if m.kind == "count_distinct" else None  # carries its values along
            groups.setdefault((self.home(m), alone), {})[name] = m
        parts = [self._along(home, dims, own, via) for (home, _), own in groups.items()]
        if dims:
            parts = [self._shown(p, dims) for p in parts]
        if dims and len(parts) > 1:  # one after the other, so that no two paths' shuffles are kept at a time
            parts = [stage(p, "chart") for p in parts]
        if not dims:  # one row each
            one = parts[0].sparkSession.range(1)
            return one.select(*[p.select(_named(c)).scalar().alias(c) for p in parts for c in p.columns]).select(*map(_named, measures))
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, list(dims), "full_outer")
        return out.select(*map(_named, (*dims, *measures)))

    def _along(self, home: str, dims: Sequence[str], measures: dict[str, Measure], via: list[str]) -> DataFrame:
        partials: dict[str, Column] = {}
        combine: dict[str, str] = {}
        values: list[str] = []
        finals: list[Column] = []
        frame = self._shown(self.tables[home], self.tables[home].columns)
        for i, (name, m) in enumerate(measures.items()):
            if m.kind == "count_distinct":
                values.append(f"_v{i}")
                frame = frame.withColumn(f"_v{i}", m.column())
                finals.append(F.count_distinct(f"_v{i}").alias(name))
                continue
            for kind in ("sum", "count") if m.kind == "avg" else (m.kind,):
                partials[f"_{kind}{i}"] = getattr(F, kind)(m.column())
                combine[f"_{kind}{i}"] = kind
            whole = [_COMBINE[k](f"_{k}{i}") for k in (("sum", "count") if m.kind == "avg" else (m.kind,))]
            finals.append((whole[0] / whole[1] if m.kind == "avg" else whole[0]).alias(name))
        if not dims:
            return frame.agg(*[e.alias(n) for n, e in partials.items()], *[F.count_distinct(v).alias(v) for v in values]).select(
                *[self._lone(f, name, m, i) for i, (f, (name, m)) in enumerate(zip(finals, measures.items()))]
            )
        tree = self.path(home, dims, via)
        below = _Tree(tree, home, dims, self.graph)
        carry = [*below.own(home), *below.fields(home), *values]
        cur = _summed(frame, [self._field(frame, c) for c in carry], [e.alias(n) for n, e in partials.items()])
        again = [_COMBINE[k](n).alias(n) for n, k in combine.items()]

        def through(cur: DataFrame, carry: list[str], table: str) -> tuple[DataFrame, list[str]]:
            """Join what hangs below ``table``, whose link fields ``cur`` has."""
            for field in below.fields(table):
                for child in below.tables(field, table):
                    kids = below.fields(child)
                    if self.is_unique(child, field):
                        more = [*below.own(child), *kids]
                        right = self.tables[child].select(*[self._field(self.tables[child], c) for c in [field, *more]])
                    else:
                        right, more = self._mapping(below, child, field)
                        kids = []
                    cur = cur.join(right, field)
                    carry = list(dict.fromkeys([*carry, *more]))
                    last = child == below.tables(field, table)[-1]
                    if last and field not in dims:
                        carry = [c for c in carry if c != field]
                    cur = _summed(cur, list(map(_named, carry)), again)
                    if kids:
                        cur, carry = through(cur, carry, child)
                if field not in dims and field in carry:  # a field that only ends the tree
                    carry = [c for c in carry if c != field]
            return cur, carry

        cur, carry = through(cur, carry, home)
        return cur.dropna(subset=list(dims)).groupBy(*map(_named, dims)).agg(*finals)

    @staticmethod
    def _lone(final: Column, name: str, m: Measure, i: int) -> Column:
        """A measure of the one row that an aggregate without dimensions is."""
        if m.kind == "count_distinct":
            return F.col(f"_v{i}").alias(name)
        if m.kind == "avg":
            return (F.col(f"_sum{i}") / F.col(f"_count{i}")).alias(name)
        return F.col(f"_{m.kind}{i}").alias(name)

    def _mapping(self, below: _Tree, table: str, field: str, again: bool = False) -> tuple[DataFrame, list[str]]:
        """The distinct (field, dimensions) of ``table`` and what hangs below it;
        of a linking table not distinct if they will be made so ``again``."""
        own, kids = below.own(table), below.fields(table)
        asked = list(dict.fromkeys([field, *own, *kids]))
        rows = self.planned[table](asked) if table in self.planned else self.tables[table]
        rows = rows.select(*[self._field(rows, c) for c in asked]).where(_named(field).isNotNull())
        if not (kids and table in self.linking):
            rows = rows.distinct()
        dims = list(own)
        for kid in kids:
            for child in below.tables(kid, table):
                right, more = self._mapping(below, child, kid, True)
                if child in self.planned:
                    way = below.way(child, kid)
                    if way not in self._kept:
                        self._kept[way] = stage(right, "mapping")
                    right = self._kept[way]
                rows = rows.join(right, kid)
                dims += more
            if kid in below.dims:
                dims.append(kid)
        dims = list(dict.fromkeys(dims))
        rows = rows.select(*map(_named, dict.fromkeys([field, *dims])))
        return rows if again and kids and table in self.linking else rows.distinct(), dims


class _Tree:
    """The tree of a path, seen from the measure's table."""

    def __init__(self, edges: set[Edge], home: str, dims: Sequence[str], graph: Graph) -> None:
        self.dims = dims
        near: dict[Node, list[Node]] = {}
        for a, b in sorted(edges):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        self._below: dict[Node, list[Node]] = {}
        todo = [(("table", home), None)]
        while todo:
            n, above = todo.pop()
            self._below[n] = [m for m in near.get(n, []) if m != above]
            todo += [(m, n) for m in self._below[n]]
        self._own = {t: [d for d in dims if graph.node(d) == ("table", t)] for t in {x for k, x in self._below if k == "table"}}

    def own(self, table: str) -> list[str]:
        """Dimensions that only this table has."""
        return self._own[table]

    def fields(self, table: str) -> list[str]:
        """Linking fields below a table."""
        return [f for _, f in self._below["table", table]]

    def tables(self, field: str, above: str) -> list[str]:
        """Tables below a linking field."""
        return [t for _, t in self._below["field", field]]

    def way(self, table: str, field: str) -> tuple:
        """What a mapping of ``table`` and its ``field`` depends on."""
        kids = [(k, k in self.dims, *(self.way(t, k) for t in self.tables(k, table))) for k in self.fields(table)]
        return table, field, *self.own(table), *kids


def _named(name: str) -> Column:
    return F.col(f"`{name}`")


def _summed(cur: DataFrame, carry: Sequence[Column], again: Sequence[Column]) -> DataFrame:
    return cur.groupBy(*carry).agg(*again) if again else cur.select(*carry).distinct()
