"""Which associations of a model to give up so that it has no cycle (SURVEY
2.8 D13, D14, D25).

Tables and linking fields are the nodes of a graph, each (table, field) an edge.
A model without cycles and synthetic keys is a forest; the maximum spanning
forest keeps the associations with the best link scores, and each edge outside
it closes a cycle.  The graph has the size of the schema.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

#: score of the fields that the build makes: they are never given up
STRUCTURAL = 1000


def closing_fields(
    columns: Mapping[str, Sequence[str]],
    scores: Mapping[tuple[str, str], int],
    facts: Iterable[str] = (),
    fixed: Iterable[str] = (),
) -> list[tuple[str, str]]:
    """The (table, field) outside the maximum spanning forest, in the order in
    which they were left out: by score, those of facts first, then by place.
    Fields that the build makes, and those of ``fixed`` tables, count most."""
    holders: dict[str, int] = {}
    for names in columns.values():
        for c in names:
            holders[c] = holders.get(c, 0) + 1
    facts, fixed = set(facts), set(fixed)
    edges = []
    for t, (table, names) in enumerate(columns.items()):
        for p, c in enumerate(names):
            if holders[c] > 1:
                score = STRUCTURAL if c.startswith("%") or table in fixed else scores.get((table, c), 0)
                edges.append((-score, table not in facts, t, p, table, c))
    root: dict[tuple[str, str], tuple[str, str]] = {}

    def find(n: tuple[str, str]) -> tuple[str, str]:
        while root.setdefault(n, n) != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    out = []
    for *_, table, c in sorted(edges):
        a, b = find(("table", table)), find(("field", c))
        if a == b:
            out.append((table, c))
        else:
            root[b] = a
    return out
