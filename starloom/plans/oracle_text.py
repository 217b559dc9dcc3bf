"""Builders of DuckDB oracle SQL text for the registered queries."""

from __future__ import annotations

from starloom.functions.values import BLANK_PATTERN, DECIMAL_PATTERN, HEX_PATTERN, WHITESPACE_EDGES
from starloom.plans.driver_tables import DRIVER_SCHEMAS, ORDER_SLICES, SLICED, SLICED_COLUMNS, STRING_COLUMNS


def columns_of(table: str) -> list[str]:
    return SLICED_COLUMNS if table == SLICED else ORDER_SLICES.get(table) or DRIVER_SCHEMAS[table]


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def round_ratio(num: str, den: str, digits: int) -> str:
    scale = 10**digits
    return (
        f"(CASE WHEN CAST({den} AS BIGINT) = 0 THEN 0.0 ELSE CAST("
        f"(CAST({num} AS BIGINT) * {2 * scale} + CAST({den} AS BIGINT)) // (2 * CAST({den} AS BIGINT))"
        f" AS DOUBLE) / {scale}.0 END)"
    )


def is_numeric(v: str) -> str:
    return f"(regexp_matches({v}, {lit(DECIMAL_PATTERN)}) OR regexp_matches({v}, {lit(HEX_PATTERN)}))"


def numeric_value(v: str) -> str:
    return (
        f"(CASE WHEN regexp_matches({v}, {lit(DECIMAL_PATTERN)}) "
        f"THEN TRY_CAST(regexp_replace({v}, {lit(WHITESPACE_EDGES)}, '', 'g') AS DOUBLE) END)"
    )


def cell(column: str) -> str:
    """A column's cells; those of an array are its elements, a null or empty
    one is a null."""
    if column == "embedding":
        return "unnest(CASE WHEN len(embedding) > 0 THEN embedding ELSE [NULL] END)"
    return q(column)


def profile_sql(tables: list[str], with_samples: bool = True) -> str:
    """Per-column profile, one SELECT per column, UNION ALL."""
    parts = []
    for t in tables:
        for pos, c in enumerate(columns_of(t)):
            present = "(v IS NOT NULL AND v <> '')"
            samples = (
                f"array_to_string(list_slice(list_sort(list(DISTINCT v) FILTER (WHERE {present})), 1, 3), '|')"
                if with_samples
                else "''"
            )
            nn = f"count(*) FILTER (WHERE {present})"
            numeric = f"({nn} > 0 AND count(*) FILTER (WHERE {present} AND NOT {is_numeric('v')}) = 0)"
            parts.append(
                f"""SELECT {lit(t)} AS "table", {pos} AS pos, {lit(c)} AS field,
  CAST(count(*) AS BIGINT) AS rowCount,
  CAST(count(*) - {nn} AS BIGINT) AS nullCount,
  CAST(count(*) FILTER (WHERE {present} AND regexp_matches(v, {lit(BLANK_PATTERN)})) AS BIGINT) AS blankCount,
  CAST(count(DISTINCT v) FILTER (WHERE {present}) AS BIGINT) AS distinctCount,
  CAST(coalesce(min(length(v)) FILTER (WHERE {present}), 0) AS INTEGER) AS minLength,
  CAST(coalesce(max(length(v)) FILTER (WHERE {present}), 0) AS INTEGER) AS maxLength,
  {round_ratio(f"coalesce(sum(length(v)) FILTER (WHERE {present}), 0)", nn, 2)} AS avgLength,
  {numeric} AS isNumeric,
  CASE WHEN {numeric} THEN min({numeric_value('v')}) FILTER (WHERE {present}) END AS minNumeric,
  CASE WHEN {numeric} THEN max({numeric_value('v')}) FILTER (WHERE {present}) END AS maxNumeric,
  {samples} AS sampleValues,
  {round_ratio(nn, "count(*)", 4)} AS informationDensity,
  {round_ratio(f"(count(*) - {nn}) * 100", "count(*)", 2)} AS nullPercentage,
  {round_ratio(f"count(DISTINCT v) FILTER (WHERE {present})", nn, 4)} AS uniquenessRatio
FROM (SELECT CAST({cell(c)} AS VARCHAR) AS v FROM {t})"""
            )
    return "\nUNION ALL\n".join(parts)


def table_metrics_sql(tables: list[str]) -> str:
    parts = []
    for t in tables:
        cols = columns_of(t)
        present = " + ".join(
            (
                f"count(*) FILTER (WHERE {q(c)} IS NOT NULL AND {q(c)} <> '')"
                if c in STRING_COLUMNS
                else f"count({q(c)})"
            )
            for c in cols
        )
        parts.append(
            f"""SELECT {lit(t)} AS "table", CAST(count(*) AS BIGINT) AS rowCount,
  CAST({len(cols)} AS INTEGER) AS columnCount,
  {round_ratio(f"({present}) * 100", f"count(*) * {len(cols)}", 2)} AS tableDensity
FROM {t}"""
        )
    return "\nUNION ALL\n".join(parts)


def long_values_sql(tables: list[str]) -> str:
    """``(tbl, field, tidx, pos, v)``: distinct non-missing text values."""
    parts = []
    for ti, t in enumerate(tables):
        for pos, c in enumerate(columns_of(t)):
            parts.append(
                f"SELECT DISTINCT {lit(t)} AS tbl, {lit(c)} AS field, {ti} AS tidx, {pos} AS pos, "
                f"CAST({q(c)} AS VARCHAR) AS v FROM {t} "
                f"WHERE {q(c)} IS NOT NULL AND CAST({q(c)} AS VARCHAR) <> ''"
            )
    return "\nUNION ALL\n".join(parts)


# ---------------------------------------------------------------- discovery
from starloom.functions.names import ID_LIKE_PATTERN  # noqa: E402
from starloom.operators.classify import (  # noqa: E402
    BARCODE_PATTERN,
    DATE_NAME_PATTERN,
    ID_CAMEL_PATTERN,
    ID_SEPARATED_PATTERN,
    ID_SUFFIX_PATTERN,
)


def squash(x: str) -> str:
    return f"regexp_replace(lower({x}), '[\\s_]', '', 'g')"


def overlap_ctes(tables: list[str]) -> str:
    """CTEs ``vals, sizes, cand, inter`` (inter: candidate pairs, inter > 0)."""
    idl = lit(ID_LIKE_PATTERN)
    return f"""vals AS ({long_values_sql(tables)}),
sizes AS (SELECT tbl, field, tidx, pos, count(*) AS n FROM vals GROUP BY tbl, field, tidx, pos),
cand AS (
  SELECT a.tbl AS tableA, a.field AS fieldA, b.tbl AS tableB, b.field AS fieldB,
         a.n AS sizeA, b.n AS sizeB
  FROM sizes a JOIN sizes b
    ON (a.tidx < b.tidx OR (a.tidx = b.tidx AND a.pos < b.pos))
  WHERE {squash('a.field')} = {squash('b.field')}
     OR contains({squash('a.field')}, {squash('b.field')})
     OR contains({squash('b.field')}, {squash('a.field')})
     OR (regexp_matches(a.field, {idl}) AND regexp_matches(b.field, {idl}))),
inter AS (
  SELECT c.tableA, c.fieldA, c.tableB, c.fieldB, c.sizeA, c.sizeB,
         CAST(count(*) AS BIGINT) AS intersectionCount
  FROM cand c
  JOIN vals va ON va.tbl = c.tableA AND va.field = c.fieldA
  JOIN vals vb ON vb.tbl = c.tableB AND vb.field = c.fieldB AND vb.v = va.v
  GROUP BY c.tableA, c.fieldA, c.tableB, c.fieldB, c.sizeA, c.sizeB),
ovl AS (
  SELECT tableA, fieldA, tableB, fieldB, sizeA, sizeB, intersectionCount,
         {round_ratio('intersectionCount', 'sizeA', 4)} AS overlapRatioA,
         {round_ratio('intersectionCount', 'sizeB', 4)} AS overlapRatioB
  FROM inter
  WHERE intersectionCount > 0
    AND (intersectionCount * 10 > sizeA OR intersectionCount * 10 > sizeB))"""


def slices_ctes() -> str:
    """CTEs ``orders_early, orders_late``."""
    when = "year(o_orderdate) < 1998"
    parts = zip(ORDER_SLICES.items(), (when, f"NOT ({when})"), strict=True)
    return ",\n".join(f"{t} AS (SELECT {', '.join(cols)} FROM orders WHERE {w})" for (t, cols), w in parts)


def overrides_values(rows) -> str:
    vals = ", ".join(
        f"({lit(t)}, {lit(f)}, {lit(ty) if ty else 'CAST(NULL AS VARCHAR)'}, {lit(al) if al else 'CAST(NULL AS VARCHAR)'})"
        for t, f, ty, al in rows
    )
    return f"SELECT * FROM (VALUES {vals}) AS o(tbl, field, otype, oalias)"


def classify_ctes(tables: list[str], overrides) -> str:
    """CTEs ``prof, ovr, base, cnt, cls`` (cls: tbl, field, tidx, pos, type,
    alias, uniquenessRatio, rowCount, isNumeric, distinctCount)."""
    prof_parts = []
    for ti, t in enumerate(tables):
        for pos, c in enumerate(columns_of(t)):
            present = "(v IS NOT NULL AND v <> '')"
            nn = f"count(*) FILTER (WHERE {present})"
            prof_parts.append(
                f"""SELECT {lit(t)} AS tbl, {lit(c)} AS field, {ti} AS tidx, {pos} AS pos,
  CAST(count(*) AS BIGINT) AS rowCount,
  CAST(count(DISTINCT v) FILTER (WHERE {present}) AS BIGINT) AS distinctCount,
  ({nn} > 0 AND count(*) FILTER (WHERE {present} AND NOT {is_numeric('v')}) = 0) AS isNumeric,
  {round_ratio(f"count(DISTINCT v) FILTER (WHERE {present})", nn, 4)} AS uniquenessRatio,
  coalesce(any_value(ty) LIKE 'DATE' OR any_value(ty) LIKE 'TIMESTAMP%', false) AS isDateType
FROM (SELECT CAST({q(c)} AS VARCHAR) AS v, typeof({q(c)}) AS ty FROM {t})"""
            )
    is_id = (
        f"(regexp_matches(p.field, {lit(ID_SUFFIX_PATTERN)}) OR regexp_matches(p.field, {lit(ID_SEPARATED_PATTERN)})"
        f" OR regexp_matches(p.field, {lit(ID_CAMEL_PATTERN)}) OR regexp_matches(p.field, {lit(BARCODE_PATTERN)}))"
    )
    is_date = f"(p.isDateType OR (NOT p.isNumeric AND regexp_matches(p.field, {lit(DATE_NAME_PATTERN)})))"
    return f"""prof AS ({' UNION ALL '.join(prof_parts)}),
ovr AS ({overrides_values(overrides)}),
base AS (
  SELECT p.*, o.oalias,
         CASE WHEN o.otype IS NOT NULL THEN o.otype
              WHEN {is_id} THEN 'IDENTIFIER'
              WHEN {is_date} THEN 'DATE' END AS _base
  FROM prof p LEFT JOIN ovr o ON o.tbl = p.tbl AND o.field = p.field),
cnt AS (
  SELECT tbl,
         sum(CASE WHEN _base = 'IDENTIFIER' AND uniquenessRatio < 0.95 THEN 1 ELSE 0 END) AS fks,
         sum(CASE WHEN _base = 'DATE' THEN 1 ELSE 0 END) AS dates
  FROM base GROUP BY tbl),
cls AS (
  SELECT b.tbl, b.field, b.tidx, b.pos, b.rowCount, b.distinctCount, b.isNumeric, b.uniquenessRatio,
         coalesce(b._base, CASE WHEN b.isNumeric AND (c.fks >= 2 OR (c.fks >= 1 AND c.dates >= 1))
                                THEN 'MEASURE' ELSE 'ATTRIBUTE' END) AS type,
         coalesce(b.oalias, b.field) AS alias
  FROM base b JOIN cnt c ON c.tbl = b.tbl)"""


def tokens_sql(x: str) -> str:
    split = (
        f"list_filter(string_split(lower(regexp_replace(regexp_replace({x}, '([a-z])([A-Z])', '\\1_\\2', 'g'),"
        f" '[_\\s-]+', '_', 'g')), '_'), lambda t: length(t) > 0)"
    )
    sing = (
        f"list_transform({split}, lambda t: CASE WHEN suffix(t, 'ies') AND length(t) > 4 THEN t[1:length(t) - 3] || 'y'"
        f" WHEN suffix(t, 's') AND length(t) > 3 AND NOT suffix(t, 'ss') THEN t[1:length(t) - 1] ELSE t END)"
    )
    generic = "['id', 'key', 'code', 'num', 'number']"
    kept = f"list_filter({sing}, lambda t: NOT list_contains({generic}, t))"
    return f"(CASE WHEN len({kept}) > 0 THEN {kept} ELSE {sing} END)"


def entity_sql(x: str) -> str:
    left = f"list_filter({tokens_sql(f"regexp_replace({x}, '[0-9]+$', '')")}, lambda w: NOT list_contains(['pk', 'fk', 'idnum'], w))"
    return f"(CASE WHEN len({left}) > 0 THEN array_to_string({left}, ' ') ELSE trim(lower({x})) END)"


def pascal_sql(x: str) -> str:
    words = f"string_split({x} || ' key', ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1:1]) || w[2:]), '')"


def within(a: str, b: str) -> str:
    return f"(len(list_filter({a}, lambda t: NOT list_contains({b}, t))) = 0)"


def subset(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND CASE WHEN len({a}) <= len({b}) THEN {within(a, b)} ELSE {within(b, a)} END)"


def alias_pairs_cte() -> str:
    """CTEs ``fa, ap, apov``: D5 pairs (needs ``cls``, ``ovl``, ``vals``)."""
    return """fa AS (SELECT * FROM cls WHERE type IN ('IDENTIFIER', 'ATTRIBUTE') AND alias IS NOT NULL),
ap AS (
  SELECT a.tbl AS tableA, a.field AS fieldA, b.tbl AS tableB, b.field AS fieldB,
         a.distinctCount AS sizeA, b.distinctCount AS sizeB
  FROM fa a JOIN fa b ON a.alias = b.alias AND a.tbl <> b.tbl
   AND (a.tidx < b.tidx OR (a.tidx = b.tidx AND a.pos < b.pos))
  WHERE NOT EXISTS (
    SELECT 1 FROM ovl o
    WHERE (o.tableA = a.tbl AND o.fieldA = a.field AND o.tableB = b.tbl AND o.fieldB = b.field)
       OR (o.tableA = b.tbl AND o.fieldA = b.field AND o.tableB = a.tbl AND o.fieldB = a.field))),
apov AS (
  SELECT ap.tableA, ap.fieldA, ap.tableB, ap.fieldB, ap.sizeA, ap.sizeB,
         CAST(count(*) AS BIGINT) AS intersectionCount,
         count(*) / ap.sizeA AS overlapRatioA, count(*) / ap.sizeB AS overlapRatioB,
         'AI_INTENT' AS discoveredBy
  FROM ap
  JOIN vals va ON va.tbl = ap.tableA AND va.field = ap.fieldA
  JOIN vals vb ON vb.tbl = ap.tableB AND vb.field = ap.fieldB AND vb.v = va.v
  GROUP BY ap.tableA, ap.fieldA, ap.tableB, ap.fieldB, ap.sizeA, ap.sizeB)"""


def link_scores_ctes() -> str:
    """CTEs ending in ``sc`` with ``confidence`` per pair (needs ``ovl``,
    ``apov``, ``cls``)."""
    from starloom.functions.names import BARE_GENERIC_PATTERN

    bare = lit(BARE_GENERIC_PATTERN)
    perfect = (
        f"(({within('tb', 'list_concat(ta, tta)')} AND {within('ta', 'tb')}) OR "
        f"({within('ta', 'list_concat(tb, ttb)')} AND {within('tb', 'ta')}))"
    )
    tbl_match = (
        f"((len(tta) > 0 AND regexp_matches(fieldA, {bare}) AND {subset('tta', 'tb')} AND len(tta) = len(tb)) OR "
        f"(len(ttb) > 0 AND regexp_matches(fieldB, {bare}) AND {subset('ttb', 'ta')} AND len(ttb) = len(ta)))"
    )
    return f"""allov AS (
  SELECT tableA, fieldA, tableB, fieldB, intersectionCount, overlapRatioA, overlapRatioB FROM ovl
  UNION ALL
  SELECT tableA, fieldA, tableB, fieldB, intersectionCount, overlapRatioA, overlapRatioB FROM apov),
s AS (
  SELECT o.*, ca.type AS classA, ca.alias AS aliasA, cb.type AS classB, cb.alias AS aliasB,
         {tokens_sql('o.fieldA')} AS ta, {tokens_sql('o.fieldB')} AS tb,
         {tokens_sql('o.tableA')} AS tta, {tokens_sql('o.tableB')} AS ttb
  FROM allov o
  LEFT JOIN cls ca ON ca.tbl = o.tableA AND ca.field = o.fieldA
  LEFT JOIN cls cb ON cb.tbl = o.tableB AND cb.field = o.fieldB
  WHERE o.tableA <> o.tableB),
f AS (
  SELECT *, lower(fieldA) = lower(fieldB) AS same_name, ta = tb AS identical,
         {perfect} AS perfect,
         (classA = 'IDENTIFIER' AND classB = 'IDENTIFIER') AS both_id,
         {tbl_match} AS tbl_match,
         (aliasA IS NOT NULL AND aliasA = aliasB AND intersectionCount > 0) AS same_alias
  FROM s),
sc AS (
  SELECT *, CASE WHEN classA = 'MEASURE' OR classB = 'MEASURE'
                   OR (coalesce(classA, '') <> 'IDENTIFIER' AND coalesce(classB, '') <> 'IDENTIFIER') THEN 0
            ELSE (CASE WHEN same_name THEN 40 WHEN identical THEN 35 WHEN {subset('ta', 'tb')} THEN 5 ELSE 0 END)
               + (CASE WHEN perfect THEN 45 ELSE 0 END)
               + (CASE WHEN overlapRatioA > 0.8 OR overlapRatioB > 0.8 THEN 50 ELSE 0 END)
               + (CASE WHEN both_id THEN 10
                        + (CASE WHEN tbl_match THEN 40
                                WHEN NOT identical AND NOT same_name AND NOT perfect THEN -50 ELSE 0 END)
                        + (CASE WHEN same_alias THEN 80 ELSE 0 END)
                  ELSE 0 END) END AS confidence
  FROM f)"""


def roles_cte() -> str:
    """CTE ``roles(tbl, tidx, role)`` (needs ``cls``)."""
    fks = "count(*) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio < 0.95)"
    return f"""roles AS (
  SELECT tbl, max(tidx) AS tidx,
         CASE WHEN (count(*) FILTER (WHERE type = 'MEASURE') > 0 AND {fks} > 0) OR (max(rowCount) > 50000 AND {fks} >= 2)
              THEN 'FACT' ELSE 'DIMENSION' END AS role
  FROM cls GROUP BY tbl)"""


def groups_ctes() -> str:
    """CTEs ``fp, sims, grouped`` (D22) of a model in which no fact is similar
    to more than one other (needs ``cls``, ``roles``)."""
    return r"""fp AS (
  SELECT c.tbl, c.tidx, c.pos, c.field, lower(regexp_replace(c.field, '[\s_-]', '', 'g')) AS f
  FROM cls c JOIN roles r ON r.tbl = c.tbl WHERE r.role = 'FACT'),
sims AS (
  SELECT ta, tb FROM (
    SELECT a.tbl AS ta, b.tbl AS tb, a.tidx AS ia, b.tidx AS ib, count(*) AS m
    FROM (SELECT DISTINCT tbl, tidx, f FROM fp) a JOIN fp b ON a.f = b.f AND a.tidx < b.tidx GROUP BY ALL)
  JOIN (SELECT tbl, count(DISTINCT f) AS n FROM fp GROUP BY tbl) na ON na.tbl = ta
  JOIN (SELECT tbl, count(*) AS n FROM fp GROUP BY tbl) nb ON nb.tbl = tb
  WHERE m / greatest(na.n, nb.n) > 0.7),
grouped AS (
  SELECT ta || '_' || tb AS grp, ta AS tbl, 0 AS member_pos FROM sims UNION ALL SELECT ta || '_' || tb, tb, 1 FROM sims)"""


def canonical_ctes() -> str:
    """CTEs ending in ``canon`` (cls with ``canonical``): links are taken one by
    one, the best first, and merged unless a table would be in a group twice
    (needs ``sc``, ``cls`` and WITH RECURSIVE)."""
    return """lk AS (
  SELECT row_number() OVER (ORDER BY confidence DESC, least(ca.c, cb.c), greatest(ca.c, cb.c)) AS i, ca.c AS a, cb.c AS b
  FROM sc JOIN (SELECT tbl, field, tidx * 100000 + pos AS c FROM cls) ca ON ca.tbl = tableA AND ca.field = fieldA
  JOIN (SELECT tbl, field, tidx * 100000 + pos AS c FROM cls) cb ON cb.tbl = tableB AND cb.field = fieldB
  WHERE confidence >= 70),
steps(i, s) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list({'c': tidx * 100000 + pos, 't': tbl, 'g': tidx * 100000 + pos}) FROM cls)
  UNION ALL
  SELECT i, CASE WHEN list_has_any(list_transform(list_filter(s, lambda x: x.g = ga), lambda x: x.t),
                                   list_transform(list_filter(s, lambda x: x.g = gb), lambda x: x.t)) THEN s
                 ELSE list_transform(s, lambda x: {'c': x.c, 't': x.t, 'g': CASE WHEN x.g = gb THEN ga ELSE x.g END}) END
  FROM (SELECT l.i, st.s, list_filter(st.s, lambda x: x.c = l.a)[1].g AS ga, list_filter(st.s, lambda x: x.c = l.b)[1].g AS gb
        FROM steps st JOIN lk l ON l.i = st.i + 1)),
member AS (SELECT unnest((SELECT max_by(s, i) FROM steps)) AS m),
grp AS (
  SELECT cls.tbl, cls.field, cls.tidx, cls.pos, cls.alias, m.g AS g, count(*) OVER (PARTITION BY m.g) AS n
  FROM member JOIN cls ON cls.tidx * 100000 + cls.pos = m.c),
by_alias AS (
  SELECT g, alias, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, alias) AS r FROM grp
  WHERE n > 1 AND lower(alias) <> lower(field) AND length(alias) > 2 GROUP BY g, alias),
by_column AS (
  SELECT g, field, row_number() OVER (PARTITION BY g ORDER BY regexp_matches(field, '(?i)^(id|key|code|num|number)$'),
                                      length(field) DESC, tidx, pos) AS r FROM grp WHERE n > 1),
named AS (
  SELECT grp.tbl, grp.field, coalesce(a.alias, c.field) AS group_name
  FROM grp JOIN by_column c ON c.g = grp.g AND c.r = 1 LEFT JOIN by_alias a ON a.g = grp.g AND a.r = 1 WHERE grp.n > 1),
c0 AS (
  SELECT cls.*, CASE WHEN named.group_name IS NOT NULL THEN named.group_name
                     WHEN type = 'IDENTIFIER' THEN cls.field ELSE cls.tbl || '_' || cls.field END AS canon0
  FROM cls LEFT JOIN named ON named.tbl = cls.tbl AND named.field = cls.field),
c1 AS (SELECT c0.*, (canon0 = tbl || '_' || field AND type NOT IN ('MEASURE', 'IDENTIFIER')) AS cand,
              field IN (SELECT canon0 FROM c0) AS is_used FROM c0),
c2 AS (SELECT c1.*, row_number() OVER (PARTITION BY field
                                       ORDER BY CASE WHEN cand AND NOT is_used THEN 0 ELSE 1 END, tidx, pos) AS r
       FROM c1),
canon AS (
  SELECT c2.*, CASE WHEN type = 'DATE' THEN tbl || '_' || field
                    WHEN cand AND NOT is_used AND r = 1 THEN field ELSE canon0 END AS canonical
  FROM c2)"""


# ---------------------------------------------------------------- building
def key_expr(fact: str, cols: list[str]) -> str:
    parts = ", ".join(f"coalesce(length(CAST({q(c)} AS VARCHAR)) || ':' || CAST({q(c)} AS VARCHAR), '-')" for c in cols)
    return f"md5(concat_ws('|', {lit(fact)}, {parts}))"


def keys_cte(grains: dict[str, list[str]]) -> str:
    """CTE ``keyids(h, id)``: dense numbers over the union of fact hashes."""
    union = " UNION ".join(f"SELECT {key_expr(f, g)} AS h FROM {f}" for f, g in grains.items())
    return f"keyids AS (SELECT h, CAST(dense_rank() OVER (ORDER BY h) AS BIGINT) AS id FROM ({union}))"


def canonical_catalog_cte(tables: list[str], aliases) -> str:
    """CTE ``ccat(tidx, tbl, field)``: canonical field names of the driver
    model as far as the graph is concerned: aliased keys take their alias,
    every other field stays unique (its own name)."""
    amap = {(t, f): a for t, f, _ty, a in aliases if a}
    rows = []
    for ti, t in enumerate(tables):
        for c in columns_of(t):
            rows.append(f"({ti}, {lit(t)}, {lit(amap.get((t, c), c))})")
    return f"ccat AS (SELECT * FROM (VALUES {', '.join(rows)}) AS c(tidx, tbl, field))"


# ---------------------------------------------------------------- enrichment
TAG_CASE = (
    "CASE WHEN ty IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT') THEN '$numeric,$integer' "
    "WHEN ty IN ('FLOAT', 'DOUBLE') OR ty LIKE 'DECIMAL%' THEN '$numeric' "
    "WHEN ty = 'DATE' THEN '$date' WHEN ty LIKE 'TIMESTAMP%' THEN '$timestamp' "
    "WHEN ty = 'VARCHAR' THEN '$text' ELSE '' END"
)


def meta_cte(tables: list[str], samples: int = 5) -> str:
    """CTE ``meta(tidx, tbl, field, pos, tags, isKey, distinctCount, samples_list)``."""
    parts = []
    for ti, t in enumerate(tables):
        for pos, c in enumerate(columns_of(t)):
            present = "(v IS NOT NULL AND v <> '')"
            parts.append(
                f"""SELECT {ti} AS tidx, {lit(t)} AS tbl, {lit(c)} AS field, {pos} AS pos,
  any_value({TAG_CASE.replace('ty', 'ty')}) AS base_tags,
  CAST(count(DISTINCT v) FILTER (WHERE {present}) AS BIGINT) AS distinctCount,
  coalesce(list_slice(list_sort(list(DISTINCT v) FILTER (WHERE {present})), 1, {samples}), []) AS samples_list
FROM (SELECT CAST({q(c)} AS VARCHAR) AS v, typeof({q(c)}) AS ty FROM {t})"""
            )
    return f"""m0 AS ({' UNION ALL '.join(parts)}),
meta AS (
  SELECT m0.*, count(*) OVER (PARTITION BY field) > 1 AS isKey,
         CASE WHEN count(*) OVER (PARTITION BY field) > 1
              THEN CASE WHEN base_tags = '' THEN '$key' ELSE base_tags || ',$key' END
              ELSE base_tags END AS tags
  FROM m0)"""
