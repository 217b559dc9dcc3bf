"""Registered queries over the driver tables and their DuckDB oracles.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables.  Values leave the queries in oracle-neutral types: money is summed
as ``decimal(18,2)`` and cast to double at the end, dates are rendered as
``yyyy-MM-dd`` text and arrays are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import materialize

from starloom.operators import analytics as an
from starloom.operators import profile as pr
from starloom.plans import oracle_text as ot
from starloom.plans import model as md
from starloom.plans.driver_tables import ALL_TABLES, DRIVER_ALIASES, DRIVER_SCHEMAS, ORDER_SLICES, SLICED, STAR_TABLES
from starloom.sources import load_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return load_tables(spark, sf_dir, names)


def money(col: str):
    return F.col(col).cast("decimal(18,2)")


# ------------------------------------------------------------------ Pareto
#: columns a scan of the given Parquet tables reads at a time when profiled
SCAN_COLUMNS = 2


@register(
    "pareto_self",
    """
WITH agg AS (
  SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS s
  FROM lineitem GROUP BY l_partkey),
run AS (
  SELECT l_partkey, s,
         SUM(s) OVER (ORDER BY s DESC NULLS LAST, l_partkey ASC NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc,
         SUM(s) OVER () AS tot
  FROM agg)
SELECT l_partkey,
       CAST(s AS DOUBLE) AS measure_sum,
       CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) AS cum_share,
       CASE WHEN CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) <= 0.8
            THEN 'Top 80%' ELSE 'Bottom 20%' END AS pareto_flag,
       CASE WHEN CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) <= 0.8
            THEN 1 ELSE 0 END AS pareto_flag_num
FROM run
""",
)
def q_pareto_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    fact = li.select("l_partkey", money("l_extendedprice").alias("l_extendedprice"))
    res = an.pareto_self(fact, "l_partkey", "l_extendedprice")
    return res.withColumn("measure_sum", F.col("measure_sum").cast("double"))


@register(
    "pareto_linked",
    """
WITH per_key AS (
  SELECT l_orderkey, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS m
  FROM lineitem GROUP BY l_orderkey),
link AS (SELECT DISTINCT o_orderkey, o_custkey FROM orders),
joined AS (
  SELECT k.m, l.o_custkey FROM per_key k LEFT JOIN link l ON k.l_orderkey = l.o_orderkey),
agg AS (SELECT o_custkey, SUM(m) AS s FROM joined GROUP BY o_custkey),
run AS (
  SELECT o_custkey, s,
         SUM(s) OVER (ORDER BY s DESC NULLS LAST, o_custkey ASC NULLS FIRST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc,
         SUM(s) OVER () AS tot
  FROM agg)
SELECT o_custkey,
       CAST(s AS DOUBLE) AS measure_sum,
       CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) AS cum_share,
       CASE WHEN CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) <= 0.8
            THEN 'Top 80%' ELSE 'Bottom 20%' END AS pareto_flag,
       CASE WHEN CAST(acc AS DOUBLE) / CAST(tot AS DOUBLE) <= 0.8
            THEN 1 ELSE 0 END AS pareto_flag_num
FROM run
""",
)
def q_pareto_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "lineitem", "orders")
    fact = t["lineitem"].select(
        F.col("l_orderkey").alias("o_orderkey"), money("l_extendedprice").alias("l_extendedprice")
    )
    res = an.pareto(fact, t["orders"], "o_orderkey", "o_custkey", "l_extendedprice")
    return res.withColumn("measure_sum", F.col("measure_sum").cast("double"))


# ------------------------------------------------------------------ profile
PROFILE_COLUMNS = [
    "table", "pos", "field", "rowCount", "nullCount", "blankCount", "distinctCount",
    "minLength", "maxLength", "avgLength", "isNumeric", "minNumeric", "maxNumeric",
    "sampleValues", "informationDensity", "nullPercentage", "uniquenessRatio",
]


def _profile_out(p: DataFrame) -> DataFrame:
    return p.withColumn("sampleValues", F.array_join("sampleValues", "|")).select(*PROFILE_COLUMNS)


@register("profile_orders", ot.profile_sql(["orders"]))
def q_profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_out(pr.profile(_t(spark, sf_dir, "orders"), scan_columns=SCAN_COLUMNS))


@register("profile_model", ot.profile_sql(STAR_TABLES))
def q_profile_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile_out(pr.profile(_t(spark, sf_dir, *STAR_TABLES), scan_columns=SCAN_COLUMNS))


#: text forms of single-precision numbers differ between engines
_ALL_PROFILE = ", ".join(
    f"CASE WHEN field = 'embedding' THEN NULL ELSE {c} END AS {c}" if c in ("minLength", "maxLength", "avgLength", "sampleValues", "minNumeric", "maxNumeric")
    else f'"{c}"' for c in PROFILE_COLUMNS
)


@register("profile_all", f"SELECT {_ALL_PROFILE} FROM ({ot.profile_sql(ALL_TABLES)})")
def q_profile_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 of all fourteen tables, with long texts and arrays."""
    p = _profile_out(pr.profile(_t(spark, sf_dir, *ALL_TABLES), scan_columns=SCAN_COLUMNS))
    shown = ("minLength", "maxLength", "avgLength", "sampleValues", "minNumeric", "maxNumeric")
    return p.withColumns({c: F.when(F.col("field") != "embedding", F.col(c)) for c in shown})


@register("table_metrics", ot.table_metrics_sql(ALL_TABLES))
def q_table_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.table_stats(_t(spark, sf_dir, *ALL_TABLES)).drop("tidx")


@register(
    "one_to_many",
    """
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_items
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL)
GROUP BY l_orderkey HAVING count(*) > 1
""",
)
def q_one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.one_to_many(_t(spark, sf_dir, "lineitem")["lineitem"], "l_orderkey", "l_partkey")


@register(
    "distinct_count_all",
    "SELECT CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_distinct FROM lineitem",
)
def q_distinct_count_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.distinct_count_all(_t(spark, sf_dir, "lineitem")["lineitem"], "l_partkey")


# ------------------------------------------------------------------ discovery
def _discover(spark: SparkSession, sf_dir: str) -> md.Discovery:
    tables = _t(spark, sf_dir, *STAR_TABLES)
    return md.discover(tables, md.overrides_frame(spark, DRIVER_ALIASES), scan_columns=SCAN_COLUMNS)


_OV = ot.overlap_ctes(STAR_TABLES)
_CL = ot.classify_ctes(STAR_TABLES, DRIVER_ALIASES)


@register(
    "value_overlap",
    f"""WITH {_OV}
SELECT tableA, fieldA, tableB, fieldB, sizeA, sizeB, intersectionCount, overlapRatioA, overlapRatioB FROM ovl""",
)
def q_value_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).overlap


@register(
    "subset_links",
    f"""WITH {_OV}
SELECT CASE WHEN a_in_b THEN tableA || '.' || fieldA ELSE tableB || '.' || fieldB END AS subset,
       CASE WHEN a_in_b THEN tableB || '.' || fieldB ELSE tableA || '.' || fieldA END AS superset
FROM (SELECT *, (intersectionCount * 100 >= sizeA * 95 AND sizeA < sizeB) AS a_in_b,
                (intersectionCount * 100 >= sizeB * 95 AND sizeB < sizeA) AS b_in_a
      FROM inter)
WHERE a_in_b OR b_in_a""",
)
def q_subset_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).subsets


@register(
    "alias_overlap",
    f"""WITH {_OV}, {_CL}, {ot.alias_pairs_cte()}
SELECT tableA, fieldA, tableB, fieldB, sizeA, sizeB, intersectionCount, overlapRatioA, overlapRatioB, discoveredBy
FROM apov WHERE intersectionCount > 0""",
)
def q_alias_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).alias_pairs


@register(
    "classify_fields",
    f"""WITH {_CL}
SELECT tbl AS "table", field, pos, type, alias FROM cls""",
)
def q_classify_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).fields.select("table", "field", "pos", "type", "alias")


@register(
    "grain_roles",
    f"""WITH {_CL},
g AS (
  SELECT tbl, max(rowCount) AS rowCount,
         CAST(count(*) FILTER (WHERE type = 'MEASURE') AS BIGINT) AS measureCount,
         CAST(count(*) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio < 0.95) AS BIGINT) AS foreignKeyCount,
         CAST(count(*) FILTER (WHERE type = 'DATE') AS BIGINT) AS dateCount,
         coalesce(string_agg(field, ', ' ORDER BY pos) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio >= 0.95), '') AS primaryKey,
         coalesce(string_agg(field, ', ' ORDER BY pos) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio < 0.95), '') AS foreignKeys,
         coalesce(string_agg(field, ', ' ORDER BY pos) FILTER (WHERE type = 'IDENTIFIER'), '') AS grainFields,
         coalesce(string_agg(field, ' + ' ORDER BY pos) FILTER (WHERE type = 'IDENTIFIER'), 'Unknown') AS grainDescription
  FROM cls GROUP BY tbl)
SELECT tbl AS "table", rowCount, measureCount, foreignKeyCount, dateCount,
       CASE WHEN (measureCount > 0 AND foreignKeyCount > 0) OR (rowCount > 50000 AND foreignKeyCount >= 2)
            THEN 'FACT' ELSE 'DIMENSION' END AS role,
       primaryKey, foreignKeys, grainFields, grainDescription
FROM g""",
)
def q_grain_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _discover(spark, sf_dir).roles
    return r.select(
        "table", "rowCount", "measureCount", "foreignKeyCount", "dateCount", "role",
        F.array_join("primaryKey", ", ").alias("primaryKey"),
        F.array_join("foreignKeys", ", ").alias("foreignKeys"),
        F.array_join("grainFields", ", ").alias("grainFields"),
        "grainDescription",
    )


@register(
    "link_scores",
    f"""WITH {_OV}, {_CL}, {ot.alias_pairs_cte()}, {ot.link_scores_ctes()}
SELECT tableA, fieldA, tableB, fieldB, CAST(confidence AS INTEGER) AS confidence FROM sc WHERE confidence >= 70""",
)
def q_link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).links


@register(
    "canonical_names",
    f"""WITH RECURSIVE {_OV}, {_CL}, {ot.alias_pairs_cte()}, {ot.link_scores_ctes()}, {ot.canonical_ctes()}
SELECT tbl AS "table", field, pos, type, canonical FROM canon""",
)
def q_canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).canonical().select("table", "field", "pos", "type", "canonical")


# ------------------------------------------------------------------ building
TODAY = "1998-08-02"  # parameter of the relative-delta queries (never the clock)
GRAINS = {
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
}


def _built(spark: SparkSession, sf_dir: str):
    return md.build_model(_discover(spark, sf_dir), today=TODAY)


def _ts_text(df: DataFrame) -> DataFrame:
    """Render date / timestamp columns as text (oracle-neutral)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if t == "date":
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif t.startswith("timestamp"):
            out.append(c.cast("string").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


_KEYS = ot.keys_cte(GRAINS)
_OKEY = ot.key_expr("orders", GRAINS["orders"])
_LKEY = ot.key_expr("lineitem", GRAINS["lineitem"])


def _keyed_sql(key: str, join: str) -> str:
    """Both facts with their grain, padded to four columns, and key."""
    return f"""SELECT 'orders' AS fact, o_orderkey AS g1, o_custkey AS g2, CAST(NULL AS BIGINT) AS g3,
       CAST(NULL AS BIGINT) AS g4, {key.format(h=_OKEY)} AS key FROM orders {join.format(h=_OKEY)}
UNION ALL
SELECT 'lineitem', l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT), {key.format(h=_LKEY)}
FROM lineitem {join.format(h=_LKEY)}"""


def _keyed_rows(keyed: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for fact, grain in GRAINS.items():
        g = [F.col(c).cast("long") for c in grain] + [F.lit(None).cast("long")] * (4 - len(grain))
        parts.append(keyed[fact].select(
            F.lit(fact).alias("fact"), *[c.alias(f"g{i}") for i, c in enumerate(g, 1)], F.col(f"`%Key_{fact}`").alias("key")
        ))
    return parts[0].unionByName(parts[1])


@register("composite_key", f"WITH {_KEYS}\n" + _keyed_sql("k.id", "JOIN keyids k ON k.h = {h}"))
def q_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import build as bd

    return _keyed_rows(bd.composite_keys(_t(spark, sf_dir, "orders", "lineitem"), GRAINS))


@register("composite_key_hash", _keyed_sql("{h}", ""))
def q_composite_key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 without numbering: the hash is the key."""
    from starloom.operators import build as bd

    return _keyed_rows(bd.composite_keys(_t(spark, sf_dir, "orders", "lineitem"), GRAINS, mode="hash"))


@register(
    "link_table",
    f"""WITH {_KEYS}
SELECT DISTINCT * FROM (
  SELECT 'orders' AS "%LinkTable_SourceTable", k.id AS "%Key_orders", CAST(NULL AS BIGINT) AS "%Key_lineitem",
         k.id AS "%DateBridgeKey", o.o_orderkey AS "Order",
         CAST(o.o_orderdate AS VARCHAR) AS orders_o_orderdate, CAST(NULL AS VARCHAR) AS lineitem_l_shipdate
  FROM orders o JOIN keyids k ON k.h = {_OKEY}
  UNION ALL
  SELECT 'lineitem', NULL, k.id, k.id, l.l_orderkey, NULL, CAST(l.l_shipdate AS VARCHAR)
  FROM lineitem l JOIN keyids k ON k.h = {_LKEY})""",
)
def q_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts_text(_built(spark, sf_dir).tables["LinkTable"])


@register(
    "date_bridge",
    f"""WITH {_KEYS}
SELECT DISTINCT * FROM (
  SELECT 'orders' AS "%CanonicalDateBridge_SourceTable", k.id AS "%DateBridgeKey",
         strftime(CAST(o.o_orderdate AS DATE), '%Y-%m-%d') AS CanonicalDate, 'orders_o_orderdate' AS DateType
  FROM orders o JOIN keyids k ON k.h = {_OKEY}
  UNION ALL
  SELECT 'lineitem', k.id, strftime(CAST(l.l_shipdate AS DATE), '%Y-%m-%d'), 'lineitem_l_shipdate'
  FROM lineitem l JOIN keyids k ON k.h = {_LKEY})""",
)
def q_date_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts_text(_built(spark, sf_dir).tables["CanonicalDateBridge"])


def _week(d: str) -> str:
    return f"CAST(floor((dayofyear({d}) - 1 + dayofweek(date_trunc('year', {d}))) / 7) + 1 AS INTEGER)"


def _gweek(d: str) -> str:
    return f"(CASE WHEN month({d}) = 1 AND {_week(d)} > 5 THEN 0 ELSE {_week(d)} END)"


def _qtr(d: str) -> str:
    return f"CAST(ceil(month({d}) / 3) AS INTEGER)"


_T = f"DATE '{TODAY}'"


@register(
    "master_calendar",
    f"""WITH d AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL
  UNION SELECT DISTINCT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT strftime(d, '%Y-%m-%d') AS CanonicalDate,
       CAST(year(d) AS INTEGER) AS Year,
       'Q' || CAST({_qtr('d')} AS VARCHAR) AS Quarter,
       CAST(month(d) AS INTEGER) AS Month,
       strftime(d, '%b') AS MonthName,
       strftime(d, '%b-%Y') AS MonthYear,
       {_week('d')} AS Week,
       CAST(day(d) AS INTEGER) AS Day,
       strftime(d, '%a') AS WeekDay,
       CAST(dayofweek(d) AS INTEGER) AS WeekDayNum,
       CAST(d - {_T} AS INTEGER) AS "Date Diff",
       CAST((year(d) - year({_T})) * 52 + ({_gweek('d')} - {_gweek(_T)}) AS INTEGER) AS "Week Diff",
       CAST((year(d) - year({_T})) * 12 + (month(d) - month({_T})) AS INTEGER) AS "Month Diff",
       CAST((year(d) - year({_T})) * 4 + ({_qtr('d')} - {_qtr(_T)}) AS INTEGER) AS "Qtr Diff",
       CAST(year(d) - year({_T}) AS INTEGER) AS "Year Diff"
FROM d""",
)
def q_master_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts_text(md.plan_model(_discover(spark, sf_dir)).calendar(TODAY))


@register(
    "model_strategy",
    f"""WITH {_CL},
roles AS (
  SELECT tbl, max(tidx) AS tidx,
         CASE WHEN (count(*) FILTER (WHERE type = 'MEASURE') > 0
                    AND count(*) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio < 0.95) > 0)
                OR (max(rowCount) > 50000 AND count(*) FILTER (WHERE type = 'IDENTIFIER' AND uniquenessRatio < 0.95) >= 2)
              THEN 'FACT' ELSE 'DIMENSION' END AS role
  FROM cls GROUP BY tbl),
canon AS (
  SELECT c.*, CASE WHEN type = 'IDENTIFIER' THEN alias ELSE tbl || '_' || field END AS canonical FROM cls c),
fc AS (SELECT c.* FROM canon c JOIN roles r ON r.tbl = c.tbl WHERE r.role = 'FACT'),
sh AS (SELECT canonical FROM fc WHERE type <> 'MEASURE' GROUP BY canonical HAVING count(DISTINCT tbl) > 1),
nd AS (SELECT count(*) AS n FROM canon WHERE type = 'DATE'),
nf AS (SELECT count(*) AS n FROM roles WHERE role = 'FACT'),
allsh AS (SELECT canonical FROM sh
          UNION SELECT canonical FROM fc WHERE type = 'DATE' AND (SELECT n FROM nd) > 1)
SELECT CASE WHEN (SELECT n FROM nf) <= 1 THEN 'SINGLE_FACT'
            WHEN (SELECT count(*) FROM allsh) >= 2 THEN 'LINK_TABLE' ELSE 'MULTI_FACT_STAR' END AS strategy,
       coalesce((SELECT string_agg(tbl, ',' ORDER BY tidx) FROM roles WHERE role = 'FACT'), '') AS facts,
       CASE WHEN (SELECT n FROM nf) > 1
            THEN coalesce((SELECT string_agg(canonical, ',' ORDER BY canonical) FROM allsh), '') ELSE '' END AS shared,
       (SELECT n FROM nd) > 1 AS date_bridge""",
)
def q_model_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import structure as st

    d = _discover(spark, sf_dir)
    row = st.strategy_frame(d.canonical(), d.roles)
    return row.select(
        "strategy", F.array_join("facts", ",").alias("facts"), F.array_join("shared", ",").alias("shared"), "date_bridge"
    )


_CCAT = ot.canonical_catalog_cte(STAR_TABLES, DRIVER_ALIASES)


def _canon_fields(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = _discover(spark, sf_dir)
    canon = d.canonical().transform(materialize)
    fields = canon.select("tidx", "table", F.col("canonical").alias("field"))
    tables = canon.select("table").distinct()
    return tables, fields


@register(
    "shared_fields",
    f"""WITH {_CCAT}
SELECT field, string_agg(tbl, ',' ORDER BY tidx) AS tables, CAST(count(*) AS INTEGER) AS n_tables
FROM ccat GROUP BY field HAVING count(*) > 1""",
)
def q_shared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import graph as gr

    _, fields = _canon_fields(spark, sf_dir)
    return gr.shared_fields(fields).select("field", F.array_join("tables", ",").alias("tables"), "n_tables")


_EDGES = """e0 AS (SELECT field, tbl, lead(tbl) OVER (PARTITION BY field ORDER BY tidx, tbl) AS nxt FROM ccat),
e AS (SELECT DISTINCT least(tbl, nxt) AS a, greatest(tbl, nxt) AS b FROM e0 WHERE nxt IS NOT NULL AND tbl <> nxt)"""


@register(
    "association_edges",
    f"""WITH {_CCAT}, {_EDGES}
SELECT a, b FROM e""",
)
def q_association_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import graph as gr

    _, fields = _canon_fields(spark, sf_dir)
    return gr.association_graph(fields)


_REACH = """und AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e),
reach(node, label) AS (
  SELECT DISTINCT tbl, tbl FROM ccat
  UNION
  SELECT u.dst, r.label FROM reach r JOIN und u ON u.src = r.node),
comp AS (SELECT node AS tbl, min(label) AS component FROM reach GROUP BY node)"""


@register(
    "islands",
    f"""WITH RECURSIVE {_CCAT}, {_EDGES}, {_REACH}
SELECT tbl AS "table", component FROM comp""",
)
def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import graph as gr

    tables, fields = _canon_fields(spark, sf_dir)
    return gr.islands(tables, fields)


@register(
    "validate_model",
    f"""WITH RECURSIVE {_CCAT}, {_EDGES}, {_REACH},
syn AS (
  SELECT a.tbl AS ta, b.tbl AS tb, string_agg(a.field, '|' ORDER BY a.field) AS fs
  FROM ccat a JOIN ccat b ON a.field = b.field AND a.tidx < b.tidx
  GROUP BY a.tbl, b.tbl HAVING count(*) >= 2),
c AS (
  SELECT (SELECT CAST(count(DISTINCT tbl) AS BIGINT) FROM ccat) AS n_tables,
         (SELECT CAST(count(*) AS BIGINT) FROM e) AS n_edges,
         (SELECT CAST(count(DISTINCT component) AS BIGINT) FROM comp) AS n_islands,
         (SELECT CAST(count(DISTINCT fs) AS BIGINT) FROM syn) AS n_synthetic_keys)
SELECT n_tables, n_edges, n_islands, n_synthetic_keys,
       n_edges > n_tables - n_islands AS has_cycle,
       n_synthetic_keys = 0 AND NOT (n_edges > n_tables - n_islands) AS success
FROM c""",
)
def q_validate_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import graph as gr

    tables, fields = _canon_fields(spark, sf_dir)
    return gr.validate_model(tables, fields).drop("errors", "warnings")


@register(
    "header_detail",
    """WITH lm AS (SELECT max(n) AS left_max FROM (SELECT count(*) AS n FROM orders WHERE o_orderkey IS NOT NULL GROUP BY o_orderkey)),
rm AS (SELECT max(n) AS right_max FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY l_orderkey)),
c AS (SELECT CAST(left_max AS BIGINT) AS left_max, CAST(right_max AS BIGINT) AS right_max,
             CASE WHEN left_max = 1 AND right_max = 1 THEN '1:1' WHEN left_max = 1 THEN '1:n'
                  WHEN right_max = 1 THEN 'n:1' ELSE 'n:m' END AS cardinality FROM lm, rm)
SELECT 'orders' AS tableA, 'lineitem' AS tableB, cardinality,
       CASE cardinality WHEN '1:n' THEN 'orders' WHEN 'n:1' THEN 'lineitem' END AS header,
       CASE cardinality WHEN '1:n' THEN 'lineitem' WHEN 'n:1' THEN 'orders' END AS detail
FROM c""",
)
def q_header_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import structure as st

    t = _t(spark, sf_dir, "orders", "lineitem")
    return st.header_detail(t, "orders", "lineitem", "o_orderkey", "l_orderkey")


@register(
    "concat_facts",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       o_orderpriority, 'orders_early' AS "%orders_early_orders_late_SourceTable"
FROM orders WHERE year(o_orderdate) < 1998
UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR), NULL, 'orders_late'
FROM orders WHERE NOT (year(o_orderdate) < 1998)""",
)
def q_concat_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22 + D23 + U1/P2/P3: two yearly slices of orders (the later one
    without a column) are found similar and concatenated."""
    from starloom.operators import build as bd
    from starloom.operators import classify as cl
    from starloom.operators import structure as st

    o = _t(spark, sf_dir, "orders")["orders"]
    early = F.year("o_orderdate") < 1998
    split = {"orders_early": o.where(early), "orders_late": o.where(~early).drop("o_orderpriority")}
    prof = pr.profile(split, samples=0)
    fields = cl.classify_fields(prof)
    groups = st.fact_groups(fields, cl.table_roles(fields))
    members: dict[str, list[str]] = {}
    for r in groups.orderBy("group", "member_pos").collect():  # one row per fact table (metadata)
        members.setdefault(r["group"], []).append(r["table"])
    collapsed = bd.collapse_facts(split, members)
    return _ts_text(collapsed["orders_early_orders_late"])


# ------------------------------------------------------------------ analytic tables
@register(
    "market_basket",
    """SELECT a.l_partkey, b.l_partkey AS Co_l_partkey, CAST(count(a.l_orderkey) AS BIGINT) AS CoOccurrences
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
WHERE a.l_partkey <> b.l_partkey
GROUP BY a.l_partkey, b.l_partkey""",
)
def q_market_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    return an.market_basket(li, "l_orderkey", "l_partkey")


_ASOF_DATES = """d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL),
asof_rows AS (
  SELECT d AS a, d AS dt, 'Current Day' AS p FROM d
  UNION ALL
  SELECT d, CAST(d - to_months(i) AS DATE), 'Rolling 12 Months' FROM d, range(0, 12) AS r(i))"""


@register(
    "as_of_table",
    f"""WITH {_ASOF_DATES}
SELECT strftime(a, '%Y-%m-%d') AS "AsOf Date", strftime(dt, '%Y-%m-%d') AS o_orderdate, p AS "Period Type" FROM asof_rows""",
)
def q_as_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")["orders"]
    return _ts_text(an.as_of_table(o, "o_orderdate"))


@register(
    "as_of_aggregate",
    f"""WITH {_ASOF_DATES},
per_date AS (SELECT CAST(o_orderdate AS DATE) AS dt, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS m
             FROM orders GROUP BY CAST(o_orderdate AS DATE))
SELECT strftime(x.a, '%Y-%m-%d') AS "AsOf Date", x.p AS "Period Type", CAST(sum(pd.m) AS DOUBLE) AS measure_sum
FROM asof_rows x JOIN per_date pd ON pd.dt = x.dt
GROUP BY x.a, x.p""",
)
def q_as_of_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")["orders"].withColumn("o_totalprice", money("o_totalprice"))
    res = an.as_of_aggregate(o, an.as_of_table(o, "o_orderdate"), "o_orderdate", "o_totalprice")
    return _ts_text(res.withColumn("measure_sum", F.col("measure_sum").cast("double")))


@register(
    "encode_flag",
    """SELECT l_orderkey, l_linenumber, l_linestatus,
       CASE WHEN l_linestatus IS NULL THEN NULL
            ELSE CAST(coalesce(list_position(['F', 'O'], l_linestatus), 0) AS INTEGER) END AS l_linestatus_Dual
FROM lineitem""",
)
def q_encode_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    return an.encode_flag(li, "l_linestatus", ["F", "O"]).select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_linestatus_Dual"
    )


@register(
    "dense_key",
    """SELECT l_orderkey, l_partkey, CAST(dense_rank() OVER (ORDER BY l_partkey) AS BIGINT) AS part_id FROM lineitem""",
)
def q_dense_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"].select("l_orderkey", "l_partkey")
    return an.dense_key(li, ["l_partkey"], "part_id")


@register(
    "encode_keys",
    """WITH v AS (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem),
ids AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) AS BIGINT) AS id FROM v)
SELECT ids.id AS "Order", l.l_partkey, l.l_linenumber
FROM lineitem l JOIN ids ON ids.v = CAST(l.l_orderkey AS VARCHAR)""",
)
def q_encode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _t(spark, sf_dir, "orders", "lineitem")
    model = {
        "orders": t["orders"].withColumnRenamed("o_orderkey", "Order"),
        "lineitem": t["lineitem"].withColumnRenamed("l_orderkey", "Order"),
    }
    enc = an.encode_keys(model, ["Order"])
    return enc["lineitem"].select("Order", "l_partkey", "l_linenumber")


@register(
    "encode_keys_tables",
    """WITH v AS (SELECT CAST(o_orderkey AS VARCHAR) AS v FROM orders UNION SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem),
ids AS (SELECT v, CAST(dense_rank() OVER (ORDER BY v) AS BIGINT) AS id FROM v)
SELECT 'orders' AS fact, ids.id AS "Order", o.o_custkey, NULL AS l_partkey, NULL AS l_linenumber
FROM orders o JOIN ids ON ids.v = CAST(o.o_orderkey AS VARCHAR)
UNION ALL SELECT 'lineitem', ids.id, NULL, l.l_partkey, l.l_linenumber
FROM lineitem l JOIN ids ON ids.v = CAST(l.l_orderkey AS VARCHAR)""",
)
def q_encode_keys_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both encoded tables."""
    t = _t(spark, sf_dir, "orders", "lineitem")
    model = {
        "orders": t["orders"].withColumnRenamed("o_orderkey", "Order"),
        "lineitem": t["lineitem"].withColumnRenamed("l_orderkey", "Order"),
    }
    enc = an.encode_keys(model, ["Order"])
    orders = enc["orders"].select(F.lit("orders").alias("fact"), "Order", "o_custkey")
    lines = enc["lineitem"].select(F.lit("lineitem").alias("fact"), "Order", "l_partkey", "l_linenumber")
    return orders.unionByName(lines, allowMissingColumns=True)


# ------------------------------------------------------------------ charts
def _star(spark: SparkSession, sf_dir: str):
    """The star tables for charts, associated by the names of their keys."""
    from starloom.operators.association import ChartModel

    names: dict[str, dict[str, str]] = {}
    for table, field, _, alias in DRIVER_ALIASES:
        names.setdefault(table, {})[field] = alias
    tables = _t(spark, sf_dir, *STAR_TABLES)
    return ChartModel({n: md.rename_canonical(df, names.get(n, {})) for n, df in tables.items()})


def _rev():
    return money("l_extendedprice") * (F.lit(1) - money("l_discount"))


_REV_SQL = "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))"


@register(
    "kpi",
    f"SELECT CAST(sum({_REV_SQL}) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS line_count FROM lineitem",
)
def q_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import charts as ch

    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    res = ch.kpi(li, {"revenue": F.sum(_rev()), "line_count": F.count(F.lit(1))})
    return res.withColumn("revenue", F.col("revenue").cast("double"))


@register(
    "bar",
    f"""SELECT n.n_name, CAST(sum({_REV_SQL}) AS DOUBLE) AS revenue, CAST(count(*) AS BIGINT) AS line_count
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY n.n_name ORDER BY n.n_name LIMIT 500""",
)
def q_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by the customer's nation, asked of the model: the measure is
    summed per order, per customer and per nation key before each join (H5).
    The supplier's nation would be nearer, so the path is named."""
    from starloom.operators import charts as ch

    measures = {"revenue": ch.Measure("sum", _rev(), "lineitem"), "line_count": ch.Measure("count", table="lineitem")}
    res = ch.bar(_star(spark, sf_dir), ["n_name"], measures, via=["orders", "customer"])
    return res.withColumn("revenue", F.col("revenue").cast("double"))


@register(
    "bar_two_dims",
    """SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus LIMIT 500""",
)
def q_bar_two_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import charts as ch

    li = _t(spark, sf_dir, "lineitem")["lineitem"]
    res = ch.bar(li, ["l_returnflag", "l_linestatus"], {"sum_qty": F.sum(money("l_quantity"))})
    return res.withColumn("sum_qty", F.col("sum_qty").cast("double"))


@register(
    "line",
    """WITH g AS (
  SELECT strftime(o.o_orderdate, '%Y-%m') AS month, n.n_name, sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS total
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
  GROUP BY 1, 2),
top AS (SELECT n_name FROM (SELECT n_name, row_number() OVER (ORDER BY sum(total) DESC, n_name) AS r
                            FROM g GROUP BY n_name) WHERE r <= 12),
p AS (SELECT g.*, row_number() OVER (PARTITION BY g.n_name ORDER BY g.month) AS rp FROM g JOIN top USING (n_name))
SELECT month, n_name, CAST(total AS DOUBLE) AS total FROM p WHERE rp <= 2000""",
)
def q_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per month and nation, asked of the model, the 12 largest
    nations, at most 2000 points each."""
    from starloom.operators import charts as ch

    star = _star(spark, sf_dir)
    month = F.date_format("o_orderdate", "yyyy-MM")
    model = ch.ChartModel(star.tables | {"orders": star.tables["orders"].withColumn("month", month)})
    res = ch.line(
        model, "month", {"total": ch.Measure("sum", money("o_totalprice"), "orders")},
        series="n_name", max_lines=ch.MAX_LINES, max_points=ch.MAX_POINTS,
    )
    return res.withColumn("total", F.col("total").cast("double"))


@register(
    "table_view",
    """SELECT r.r_name, n.n_name, CAST(count(*) AS BIGINT) AS order_count,
       CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
GROUP BY r.r_name, n.n_name""",
)
def q_table_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import charts as ch

    measures = {"order_count": ch.Measure("count", table="orders"), "order_value": ch.Measure("sum", money("o_totalprice"), "orders")}
    res = ch.table_view(_star(spark, sf_dir), ["r_name", "n_name"], measures)
    return res.withColumn("order_value", F.col("order_value").cast("double"))


@register(
    "bar_each_once",
    """WITH met AS (SELECT DISTINCT l.l_orderkey, p.p_brand FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey)
SELECT m.p_brand, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_value,
       CAST(count(*) AS BIGINT) AS order_count, CAST(count(DISTINCT o.o_custkey) AS BIGINT) AS customers
FROM met m JOIN orders o ON o.o_orderkey = m.l_orderkey WHERE m.p_brand IS NOT NULL GROUP BY m.p_brand""",
)
def q_bar_each_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by the brands of their parts: an order has many lines, but
    counts once for a brand."""
    from starloom.operators import charts as ch

    measures = {
        "order_value": ch.Measure("sum", money("o_totalprice"), "orders"),
        "order_count": ch.Measure("count", table="orders"),
        "customers": ch.Measure("count_distinct", "Customer", "orders"),
    }
    res = ch.bar(_star(spark, sf_dir), ["p_brand"], measures)
    return res.withColumn("order_value", F.col("order_value").cast("double"))


@register(
    "bar_link_table",
    f"""WITH oy AS (SELECT DISTINCT {_OKEY} AS k, CAST(year(o_orderdate) AS INTEGER) AS "Year" FROM orders),
ly AS (SELECT DISTINCT {_LKEY} AS k, CAST(year(l_shipdate) AS INTEGER) AS "Year" FROM lineitem),
o AS (SELECT "Year", CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS ordered
      FROM orders JOIN oy ON k = {_OKEY} WHERE "Year" IS NOT NULL GROUP BY "Year"),
l AS (SELECT "Year", CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS shipped, CAST(count(*) AS BIGINT) AS lines
      FROM lineitem JOIN ly ON k = {_LKEY} WHERE "Year" IS NOT NULL GROUP BY "Year")
SELECT "Year", ordered, shipped, lines FROM o FULL JOIN l USING ("Year")""",
)
def q_bar_link_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both facts by calendar year through LinkTable, date bridge and
    calendar of the built model: a row counts once for each year that its key
    has dates in, so no total is multiplied on the way."""
    from starloom.operators import charts as ch

    built = md.build_model(_discover(spark, sf_dir), key_mode="hash")
    measures = {
        "ordered": ch.Measure("sum", money("orders_o_totalprice"), "orders"),
        "shipped": ch.Measure("sum", money("lineitem_l_extendedprice"), "lineitem"),
        "lines": ch.Measure("count", table="lineitem"),
    }
    res = ch.bar(built.charts(), ["Year"], measures)
    return res.withColumns({c: F.col(c).cast("double") for c in ("ordered", "shipped")})


@register(
    "period_sum",
    f"""SELECT o_orderpriority,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (
            WHERE (year(o_orderdate) - year({_T})) * 12 + (month(o_orderdate) - month({_T})) = 0) AS DOUBLE) AS this_month,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE year(o_orderdate) = year({_T})) AS DOUBLE) AS this_year,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS all_time
FROM orders GROUP BY o_orderpriority""",
)
def q_period_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.functions import calendar as cal
    from starloom.operators import charts as ch

    o = _t(spark, sf_dir, "orders")["orders"]
    today = F.to_date(F.lit(TODAY))
    d = F.to_date("o_orderdate")
    m = money("o_totalprice")
    res = o.groupBy("o_orderpriority").agg(
        ch.set_sum(m, cal.month_diff(d, today) == 0).alias("this_month"),
        ch.set_sum(m, (F.year(d) - F.year(today)) == 0).alias("this_year"),
        F.sum(m).alias("all_time"),
    )
    return res.select("o_orderpriority", *[F.col(c).cast("double") for c in ["this_month", "this_year", "all_time"]])


# ------------------------------------------------------------------ enrichment
_META = ot.meta_cte(STAR_TABLES)


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    return en.live_metadata(_t(spark, sf_dir, *STAR_TABLES), scan_columns=SCAN_COLUMNS)


@register(
    "live_metadata",
    f"""WITH {_META}
SELECT tbl AS "table", field, pos, tags, isKey, distinctCount, array_to_string(samples_list, '|') AS sampleValues FROM meta""",
)
def q_live_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _meta(spark, sf_dir)
    return m.select("table", "field", "pos", F.array_join("tags", ",").alias("tags"), "isKey", "distinctCount",
                    F.array_join("sampleValues", "|").alias("sampleValues"))


@register(
    "data_dictionary",
    f"""WITH {_META}
SELECT tbl AS "table", field, distinctCount, tags,
       array_to_string(list_transform(list_slice(samples_list, 1, 3), lambda s: substring(s, 1, 20)), '|') AS samples
FROM meta""",
)
def q_data_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    d = en.data_dictionary(_meta(spark, sf_dir))
    return d.select("table", "field", "distinctCount", F.array_join("tags", ",").alias("tags"),
                    F.array_join("samples", "|").alias("samples"))


_FLAG_BASE = """fb AS (
  SELECT * FROM meta
  WHERE NOT starts_with(field, '%')
    AND NOT (tags LIKE '%$numeric%' OR tags LIKE '%$integer%')
    AND NOT (regexp_matches(field, '(?i)^(Year|Month|Quarter|Week|Day|WeekDay|MonthYear|Date_Diff|Month_Diff|Year_Diff|Date|Time|Timestamp)$')
             OR tags LIKE '%$date%' OR tags LIKE '%$timestamp%')
    AND distinctCount = 2 AND len(samples_list) = 2),
fh AS (
  SELECT *, regexp_matches(field, '(?i)(flag|status|yes|no|active|valid|binary|imported|return)')
            OR len(list_filter(samples_list, lambda v: list_contains(['yes', 'no', 'y', 'n', '1', '0', 'true', 'false', 'active', 'inactive'], lower(v)))) > 0 AS hit
  FROM fb)"""


@register(
    "flag_candidates",
    f"""WITH {_META}, {_FLAG_BASE}
SELECT tbl AS "table", field, array_to_string(samples_list, '|') AS "values" FROM fh
WHERE hit AND NOT (contains(field, 'SourceTable') AND NOT contains(lower(field), 'flag'))""",
)
def q_flag_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    return en.flag_candidates(_meta(spark, sf_dir)).select("table", "field", F.array_join("values", "|").alias("values"))


@register(
    "ambiguous_flags",
    f"""WITH {_META}, {_FLAG_BASE}
SELECT tbl AS "table", field, array_to_string(samples_list, '|') AS "values" FROM fh WHERE NOT hit""",
)
def q_ambiguous_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    return en.ambiguous_flags(_meta(spark, sf_dir)).select("table", "field", F.array_join("values", "|").alias("values"))


@register(
    "as_of_candidate",
    f"""WITH {_META}
SELECT tbl AS sourceTable, field AS dateField FROM meta
WHERE field = 'CanonicalDate' OR tags LIKE '%$date%' OR tags LIKE '%$timestamp%'
ORDER BY CASE WHEN field = 'CanonicalDate' THEN 0 ELSE 1 END, tidx, pos LIMIT 1""",
)
def q_as_of_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    return en.as_of_candidate(_meta(spark, sf_dir))


@register(
    "pareto_candidates",
    f"""WITH {_META}, {_CL},
ms AS (SELECT tbl, field, row_number() OVER (PARTITION BY tbl ORDER BY pos) AS r FROM meta
       WHERE tags LIKE '%$numeric%' AND NOT starts_with(field, '%') AND NOT tags LIKE '%$key%'
         AND tbl NOT IN ('LinkTable', 'MasterCalendar', 'CanonicalDateBridge')),
ds AS (SELECT tbl, field, row_number() OVER (PARTITION BY tbl ORDER BY pos) AS r FROM cls
       WHERE type = 'ATTRIBUTE' AND distinctCount > 10
         AND NOT contains(lower(field), 'date') AND NOT contains(lower(field), 'id'))
SELECT ms.tbl AS factTable, CAST(NULL AS VARCHAR) AS linkTable, CAST(NULL AS VARCHAR) AS keyField,
       ds.field AS dimensionField, ms.field AS measureField
FROM ms JOIN ds ON ds.tbl = ms.tbl AND ds.r = 1 WHERE ms.r = 1""",
)
def q_pareto_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    d = _discover(spark, sf_dir)
    meta = en.live_metadata(d.tables, counts=d.counts)
    return en.pareto_candidates(meta, d.fields)


# ------------------------------------------------------------------ sources and sinks
def _shared_folder(spark: SparkSession, prefix: str) -> str:
    """A fresh folder under the session's checkpoint directory (the shared
    folder a cluster names in spark.checkpoint.dir)."""
    import uuid

    from starloom.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


@register("load_folder", ot.profile_sql(["customer", "nation", "region"]))
def q_load_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension tables written as CSV files with a shared name
    prefix, loaded back raw (all text) as a folder and profiled."""
    from starloom.sources import load_folder

    folder = _shared_folder(spark, "csv")
    t = _t(spark, sf_dir, "customer", "nation", "region")
    for name, df in t.items():
        df.write.option("header", True).csv(f"{folder}/tpch_{name}.csv")
    loaded = load_folder(spark, folder)
    return _profile_out(pr.profile(loaded))


@register("load_folder_facts", ot.profile_sql(["orders", "lineitem"]))
def q_load_folder_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact tables, their dates as text, loaded back and profiled
    like the dimension tables."""
    from starloom.sources import load_folder

    folder = _shared_folder(spark, "csv")
    for name, df in _t(spark, sf_dir, "orders", "lineitem").items():
        _ts_text(df).write.option("header", True).csv(f"{folder}/tpch_{name}.csv")
    return _profile_out(pr.profile(load_folder(spark, folder)))


@register(
    "save_model",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS VARCHAR) AS o_orderdate,
       o_orderpriority FROM orders""",
)
def q_save_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model written as parquet (replacing what was there) and read
    back."""
    from starloom.sources import read_model, save_model

    folder = _shared_folder(spark, "model")
    saved = save_model(_t(spark, sf_dir, "orders", "lineitem"), folder)
    return _ts_text(read_model(spark, saved)["orders"])


@register(
    "save_model_tables",
    """SELECT 'orders' AS "table", * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders
UNION ALL BY NAME
SELECT 'lineitem' AS "table", * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate) FROM lineitem""",
)
def q_save_model_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table of the saved model read back."""
    from starloom.sources import read_model, save_model

    folder = _shared_folder(spark, "model")
    back = read_model(spark, save_model(_t(spark, sf_dir, "orders", "lineitem"), folder))
    orders, lines = (_ts_text(back[n]).withColumn("table", F.lit(n)) for n in ("orders", "lineitem"))
    return orders.unionByName(lines, allowMissingColumns=True)


@register(
    "sample_load",
    " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM {t} LIMIT 1)"
        for t in STAR_TABLES
    ),
)
def q_sample_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``FIRST 1`` loads of every table (a structural check)."""
    from starloom.sources import sample_load

    parts = [
        sample_load(df).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table"), "n")
        for n, df in _t(spark, sf_dir, *STAR_TABLES).items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "qualify",
    """SELECT n_nationkey AS "nation.n_nationkey", n_name AS "nation.n_name", n_regionkey AS "nation.n_regionkey" FROM nation""",
)
def q_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.sources import qualify

    return qualify(_t(spark, sf_dir, "nation")["nation"], "nation")


@register("distinct_load", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def q_distinct_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.sources import distinct_load

    return distinct_load(_t(spark, sf_dir, "orders")["orders"], ["o_orderstatus", "o_orderpriority"])


# ------------------------------------------------------------------ typed reload of raw text
def _csv_model(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    """The tables written as CSV files with a shared name prefix and loaded
    back raw, in the order of ``names``."""
    from starloom.sources import load_folder

    folder = _shared_folder(spark, "csv")
    for name, df in _t(spark, sf_dir, *names).items():
        _ts_text(df).write.option("header", True).csv(f"{folder}/tpch_{name}.csv")
    loaded = load_folder(spark, folder)
    return {n: loaded[n] for n in names}


_TYPED = f"""SELECT table_name AS "table", column_name AS field,
       CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'bigint' WHEN data_type = 'DOUBLE' THEN 'double'
            WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp' ELSE 'string' END AS type, CAST(0 AS BIGINT) AS rejects
FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in STAR_TABLES)})"""


@register("typed_columns", _TYPED)
def q_typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the star tables' columns, found in their CSV text."""
    from starloom.operators import typed as ty

    return ty.column_types(_csv_model(spark, sf_dir, STAR_TABLES)).select("table", "field", "type", "rejects")


@register(
    "typed_load",
    """SELECT 'orders' AS "table", * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate) FROM orders
UNION ALL BY NAME
SELECT 'lineitem' AS "table", * REPLACE (CAST(l_shipdate AS VARCHAR) AS l_shipdate, CAST(l_linenumber AS BIGINT) AS l_linenumber)
FROM lineitem""",
)
def q_typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both facts, from CSV text back to typed rows."""
    from starloom.operators import typed as ty

    model = ty.typed_model(_csv_model(spark, sf_dir, ["orders", "lineitem"]))
    orders, lines = (_ts_text(model[n]).withColumn("table", F.lit(n)) for n in ("orders", "lineitem"))
    return orders.unionByName(lines, allowMissingColumns=True)


def _csv_discovery(spark: SparkSession, sf_dir: str) -> md.Discovery:
    from starloom.operators import typed as ty

    tables, counts = ty.counted_model(_csv_model(spark, sf_dir, STAR_TABLES))
    return md.discover(tables, md.overrides_frame(spark, DRIVER_ALIASES), counts=counts)


@register("link_table_csv", ORACLE["link_table"])
def q_link_table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The link table of the star tables loaded from CSV: that of their
    Parquet files."""
    return _ts_text(md.build_model(_csv_discovery(spark, sf_dir)).tables["LinkTable"])


@register("as_of_candidate_csv", ORACLE["as_of_candidate"])
def q_as_of_candidate_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    return en.as_of_candidate(en.live_metadata(_csv_discovery(spark, sf_dir).tables))


@register("pareto_candidates_csv", ORACLE["pareto_candidates"])
def q_pareto_candidates_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import enrich as en

    d = _csv_discovery(spark, sf_dir)
    return en.pareto_candidates(en.live_metadata(d.tables, counts=d.counts), d.fields)


@register("classify_fields_csv", ORACLE["classify_fields"])
def q_classify_fields_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15 on raw text, where the values say which columns are dates."""
    from starloom.operators import typed as ty

    raw = _csv_model(spark, sf_dir, STAR_TABLES)
    types = ty.column_types(raw).transform(materialize)
    d = md.discover(raw, md.overrides_frame(spark, DRIVER_ALIASES), types=types)
    return d.fields.select("table", "field", "pos", "type", "alias")


# ------------------------------------------------------------------ more catalog rules
@register(
    "field_cardinality",
    """SELECT "table", field, rowCount, distinctCount FROM (""" + ot.profile_sql(STAR_TABLES, with_samples=False) + ")",
)
def q_field_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.field_cardinality(_t(spark, sf_dir, *STAR_TABLES))


@register(
    "date_fields",
    f"""WITH {_CL}
SELECT tbl AS "table", field FROM cls WHERE type = 'DATE'""",
)
def q_date_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import classify as cl

    return cl.date_fields(_discover(spark, sf_dir).fields).select("table", "field")


@register(
    "validate_keys",
    f"""WITH {_CL}
SELECT tbl AS "table", field FROM cls WHERE type = 'IDENTIFIER'""",
)
def q_validate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposed keys = every grain field plus one that does not exist;
    the missing one is dropped, native links (none among the raw names)
    would be added."""
    from starloom.operators import graph as gr
    from starloom.operators import structure as st

    d = _discover(spark, sf_dir)
    proposed = d.roles.select("table", F.explode("grainFields").alias("field")).unionByName(
        spark.createDataFrame([("orders", "o_no_such_key")], "table string, field string")
    )
    shared = gr.shared_fields(d.fields.select("tidx", "table", "field"))
    return st.validate_keys(proposed, d.fields, shared)


@register("value_overlap_approx", f"WITH {_OV} SELECT tableA, fieldA, tableB, fieldB FROM ovl")
def q_value_overlap_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1-D3 on the sketch path: HyperLogLog distinct counts and theta-sketch
    intersections; pairs that the sketches' bounds leave open are counted.  The
    accepted pairs are those of the exact path."""
    tables = _t(spark, sf_dir, *STAR_TABLES)
    found = md.discover(tables, md.overrides_frame(spark, DRIVER_ALIASES), approx=True).overlap
    return found.select("tableA", "fieldA", "tableB", "fieldB")


@register(
    "golden_keys",
    f"""WITH {_CL}, {ot.roles_cte()},
e AS (SELECT c.tidx, c.tbl, c.pos, c.field, c.type = 'IDENTIFIER' AS cand, r.role = 'DIMENSION' AS is_dim,
             {ot.entity_sql('c.tbl')} AS te, {ot.entity_sql('c.field')} AS fe,
             regexp_matches(c.field, '(?i)(date|time|year|month|day)') AS dated
      FROM cls c JOIN roles r ON r.tbl = c.tbl),
named AS (SELECT *, {ot.pascal_sql('te')} AS table_key, {ot.pascal_sql('fe')} AS field_key FROM e)
SELECT tidx, tbl AS "table", pos, field, regexp_replace(
       CASE WHEN cand AND is_dim AND fe = te THEN table_key WHEN cand THEN field_key
            WHEN dated THEN tbl || '_' || field
            WHEN is_dim AND NOT starts_with(field, tbl) THEN tbl || '_' || field ELSE field END, '\\s+', '', 'g') AS golden
FROM named""",
)
def q_golden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import structure as st

    d = _discover(spark, sf_dir)
    return st.golden_keys(d.fields, d.roles)


def _split_orders(spark: SparkSession, sf_dir: str):
    from starloom.operators import classify as cl

    o = _t(spark, sf_dir, "orders")["orders"]
    early = F.year("o_orderdate") < 1998
    split = {"orders_early": o.where(early), "orders_late": o.where(~early).drop("o_orderpriority")}
    fields = cl.classify_fields(pr.profile(split, samples=0))
    return split, fields, cl.table_roles(fields)


_SLICES = list(ORDER_SLICES)
_NO_ALIAS = [("no table", "no field", None, None)]
_SLICE_CLS = f"{ot.slices_ctes()}, {ot.classify_ctes(_SLICES, _NO_ALIAS)}, {ot.roles_cte()}, {ot.groups_ctes()}"


@register("fact_groups", f"""WITH {_SLICE_CLS}
SELECT grp AS "group", tbl AS "table", member_pos FROM grouped""")
def q_fact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from starloom.operators import structure as st

    _, fields, roles = _split_orders(spark, sf_dir)
    return st.fact_groups(fields, roles)


@register(
    "conform_group",
    f"""WITH RECURSIVE {_SLICE_CLS}, {ot.overlap_ctes(_SLICES)}, {ot.alias_pairs_cte()}, {ot.link_scores_ctes()}, {ot.canonical_ctes()},
named_fp AS (SELECT canon.*, g.grp, g.member_pos, lower(regexp_replace(canon.field, '[\\s_-]', '', 'g')) AS f
             FROM canon LEFT JOIN grouped g ON g.tbl = canon.tbl)
SELECT tbl AS "table", field, CASE WHEN grp IS NULL THEN canonical
       ELSE first_value(canonical) OVER (PARTITION BY grp, f ORDER BY member_pos, pos) END AS canonical
FROM named_fp""",
)
def q_conform_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both yearly slices, with the links discovered between them, end up
    with one canonical name per footprint."""
    from starloom.operators import links as lk
    from starloom.operators import structure as st

    split, fields, roles = _split_orders(spark, sf_dir)
    canon = lk.normalize_names(fields, md.discover(split).links).transform(materialize)
    return st.conform_group(canon, st.fact_groups(fields, roles)).select("table", "field", "canonical")


def _sliced_discovery(spark: SparkSession, sf_dir: str) -> md.Discovery:
    """The star tables with orders in two slices."""
    tables = _t(spark, sf_dir, *STAR_TABLES)
    early = F.year("o_orderdate") < 1998
    slices = [tables["orders"].where(early), tables["orders"].where(~early).drop("o_orderpriority")]
    model: dict[str, DataFrame] = {}
    for n, df in tables.items():
        model |= dict(zip(ORDER_SLICES, slices)) if n == "orders" else {n: df}
    aliases = [(t, f, k, a) for n, f, k, a in DRIVER_ALIASES for t in (ORDER_SLICES if n == "orders" else [n])]
    return md.discover(model, md.overrides_frame(spark, aliases), scan_columns=SCAN_COLUMNS)


_GROUPED = f"""{SLICED} AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         CASE WHEN year(o_orderdate) < 1998 THEN o_orderpriority END AS o_orderpriority,
         CASE WHEN year(o_orderdate) < 1998 THEN 'orders_early' ELSE 'orders_late' END AS "%{SLICED}_SourceTable" FROM orders)"""
_GRAINS2 = {SLICED: GRAINS["orders"], "lineitem": GRAINS["lineitem"]}
_SKEY = ot.key_expr(SLICED, GRAINS["orders"])


@register(
    "profile_grouped",
    f"WITH {_GROUPED} {ot.profile_sql([SLICED])}",
)
def q_profile_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the two slices' union, from the slices' value
    counts, without a scan of the union."""
    found = _sliced_discovery(spark, sf_dir).grouped().profile
    return _profile_out(found.where(F.col("table") == SLICED))


@register(
    "link_table_grouped",
    f"""WITH {_GROUPED}, {ot.keys_cte(_GRAINS2)}
SELECT DISTINCT * FROM (
  SELECT '{SLICED}' AS "%LinkTable_SourceTable", k.id AS "%Key_{SLICED}", CAST(NULL AS BIGINT) AS "%Key_lineitem",
         k.id AS "%DateBridgeKey", o.o_orderkey AS "Order",
         CAST(o.o_orderdate AS VARCHAR) AS {SLICED}_o_orderdate, CAST(NULL AS VARCHAR) AS lineitem_l_shipdate
  FROM {SLICED} o JOIN keyids k ON k.h = {_SKEY}
  UNION ALL
  SELECT 'lineitem', NULL, k.id, k.id, l.l_orderkey, NULL, CAST(l.l_shipdate AS VARCHAR)
  FROM lineitem l JOIN keyids k ON k.h = {_LKEY})""",
)
def q_link_table_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D22-D24 inside the build: the link table over orders in two slices is
    that over orders."""
    return _ts_text(md.build_model(_sliced_discovery(spark, sf_dir)).tables["LinkTable"])


# ------------------------------------------------------------------ cardinalities, header and detail, repair
@register(
    "link_cardinalities",
    f"""WITH {_OV}, {_CL}, {ot.alias_pairs_cte()}, {ot.link_scores_ctes()},
many AS ({" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS field, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}" for t in STAR_TABLES for c in DRIVER_SCHEMAS[t])}),
most AS (
  SELECT sc.tableA, sc.fieldA, sc.tableB, sc.fieldB, CAST(sc.confidence AS INTEGER) AS confidence,
         CAST(max(a.n) AS BIGINT) AS maxA, CAST(max(b.n) AS BIGINT) AS maxB
  FROM sc JOIN many a ON a.tbl = sc.tableA AND a.field = sc.fieldA
  JOIN many b ON b.tbl = sc.tableB AND b.field = sc.fieldB AND b.v = a.v
  WHERE sc.confidence >= 70 GROUP BY ALL)
SELECT *, CASE WHEN maxA = 1 AND maxB = 1 THEN '1:1' WHEN maxA = 1 THEN '1:n' WHEN maxB = 1 THEN 'n:1' ELSE 'n:m' END AS cardinality
FROM most""",
)
def q_link_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _discover(spark, sf_dir).cardinalities


def _with_details(spark: SparkSession, sf_dir: str) -> md.BuiltModel:
    return md.build_model(_discover(spark, sf_dir), today=TODAY, key_mode="hash", header_detail=True)


@register(
    "header_detail_link",
    f"""SELECT DISTINCT * FROM (
  SELECT 'lineitem' AS "%LinkTable_SourceTable", {_LKEY} AS "%Key_lineitem",
         CASE WHEN o_orderkey IS NOT NULL THEN {_OKEY} END AS "%Key_orders",
         CASE WHEN o_orderkey IS NOT NULL THEN {_OKEY} END AS "%DateBridgeKey", l_orderkey AS "Order",
         CAST(o_orderdate AS VARCHAR) AS orders_o_orderdate, CAST(l_shipdate AS VARCHAR) AS lineitem_l_shipdate
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey
  UNION ALL
  SELECT 'orders', NULL, {_OKEY}, {_OKEY}, o_orderkey, CAST(o_orderdate AS VARCHAR), NULL
  FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL))""",
)
def q_header_detail_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines carry their order's key into the link table."""
    return _ts_text(_with_details(spark, sf_dir).tables["LinkTable"])


@register(
    "header_detail_bridge",
    f"""SELECT DISTINCT * FROM (
  SELECT 'orders' AS "%CanonicalDateBridge_SourceTable", {_OKEY} AS "%DateBridgeKey",
         strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS CanonicalDate, 'orders_o_orderdate' AS DateType FROM orders
  UNION ALL
  SELECT 'lineitem', {_OKEY}, strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d'), 'lineitem_l_shipdate'
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
)
def q_header_detail_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All dates hang on the order."""
    return _ts_text(_with_details(spark, sf_dir).tables["CanonicalDateBridge"])


@register(
    "trimmed_facts",
    f"""SELECT 'orders' AS fact, {_OKEY} AS "key", o_custkey AS a, CAST(NULL AS BIGINT) AS b, o_totalprice AS c, 5 AS columns FROM orders
UNION ALL SELECT 'lineitem', {_LKEY}, l_partkey, l_suppkey, l_extendedprice, 10 FROM lineitem""",
)
def q_trimmed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of the built model without the fields that went to the
    link table, and how many columns that leaves."""
    built = md.build_model(_discover(spark, sf_dir), key_mode="hash")
    parts = []
    for fact, (a, b, c) in {
        "orders": ("Customer", None, "orders_o_totalprice"), "lineitem": ("Part", "Supplier", "lineitem_l_extendedprice"),
    }.items():
        df = built.tables[fact]
        parts.append(df.select(
            F.lit(fact).alias("fact"), F.col(f"`%Key_{fact}`").alias("key"), F.col(a).cast("long").alias("a"),
            (F.col(b) if b else F.lit(None)).cast("long").alias("b"), F.col(c).alias("c"), F.lit(len(df.columns)).alias("columns"),
        ))
    return parts[0].unionByName(parts[1])


_REPAIR = f"""{_OV}, {_CL}, {ot.alias_pairs_cte()}, {ot.link_scores_ctes()}, {ot.canonical_ctes()}, {ot.roles_cte()},
weight AS (
  SELECT tbl, field, max(confidence) AS score
  FROM (SELECT tableA AS tbl, fieldA AS field, confidence FROM sc UNION ALL SELECT tableB, fieldB, confidence FROM sc)
  WHERE confidence >= 70 GROUP BY tbl, field),
moved AS (  -- what goes to the link table: fields of two facts, and dates of facts
  SELECT canonical FROM canon JOIN roles USING (tbl) WHERE role = 'FACT' AND canon.type <> 'MEASURE'
  GROUP BY canonical HAVING count(DISTINCT tbl) > 1 OR bool_or(canon.type = 'DATE')),
edge AS (
  SELECT row_number() OVER (ORDER BY coalesce(w.score, 0) DESC, r.role <> 'FACT', c.tidx, c.pos) AS i, c.tbl, c.canonical AS field
  FROM canon c JOIN roles r ON r.tbl = c.tbl LEFT JOIN weight w ON w.tbl = c.tbl AND w.field = c.field
  WHERE NOT (r.role = 'FACT' AND c.canonical IN (SELECT canonical FROM moved))
    AND c.canonical IN (SELECT canonical FROM canon GROUP BY canonical HAVING count(*) > 1)),
facts AS (SELECT min(tbl) AS hub FROM roles WHERE role = 'FACT'),  -- facts hang together through the link table
forest(i, s, out) AS (
  SELECT CAST(0 AS BIGINT), (SELECT list({{'n': n, 'g': g}}) FROM (
    SELECT 't ' || tbl AS n, CASE WHEN role = 'FACT' THEN 't ' || (SELECT hub FROM facts) ELSE 't ' || tbl END AS g FROM roles
    UNION ALL SELECT DISTINCT 'f ' || field, 'f ' || field FROM edge)), false
  UNION ALL
  SELECT i, CASE WHEN ga = gb THEN s ELSE list_transform(s, lambda x: {{'n': x.n, 'g': CASE WHEN x.g = gb THEN ga ELSE x.g END}}) END, ga = gb
  FROM (SELECT e.i, f.s, list_filter(f.s, lambda x: x.n = 't ' || e.tbl)[1].g AS ga,
               list_filter(f.s, lambda x: x.n = 'f ' || e.field)[1].g AS gb
        FROM forest f JOIN edge e ON e.i = f.i + 1)),
closing AS (SELECT e.tbl, e.field FROM forest f JOIN edge e ON e.i = f.i WHERE f.out)"""


@register(
    "cycle_fields",
    f"""WITH RECURSIVE {_REPAIR}
SELECT tbl AS "table", field, tbl || '_' || field AS new_name FROM closing""",
)
def q_cycle_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 -> D25: the associations of the star model that close a cycle, and
    what becomes of their fields."""
    plan = md.plan_model(_discover(spark, sf_dir))
    plan = plan.repaired(md.link_weights(_discover(spark, sf_dir), plan.canonical))
    return spark.createDataFrame(plan.repairs, '`table` string, field string, new_name string')


@register(
    "validate_repaired",
    f"""WITH RECURSIVE {_REPAIR},
model AS (
  SELECT c.tbl, c.canonical AS field FROM canon c JOIN roles r ON r.tbl = c.tbl
  WHERE NOT (r.role = 'FACT' AND c.canonical IN (SELECT canonical FROM moved))
    AND NOT EXISTS (SELECT 1 FROM closing x WHERE x.tbl = c.tbl AND x.field = c.canonical)
  UNION SELECT 'LinkTable', canonical FROM moved
  UNION SELECT tbl, '%Key_' || tbl FROM roles WHERE role = 'FACT'
  UNION SELECT 'LinkTable', '%Key_' || tbl FROM roles WHERE role = 'FACT'
  UNION VALUES ('LinkTable', '%DateBridgeKey'), ('CanonicalDateBridge', '%DateBridgeKey'),
               ('CanonicalDateBridge', 'CanonicalDate'), ('MasterCalendar', 'CanonicalDate')),
pair AS (SELECT DISTINCT a.tbl AS a, b.tbl AS b FROM model a JOIN model b ON a.field = b.field AND a.tbl < b.tbl),
reach(node, label) AS (
  SELECT DISTINCT tbl, tbl FROM model UNION
  SELECT p.dst, r.label FROM reach r JOIN (SELECT a AS src, b AS dst FROM pair UNION SELECT b, a FROM pair) p ON p.src = r.node),
syn AS (SELECT a.tbl AS a, b.tbl AS b FROM model a JOIN model b ON a.field = b.field AND a.tbl < b.tbl GROUP BY ALL HAVING count(*) > 1),
link AS (SELECT CAST(sum(n - 1) AS BIGINT) AS n_edges FROM (SELECT count(*) AS n FROM model GROUP BY field))
SELECT (SELECT count(DISTINCT tbl) FROM model) AS n_tables, n_edges,
       (SELECT count(DISTINCT label) FROM (SELECT node, min(label) AS label FROM reach GROUP BY node)) AS n_islands,
       (SELECT count(*) FROM syn) AS n_synthetic_keys,
       n_edges > (SELECT count(DISTINCT tbl) FROM model) - 1 AS has_cycle, (SELECT count(*) FROM syn) = 0 AS success,
       '' AS errors, '' AS warnings
FROM link""",
)
def q_validate_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 of the rebuilt star model: clean."""
    report = md.build_model(_discover(spark, sf_dir), key_mode="hash").report()
    return report.withColumns({c: F.array_join(c, "; ") for c in ("errors", "warnings")})


@register(
    "grand_total",
    """SELECT l_returnflag, CAST(s AS DOUBLE) AS qty, CAST(sum(s) OVER () AS DOUBLE) AS total_qty
FROM (SELECT l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,2))) AS s FROM lineitem GROUP BY l_returnflag)""",
)
def q_grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")["lineitem"].withColumn("l_quantity", money("l_quantity"))
    per = an.sum_by(li, "l_returnflag", "l_quantity", "qty")
    res = an.grand_total(per, "qty", "total_qty")
    return res.select("l_returnflag", F.col("qty").cast("double"), F.col("total_qty").cast("double"))


@register("profile_approx")
def q_profile_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 with ``approx=True``: one wide aggregate per table, HLL distincts."""
    return pr.profile(_t(spark, sf_dir, *STAR_TABLES), approx=True).drop("sampleValues")


_SALES = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region"]


def _sales(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star tables, lines first, associated by their keys' names; a part
    is called a product."""
    tables = _star(spark, sf_dir).tables
    return {n: tables[n].withColumnRenamed("Part", "Product") for n in _SALES}


def _pareto_sql(table: str, dim: str, measure: str) -> str:
    return f"""SELECT 'Pareto_{table}' AS tool, {dim} AS a,
       CASE WHEN acc / tot <= 0.8 THEN 'Top 80%' ELSE 'Bottom 20%' END AS b, CAST(s AS DOUBLE) AS n
FROM (SELECT {dim}, s, sum(s) OVER (ORDER BY s DESC NULLS LAST, {dim} ROWS UNBOUNDED PRECEDING) AS acc, sum(s) OVER () AS tot
      FROM (SELECT {dim}, sum(CAST({measure} AS DOUBLE)) AS s FROM {table} GROUP BY {dim}))
WHERE (SELECT count(DISTINCT {dim}) FROM {table}) > 10"""


@register(
    "enrich_model",
    f"""WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_shipdate IS NOT NULL)
SELECT 'AsOf_Table' AS tool, strftime(d, '%Y-%m-%d') AS a, strftime(d, '%Y-%m-%d') || ' Current Day' AS b, CAST(NULL AS DOUBLE) AS n FROM d
UNION ALL SELECT 'AsOf_Table', strftime(d, '%Y-%m-%d'), strftime(CAST(d - to_months(i) AS DATE), '%Y-%m-%d') || ' Rolling 12 Months', NULL
FROM d, range(0, 12) AS r(i)
UNION ALL SELECT DISTINCT 'Flag_lineitem_l_linestatus', l_linestatus, NULL, CASE l_linestatus WHEN 'F' THEN 1.0 ELSE 2.0 END FROM lineitem
UNION ALL {_pareto_sql('customer', 'c_name', 'c_acctbal')}
UNION ALL {_pareto_sql('supplier', 's_name', 's_acctbal')}
UNION ALL {_pareto_sql('part', 'p_name', 'p_size')}
UNION ALL SELECT 'Basket_Product', CAST(a.l_partkey AS VARCHAR), CAST(b.l_partkey AS VARCHAR), CAST(count(*) AS DOUBLE)
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey""",
)
def q_enrich_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the tables that enrichment adds to the saved
    model, one transaction each."""
    from starloom.operators import enrich as en
    from starloom.sources import ModelStore

    model = _sales(spark, sf_dir)
    store = ModelStore(spark, _shared_folder(spark, "enriched"))
    store.save(model)
    keys = [(t, "Product" if a == "Part" else a, "IDENTIFIER", None) for t, _, _, a in DRIVER_ALIASES]
    d = md.discover(store.read(), md.overrides_frame(spark, keys), scan_columns=SCAN_COLUMNS)
    en.enrich(store, d.fields, ["lineitem", "orders"], counts=d.counts)
    made = {n: df for n, df in store.read().items() if n not in model}
    parts = []
    for name, df in made.items():
        c = [F.col(f"`{x}`") for x in df.columns]
        if name == "AsOf_Table":
            a, b, n = F.date_format(c[0], "yyyy-MM-dd"), F.concat_ws(" ", F.date_format(c[1], "yyyy-MM-dd"), c[2]), F.lit(None)
        elif name.startswith("Pareto"):
            a, b, n = c[0], c[3], c[1]
        else:
            a, b, n = c[0], c[1] if len(c) > 2 else F.lit(None), c[-1]
        parts.append(df.select(
            F.lit(name).alias("tool"), a.cast("string").alias("a"), b.cast("string").alias("b"), n.cast("double").alias("n")
        ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register(
    "basket_candidate",
    """SELECT 'lineitem' AS "table", 'Order' AS idField, 'Product' AS itemField,
       (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey) <> max(l_partkey))) > 0 AS viable""",
)
def q_basket_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17 with its A11 gate."""
    from starloom.operators import enrich as en

    model = _sales(spark, sf_dir)
    found = en.basket_candidate(en.live_metadata(model), spark.createDataFrame([(0, "lineitem")], "tidx int, table string"))
    r = found.first()
    viable = en.is_one_to_many(model[r["table"]], r["idField"], r["itemField"])
    return found.select("table", "idField", "itemField", F.lit(viable).alias("viable"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
