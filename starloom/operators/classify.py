"""Field classes, grain and table roles.

All inputs are catalog DataFrames (one row per column of the model), so
windows partitioned by table stay bounded by a table's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The classification rule (ours; replaces the language-model call).
ID_SUFFIX_PATTERN = r"(?i)(key|number)$"
ID_SEPARATED_PATTERN = r"(?i)(^|[_\s-])(id|code|num)$"
ID_CAMEL_PATTERN = r"[a-z0-9](ID|Id|Code|Num)$"
BARCODE_PATTERN = r"(?i)barcode"
DATE_NAME_PATTERN = r"(?i)(date|time|year|month|day)"
DATE_TYPES = ["date", "timestamp", "timestamp_ntz"]
PRIMARY_KEY_UNIQUENESS = 0.95
FACT_ROWS = 50000
CLASSES = ["IDENTIFIER", "MEASURE", "DATE", "ATTRIBUTE", "SYSTEM_METADATA"]


def is_identifier_name(c):
    return c.rlike(ID_SUFFIX_PATTERN) | c.rlike(ID_SEPARATED_PATTERN) | c.rlike(ID_CAMEL_PATTERN) | c.rlike(BARCODE_PATTERN)


def date_fields(fields: DataFrame) -> DataFrame:
    """Fields that hold dates: a date/timestamp type or class DATE when
    classes exist, else a non-numeric field whose name says date/time."""
    if "type" in fields.columns:
        return fields.where(F.col("type") == "DATE")
    return fields.where(
        F.col("dtype").isin(*DATE_TYPES) | (~F.col("isNumeric") & F.col("field").rlike(DATE_NAME_PATTERN))
    )


def classify_fields(profile: DataFrame, overrides: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """Add ``type`` (one of the five classes) and ``alias``.

    Rule: IDENTIFIER by name (``key``/``number`` suffix, ``id``/``code``/
    ``num`` after a separator or camelCase boundary, ``barcode``); DATE by
    type or by a date-like name on a non-numeric field; MEASURE for the other
    numeric fields of a table with >= 2 foreign keys, or >= 1 foreign key and
    a date; ATTRIBUTE otherwise.  ``overrides(table, field, type, alias)``
    wins; the alias defaults to the field's own name.

    ``types(table, field, type)``, from ``typed.column_types``, lets the values
    of raw text columns say whether they are dates: a column of dates is DATE by
    any name, and a date-like name alone does not make one.
    """
    p = profile
    by_name = ~F.col("isNumeric") & F.col("field").rlike(DATE_NAME_PATTERN)
    if types is not None:
        p = p.join(types.select("table", "field", F.col("type").alias("_vtype")), ["table", "field"], "left")
        by_values = F.col("_vtype").isin(*DATE_TYPES)
        by_name = F.when(F.col("_vtype").isNull(), by_name).otherwise(by_values)
    if overrides is not None:
        o = overrides.select(
            "table", "field", F.col("type").alias("_otype"), F.col("alias").alias("_oalias")
        )
        p = p.join(o, ["table", "field"], "left")
    else:
        p = p.withColumn("_otype", F.lit(None).cast("string")).withColumn("_oalias", F.lit(None).cast("string"))
    is_date = F.col("dtype").isin(*DATE_TYPES) | by_name
    base = (
        F.when(F.col("_otype").isNotNull(), F.col("_otype"))
        .when(is_identifier_name(F.col("field")), F.lit("IDENTIFIER"))
        .when(is_date, F.lit("DATE"))
    )
    p = p.withColumn("_base", base)
    w = Window.partitionBy("table")
    fk = (F.col("_base") == "IDENTIFIER") & (F.col("uniquenessRatio") < PRIMARY_KEY_UNIQUENESS)
    p = p.withColumn("_fks", F.sum(F.when(fk, 1).otherwise(0)).over(w)).withColumn(
        "_dates", F.sum(F.when(F.col("_base") == "DATE", 1).otherwise(0)).over(w)
    )
    measure = F.col("isNumeric") & ((F.col("_fks") >= 2) | ((F.col("_fks") >= 1) & (F.col("_dates") >= 1)))
    typ = F.coalesce(F.col("_base"), F.when(measure, F.lit("MEASURE")).otherwise(F.lit("ATTRIBUTE")))
    return p.withColumn("type", typ).withColumn("alias", F.coalesce(F.col("_oalias"), F.col("field"))).drop(
        "_otype", "_oalias", "_base", "_fks", "_dates", "_vtype"
    )


def _ordered_names(cond) -> F.Column:
    return F.transform(
        F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos"), F.col("field"))))),
        lambda s: s["field"],
    )


def grain(fields: DataFrame) -> DataFrame:
    """Per table ``primaryKey`` (identifiers with uniqueness >= 0.95),
    ``foreignKeys`` (other identifiers), ``grainFields`` (all identifiers in
    column order) and ``grainDescription`` (`` + ``-joined or ``Unknown``)."""
    is_id = F.col("type") == "IDENTIFIER"
    pk = is_id & (F.col("uniquenessRatio") >= PRIMARY_KEY_UNIQUENESS)
    fk = is_id & (F.col("uniquenessRatio") < PRIMARY_KEY_UNIQUENESS)
    g = fields.groupBy("tidx", "table").agg(
        _ordered_names(pk).alias("primaryKey"),
        _ordered_names(fk).alias("foreignKeys"),
        _ordered_names(is_id).alias("grainFields"),
    )
    return g.withColumn(
        "grainDescription",
        F.when(F.size("grainFields") > 0, F.array_join("grainFields", " + ")).otherwise(F.lit("Unknown")),
    )


def table_roles(fields: DataFrame, fact_rows: int | None = FACT_ROWS) -> DataFrame:
    """FACT when (measures > 0 and foreign keys > 0) or (rows >
    ``fact_rows`` and foreign keys >= 2), else DIMENSION; with the grain
    columns.  ``fact_rows=None`` leaves the row count out of the rule."""
    many_rows = F.lit(False) if fact_rows is None else F.col("rowCount") > fact_rows
    is_fk = (F.col("type") == "IDENTIFIER") & (F.col("uniquenessRatio") < PRIMARY_KEY_UNIQUENESS)
    rows = F.max("rowCount")
    if "dtype" in fields.columns:  # arrays and maps are counted by element
        rows = F.coalesce(F.max(F.when(~F.col("dtype").rlike("^(array|map)<"), F.col("rowCount"))), rows)
    counts = fields.groupBy("tidx", "table").agg(
        rows.alias("rowCount"),
        F.count_if(F.col("type") == "MEASURE").alias("measureCount"),
        F.count_if(is_fk).alias("foreignKeyCount"),
        F.count_if(F.col("type") == "DATE").alias("dateCount"),
    )
    role = F.when(
        ((F.col("measureCount") > 0) & (F.col("foreignKeyCount") > 0))
        | (many_rows & (F.col("foreignKeyCount") >= 2)),
        F.lit("FACT"),
    ).otherwise(F.lit("DIMENSION"))
    return counts.withColumn("role", role).join(grain(fields), ["tidx", "table"])
