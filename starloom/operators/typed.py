"""Types of raw text columns.

A CSV load leaves all cells as text.  Each cell votes with a bit mask of the
formats it fits; the masks of a column are ANDed, in each task before the
shuffle, so a column sends one row a task whatever its length.  Of the formats
that survive the narrowest gives the column its type: whole numbers, decimals,
numbers with an exponent, dates, timestamps, else text.

Missing and blank cells do not vote and become null in a typed column.  Text
that a type would not give back (leading zeros, more digits than a double
holds) fits no number.  With a ``tolerance`` a column takes a format that this
share of its cells fails; such cells are rejects, counted, and null.  Where two
date formats survive that differ in the order of day and month, ``day_first``
decides; without it the column stays text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.functions.values import is_blank, is_missing
from starloom.operators.profile import catalog, value_counts, with_facts
from starloom.session import materialize, stage

#: Number, date and time forms of a cell.
WHOLE = r"^-?(0|[1-9][0-9]{0,17})$"
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
EXPONENT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]{1,3})?$"
YEAR_FIRST = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
YEAR_FIRST_SLASH = r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"
YEAR_LAST_SLASH = r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"
YEAR_LAST_DASH = r"^[0-9]{2}-[0-9]{2}-[0-9]{4}$"
YEAR_LAST_DOT = r"^[0-9]{2}\.[0-9]{2}\.[0-9]{4}$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
#: digits that a double always gives back
DOUBLE_DIGITS = 15


@dataclass(frozen=True)
class Format:
    """A way to write a value: its pattern, the date pattern if it has one,
    and the type that it makes."""

    name: str
    dtype: str
    shape: str
    pattern: str | None = None
    day_first: bool | None = None

    def fits(self, cell: Column) -> Column:
        # cheap looks first: most cells fit few formats, and patterns cost more
        size, first = F.length(cell), F.ascii(cell)
        if self.dtype in ("bigint", "double"):
            shaped = first.between(ord("-"), ord("9")) & cell.rlike(self.shape)
        elif self.dtype == "date":
            shaped = (size == 10) & cell.rlike(self.shape)
        else:
            shaped = (size >= 16) & first.between(ord("0"), ord("9")) & cell.rlike(self.shape)
        if self.dtype == "double":
            return shaped & ((size <= DOUBLE_DIGITS) | (F.length(F.regexp_replace(F.regexp_replace(cell, "[eE].*", ""), "[^0-9]", "")) <= DOUBLE_DIGITS))
        return shaped if self.dtype == "bigint" else shaped & self.value(cell).isNotNull()

    def value(self, cell: Column, fits: bool = False) -> Column:
        """The typed value of a cell, null where it does not fit (or, if it is
        known that it ``fits`` or is blank, where it is blank)."""
        cell = cell if fits else F.when(cell.rlike(self.shape), cell)
        if self.pattern:
            return F.try_to_timestamp(cell, F.lit(self.pattern)).cast(self.dtype)
        return cell.try_cast(self.dtype)


#: the narrowest first
FORMATS = [
    Format("whole", "bigint", WHOLE),
    Format("decimal", "double", DECIMAL),
    Format("exponent", "double", EXPONENT),
    Format("yyyy-MM-dd", "date", YEAR_FIRST),
    Format("yyyy/MM/dd", "date", YEAR_FIRST_SLASH, "yyyy/MM/dd"),
    Format("dd.MM.yyyy", "date", YEAR_LAST_DOT, "dd.MM.yyyy"),
    Format("dd/MM/yyyy", "date", YEAR_LAST_SLASH, "dd/MM/yyyy", True),
    Format("MM/dd/yyyy", "date", YEAR_LAST_SLASH, "MM/dd/yyyy", False),
    Format("dd-MM-yyyy", "date", YEAR_LAST_DASH, "dd-MM-yyyy", True),
    Format("MM-dd-yyyy", "date", YEAR_LAST_DASH, "MM-dd-yyyy", False),
    Format("timestamp", "timestamp", TIMESTAMP),
]
_BY_NAME = {f.name: f for f in FORMATS}


def _text_cells(model: dict[str, DataFrame]) -> DataFrame | None:
    """(tidx, pos, value) of the cells of all text columns."""
    out = None
    for tidx, df in enumerate(model.values()):
        texts = [(i, f.name) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
        if not texts:
            continue
        cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.col(f"`{n}`").alias("value")) for i, n in texts])
        part = df.select(F.lit(tidx).alias("tidx"), F.inline(cells))
        out = part if out is None else out.unionByName(part)
    return out


def _counted_cells(model: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """(tidx, pos, value, n) of the text columns' distinct values that vote.  What
    stands for a wide cell fits no format, as the cell itself: no format takes as
    many characters."""
    told = with_facts(counts).where(~is_missing(F.col("value")) & ~F.col("_blank"))
    texts = [(t, p) for t, df in enumerate(model.values()) for p, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    return told.where(_one_of(texts)).select("tidx", "pos", "value", "n")


def _one_of(columns: list[tuple[int, int]]) -> Column:
    """Whether a row is of one of the columns (tidx, pos)."""
    places: dict[int, list[int]] = {}
    for t, p in columns:
        places.setdefault(t, []).append(p)
    found = F.lit(False)
    for t, own in places.items():
        found = found | ((F.col("tidx") == t) & F.col("pos").isin(own))
    return found


def column_types(
    model: dict[str, DataFrame], tolerance: float = 0.0, day_first: bool | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """One row for each column of the model: ``tidx, table, pos, field,
    dtype`` (what it is), ``cells`` (those that vote), ``format``, ``type``
    (what it should be) and ``rejects``.  With ``counts`` (the model's
    :func:`~starloom.operators.profile.value_counts`) each distinct value is looked
    at once and votes for all its cells."""
    columns = catalog(model)
    cells = _text_cells(model)
    if cells is None:
        empty = model[next(iter(model))].sparkSession.createDataFrame([], "tidx int, pos int, cells long, format string, rejects long")
        return _named(columns, empty)
    value = F.col("value")
    if counts is None:
        votes, n = cells.where(~is_missing(value) & ~is_blank(value)).withColumn("n", F.lit(1)), F.count("*")
    else:
        votes, n = _counted_cells(model, counts), F.sum("n")
    marks = [F.when(f.fits(value), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FORMATS)]
    mask = sum(marks[1:], marks[0])
    # one pass: the AND of the masks, and with a tolerance how many cells fit each
    # format (without one all cells fit the format that is chosen)
    fits = [F.col("mask").bitwiseAND(F.lit(1 << i)) != 0 for i in range(len(FORMATS) if tolerance > 0 else 0)]
    fit = [F.sum(F.when(x, F.col("n")).otherwise(F.lit(0))).alias(f"fit{i}") for i, x in enumerate(fits)]
    seen = votes.select("tidx", "pos", "n", mask.alias("mask")).groupBy("tidx", "pos").agg(
        n.alias("cells"), F.bit_and("mask").alias("mask"), *fit
    )
    within = [
        (F.col("mask").bitwiseAND(F.lit(1 << i)) != 0) | (F.col(f"fit{i}") >= F.ceil(F.col("cells") * (1 - tolerance)))
        if tolerance > 0
        else F.col("mask").bitwiseAND(F.lit(1 << i)) != 0
        for i in range(len(FORMATS))
    ]
    chosen, rejects = F.lit(None).cast("string"), F.lit(0).cast("long")
    for i, f in reversed(list(enumerate(FORMATS))):
        fine = within[i]
        if f.day_first is not None:
            twin = next(j for j, g in enumerate(FORMATS) if g.shape == f.shape and j != i)
            fine = fine & (~within[twin] | F.lit(day_first is not None and day_first == f.day_first))
        chosen = F.when(fine, F.lit(f.name)).otherwise(chosen)
        rejects = F.when(fine, F.col("cells") - F.col(f"fit{i}") if tolerance > 0 else F.lit(0).cast("long")).otherwise(rejects)
    return _named(columns, seen.select("tidx", "pos", "cells", chosen.alias("format"), rejects.alias("rejects")))


def _named(columns: DataFrame, found: DataFrame) -> DataFrame:
    kinds = F.lit(None).cast("string")
    for f in FORMATS:
        kinds = F.when(F.col("format") == f.name, F.lit(f.dtype)).otherwise(kinds)
    return columns.join(found, ["tidx", "pos"], "left").select(
        "tidx", "table", "pos", "field", "dtype", F.coalesce("cells", F.lit(0)).alias("cells"), "format",
        F.coalesce(kinds, F.col("dtype")).alias("type"), F.coalesce("rejects", F.lit(0)).alias("rejects"),
    )


def typed_model(model: dict[str, DataFrame], types: DataFrame | None = None, certain: bool = False) -> dict[str, DataFrame]:
    """The model with its text columns in the types of :func:`column_types`
    (one row a column, read on the driver to make the plan).  ``certain``: the
    types were found in this very model, so that where a column has no rejects
    each cell that is not blank fits, and its pattern is not asked again."""
    types = column_types(model) if types is None else types
    rows = types.where("format IS NOT NULL").collect()
    formats = {(r["table"], r["field"]): r["format"] for r in rows}
    fine = {(r["table"], r["field"]) for r in rows if certain and not r["rejects"]}
    out = {}
    for table, df in model.items():
        columns = []
        for name in df.columns:
            cell = F.col(f"`{name}`")
            if (table, name) in formats:
                cell = _BY_NAME[formats[table, name]].value(cell, (table, name) in fine).alias(name)
            columns.append(cell)
        out[table] = df.select(*columns)
    return out


def counted_model(model: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """A raw model with types, and the value counts of the typed model: the cells
    are read and counted once, as text, and each distinct value is looked at and
    typed once."""
    raw = stage(value_counts(model), "texts")
    types = column_types(model, counts=raw).transform(materialize)
    rows = types.where("format IS NOT NULL").collect()  # one row a column
    text = F.lit(None).cast("string")
    for name in sorted({r["format"] for r in rows}):
        cell = _BY_NAME[name].value(F.col("value"), True)
        cell = cell + F.lit(0.0) if _BY_NAME[name].dtype == "double" else cell  # one zero, as in a grouping of doubles
        text = F.when(_one_of([(r["tidx"], r["pos"]) for r in rows if r["format"] == name]), cell.cast("string")).otherwise(text)
    typed = _one_of([(r["tidx"], r["pos"]) for r in rows])
    told = raw.where(typed).select("tidx", "pos", text.alias("value"), "n").groupBy("tidx", "pos", "value").agg(F.sum("n").alias("n"))
    counts = raw.where(~typed).select("tidx", "pos", "value", "n").unionByName(told)
    return typed_model(model, types, certain=True), stage(counts, "values")


def load_typed(model: dict[str, DataFrame], tolerance: float = 0.0, day_first: bool | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """A raw model with types, and the types' report."""
    types = column_types(model, tolerance, day_first).transform(materialize)
    return typed_model(model, types), types
