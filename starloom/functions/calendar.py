"""Calendar Column helpers for the master calendar and relative deltas.

Week settings are fixed: weeks start on Sunday and restart on January 1
(so the first, broken week of a year is week 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_num(d: Column) -> Column:
    return F.ceil(F.month(d) / F.lit(3)).cast("int")


def quarter_label(d: Column) -> Column:
    """``'Q' & Ceil(Month/3)``."""
    return F.concat(F.lit("Q"), quarter_num(d).cast("string"))


def broken_week(d: Column) -> Column:
    """Week number 1..54: Sunday-start weeks, week 1 is the (possibly short)
    week holding January 1.  (``weekofyear`` is ISO and differs.)"""
    jan1_dow = F.dayofweek(F.trunc(d, "YEAR")) - 1  # Sunday = 0
    return (F.floor((F.dayofyear(d) - 1 + jan1_dow) / F.lit(7)) + 1).cast("int")


def _guarded_week(d: Column) -> Column:
    """Week, but 0 for late-January dates whose broken week exceeds 5 (the
    guard of the week-delta formula)."""
    return F.when((F.month(d) == 1) & (broken_week(d) > 5), F.lit(0)).otherwise(broken_week(d))


def week_diff(d: Column, today: Column) -> Column:
    """``(Year(d) - Year(today)) * 52 + (w(d) - w(today))`` with the guard."""
    return ((F.year(d) - F.year(today)) * 52 + (_guarded_week(d) - _guarded_week(today))).cast("int")


def month_diff(d: Column, today: Column) -> Column:
    return ((F.year(d) - F.year(today)) * 12 + (F.month(d) - F.month(today))).cast("int")


def quarter_diff(d: Column, today: Column) -> Column:
    return ((F.year(d) - F.year(today)) * 4 + (quarter_num(d) - quarter_num(today))).cast("int")
