"""Value-level Column helpers: raw text checks, numeric parsing, exact
rounding of ratios, composite-key hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a raw text cell (decimal with an
# optional exponent, or hexadecimal with 0x), surrounding whitespace allowed;
# and what counts as a blank (whitespace only).
DECIMAL_PATTERN = r"^[ \t\n\r\f\x0B]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\r\f\x0B]*$"
HEX_PATTERN = r"^[ \t\n\r\f\x0B]*0[xX][0-9a-fA-F]+[ \t\n\r\f\x0B]*$"
BLANK_PATTERN = r"^[ \t\n\r\f\x0B]+$"
WHITESPACE_EDGES = r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$"


def is_missing(c: Column) -> Column:
    """Null or the empty string (both count as null in a raw text table)."""
    return c.isNull() | (c == F.lit(""))


def is_blank(c: Column) -> Column:
    """Whitespace only; such a value is *not* missing."""
    return c.rlike(BLANK_PATTERN)


def is_numeric_text(c: Column) -> Column:
    return c.rlike(DECIMAL_PATTERN) | c.rlike(HEX_PATTERN)


def numeric_value(c: Column) -> Column:
    """Double value of a numeric text cell, null when it is not numeric.

    Hex cells of up to 15 digits convert at once; longer ones digit by digit,
    since ``conv`` fails beyond 64 bits."""
    stripped = F.regexp_replace(c, WHITESPACE_EDGES, "")
    digits = F.substring(stripped, 3, 2**31 - 1)
    long_val = F.aggregate(
        F.filter(F.split(digits, ""), lambda d: d != ""),
        F.lit(0.0),
        lambda total, d: total * 16 + F.conv(d, 16, 10).cast("double"),
    )
    hex_val = F.when(F.length(digits) <= 15, F.conv(digits, 16, 10).cast("double")).otherwise(long_val)
    return (
        F.when(c.rlike(HEX_PATTERN), hex_val)
        .when(c.rlike(DECIMAL_PATTERN), stripped.try_cast("double"))
    )


def round_ratio(num: Column, den: Column, digits: int) -> Column:
    """``num / den`` rounded half-up to ``digits`` decimals, computed exactly
    in integer arithmetic (so no engine-specific double rounding), 0 when
    ``den`` is 0.  Non-negative inputs."""
    scale = 10**digits
    x = num.cast("long") * F.lit(2 * scale) + den.cast("long")
    y = den.cast("long") * F.lit(2)
    q = F.call_function("div", x, y)
    return F.when(den.cast("long") == 0, F.lit(0.0)).otherwise(q.cast("double") / F.lit(float(scale)))


def key_hash(parts: Sequence[Column], prefix: str | None = None) -> Column:
    """``Hash128(a & '|' & b ..)``: md5 over the '|'-joined parts.  Each is its
    text after the text's length, so that no two lists of parts are the same
    text, and a null is ``-``, which is no part's text; an optional prefix (the
    fact name) keeps equal grains of two facts apart."""
    told = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", *([F.lit(prefix)] if prefix is not None else []), *told))


def hash_bytes(c: Column, nullable: bool = True) -> Column:
    """The 16 bytes of a hash in hexadecimal text.  They sort as the text does.
    Of a hash that is never null the bytes are known not to be, so that a join
    does not make it once more to look."""
    return F.unhex(c) if nullable else F.coalesce(F.unhex(c), F.lit(bytearray()))
