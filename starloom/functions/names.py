"""Name handling as native Column expressions (no Python UDF):
tokenizing column and table names, squashing, generic-suffix tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generic key words and the patterns built on them.
GENERIC_TOKENS = ["id", "key", "code", "num", "number"]
ID_LIKE_PATTERN = r"(?i)(id|key|code|num|number)"
BARE_GENERIC_PATTERN = r"(?i)^(id|key|code|num|number)$"


def squash_name(c: Column) -> Column:
    """Lowercase, whitespace and ``_`` removed (the pair-gate form)."""
    return F.regexp_replace(F.lower(c), r"[\s_]", "")


def name_tokens(c: Column) -> Column:
    """``array<string>`` tokens of a name.

    camelCase is split, ``_``/whitespace/``-`` separate, tokens are lowercased
    and singularized (``ies`` -> ``y`` when longer than 4; a final ``s``
    dropped when longer than 3 and not ``ss``); generic words
    (id/key/code/num/number) are dropped unless nothing else is left.
    """
    spaced = F.regexp_replace(c, r"([a-z])([A-Z])", "$1_$2")
    sep = F.regexp_replace(spaced, r"[_\s-]+", "_")
    toks = F.filter(F.split(F.lower(sep), "_"), lambda x: F.length(x) > 0)
    sing = F.transform(toks, lambda x: _singular_expr(x))
    generic = F.array(*[F.lit(g) for g in GENERIC_TOKENS])
    kept = F.filter(sing, lambda x: ~F.array_contains(generic, x))
    return F.when(F.size(kept) > 0, kept).otherwise(sing)


def _singular_expr(x: Column) -> Column:
    n = F.length(x)
    return (
        F.when(x.endswith("ies") & (n > 4), F.concat(F.substring(x, F.lit(1), n - 3), F.lit("y")))
        .when(x.endswith("s") & (n > 3) & ~x.endswith("ss"), F.substring(x, F.lit(1), n - 1))
        .otherwise(x)
    )


def tokens_within(a: Column, b: Column) -> Column:
    """Every token of ``a`` occurs in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def token_subset(a: Column, b: Column) -> Column:
    """Both non-empty and the shorter list is contained in the longer."""
    a_small = F.size(a) <= F.size(b)
    return (
        (F.size(a) > 0)
        & (F.size(b) > 0)
        & F.when(a_small, tokens_within(a, b)).otherwise(tokens_within(b, a))
    )


def is_bare_generic(c: Column) -> Column:
    return c.rlike(BARE_GENERIC_PATTERN)
