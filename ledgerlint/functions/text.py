"""Text expressions with Unicode-aware white space, built on Column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode white space (``trim`` only knows blanks)."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def normalised(c: Column) -> Column:
    """Lower-cased, stripped text; missing text becomes empty."""
    return F.lower(strip(text_or_empty(c)))


def is_blank(c: Column) -> Column:
    """True for NULL and for text of white space only."""
    return strip(text_or_empty(c)) == ""


def sentinels_to_null(c: Column, sentinels: list[str]) -> Column:
    return F.when(c.isin(sentinels), F.lit(None)).otherwise(c)


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def swap_middle(c: Column) -> Column:
    """Swap the two characters at the middle (0-based ``length // 2`` and the next one)."""
    i = F.floor(F.length(c) / 2).cast("int")
    return F.concat(
        F.substr(c, F.lit(1), i),
        F.substr(c, i + 2, F.lit(1)),
        F.substr(c, i + 1, F.lit(1)),
        F.substr(c, i + 3),
    )
