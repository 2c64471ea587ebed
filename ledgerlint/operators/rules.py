"""Validation rules as Column expressions, and the flags they put on a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.functions.text import is_blank, normalised
from ledgerlint.operators.joins import hot_only, lookup
from ledgerlint.specs import BoundingBox, Fields

# What counts as a time of day in opening hours, and the phrases accepted as such.
HOURS_PATTERN = r"(?iU)\d{1,2}[:.]?\d{0,2}[\s\x1c-\x1f]*(am|pm|hrs|hours|-|to)"
HOURS_PHRASES = ["24 hours", "24hrs", "24/7"]

RULE_FLAGS = ["flag_missing_address", "flag_invalid_coords", "flag_duplicate_coords",
              "flag_malformed_hours"]


@dataclass(frozen=True)
class Rule:
    """A named row-local predicate, never NULL: true where a record looks wrong."""

    name: str
    test: Callable[[], Column]


def missing_address(f: Fields = Fields()) -> Column:
    return F.col(f.road).isNull() | F.col(f.postal).isNull()


def invalid_coordinates(f: Fields = Fields(), box: BoundingBox = BoundingBox()) -> Column:
    """True outside the box (bounds belong to it), for missing values and for NaN."""
    lat, lon = F.col(f.lat), F.col(f.lon)
    inside = lat.between(box.lat_min, box.lat_max) & lon.between(box.lon_min, box.lon_max)
    return F.coalesce(~inside, F.lit(True))


def malformed_hours(f: Fields = Fields()) -> Column:
    text = F.col(f.hours).cast("string")
    known = text.rlike(HOURS_PATTERN) | normalised(text).isin(HOURS_PHRASES)
    return is_blank(text) | ~F.coalesce(known, F.lit(False))


def local_rules(f: Fields = Fields(), box: BoundingBox = BoundingBox()) -> list[Rule]:
    return [
        Rule("flag_missing_address", lambda: missing_address(f)),
        Rule("flag_invalid_coords", lambda: invalid_coordinates(f, box)),
        Rule("flag_malformed_hours", lambda: malformed_hours(f)),
    ]


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumns({r.name: r.test() for r in rules})


def duplicated(df: DataFrame, keys: list[str], flag: str, spread: str,
               hot_rows: int = 1_000_000, base: DataFrame | None = None) -> DataFrame:
    """Flag every row whose ``keys`` occur more than once; NULL equals NULL, NaN equals NaN.

    Counted before anything is joined, so a key of many rows never meets in one task. ``base``
    is the table ``df`` was made from, row by row: counting there saves computing ``df`` twice.
    """
    counts = ((df if base is None else base).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
              .where(F.col("_copies") > 1))
    hot = hot_only(counts, "_copies", hot_rows)
    found = lookup(df, counts, keys, hot, spread)
    return found.withColumn(flag, F.col("_copies").isNotNull()).drop("_copies")


def flag_records(df: DataFrame, f: Fields = Fields(), box: BoundingBox = BoundingBox(),
                 extra: list[Rule] = (), hot_rows: int = 1_000_000,
                 base: DataFrame | None = None) -> DataFrame:
    """All rules plus ``any_flag``. ``extra`` rules join in ``any_flag``; ``base`` as above."""
    flagged = apply_rules(df, [*local_rules(f, box), *extra])
    flagged = duplicated(flagged, [f.lat, f.lon, f.descr], "flag_duplicate_coords", f.pos, hot_rows,
                         df if base is None else base)
    flags = [*RULE_FLAGS, *[r.name for r in extra]]
    any_flag = reduce(lambda a, b: a | b, [F.col(c) for c in flags])
    return flagged.select(*df.columns, *flags, any_flag.alias("any_flag"))


def rule_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(c)).alias(c) for c in RULE_FLAGS],
        F.count_if(F.col("any_flag")).alias("any_flag"),
        F.round(F.avg(F.col("any_flag").cast("double")), 6).alias("any_rate"),
        F.round(F.lit(100) * F.avg(F.col("any_flag").cast("double")), 1).alias("any_percent"))
