"""Joins to a table that is unique on its keys, safe against keys holding most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MOST_HOT = 10_000


def lookup(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame,
           spread: str) -> DataFrame:
    """Left join ``right`` (unique on ``keys``; NULL equals NULL) to ``left``.

    ``hot`` holds the keys with so many left rows that one task must not get them all, at most
    ``MOST_HOT`` of them (see :func:`hot_only`): their right rows are broadcast. In the shuffled
    join the left rows of hot keys are scattered by the column ``spread`` instead of gathering
    in one partition. With no hot keys the broadcast side is empty and adaptive execution
    removes it.
    """
    payload = [c for c in right.columns if c not in keys]
    few = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    small = few.join(right, _same(right, few, keys, "_h_"), "left").select(
        *few.columns, *[F.col(c).alias(f"_hot_{c}") for c in payload], F.lit(True).alias("_is_hot"))
    marked = left.join(F.broadcast(small), _same(left, small, keys, "_h_"), "left")
    is_hot = F.col("_is_hot").isNotNull()
    marked = marked.withColumn(
        "_scatter", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(1 << 20)) + 1)
        .otherwise(F.lit(0).cast("long")))
    cold = right.select(*[F.col(k).alias(f"_c_{k}") for k in keys],
                        *[F.col(c).alias(f"_cold_{c}") for c in payload],
                        F.lit(0).cast("long").alias("_cold"))
    joined = marked.join(
        cold, _same(marked, cold, keys, "_c_") & (F.col("_scatter") == F.col("_cold")), "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.when(is_hot, F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c)
          for c in payload])


def _same(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    condition = F.lit(True)
    for i, k in enumerate(keys):
        test = left[k].eqNullSafe(right[f"{prefix}{k}"])
        condition = test if i == 0 else condition & test
    return condition


def hot_only(counts: DataFrame, count: str, hot_rows: int, total: int | None = None) -> DataFrame:
    """The rows of a table of key counts whose keys are hot: at least ``hot_rows`` rows and at
    least one in ``MOST_HOT`` of all. So there are never more than ``MOST_HOT`` of them, however
    large the table; a smaller key is no larger than what one of many tasks reads anyway."""
    if total is not None:
        return counts.where(F.col(count) >= max(hot_rows, total // MOST_HOT))
    everything = counts.agg(F.sum(count)).scalar()
    return counts.where((F.col(count) >= hot_rows) & (F.col(count) * MOST_HOT >= everything))


def frequent_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """The hot keys of a table, counted with map-side partial counts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return hot_only(counts, "_n", hot_rows).select(*keys)
