"""How long reviewers take: gaps between consecutive decisions and their distribution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlint.operators.quantiles import exact_quantiles
from ledgerlint.sources.tables import materialise


def in_ranges(df: DataFrame, order: list[str], ranges: int | None = None) -> DataFrame:
    """A written copy of ``df`` with ``_range``, its number in the order of ``order``: the ranges are cut from the
    rows themselves to about equal sizes, whatever the values. ``ranges`` defaults to the shuffle partitions."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def review_gaps(log: DataFrame, partition_by: list[str] | None = None, ranges: int | None = None,
                exclude_propagated: bool = False) -> DataFrame:
    """Add ``gap_seconds`` to the previous decision (of the same ``partition_by``).

    Rows are ordered by (partition_by, reviewed_at, seq) and cut into ranges, so neither one busy reviewer, nor one
    busy hour, nor the global order ends up in a single task. Inside a range the previous row is the one before;
    the first row of a range is handed the last one of the ranges before it, from a table of one row a range.
    """
    if exclude_propagated:
        log = log.where(F.col("source") != "propagated")
    by = partition_by or []
    order = [*by, "reviewed_at", "seq"]
    ranged = in_ranges(log, order, ranges)
    inside = Window.partitionBy("_range").orderBy(*order)
    row = F.struct(*[F.col(c) for c in [*by, "reviewed_at"]])
    lasts = ranged.groupBy("_range").agg(F.max_by(row, F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])).alias("_last"))
    across = Window.orderBy("_range")  # one row a range
    lasts = lasts.select("_range", F.lag("_last").over(across).alias("_before"))
    placed = ranged.withColumn("_own", F.lag(row).over(inside)).join(F.broadcast(lasts), "_range")
    previous = F.coalesce("_own", "_before")
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(previous.getField(k)) for k in by], F.lit(True))
    gap = F.when(same, _seconds(previous.getField("reviewed_at"), F.col("reviewed_at")))
    return placed.select(*[F.col(f"`{c}`") for c in log.columns], gap.alias("gap_seconds"))


def _seconds(start: Column, end: Column) -> Column:
    return (F.timestamp_diff("MICROSECOND", start, end)
            / F.lit(1e6))


def effort_metrics(log: DataFrame, partition_by: list[str] | None = None, ranges: int | None = None,
                   exclude_propagated: bool = False) -> DataFrame:
    """Decisions, gaps, mean, median, p90 and p95 seconds; no figures for fewer than two rows."""
    gaps = review_gaps(log, partition_by, ranges, exclude_propagated).select("gap_seconds")
    gaps = materialise(gaps, "gaps")
    base = gaps.agg(F.count(F.lit(1)).alias("n_decisions"), F.count("gap_seconds").alias("n_gaps"),
                    F.avg("gap_seconds").alias("mean_seconds"))
    marks = exact_quantiles(gaps, "gap_seconds", {"p50": 0.5, "p90": 0.9, "p95": 0.95})
    enough = F.col("n_decisions") >= 2
    quantile = marks.select(F.struct("*")).scalar()
    return base.select(
        "n_decisions", "n_gaps",
        F.when(enough, F.round("mean_seconds", 6)).alias("mean_seconds"),
        *[F.when(enough, F.round(quantile.getField(p), 6)).alias(f"{name}_seconds")
          for p, name in [("p50", "median"), ("p90", "p90"), ("p95", "p95")]])
