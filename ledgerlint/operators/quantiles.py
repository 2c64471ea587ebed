"""Exact quantiles with linear interpolation, without gathering the values in one task."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window, functions as F

from ledgerlint.sources.tables import materialise


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float],
                    partitions: int | None = None) -> DataFrame:
    """One row with a column per entry of ``probabilities``.

    Equal values are counted first. The distinct values are laid out in ranges of about equal
    size and written, so that the ranges stay the same for all later reads. Summing the counts
    per range tells which range holds a wanted rank; only there are values ranked one by one.
    """
    ranges = ["v"] if partitions is None else [partitions, "v"]
    counts = (df.select(F.col(value).cast("double").alias("v"))
              .where(F.col("v").isNotNull() & ~F.isnan("v"))
              .groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    ranged = materialise(counts.repartitionByRange(*ranges)
                         .withColumn("part", F.spark_partition_id()), "quantiles")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.sum("n").alias("rows"))
    offsets = parts.select("part", "rows",
                           F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    total = ranged.agg(F.sum("n")).scalar()

    def ranks(p: float):
        exact = F.lit(p) * (total - 1)
        low = F.floor(exact + F.lit(1e-9)).cast("long")
        return exact, low, F.least(low + 1, total - 1)

    def holds(rank, first, size):
        return (first <= rank) & (rank < first + size)

    wanted = F.lit(False)
    for p in probabilities.values():
        _, low, high = ranks(p)
        wanted = wanted | holds(low, F.col("offset"), F.col("rows"))
        wanted = wanted | holds(high, F.col("offset"), F.col("rows"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (ranged.join(F.broadcast(offsets.where(wanted)), "part")
              .withColumn("first", F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))))

    columns = []
    for name, p in probabilities.items():
        exact, low, high = ranks(p)
        at = lambda rank: F.max(F.when(holds(rank, F.col("first"), F.col("n")), F.col("v")))
        share = F.greatest(exact - low, F.lit(0.0))
        columns.append((at(low) + (at(high) - at(low)) * F.max(share)).alias(name))
    return ranked.agg(*columns)
