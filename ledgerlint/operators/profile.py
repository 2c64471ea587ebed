"""Profiles of a table, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlint.specs import REGISTRY_FILE_FIELDS


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_listing(df: DataFrame) -> DataFrame:
    """Name, type and position of each column; schema metadata, independent of the rows."""
    rows = [(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, name string, type string")


def schema_conformance(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Each expected field and whether the table has it."""
    expected = [n for n, _ in REGISTRY_FILE_FIELDS] if expected is None else expected
    rows = [(name, name in df.columns) for name in expected]
    return df.sparkSession.createDataFrame(rows, "name string, present boolean")


def missing_per_column(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many; one pass over the table."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return (counts.unpivot([], df.columns, "column_name", "n_missing")
            .where(F.col("n_missing") > 0))


def first_distinct(df: DataFrame, column: str, order: str, n: int = 15) -> DataFrame:
    """The first ``n`` distinct non-missing values in order of appearance."""
    seen = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
            .agg(F.min(order).alias("first_pos")))
    return seen.orderBy("first_pos").limit(n)


def shared_key_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of rows whose keys occur more than once, from partial counts alone."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > 1).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"))


def head(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    return df.orderBy(order).limit(n)
