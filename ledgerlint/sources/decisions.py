"""The append-only log of review decisions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

LOG_SCHEMA = ("seq long, record_id string, reviewer long, reviewed_at timestamp, score double, "
              "decision string, source string")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, or no rows when it does not exist yet or holds no data."""
    try:
        return spark.read.schema(LOG_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def read_csv_log(spark: SparkSession, path: str) -> DataFrame:
    """A log exported as CSV; an empty or header-only file holds no decisions."""
    return spark.read.schema(LOG_SCHEMA).option("header", True).csv(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Append a batch of (record_id, score, decision[, reviewer, source, reviewed_at, seq]).

    ``seq`` orders decisions made at one time, so a batch of several rows must bring it; only a
    single decision gets it from the clock.
    """
    if "seq" not in decisions.columns and decisions.limit(2).count() > 1:
        raise ValueError("a batch of several decisions needs seq, the order they were made in")
    now = F.current_timestamp()
    defaults = {
        "reviewer": F.lit(None).cast("long"), "source": F.lit("reviewer"), "reviewed_at": now,
        "seq": F.unix_micros(now),
    }
    for name, value in defaults.items():
        if name not in decisions.columns:
            decisions = decisions.withColumn(name, value)
    fields = [part.split()[0] for part in LOG_SCHEMA.split(", ")]
    decisions.select(*fields).write.mode("append").parquet(path)


def latest_decisions(log: DataFrame) -> DataFrame:
    """The last decision of each record by time, ties by append order."""
    return log.groupBy("record_id").agg(
        F.max_by("decision", F.struct("reviewed_at", "seq")).alias("decision"))
