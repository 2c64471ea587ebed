"""The latest decision per record, kept up to date from the decision log as a stream.

Below ``out`` lie ``batches``, the records each micro-batch touched; ``snapshots``, the latest decision of every
record up to a batch; and ``marks``, the batches whose snapshot is complete. A reader takes the newest marked snapshot
and the batches after it, so what it reads does not grow with the stream's age. A batch that runs again replaces its
own folder and snapshot, and a snapshot counts only once its mark is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlint.sources.decisions import latest_decisions

CHANGE_SCHEMA = "record_id string, reviewed_at timestamp, seq long, decision string"


def decision_changes(log: DataFrame) -> DataFrame:
    """The latest decision of each record, for update mode: one small state per record and no
    watermark, so a late decision is weighed by its time, never dropped."""
    log = log.selectExpr("record_id", "cast(reviewed_at AS timestamp) AS reviewed_at", "seq", "decision")
    latest = F.max_by("decision", F.struct("reviewed_at", "seq")).alias("decision")
    order = F.max(F.struct("reviewed_at", "seq")).alias("at")
    return log.groupBy("record_id").agg(order, latest).select(
        "record_id", "at.reviewed_at", "at.seq", "decision")


def write_changes(changes: DataFrame, out: str, checkpoint: str, compact_every: int = 20) -> StreamingQuery:
    """Write the records each micro-batch touched and, every ``compact_every`` batches, a snapshot."""
    spark = changes.sparkSession
    spark.createDataFrame([], CHANGE_SCHEMA).write.mode("ignore").parquet(f"{out}/batches/batch=-1")
    spark.createDataFrame([(-1,)], "upto long").write.mode("ignore").parquet(f"{out}/marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batches/batch={number}")
        if (number + 1) % compact_every == 0:
            compact(batch.sparkSession, out, number)

    return (changes.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Write the snapshot of all batches up to ``upto``, from the one before and what came since, and mark it."""
    changes_since(spark, out, upto).groupBy("record_id").agg(
        F.max_by(F.struct("reviewed_at", "seq", "decision"), F.struct("reviewed_at", "seq")).alias("last")).select(
        "record_id", "last.*").write.mode("overwrite").parquet(f"{out}/snapshots/upto={upto}")
    spark.createDataFrame([(upto,)], "upto long").write.mode("append").parquet(f"{out}/marks")


def changes_since(spark: SparkSession, out: str, upto: int | None = None) -> DataFrame:
    """The newest marked snapshot before batch ``upto`` and the changes after it, up to that batch or all."""
    wanted = F.lit(True) if upto is None else F.col("upto") < upto
    mark = spark.read.schema("upto long").parquet(f"{out}/marks").where(wanted).agg(F.max("upto")).first()[0]
    after = F.col("batch") > mark if upto is None else F.col("batch").between(mark + 1, upto)
    columns = [c.split()[0] for c in CHANGE_SCHEMA.split(", ")]
    changes = spark.read.schema(CHANGE_SCHEMA + ", batch long").parquet(f"{out}/batches").where(after).select(*columns)
    if mark < 0:
        return changes
    return changes.unionByName(spark.read.schema(CHANGE_SCHEMA).parquet(f"{out}/snapshots/upto={mark}"))


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    return latest_decisions(changes_since(spark, out))
