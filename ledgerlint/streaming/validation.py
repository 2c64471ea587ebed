"""Rules on arriving records: those of one record, and whether a stored record has the same place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlint.operators.joins import hot_only, lookup
from ledgerlint.operators.rules import apply_rules, local_rules
from ledgerlint.sources.tables import materialise
from ledgerlint.specs import BoundingBox, Fields


def validate_stream(records: DataFrame, f: Fields = Fields(), box: BoundingBox = BoundingBox()) -> DataFrame:
    """The flags that need no other record; duplicates need the history and stay in the batch."""
    return apply_rules(records, local_rules(f, box))


def place_counts(stored: DataFrame, f: Fields = Fields()) -> DataFrame:
    """How many stored records share each (coordinates, description), written; to be kept beside the records."""
    return materialise(stored.groupBy(f.lat, f.lon, f.descr).agg(F.count(F.lit(1)).alias("n_stored")), "place-counts")


def flag_stored_places(records: DataFrame, counts: DataFrame, f: Fields = Fields(), hot_rows: int = 1_000_000) -> DataFrame:
    """Add ``flag_stored_place``: a stored record has the same coordinates and description; NULL equals NULL. The
    records may be a stream, the counts are a written table. Arriving records of a place that very many stored ones
    have are not gathered in one task."""
    keys = [f.lat, f.lon, f.descr]
    found = lookup(records, counts, keys, hot_only(counts, "n_stored", hot_rows).select(*keys), f.pos)
    return found.withColumn("flag_stored_place", F.col("n_stored").isNotNull()).drop("n_stored")


def write_validated(validated: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (validated.writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
