"""Why a record is in the queue, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.functions.text import capitalised
from ledgerlint.operators.rules import malformed_hours
from ledgerlint.specs import MISSING_TEXT, Fields

# The texts shown to a reviewer.
REASON_ADDRESS = "Missing road name or postal code"
REASON_COORDS = "Coordinates fall outside Singapore's bounds"
REASON_DUPLICATE = "Same coordinates AND same location description as another record"
REASON_FUZZY = "Very similar address text to another record (same building/floor)"
REASON_HOURS = "Operating hours text doesn't look like a valid time range"
REASON_MODEL = "AI flagged this as statistically unusual — "
REASON_MODEL_PLAIN = ("Flagged by the AI model as statistically unusual — no single feature stood "
                      "out clearly, but the overall combination is unusual")
REASON_NONE = "No specific flag triggered — check manually."
LABEL_BUILDING = "building name text length"
LABEL_DESCR = "location description text length"
LABEL_NO_BUILDING = "missing building name entirely"
LABEL_NO_ROAD = "missing road name entirely"
LABEL_NO_HOURS = "missing operating hours entirely"
UNUSUAL = "{label} is unusually {direction} compared to other registry entries ({value} characters)"
STANDS_OUT = "{label} — this stands out compared to other registry entries"
MISSING_WEIGHT = 3.0
LEAST_DEVIATION = 1.0


def filled(template: str, **values: Column) -> Column:
    """A fixed text with its placeholders replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def with_explanation(df: DataFrame, f: Fields = Fields(), population: DataFrame | None = None) -> DataFrame:
    """Add ``ai_explanation``: the feature deviating most from the population, NULL when none
    deviates by a standard deviation. The population defaults to the table itself."""
    population = df if population is None else population
    size = lambda name: F.length(F.coalesce(F.col(name), F.lit("")))
    stats = population.agg(F.struct(
        *[fn(size(name)).alias(f"{kind}_{part}") for part, name in (("b", f.building), ("d", f.descr))
          for kind, fn in (("avg", F.avg), ("std", F.stddev_samp))]).alias("s")).scalar()

    def candidate(rank: int, label: str, z: Column, value: Column) -> Column:
        return F.struct(F.abs(z).alias("size"), F.lit(-rank).alias("rank"), F.lit(label).alias("label"),
                        z.alias("z"), value.cast("int").alias("value"))

    def by_length(rank: int, label: str, part: str, name: str) -> Column:
        # a missing text counts as its three letters here, but as empty in the population
        length = F.length(F.coalesce(F.col(name), F.lit(MISSING_TEXT)))
        std = stats.getField(f"std_{part}")
        z = (length - stats.getField(f"avg_{part}")) / std
        return F.when(std > 0, candidate(rank, label, z, length))

    def by_absence(rank: int, label: str, name: str) -> Column:
        return F.when(F.col(name).isNull(),
                      candidate(rank, label, F.lit(MISSING_WEIGHT), F.lit(None)))

    top = F.array_max(F.array_compact(F.array(
        by_length(0, LABEL_BUILDING, "b", f.building), by_length(1, LABEL_DESCR, "d", f.descr),
        by_absence(2, LABEL_NO_BUILDING, f.building), by_absence(3, LABEL_NO_ROAD, f.road),
        by_absence(4, LABEL_NO_HOURS, f.hours))))
    df = df.withColumn("_top", top)
    label = capitalised(F.col("_top.label"))
    direction = F.when(F.col("_top.z") > 0, "long").otherwise("short")
    text = F.when(F.col("_top.value").isNull(), filled(STANDS_OUT, label=label)).otherwise(
        filled(UNUSUAL, direction=direction, value=F.col("_top.value").cast("string"), label=label))
    return df.withColumn(
        "ai_explanation", F.when(F.col("_top.size") >= LEAST_DEVIATION, text)).drop("_top")


def with_reasons(df: DataFrame, f: Fields = Fields(), population: DataFrame | None = None) -> DataFrame:
    """Add ``reasons``, an array of texts, never empty."""
    explained = with_explanation(df, f, population)
    model_only = (F.col("review_confidence_score") == 0) & (F.col("ai_anomaly_score") > 0)
    model = F.coalesce(F.concat(F.lit(REASON_MODEL), "ai_explanation"), F.lit(REASON_MODEL_PLAIN))
    reasons = F.array_compact(F.array(
        F.when(F.col("flag_missing_address"), REASON_ADDRESS),
        F.when(F.col("flag_invalid_coords"), REASON_COORDS),
        F.when(F.col("flag_duplicate_coords"), REASON_DUPLICATE),
        F.when(F.col("flag_fuzzy_duplicate"), REASON_FUZZY),
        F.when(F.col("flag_malformed_hours") | malformed_hours(f), REASON_HOURS),
        F.when(model_only, model)))
    explained = explained.withColumn("reasons", reasons)
    return explained.withColumn("reasons", F.when(
        F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(REASON_NONE))))
