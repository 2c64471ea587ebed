"""The rule score, the model's flag and severity, and the blended priority."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.operators.quantiles import exact_quantiles
from ledgerlint.specs import ScoreSpec


def rule_score(df: DataFrame, spec: ScoreSpec = ScoreSpec()) -> DataFrame:
    """Weighted sum of the flags the table has, at most 1. Where the exact and the fuzzy
    duplicate test agree, the score is set to ``agreement``, even if the sum is higher."""
    parts = [F.col(c).cast("double") * F.lit(w) for c, w in spec.weights.items() if c in df.columns]
    score = reduce(lambda a, b: a + b, parts, F.lit(0.0))
    both = ["flag_duplicate_coords", "flag_fuzzy_duplicate"]
    if all(c in df.columns for c in both):
        score = F.when(F.col(both[0]) & F.col(both[1]), F.lit(spec.agreement)).otherwise(score)
    return df.withColumn("review_confidence_score", F.least(score, F.lit(1.0)))


def flag_outliers(df: DataFrame, contamination: float = 0.03, score: str = "raw_score") -> DataFrame:
    """``flag_ai_anomaly``: the score lies strictly beyond the contamination quantile."""
    threshold = exact_quantiles(df, score, {"threshold": 1 - contamination})
    return df.withColumn("flag_ai_anomaly",
                         F.coalesce(F.col(score) > threshold.scalar(), F.lit(False)))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """Scale to 0..1 over the whole table; a constant column becomes 0."""
    span = df.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("s")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    return df.withColumn(out, F.when(hi > lo, (F.col(column) - lo) / (hi - lo)).otherwise(0.0))


def blended(spec: ScoreSpec = ScoreSpec()) -> Column:
    model = F.col("ai_anomaly_score") * F.col("flag_ai_anomaly").cast("double")
    total = (F.lit(spec.rule_share) * F.col("review_confidence_score")
             + F.lit(spec.model_share) * model)
    return F.least(total, F.lit(1.0))


def blend(df: DataFrame, contamination: float = 0.03, spec: ScoreSpec = ScoreSpec()) -> DataFrame:
    """From ``raw_score`` to ``flag_ai_anomaly``, ``ai_anomaly_score`` and
    ``final_review_score``. The model counts only for the records it flags. The table is read
    several times, so pass a written one where computing it is expensive."""
    df = min_max(flag_outliers(df, contamination), "raw_score", "ai_anomaly_score")
    return df.withColumn("final_review_score", blended(spec)).drop("raw_score")


def layer_comparison(scored: DataFrame) -> DataFrame:
    """What the rules find, what fuzzy matching finds, and what only the latter finds."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    any_flag, fuzzy = F.col("any_flag"), F.col("flag_fuzzy_duplicate")
    flagged = F.col("review_confidence_score") > 0
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_flag).alias("baseline"), rate(any_flag).alias("baseline_rate"),
        F.count_if(fuzzy).alias("fuzzy"), F.count_if(fuzzy & ~any_flag).alias("new_catches"),
        F.count_if(flagged).alias("flagged"), rate(flagged).alias("flagged_rate"))


def model_summary(scored: DataFrame) -> DataFrame:
    rules = F.col("review_confidence_score") > 0
    return scored.agg(
        F.count_if("flag_ai_anomaly").alias("model_flagged"), F.count_if(rules).alias("rule_flagged"),
        F.count_if(~rules & F.col("flag_ai_anomaly")).alias("model_only"),
        F.count_if(F.col("final_review_score") > 0).alias("in_queue"))
