"""Confusion matrices and the measures derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.operators.matching import find_duplicates
from ledgerlint.operators.rules import flag_records
from ledgerlint.operators.scoring import rule_score
from ledgerlint.sources.tables import materialise
from ledgerlint.specs import Fields, MatchSpec


def confusion(df: DataFrame, actual: Column, predicted: Column, by: list[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(
        F.count_if(actual & predicted).alias("tp"), F.count_if(actual & ~predicted).alias("fn"),
        F.count_if(~actual & predicted).alias("fp"), F.count_if(~actual & ~predicted).alias("tn"))
    return counts


def measures(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and false-positive rate; 0 where nothing can be measured."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    out = counts.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn),
                              "false_positive_rate": share(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", share(2 * p * r, p + r))
    rates = ["precision", "recall", "f1", "false_positive_rate"]
    return out.withColumns({c: F.round(c, 6) for c in rates})


def detect(test_set: DataFrame, f: Fields = Fields(), spec: MatchSpec = MatchSpec()) -> DataFrame:
    """The detection layers over a labelled table."""
    test_set = materialise(test_set, "test-set")
    return rule_score(flag_records(find_duplicates(test_set, f, spec), f, base=test_set))


def evaluate(detected: DataFrame) -> DataFrame:
    """Measures over the labelled rows: a row is flagged when its rule score is positive."""
    labelled = detected.where(F.col("label").isin("seeded", "clean"))
    return measures(confusion(labelled, F.col("label") == "seeded",
                              F.col("review_confidence_score") > 0))


def evaluate_by_layer(detected: DataFrame) -> DataFrame:
    """The same measures for the rules alone, fuzzy matching alone and both together."""
    labelled = detected.where(F.col("label").isin("seeded", "clean"))
    layers = F.array(
        F.struct(F.lit("rules").alias("layer"), F.col("any_flag").alias("flagged")),
        F.struct(F.lit("fuzzy").alias("layer"), F.col("flag_fuzzy_duplicate").alias("flagged")),
        F.struct(F.lit("combined").alias("layer"),
                 (F.col("review_confidence_score") > 0).alias("flagged")))
    rows = labelled.select("label", F.explode(layers).alias("l")).select("label", "l.*")
    return measures(confusion(rows, F.col("label") == "seeded", F.col("flagged"), ["layer"]))
