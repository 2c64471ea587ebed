"""The whole batch: validate, match, score, find outliers, blend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlint.operators.forest import fit_forest, with_outlier_score
from ledgerlint.operators.matching import find_duplicates
from ledgerlint.operators.queue import flagged_records, review_queue
from ledgerlint.operators.rules import flag_records
from ledgerlint.operators.scoring import blend, rule_score
from ledgerlint.sources.decisions import read_log
from ledgerlint.sources.tables import materialise, stage_tables
from ledgerlint.specs import BoundingBox, Fields, ForestSpec, MatchSpec, ScoreSpec


def triage(registry: DataFrame, f: Fields = Fields(), box: BoundingBox = BoundingBox(),
           match: MatchSpec = MatchSpec(), score: ScoreSpec = ScoreSpec(),
           forest: ForestSpec = ForestSpec()) -> DataFrame:
    """From a clean registry table to ``final_review_score`` for every record."""
    matched = find_duplicates(registry, f, match)
    scored = rule_score(flag_records(matched, f, box, base=registry), score)
    model = fit_forest(registry, f, forest)
    scored = materialise(with_outlier_score(scored, model, f), "scored")
    return blend(scored, forest.contamination, score)


def run_batch(registry: DataFrame, path: str, **spec) -> None:
    """Score a registry and store the records that enter the queue at ``path``; the run's stage tables end with it."""
    with stage_tables(registry.sparkSession):
        flagged_records(triage(registry, **spec)).write.mode("overwrite").parquet(path)


def stored_queue(spark: SparkSession, path: str, log: str, mode: str = "pair", f: Fields = Fields()) -> DataFrame:
    """The queue after each decision: the stored records joined with the log at ``log``, nothing computed anew."""
    return review_queue(spark.read.parquet(path), read_log(spark, log), mode, f)
