"""The review queue: who is in it, in which order, what was decided, and its figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ledgerlint.operators.joins import frequent_keys, lookup
from ledgerlint.sources.decisions import latest_decisions
from ledgerlint.specs import Fields

# The states of a record in the queue.
STATUSES = ["pending", "confirmed_real_issue", "false_positive"]


def present_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def flagged_records(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("final_review_score") > 0)


def with_decisions(df: DataFrame, log: DataFrame, f: Fields = Fields()) -> DataFrame:
    """Add ``decision``: the latest one of the log, else ``pending``."""
    latest = latest_decisions(log).withColumnRenamed("record_id", f.id)
    return df.join(latest, f.id, "left").select(
        *df.columns, F.coalesce("decision", F.lit(STATUSES[0])).alias("decision"))


def collapsed(df: DataFrame, mode: str = "pair", f: Fields = Fields()) -> DataFrame:
    """One entry per matched pair: the side whose id sorts first (``pair``), or one entry per
    group of copies: its leader (``cluster``)."""
    partner = F.col("fuzzy_partner_id")
    keep = {"pair": F.col(f.id) < partner, "cluster": F.col("fuzzy_is_leader")}[mode]
    return df.where(partner.isNull() | keep)


def review_queue(scored: DataFrame, log: DataFrame, mode: str = "pair",
                 f: Fields = Fields()) -> DataFrame:
    return collapsed(with_decisions(flagged_records(scored), log, f), mode, f)


def top_records(df: DataFrame, score: str, n: int, f: Fields = Fields()) -> DataFrame:
    return df.orderBy(F.desc(score), f.id).limit(n)


def top_pending(queue: DataFrame, n: int = 5, f: Fields = Fields()) -> DataFrame:
    return top_records(by_status(queue, STATUSES[0]), "final_review_score", n, f)


def by_status(queue: DataFrame, status: str) -> DataFrame:
    return queue.where(F.col("decision") == status)


def filtered(queue: DataFrame, min_score: float = 0.2, issue_types: list[str] = (),
             model_only: bool = False) -> DataFrame:
    """The reviewer's filters; no issue types chosen means all."""
    queue = queue.where(F.col("final_review_score") >= min_score)
    if issue_types:
        queue = queue.where(reduce(lambda a, b: a | b, [F.col(c) for c in issue_types]))
    if model_only:
        queue = queue.where((F.col("review_confidence_score") == 0)
                            & (F.col("final_review_score") > 0))
    return queue


def ranked(queue: DataFrame, f: Fields = Fields()) -> DataFrame:
    """In order of priority; the id breaks ties, which also spreads equal scores over the sort."""
    # The columns a reviewer is shown, in their order.
    shown = [f.id, f.building, f.road, f.hours, "final_review_score", "review_confidence_score",
             "ai_anomaly_score", "flag_missing_address", "flag_invalid_coords",
             "flag_duplicate_coords", "flag_fuzzy_duplicate", "flag_malformed_hours"]
    return present_columns(queue, shown).orderBy(F.desc("final_review_score"), f.id)


def status_counts(queue: DataFrame) -> DataFrame:
    """Entries per status, with a row for a status nobody has."""
    counts = queue.agg(*[F.count_if(F.col("decision") == s).alias(s) for s in STATUSES])
    return counts.unpivot([], STATUSES, "status", "n")


def queue_kpis(flagged: DataFrame, mode: str = "pair", f: Fields = Fields()) -> DataFrame:
    """Layer counts over the flagged records, and the queue left after collapsing pairs."""
    partner = F.col("fuzzy_partner_id")
    keep = {"pair": F.col(f.id) < partner, "cluster": F.col("fuzzy_is_leader")}[mode]
    rules = F.col("review_confidence_score") > 0
    counts = flagged.agg(
        F.count_if("any_flag").alias("baseline"), F.count_if(rules).alias("rules"),
        F.count_if((F.col("review_confidence_score") == 0)
                   & (F.col("final_review_score") > 0)).alias("model_only"),
        F.count_if(partner.isNull() | keep).alias("queue_size"),
        F.count(F.lit(1)).alias("flagged"))
    return counts.withColumn("queue_share", F.when(
        F.col("flagged") > 0, F.round(F.col("queue_size") / F.col("flagged"), 6)))


def partner_records(flagged: DataFrame, wanted: list[str], f: Fields = Fields(),
                    hot_rows: int = 1_000_000) -> DataFrame:
    """Flagged records whose partner is flagged too, with the partner's ``wanted`` columns as
    ``matched_*``. A leader with very many claimed records is a hot key of this join."""
    first = flagged.groupBy(F.col(f.id).alias("fuzzy_partner_id")).agg(F.min_by(
        F.struct(*[F.col(c) for c in wanted]), f.pos).alias("_m"))
    right = first.select("fuzzy_partner_id", F.lit(True).alias("_found"),
                         *[F.col(f"_m.{c}").alias(f"matched_{c}") for c in wanted])
    left = flagged.where(F.col("fuzzy_partner_id").isNotNull())
    hot = frequent_keys(left, ["fuzzy_partner_id"], hot_rows)
    found = lookup(left, right, ["fuzzy_partner_id"], hot, f.pos)
    return found.where("_found").drop("_found")


def partner_comparison(flagged: DataFrame, f: Fields = Fields(), hot_rows: int = 1_000_000) -> DataFrame:
    """One row per compared field: this record's value next to the matched record's."""
    # The fields compared, in their order.
    fields = [f.id, f.building, f.road, f.floor, f.descr, f.hours]
    pairs = partner_records(flagged, fields, f, hot_rows)
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("field"), F.col(name).cast("string").alias("this_record"),
        F.col(f"matched_{name}").cast("string").alias("matched_record")) for name in fields]))
    return pairs.select(F.col(f.id).alias("id"), rows.alias("r")).select("id", "r.*")


def propagated_decisions(decisions: DataFrame, flagged: DataFrame, log: DataFrame | None = None,
                         f: Fields = Fields()) -> DataFrame:
    """Log rows that carry a batch of decisions over to the matched partners.

    A partner gets the decision of the first record that names it as partner, unless it was
    decided itself before that, in ``log`` or earlier in the batch. That is what applying the
    batch one decision after the other gives: a record's later decisions find its partner
    decided.
    """
    when = F.struct("reviewed_at", "seq")
    firsts = decisions.groupBy("record_id").agg(
        F.min(when).alias("at"), F.min_by("decision", when).alias("decision"),
        F.min_by("reviewer", when).alias("reviewer"))
    named = (flagged.where(F.col("fuzzy_partner_id").isNotNull())
             .select(F.col(f.id).alias("record_id"), F.col("fuzzy_partner_id").alias("partner")))
    sources = (named.join(firsts, "record_id").groupBy("partner")
               .agg(F.min("at").alias("at"), F.min_by("decision", "at").alias("decision"),
                    F.min_by("reviewer", "at").alias("reviewer")))
    order = f.pos if f.pos in flagged.columns else "final_review_score"
    targets = flagged.groupBy(F.col(f.id).alias("partner")).agg(
        F.min_by("final_review_score", order).alias("score"))  # of the first record with the id
    own = firsts.select(F.col("record_id").alias("partner"), F.col("at").alias("own_at"))
    carried = (sources.join(targets, "partner").join(own, "partner", "left")
               .where(F.col("own_at").isNull() | (F.col("at") < F.col("own_at"))))
    if log is not None:
        decided = log.select(F.col("record_id").alias("partner")).distinct()
        carried = carried.join(decided, "partner", "left_anti")
    return carried.select(F.col("at.seq").alias("seq"), F.col("partner").alias("record_id"), "reviewer",
                          F.col("at.reviewed_at").alias("reviewed_at"), "score", "decision",
                          F.lit("propagated").alias("source"))


def record_json(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    """Each record as a JSON document of its filled fields, without its decision."""
    shown = [c for c in df.columns if c != "decision"]
    return df.select(F.col(f.id).alias("id"), F.to_json(F.struct(*shown)).alias("document"))


def map_points(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    return df.select(F.col(f.lat).alias("lat"), F.col(f.lon).alias("lon")).na.drop()
