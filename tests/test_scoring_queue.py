import random

from pyspark.sql import functions as F

from ledgerlint.operators import explain, queue, scoring
from ledgerlint.operators.rules import flag_records

FLAGS = ["flag_invalid_coords", "flag_missing_address", "flag_duplicate_coords", "flag_fuzzy_duplicate",
         "flag_malformed_hours"]


def test_rule_score(spark):
    cases = {"all": ([True] * 5, 0.9), "agree": ([False, False, True, True, False], 0.9),
             "hours": ([False, False, False, False, True], 0.15),
             "lowered": ([True, True, True, True, False], 0.9), "none": ([False] * 5, 0.0),
             "no fuzzy": ([True, True, True, False, True], 0.95)}
    df = spark.createDataFrame([(k, *f) for k, (f, _) in cases.items()],
                               "id string, " + ", ".join(f"{c} boolean" for c in FLAGS))
    got = {r["id"]: round(r["review_confidence_score"], 9) for r in scoring.rule_score(df).collect()}
    assert got == {k: s for k, (_, s) in cases.items()}
    partial = scoring.rule_score(df.select("id", "flag_malformed_hours")).collect()
    assert {r["review_confidence_score"] for r in partial} == {0.0, 0.15}


def test_blend(spark):
    df = spark.range(101).selectExpr("id AS pos", "0.0D AS review_confidence_score", "id / 100 AS raw_score")
    out = {r["pos"]: r for r in scoring.blend(df, contamination=0.03).collect()}
    # quantile 0.97 of 0..1 in steps of 0.01 is 0.97 itself: strictly beyond are three rows
    assert [i for i, r in out.items() if r["flag_ai_anomaly"]] == [98, 99, 100]
    assert out[100]["final_review_score"] == 0.3 and out[97]["final_review_score"] == 0.0
    flat = scoring.min_max(spark.range(3).selectExpr("1.5D AS x"), "x", "y")
    assert {r["y"] for r in flat.collect()} == {0.0}


def test_layer_identities(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, rng.random() < 0.4, rng.random() < 0.1) for _ in range(300)]
    df = spark.createDataFrame(rows, "any_flag boolean, flag_fuzzy_duplicate boolean, flag_ai_anomaly boolean")
    df = df.withColumns({
        "review_confidence_score": F.when(F.col("any_flag") | F.col("flag_fuzzy_duplicate"), 0.4).otherwise(0.0),
        "ai_anomaly_score": F.lit(0.5)})
    df = df.withColumn("final_review_score", scoring.blended())
    layers = scoring.layer_comparison(df).first()
    assert layers["flagged"] == layers["baseline"] + layers["new_catches"]
    model = scoring.model_summary(df).first()
    assert model["in_queue"] == model["rule_flagged"] + model["model_only"]


LOG = "seq long, record_id string, reviewer long, reviewed_at timestamp, score double, decision string"


def log_of(spark, entries):
    rows = [(i, r, 1, None, 0.5, d) for i, (r, d) in enumerate(entries)]
    return spark.createDataFrame(rows, LOG).withColumn("reviewed_at", F.timestamp_seconds(F.col("seq") + 1000))


def test_status_counts_has_all_statuses(spark):
    df = spark.createDataFrame([("pending",), ("pending",)], "decision string")
    assert {tuple(r) for r in queue.status_counts(df).collect()} == {
        ("pending", 2), ("confirmed_real_issue", 0), ("false_positive", 0)}


def test_propagation_equals_replaying_the_log(spark):
    """Deciding one after the other, each decision also going to a partner nobody decided yet."""
    rng = random.Random(4)
    for trial in range(3):
        partners = {f"R{i}": rng.choice([None, f"R{rng.randrange(12)}"]) for i in range(10)}
        entries = [(f"R{rng.randrange(12)}", rng.choice(["confirmed_real_issue", "false_positive"]))
                   for _ in range(12)]
        expected, decided = [], set()
        for seq, (rec, decision) in enumerate(entries):
            decided.add(rec)
            partner = partners.get(rec)
            if partner in partners and partner not in decided:
                expected.append((partner, decision, seq))
                decided.add(partner)
        flagged = spark.createDataFrame([(k, v, 0.5) for k, v in partners.items()],
                                        "record_id string, fuzzy_partner_id string, final_review_score double")
        got = queue.propagated_decisions(log_of(spark, entries), flagged).collect()
        assert sorted((r["record_id"], r["decision"], r["seq"]) for r in got) == sorted(expected)
        earlier = log_of(spark, [(f"R{i}", "false_positive") for i in range(12)])
        assert queue.propagated_decisions(log_of(spark, entries), flagged, earlier).isEmpty()


def test_partner_comparison_same_with_hot_leader(spark, registry):
    df = registry([{}] * 30).withColumn("fuzzy_partner_id", F.when(F.col("pos") > 0, F.lit("R000")))
    plain = {tuple(r) for r in queue.partner_comparison(df).collect()}
    hot = {tuple(r) for r in queue.partner_comparison(df, hot_rows=5).collect()}
    assert plain == hot and len(plain) == 29 * 6


def test_filters(spark):
    df = spark.createDataFrame([("a", 0.1, 0.1, True), ("b", 0.2, 0.0, False), ("c", 0.9, 0.9, True)],
                               "record_id string, final_review_score double, review_confidence_score double, "
                               "flag_malformed_hours boolean")
    ids = lambda d: [r["record_id"] for r in d.orderBy("record_id").collect()]
    assert ids(queue.filtered(df)) == ["b", "c"]
    assert ids(queue.filtered(df, 0.0, ["flag_malformed_hours"])) == ["a", "c"]
    assert ids(queue.filtered(df, 0.0, model_only=True)) == ["b"]
    assert queue.ranked(df).first()["record_id"] == "c"


def test_record_json_leaves_out_nulls_and_decision(registry):
    df = registry([{"building_name": None}]).withColumn("decision", F.lit("pending"))
    document = queue.record_json(df).first()["document"]
    assert "building_name" not in document and "decision" not in document and '"pos":0' in document


def test_explanations_and_reasons(registry):
    rows = [dict(building_name="x" * 5) for _ in range(20)] + [
        dict(building_name="y" * 50), dict(building_name=None), dict(operating_hours=None)]
    df = flag_records(registry(rows).withColumn("location_description", F.lit("Same")))
    df = df.withColumns({"review_confidence_score": F.lit(0.0), "ai_anomaly_score": F.lit(0.4),
                         "flag_fuzzy_duplicate": F.lit(False), "flag_duplicate_coords": F.lit(False)})
    out = {r["pos"]: r for r in explain.with_reasons(df).collect()}
    assert out[20]["ai_explanation"] == (
        "Building name text length is unusually long compared to other registry entries (50 characters)")
    assert out[21]["ai_explanation"].startswith("Missing building name entirely")
    assert out[22]["reasons"][0] == explain.REASON_HOURS
    assert out[0]["ai_explanation"] is None and out[0]["reasons"] == [explain.REASON_MODEL_PLAIN]
    quiet = df.withColumn("review_confidence_score", F.lit(0.2))
    assert explain.with_reasons(quiet).where("pos = 0").first()["reasons"] == [explain.REASON_NONE]


def test_stored_queue_follows_the_log(spark, registry, tmp_path):
    from ledgerlint.plans.triage import run_batch, stored_queue
    from ledgerlint.sources.decisions import append_decisions
    from ledgerlint.specs import ForestSpec
    df = registry([dict(operating_hours="x" if i % 3 else "24/7", building_name=f"Tower {i}") for i in range(30)])
    path, log = str(tmp_path / "scored"), str(tmp_path / "log")
    run_batch(df, path, forest=ForestSpec(trees=5))
    first = {r["record_id"]: r["decision"] for r in stored_queue(spark, path, log).collect()}
    assert first and set(first.values()) == {"pending"}
    one = sorted(first)[0]
    append_decisions(spark.createDataFrame([(one, 0.5, "false_positive")], "record_id string, score double, decision string"), log)
    after = stored_queue(spark, path, log)
    assert {r["record_id"]: r["decision"] for r in after.collect()} == {**first, one: "false_positive"}
    assert after._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == 0
