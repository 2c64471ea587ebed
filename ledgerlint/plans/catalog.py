"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlint.functions import similarity as sim
from ledgerlint.functions.hashing import seeded_choice
from ledgerlint.operators import evaluation, explain, forest, matching, profile, queue, rules, scoring
from ledgerlint.operators import effort, seeding
from ledgerlint.plans import views
from ledgerlint.plans.triage import triage
from ledgerlint.sources import decisions, geojson, tables
from ledgerlint.specs import Fields, MatchSpec
from ledgerlint.streaming import decisions as decision_stream, validation

REG = Fields()
CATALOG: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SCORED = ["record_id", "review_confidence_score", "final_review_score"]
EVENTS_DDL = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CUSTOMER_DDL = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def query(fn):
    CATALOG[fn.__name__] = fn
    return fn


# ------------------------------------------------------------------------------ stages

def flagged(spark, sf):
    return rules.flag_records(views.registry(spark, sf))


def matched(spark, sf, null_units="literal"):
    return matching.find_duplicates(views.registry(spark, sf), spec=MatchSpec(null_units=null_units))


def scored(spark, sf):
    registry = views.registry(spark, sf)
    return scoring.rule_score(rules.flag_records(matching.find_duplicates(registry), base=registry))


def final(spark, sf):
    """Scored records with the stand-in for the model's raw score."""
    table = scored(spark, sf).withColumn("raw_score", F.expr(views.STAND_IN_SCORE))
    return scoring.blend(tables.materialise(table, "scored"))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def shown(df, *columns):
    out = df.select(*columns)
    return rounded(out, *[c for c, t in out.dtypes if t == "double"])


# ----------------------------------------------------------------------------- profile

@query
def profile_shape(spark, sf):
    return profile.shape(views.registry(spark, sf))


@query
def profile_schema(spark, sf):
    """Expected fields of a registry: present or not, and how many values each has."""
    df = views.registry(spark, sf)
    expected = profile.schema_conformance(df, [*Fields().__dict__.values(), "unit_number"])
    counts = (df.agg(*[F.count(c).alias(c) for c in df.columns])
              .unpivot([], df.columns, "name", "n_values"))
    return expected.join(counts, "name", "left").select(
        "name", "present", F.coalesce("n_values", F.lit(0)).alias("n_values"))


@query
def profile_columns(spark, sf):
    """Each column of the registry with its position, type and number of values."""
    df = views.registry(spark, sf)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "name", "n_values")
    return profile.column_listing(df).join(counts, "name").select("ordinal", "name", "type", "n_values")


@query
def profile_missing(spark, sf):
    return profile.missing_per_column(views.registry(spark, sf))


@query
def profile_distinct(spark, sf):
    return profile.first_distinct(views.registry(spark, sf), "operating_hours", "pos")


@query
def profile_shared_key(spark, sf):
    return profile.shared_key_rows(views.registry(spark, sf), ["latitude", "longitude"])


@query
def profile_shared_key_lineitem(spark, sf):
    return profile.shared_key_rows(views.table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query
def profile_head(spark, sf):
    return shown(profile.head(views.registry(spark, sf), "pos"), "pos", "record_id", "building_name",
                 "road_name", "latitude")


# ------------------------------------------------------------------------------- rules

@query
def rule_missing_address(spark, sf):
    return views.registry(spark, sf).select("record_id", rules.missing_address().alias("flag"))


@query
def rule_bbox(spark, sf):
    return views.registry(spark, sf).select("record_id", rules.invalid_coordinates().alias("flag"))


@query
def rule_hours(spark, sf):
    return views.registry(spark, sf).select("record_id", rules.malformed_hours().alias("flag"))


@query
def rule_duplicate(spark, sf):
    df = rules.duplicated(views.registry(spark, sf), ["latitude", "longitude", "location_description"],
                          "flag", "pos")
    return df.select("record_id", "flag")


@query
def rule_duplicate_lineitem(spark, sf):
    keys = ["l_partkey", "l_suppkey", "l_returnflag"]
    df = rules.duplicated(views.table(spark, sf, "lineitem"), keys, "flag", "l_orderkey")
    return df.select("l_orderkey", "l_linenumber", "flag")


@query
def rule_flags(spark, sf):
    return flagged(spark, sf).select("record_id", *rules.RULE_FLAGS, "any_flag")


@query
def rule_summary(spark, sf):
    return rules.rule_summary(flagged(spark, sf))


# ---------------------------------------------------------------------------- matching

@query
def address_text(spark, sf):
    return views.registry(spark, sf).select(
        "record_id", matching.address_text().alias("address_text"), matching.block_key().alias("block"))


@query
def candidate_pairs(spark, sf):
    """Per block its matchable records and the pairs blocking leaves to compare."""
    return matching.block_sizes(views.registry(spark, sf))


@query
def similarity_ratio(spark, sf):
    """The ratio of two texts of each record."""
    a, b = F.coalesce("building_name", F.lit("")), F.coalesce("location_description", F.lit(""))
    return views.registry(spark, sf).select("record_id", F.round(sim.ratio(a, b), 6).alias("ratio"))


@query
def similarity_ratio_parts(spark, sf):
    a, b = F.col("p_name"), F.lower("p_type")
    return views.table(spark, sf, "part").select("p_partkey", F.round(sim.ratio(a, b), 6).alias("ratio"))


def _nodes(spark, sf, null_units="literal"):
    spec = MatchSpec(null_units=null_units)
    units = tables.materialise(matching.match_units(views.registry(spark, sf), spec=spec), "units")
    open_floors = not units.where("floor = ''").isEmpty()
    nodes = tables.materialise(matching.match_nodes(matching.node_keys(units, open_floors)), "nodes")
    return nodes, tables.materialise(matching.text_keys(nodes, spec), "texts"), spec, open_floors


@query
def similar_addresses(spark, sf):
    """Different address texts of a block that reach the address threshold."""
    _, texts, spec, _ = _nodes(spark, sf)
    return shown(matching.similar_texts(texts, texts, spec, True),
                 "block", "text_a", "text_b", "score")


def _edges(spark, sf, null_units):
    nodes, texts, spec, open_floors = _nodes(spark, sf, null_units)
    edges = matching.match_edges(nodes, nodes, texts, spec, True, None, open_floors)
    return edges.select("block", "left", "right", F.round("score", 6).alias("score"))


@query
def fuzzy_edges(spark, sf):
    """Matching groups of copies, each named by the order of its first record."""
    return _edges(spark, sf, "literal")


@query
def fuzzy_edges_unknown(spark, sf):
    return _edges(spark, sf, "unknown")


CLAIM = ["record_id", "flag_fuzzy_duplicate", "fuzzy_partner_id", "fuzzy_is_leader"]


@query
def fuzzy_claims(spark, sf):
    return matched(spark, sf).select(*CLAIM)


@query
def fuzzy_claims_unknown(spark, sf):
    return matched(spark, sf, "unknown").select(*CLAIM)


@query
def fuzzy_claims_names(spark, sf):
    """The matcher on customer names within a nation: the distinct texts grow with the table."""
    return matching.find_duplicates(views.names(spark, sf)).select(*CLAIM)


# ----------------------------------------------------------------------------- scoring

@query
def rule_score(spark, sf):
    return shown(scored(spark, sf), "record_id", "review_confidence_score")


@query
def layer_comparison(spark, sf):
    return scoring.layer_comparison(scored(spark, sf))


@query
def top_records(spark, sf):
    top = queue.top_records(scored(spark, sf), "review_confidence_score", 10)
    wanted = ["record_id", "building_name", "road_name", "review_confidence_score", "not_a_column"]
    return rounded(queue.present_columns(top, wanted), "review_confidence_score")


@query
def contamination_flag(spark, sf):
    df = views.registry(spark, sf).select("record_id", F.expr(views.STAND_IN_SCORE).alias("raw_score"))
    return scoring.flag_outliers(df).select("record_id", "flag_ai_anomaly")


@query
def minmax_blend(spark, sf):
    return shown(final(spark, sf), "record_id", "flag_ai_anomaly", "ai_anomaly_score", "final_review_score")


@query
def model_summary(spark, sf):
    return scoring.model_summary(final(spark, sf))


@query
def top_blended(spark, sf):
    top = queue.top_records(final(spark, sf), "final_review_score", 10)
    return shown(top, "record_id", "review_confidence_score", "ai_anomaly_score", "flag_ai_anomaly",
                 "final_review_score")


# ------------------------------------------------------------------------------- queue

@query
def latest_decision(spark, sf):
    return decisions.latest_decisions(views.decision_log(spark, sf))


def _queue(spark, sf, mode="pair"):
    return queue.review_queue(final(spark, sf), views.decision_log(spark, sf), mode)


@query
def queue_status(spark, sf):
    return queue.status_counts(_queue(spark, sf))


@query
def queue_collapsed(spark, sf):
    return shown(_queue(spark, sf), "record_id", "decision", "final_review_score")


@query
def queue_cluster(spark, sf):
    return shown(_queue(spark, sf, "cluster"), "record_id", "decision", "final_review_score")


@query
def review_queue(spark, sf):
    return shown(queue.top_pending(_queue(spark, sf)), "record_id", "building_name", "road_name",
                 "final_review_score")


@query
def queue_kpis(spark, sf):
    return queue.queue_kpis(queue.flagged_records(final(spark, sf)))


@query
def filter_min_score(spark, sf):
    pending = queue.by_status(_queue(spark, sf), "pending")
    return rounded(queue.ranked(queue.filtered(pending, 0.2)), "final_review_score",
                   "review_confidence_score", "ai_anomaly_score")


@query
def filter_issue_types(spark, sf):
    pending = queue.by_status(_queue(spark, sf), "pending")
    chosen = queue.filtered(pending, 0.0, ["flag_invalid_coords", "flag_fuzzy_duplicate"])
    return shown(chosen, *SCORED)


@query
def filter_model_only(spark, sf):
    return shown(queue.filtered(_queue(spark, sf), 0.0, model_only=True), *SCORED)


@query
def queue_confirmed(spark, sf):
    return shown(queue.by_status(_queue(spark, sf), "confirmed_real_issue"), *SCORED)


@query
def partner_compare(spark, sf):
    return queue.partner_comparison(queue.flagged_records(final(spark, sf)))


@query
def decision_propagation(spark, sf):
    flagged_rows = queue.flagged_records(final(spark, sf))
    carried = queue.propagated_decisions(views.decision_log(spark, sf), flagged_rows)
    return shown(carried, "record_id", "seq", "reviewer", "score", "decision", "source")


@query
def record_json(spark, sf):
    return queue.record_json(flagged(spark, sf))


@query
def record_json_fields(spark, sf):
    """The documents of :func:`record_json` read back into columns."""
    table = flagged(spark, sf)
    back = queue.record_json(table).select(F.from_json("document", table.schema).alias("r")).select("r.*")
    return rounded(back, "latitude", "longitude")


@query
def map_points_flagged(spark, sf):
    """The points a reviewer sees: those of the flagged records."""
    return shown(queue.map_points(queue.flagged_records(final(spark, sf))), "lat", "lon")


@query
def map_points(spark, sf):
    return shown(queue.map_points(views.registry(spark, sf)), "lat", "lon")


# ---------------------------------------------------------------------- sources, sinks

@query
def log_append_roundtrip(spark, sf):
    """The decision log appended in two batches to a log that does not exist yet."""
    log, path = views.decision_log(spark, sf), tables.fresh_path(spark, "log")
    assert decisions.read_log(spark, path).isEmpty()
    for part in (F.col("decision") == "false_positive", F.col("decision") != "false_positive"):
        decisions.append_decisions(log.where(part), path)
    return shown(decisions.read_log(spark, path), "seq", "record_id", "reviewer", "score", "decision",
                 "source")


@query
def csv_roundtrip(spark, sf):
    """Flagged records through a CSV file; the texts standing for missing values become NULL."""
    path = tables.fresh_path(spark, "csv")
    stage = flagged(spark, sf)
    tables.write_csv(stage, path)
    back = tables.read_csv(spark, path, stage.schema)
    return shown(back, "pos", "record_id", "building_name", "operating_hours", "latitude", "any_flag")


EXPORTED = {REG.id: "AED_ID", REG.hours: "OPERATING_HOURS", REG.road: "ROAD_NAME", REG.building: "BUILDING_NAME",
            REG.postal: "POSTAL_CODE", REG.lat: "LATITUDE", REG.lon: "LONGITUDE"}


def _features(spark, sf):
    """The registry as GeoJSON features, in record order by ``pos``."""
    return views.registry(spark, sf).select(
        "pos", F.struct(*[F.col(c).alias(n) for c, n in EXPORTED.items()]).alias("properties"),
        F.when(F.col("latitude").isNotNull(), F.struct(
            F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates"))
        ).alias("geometry"))


@query
def geojson_flatten(spark, sf):
    """The registry written as GeoJSON features, one per line, and flattened again."""
    path = tables.fresh_path(spark, "geojson")
    _features(spark, sf).drop("pos").write.json(path)
    back = tables.materialise(geojson.read_feature_lines(spark, path), "flat")
    return shown(back, *EXPORTED.values(), "geo_longitude", "geo_latitude")


@query
def geojson_document(spark, sf):
    """The registry as one document, read back by a task per byte range; pos counts its features."""
    features = _features(spark, sf)
    rank = F.lit(1).alias("rank")
    lines = features.select(rank, "pos", F.concat(F.lit(","), F.to_json(F.struct("properties", "geometry"))).alias("value"))
    edges = spark.createDataFrame([(0, 0, '{"type": "FeatureCollection", "features": [null'), (2, 0, "]}")], "rank int, pos long, value string")
    path = tables.fresh_path(spark, "document")
    lines.unionByName(edges).coalesce(1).sortWithinPartitions("rank", "pos").select("value").write.text(path)  # one document, one file
    file = spark.read.text(path).inputFiles()[0]
    back = tables.materialise(geojson.read_large_collection(spark, file, range_bytes=1 << 18), "flat")
    return shown(back, "pos", *EXPORTED.values(), "geo_longitude", "geo_latitude")


# ------------------------------------------------------------------- seeded evaluation

@query
def sample_rows(spark, sf):
    return seeding.sample_rows(seeding.seed_candidates(views.registry(spark, sf)), 25, 42).select(
        "record_id", "building_name")


@query
def synthetic_duplicates(spark, sf):
    """A near-copy of every record that has a building name."""
    df = seeding.seed_candidates(views.registry(spark, sf)).withColumn(
        "style", seeded_choice("42-style", F.col("record_id"), seeding.STYLES))
    return seeding.synthetic_duplicates(df).select("record_id", "style", "building_name")


def _seeded(spark, sf):
    return seeding.seeded_test_set(views.registry(spark, sf))


@query
def seeded_set(spark, sf):
    return _seeded(spark, sf).select("pos", "record_id", "building_name", "label", "seeded_from")


@query
def seeded_eval(spark, sf):
    return evaluation.evaluate(evaluation.detect(_seeded(spark, sf)))


@query
def seeded_eval_by_layer(spark, sf):
    return evaluation.evaluate_by_layer(evaluation.detect(_seeded(spark, sf)))


@query
def label_eval(spark, sf):
    labels = views.table(spark, sf, "labels")
    return evaluation.measures(evaluation.confusion(labels, F.col("quality") == 0, F.col("toxic") == 1))


@query
def id_sets(spark, sf):
    """Set algebra over two id sets: records with a bad address, records with bad hours."""
    df = flagged(spark, sf)
    a = df.where("flag_missing_address").select("record_id")
    b = df.where("flag_malformed_hours").select("record_id")
    sets = [("union", a.union(b).distinct()), ("both", a.intersect(b)), ("only_first", a.subtract(b)),
            ("only_second", b.join(a, "record_id", "left_anti"))]
    out = None
    for name, ids in sets:
        ids = ids.select(F.lit(name).alias("id_set"), "record_id")
        out = ids if out is None else out.unionByName(ids)
    return out


# ------------------------------------------------------------------------------- model

@query
def feature_vector(spark, sf):
    return rounded(forest.feature_vector(views.registry(spark, sf)), "lat", "lon")


@query
def forest_scores(spark, sf):
    """Scores by a forest that was stored and read again."""
    df = views.registry(spark, sf)
    nodes = tables.materialise(forest.tree_nodes(df), "forest")
    return rounded(forest.with_outlier_score(df, forest.forest_of(nodes)).select("record_id", "raw_score"), "raw_score")


@query
def forest_nodes(spark, sf):
    """The nodes of the fitted trees."""
    nodes = forest.tree_nodes(views.registry(spark, sf))
    return shown(nodes, "tree", "node", "feature", "threshold", F.col("size").alias("n_rows"), "depth")


@query
def anomaly_explain(spark, sf):
    rows = queue.flagged_records(final(spark, sf))
    return explain.with_explanation(tables.materialise(rows, "flagged")).select("record_id", "ai_explanation")


@query
def review_reasons(spark, sf):
    rows = tables.materialise(queue.flagged_records(final(spark, sf)), "flagged")
    return explain.with_reasons(rows).select("record_id", F.array_join("reasons", " | ").alias("reasons"))


# ------------------------------------------------------------------------------ effort

@query
def effort_metrics(spark, sf):
    return effort.effort_metrics(views.decision_log(spark, sf), ["reviewer"])


@query
def effort_metrics_global(spark, sf):
    return effort.effort_metrics(views.decision_log(spark, sf))


@query
def review_gaps(spark, sf):
    return shown(effort.review_gaps(views.decision_log(spark, sf), ["reviewer"]), "seq", "gap_seconds")


# ------------------------------------------------------------------- pipeline, streams

@query
def full_pipeline(spark, sf):
    out = triage(views.registry(spark, sf))
    return shown(out, "record_id", *rules.RULE_FLAGS, "any_flag", "flag_fuzzy_duplicate",
                      "fuzzy_partner_id", "review_confidence_score", "flag_ai_anomaly",
                      "ai_anomaly_score", "final_review_score")


@query
def full_pipeline_rules(spark, sf):
    """What the whole batch says of each record apart from the forest's random trees."""
    return shown(triage(views.registry(spark, sf)), "record_id", *rules.RULE_FLAGS, "any_flag",
                 "flag_fuzzy_duplicate", "fuzzy_partner_id", "fuzzy_is_leader", "review_confidence_score")


@query
def stream_validate(spark, sf):
    """Arriving records validated by a stream; the written table is returned."""
    arriving = (spark.readStream.schema(CUSTOMER_DDL).option("pathGlobFilter", "customer.parquet")
                .parquet(sf))
    records = spark.sql(views.REGISTRY_SQL.replace("FROM customer", "FROM {customer}"), customer=arriving)
    out, checkpoint = tables.fresh_path(spark, "validated"), tables.fresh_path(spark, "offsets")
    validation.write_validated(validation.validate_stream(records), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("record_id", "flag_missing_address", "flag_invalid_coords",
                                          "flag_malformed_hours")


@query
def stream_stored_places(spark, sf):
    """Records of one market segment arrive; those at a place that a stored record of another has are flagged."""
    customers = views.table(spark, sf, "customer")
    sql = views.REGISTRY_SQL.replace("FROM customer", "FROM {customer}")
    stored = spark.sql(sql, customer=customers.where("c_mktsegment <> 'BUILDING'"))
    arriving = (spark.readStream.schema(CUSTOMER_DDL).option("pathGlobFilter", "customer.parquet")
                .parquet(sf).where("c_mktsegment = 'BUILDING'"))
    found = validation.flag_stored_places(spark.sql(sql, customer=arriving), validation.place_counts(stored))
    out, checkpoint = tables.fresh_path(spark, "arrived"), tables.fresh_path(spark, "offsets")
    validation.write_validated(found, out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("record_id", "flag_stored_place")


@query
def stream_latest_decision(spark, sf):
    """The decision log as a stream; the latest decision of each record from its changes."""
    arriving = (spark.readStream.schema(EVENTS_DDL).option("pathGlobFilter", "events.parquet").parquet(sf))
    log = views.decision_log(spark, sf, arriving)
    out, checkpoint = tables.fresh_path(spark, "changes"), tables.fresh_path(spark, "offsets")
    decision_stream.write_changes(
        decision_stream.decision_changes(log), out, checkpoint).awaitTermination()
    return decision_stream.read_latest(spark, out)
