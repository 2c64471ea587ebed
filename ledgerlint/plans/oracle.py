"""The queries in DuckDB SQL, written from their definitions rather than from the Spark plans:
no prefilters, no collapsing of copies, matching record by record."""

from __future__ import annotations

import numpy as np

from ledgerlint.operators import explain as texts, forest
from ledgerlint.plans.views import DECISION_LOG_SQL, NAMES_SQL, REGISTRY_SQL, STAND_IN_SCORE
from ledgerlint.specs import ForestSpec

ORACLE: dict[str, str] = {}


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by bit vectors; the first text has at most 61 characters."""
    masks = (f"list_transform(string_split({b}, ''), lambda c: list_sum(list_transform("
             f"range(1, length({a}) + 1), lambda i: CASE WHEN substr({a}, i, 1) = c "
             f"THEN CAST(1 AS BIGINT) << CAST(i - 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END))::BIGINT)")
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    return (f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({a}) - bit_count(list_reduce("
            f"{masks}, lambda v, m: ((v + (v & m)) | (v & ~m)) & {full}, {full})) END")


def ratio(a: str, b: str) -> str:
    return (f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE "
            f"ELSE 200.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END")


HOURS = f"""(operating_hours IS NULL OR {strip("operating_hours")} = '' OR NOT (
  regexp_matches(operating_hours, '\\d{{1,2}}[:.]?\\d{{0,2}}\\s*(am|pm|hrs|hours|-|to)', 'i')
  OR lower({strip("operating_hours")}) IN ('24 hours', '24hrs', '24/7')))"""
ADDRESS = "(road_name IS NULL OR postal_code IS NULL)"
BOX = "coalesce(NOT (latitude BETWEEN 1.1 AND 1.5 AND longitude BETWEEN 103.5 AND 104.2), true)"
TEXT = strip("(coalesce(building_name, '') || ' ' || coalesce(road_name, ''))")
BLOCK = f"lower({strip("coalesce(road_name, '')")})"
MATCHABLE = f"{BLOCK} <> '' AND building_name IS NOT NULL AND building_name <> ''"


def flags(source: str = "registry") -> str:
    return f"""flags AS (SELECT *, flag_missing_address OR flag_invalid_coords OR flag_duplicate_coords
    OR flag_malformed_hours AS any_flag FROM (SELECT *, {ADDRESS} AS flag_missing_address,
    {BOX} AS flag_invalid_coords,
    count(*) OVER (PARTITION BY latitude, longitude, location_description) > 1 AS flag_duplicate_coords,
    {HOURS} AS flag_malformed_hours FROM {source}))"""


def edges(mode: str = "literal", source: str = "registry") -> str:
    missing = {"literal": "nan", "unknown": ""}[mode]
    return f"""units AS (SELECT pos, record_id, {BLOCK} AS block, {TEXT} AS text,
    lower({strip(f"coalesce(floor_level, '{missing}')")}) AS floor,
    coalesce(location_description, '{missing}') AS descr FROM {source} WHERE {MATCHABLE}),
  text_pairs AS (SELECT DISTINCT least(a.text, b.text) AS ta, greatest(a.text, b.text) AS tb
    FROM units a JOIN units b ON a.block = b.block AND a.pos < b.pos),
  ratios AS (SELECT ta, tb, {lcs("ta", "tb")} AS common FROM text_pairs),
  similar_texts AS (SELECT ta, tb, 200.0::DOUBLE * common / (length(ta) + length(tb)) AS score FROM ratios
    WHERE 200 * common >= 90 * (length(ta) + length(tb))),
  near AS (SELECT a.block, a.pos AS i, b.pos AS j, s.score, a.text AS text_i, b.text AS text_j,
      a.floor AS floor_i, b.floor AS floor_j, a.descr AS descr_i, b.descr AS descr_j
    FROM units a JOIN units b ON a.block = b.block AND a.pos < b.pos
    JOIN similar_texts s ON s.ta = least(a.text, b.text) AND s.tb = greatest(a.text, b.text)),
  descr_pairs AS (SELECT DISTINCT descr_i, descr_j FROM near
    WHERE (floor_i = '' OR floor_j = '') AND descr_i <> '' AND descr_j <> ''),
  descr_ok AS (SELECT descr_i, descr_j FROM descr_pairs
    WHERE 200 * ({lcs("descr_i", "descr_j")}) >= 85 * (length(descr_i) + length(descr_j))),
  edges AS (SELECT n.* FROM near n LEFT JOIN descr_ok d ON n.descr_i = d.descr_i AND n.descr_j = d.descr_j
    WHERE CASE WHEN floor_i <> '' AND floor_j <> '' THEN floor_i = floor_j ELSE d.descr_i IS NOT NULL END)"""


def fuzzy(mode: str = "literal", source: str = "registry") -> str:
    """The claims of a block as a fold over its edges in record order."""
    return edges(mode, source) + f""",
  folds AS (SELECT block, list_reduce(
      list(struct_pack(l := [i], r := [j]) ORDER BY i, j),
      lambda acc, e: CASE WHEN list_contains(acc.r, e.l[1]) OR list_contains(acc.r, e.r[1]) THEN acc
        ELSE struct_pack(l := list_concat(acc.l, e.l), r := list_concat(acc.r, e.r)) END,
      struct_pack(l := CAST([] AS BIGINT[]), r := CAST([] AS BIGINT[]))) AS f FROM edges GROUP BY block),
  claims AS (SELECT unnest(f.l) AS i, unnest(f.r) AS j FROM folds),
  partners AS (SELECT j AS pos, i AS partner, false AS leads FROM claims
    UNION ALL SELECT i, max(j), true FROM claims GROUP BY i),
  fuzzy AS (SELECT r.*, p.pos IS NOT NULL AS flag_fuzzy_duplicate, q.record_id AS fuzzy_partner_id,
      coalesce(p.leads, false) AS fuzzy_is_leader
    FROM {source} r LEFT JOIN partners p ON r.pos = p.pos LEFT JOIN {source} q ON q.pos = p.partner)"""


def scored(source: str = "registry") -> str:
    return flags(source) + ", " + fuzzy("literal", source) + """,
  scored AS (SELECT f.*, z.flag_fuzzy_duplicate, z.fuzzy_partner_id, z.fuzzy_is_leader,
      least(1.0::DOUBLE, CASE WHEN f.flag_duplicate_coords AND z.flag_fuzzy_duplicate THEN 0.9::DOUBLE ELSE
        0.35::DOUBLE * f.flag_invalid_coords::INT + 0.25::DOUBLE * f.flag_missing_address::INT
        + 0.20::DOUBLE * f.flag_duplicate_coords::INT + 0.15::DOUBLE * z.flag_fuzzy_duplicate::INT
        + 0.15::DOUBLE * f.flag_malformed_hours::INT END) AS review_confidence_score
    FROM flags f JOIN fuzzy z ON f.pos = z.pos)"""


BLENDED = """,
  final AS (SELECT *, least(1.0::DOUBLE, 0.7::DOUBLE * review_confidence_score
      + 0.3::DOUBLE * ai_anomaly_score * flag_ai_anomaly::INT) AS final_review_score
    FROM (SELECT *, raw > (SELECT quantile_cont(raw, 0.97) FROM raws) AS flag_ai_anomaly,
      (raw - (SELECT min(raw) FROM raws)) / (SELECT max(raw) - min(raw) FROM raws) AS ai_anomaly_score
      FROM raws))"""
MODEL = f", raws AS (SELECT *, {STAND_IN_SCORE} AS raw FROM scored)" + BLENDED
LOG = f"""decision_log AS ({DECISION_LOG_SQL}),
  latest AS (SELECT record_id, arg_max(decision, struct_pack(t := reviewed_at, s := seq)) AS decision
    FROM decision_log GROUP BY record_id)"""
REGISTRY = f"registry AS ({REGISTRY_SQL})"
FINAL = f"WITH {REGISTRY}, {scored()}{MODEL}"
FLAGGED = FINAL + ", flagged AS (SELECT * FROM final WHERE final_review_score > 0)"


def queue(keep: str = "f.record_id < fuzzy_partner_id") -> str:
    return f"""{FLAGGED}, {LOG},
  queue AS (SELECT f.*, coalesce(l.decision, 'pending') AS decision FROM flagged f
    LEFT JOIN latest l ON f.record_id = l.record_id WHERE fuzzy_partner_id IS NULL OR {keep})"""


QUEUE = queue()


def measures(counts: str) -> str:
    share = lambda part, whole: f"CASE WHEN {whole} > 0 THEN {part}::DOUBLE / ({whole}) ELSE 0.0 END"
    return f"""m AS (SELECT *, {share("tp", "(tp + fp)")} AS p, {share("tp", "(tp + fn)")} AS r,
      {share("fp", "(fp + tn)")} AS fpr FROM ({counts}))"""


def confusion(actual: str, predicted: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {a} AND {p}) AS {name}" for name, a, p in [
        ("tp", actual, predicted), ("fn", actual, f"NOT ({predicted})"),
        ("fp", f"NOT ({actual})", predicted), ("tn", f"NOT ({actual})", f"NOT ({predicted})")])


RATES = ("tp, fn, fp, tn, round(p, 6) AS precision, round(r, 6) AS recall, "
         "round(fpr, 6) AS false_positive_rate, "
         "round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1")


def pick(*columns: str) -> str:
    scores = ("review_confidence_score", "final_review_score", "ai_anomaly_score", "latitude",
              "longitude", "score")
    return ", ".join(f"round({c}, 6) AS {c}" if c in scores else c for c in columns)


def put(name: str, sql: str) -> None:
    ORACLE[name] = sql


REG = f"WITH {REGISTRY} "
REGISTRY_COLUMNS = ["pos", "record_id", "building_name", "road_name", "postal_code", "operating_hours",
                    "latitude", "longitude", "floor_level", "location_description"]

# profile
put("profile_shape", REG + "SELECT count(*) AS n_rows, 10 AS n_columns FROM registry")
put("profile_schema", REG + "SELECT * FROM (VALUES ('unit_number', false, 0)) v(name, present, n_values)"
    + "".join(f" UNION ALL SELECT '{c}', true, count({c}) FROM registry" for c in REGISTRY_COLUMNS))
TYPES = {"pos": "bigint", "latitude": "double", "longitude": "double"}
put("profile_columns", REG + " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{c}' AS name, '{TYPES.get(c, 'string')}' AS type, count({c}) AS n_values FROM registry"
    for i, c in enumerate(REGISTRY_COLUMNS)))
put("profile_missing", REG + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM registry"
    for c in REGISTRY_COLUMNS) + ") WHERE n_missing > 0")
put("profile_distinct", REG + """SELECT operating_hours AS value, min(pos) AS first_pos FROM registry
    WHERE operating_hours IS NOT NULL GROUP BY 1 ORDER BY 2 LIMIT 15""")
SHARED = "SELECT coalesce(sum(n), 0)::BIGINT AS n_rows, count(*) AS n_keys FROM (SELECT count(*) AS n FROM "
put("profile_shared_key", REG + SHARED + "registry GROUP BY latitude, longitude) WHERE n > 1")
put("profile_shared_key_lineitem", SHARED + "lineitem GROUP BY l_partkey, l_suppkey) WHERE n > 1")
put("profile_head", REG + "SELECT " + pick("pos", "record_id", "building_name", "road_name", "latitude")
    + " FROM registry ORDER BY pos LIMIT 5")

# rules
put("rule_missing_address", REG + f"SELECT record_id, {ADDRESS} AS flag FROM registry")
put("rule_bbox", REG + f"SELECT record_id, {BOX} AS flag FROM registry")
put("rule_hours", REG + f"SELECT record_id, {HOURS} AS flag FROM registry")
put("rule_duplicate", f"WITH {REGISTRY}, {flags()} SELECT record_id, flag_duplicate_coords AS flag FROM flags")
put("rule_duplicate_lineitem", """SELECT l_orderkey, l_linenumber,
    count(*) OVER (PARTITION BY l_partkey, l_suppkey, l_returnflag) > 1 AS flag FROM lineitem""")
FLAG_COLUMNS = "flag_missing_address, flag_invalid_coords, flag_duplicate_coords, flag_malformed_hours"
put("rule_flags", f"WITH {REGISTRY}, {flags()} SELECT record_id, {FLAG_COLUMNS}, any_flag FROM flags")
put("rule_summary", f"WITH {REGISTRY}, {flags()} SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE {c}) AS {c}" for c in FLAG_COLUMNS.split(", "))
    + """, count(*) FILTER (WHERE any_flag) AS any_flag, round(avg(any_flag::INT), 6) AS any_rate,
    round(100 * avg(any_flag::INT), 1) AS any_percent FROM flags""")

# matching
put("address_text", REG + f"SELECT record_id, {TEXT} AS address_text, {BLOCK} AS block FROM registry")
put("candidate_pairs", f"""WITH {REGISTRY}, u AS (SELECT pos, {BLOCK} AS block FROM registry WHERE {MATCHABLE}),
    n AS (SELECT block, count(*) AS n_records FROM u GROUP BY block),
    p AS (SELECT a.block, count(*) AS n_pairs FROM u a JOIN u b ON a.block = b.block AND a.pos < b.pos
      GROUP BY a.block)
    SELECT n.block, n_records, n_pairs FROM n JOIN p ON n.block = p.block""")
put("similarity_ratio", REG + "SELECT record_id, round(" + ratio("b", "d") + """, 6) AS ratio FROM (SELECT
    record_id, coalesce(building_name, '') AS b, coalesce(location_description, '') AS d FROM registry)""")
put("similarity_ratio_parts", "SELECT p_partkey, round(" + ratio("p_name", "lower(p_type)")
    + ", 6) AS ratio FROM part")
put("similar_addresses", f"""WITH {REGISTRY}, {edges()}
    SELECT DISTINCT block, least(text_i, text_j) AS text_a, greatest(text_i, text_j) AS text_b,
    round(score, 6) AS score FROM near WHERE text_i <> text_j""")
# groups of copies: the description tells records apart where their block has one without a floor
for name, mode in (("fuzzy_edges", "literal"), ("fuzzy_edges_unknown", "unknown")):
    put(name, f"""WITH {REGISTRY}, {edges(mode)},
    keyed AS (SELECT *, CASE WHEN floor <> '' AND NOT bool_or(floor = '' AND descr <> '')
      OVER (PARTITION BY block) THEN '' ELSE descr END AS by_descr FROM units),
    copies AS (SELECT pos, min(pos) OVER (PARTITION BY block, text, floor, by_descr) AS first FROM keyed)
    SELECT DISTINCT block, least(a.first, b.first) AS "left", greatest(a.first, b.first) AS "right",
    round(score, 6) AS score FROM edges e JOIN copies a ON a.pos = e.i JOIN copies b ON b.pos = e.j
    WHERE a.first <> b.first""")
for name, mode in (("fuzzy_claims", "literal"), ("fuzzy_claims_unknown", "unknown")):
    put(name, f"""WITH {REGISTRY}, {fuzzy(mode)}
    SELECT record_id, flag_fuzzy_duplicate, fuzzy_partner_id, fuzzy_is_leader FROM fuzzy""")

put("fuzzy_claims_names", f"""WITH names AS ({NAMES_SQL}), {fuzzy("literal", "names")}
    SELECT record_id, flag_fuzzy_duplicate, fuzzy_partner_id, fuzzy_is_leader FROM fuzzy""")

# scores
SCORED = f"WITH {REGISTRY}, {scored()} "
put("rule_score", SCORED + "SELECT " + pick("record_id", "review_confidence_score") + " FROM scored")
put("layer_comparison", SCORED + """SELECT count(*) AS total, count(*) FILTER (WHERE any_flag) AS baseline,
    round(avg(any_flag::INT), 6) AS baseline_rate, count(*) FILTER (WHERE flag_fuzzy_duplicate) AS fuzzy,
    count(*) FILTER (WHERE flag_fuzzy_duplicate AND NOT any_flag) AS new_catches,
    count(*) FILTER (WHERE review_confidence_score > 0) AS flagged,
    round(avg((review_confidence_score > 0)::INT), 6) AS flagged_rate FROM scored""")
put("top_records", SCORED + "SELECT "
    + pick("record_id", "building_name", "road_name", "review_confidence_score")
    + " FROM scored ORDER BY scored.review_confidence_score DESC, record_id LIMIT 10")
put("contamination_flag", f"""WITH {REGISTRY}, raws AS (SELECT record_id, {STAND_IN_SCORE} AS raw FROM registry)
    SELECT record_id, raw > (SELECT quantile_cont(raw, 0.97) FROM raws) AS flag_ai_anomaly FROM raws""")
put("minmax_blend", FINAL + " SELECT "
    + pick("record_id", "flag_ai_anomaly", "ai_anomaly_score", "final_review_score") + " FROM final")
put("model_summary", FINAL + """ SELECT count(*) FILTER (WHERE flag_ai_anomaly) AS model_flagged,
    count(*) FILTER (WHERE review_confidence_score > 0) AS rule_flagged,
    count(*) FILTER (WHERE review_confidence_score <= 0 AND flag_ai_anomaly) AS model_only,
    count(*) FILTER (WHERE final_review_score > 0) AS in_queue FROM final""")
put("top_blended", FINAL + " SELECT " + pick(
    "record_id", "review_confidence_score", "ai_anomaly_score", "flag_ai_anomaly", "final_review_score")
    + " FROM final ORDER BY final.final_review_score DESC, record_id LIMIT 10")

# queue
put("latest_decision", f"WITH {LOG} SELECT record_id, decision FROM latest")
put("queue_status", QUEUE + """ SELECT s.status, count(q.record_id) AS n FROM (VALUES ('pending'),
    ('confirmed_real_issue'), ('false_positive')) s(status) LEFT JOIN queue q ON q.decision = s.status
    GROUP BY s.status""")
ENTRY = "SELECT " + pick("record_id", "decision", "final_review_score") + " FROM queue"
put("queue_collapsed", f"{QUEUE} {ENTRY}")
put("queue_cluster", f"{queue('fuzzy_is_leader')} {ENTRY}")
put("review_queue", QUEUE + " SELECT " + pick("record_id", "building_name", "road_name", "final_review_score")
    + " FROM queue WHERE decision = 'pending' ORDER BY queue.final_review_score DESC, record_id LIMIT 5")
put("queue_kpis", FLAGGED + """ SELECT *, round(queue_size / flagged, 6) AS queue_share FROM (SELECT
    count(*) FILTER (WHERE any_flag) AS baseline,
    count(*) FILTER (WHERE review_confidence_score > 0) AS rules,
    count(*) FILTER (WHERE review_confidence_score = 0 AND final_review_score > 0) AS model_only,
    count(*) FILTER (WHERE fuzzy_partner_id IS NULL OR record_id < fuzzy_partner_id) AS queue_size,
    count(*) AS flagged FROM flagged)""")
THREE = "SELECT " + pick("record_id", "review_confidence_score", "final_review_score") + " FROM queue WHERE "
put("filter_min_score", QUEUE + " SELECT " + pick(
    "record_id", "building_name", "road_name", "operating_hours", "final_review_score",
    "review_confidence_score", "ai_anomaly_score", "flag_missing_address", "flag_invalid_coords",
    "flag_duplicate_coords", "flag_fuzzy_duplicate", "flag_malformed_hours")
    + " FROM queue WHERE decision = 'pending' AND queue.final_review_score >= 0.2")
put("filter_issue_types", f"""{QUEUE} {THREE} decision = 'pending' AND queue.final_review_score >= 0
    AND (flag_invalid_coords OR flag_fuzzy_duplicate)""")
put("filter_model_only", f"""{QUEUE} {THREE} queue.review_confidence_score = 0
    AND queue.final_review_score > 0""")
put("queue_confirmed", f"{QUEUE} {THREE} decision = 'confirmed_real_issue'")
put("partner_compare", FLAGGED + " SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT a.record_id AS id, '{c}' AS field, a.{c} AS this_record, b.{c} AS matched_record
    FROM flagged a JOIN flagged b ON b.record_id = a.fuzzy_partner_id""" for c in
    ("record_id", "building_name", "road_name", "floor_level", "location_description",
     "operating_hours")) + ")")
put("decision_propagation", FLAGGED + f""", {LOG},
    named AS (SELECT f.fuzzy_partner_id AS partner, d.seq, d.reviewer, d.reviewed_at, d.decision,
        row_number() OVER (PARTITION BY f.fuzzy_partner_id ORDER BY d.reviewed_at, d.seq) AS k
      FROM decision_log d JOIN flagged f ON f.record_id = d.record_id WHERE f.fuzzy_partner_id IS NOT NULL)
    SELECT n.partner AS record_id, n.seq, n.reviewer, round(p.final_review_score, 6) AS score, n.decision,
      'propagated' AS source
    FROM named n JOIN flagged p ON p.record_id = n.partner
    WHERE n.k = 1 AND NOT EXISTS (SELECT 1 FROM decision_log o WHERE o.record_id = n.partner
      AND (o.reviewed_at < n.reviewed_at OR (o.reviewed_at = n.reviewed_at AND o.seq <= n.seq)))""")
put("record_json_fields", f"WITH {REGISTRY}, {flags()} SELECT "
    + pick(*REGISTRY_COLUMNS, *FLAG_COLUMNS.split(", "), "any_flag") + " FROM flags")
put("map_points_flagged", FLAGGED + """ SELECT round(latitude, 6) AS lat, round(longitude, 6) AS lon
    FROM flagged WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")
put("full_pipeline_rules", SCORED + "SELECT " + pick(
    "record_id", *FLAG_COLUMNS.split(", "), "any_flag", "flag_fuzzy_duplicate", "fuzzy_partner_id",
    "fuzzy_is_leader", "review_confidence_score") + " FROM scored")
put("map_points", REG + """SELECT round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM registry
    WHERE latitude IS NOT NULL AND longitude IS NOT NULL""")

# sources and sinks
put("log_append_roundtrip", f"""WITH {LOG} SELECT seq, record_id, reviewer, round(score, 6) AS score,
    decision, 'reviewer' AS source FROM decision_log""")
put("csv_roundtrip", f"""WITH {REGISTRY}, {flags()} SELECT pos, record_id, building_name, operating_hours,
    round(latitude, 6) AS latitude, any_flag FROM flags""")
EXPORTED = """record_id AS "AED_ID", operating_hours AS "OPERATING_HOURS",
    road_name AS "ROAD_NAME", building_name AS "BUILDING_NAME", postal_code AS "POSTAL_CODE",
    round(latitude, 6) AS "LATITUDE", round(longitude, 6) AS "LONGITUDE",
    CASE WHEN latitude IS NOT NULL THEN round(longitude, 6) END AS geo_longitude,
    round(latitude, 6) AS geo_latitude FROM registry"""
put("geojson_flatten", REG + "SELECT " + EXPORTED)
put("geojson_document", REG + "SELECT row_number() OVER (ORDER BY registry.pos) - 1 AS pos, " + EXPORTED)

# seeded evaluation
NAMED = strip("coalesce(building_name, '')") + " <> ''"
STYLE = """['abbreviation', 'extra_word', 'typo', 'near_exact'][
    CAST('0x' || substr(md5('42-style:' || record_id), 1, 4) AS INT) % 4 + 1]"""
VARIED = """CASE WHEN style = 'abbreviation' AND contains(building_name, 'Block')
      THEN replace(building_name, 'Block', 'Blk')
    WHEN style = 'extra_word' THEN building_name || ' Building'
    WHEN style = 'typo' AND length(building_name) > 4
      THEN left(building_name, length(building_name) // 2)
        || substr(building_name, length(building_name) // 2 + 2, 1)
        || substr(building_name, length(building_name) // 2 + 1, 1)
        || substr(building_name, length(building_name) // 2 + 3)
    ELSE building_name END"""
SEEDED = f"""drawn AS (SELECT *, {STYLE} AS style,
      row_number() OVER (ORDER BY md5('42:' || record_id), record_id) AS k
    FROM registry WHERE {NAMED} ORDER BY k LIMIT 25),
  clean AS (SELECT record_id FROM registry WHERE record_id NOT IN (SELECT record_id FROM drawn)
    ORDER BY md5('42-clean:' || record_id), record_id LIMIT 25),
  planted AS (SELECT (SELECT max(pos) FROM registry) + k AS pos, record_id || '-SEEDED' AS record_id,
    {VARIED} AS building_name, road_name, postal_code, operating_hours, latitude, longitude, floor_level,
    location_description, 'seeded' AS label, record_id AS seeded_from FROM drawn),
  test_set AS (SELECT *, CASE WHEN record_id IN (SELECT record_id FROM drawn) THEN 'seeded'
      WHEN record_id IN (SELECT record_id FROM clean) THEN 'clean' ELSE 'none' END AS label,
      NULL AS seeded_from FROM registry
    UNION ALL SELECT * FROM planted)"""
put("sample_rows", REG + f"""SELECT record_id, building_name FROM registry WHERE {NAMED}
    ORDER BY md5('42:' || record_id), record_id LIMIT 25""")
put("synthetic_duplicates", REG + f"""SELECT record_id || '-SEEDED' AS record_id, style,
    {VARIED} AS building_name FROM (SELECT *, {STYLE} AS style FROM registry WHERE {NAMED})""")
put("seeded_set", f"""WITH {REGISTRY}, {SEEDED}
    SELECT pos, record_id, building_name, label, seeded_from FROM test_set""")
DETECTED = f"""WITH {REGISTRY}, {SEEDED}, {scored("test_set")},
  labelled AS (SELECT * FROM scored WHERE label IN ('seeded', 'clean'))"""
put("seeded_eval", DETECTED + ", " + measures(
    "SELECT " + confusion("label = 'seeded'", "review_confidence_score > 0") + " FROM labelled")
    + f" SELECT {RATES} FROM m")
put("seeded_eval_by_layer", DETECTED + ", " + measures(" UNION ALL ".join(
    f"SELECT '{layer}' AS layer, " + confusion("label = 'seeded'", test) + " FROM labelled"
    for layer, test in (("rules", "any_flag"), ("fuzzy", "flag_fuzzy_duplicate"),
                        ("combined", "review_confidence_score > 0"))))
    + f" SELECT layer, {RATES} FROM m")
put("label_eval", "WITH " + measures("SELECT " + confusion("quality = 0", "toxic = 1") + " FROM labels")
    + f" SELECT {RATES} FROM m")
IDS = f"""WITH {REGISTRY}, {flags()}, a AS (SELECT record_id FROM flags WHERE flag_missing_address),
    b AS (SELECT record_id FROM flags WHERE flag_malformed_hours)"""
put("id_sets", IDS + " " + " UNION ALL ".join(
    f"SELECT '{name}' AS id_set, record_id FROM (SELECT * FROM {x} {op} SELECT * FROM {y})"
    for name, x, op, y in (("union", "a", "UNION", "b"), ("both", "a", "INTERSECT", "b"),
                           ("only_first", "a", "EXCEPT", "b"), ("only_second", "b", "EXCEPT", "a"))))

# model
put("feature_vector", REG + """SELECT record_id, round(coalesce(latitude, 0), 6) AS lat,
    round(coalesce(longitude, 0), 6) AS lon, (postal_code IS NULL)::INT::DOUBLE AS missing_postal,
    (road_name IS NULL)::INT::DOUBLE AS missing_road, (operating_hours IS NULL)::INT::DOUBLE AS missing_hours,
    length(coalesce(building_name, ''))::DOUBLE AS building_length,
    length(coalesce(location_description, ''))::DOUBLE AS description_length FROM registry""")


def forest_sql(raw: str, spec: ForestSpec = ForestSpec()) -> str:
    """Common tables after ``registry``: ``nodes`` of the fitted trees, level by level, and ``raws``, the columns of the
    table ``raw`` with the score of its records, walked level by level."""
    names, limit = forest.FEATURES, 8
    drawn = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(forest.tree_hashes(spec)))
    edges = ", ".join(f"min({n}) AS l{i}, max({n}) AS h{i}" for i, n in enumerate(names))
    varying = ", ".join(f"CASE WHEN h{i} > l{i} THEN {i} END" for i in range(len(names)))
    either = lambda letter: "CASE feature " + " ".join(f"WHEN {i} THEN {letter}{i}" for i in range(len(names))) + " END"
    value = "CASE s.feature " + " ".join(f"WHEN {i} THEN m.{n}" for i, n in enumerate(names)) + " END"
    number = lambda at: f"CAST('0x' || substr(md5('{spec.seed}:' || tree || ':' || node), {at}, 8) AS BIGINT)"
    out = [f"""feats AS MATERIALIZED (SELECT pos, record_id, coalesce(latitude, 0) AS lat, coalesce(longitude, 0) AS lon,
    (postal_code IS NULL)::INT::DOUBLE AS missing_postal, (road_name IS NULL)::INT::DOUBLE AS missing_road,
    (operating_hours IS NULL)::INT::DOUBLE AS missing_hours, length(coalesce(building_name, ''))::DOUBLE AS building_length,
    length(coalesce(location_description, ''))::DOUBLE AS description_length FROM registry)""",
           f"""m0 AS MATERIALIZED (SELECT tree, 0::BIGINT AS node, feats.* FROM feats, (VALUES {drawn}) d(tree, a, b)
    QUALIFY row_number() OVER (PARTITION BY tree ORDER BY (a * (pos % {forest.PRIME}) + b) % {forest.PRIME}, pos) <= {spec.sample})"""]
    for k in range(limit + 1):
        out.append(f"""e{k} AS (SELECT tree, node, count(*) AS size, {edges} FROM m{k} GROUP BY tree, node),
  v{k} AS (SELECT *, list_filter([{varying}], lambda x: x IS NOT NULL) AS varying FROM e{k}),
  f{k} AS (SELECT *, CASE WHEN len(varying) = 0 OR {k} >= (SELECT ceil(log2(greatest(2, least({spec.sample}, count(*))))) FROM feats)
      THEN -1 ELSE varying[1 + {number(1)} % len(varying)] END AS feature FROM v{k}),
  c{k} AS (SELECT *, {either("l")} AS low, {either("h")} AS high FROM f{k}),
  s{k} AS MATERIALIZED (SELECT tree, node, size, {k} AS depth, feature, CASE WHEN feature < 0 THEN 0.0
      WHEN low + (high - low) * ({number(9)} / {forest.NUMBERS}.0::DOUBLE) >= high THEN low
      ELSE low + (high - low) * ({number(9)} / {forest.NUMBERS}.0::DOUBLE) END AS threshold FROM c{k})""")
        if k < limit:
            out.append(f"""m{k + 1} AS MATERIALIZED (SELECT m.* REPLACE (2 * m.node + CASE WHEN {value} <= s.threshold THEN 1 ELSE 2 END AS node)
    FROM m{k} m JOIN s{k} s USING (tree, node) WHERE s.feature >= 0)""")
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(limit + 1)) + ")")
    out.append("w0 AS (SELECT t.tree, 0::BIGINT AS node, feats.* FROM feats, (SELECT DISTINCT tree FROM nodes) t)")
    for k in range(limit):
        out.append(f"""w{k + 1} AS MATERIALIZED (SELECT m.* REPLACE (CASE WHEN s.feature < 0 THEN m.node
      WHEN {value} <= s.threshold THEN 2 * m.node + 1 ELSE 2 * m.node + 2 END AS node) FROM w{k} m JOIN nodes s USING (tree, node))""")
    path = lambda n: (f"CASE WHEN {n} <= 1 THEN 0.0 WHEN {n} = 2 THEN 1.0 ELSE 2 * (ln({n} - 1.0::DOUBLE) + {float(np.euler_gamma)!r}) "
                      f"- 2 * ({n} - 1.0::DOUBLE) / {n} END")
    out.append(f"""walked AS (SELECT record_id, list_sum(list(s.depth + {path("s.size")} ORDER BY tree)) AS total, count(*) AS trees
    FROM w{limit} JOIN nodes s USING (tree, node) GROUP BY record_id),
  whole AS (SELECT max(size) AS n FROM nodes), scale AS (SELECT {path("n")} AS c FROM whole),
  raws AS (SELECT t.*, pow(2, -total / trees / CASE WHEN c = 0 THEN 1 ELSE c END) AS raw FROM {raw} t JOIN walked USING (record_id), scale)""")
    return ",\n  ".join(out)


put("forest_nodes", f"WITH {REGISTRY}, {forest_sql('feats')} SELECT tree, node, feature, round(threshold, 6) AS threshold, "
    "size AS n_rows, depth FROM nodes")
put("forest_scores", f"WITH {REGISTRY}, {forest_sql('feats')} SELECT record_id, round(raw, 6) AS raw_score FROM raws")
put("full_pipeline", f"WITH {REGISTRY}, {scored()}, {forest_sql('scored')}{BLENDED} SELECT " + pick(
    "record_id", *FLAG_COLUMNS.split(", "), "any_flag", "flag_fuzzy_duplicate", "fuzzy_partner_id",
    "review_confidence_score", "flag_ai_anomaly", "ai_anomaly_score", "final_review_score") + " FROM final")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sentence(label: str) -> str:
    return quoted(label[0].upper() + label[1:])


EXPLAINED = FLAGGED + f""",
  sizes AS (SELECT avg(length(coalesce(building_name, ''))) AS ab,
      stddev_samp(length(coalesce(building_name, ''))) AS sb,
      avg(length(coalesce(location_description, ''))) AS ad,
      stddev_samp(length(coalesce(location_description, ''))) AS sd FROM flagged),
  checks AS (
    SELECT record_id, 0 AS k, {sentence(texts.LABEL_BUILDING)} AS label,
      length(coalesce(building_name, 'nan')) AS value, (value - ab) / sb AS z FROM flagged, sizes WHERE sb > 0
    UNION ALL SELECT record_id, 1, {sentence(texts.LABEL_DESCR)},
      length(coalesce(location_description, 'nan')) AS v, (v - ad) / sd FROM flagged, sizes WHERE sd > 0
    UNION ALL SELECT record_id, 2, {sentence(texts.LABEL_NO_BUILDING)}, NULL, 3 FROM flagged
      WHERE building_name IS NULL
    UNION ALL SELECT record_id, 3, {sentence(texts.LABEL_NO_ROAD)}, NULL, 3 FROM flagged
      WHERE road_name IS NULL
    UNION ALL SELECT record_id, 4, {sentence(texts.LABEL_NO_HOURS)}, NULL, 3 FROM flagged
      WHERE operating_hours IS NULL),
  strongest AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY abs(z) DESC, k) AS best FROM checks),
  explained AS (SELECT f.*, CASE WHEN abs(s.z) < 1 THEN NULL
      WHEN s.value IS NULL THEN replace({quoted(texts.STANDS_OUT)}, '{{label}}', s.label)
      ELSE replace(replace(replace({quoted(texts.UNUSUAL)}, '{{direction}}', CASE WHEN s.z > 0 THEN 'long' ELSE 'short' END),
        '{{value}}', s.value::VARCHAR), '{{label}}', s.label) END AS ai_explanation
    FROM flagged f LEFT JOIN strongest s ON s.record_id = f.record_id AND s.best = 1)"""
put("anomaly_explain", EXPLAINED + " SELECT record_id, ai_explanation FROM explained")
REASONS = ", ".join([
    f"CASE WHEN flag_missing_address THEN {quoted(texts.REASON_ADDRESS)} END",
    f"CASE WHEN flag_invalid_coords THEN {quoted(texts.REASON_COORDS)} END",
    f"CASE WHEN flag_duplicate_coords THEN {quoted(texts.REASON_DUPLICATE)} END",
    f"CASE WHEN flag_fuzzy_duplicate THEN {quoted(texts.REASON_FUZZY)} END",
    f"CASE WHEN flag_malformed_hours THEN {quoted(texts.REASON_HOURS)} END",
    f"""CASE WHEN review_confidence_score = 0 AND ai_anomaly_score > 0 THEN
      coalesce({quoted(texts.REASON_MODEL)} || ai_explanation, {quoted(texts.REASON_MODEL_PLAIN)}) END"""])
put("review_reasons", EXPLAINED + f""" SELECT record_id,
    coalesce(nullif(concat_ws(' | ', {REASONS}), ''), {quoted(texts.REASON_NONE)}) AS reasons FROM explained""")


# effort
def gaps(window: str) -> str:
    return f"""WITH {LOG}, gaps AS (SELECT seq, date_diff('microsecond', lag(reviewed_at) OVER (
    {window} ORDER BY reviewed_at, seq), reviewed_at) / 1e6 AS gap FROM decision_log)"""


EFFORT = """ SELECT count(*) AS n_decisions, count(gap) AS n_gaps, round(avg(gap), 6) AS mean_seconds,
    round(quantile_cont(gap, 0.5), 6) AS median_seconds, round(quantile_cont(gap, 0.9), 6) AS p90_seconds,
    round(quantile_cont(gap, 0.95), 6) AS p95_seconds FROM gaps"""
put("effort_metrics", gaps("PARTITION BY reviewer") + EFFORT)
put("effort_metrics_global", gaps("") + EFFORT)
put("review_gaps", gaps("PARTITION BY reviewer") + " SELECT seq, round(gap, 6) AS gap_seconds FROM gaps")

# streams give what the batch gives
put("stream_validate", REG + f"""SELECT record_id, {ADDRESS} AS flag_missing_address,
    {BOX} AS flag_invalid_coords, {HOURS} AS flag_malformed_hours FROM registry""")
put("stream_stored_places", f"""WITH {REGISTRY}, sides AS (SELECT r.*, c_mktsegment = 'BUILDING' AS arrives
    FROM registry r JOIN customer ON c_custkey = pos) SELECT record_id, EXISTS (SELECT 1 FROM sides s WHERE NOT s.arrives
    AND s.latitude IS NOT DISTINCT FROM a.latitude AND s.longitude IS NOT DISTINCT FROM a.longitude
    AND s.location_description IS NOT DISTINCT FROM a.location_description) AS flag_stored_place
    FROM sides a WHERE arrives""")
put("stream_latest_decision", ORACLE["latest_decision"])
