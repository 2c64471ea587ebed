import json

import pytest
from pyspark.sql import functions as F

from ledgerlint.operators.rules import apply_rules, local_rules
from ledgerlint.sources import decisions, geojson, tables
from ledgerlint.streaming import decisions as decision_stream, validation

FEATURES = [
    {"properties": {"AED_ID": "A1", "LATITUDE": 1.3, "POSTAL_CODE": "012345"},
     "geometry": {"type": "Point", "coordinates": [103.8, 1.3]}},
    {"properties": {"AED_ID": "A2"}},
    {"properties": {"AED_ID": "A3", "ROAD_NAME": "X"}, "geometry": None},
]


def test_feature_collection(spark, tmp_path):
    path = tmp_path / "registry.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=1))
    rows = geojson.read_feature_collection(spark, str(path)).orderBy("pos").collect()
    assert [(r["pos"], r["AED_ID"], r["geo_longitude"], r["geo_latitude"]) for r in rows] == [
        (0, "A1", 103.8, 1.3), (1, "A2", None, None), (2, "A3", None, None)]
    assert rows[0]["POSTAL_CODE"] == "012345" and len(rows[0]) == 19


NASTY = ['quote " inside', "back\\\\slash \\", "{[}]", '"features": [{', "é🙂漢", "", "\\" * 9, "a\nb", '\\"']


@pytest.mark.parametrize("range_bytes", [13, 200, 4000, 1 << 20])
def test_one_document_is_split_at_any_byte(spark, tmp_path, range_bytes):
    features = [{"type": "Feature", "properties": {"AED_ID": f"A{i}", "ROAD_NAME": NASTY[i % 9], "BUILDING_NAME": NASTY[(i * 4) % 9], "features": [{"x": 1}]},
                 "geometry": {"type": "Point", "coordinates": [i / 8, 1.5]} if i % 5 else None} for i in range(60 if range_bytes > 13 else 6)]
    document = {"type": "FeatureCollection", "crs": {"properties": {"name": "features"}}, "other": [{"AED_ID": "no"}], "features": features,
                "after": [{"AED_ID": "no"}]}
    for k, layout in enumerate((dict(indent=2), dict(separators=(",", ":"), ensure_ascii=False))):
        path = tmp_path / f"doc-{k}.geojson"
        path.write_text(json.dumps(document, **layout), encoding="utf-8")
        whole = geojson.read_feature_collection(spark, str(path))
        split = geojson.read_large_collection(spark, str(path), range_bytes=range_bytes)
        assert split.schema.names == whole.schema.names
        assert sorted(map(tuple, split.collect()), key=lambda r: r[0]) == sorted(map(tuple, whole.collect()), key=lambda r: r[0])


def test_documents_without_features(spark, tmp_path):
    for k, text in enumerate(('{"features": []}', "{}", "", '{"features": [1, null, "{"]}')):
        path = tmp_path / f"d{k}.json"
        path.write_text(text)
        assert geojson.read_large_collection(spark, str(path), range_bytes=5).count() == 0


def test_feature_lines_are_numbered_in_file_order(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for part in range(3):
        rows = [{"properties": {"AED_ID": f"{part}-{i}"}} for i in range(400 - 100 * part)]
        (folder / f"part-{part}.json").write_text("\n".join(json.dumps(r) for r in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = geojson.read_feature_lines(spark, str(folder))
        assert df.rdd.getNumPartitions() > 1
        ids = [r["AED_ID"] for r in df.orderBy("pos").collect()]
        positions = sorted(r["pos"] for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [f"{part}-{i}" for part in range(3) for i in range(400 - 100 * part)]
    assert positions == list(range(900))


def test_csv_keeps_texts_and_turns_sentinels_to_null(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [("0123", ' say "hi", twice\nplease ', 1.5), ("NA", "", float("nan")), ("None", None, None)],
        "a string, b string, c double")
    tables.write_csv(df, path)
    rows = [tuple(r) for r in tables.read_csv(spark, path, df.schema, multi_line=True).orderBy("a").collect()]
    assert rows[-1] == ("0123", ' say "hi", twice\nplease ', 1.5)
    assert rows[:2] == [(None, None, None)] * 2
    kept = tables.clean_nulls(df, ["None"]).orderBy("a").collect()
    assert [r["a"] for r in kept] == [None, "0123", "NA"]


def test_ranked_files_follow_the_order(spark, tmp_path):
    path = str(tmp_path / "ranked")
    df = spark.range(1000).selectExpr("id", "id % 7 AS score").repartition(8)
    tables.write_ranked(df, path, [F.desc("score"), F.col("id")])
    rows = []
    for file in sorted((tmp_path / "ranked").glob("*.parquet")):
        rows += [tuple(r)[::-1] for r in spark.read.parquet(str(file)).collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1]))


def test_log_may_be_missing_or_empty(spark, tmp_path):
    path = str(tmp_path / "log")
    assert decisions.read_log(spark, path).count() == 0
    (tmp_path / "empty").mkdir()
    assert decisions.read_log(spark, str(tmp_path / "empty")).count() == 0
    header = tmp_path / "log.csv"
    header.write_text("seq,record_id,reviewer,reviewed_at,score,decision,source\n")
    assert decisions.read_csv_log(spark, str(header)).count() == 0
    (tmp_path / "zero.csv").write_text("")
    assert decisions.read_csv_log(spark, str(tmp_path / "zero.csv")).count() == 0


def test_csv_without_line_breaks_is_split(spark, tmp_path):
    path = str(tmp_path / "csv")
    tables.write_csv(spark.range(20000).selectExpr("id", "repeat('x', 50) AS t").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        back = tables.read_csv(spark, path, "id long, t string")
        assert back.rdd.getNumPartitions() > 1 and back.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_decisions_of_one_batch_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("A", 0.5, "false_positive", 7), ("A", 0.5, "confirmed_real_issue", 8)],
                                  "record_id string, score double, decision string, seq long").repartition(2)
    with pytest.raises(ValueError):
        decisions.append_decisions(batch.drop("seq"), path)
    decisions.append_decisions(batch, path)
    latest = decisions.latest_decisions(decisions.read_log(spark, path)).collect()
    assert [tuple(r) for r in latest] == [("A", "confirmed_real_issue")]


def test_ids_of_views_stay_apart(spark):
    from ledgerlint.plans import views
    keys = [1, 999_999_999, 12_345_678_901, 12_345_678_902, 5 * 10**12]
    customer = spark.createDataFrame([(k, 1, "BUILDING") for k in keys],
                                     "c_custkey long, c_nationkey int, c_mktsegment string")
    sql = views.REGISTRY_SQL.replace("FROM customer", "FROM {customer}")
    ids = [r["record_id"] for r in spark.sql(sql, customer=customer).orderBy("pos").collect()]
    assert len(set(ids)) == len(keys) and ids == sorted(ids)


def test_appending_and_latest(spark, tmp_path):
    path = str(tmp_path / "log")
    batch = spark.createDataFrame([("A", 0.5, "false_positive", 1), ("B", 0.1, "false_positive", 2)],
                                  "record_id string, score double, decision string, seq long")
    decisions.append_decisions(batch, path)
    decisions.append_decisions(batch.drop("seq").where("record_id = 'A'").withColumn(
        "decision", F.lit("confirmed_real_issue")), path)
    log = decisions.read_log(spark, path)
    assert log.count() == 3 and {r["source"] for r in log.collect()} == {"reviewer"}
    latest = {tuple(r) for r in decisions.latest_decisions(log).collect()}
    assert latest == {("A", "confirmed_real_issue"), ("B", "false_positive")}


def test_latest_breaks_ties_by_sequence(spark):
    log = spark.createDataFrame([(2, "A", "x"), (1, "A", "y")], "seq long, record_id string, decision string")
    log = log.withColumn("reviewed_at", F.timestamp_seconds(F.lit(5)))
    assert decisions.latest_decisions(log).first()["decision"] == "x"


def test_streamed_decisions_equal_the_batch(spark, tmp_path):
    """Three micro-batches, out of order, resumed from the checkpoint in between."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    log = spark.range(300).selectExpr(
        "id AS seq", "concat('R', id * 7 % 40) AS record_id",
        "timestamp_seconds(id * 7919 % 1000) AS reviewed_at",
        "IF(id % 3 = 0, 'confirmed_real_issue', 'false_positive') AS decision")
    for part in range(3):
        log.where(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source)
        changes = decision_stream.decision_changes(stream)
        decision_stream.write_changes(changes, out, checkpoint).awaitTermination()
        seen = log.where(f"seq % 3 <= {part}")
        want = {tuple(r) for r in decisions.latest_decisions(seen).collect()}
        assert {tuple(r) for r in decision_stream.read_latest(spark, out).collect()} == want


def test_streamed_validation_equals_the_batch(spark, registry, tmp_path):
    df = registry([dict(operating_hours=h) for h in ("24/7", None, "x")])
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df.repartition(3).write.parquet(source)
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source))
    validation.write_validated(validation.validate_stream(stream), out, checkpoint).awaitTermination()
    want = {tuple(r) for r in apply_rules(df, local_rules()).collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect()} == want


def test_snapshots_take_the_place_of_batches(spark, tmp_path):
    """Seven micro-batches, a snapshot every two; a batch that runs again and a snapshot without a mark change nothing."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    log = spark.range(140).selectExpr(
        "id AS seq", "concat('R', id * 7 % 9) AS record_id", "timestamp_seconds(id * 7919 % 50) AS reviewed_at",
        "concat('d', id) AS decision")
    for part in range(7):
        log.where(f"seq % 7 = {part}").coalesce(1).write.mode("append").parquet(source)
        changes = decision_stream.decision_changes(spark.readStream.schema(log.schema).parquet(source))
        decision_stream.write_changes(changes, out, checkpoint, compact_every=2).awaitTermination()
        want = {tuple(r) for r in decisions.latest_decisions(log.where(f"seq % 7 <= {part}")).collect()}
        assert {tuple(r) for r in decision_stream.read_latest(spark, out).collect()} == want
    marks = sorted(r[0] for r in spark.read.parquet(f"{out}/marks").collect())
    assert marks == [-1, 1, 3, 5]
    read = {r[0].split("/")[-2] for r in decision_stream.changes_since(spark, out).select(F.input_file_name()).collect()}
    assert read == {"upto=5", "batch=6"}
    decision_stream.compact(spark, out, 5)  # as when batch 5 runs again
    spark.createDataFrame([("R1", None, 1, "half written")], decision_stream.CHANGE_SCHEMA).write.parquet(f"{out}/snapshots/upto=6")
    assert {tuple(r) for r in decision_stream.read_latest(spark, out).collect()} == want


def test_stage_tables_end_with_their_run(spark, registry):
    import os
    df = registry([dict(building_name=f"Tower {i % 3}") for i in range(9)])
    with tables.stage_tables(spark) as folder:
        rows = tables.materialise(df, "outer").count()
        with tables.stage_tables(spark) as inner:
            tables.materialise(df, "inner")
            assert len(os.listdir(inner)) == 1
        assert not os.path.exists(inner) and rows == 9 and len(os.listdir(folder)) == 1
        assert tables.fresh_path(spark, "x").startswith(folder)
    assert not os.path.exists(folder) and "run-" not in tables.fresh_path(spark, "x")
    with pytest.raises(ZeroDivisionError):
        with tables.stage_tables(spark) as folder:
            tables.materialise(df, "kept")
            1 / 0
    assert len(os.listdir(folder)) == 1 and "run-" not in tables.fresh_path(spark, "x")


def test_stored_places_of_nulls_and_hot_keys(spark, registry):
    stored = registry([dict(latitude=1.0)] * 5 + [dict(latitude=None, longitude=None, location_description=None)])
    arriving = registry([dict(latitude=1.0), dict(latitude=2.0), dict(latitude=None, longitude=None, location_description=None)])
    counts = validation.place_counts(stored)
    for hot_rows in (2, 10**6):
        out = validation.flag_stored_places(arriving, counts, hot_rows=hot_rows).orderBy("pos")
        assert [r["flag_stored_place"] for r in out.collect()] == [True, False, True]
        assert out.columns == [*arriving.columns, "flag_stored_place"]
