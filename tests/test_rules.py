from pyspark.sql import functions as F

from ledgerlint.operators import profile, rules
from ledgerlint.operators.joins import frequent_keys, lookup
from ledgerlint.specs import BoundingBox


def flags(df, name):
    return [r[0] for r in df.orderBy("pos").select(name).collect()]


def test_hours(registry):
    good = ["9am - 5pm", "24 hours", "24hrs", "24/7", "\t24/7\n", "0900-1800", "9.30AM", "9 am", "24/7　"]
    bad = ["Mon to Fri", "Open 7", "", "   ", None, " "]
    df = rules.flag_records(registry([{"operating_hours": h} for h in good + bad]))
    assert flags(df, "flag_malformed_hours") == [False] * len(good) + [True] * len(bad)


def test_bounding_box(registry):
    points = [(1.1, 103.5), (1.5, 104.2), (1.0999, 103.8), (None, 103.8), (1.3, None), (float("nan"), 103.8)]
    df = registry([{"latitude": a, "longitude": b} for a, b in points])
    assert flags(rules.flag_records(df), "flag_invalid_coords") == [False, False, True, True, True, True]
    wide = BoundingBox(1.0, 2.0, 103.0, 105.0)
    assert flags(rules.flag_records(df, box=wide), "flag_invalid_coords")[2] is False


def test_missing_address(registry):
    df = registry([{}, {"road_name": None}, {"postal_code": None}, {"road_name": ""}])
    assert flags(rules.flag_records(df), "flag_missing_address") == [False, True, True, False]


def test_duplicates_treat_nulls_as_equal(registry):
    rows = [(None, None, None)] * 2 + [(1.2, 103.7, "a")] * 2 + [(1.2, 103.7, "b")]
    df = registry([dict(latitude=a, longitude=b, location_description=c) for a, b, c in rows])
    expected = [True, True, True, True, False]
    assert flags(rules.flag_records(df), "flag_duplicate_coords") == expected
    # the same when every repeated key counts as hot
    assert flags(rules.flag_records(df, hot_rows=2), "flag_duplicate_coords") == expected


def test_any_flag_and_extra_rule(registry):
    df = registry([{"location_description": c} for c in "abc"])
    extra = [rules.Rule("flag_b", lambda: F.col("location_description") == "b")]
    assert flags(rules.flag_records(df, extra=extra), "any_flag") == [False, True, False]


def test_lookup_splits_hot_keys(spark):
    left = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 "
                                              "ELSE id END AS k")
    right = spark.createDataFrame([(None, "null"), (7, "seven"), (8, "eight")], "k long, v string")
    hot = frequent_keys(left, ["k"], 100)
    assert {r[0] for r in hot.collect()} == {None, 7}
    got = {r["id"]: r["v"] for r in lookup(left, right, ["k"], hot, "id").collect()}
    assert len(got) == 1000
    for i, v in got.items():
        assert v == ("null" if i % 3 == 0 else "seven" if i % 3 == 1 else "eight" if i == 8 else None)


def test_hot_rows_are_scattered(spark):
    """In the shuffled join the rows of a hot key must not share their join key."""
    left = spark.range(1000).selectExpr("id", "1 AS k")
    right = spark.createDataFrame([(1, "x")], "k int, v string")
    joined = lookup(left, right, ["k"], left.select("k").distinct(), "id")
    assert joined.where("v = 'x'").count() == 1000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_scatter" in plan and "xxhash64" in plan


def test_profile(registry, spark):
    df = registry([{"operating_hours": h} for h in ["b", None, "a", "b", "c"]])
    assert [r["value"] for r in profile.first_distinct(df, "operating_hours", "pos", 2).collect()] == ["b", "a"]
    assert profile.missing_per_column(df).collect()[0].asDict() == {"column_name": "operating_hours", "n_missing": 1}
    assert profile.shared_key_rows(df, ["latitude", "longitude"]).first()["n_rows"] == 5
    listing = profile.column_listing(df).collect()
    assert (listing[0]["ordinal"], listing[0]["name"], listing[0]["type"]) == (0, "pos", "bigint")
    missing = profile.schema_conformance(df).where("NOT present").count()
    assert missing == 16
