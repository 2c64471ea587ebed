"""Every query next to its SQL on the smallest data set, and what the entry module promises."""

import pytest
from compare import connection, difference

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
from ledgerlint.plans.catalog import CATALOG

QUERIES, SQL = CATALOG, {k: v for k, v in entry_module.oracle_sql().items() if k in CATALOG}


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert difference(spark, duck, SF, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_every_record(spark, name):
    assert QUERIES[name](spark, SF).count() == 150


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["record_id", "building_name", "road_name", "final_review_score"]
    assert df.count() == 5


def test_pipeline_identities(spark):
    rows = QUERIES["full_pipeline"](spark, SF).collect()
    assert all(0 <= r["final_review_score"] <= 1 and 0 <= r["ai_anomaly_score"] <= 1 for r in rows)
    assert sum(r["flag_ai_anomaly"] for r in rows) <= 0.03 * len(rows) + 1
    queue = sum(r["final_review_score"] > 0 for r in rows)
    rules = sum(r["review_confidence_score"] > 0 for r in rows)
    model_only = sum(r["review_confidence_score"] == 0 and r["flag_ai_anomaly"] for r in rows)
    assert queue == rules + model_only
