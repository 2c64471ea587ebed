"""The registry, the decision log and stand-in scores, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Plain SQL that Spark and DuckDB read alike.
REGISTRY_SQL = """
SELECT c_custkey AS pos,
  concat('R', lpad(CAST(c_custkey AS STRING), 19, '0')) AS record_id,
  CASE WHEN c_custkey % 17 = 0 THEN NULL
       WHEN c_custkey % 5 = 0 THEN concat('Block ', CAST(100 + c_custkey % 40 AS STRING), ' ', c_mktsegment)
       WHEN c_custkey % 5 = 1 THEN concat('Blk ', CAST(100 + c_custkey % 40 AS STRING), ' ', c_mktsegment)
       ELSE concat(c_mktsegment, ' Centre ', CAST(c_custkey % 12 AS STRING)) END AS building_name,
  CASE WHEN c_custkey % 53 = 0 THEN NULL
       WHEN c_custkey % 7 = 0 THEN concat(' NATION ROAD ', CAST(c_nationkey AS STRING), ' ')
       ELSE concat('Nation Road ', CAST(c_nationkey AS STRING)) END AS road_name,
  CASE WHEN c_custkey % 41 = 0 THEN NULL
       ELSE lpad(CAST(c_custkey % 300 AS STRING), 6, '0') END AS postal_code,
  CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '24 hours' WHEN 2 THEN '24/7' WHEN 3 THEN 'Mon to Fri'
       WHEN 4 THEN '9.30am - 5pm' WHEN 5 THEN '0900-1800' WHEN 6 THEN ' ' ELSE '24 HRS' END AS operating_hours,
  CASE WHEN c_custkey % 97 = 0 THEN CAST(9.9 AS DOUBLE) WHEN c_custkey % 89 = 0 THEN CAST(NULL AS DOUBLE)
       ELSE CAST(1.2 AS DOUBLE) + (c_custkey % 30) * CAST(0.01 AS DOUBLE) END AS latitude,
  CAST(103.6 AS DOUBLE) + (c_nationkey % 25) * CAST(0.01 AS DOUBLE) AS longitude,
  CASE c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN NULL ELSE 'B1' END AS floor_level,
  CASE WHEN c_custkey % 19 = 0 THEN NULL
       ELSE concat('Lift lobby ', CAST(c_custkey % 7 AS STRING)) END AS location_description
FROM customer
"""

# Customers by name and nation: every name is another text, so the distinct texts grow with the table.
NAMES_SQL = """
SELECT c_custkey AS pos, concat('R', lpad(CAST(c_custkey AS STRING), 19, '0')) AS record_id,
  c_name AS building_name, concat('Nation ', CAST(c_nationkey AS STRING)) AS road_name,
  c_mktsegment AS floor_level, CAST(NULL AS STRING) AS location_description
FROM customer
"""

# The purchases and errors among the events count as decisions. Decisions spread over three times the registry: some records get several, some none, and some
# decisions are about records no longer in the registry.
DECISION_LOG_SQL = """
SELECT event_id AS seq,
  concat('R', lpad(CAST(event_id % (3 * (SELECT count(*) FROM customer)) AS STRING), 19, '0')) AS record_id,
  user_id AS reviewer, ts AS reviewed_at, value / CAST(500 AS DOUBLE) AS score,
  CASE event_type WHEN 'purchase' THEN 'confirmed_real_issue' ELSE 'false_positive' END AS decision
FROM events WHERE event_type IN ('purchase', 'error')
"""

# A stand-in for the model's raw score, the same in every engine.
STAND_IN_SCORE = "CAST(pos * 7919 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTRY_SQL.replace("FROM customer", "FROM {customer}"),
                     customer=table(spark, sf_dir, "customer"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMES_SQL.replace("FROM customer", "FROM {customer}"),
                     customer=table(spark, sf_dir, "customer"))


def decision_log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    sql = DECISION_LOG_SQL.replace("FROM customer", "FROM {customer}").replace(
        "FROM events", "FROM {events}")
    return spark.sql(sql, customer=table(spark, sf_dir, "customer"),
                     events=table(spark, sf_dir, "events") if events is None else events)
