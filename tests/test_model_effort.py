import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlint.operators import effort, forest, quantiles, seeding
from ledgerlint.operators.evaluation import measures
from ledgerlint.specs import ForestSpec


def test_exact_quantiles(spark):
    rng = random.Random(7)
    samples = [[rng.gauss(0, 1e6) for _ in range(997)], [1.0] * 400 + [rng.random() for _ in range(101)],
               [5.0], [1.0, 2.0], [1e300, -1e300, 0.0, 1e-300]]
    probabilities = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.97, "e": 1.0}
    for values in samples:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
        want = np.quantile(values, list(probabilities.values()))
        for partitions in (7, None):
            got = quantiles.exact_quantiles(df, "v", probabilities, partitions=partitions).first()
            assert np.allclose([got[k] for k in probabilities], want, rtol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles.exact_quantiles(df, "v", {"m": 0.5}).first()["m"] is None


def log_of(spark, seconds, reviewer=1, source="reviewer"):
    rows = [(i, s, reviewer, source) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "seq long, s double, reviewer long, source string").select(
        "seq", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("reviewed_at"), "reviewer", "source")


def test_gaps_do_not_depend_on_ranges(spark):
    rng = random.Random(9)
    seconds = [rng.uniform(0, 40 * 3600) for _ in range(200)] + [0.0, 0.0, 90 * 3600.0]
    log = log_of(spark, seconds)
    want = np.diff(sorted(seconds))
    for ranges in (1, 2, 3, 7):
        for by in (None, ["reviewer"]):
            got = effort.review_gaps(log, by, ranges).orderBy("reviewed_at", "seq").collect()
            assert got[0]["gap_seconds"] is None
            assert np.allclose([r["gap_seconds"] for r in got[1:]], want, atol=2e-6)


def test_gaps_of_unnamed_reviewers_are_kept(spark):
    log = log_of(spark, [0.0, 4000.0, 9000.0], reviewer=None)
    assert effort.review_gaps(log, ["reviewer"]).count() == 3


def test_effort_metrics(spark):
    log = log_of(spark, [0.0, 10.0, 30.0, 60.0])
    row = effort.effort_metrics(log).first()
    assert (row["n_gaps"], row["mean_seconds"], row["median_seconds"]) == (3, 20.0, 20.0)
    assert round(row["p90_seconds"], 6) == 28.0
    alone = effort.effort_metrics(log.where("seq = 0")).first()
    assert alone["n_decisions"] == 1 and alone["mean_seconds"] is None and alone["p95_seconds"] is None
    both = log.unionByName(log_of(spark, [0.001], source="propagated").withColumn("seq", F.lit(99)))
    assert effort.effort_metrics(both, exclude_propagated=True).first()["n_gaps"] == 3


def planted(registry):
    rows = [dict(building_name="x" * (8 + i % 5), latitude=1.2 + (i % 20) * 0.01) for i in range(600)]
    rows += [dict(building_name="y" * 120, latitude=9.9, longitude=50.0, postal_code=None) for _ in range(3)]
    return registry(rows)


def test_forest_finds_planted_outliers(spark, registry):
    df = planted(registry)
    out = forest.with_outlier_score(df, forest.fit_forest(df))
    scores = {r["pos"]: r["raw_score"] for r in out.collect()}
    assert all(0 < s <= 1 for s in scores.values())
    assert set(sorted(scores, key=scores.get)[-3:]) == {600, 601, 602}


def test_forest_does_not_depend_on_layout(spark, registry):
    df = planted(registry)
    spec = ForestSpec(trees=10)
    nodes = [sorted(map(tuple, forest.tree_nodes(d, spec=spec).collect()))
             for d in (df.repartition(1), df.repartition(7), df.orderBy(F.desc("pos")))]
    assert nodes[0] == nodes[1] == nodes[2]
    assert {r[0] for r in nodes[0]} == set(range(10))
    assert max(r[7] for r in nodes[0]) <= 8 and all(r[6] <= 256 for r in nodes[0])


def test_forest_scores_follow_the_node_table(spark, registry):
    """Scores recomputed by walking the node table row by row."""
    df = planted(registry).where("pos % 40 = 0 OR pos >= 600")
    spec = ForestSpec(trees=5, sample=16)
    nodes = {(r["tree"], r["node"]): r for r in forest.tree_nodes(df, spec=spec).collect()}
    model = forest.fit_forest(df, spec=spec)
    rows = forest.with_outlier_score(df, model).select("raw_score", *[
        c.alias(k) for k, c in forest.feature_columns().items()]).collect()
    for row in rows:
        total = 0.0
        for tree in range(5):
            n = nodes[tree, 0]
            while n["feature"] >= 0:
                low = row[forest.FEATURES[n["feature"]]] <= n["threshold"]
                n = nodes[tree, n["left"] if low else n["right"]]
            total += n["depth"] + float(forest.average_path(n["size"]))
        assert abs(row["raw_score"] - 2 ** (-total / 5 / float(forest.average_path(16)))) < 1e-12


def test_stored_forest_scores_like_the_fitted_one(spark, registry, tmp_path):
    df, spec = planted(registry), ForestSpec(trees=7, sample=32)
    forest.tree_nodes(df, spec=spec).repartition(3).write.parquet(str(tmp_path / "forest"))
    again = forest.forest_of(spark.read.parquet(str(tmp_path / "forest")))
    fitted = forest.fit_forest(df, spec=spec)
    scores = lambda model: sorted((r["pos"], r["raw_score"]) for r in forest.with_outlier_score(df, model).collect())
    assert scores(again) == scores(fitted)
    assert again.scale == float(forest.average_path(32)) and len(again.roots) == 7
    with pytest.raises(ValueError):
        forest.fit_forest(df.limit(0), spec=spec)


def test_draws_of_trees_are_even(spark, registry):
    """Each tree takes its own records, with no drift towards early or late ones."""
    spec = ForestSpec(trees=40, sample=50)
    taken = [sorted(range(2000), key=lambda p: ((a * p + b) % forest.PRIME, p))[:50] for a, b in forest.tree_hashes(spec)]
    middle = np.mean([np.mean(t) for t in taken])
    assert 900 < middle < 1100 and len({tuple(t) for t in taken}) == 40


def test_model_travels_without_the_package(spark, registry):
    """Executors read the broadcast with plain pickle, so it must not name this package."""
    assert b"ledgerlint" not in pickle.dumps(vars(forest.fit_forest(planted(registry))).copy())


def test_one_busy_hour_is_spread_over_tasks(spark):
    """30,000 decisions of one reviewer in one hour: no range holds many, gaps are those of the whole order."""
    rows = spark.range(30_000).select(
        F.col("id").alias("seq"), F.lit("r").alias("reviewer"),
        F.timestamp_micros(F.lit(1_600_000_000_000_000) + (F.col("id") * 7919 % 30_000) * 100_000).cast("timestamp_ntz").alias("reviewed_at"))
    sizes = effort.in_ranges(rows, ["reviewer", "reviewed_at", "seq"], 8).groupBy("_range").count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 6_000
    gaps = effort.review_gaps(rows, ["reviewer"], 8)
    assert gaps.where("gap_seconds IS NULL").count() == 1
    assert [r[0] for r in gaps.where("gap_seconds IS NOT NULL").select("gap_seconds").distinct().collect()] == [0.1]


def test_gaps_of_null_reviewers_and_times(spark):
    rows = [(1, None, "2024-01-01 10:00:00"), (2, None, "2024-01-01 10:00:05"), (3, "a", "2024-01-01 10:00:09"), (4, "a", None),
            (5, "a", "2024-01-01 10:00:10"), (5, "a", "2024-01-01 10:00:10")]
    log = spark.createDataFrame(rows, "seq long, reviewer string, t string").select("seq", "reviewer", F.col("t").cast("timestamp_ntz").alias("reviewed_at"))
    for ranges in (1, 3):
        got = sorted((r["seq"], r["gap_seconds"]) for r in effort.review_gaps(log, ["reviewer"], ranges).where("seq <> 4").collect() if r["gap_seconds"] is not None)
        assert got == [(2, 5.0), (5, 0.0), (5, 1.0)]
    assert effort.review_gaps(log.limit(0), ["reviewer"]).count() == 0


def test_synthetic_styles(spark, registry):
    cases = [("Block 5", "abbreviation", "Blk 5"), ("Tower", "abbreviation", "Tower"),
             ("Tower", "extra_word", "Tower Building"), ("Plaza", "typo", "Plzaa"), ("Mall", "typo", "Mall"),
             ("Plaza", "near_exact", "Plaza")]
    df = registry([dict(building_name=b) for b, _, _ in cases])
    styles = F.array(*[F.lit(s) for _, s, _ in cases])
    out = seeding.synthetic_duplicates(df.withColumn("style", F.get(styles, F.col("pos").cast("int"))))
    rows = out.orderBy("pos").collect()
    assert [r["building_name"] for r in rows] == [c[2] for c in cases]
    assert rows[0]["record_id"] == "R000-SEEDED"


def test_seeded_set_is_layout_independent_and_labelled(spark, registry):
    df = registry([dict(building_name=f"Tower {i}" if i % 3 else " ") for i in range(90)])
    one = {tuple(r) for r in seeding.seeded_test_set(df.repartition(1), 10, 5).collect()}
    two = {tuple(r) for r in seeding.seeded_test_set(df.repartition(6), 10, 5).collect()}
    assert one == two and len(one) == 100
    labels = [r[10] for r in one]
    assert labels.count("seeded") == 20 and labels.count("clean") == 5
    assert {r[0] for r in one if r[1].endswith("-SEEDED")} == set(range(90, 100))
    few = seeding.seeded_test_set(registry([{}] * 3), 10, 5)
    assert few.count() == 6 and few.where("label = 'clean'").count() == 0


def test_measures_with_empty_denominators(spark):
    df = spark.createDataFrame([(50, 0, 5, 20), (0, 0, 0, 0)], "tp long, fn long, fp long, tn long")
    full, empty = measures(df).orderBy(F.desc("tp")).collect()
    assert (full["precision"], full["recall"], full["f1"], full["false_positive_rate"]) == (
        0.909091, 1.0, 0.952381, 0.2)
    assert (empty["precision"], empty["recall"], empty["f1"], empty["false_positive_rate"]) == (0, 0, 0, 0)
