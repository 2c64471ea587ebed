"""Embedding near-duplicates in cells of spherical k-means (operator 6).

Vectors of one label are assigned to the nearest of its centroids, fitted on a bounded sample. Two
vectors may link although their cells differ: so a vector is also a guest in every other cell that
one of its links could have as home, by the distance to the plane between both centroids. That
makes the search whole, however good the centroids are. Within a cell, home rows are multiplied
with home and guest rows in blocks; each block pair is one group of bounded size, also where a cell
holds most rows. A group gives a number of links per home row and, for the links of a block pair,
a spanning forest of them, never the pairs. Equal vectors are one row with a weight throughout.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlint.llm.components import components
from ledgerlint.sources.tables import materialise

THRESHOLD = 0.93
CELL_ROWS = 2048  # wanted rows of a cell
SAMPLE_ROWS = 4096  # rows of a label that its centroids are fitted on, at most
MOST_CELLS = 4096  # centroids of all labels together; the largest labels come first
BLOCK_ROWS = 1024
ROUNDS = 12
SLACK = 1e-9


def unit_row(vector) -> np.ndarray:
    v = np.asarray(vector, np.float64)
    v = v / np.abs(v).max()  # scaled first, so that no square over- or underflows
    return v / np.sqrt(v @ v)


def usable(vec: str):
    """Not null, not all zero, no null or non-finite component."""
    c = F.col(vec).cast("array<double>")
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def fit_cells(rows: np.ndarray, k: int, seed: int = 6) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return np.unique(centres, axis=0)


def cell_numbers(rows: np.ndarray, centres: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, is_home) for the home and guest cells of each row."""
    n = len(rows)
    if centres is None:
        return np.arange(n), np.zeros(n, np.int64), np.ones(n, bool)
    near = rows @ centres.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))[home]
    reach = np.sqrt(2 - 2 * threshold)
    visits = near[np.arange(n), home][:, None] - near <= reach * apart + SLACK
    visits[np.arange(n), home] = True
    row, cell = np.nonzero(visits)
    return row, cell, cell == home[row]


def spanning(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smaller, larger) that connect what a boolean matrix of links between ids connects."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i in np.flatnonzero(links.any(axis=1)):
        x = int(a[i])
        for y in b[links[i]].tolist():
            if y != x:
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    out.append((min(x, y), max(x, y)))
    return out


def _compare(threshold: float):
    def compared(group: pd.DataFrame) -> pd.DataFrame:
        left, right = group[group["is_left"]], group[~group["is_left"]]
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        x, y = np.stack(left["unit"].to_numpy()), np.stack(right["unit"].to_numpy())
        a, b, weight = left["id"].to_numpy(), right["id"].to_numpy(), right["weight"].to_numpy()
        links = x @ y.T >= threshold
        links &= a[:, None] != b[None, :]
        found = links @ weight
        linked = found > 0
        edges = spanning(links, a, b)
        return pd.DataFrame({"a": np.concatenate([a[linked], [e[0] for e in edges]]).astype("int64"),
                             "b": np.concatenate([a[linked], [e[1] for e in edges]]).astype("int64"),
                             "n": np.concatenate([found[linked], np.zeros(len(edges), int)]).astype("int64")})
    return compared


def _centroids(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Centroids by label, for labels of more than CELL_ROWS vectors; MOST_CELLS in all."""
    large = (distinct.groupBy("label").count().where(F.col("count") > CELL_ROWS)
             .orderBy(F.desc("count"), "label").limit(MOST_CELLS // 2).collect())
    wanted, left = {}, MOST_CELLS
    for r in large:
        k = min(-(-r["count"] // CELL_ROWS), SAMPLE_ROWS // 8, left)
        if k > 1:
            wanted[r["label"]], left = (k, r["count"]), left - k
    if not wanted:
        return {}
    rates = distinct.sparkSession.createDataFrame(
        [(label, k, min(1.0, 2.0 * SAMPLE_ROWS / n)) for label, (k, n) in wanted.items()], "label long, k long, rate double")
    h = F.pmod(F.xxhash64("unit"), F.lit(1 << 30))
    drawn = distinct.join(F.broadcast(rates), "label").where(h < F.col("rate") * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("unit"), "id"))
    drawn = drawn.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_ROWS).select("label", "k", "unit")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        length = group["unit"].map(len).mode()[0]  # rows of other lengths do without cells
        rows = np.stack(group["unit"][group["unit"].map(len) == length].to_numpy())
        centres = fit_cells(rows, min(int(group["k"].iloc[0]), len(rows)))
        return pd.DataFrame({"label": group["label"].iloc[0], "centre": list(centres)})

    out: dict[int, list] = {}
    for r in drawn.groupBy("label").applyInPandas(fit, "label long, centre array<double>").collect():
        out.setdefault(r["label"], []).append(r["centre"])
    return {label: np.array(sorted(c)) for label, c in out.items()}


def links(embeddings: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(vectors, counts and edges): ``vectors`` has vec_id, label, and ``id``, the smallest vec_id of
    the equal usable vectors of a label (null: links with nothing); the other (a, b, n) has n > 0 for
    links of a to vectors not equal to it, and n = 0 for an edge between ids."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"),
                             F.col("embedding").cast("array<double>").alias("vec"))
    good = rows.where(F.col("label").isNotNull() & usable("vec") & F.col("vec_id").isNotNull())
    unit = F.pandas_udf(lambda v: pd.Series([unit_row(x) for x in v], dtype=object), "array<double>")
    good = good.select("vec_id", "label", unit("vec").alias("unit"), F.size("vec").alias("dims"))
    keyed = materialise(good, "units")
    firsts = keyed.groupBy("label", "unit", "dims").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    distinct = materialise(firsts, "distinct-vectors")
    centres = spark.sparkContext.broadcast(_centroids(distinct))

    def placed(batches):
        for batch in batches:
            for (label, dims), part in batch.groupby(["label", "dims"], sort=False):
                c = centres.value.get(label)
                c = c if c is not None and c.shape[1] == dims else None
                row, cell, home = cell_numbers(np.stack(part["unit"].to_numpy()), c, threshold)
                out = part.iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell, is_home=home)

    cells = materialise(distinct.mapInPandas(
        placed, "label long, unit array<double>, dims int, id long, weight long, cell long, is_home boolean"), "cells")
    where = ["label", "dims", "cell"]
    sizes = cells.groupBy(*where).agg(
        F.ceil(F.count_if("is_home") / BLOCK_ROWS).cast("int").alias("lefts"),
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("rights")).where("lefts > 0")
    joined = cells.join(sizes, where)
    lot = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    left = joined.where("is_home").withColumn("i", (lot % F.col("lefts")).cast("int")).withColumn(
        "j", F.explode(F.sequence(F.lit(0), F.col("rights") - 1))).withColumn("is_left", F.lit(True))
    right = joined.withColumn("j", (lot % F.col("rights")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))).withColumn("is_left", F.lit(False))
    columns = [*where, "i", "j", "is_left", "id", "unit", "weight"]
    pairs = left.select(*columns).unionByName(right.select(*columns))
    found = pairs.groupBy(*where, "i", "j").applyInPandas(_compare(threshold), "a long, b long, n long")
    vectors = keyed.join(distinct.select("label", "unit", "dims", "id", "weight"), ["label", "unit", "dims"]).select(
        "vec_id", "id", "weight")
    return vectors, materialise(found, "links")


def vector_digest(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. Rows without a label and vectors that are
    null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    lengths do not link; a null vec_id stands alone. An empty table gives no rows."""
    vectors, found = links(embeddings, threshold)
    counts = found.where("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"))
    member = components(found.where("n = 0").select("a", "b")).withColumnRenamed("node", "id")
    facts = vectors.join(counts, "id", "left").join(member, "id", "left").select(
        F.col("vec_id").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("_n"),
        F.coalesce("component", "id").alias("_c"))
    facts = materialise(facts, "vector-facts")
    out = embeddings.select(F.col("vec_id").cast("long"), F.col("label").isNotNull().alias("_l"),
                            (F.col("label").isNotNull() & usable("embedding")).alias("_ok"))
    facts = facts.groupBy("_v").agg(F.max("_n").alias("_n"), F.min("_c").alias("_c"))
    return (out.join(facts, F.col("vec_id") == F.col("_v"), "left")
            .withColumn("n_links", F.when(F.col("_ok"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long"))
            .withColumn("component_id", F.when(F.col("_ok"), F.coalesce("_c", "vec_id")).otherwise(F.col("vec_id")))
            .select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
