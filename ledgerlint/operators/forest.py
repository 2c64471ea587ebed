"""Isolation forest (Liu, Ting & Zhou 2008): trees built per group, scores per Arrow batch.

Every draw is a hash: which records a tree takes, and a node's feature and cut. So a forest is the same under any
partitioning, on any engine that computes the same hashes, and as a stored table of nodes. Node k of a tree has
the nodes 2k + 1 (at most the threshold) and 2k + 2 below it; the root is node 0.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ledgerlint.specs import Fields, ForestSpec

FEATURES = ["lat", "lon", "missing_postal", "missing_road", "missing_hours", "building_length",
            "description_length"]
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, size int, "
               "depth int")


def feature_columns(f: Fields = Fields()) -> dict[str, Column]:
    """The seven numeric features; what is still missing becomes 0."""
    missing = lambda name: F.col(name).isNull().cast("double")
    length = lambda name: F.length(F.coalesce(F.col(name), F.lit(""))).cast("double")
    number = lambda name: F.coalesce(F.nanvl(F.col(name), F.lit(0.0)), F.lit(0.0))
    return dict(zip(FEATURES, [number(f.lat), number(f.lon), missing(f.postal), missing(f.road),
                               missing(f.hours), length(f.building), length(f.descr)]))


def feature_vector(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    return df.select(f.id, *[c.alias(k) for k, c in feature_columns(f).items()])


def average_path(n) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


PRIME = 2**31 - 1
NUMBERS = 2**32


def _numbers(text: str) -> tuple[int, int]:
    """Two 32-bit numbers, the first digits of a hash."""
    digest = hashlib.md5(text.encode()).hexdigest()
    return int(digest[:8], 16), int(digest[8:16], 16)


def tree_hashes(spec: ForestSpec) -> list[tuple[int, int]]:
    """(factor, offset) of each tree: it takes the records with the lowest (factor * pos + offset) modulo PRIME."""
    drawn = [_numbers(f"{spec.seed}:{t}") for t in range(spec.trees)]
    return [(a % (PRIME - 1) + 1, b % PRIME) for a, b in drawn]


def depth_limit(sample: int) -> int:
    return int(np.ceil(np.log2(max(sample, 2))))


def _tree(rows: pd.DataFrame, seed: int, sample: int) -> pd.DataFrame:
    """One tree from at most ``sample`` rows: of the features that vary in a node one, and a cut between its least and
    greatest value, as the hash of the node says."""
    tree = int(rows["tree"].iloc[0])
    x = rows.sort_values("key")[FEATURES].to_numpy()
    limit = depth_limit(sample)
    nodes, waiting = [], [(np.arange(len(x)), 0, 0)]
    while waiting:
        members, node, depth = waiting.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(varying) == 0:
            nodes.append((tree, node, -1, 0.0, node, node, len(members), depth))
            continue
        which, where = _numbers(f"{seed}:{tree}:{node}")
        feature = int(varying[which % len(varying)])
        cut = float(low[feature] + (high[feature] - low[feature]) * (where / NUMBERS))
        if cut >= high[feature]:
            cut = float(low[feature])
        below = part[:, feature] <= cut
        nodes.append((tree, node, feature, cut, 2 * node + 1, 2 * node + 2, len(members), depth))
        waiting += [(members[below], 2 * node + 1, depth + 1), (members[~below], 2 * node + 2, depth + 1)]
    return pd.DataFrame(nodes, columns=[p.split()[0] for p in NODE_SCHEMA.split(", ")])


@dataclass(frozen=True)
class Forest:
    """A fitted forest: per node feature, threshold and children as offsets into one list, and
    the path length at its end. ``trees * (2 * sample - 1)`` nodes at most, whatever the table."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    levels: int
    scale: float


def isolation_scores(forest: dict, x: np.ndarray) -> np.ndarray:
    """Scores of a batch of feature rows; ``forest`` holds the fields of :class:`Forest`."""
    feature, threshold, left, right = (forest[k] for k in ("feature", "threshold", "left", "right"))
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root in forest["roots"]:
        at = np.full(len(x), root)
        for _ in range(forest["levels"]):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        total += forest["path"][at]
    return np.exp2(-total / len(forest["roots"]) / forest["scale"])


def tree_nodes(df: DataFrame, f: Fields = Fields(), spec: ForestSpec = ForestSpec(),
               n_rows: int | None = None) -> DataFrame:
    """The node table of a forest fitted to ``df``: write it to keep the model, see :func:`forest_of`.

    Tree t takes the ``sample`` rows with the smallest hash of the order key: the same rows under any
    partitioning. A row joins a tree's draw only below a hash bound that lets about four times the sample
    through, or all rows where that could be too few, so the draw does not grow with the table.
    """
    n_rows = df.count() if n_rows is None else n_rows
    share = 4 * spec.sample / max(n_rows, 1)
    bound = int(share * PRIME) if share < 1 else PRIME
    pairs = F.lit([v for pair in tree_hashes(spec) for v in pair]).cast("array<long>")
    place = F.pmod(F.col(f.pos).cast("long"), F.lit(PRIME))
    draws = F.transform(F.sequence(F.lit(0), F.lit(spec.trees - 1)), lambda t: F.struct(t.alias("tree"), (
        (F.get(pairs, 2 * t) * place + F.get(pairs, 2 * t + 1)) % PRIME).alias("h")))
    drawn = df.select(F.explode(F.filter(draws, lambda d: d.getField("h") <= bound)).alias("d"),
                      F.col(f.pos).alias("key"),
                      *[c.alias(k) for k, c in feature_columns(f).items()])
    drawn = drawn.select("d.*", "key", *FEATURES)
    order = Window.partitionBy("tree").orderBy("h", "key")
    chosen = drawn.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= spec.sample)
    seed, sample = spec.seed, min(spec.sample, max(n_rows, 1))
    return chosen.select("tree", "key", *FEATURES).groupBy("tree").applyInPandas(
        lambda rows: _tree(rows, seed, sample), NODE_SCHEMA)


def forest_of(nodes: DataFrame) -> Forest:
    """The forest of a table of nodes, just fitted or stored; bounded by its spec, not by the records."""
    table = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    if table.empty:
        raise ValueError("a forest needs at least one record")
    key = table["tree"].to_numpy().astype(np.int64) << 32 | table["node"].to_numpy()
    at = lambda child: np.searchsorted(key, table["tree"].to_numpy().astype(np.int64) << 32 | table[child].to_numpy())
    # leaves lead to themselves: feature 0 is compared, both ways stay
    return Forest(
        roots=np.flatnonzero(table["node"].to_numpy() == 0), feature=np.maximum(table["feature"].to_numpy(), 0),
        threshold=table["threshold"].to_numpy(), left=at("left"), right=at("right"),
        path=table["depth"].to_numpy() + average_path(table["size"].to_numpy()),
        levels=int(table["depth"].max()),
        scale=float(average_path(int(table["size"].max()))) or 1.0)


def fit_forest(df: DataFrame, f: Fields = Fields(), spec: ForestSpec = ForestSpec()) -> Forest:
    return forest_of(tree_nodes(df, f, spec))


def with_outlier_score(df: DataFrame, forest: Forest, f: Fields = Fields()) -> DataFrame:
    """Add ``raw_score`` in (0, 1], larger for records that are easier to isolate."""
    # plain arrays: what is broadcast must be readable where this package is not installed
    shared = df.sparkSession.sparkContext.broadcast(vars(forest).copy())

    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(isolation_scores(
            shared.value, np.column_stack([c.to_numpy() for c in columns])))

    udf = pandas_udf(score, returnType=DoubleType())
    return df.withColumn("raw_score", udf(*feature_columns(f).values()))
