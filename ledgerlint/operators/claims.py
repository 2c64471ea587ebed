"""Greedy claims over a graph of matches, without a round per link of a chain.

In record order a node leads unless an earlier neighbour leads, and a leader claims its later neighbours. Small
blocks are read through in order, one task each. Larger ones are a system of clauses, one per node: it leads if
none of its literals holds, a literal being "u leads" or "u does not lead" for an earlier node u.

* The clauses are cut into ranges of the order, however large a block is, and a task reads a range in order.
  What lies before the range is unknown, but a clause whose literals fall together to one says that its node
  does, or does not, as an earlier one does; so the nodes of a chain through a range all come to depend on
  the last node before it.
* What is known by then is put in, and nodes that no clause names are set aside. What stays of a chain is a node
  per range, so the next round has far fewer ranges. The first range of all is known entirely each round,
  whatever the graph.
* In the end the nodes set aside take their answer from those they name, round by round backwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from ledgerlint.sources.tables import materialise

CLAUSES = "block string, v long, u long, but boolean, hit boolean"
FOLDED = "block string, v long, u long, but boolean, size int, leads boolean"


def _fold(edges: pd.DataFrame) -> pd.DataFrame:
    """Claims of one block from its few edges, in record order."""
    claimed: dict[int, int] = {}
    for left, right in edges[["left", "right"]].sort_values(["left", "right"]).itertuples(index=False):
        if left not in claimed and right not in claimed:
            claimed[right] = left
    return pd.DataFrame({"vid": list(claimed), "leader": list(claimed.values())}, dtype="int64")


class RangeFold:
    """Reads the clauses of a range in order and says of each node that it leads, that it does not, or by what
    literals that is decided. ``same[v] = (u, but)``: v leads as u does, or with ``but`` as u does not."""

    def __init__(self):
        self.known: dict[int, bool] = {}
        self.same: dict[int, tuple[int, bool]] = {}

    def clause(self, v: int, literals: list[tuple[int | None, bool, bool]]) -> tuple[bool | None, list[tuple[int, bool]]]:
        """(leads, literals left) of node v. A literal (u, but, hit) holds if u leads, with ``but`` if it does not; without
        a u it holds if ``hit``."""
        left: set[tuple[int, bool]] = set()
        for u, but, hit in literals:
            if u is None:
                holds = hit
            elif u in self.known:
                holds = self.known[u] != but
            else:
                root, other = self.same.get(u, (u, False))
                own = (root, other != but)
                holds = (root, not own[1]) in left  # one of both does
                left.add(own)
            if holds:
                self.known[v] = False
                return False, []
        if not left:
            self.known[v] = True
            return True, []
        if len(left) == 1:
            (u, but), = left
            self.same[v] = (u, not but)
        return None, sorted(left)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FOLDED from CLAUSES that come sorted by (block, v)."""
    fold, out = RangeFold(), []
    at, block, literals = None, None, []

    def close():
        leads, left = fold.clause(at, literals)
        if leads is None:
            out.extend((block, at, u, but, len(left), None) for u, but in left)
        else:
            out.append((block, at, None, False, 0, leads))

    def rows():
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in FOLDED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for batch in batches:
        for own_block, v, u, but, hit in zip(*[batch[c].to_pylist() for c in ("block", "v", "u", "but", "hit")]):
            if v != at and at is not None:
                close()
                literals = []
            at, block = v, own_block
            literals.append((u, but, hit))
        if out:
            yield rows()
            out = []
    if at is not None:
        close()
        yield rows()


def leading_nodes(edges: DataFrame, n_edges: int, fold_edges: int) -> DataFrame:
    """(vid, leads) of every node of a table of ``n_edges`` edges (block, left, right) with left < right."""
    none = [F.lit(False).alias("but"), F.lit(False).alias("hit")]
    clauses = edges.select("block", F.col("right").alias("v"), F.col("left").alias("u"), *none).unionByName(
        edges.select("block", F.col("left").alias("v"), F.lit(None).cast("long").alias("u"), *none))  # no literal
    widest = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known, aside, n = [], [], 2 * n_edges
    while n:
        ranges = max(1, min(widest, math.ceil(n / max(1, fold_edges))))
        ordered = (clauses.repartitionByRange(ranges, "block", "v") if ranges > 1 else clauses.coalesce(1)).sortWithinPartitions("block", "v")
        folded = materialise(ordered.mapInArrow(_folded, FOLDED), "folded")
        known.append(folded.where("leads IS NOT NULL").select(F.col("v").alias("vid"), "leads"))
        if ranges == 1:
            break
        told = known[-1].select(F.col("vid").alias("u"), "leads")
        left = folded.where("u IS NOT NULL").select("block", "v", "u", "but").join(told, "u", "left")
        left = materialise(left.select(
            "block", "v", F.when(F.col("leads").isNull(), F.col("u")).alias("u"), "but",
            F.coalesce(F.col("leads") != F.col("but"), F.lit(False)).alias("hit")), "clauses-left")
        named = left.where("u IS NOT NULL").select(F.col("u").alias("v")).distinct()
        aside.append(left.join(named, "v", "left_anti"))
        counted = Observation()
        clauses = materialise(left.join(named, "v", "left_semi").observe(counted, F.count(F.lit(1)).alias("n")).select(
            *[c.split()[0] for c in CLAUSES.split(", ")]), "clauses")
        n = counted.get["n"]
    values = reduce(DataFrame.unionByName, known)
    for rest in reversed(aside):
        told = rest.join(values.withColumnRenamed("vid", "u"), "u", "left")
        holds = F.col("hit") | F.coalesce(F.col("leads") != F.col("but"), F.lit(False))
        values = values.unionByName(materialise(
            told.groupBy(F.col("v").alias("vid")).agg((~F.max(holds)).alias("leads")), "told"))
    return values


def resolve_claims(edges: DataFrame, fold_edges: int) -> DataFrame:
    """(vid, leader) of every claimed node of a written edge table (block, left, right). Blocks are folded by
    themselves if none has more than ``fold_edges`` edges; the claiming leader is the lowest among all neighbours."""
    most, n_edges = edges.groupBy("block").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most or 0) <= fold_edges:
        return edges.select("block", "left", "right").groupBy("block").applyInPandas(_fold, "vid long, leader long")
    leaders = leading_nodes(edges.select("block", "left", "right"), n_edges, fold_edges).where("leads").select(F.col("vid").alias("left"))
    return edges.join(leaders, "left", "left_semi").groupBy(F.col("right").alias("vid")).agg(F.min("left").alias("leader"))
