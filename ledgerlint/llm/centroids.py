"""Centroid clustering with heap-ordered bounds (operator 11).

Vectors are integers and all arithmetic on them is exact. A vector has an upper bound of the distance to
its own centroid and a lower bound of that to any other; while the gap between them is open it cannot change
sides. Moving centroids close the gaps of a cluster at one pace, the cluster's accumulated drift, so a vector
is kept in its cluster's heap under its gap plus the drift at that time, and expires when the drift reaches
that. A round pops what has expired from the tops of the heaps, rescans only that against all centroids, and
changes the sums of the clusters by the vectors that moved.

Vectors lie in blocks of bounded size. The blocks are placed once by their number and stay; a round joins
them with their heaps, which are a few bytes a vector and written each round, so a lost executor costs one
round at most. The driver sees sums per cluster and component, never a vector but the first centroids.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from ledgerlint.llm.worker import release
from ledgerlint.sources.tables import materialise

BLOCK_ROWS = 2048
SMALL = 1 << 27  # below this, squared distances of up to 128 components are exact in 64 bits
SLACK = 1e-9  # relative; covers the rounding of square roots and of sums of drifts
LIMB = 40  # bits of a digit of a sum
BLOCKS = "block long, ids binary, known binary, big boolean, data binary"
STATE = "block long, sizes array<int>, keys binary, members binary, moved array<struct<cluster:int,dim:int,limb:int,digit:long>>"


@dataclass(frozen=True)
class ClusterSpec:
    """``clusters`` centroids, ``rounds`` of moving them, components of a vector that is kept, the ``scale`` of
    the integers and the salt of the hash that draws the first centroids."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    salt: str = "3:"


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); 64-bit integers, or Python's where those could overflow later."""
    with np.errstate(over="ignore"):
        scaled = np.floor(rows * float(scale))
    if not rows.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    whole = lambda x: math.floor(x * scale) if abs(x) < 1e290 else int(x) * scale  # so large a double is whole
    return np.array([[whole(x) for x in row] for row in rows.tolist()], object)


def _packed(rows: np.ndarray) -> bytes:
    return rows.astype("<i4").tobytes() if rows.dtype != object else json.dumps(rows.tolist()).encode()


def _unpacked(data: bytes, big: bool, components: int, exact: bool) -> np.ndarray:
    rows = np.array(json.loads(data), object) if big else np.frombuffer(data, "<i4").astype(np.int64)
    return rows.reshape(-1, components).astype(object if exact else np.int64)


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centres."""
    out = np.empty((len(rows), len(centres)), rows.dtype)
    for c, centre in enumerate(centres):
        apart = rows - centre
        out[:, c] = (apart * apart).sum(axis=1)
    return out


def _roots(values: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, not below (``up``) or not above the true ones."""
    if values.dtype == object:
        whole = [math.isqrt(v) + up for v in values.tolist()]
        near = np.array([float(v) if v < 1 << 1000 else math.inf for v in whole])
    else:
        near = np.sqrt(values.astype(np.float64))
    return near * (1 + SLACK if up else 1 - SLACK)


class Heaps:
    """The heaps of a block: for each cluster, keys in ascending order (which is a heap) and their rows."""

    def __init__(self, keys: list[np.ndarray], members: list[np.ndarray]):
        self.keys, self.members = keys, members

    @classmethod
    def empty(cls, clusters: int) -> Heaps:
        return cls([np.zeros(0)] * clusters, [np.zeros(0, np.int32)] * clusters)

    @classmethod
    def of(cls, sizes, keys: bytes, members: bytes) -> Heaps:
        ends = np.cumsum(sizes)[:-1]
        return cls(np.split(np.frombuffer(keys, "<f8"), ends), np.split(np.frombuffer(members, "<i4"), ends))

    def pop(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, clusters) of what the drift has reached, taken out from the tops."""
        rows, clusters = [], []
        for c, reached in enumerate(drift):
            n = int(np.searchsorted(self.keys[c], reached, "right"))
            rows.append(self.members[c][:n])
            clusters.append(np.full(n, c))
            self.keys[c], self.members[c] = self.keys[c][n:], self.members[c][n:]
        return np.concatenate(rows), np.concatenate(clusters)

    def push(self, rows: np.ndarray, clusters: np.ndarray, keys: np.ndarray) -> None:
        for c in np.unique(clusters).tolist():
            new = clusters == c
            order = np.argsort(keys[new], kind="stable")
            at = np.searchsorted(self.keys[c], keys[new][order])
            self.keys[c] = np.insert(self.keys[c], at, keys[new][order])
            self.members[c] = np.insert(self.members[c], at, rows[new][order])

    def columns(self) -> tuple[list[int], bytes, bytes]:
        return ([len(k) for k in self.keys], np.concatenate(self.keys).astype("<f8").tobytes(),
                np.concatenate(self.members).astype("<i4").tobytes())


def rescan(rows: np.ndarray, old: np.ndarray, at: np.ndarray, heaps: Heaps, centres: np.ndarray,
           drift: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Assign the rows numbered ``at`` anew, from clusters ``old`` (-1: none), and push them. Returns by how much the
    sums of the clusters change: (cluster, component, limb, digit), the count as a last component."""
    far = squared(rows[at], centres)
    near = far.argmin(axis=1) if len(at) else np.zeros(0, np.int64)  # the first of equal ones
    own = far[np.arange(len(at)), near]
    if len(centres) > 1:
        far[np.arange(len(at)), near] = far.max() if far.size else 0
        other = far.min(axis=1) if len(at) else own
        with np.errstate(invalid="ignore"):
            gap = _roots(other, False) - _roots(own, True) + drift[near]
        gap = np.where(np.isnan(gap), -np.inf, gap)
    else:
        gap = np.full(len(at), np.inf)
    heaps.push(at.astype(np.int32), near, gap)
    moved = near != old
    out = []
    for sign, clusters in ((1, near[moved]), (-1, old[moved])):
        for c in np.unique(clusters[clusters >= 0]).tolist():
            mine = rows[at[moved][clusters == c]]
            for dim, total in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                out += [(c, dim, limb, sign * digit) for limb, digit in _digits(int(total))]
    return out


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield limb, sign * (value & (1 << LIMB) - 1)
        value, limb = value >> LIMB, limb + 1


def _kept(vectors: DataFrame, spec: ClusterSpec) -> DataFrame:
    """vec_id and x of the vectors with the right number of components, none null or non-finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.coalesce((F.size("x") == spec.components) & finite, F.lit(False)))


def _blocks(vectors: DataFrame, spec: ClusterSpec) -> DataFrame:
    """The kept vectors in blocks (BLOCKS), made inside each task of the scan."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for k in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(k, BLOCK_ROWS)
                rows = integers(part["x"].flatten().to_numpy().reshape(-1, spec.components), spec.scale)
                ids, known = part["vec_id"].fill_null(0), part["vec_id"].is_valid()
                yield _row(BLOCKS, [n, ids.to_numpy().astype("<i8").tobytes(), known.to_numpy(zero_copy_only=False).astype("u1").tobytes(),
                                    rows.dtype == object, _packed(rows)])
                n += 1

    return materialise(_kept(vectors, spec).mapInArrow(blocks, BLOCKS), "blocks")


def _first_centres(vectors: DataFrame, spec: ClusterSpec) -> np.ndarray:
    """The first vectors by a hash of vec_id; null ids come last, rows with equal ids by their components."""
    hashed = F.sha2(F.concat(F.lit(spec.salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = _kept(vectors, spec).orderBy(hashed.asc_nulls_last(), "x").limit(spec.clusters).collect()
    return integers(np.array([r["x"] for r in first], np.float64).reshape(-1, spec.components), spec.scale)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()),
          "string": pa.string(), "array<struct<cluster:int,dim:int,limb:int,digit:long>>": pa.list_(pa.struct(
              [("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("digit", pa.int64())]))}


def _row(schema: str, values: list) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], _TYPES[t]) for v, (_, t) in zip(values, fields)], [n for n, _ in fields])


def _state(block: int, heaps: Heaps, moved: list) -> pa.RecordBatch:
    named = [dict(zip(("cluster", "dim", "limb", "digit"), m)) for m in moved]
    return _row(STATE, [block, *heaps.columns(), named])


def _scan(batches: Iterator[pa.RecordBatch], spec: ClusterSpec, exact: bool):
    """(row of a block and its heaps as a dict, vectors) one after the other."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
            yield row, _unpacked(row.pop("data"), row["big"], spec.components, exact)


def _popped(row: dict, rows: np.ndarray, centres: np.ndarray, drift: np.ndarray) -> tuple[Heaps, list]:
    heaps = Heaps.of(row["sizes"], row["keys"], row["members"])
    at, old = heaps.pop(drift)
    return heaps, rescan(rows, old, at, heaps, centres, drift)


def _changed(sums: list[list[int]], state: DataFrame) -> None:
    """Add what moved in a round to the sums; a row per cluster, component and limb is collected."""
    moved = state.select(F.explode("moved").alias("m")).groupBy("m.cluster", "m.dim", "m.limb").agg(
        F.sum(F.col("m.digit").cast("decimal(38,0)")).alias("total"))
    for r in moved.collect():
        sums[r["cluster"]][r["dim"]] += int(r["total"]) << LIMB * r["limb"] if r["total"] >= 0 else -(-int(r["total"]) << LIMB * r["limb"])


def clustered(vectors: DataFrame, spec: ClusterSpec = ClusterSpec()) -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): vec_id, cluster and squared distance (null beyond 64 bits) of every kept vector, and
    the components of the centroids they were last assigned to.

    Vectors that are null, of another length or hold a null or non-finite component are left out. Rows with one
    vec_id, or none, are vectors of their own. There are as many centroids as kept vectors if those are fewer
    than ``clusters``; without any there are no rows.
    """
    blocks = _blocks(vectors, spec)
    first = _first_centres(vectors, spec)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    exact = bool(blocks.agg(F.max("big")).first()[0]) or first.dtype == object
    centres = first.astype(object if exact else np.int64)
    k, drift, nothing = len(centres), np.zeros(len(centres)), np.zeros(len(centres))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = blocks.select("block", "big", "data").repartition(n, "block").persist(StorageLevel.MEMORY_AND_DISK)

    def begin(batches):
        for row, rows in _scan(batches, spec, exact):
            heaps = Heaps.empty(k)
            every = np.arange(len(rows))
            yield _state(row["block"], heaps, rescan(rows, np.full(len(rows), -1), every, heaps, centres, nothing))

    def go_on(now: np.ndarray, reached: np.ndarray):
        def step(batches):
            for row, rows in _scan(batches, spec, exact):
                heaps, moved = _popped(row, rows, now, reached)
                yield _state(row["block"], heaps, moved)
        return step

    state = materialise(placed.mapInArrow(begin, STATE), "heaps-0")
    sums = [[0] * (spec.components + 1) for _ in range(k)]
    for r in range(spec.rounds):
        _changed(sums, state)
        moved = np.array([[s // own[-1] for s in own[:-1]] if own[-1] else old for own, old in zip(sums, centres.tolist())], centres.dtype)
        if (moved == centres).all():
            break  # so would be all further rounds
        far = _roots(((moved - centres) ** 2).sum(axis=1), True)
        centres = moved
        drift = drift + far + np.array([max(np.delete(far, c), default=0.0) for c in range(k)])
        if r + 1 < spec.rounds:
            state = materialise(placed.join(state.drop("moved"), "block").mapInArrow(go_on(centres, drift), STATE), f"heaps-{r + 1}")

    def end(batches):
        for row, rows in _scan(batches, spec, exact):
            heaps, _ = _popped(row, rows, centres, drift)
            at, cluster = np.concatenate(heaps.members), np.repeat(np.arange(k), [len(m) for m in heaps.members])
            far = rows[at] - centres[cluster]
            far = (far * far).sum(axis=1).tolist()
            ids, known = np.frombuffer(row["ids"], "<i8")[at], np.frombuffer(row["known"], "u1")[at] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~known), pa.array(cluster, pa.int32()), pa.array([d if d < 1 << 63 else None for d in far], pa.int64())],
                ["vec_id", "cluster", "distance"])

    last = blocks.join(state.drop("moved"), "block").mapInArrow(end, "vec_id long, cluster int, distance long")
    rows = materialise(last, "clustered")
    placed.unpersist()
    return rows, centres.tolist()


def cluster_digest(vectors: DataFrame, spec: ClusterSpec = ClusterSpec()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector; sums beyond 64
    bits are null."""
    rows, centres = clustered(vectors, spec)
    wide = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"),
                                       F.count_if(F.col("distance").isNull()).alias("open")).collect()  # a row per cluster
    total = lambda rs: None if any(r["open"] for r in rs) else (lambda s: s if s < 1 << 63 else None)(int(sum(r["s"] for r in rs)))
    sha = lambda c: hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
    facts = [(r["cluster"], total([r]), total(wide), sha(r["cluster"])) for r in wide]
    small = rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(spec: ClusterSpec = ClusterSpec()) -> str:
    """:func:`cluster_digest` in DuckDB's SQL: every round in full, without bounds."""
    apart = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assigned = lambda i: f"""a{i} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := {apart}, c := c.c)) AS best FROM kept k, c{i} c GROUP BY r)"""
    moved = lambda i: f"""s{i} AS (
  SELECT best.c AS c, dim, sum(v[dim])::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM a{i} JOIN kept USING (r), range(1, {spec.components + 1}) t(dim) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (
  SELECT old.c AS c, coalesce(new.v, old.v) AS v FROM c{i} old LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY dim) AS v FROM s{i} GROUP BY c) new ON old.c = new.c)"""
    steps = ",\n".join(x for i in range(spec.rounds) for x in (assigned(i), moved(i)))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor({spec.scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = {spec.components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {spec.components}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('{spec.salt}' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {spec.clusters})),
{steps},
{assigned(spec.rounds)},
each AS (SELECT vec_id, best.c AS c, best.d AS d FROM a{spec.rounds} JOIN kept USING (r))
SELECT vec_id, each.c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY each.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM each JOIN c{spec.rounds} f ON f.c = each.c"""
