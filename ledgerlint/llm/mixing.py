"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 4).

The documents of a source are laid out in ``blocks`` blocks by a hash. A source's target becomes a
quota of blocks: whole epochs of all its blocks, then further blocks, each once, in the order of a
permutation, the last of them in part. The quotas of all sources are split among the output shards
by a tree: at each node the left half of the shards gets a multivariate-hypergeometric draw of the
node's blocks, the right half the rest, so shards have exact sizes and the quotas are met exactly.
A shard's blocks of a source are the next in the permutation, disjoint from all other shards', and
rows are shuffled by a hash inside their shard.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlint.sources.tables import materialise

WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSpec:
    """Weights repeat over the sources in order; ``most`` is how often a document may be taken."""

    weights: tuple[float, ...] = (1, 2, 3)
    most: int = 3
    blocks: int = 256
    shards: int | None = None  # the session's number of shuffle partitions
    seed: int = 4


def water_fill(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; what is cut off goes to
    the others by weight, until none is above."""
    total, target = float(sum(sizes)), [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if share * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                target[i] = share * weights[i]
            break
        for i in full:
            target[i] = float(most * sizes[i])
        left = total - sum(target[i] for i in range(len(sizes)) if i not in free or i in full)
        free = [i for i in free if i not in full]
    return target


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: exact quotas in total, shard sizes as even as can be."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    drawn = rng.multivariate_hypergeometric(quotas, total * left // shards, method="marginals")
    return np.concatenate([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def _size():
    return F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")


def _place(spec: MixSpec):
    return F.xxhash64(F.col("doc_id").cast("long"), F.hash("text"), F.lit(spec.seed))


def _block(h: str, spec: MixSpec):
    return F.pmod(F.col(h), F.lit(spec.blocks)).cast("int")


def sized(docs: DataFrame, spec: MixSpec) -> DataFrame:
    """doc_id, source, size, h and block of every row; a null text has size 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), _size().alias("size"),
                       _place(spec).alias("h")).withColumn("block", _block("h", spec))


def _shards(docs: DataFrame, spec: MixSpec) -> int:
    return spec.shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def plan(blocks: DataFrame, spec: MixSpec, shards: int) -> tuple[list[tuple], list[tuple]]:
    """From block sizes (source, block, words): rows (source, source_size, target) and rows
    (source, block, copy, shard, share of the block). One row per source and block is collected: as
    many as there are sources to weigh, times ``spec.blocks``."""
    rows = blocks.select("source", "block", "words").collect()
    per: dict = {}
    for r in rows:
        per.setdefault(r["source"], {})[r["block"]] = r["words"]
    sources = sorted((s for s in per if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in per else [])
    sizes = [sum(per[s].values()) for s in sources]
    weights = [spec.weights[i % len(spec.weights)] for i in range(len(sources))]
    targets = water_fill(sizes, weights, spec.most)
    units: list[list[tuple]] = []
    for i, (s, size, target) in enumerate(zip(sources, sizes, targets)):
        own = sorted(per[s])
        order = np.random.default_rng([spec.seed, i]).permutation(len(own))
        epochs = int(target // size) if size else 0
        drawn = [(own[b], c, 1.0) for c in range(epochs) for b in np.random.default_rng([spec.seed, i, c]).permutation(len(own))]
        rest = target - epochs * size
        for b in order:
            words = per[s][own[b]]
            if rest < 0.5:
                break
            if words:
                drawn.append((own[b], epochs, min(1.0, rest / words)))
                rest -= min(rest, words)
        units.append(drawn)
    counts = split_tree(np.array([len(u) for u in units], np.int64), shards, np.random.default_rng(spec.seed)) \
        if units else np.zeros((shards, 0), np.int64)
    placed = []
    for i, s in enumerate(sources):
        shard = np.repeat(np.arange(shards), counts[:, i])
        placed += [(s, int(b), int(c), int(k), float(f)) for (b, c, f), k in zip(units[i], shard)]
    return list(zip(sources, sizes, targets)), placed


def _drawn(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """``rows`` (with source, size, block, h) once for each time they are taken, with copy, shard and
    words, less than size only for one document of a source's last block."""
    # sources x blocks x most rows, however many documents
    taken = rows.join(F.broadcast(draws), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    taken = taken.drop("_source", "_block")
    block = Window.partitionBy("source", "block")  # the one block of a source that is taken in part
    before = F.sum("size").over(block.orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    want = F.round(F.col("share") * F.sum("size").over(block)).cast("long") - F.coalesce(before, F.lit(0))
    part = taken.where("share < 1").withColumn("words", F.greatest(F.lit(0), F.least(F.col("size"), want)))
    return taken.where("share >= 1").withColumn("words", F.col("size")).unionByName(part.where("words > 0"))


def mixture(docs: DataFrame, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, draws, sources). ``rows``: doc_id, source, size, h, block of every document. ``draws``:
    what is taken of each block, with copy and shard. ``sources``: source, source_size, target."""
    spark = docs.sparkSession
    rows = materialise(sized(docs, spec), "sizes")
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sources, placed = plan(blocks, spec, _shards(docs, spec))
    return (rows, spark.createDataFrame(placed, "_source string, _block int, copy int, shard int, share double"),
            spark.createDataFrame(sources, "source string, source_size long, target double"))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec(), whole: bool = False) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, a partition
    per shard in an order shuffled by hash. A document taken in part keeps its first words;
    with ``whole`` it is taken whole or not at all, whichever is nearer to the target. Documents without
    words belong to no mix."""
    rows, draws, _ = mixture(docs, spec)
    others = [c for c in docs.columns if c != "text"]  # apart from the names used here
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), "doc_id", "text",
                         F.col("source").cast("string").alias("source"), _size().alias("size"), _place(spec).alias("h"))
    taken = _drawn(placed.withColumn("block", _block("h", spec)).where("size > 0"), draws)

    @F.pandas_udf("string")
    def first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
        found = [next(itertools.islice(re.finditer(WORDS, t), n - 1, None)).end() for t, n in zip(texts, words)]
        return pd.Series([t[:end] for t, end in zip(texts, found)], dtype=object)

    cut = taken.where("words < size")
    cut = cut.where("size - words <= words") if whole else cut.withColumn("text", first_words("text", "words"))
    out = taken.where("words = size").unionByName(cut)
    order = F.xxhash64("h", "copy", F.lit(spec.seed + 1))
    out = out.repartitionById(_shards(docs, spec), F.col("shard")).sortWithinPartitions(order)
    return out.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns])


def mix_digest(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, and where the tree put them: first_shard (null: nothing
    is taken) and draws, how often some of it is taken. Null texts have size 0 and null sources
    are one source, the last. Rows that are equal in all columns share what they take evenly."""
    places, draws, sources = mixture(docs, spec)
    taken = _drawn(places, draws)
    rows = places.groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    totals = taken.groupBy("doc_id", "source", "size", "h").agg(
        F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.count(F.lit(1)).alias("draws"))
    same = ["doc_id", "source", "size", "h"]
    a, b = rows.alias("a"), totals.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in same]
    joined = a.join(b, on, "left").select(*[F.col(f"a.{k}") for k in same], "n", F.coalesce("b.taken", F.lit(0)).alias("taken"),
                                           "b.first_shard", F.coalesce("b.draws", F.lit(0)).alias("draws"))
    small = F.broadcast(sources.withColumnRenamed("source", "_s"))  # one row per source
    return (joined.join(small, F.col("source").eqNullSafe(F.col("_s")))
            .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select("doc_id", "size", "source_size", "target",
                    F.expr("taken div n + IF(k <= taken % n, 1, 0)").alias("taken"), "first_shard", "draws"))
