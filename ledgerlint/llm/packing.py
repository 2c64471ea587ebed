"""Packing of token sequences by minimum bin slack (operator 12).

Documents become token ids and an end id; longer ones than a sequence are cut into pieces. A sequence is
filled from the largest piece left and the combination of the others that leaves the least room, found by
subset sums over the lengths left: bit s of a number is set if some combination has s tokens. The combination
is taken out, and so on. Only lengths matter for that, so the whole corpus is packed at once from the number of
pieces of each length, a table no longer than a sequence; a combination is taken as often as its pieces last.

Pieces are numbered among those of their length, as they are cut, within a task, and the numbers before a
task are added up; a piece then finds its sequence and place by its length and number. No text is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ledgerlint.llm.presplit import PieceEncoder, distinct_words, gathered
from ledgerlint.llm.worker import kept
from ledgerlint.sources.tables import materialise

SLICE_ROWS = 2_000  # texts encoded together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
NUMBER_BITS = 44  # of a piece among those of its length


@dataclass(frozen=True)
class PackSpec:
    """Tokens of a sequence at most, below 2**18, and the id that ends a document."""

    capacity: int = 4096
    end_id: int = 1


def fullest(lengths: list[int], counts: list[int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest that is at most ``room``; each of ``lengths``
    (descending) at most as often as ``counts`` says."""
    reached, mask, steps = 1, (1 << room + 1) - 1, []
    for length, count in zip(lengths, counts):
        for _ in range(min(count, room // length)):
            more = (reached | reached << length) & mask
            if more == reached:
                break
            steps.append((length, reached))
            reached = more
            if reached >> room:  # no room left over
                break
        if reached >> room:
            break
    left, taken = reached.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            taken.append(length)
            left -= length
    return sorted(taken, reverse=True)


def combinations(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many sequences have them), until no piece of the histogram is left."""
    left, out = {length: n for length, n in histogram.items() if n}, []
    order = sorted(left, reverse=True)
    while order:
        first = order[0]
        room = capacity - first
        left[first] -= 1
        fitting = [x for x in order if x <= room and left[x]]
        chosen = [first, *fullest(fitting, [left[x] for x in fitting], room)]
        left[first] += 1
        wanted = {x: chosen.count(x) for x in dict.fromkeys(chosen)}
        times = min(left[x] // n for x, n in wanted.items())
        for x, n in wanted.items():
            left[x] -= n * times
        order = [x for x in order if left[x]]
        out.append((chosen, times))
    return out


def places(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Arrays (key, sequence, offset, times), ascending by key. A key is a length and the number of the first
    piece an entry is for; the next ``times`` pieces go to as many sequences, the ``times`` after them
    to the same ones behind them, and so on. One entry per combination and length: a length is used up, or
    left with fewer pieces than one combination takes, each time, so their number has a bound that only
    the capacity sets."""
    used, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for chosen, times in combinations(histogram, capacity):
        offset = 0
        for length in dict.fromkeys(chosen):
            n = chosen.count(length)
            rows.append((length << NUMBER_BITS | used[length], sequence, offset, times))
            used[length] += n * times
            offset += n * length
        sequence += times
    return tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) if rows else (np.zeros(0, np.int64),) * 4


def _cut(doc_ids: list, texts: pa.Array, encoder: PieceEncoder, spec: PackSpec, numbers: list[int], part: int,
         with_ids: bool) -> pa.RecordBatch:
    starts, codes, words = distinct_words(texts)
    data, at = gathered(encoder.encode(words), codes, starts)
    raw, end, most = data[: at[-1]].tobytes(), int(spec.end_id).to_bytes(4, "little"), 4 * spec.capacity
    rows, ids = [], []
    for doc_id, a, b in zip(doc_ids, at[:-1].tolist(), at[1:].tolist()):
        whole = raw[a:b] + end
        for k in range(0, len(whole), most):
            own = whole[k: k + most]
            length = len(own) // 4
            rows.append((doc_id, k // most, k // 4, length, zlib.crc32(own), part, numbers[length]))
            numbers[length] += 1
            if with_ids:
                ids.append(own)
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names + ["ids"] * with_ids)


def cut_documents(docs: DataFrame, tokenizer_path: str, spec: PackSpec = PackSpec(), with_ids: bool = False) -> DataFrame:
    """The pieces (PIECES) of all documents, written; ``ids`` are little-endian unsigned 32-bit. ``nth`` counts
    the pieces of one length in a task ``part``. A null text is empty: one piece, the end id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of a fixed vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept("piece encoder", shipped.value, lambda: PieceEncoder(shipped.value))
        numbers, part = [0] * (spec.capacity + 1), TaskContext.get().partitionId()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(k, SLICE_ROWS)
                yield _cut(piece["doc_id"].to_pylist(), piece["text"], encoder, spec, numbers, part, with_ids)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialise(rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids), "pieces")


def packed(pieces: DataFrame, spec: PackSpec = PackSpec()) -> DataFrame:
    """Written pieces with ``sequence_id`` and ``offset`` in place of part and nth. Sequences are numbered from 0
    and filled from offset 0 without gaps."""
    counts = materialise(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows
    table = pieces.sparkSession.sparkContext.broadcast(places(histogram, spec.capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = [c for c in pieces.columns if c not in ("part", "nth")]
    numbered = pieces.join(bases, ["part", "length"]).select(*columns, (F.col("base") + F.col("nth")).alias("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset, times = table.value
        for batch in batches:
            length = batch["length"].to_numpy()
            own = length << NUMBER_BITS | batch["nth"].to_numpy()
            i = np.searchsorted(key, own, "right") - 1
            copy, nth = np.divmod(own - key[i], times[i]) if len(own) else (own, own)
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in columns], pa.array(sequence[i] + nth), pa.array(offset[i] + copy * length)],
                [*columns, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return numbered.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(docs: DataFrame, tokenizer_path: str, spec: PackSpec = PackSpec()) -> DataFrame:
    """The sequences themselves: sequence_id, token_ids (binary, little-endian unsigned 32-bit) and ``pieces``, an
    array of (offset, length, doc_id, piece, start) in order. A group holds no more than ``capacity`` ids."""
    rows = packed(cut_documents(docs, tokenizer_path, spec, with_ids=True), spec)
    own = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    whole = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(own)).alias("x"))
    joined = F.aggregate("x", F.lit(b""), lambda a, b: F.concat(a, b["ids"]))
    return whole.select("sequence_id", joined.alias("token_ids"), F.transform(
        "x", lambda e: F.struct(*[e[c].alias(c) for c in ("offset", "length", "doc_id", "piece", "start")])).alias("pieces"))


def packing_digest(docs: DataFrame, tokenizer_path: str, spec: PackSpec = PackSpec()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece. Repeated rows are documents
    of their own, a null doc_id is kept; an empty table gives no rows."""
    return packed(cut_documents(docs, tokenizer_path, spec), spec)
