"""Removal of long repeated byte strings by sampled suffixes (operator 2).

A string of ``length`` bytes that starts anywhere else in the corpus is found over a cover: a
sparse set of positions such that every string holds one, at the same offset wherever it occurs.
A difference cover takes positions by their remainder; its samples alone, sorted as triples, would
be several times the budget in shuffles. Here the cover is taken by content, the position in the
first ``reach`` of a string whose next bytes hash lowest: about two in ``reach`` positions.

1. Sampled suffixes are named by their first ``length - reach + 1`` bytes, which every string
   with that sample holds. Names that occur once end there.
2. Names are refined by all bytes of the strings that share the sample: equal ones settle all
   their strings at once, so copies are never compared with each other.
3. What is left, close to the ends of repeated passages, is merged with the suffixes between the
   samples: strings are sorted by the hash of their bytes and adjacent ones compared. A name with
   very many different surroundings is spread over all tasks by string.

Strings are equal when 64-bit polynomial hashes of their bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ledgerlint.llm.worker import kept
from ledgerlint.sources.tables import materialise

GRAM = 32  # bytes hashed to choose a sample
CHUNK = 1 << 20  # starts of a long text handled together
CROWDED = 8192  # surroundings of a name, about 5 MB, beyond which its strings are spread over tasks
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class RepeatSpec:
    """``length`` of a string in bytes; ``reach``, a power of two, at most ``length - GRAM``."""

    length: int = 400
    reach: int = 256


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE**i, BASE**-i and the values of bytes, for positions below n (rounded up)."""
    size = 1 << max(21, int(n).bit_length())

    def build():
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        up[:], down[:] = BASE, pow(BASE, -1, 1 << 64)
        up[0] = down[0] = 1
        table = np.random.default_rng(2).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), table
    return kept("powers", size, build)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of all substrings of a byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        up, self.down, table = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start, stop) -> np.ndarray:
        """Hashes of [start, stop): two arrays of positions, or two slices of them."""
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def samples(data: np.ndarray, spec: RepeatSpec) -> Iterator[tuple[np.ndarray, ...]]:
    """(name, around, position, lo, hi) of the samples of a text: the strings of a sample at p start
    at p - hi .. p - lo; ``around`` hashes all their bytes."""
    n, length, reach = len(data), spec.length, spec.reach
    for c in range(0, n - length + 1, CHUNK):
        part = data[c: c + CHUNK + length - 1]
        m = len(part) - length + 1
        h, wide = Hashes(part), m + reach - 1
        low = _mixed(h(slice(0, wide), slice(GRAM, GRAM + wide)))
        where = np.arange(wide, dtype=np.int32)
        step = 1
        while step < reach:  # lowest hash of 2 * step positions, the first on ties
            later = low[step:] < low[:-step]
            low = np.where(later, low[step:], low[:-step])
            where = np.where(later, where[step:], where[:-step])
            step *= 2
        first = np.concatenate([[0], np.flatnonzero(np.diff(where)) + 1])
        last = np.append(first[1:], m) - 1
        p = where[first].astype(np.int64)
        lo, hi = p - last, p - first
        around = _mixed(h(first, last + length) + ((lo << 16) + hi).astype(np.uint64) * np.uint64(BASE))
        yield _mixed(h(p, p + length - reach + 1)), around, p + c, lo, hi


def _rows(*columns, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names)


def _keyed(docs: DataFrame) -> DataFrame:
    """k, text: a row's key is a hash of doc_id and text, so equal rows have one key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id").cast("long"), text).alias("k"), text.alias("text"))


def _sampled(docs: DataFrame, spec: RepeatSpec) -> DataFrame:
    names = ["name", "around", "k", "p", "lo", "hi"]

    def found(batches):
        for batch in batches:
            for k, text in zip(batch["k"].to_pylist(), batch["text"]):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for name, around, p, lo, hi in samples(data, spec):
                    yield _rows(pa.array(name.view(np.int64)), pa.array(around.view(np.int64)),
                                pa.array(np.full(len(p), k, np.int64)), pa.array(p), pa.array(lo.astype(np.int32)),
                                pa.array(hi.astype(np.int32)), names=names)

    def gathered(batches):
        waiting, n = [], 0
        for b in found(batches):
            waiting.append(b)
            n += b.num_rows
            if n >= 50_000:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, n = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return _keyed(docs).where(F.octet_length("text") >= spec.length).mapInArrow(
        gathered, "name long, around long, k long, p long, lo int, hi int")


def _packed(docs: DataFrame, spec: RepeatSpec) -> DataFrame:
    """k and the compressed text, for the joins that need texts."""
    def squeezed(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield _rows(batch["k"], pa.array([squeeze(t.as_buffer()) for t in batch["text"]], pa.binary()), names=["k", "z"])

    return _keyed(docs).where(F.octet_length("text") >= spec.length).mapInArrow(squeezed, "k long, z binary")


def _open(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _runs(k: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (k, i), neighbours in order, as (k, first, last) of consecutive i."""
    if not len(k):
        return k, i, i
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1] + 1)])
    at = np.flatnonzero(new)
    return k[at], i[at], i[np.append(at[1:], len(i)) - 1]


def _strings(batch: pa.RecordBatch, spec: RepeatSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in its text, hash) of every string in a batch of surroundings."""
    data = batch["bytes"]
    sizes = np.array([len(b) for b in data.to_pylist()], np.int64)
    joined = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - spec.length + 1
    row = np.repeat(np.arange(len(sizes)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[row] + inside
    p, hi = batch["p"].to_numpy(), batch["hi"].to_numpy().astype(np.int64)
    return row, (p - hi)[row] + inside, _mixed(Hashes(joined)(at, at + spec.length))


def _settled(spec: RepeatSpec):
    """Runs of repeated starts, from surroundings that come sorted by name."""
    def settle(table: pa.Table) -> pa.RecordBatch | None:
        batch = table.combine_chunks().to_batches()[0]
        row, start, h = _strings(batch, spec)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= batch["open"].to_numpy(zero_copy_only=False)[row]
        k = batch["k"].to_numpy()[row[twice]]
        return _rows(*map(pa.array, _runs(k, start[twice])), names=["k", "a", "b"])

    def settled(batches):
        waiting: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = pa.Table.from_batches([batch.slice(at, 4000)])
                table = part if waiting is None else pa.concat_tables([waiting, part])
                names = table["name"].to_numpy()
                cut = int(np.searchsorted(names, names[-1], "left"))  # the last name may go on
                if cut:
                    yield settle(table.slice(0, cut))
                waiting = table.slice(cut)
        if waiting is not None and waiting.num_rows:
            yield settle(waiting)
    return settled


def repeated_starts(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """(k, a, b): in the text with key k, the strings from a to b all start elsewhere, too."""
    rows = materialise(_sampled(docs, spec), "samples")
    names = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("around").alias("least"),
                                     F.max("around").alias("most")).where("n > 1")
    names = materialise(names, "names")  # so that the join may split a name with very many rows
    alike = F.col("least") == F.col("most")
    rows = materialise(rows.join(names.select("name", alike.alias("alike")), "name"), "named")
    mixed = rows.where("NOT alike")
    groups = mixed.groupBy("name", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "p")).alias("first"))
    groups = materialise(groups, "around")
    crowd = groups.groupBy("name").agg((F.count(F.lit(1)) > CROWDED).alias("crowded"))
    copies = groups.where("n > 1").select("name", "around")
    settled = rows.where("alike").select("k", "p", "lo", "hi").unionByName(
        mixed.join(copies, ["name", "around"], "left_semi").select("k", "p", "lo", "hi"))
    settled = settled.select("k", (F.col("p") - F.col("hi")).alias("a"), (F.col("p") - F.col("lo")).alias("b"))

    # single surroundings, and one of each kind of copies to compare them with
    todo = (groups.select("name", "around", F.col("first.k").alias("k"), F.col("first.p").alias("p"),
                          (F.col("n") == 1).alias("open"))
            .join(mixed.select("name", "around", "k", "p", "lo", "hi"), ["name", "around", "k", "p"])
            .dropDuplicates(["name", "around", "k", "p"]).join(crowd, "name"))
    asked = todo.groupBy("k").agg(F.collect_list(F.struct("name", "p", "lo", "hi", "open", "crowded")).alias("asked"))
    met = _packed(docs, spec).join(asked, "k")
    fields = ["name", "k", "p", "hi", "open", "crowded", "bytes"]

    def cut(batches):
        for batch in batches:
            out = [[] for _ in fields]
            for k, z, wanted in zip(*[batch[c].to_pylist() for c in ("k", "z", "asked")]):
                text = _open(z)
                for x in wanted:
                    row = (x["name"], k, x["p"], x["hi"], x["open"], x["crowded"],
                           text[x["p"] - x["hi"]: x["p"] - x["lo"] + spec.length])
                    for column, v in zip(out, row):
                        column.append(v)
                if len(out[0]) >= 5000:
                    yield _surroundings(out)
                    out = [[] for _ in fields]
            if out[0]:
                yield _surroundings(out)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
    _surroundings = lambda out: _rows(*[pa.array(c, t) for c, t in zip(out, types)], names=fields)
    around = materialise(met.select("k", "z", "asked").mapInArrow(
        cut, "name long, k long, p long, hi int, open boolean, crowded boolean, bytes binary"), "surroundings")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (around.where("NOT crowded").drop("crowded").repartition(n, "name").sortWithinPartitions("name")
             .mapInArrow(_settled(spec), "k long, a long, b long"))

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                row, start, h = _strings(part, spec)
                yield _rows(pa.array(h.view(np.int64)), pa.array(part["k"].to_numpy()[row]), pa.array(start),
                            part["open"].take(pa.array(row)), names=["h", "k", "i", "open"])

    strings = materialise(around.where("crowded").drop("crowded").mapInArrow(
        spread, "h long, k long, i long, open boolean"), "strings")
    twice = strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    single = strings.where("open").join(twice, "h").select("k", F.col("i").alias("a"), F.col("i").alias("b"))
    return settled.unionByName(found).unionByName(single)


def without_repeats(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes, not always valid UTF-8) of
    every row. Texts are UTF-8 bytes; a null text is empty. Equal rows are repeats of each other;
    an empty table gives no rows."""
    runs = materialise(repeated_starts(docs, spec), "repeats").groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("k"),
                       F.encode(text, "UTF-8").alias("raw"))

    def squeezed(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield _rows(batch["doc_id"], batch["k"], pa.array([squeeze(t.as_buffer()) for t in batch["raw"]], pa.binary()),
                        names=["doc_id", "k", "z"])

    def removed(batches):
        for batch in batches:
            out = []
            for doc_id, z, found in zip(*[batch[c].to_pylist() for c in ("doc_id", "z", "runs")]):
                text, parts, at, gone, spans = _open(z), [], 0, 0, 0
                for r in found or ():
                    a, b = r["a"], r["b"] + spec.length
                    if a > at or not spans:
                        parts.append(text[at:a])
                        spans += 1
                        gone += b - a
                        at = b
                    elif b > at:
                        gone += b - at
                        at = b
                left = b"".join([*parts, text[at:]])
                out.append((doc_id, len(text), gone, spans, hashlib.sha256(left).hexdigest(), left))
            if out:
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield _rows(*[pa.array(c, t) for c, t in zip(zip(*out), types)],
                            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    packed = rows.mapInArrow(squeezed, "doc_id long, k long, z binary")
    return packed.join(runs, "k", "left").select("doc_id", "z", "runs").mapInArrow(
        removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeat_digest(docs: DataFrame, spec: RepeatSpec = RepeatSpec()) -> DataFrame:
    return without_repeats(docs, spec).drop("kept")
