"""One large JSON document read by several tasks.

Where a byte range of a JSON text begins, it is unknown whether that is inside a string and how deep. But a range can say
for both cases how it would end; those answers, one row a range, put together in order, give the true state at each
border. With that every range finds the objects that begin in it, and reads on behind its end for the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ledgerlint.sources.tables import materialise

QUOTE, BACKSLASH = 0x22, 0x5C
STEP = np.zeros(256, np.int64)
STEP[[ord(c) for c in "{["]] = 1
STEP[[ord(c) for c in "}]"]] = -1
FOUND = "part long, kind string, start long, nth long, text string"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri}" if uri.startswith("/") else uri.replace(":/", ":///", 1)
    return fs.FileSystem.from_uri(uri)


def _escaped(read, start: int) -> bool:
    """Whether the byte at ``start`` follows an odd number of backslashes."""
    n, size = 0, 64
    while n < start:
        before = read(max(0, start - size), start)
        n = len(before) - len(before.rstrip(b"\\"))
        if n < len(before):
            break
        size *= 2
    return n % 2 == 1


def quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """The quotes that begin or end a string: those after an even number of backslashes."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != BACKSLASH, at, -1))
    run = at - plain  # backslashes up to and with each byte
    run[plain < 0] += escaped
    return (data == QUOTE) & (np.concatenate([[int(escaped)], run[:-1]]) % 2 == 0)


def shape(data: np.ndarray, inside: bool, escaped: bool) -> np.ndarray:
    """The step in depth at each byte of a piece of JSON, 0 inside strings."""
    within = (np.cumsum(quotes(data, escaped)) + inside) % 2 == 1
    return np.where(within, 0, STEP[data])


def _ends(data: np.ndarray, escaped: bool) -> tuple[int, int, int]:
    """(whether the piece has an odd number of quotes, depth gained if it begins outside, and if inside a string)."""
    if not len(data):
        return 0, 0, 0
    return (int(quotes(data, escaped).sum()) % 2, int(shape(data, False, escaped).sum()), int(shape(data, True, escaped).sum()))


def objects_of(spark: SparkSession, path: str, key: str, range_bytes: int = 32 << 20) -> DataFrame:
    """(pos, text) of the objects in the array under ``key`` of the outermost object, in order; elements that are not
    objects are left out. Each task reads a range of ``range_bytes``; the path must be one ``pyarrow.fs`` can open."""
    store, name = _opened(path)
    size = store.get_file_info(name).size or 0
    n = max(1, -(-size // range_bytes))
    name_bytes = f'"{key}"'.encode()

    def reader():
        own, where = _opened(path)
        source = own.open_input_file(where)

        def read(start: int, stop: int) -> bytes:
            source.seek(start)
            return source.read(max(0, min(stop, size) - start))
        return read

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            rows = []
            for part in batch["id"].to_pylist():
                data = np.frombuffer(read(part * range_bytes, (part + 1) * range_bytes), np.uint8)
                rows.append((part, *_ends(data, _escaped(read, part * range_bytes))))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["part", "odd", "outside", "inside"])

    ranges = spark.range(0, n, 1, n)
    states, inside, depth = {}, False, 0  # a row a range
    for r in sorted(ranges.mapInArrow(summed, "part long, odd long, outside long, inside long").collect()):
        states[r["part"]] = (inside, depth)
        depth += r["inside"] if inside else r["outside"]
        inside ^= bool(r["odd"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader()
        for batch in batches:
            for part in batch["id"].to_pylist():
                rows = list(_objects(read, part, states[part]))
                if rows:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     [x.split()[0] for x in FOUND.split(", ")])

    def _objects(read, part: int, state: tuple[bool, int]):
        start, (within, above) = part * range_bytes, state
        raw, escaped = read(start, start + range_bytes), _escaped(read, start)
        if not raw:
            return

        def steps() -> tuple[np.ndarray, np.ndarray]:
            step = shape(np.frombuffer(raw, np.uint8), within, escaped)
            return step, np.cumsum(step) + above

        step, depth = steps()
        data = np.frombuffer(raw, np.uint8)
        for i in np.flatnonzero((step == 1) & (depth == 2) & (data == ord("["))).tolist():
            lead = read(max(0, start + i - 4096), start + i).rstrip()
            if lead.endswith(b":") and lead[:-1].rstrip().endswith(name_bytes):
                yield part, "begin", start + i, 0, None
        for i in np.flatnonzero((step == -1) & (depth == 1)).tolist():
            yield part, "end", start + i, 0, None
        opens = np.flatnonzero((step == 1) & (depth == 3) & (data == ord("{")))
        closes, more = np.flatnonzero((step == -1) & (depth == 2)), 1 << 16
        while len(opens) and not (closes > opens[-1]).any() and start + len(raw) < size:
            raw, more = read(start, start + len(raw) + more), 2 * more  # the last object goes on behind the range
            step, depth = steps()
            closes = np.flatnonzero((step == -1) & (depth == 2))
        for k, i in enumerate(opens.tolist()):
            j = int(np.searchsorted(closes, i))
            stop = int(closes[j]) + 1 if j < len(closes) else len(raw)
            yield part, "object", start + i, k, raw[i:stop].decode(errors="replace")

    rows = materialise(ranges.mapInArrow(found, FOUND), "json-objects")
    begin = rows.where("kind = 'begin'").agg(F.min("start")).scalar()
    end = rows.where((F.col("kind") == "end") & (F.col("start") > begin)).agg(F.min("start")).scalar()
    inside_array = rows.where((F.col("kind") == "object") & F.col("start").between(begin, F.coalesce(end, F.lit(size))))
    counts = inside_array.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = counts.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base"))
    return inside_array.join(F.broadcast(bases), "part").select((F.col("base") + F.col("nth")).alias("pos"), "text")
