"""Fill-in-middle transformation over a sparse index of multibyte characters (operator 13).

A text is cut at two code points and its parts are put in another order between sentinels. The cuts
are drawn in code points, the parts are taken from UTF-8 bytes. An index holds only the multibyte
characters of a batch, their positions and the bytes they have beyond one; ``searchsorted`` turns cuts
of all its texts from code points to bytes and back, and where a text is ASCII that is arithmetic.

Draws come from a hash of doc_id, so reruns agree and no row depends on another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.llm.worker import release

SLICE_BYTES = 4 << 20  # texts indexed together; a longer text is a slice of its own
PARTS = "form string, n long, prefix_chars long, middle_chars long, text string"
REBUILT = "text string, prefix_chars long, middle_chars long"
_PARTS = pa.struct([("form", pa.string()), ("n", pa.int64()), ("prefix_chars", pa.int64()),
                    ("middle_chars", pa.int64()), ("text", pa.string())])
_REBUILT = pa.struct([("text", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


@dataclass(frozen=True)
class InfillSpec:
    """Percent of texts left plain and, of the others, of those with the suffix first (spm); sentinels of
    prefix, suffix and middle, of which none may begin inside itself or another; what is hashed."""

    plain: int = 10
    suffix_first: int = 20
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    salt: str = "1:"


class Excess:
    """The multibyte characters of UTF-8 bytes: ``at_byte`` and ``at_point`` say where they are, in bytes
    and in code points, ``total[i]`` how many bytes beyond one each all before the i-th have."""

    def __init__(self, data: np.ndarray):
        self.at_byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.at_byte]
        self.total = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.total[1:])
        self.at_point = self.at_byte - self.total[:-1]

    def to_bytes(self, points: np.ndarray) -> np.ndarray:
        return points + self.total[np.searchsorted(self.at_point, points)]

    def to_points(self, places: np.ndarray) -> np.ndarray:
        return places - self.total[np.searchsorted(self.at_byte, places)]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about SLICE_BYTES; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def _arranged(texts: pa.Array, draws: list[np.ndarray], spec: InfillSpec) -> pa.Array:
    """PARTS of every text from the four draws of each."""
    p, s, m = (x.encode() for x in spec.sentinels)
    taken = np.zeros(len(texts), bool)
    for mark in spec.sentinels:
        taken |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
    plain = taken | (draws[2] % 100 >= 100 - spec.plain)
    suffix_first = draws[3] % 100 < spec.suffix_first
    forms, counts, out = [], np.zeros(len(texts), np.int64), []
    cuts = np.zeros((2, len(texts)), np.int64)
    for first, last, data, offsets in _slices(texts):
        index = Excess(data)
        points = index.to_points(offsets)
        n = np.diff(points)
        a, b = draws[0][first:last] % (n + 1), draws[1][first:last] % (n + 1)
        a, b = np.minimum(a, b), np.maximum(a, b)
        counts[first:last], cuts[0, first:last], cuts[1, first:last] = n, a, b - a
        begins, raw = points[:-1], data.tobytes()
        for i, (start, x, y, stop) in enumerate(zip(offsets[:-1].tolist(), index.to_bytes(begins + a).tolist(),
                                                    index.to_bytes(begins + b).tolist(), offsets[1:].tolist()), first):
            if plain[i] or start == stop:
                forms.append("plain")
                out.append(raw[start:stop])
            elif suffix_first[i]:
                forms.append("spm")
                out.append(b"".join((s, raw[y:stop], p, raw[start:x], m, raw[x:y])))
            else:
                forms.append("psm")
                out.append(b"".join((p, raw[start:x], s, raw[y:stop], m, raw[x:y])))
    none = np.array([f == "plain" for f in forms], bool)
    return pa.StructArray.from_arrays(
        [pa.array(forms, pa.string()), pa.array(counts), pa.array(cuts[0], mask=none), pa.array(cuts[1], mask=none),
         pa.array(out, pa.binary()).cast(pa.string())], fields=list(_PARTS))


def _rebuilt(outputs: pa.Array, forms: pa.Array, spec: InfillSpec) -> pa.Array:
    """REBUILT from outputs and forms alone: the sentinels are found as bytes, the cuts they mark are turned
    to code points."""
    p, s, m = (x.encode() for x in spec.sentinels)
    texts, sizes = [], []
    for form, output in zip(forms.to_pylist(), outputs):
        raw = (output.as_buffer() or b"") if output.is_valid else b""
        raw = raw.to_pybytes() if isinstance(raw, pa.Buffer) else raw
        if form == "plain":
            texts.append(raw)
            sizes.append((-1, -1))
            continue
        head, second = (s, p) if form == "spm" else (p, s)
        x = raw.find(second, len(head))
        y = raw.find(m, x + len(second))
        parts = {head: raw[len(head): x], second: raw[x + len(second): y], m: raw[y + len(m):]}
        texts.append(parts[p] + parts[m] + parts[s])
        sizes.append((len(parts[p]), len(parts[m])))
    whole, cuts = pa.array(texts, pa.large_binary()).cast(pa.large_string()), np.array(sizes, np.int64).reshape(-1, 2)
    none, chars = cuts[:, 0] < 0, np.zeros((2, len(texts)), np.int64)
    for first, last, data, offsets in _slices(whole):
        index, own = Excess(data), np.maximum(cuts[first:last], 0)
        begin, x = index.to_points(offsets[:-1]), index.to_points(offsets[:-1] + own[:, 0])
        chars[0, first:last], chars[1, first:last] = x - begin, index.to_points(offsets[:-1] + own.sum(axis=1)) - x
    return pa.StructArray.from_arrays(
        [whole.cast(pa.string()), pa.array(chars[0], mask=none), pa.array(chars[1], mask=none)], fields=list(_REBUILT))


def _draws(doc_id: Column, spec: InfillSpec) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, the first digits of a hash of its id (null: an empty one)."""
    digest = F.sha2(F.concat(F.lit(spec.salt), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def arranged(text: Column, doc_id: Column, spec: InfillSpec = InfillSpec()) -> Column:
    """A struct (PARTS) of a text: its form, its code points ``n``, the code points of prefix and middle
    (null where plain) and the arranged text. A null text is an empty one, and that is plain, as are texts
    that hold a sentinel. Rows with one doc_id, or none, have the same draws."""
    @F.arrow_udf(PARTS)
    def arrange(texts: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        release()
        return _arranged(texts, [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)], spec)

    return arrange(text.cast("string"), *_draws(doc_id, spec))


def rebuilt(output: Column, form: Column, spec: InfillSpec = InfillSpec()) -> Column:
    """A struct (REBUILT) of the text that an arranged one was made from, and its cuts (null where plain)."""
    @F.arrow_udf(REBUILT)
    def rebuild(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        return _rebuilt(outputs, forms, spec)

    return rebuild(output, form)


def infilled(docs: DataFrame, spec: InfillSpec = InfillSpec(), out: str = "infill") -> DataFrame:
    """The rows of ``docs`` with a column ``out`` of PARTS; a column of that name is replaced, others stay.
    Repeated rows get equal results, an empty table gives no rows."""
    return docs.withColumn(out, arranged(F.col("text"), F.col("doc_id"), spec))


def infill_digest(docs: DataFrame, spec: InfillSpec = InfillSpec()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row; the
    last is of the text rebuilt from output and form."""
    rows = infilled(docs.select(F.col("doc_id").cast("long"), "text"), spec, "x").select("doc_id", "x")
    back = rows.withColumn("back", rebuilt(F.col("x.text"), F.col("x.form"), spec))
    hashed = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return back.select("doc_id", "x.n", "x.form", "x.prefix_chars", "x.middle_chars",
                       hashed("x.text").alias("output_sha256"), hashed("back.text").alias("restored_sha256"))


def infill_sql(spec: InfillSpec = InfillSpec()) -> str:
    """:func:`infill_digest` in DuckDB's SQL."""
    p, s, m = spec.sentinels
    number = lambda i: f"CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)"
    return f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('{spec.salt}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, n, {number(0)} % (n + 1) AS a, {number(1)} % (n + 1) AS b,
         CASE WHEN n = 0 OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}')
                OR {number(2)} % 100 >= {100 - spec.plain} THEN 'plain'
              WHEN {number(3)} % 100 < {spec.suffix_first} THEN 'spm' ELSE 'psm' END AS form
  FROM hashed),
cut AS (
  SELECT *, least(a, b) AS x, greatest(a, b) - least(a, b) AS y,
         substr(t, 1, least(a, b)) AS prefix,
         substr(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS middle,
         substr(t, greatest(a, b) + 1, n) AS suffix
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN y END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
    ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut"""
