"""Normalised indel similarity of two texts and exact tests that are cheaper than it.

``ratio(a, b) = 100 * 2 * LCS(a, b) / (len(a) + len(b))``, 100 for two empty texts, where LCS
is the length of the longest common subsequence in characters.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

_CELLS = 4_000_000  # padded cells of one vectorised step


def _codes(texts: Sequence[str], pad: int) -> np.ndarray:
    """Code points, one padded row per text; all texts are encoded at once."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), max(1, lengths.max())), pad, dtype=np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(
        "".join(texts).encode("utf-32-le"), dtype=np.int32)
    return out


def _lcs_block(left: list[str], right: list[str]) -> np.ndarray:
    """LCS of many pairs at once, a bit per character of the longer text and a numpy step per character of the
    shorter one (Hyyrö 2004): a zero bit is a place up to which the subsequence is one longer than before it."""
    shorter, longer = zip(*[(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right)])
    a, b = _codes(shorter, -1), _codes(longer, -2)
    words = -(-b.shape[1] // 64)
    hit = np.zeros((len(left), 64 * words), dtype=bool)
    open_bits = np.full((len(left), words), ~np.uint64(0))
    for column in a.T:
        np.equal(b, column[:, None], out=hit[:, : b.shape[1]])
        match = np.packbits(hit, axis=1, bitorder="little").view("<u8")
        taken = open_bits & match
        total = open_bits + taken
        if words > 1:  # carry from word to word
            carry = np.zeros(len(left), dtype=np.uint64)
            for w in range(words):
                over = total[:, w] < taken[:, w]
                total[:, w] += carry
                carry = (over | (total[:, w] < carry)).astype(np.uint64)
        open_bits = total | (open_bits & ~match)
    return np.bitwise_count(~open_bits).sum(axis=1).astype(np.int64)


def lcs_lengths(left: pd.Series, right: pd.Series) -> pd.Series:
    lengths = (left.str.len() + right.str.len()).to_numpy(dtype=float, na_value=np.nan)
    result = np.full(len(lengths), np.nan)
    order = np.argsort(lengths, kind="stable")[: np.count_nonzero(~np.isnan(lengths))]
    width = lengths[order] + 1
    start = 0
    while start < len(order):  # pairs of similar length share a padded block
        cells = np.arange(1, len(order) - start + 1) * width[start:]
        stop = start + max(1, int(np.searchsorted(cells, _CELLS, side="right")))
        rows = order[start:stop]
        result[rows] = _lcs_block(left.iloc[rows].tolist(), right.iloc[rows].tolist())
        start = stop
    return pd.Series(result, index=left.index)


def _lcs_batch(left: pd.Series, right: pd.Series) -> pd.Series:
    left, right = left.reset_index(drop=True), right.reset_index(drop=True)
    return lcs_lengths(left, right).astype("Int64")


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, vectorised over Arrow batches.

    Declared non-deterministic only so that a filter on the length does not make the optimizer
    compute it a second time.
    """
    return pandas_udf(_lcs_batch, returnType=LongType()).asNondeterministic()(a, b)


def lcs_native(a: Column, b: Column) -> Column:
    """The same length from Spark's higher-order functions only; for short texts."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    left, right = chars(a), chars(b)
    first = F.transform(F.concat(F.array(F.lit("")), right), lambda _: F.lit(0))

    def next_row(row: Column, ch: Column) -> Column:
        def cell(out: Column, j: Column) -> Column:
            taken = F.get(row, j) + F.when(F.get(right, j) == ch, 1).otherwise(0)
            return F.array_append(out, F.greatest(F.get(row, j + 1), F.get(out, j), taken))

        return F.aggregate(_positions(right), F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(left, first, next_row), -1).cast("long")


def _positions(arr: Column) -> Column:
    return F.transform(arr, lambda _, i: i)


def ratio_from_lcs(common: Column, a: Column, b: Column, trim: Column | int = 0) -> Column:
    total = _total(a, b, trim)
    return F.when(total == 0, F.lit(100.0)).otherwise(F.lit(200.0) * (common + trim) / total)


def ratio(a: Column, b: Column) -> Column:
    return ratio_from_lcs(lcs(a, b), a, b)


def reaches(common: Column, a: Column, b: Column, threshold: int, trim: Column | int = 0) -> Column:
    """``ratio >= threshold`` decided in integers, so equality is never lost to rounding. ``trim``, here and
    below, is how many characters of a common beginning and end were cut off both texts beforehand."""
    return F.lit(200) * (common + trim) >= F.lit(threshold) * _total(a, b, trim)


def _total(a: Column, b: Column, trim: Column | int) -> Column:
    return F.length(a) + F.length(b) + 2 * (F.lit(trim) if isinstance(trim, int) else trim)


def lengths_allow(len_a: Column, len_b: Column, threshold: int) -> Column:
    """Necessary: the shorter text alone must be able to reach the threshold."""
    return F.lit(200) * F.least(len_a, len_b) >= F.lit(threshold) * (len_a + len_b)


def least_common(len_a: Column, len_b: Column, threshold: int) -> Column:
    """The least common length that reaches the threshold; an integer quotient rounds up correctly in doubles."""
    return F.ceil(F.lit(threshold) * (len_a + len_b) / F.lit(200.0)).cast("int")


def _allowed(a: Column, b: Column, threshold: int, trim: Column | int) -> Column:
    """The largest indel distance that reaches the threshold; the product is an integer, so the
    quotient floors correctly in doubles."""
    return F.floor(F.lit(100 - threshold) * _total(a, b, trim) / 100).cast("int")


def edits_allow(a: Column, b: Column, threshold: int, trim: Column | int = 0) -> Column:
    """Necessary: Levenshtein distance never exceeds the indel distance."""
    return F.call_function("levenshtein", a, b, _allowed(a, b, threshold, trim)) >= 0


def edits_suffice(a: Column, b: Column, threshold: int, trim: Column | int = 0) -> Column:
    """Sufficient: the indel distance is at most twice the Levenshtein distance."""
    half = F.floor(_allowed(a, b, threshold, trim) / 2).cast("int")
    return F.call_function("levenshtein", a, b, half) >= 0


def common_prefix(a: Column, b: Column) -> Column:
    """How many characters two texts begin with alike."""
    shorter = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(0), shorter), lambda i: (i == shorter) | (F.substring(a, i + 1, F.lit(1)) != F.substring(b, i + 1, F.lit(1))))
    return F.get(differs, F.lit(0))
