"""Deterministic pseudo-randomness that does not depend on partitioning or engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_order(seed: int | str, key: Column) -> Column:
    """A reproducible random order key for a row: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_choice(seed: int | str, key: Column, options: list[str]) -> Column:
    """One of ``options`` per row, chosen by the first 16 bits of the seeded md5."""
    bits = F.conv(F.substring(seeded_order(seed, key), 1, 4), 16, 10).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), bits % len(options) + 1)
