"""Seeded ground truth: synthetic near-duplicates planted among the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ledgerlint.functions.hashing import seeded_choice, seeded_order
from ledgerlint.functions.text import is_blank, swap_middle, text_or_empty
from ledgerlint.sources.tables import materialise
from ledgerlint.specs import Fields

# The ways a synthetic duplicate differs, its id suffix and its texts.
STYLES = ["abbreviation", "extra_word", "typo", "near_exact"]
ID_SUFFIX = "-SEEDED"
ABBREVIATED = ("Block", "Blk")
EXTRA_WORD = " Building"


def sample_rows(df: DataFrame, n: int, seed: int | str, f: Fields = Fields()) -> DataFrame:
    """``n`` rows at random without replacement, reproducible under any partitioning."""
    return df.orderBy(seeded_order(seed, F.col(f.id)), f.id).limit(n)


def seed_candidates(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    return df.where(~is_blank(F.col(f.building)))


def synthetic_duplicates(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    """A near-copy of every row, varied as its column ``style`` says."""
    name = text_or_empty(F.col(f.building))
    long, short = ABBREVIATED
    style = F.col("style")
    varied = (F.when((style == "abbreviation") & name.contains(long),
                     F.replace(name, F.lit(long), F.lit(short)))
              .when(style == "extra_word", F.concat(name, F.lit(EXTRA_WORD)))
              .when((style == "typo") & (F.length(name) > 4), swap_middle(name))
              .otherwise(name))
    new_id = F.concat(text_or_empty(F.col(f.id)), F.lit(ID_SUFFIX))
    return df.withColumns({f.building: varied, f.id: new_id})


def seeded_test_set(df: DataFrame, n_duplicates: int = 25, n_clean: int = 25, seed: int = 42,
                    f: Fields = Fields()) -> DataFrame:
    """The records, the synthetic duplicates after them, and ``label``: ``seeded`` for both
    sides of a planted pair, ``clean`` for sampled other records, ``none`` for the rest.
    ``seeded_from`` names the original of a synthetic row."""
    drawn = sample_rows(seed_candidates(df, f), n_duplicates, seed, f).withColumn(
        "style", seeded_choice(f"{seed}-style", F.col(f.id), STYLES))
    order = Window.orderBy(seeded_order(seed, F.col(f.id)), f.id)  # over the few drawn rows
    drawn = materialise(drawn.withColumn("_rank", F.row_number().over(order)), "sources")
    last = df.agg(F.max(f.pos)).scalar()
    planted = (synthetic_duplicates(drawn.withColumn("seeded_from", F.col(f.id)), f)
               .withColumn(f.pos, last + F.col("_rank")).drop("_rank", "style")
               .withColumn("label", F.lit("seeded")))
    rest = df.join(drawn.select(f.id), f.id, "left_anti")
    clean = materialise(sample_rows(rest, n_clean, f"{seed}-clean", f).select(f.id), "clean")
    marks = (drawn.select(f.id, F.lit("seeded").alias("label"))
             .unionByName(clean.select(f.id, F.lit("clean").alias("label")))
             .groupBy(f.id).agg(F.max("label").alias("label")))  # an id may repeat; seeded wins
    labelled = df.join(marks, f.id, "left").select(
        *df.columns, F.coalesce("label", F.lit("none")).alias("label"))
    return labelled.unionByName(planted, allowMissingColumns=True)
