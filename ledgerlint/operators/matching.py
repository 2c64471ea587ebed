"""Near-duplicate records: blocked similarity join and order-aware claiming.

Two records of a block (same road) match when their address texts are similar enough and their
floors and descriptions do not speak against it. In record order every record that is not yet
claimed claims all later unclaimed records it matches. The result is whole, but the matching
pairs of a block are never enumerated record by record:

* Copies are collapsed first. Records with the same address text and floor match the same
  others and each other, so one node stands for all of them; the description only tells them
  apart where a block has records without a floor.
* Candidate texts come from an equi-join on (block, character bigram) over the few bigrams of a
  text that any similar text must share one of, not from the block alone. The same holds for
  descriptions where they decide. Where what tells the texts of a block apart is short, they meet
  by whole subsequences instead, as long as that of any similar text, so hardly any others meet.
* The nodes of a block are taken in growing slices of the record order. What the leaders of a
  slice claim is gone before the next slice is joined with itself, which keeps the matches that
  are ever written near-linear even where almost everything in a block looks alike.
* The pairs of a join key that many rows of both sides hold are split over a grid of tasks whose
  size follows from the product of both counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.functions import similarity as sim
from ledgerlint.functions.text import normalised, strip, text_or_empty
from ledgerlint.operators import claims
from ledgerlint.operators.joins import hot_only, lookup
from ledgerlint.sources.tables import materialise
from ledgerlint.specs import MISSING_TEXT, Fields, MatchSpec

UNIT = ["block", "text", "floor", "descr"]
COMMON_GRAMS = 64
WEAK = -1
MOST_SUBSEQUENCES = 64  # keys of a text
CELL = ["cell_row", "cell_column"]


def address_text(f: Fields = Fields()) -> Column:
    return strip(F.concat(text_or_empty(F.col(f.building)), F.lit(" "),
                          text_or_empty(F.col(f.road))))


def block_key(f: Fields = Fields()) -> Column:
    return normalised(F.col(f.road))


def matchable(f: Fields = Fields()) -> Column:
    """A block and some building text to compare; white space counts as text."""
    return (block_key(f) != "") & F.coalesce(F.col(f.building) != "", F.lit(False))


def unit_columns(f: Fields, spec: MatchSpec) -> dict[str, Column]:
    missing = {"literal": MISSING_TEXT, "unknown": ""}[spec.null_units]
    filled = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(missing))
    return {"block": block_key(f), "text": address_text(f),
            "floor": F.lower(strip(filled(f.floor))), "descr": filled(f.descr)}


def block_sizes(df: DataFrame, f: Fields = Fields()) -> DataFrame:
    """Matchable records per block and the pairs a plain blocked self-join would compare."""
    sizes = (df.where(matchable(f)).groupBy(block_key(f).alias("block"))
             .agg(F.count(F.lit(1)).alias("n_records")))
    return sizes.where(F.col("n_records") >= 2).withColumn(
        "n_pairs", F.expr("n_records * (n_records - 1) div 2"))


# ---------------------------------------------------------------------------------- nodes

def _bigrams(text: Column) -> Column:
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, 2))
    return F.when(n >= 2, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def _lost_grams(length: Column, threshold: int) -> Column:
    """How many of its bigrams a text of this length can lose towards any similar text.

    With x = common / (own + other length) >= t / 200, at most 2 * deleted + inserted bigrams
    are hit; the extremes over the admissible other lengths bound it.
    """
    c = threshold / 200
    short, long = c / (1 - c), (1 - c) / c
    worst = max((2 - 3 * c) + (1 - 3 * c) * other for other in (short, long))
    return F.floor(length * F.lit(worst) + F.lit(1e-6)).cast("int")


def match_units(df: DataFrame, f: Fields = Fields(), spec: MatchSpec = MatchSpec()) -> DataFrame:
    """One row per distinct (block, text, floor, descr): its first and last record and their
    number. Only numbers are aggregated, which keeps this a hash aggregation."""
    records = df.where(matchable(f)).select(
        F.col(f.pos).alias("pos"), *[c.alias(k) for k, c in unit_columns(f, spec).items()])
    # without a floor and a description there is nothing a record could match by
    records = records.where((F.col("floor") != "") | (F.col("descr") != ""))
    return records.groupBy(*UNIT).agg(
        F.min("pos").alias("vid"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def node_keys(units: DataFrame, some_without_floor: bool) -> DataFrame:
    """Add ``by``, the description as far as it tells nodes apart: floors are compared first, so
    among records with a floor it only matters if their block has records without one."""
    has_floor = F.col("floor") != ""
    if not some_without_floor:
        return units.withColumn("by", F.lit(""))
    open_blocks = units.where(~has_floor).select("block", F.lit(True).alias("_open")).distinct()
    return units.join(open_blocks, "block", "left").withColumn(
        "by", F.when(has_floor & F.col("_open").isNull(), F.lit("")).otherwise(F.col("descr"))
    ).drop("_open")


def match_nodes(units: DataFrame) -> DataFrame:
    """The nodes to match: units with equal keys taken together."""
    return units.groupBy("block", "text", "floor", "by").agg(
        F.min("vid").alias("vid"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"))


def block_shapes(nodes: DataFrame, threshold: int) -> DataFrame:
    """One row per block, written: its nodes ``n``, those without a floor ``open``, and what fits its matching best.

    ``left`` and ``right`` characters begin and end all its texts alike and are left out of every comparison.
    ``by_floor`` says that comparing floor by floor makes fewer pairs than comparing each distinct text once;
    only where all nodes have a floor. ``all_weak`` says that its texts are so short beside what similar ones
    may differ in that no bigram of them need be shared. ``common`` are its most frequent bigrams, rarest first.
    ``exact`` says that a text has few subsequences of the lengths two similar ones must share, and that these are
    fewer rows than the pairs to compare; then they are its keys. ``shortest`` and ``longest`` are lengths of texts.
    """
    by_floors = nodes.groupBy("block", "floor").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("text").alias("texts"), F.min("text").alias("low"), F.max("text").alias("high"),
        F.min(F.reverse("text")).alias("low_end"), F.max(F.reverse("text")).alias("high_end"),
        F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest"))
    shapes = by_floors.groupBy("block").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("floor") == "", F.col("n")).otherwise(0)).alias("open"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs_by_floor"),
        F.hll_sketch_estimate(F.hll_union_agg("texts")).cast("double").alias("texts"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("low_end").alias("low_end"), F.max("high_end").alias("high_end"),
        F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    left = sim.common_prefix(F.col("low"), F.col("high"))
    shapes = shapes.withColumn("left", left).withColumn(
        "right", F.least(sim.common_prefix(F.col("low_end"), F.col("high_end")), F.col("shortest") - F.col("left")))
    by_floor = (F.col("open") == 0) & (F.col("pairs_by_floor") < F.col("texts") * F.col("texts"))
    weak = F.col("longest") - F.col("left") - F.col("right") - 1 <= _lost_grams(F.col("longest"), threshold)
    pairs = F.when(by_floor, F.col("pairs_by_floor")).otherwise(F.col("texts") * F.col("texts"))
    exact = F.col("n") * _most_subsequences(threshold) < pairs
    counted = nodes.select("block", F.explode(_bigrams(F.col("text"))).alias("gram")).groupBy("block", "gram").agg(F.count(F.lit(1)).alias("k"))
    ordered = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "gram"))).alias("g"))
    grams = ordered.select("block", F.reverse(F.slice("g", 1, COMMON_GRAMS).getField("gram")).alias("common"))
    return materialise(shapes.select("block", "n", "open", "left", "right", by_floor.alias("by_floor"), weak.alias("all_weak"),
                                     pairs.alias("pairs"), F.coalesce(exact, F.lit(False)).alias("exact"), "shortest", "longest").join(grams, "block", "left"), "shapes")


def _most_subsequences(threshold: int) -> Column:
    """About how many keys the longest text of a block has at most, null if more than ``MOST_SUBSEQUENCES``."""
    longest, chars = F.col("longest"), F.col("longest") - F.col("left") - F.col("right")
    lost = lambda other: longest - sim.least_common(longest, other, threshold)
    shortest = F.greatest(F.col("shortest"), F.ceil(longest * threshold / F.lit(200.0 - threshold)).cast("int"))
    ways = lambda d: F.factorial(chars) / (F.factorial(F.least(d, chars)) * F.factorial(chars - F.least(d, chars)))
    number = F.when(chars <= 20, F.aggregate(F.sequence(lost(longest), F.greatest(lost(longest), lost(shortest))), F.lit(0.0), lambda n, d: n + ways(d)))
    return F.when(number <= MOST_SUBSEQUENCES, number)


def subsequence_keys(text: Column, length: Column, trim: Column, shortest: Column, longest: Column, threshold: int) -> Column:
    """Hashes of the subsequences of a text by which all similar ones meet, given the lengths in its block.

    Two texts are similar if and only if they have a common subsequence of the least length that reaches the
    threshold, which follows from both their lengths; so each gets those for every length the other may have.
    """
    others = F.filter(F.sequence(shortest, longest), lambda other: sim.lengths_allow(length, other, threshold))
    sizes = F.array_distinct(F.transform(others, lambda other: F.greatest(sim.least_common(length, other, threshold) - trim, F.lit(0))))
    without_one = lambda texts: F.array_distinct(F.flatten(F.transform(texts, lambda s: F.transform(
        F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s)))))))

    def of(sizes: Column) -> Column:
        def shorter(found: Column, lost: Column) -> Column:
            texts = F.when(lost == 0, found["texts"]).otherwise(without_one(found["texts"]))
            return F.struct(texts.alias("texts"), found["kept"].alias("kept"))

        def taken(found: Column, lost: Column) -> Column:
            wanted = F.array_contains(sizes, F.length(text) - lost)
            return F.struct(found["texts"].alias("texts"), F.when(wanted, F.concat(found["kept"], found["texts"])).otherwise(found["kept"]).alias("kept"))

        def step(found: Column, lost: Column) -> Column:
            return F.get(F.transform(F.array(shorter(found, lost)), lambda made: taken(made, lost)), F.lit(0))

        start = F.struct(F.array(text).alias("texts"), F.array().cast("array<string>").alias("kept"))
        return F.aggregate(F.sequence(F.lit(0), F.length(text) - F.array_min(sizes)), start, step, lambda found: found["kept"])

    found = F.flatten(F.transform(F.array(sizes), of))  # a variable of its own, so the sizes are computed once
    return F.transform(found, lambda s: F.xxhash64(s))


def _common_grams(texts: DataFrame, text: str) -> Column:
    """The most frequent bigrams of a table, rarest first, as a one-row subquery."""
    common = (texts.select(F.explode(_bigrams(F.col(text))).alias("gram"))
              .groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "gram").limit(COMMON_GRAMS)
              .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).getField("gram").alias("g")))
    return F.coalesce(common.scalar(), F.array().cast("array<string>"))


def with_keys(df: DataFrame, text: str, length: Column, threshold: int, out: str, common: Column,
              all_weak: Column | None = None) -> DataFrame:
    """Add ``out``, the bigrams of a text by which similar texts meet; ``length`` is that of the text before its
    common ends were cut off.

    Any two similar texts share a bigram among the first ``lost + 1`` of each in one common
    order, in which frequent ones come late; the order and the bigram's hash are packed into one number to be
    sorted. The hash is the key: a collision only makes a bigram look shared, which the exact tests sort out.
    A text with no more bigrams than it may lose also gets the key ``WEAK``, so that two such texts
    meet as well; where ``all_weak`` it gets no other.
    """
    low = F.lit((1 << 32) - 1)
    df = df.withColumn("_common", F.coalesce(common, F.array().cast("array<string>")))
    packed = F.transform(_bigrams(F.col(text)), lambda g: (
        F.array_position("_common", g) * F.lit(1 << 32) + F.hash(g).cast("long").bitwiseAND(low)))
    df = df.withColumn("_grams", F.array_sort(packed))
    lost = _lost_grams(length, threshold)
    weak = F.when(F.size("_grams") <= lost, F.array(F.lit(WEAK).cast("long"))).otherwise(
        F.array().cast("array<long>"))
    hashes = F.transform(F.slice("_grams", 1, lost + 1), lambda p: p.bitwiseAND(low))
    keys = F.concat(F.array_distinct(hashes), weak)
    if all_weak is not None:
        keys = F.when(all_weak, F.array(F.lit(WEAK).cast("long"))).otherwise(keys)
    return df.withColumn(out, keys).drop("_common", "_grams")


def shaped(df: DataFrame, shapes: DataFrame, columns: list[str], spec: MatchSpec, total: int | None = None) -> DataFrame:
    """Add columns of its block's shape to every row; blocks with very many rows are not gathered in one task."""
    hot = hot_only(shapes, "n", spec.hot_rows, total).select("block")
    return lookup(df, shapes.select("block", *columns), ["block"], hot, "text")


def with_parts(nodes: DataFrame, shapes: DataFrame, spec: MatchSpec) -> DataFrame:
    """Add ``part``, the floor in blocks that are matched floor by floor, else empty."""
    placed = shaped(nodes, shapes, ["by_floor"], spec)
    return placed.withColumn("part", F.when(F.col("by_floor"), F.col("floor")).otherwise(F.lit(""))).drop("by_floor")


def text_keys(nodes: DataFrame, spec: MatchSpec = MatchSpec(), shapes: DataFrame | None = None) -> DataFrame:
    """The distinct (block, part, text) with ``core``, the text without what all texts of its block begin and end
    with, ``trim``, the number of characters left out, and ``keys``, subsequences where ``exact``. Nodes without a
    part have one part."""
    shapes = block_shapes(nodes, spec.address_threshold) if shapes is None else shapes
    part = F.col("part") if "part" in nodes.columns else F.lit("").alias("part")
    texts = shaped(nodes.select("block", part, "text").distinct(), shapes, ["left", "right", "all_weak", "common", "exact", "shortest", "longest"], spec)
    trim = F.col("left") + F.col("right")
    texts = texts.withColumn("trim", trim).withColumn("core", F.substring("text", F.col("left") + 1, F.length("text") - trim))
    texts = with_keys(texts, "core", F.length("text"), spec.address_threshold, "keys", F.col("common"), F.col("all_weak"))
    subsequences = subsequence_keys(F.col("core"), F.length("text"), F.col("trim"), F.col("shortest"), F.col("longest"), spec.address_threshold)
    return texts.withColumn("keys", F.when(F.col("exact"), subsequences).otherwise(F.col("keys"))).select(
        "block", "part", "text", "core", "trim", "keys", "exact")


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------------------------- pairs

def similar_texts(left: DataFrame, right: DataFrame, spec: MatchSpec = MatchSpec(),
                  itself: bool = False, n_block: int | None = None, scored: bool = True,
                  parts: bool = False, some_exact: bool = True) -> DataFrame:
    """Pairs (block, text_a, text_b[, score]), with ``parts`` also their part, of different texts that reach the
    threshold, each once, from two tables of :func:`text_keys`; with ``itself`` (``left`` is ``right``) only in
    the order text_a < text_b.

    ``n_block``, if given, bounds the texts of a block on either side. Where no block can hold
    more than ``task_pairs`` pairs, no key can either and none is counted.
    Without the score, pairs so close that their edit distance decides are not compared further.
    ``some_exact`` may be false if no text has subsequences as keys; pairs that meet by several are told apart
    afterwards, so that a text's keys need not go with each of its rows.
    """
    on = ["block", "part", "key"]
    sides = []
    for side, texts in (("a", left), ("b", right)):
        sides.append(texts.select(
            "block", "part", F.explode("keys").alias("key"), F.col("text").alias(f"text_{side}"),
            F.col("core").alias(f"core_{side}"), F.length("text").alias(f"len_{side}"), F.when(~F.col("exact"), F.col("keys")).alias(f"keys_{side}"),
            *[F.col("trim")] * (side == "a")))
    a, b = sides
    if n_block is None or n_block * n_block > spec.task_pairs:
        a, b = split_crowded(a, b, on, "text_a", "text_b", spec)
        on = [*on, *CELL]
    x, y, trim, t = F.col("core_a"), F.col("core_b"), F.col("trim"), spec.address_threshold
    is_weak = lambda keys: F.element_at(keys, -1) == WEAK
    both_weak = is_weak(F.col("keys_a")) & is_weak(F.col("keys_b"))
    once = F.when(F.col("keys_a").isNull(), True).when(both_weak, F.col("key") == WEAK).otherwise(
        F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key"))
    # the work is in the comparisons, not in the bytes: keep all partitions
    candidates = a.repartition(_partitions(left), *on).join(b, on).where(
        (F.col("text_a") < F.col("text_b") if itself else F.col("text_a") != F.col("text_b"))
        & sim.lengths_allow(F.col("len_a"), F.col("len_b"), t) & once & sim.edits_allow(x, y, t, trim)).select(
        "block", "part", "text_a", "text_b", "core_a", "core_b", "trim")
    if some_exact:
        candidates = candidates.distinct()
    out = ["block", *["part"] * parts, "text_a", "text_b"]
    if not scored:
        return _reaching(candidates, x, y, t, trim).select(*out)
    compared = candidates.withColumn("_common", sim.lcs(x, y))
    return compared.where(sim.reaches(F.col("_common"), x, y, t, trim)).select(
        *out, sim.ratio_from_lcs(F.col("_common"), x, y, trim).alias("score"))


def _reaching(candidates: DataFrame, x: Column, y: Column, threshold: int, trim: Column | int = 0) -> DataFrame:
    """Candidates that reach the threshold; only unclear ones have their subsequence computed."""
    sure = candidates.withColumn("_sure", sim.edits_suffice(x, y, threshold, trim))
    unclear = ~F.col("_sure")
    compared = sure.withColumn("_common", sim.lcs(F.when(unclear, x), F.when(unclear, y)))
    return compared.where(F.col("_sure") | sim.reaches(F.col("_common"), x, y, threshold, trim)).drop(
        "_sure", "_common")


def split_crowded(a: DataFrame, b: DataFrame, on: list[str], id_a: str, id_b: str,
                  spec: MatchSpec = MatchSpec()) -> tuple[DataFrame, DataFrame]:
    """Add the columns ``CELL`` to both sides of a join so that no value of (on, cell) has many
    more than ``task_pairs`` pairs.

    A key with more pairs becomes a grid: left rows are dealt to its rows by ``id_a``, right rows
    to its columns by ``id_b``, and each is repeated along the other side, so every pair meets in
    one cell. The crowded keys are a written table; the planner broadcasts it only if its files
    are below the session's limit and shuffles it otherwise.
    """
    most, side = F.lit(float(spec.task_pairs)), F.lit(float(spec.task_pairs) ** 0.5)
    counted = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    width = lambda other: F.greatest(side, most / F.col(other))
    crowded = counted(a, "_na").join(counted(b, "_nb"), on).where(
        F.col("_na").cast("double") * F.col("_nb") > most).select(
        *on, F.ceil(F.col("_na") / width("_nb")).cast("int").alias("_rows"),
        F.ceil(F.col("_nb") / width("_na")).cast("int").alias("_columns"))
    crowded = materialise(crowded, "crowded")

    def dealt(df, own, parts, key, other, repeats):
        parts, repeats = (F.coalesce(F.col(c), F.lit(1)) for c in (parts, repeats))
        return (df.join(crowded, on, "left")
                .withColumn(own, F.pmod(F.xxhash64(key), parts).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), repeats - 1)))
                .drop("_rows", "_columns"))

    row, column = CELL
    return (dealt(a, row, "_rows", id_a, column, "_columns"),
            dealt(b, column, "_columns", id_b, row, "_rows"))


def match_edges(left: DataFrame, right: DataFrame, texts: DataFrame, spec: MatchSpec = MatchSpec(),
                itself: bool = False, n_block: int | None = None,
                some_without_floor: bool = True, scored: bool = True, some_exact: bool = True) -> DataFrame:
    """Matching nodes as (block, left, right[, score]) with left < right in record order; the
    score is that of the address texts.

    ``texts`` holds the keys of at least the texts of both sides, with ``itself`` of no others.
    ``n_block``, if given, bounds the nodes of a block; see :func:`similar_texts`.
    Equal floors match; different ones never do. Where a floor is absent the descriptions
    decide, provided both have text.
    """
    left, right = (n if "part" in n.columns else n.withColumn("part", F.lit("")) for n in (left, right))
    own = ["block", "part", "text"]
    of = lambda nodes: texts.join(nodes.select(*own).distinct(), own, "left_semi")
    pairs = (similar_texts(texts, texts, spec, True, n_block, scored, True, some_exact) if itself
             else similar_texts(of(left), of(right), spec, False, n_block, scored, True, some_exact))
    score = [F.col("score")] if scored else []
    alike = left.select("block", "part", F.col("text").alias("text_a")).distinct().select(
        "block", "part", "text_a", F.col("text_a").alias("text_b"), *[F.lit(100.0).alias("score") for _ in score])
    pairs = pairs.unionByName(alike)
    once = (F.col("text_a") != F.col("text_b")) | (F.col("a") < F.col("b"))
    ends = [F.col("block"), F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), *score]
    has_floor = F.col("floor") != ""
    a = left.where(has_floor).select("block", "part", F.col("text").alias("text_a"), "floor", F.col("vid").alias("a"))
    b = right.where(has_floor).select("block", "part", F.col("text").alias("text_b"), "floor", F.col("vid").alias("b"))
    edges = (pairs.join(a, ["block", "part", "text_a"]).join(b, ["block", "part", "text_b", "floor"])
             .where(once).select(*ends))
    if some_without_floor:
        edges = edges.unionByName(_description_edges(left, right, pairs, once, ends, spec))
    return edges


def _description_edges(left: DataFrame, right: DataFrame, pairs: DataFrame, once: Column,
                       ends: list[Column], spec: MatchSpec) -> DataFrame:
    """Matches where at least one floor is absent: from similar address texts, an equi-join on
    the other text and a bigram of the description."""
    t = spec.descr_threshold
    common = _common_grams(right.select("by").distinct(), "by")
    sides = []
    for side, nodes in (("a", left), ("b", right)):
        keyed = with_keys(nodes.where(F.col("by") != ""), "by", F.length("by"), t, "keys", common)
        sides.append(keyed.select(
            "block", "part", F.col("text").alias(f"text_{side}"), F.col("floor").alias(f"floor_{side}"),
            F.col("by").alias(f"descr_{side}"), F.col("vid").alias(side),
            F.col("keys").alias(f"keys_{side}")))
    a, b = sides
    x, y = F.col("descr_a"), F.col("descr_b")
    a = pairs.join(a, ["block", "part", "text_a"]).withColumn("key", F.explode("keys_a"))
    b = b.withColumn("key", F.explode("keys_b"))
    on = ["block", "part", "text_b", "key"]
    a, b = split_crowded(a, b, on, "a", "b", spec)
    met = a.join(b, [*on, *CELL]).where(
        ((F.col("floor_a") == "") | (F.col("floor_b") == "")) & once
        & sim.lengths_allow(F.length(x), F.length(y), t)
        & (F.get(F.array_intersect("keys_a", "keys_b"), F.lit(0)) == F.col("key"))
        & sim.edits_allow(x, y, t))
    return _reaching(met, x, y, t).select(*ends)


# ---------------------------------------------------------------------------------- claims

def resolve_claims(edges: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """(vid, leader) of every claimed node of a written edge table; see :mod:`claims`."""
    return claims.resolve_claims(edges, spec.fold_edges)


def with_slices(nodes: DataFrame, largest: int, spec: MatchSpec = MatchSpec()) -> tuple[DataFrame, int]:
    """Add ``slice``, which grows with the record order of a block, and return the highest one.

    The slices of a block end at the shares 1 / growth, 1 / growth**2, ... of its nodes; the first
    holds about ``first_slice`` nodes at most. ``largest`` is the size of the largest block.
    """
    n_cuts = 0
    while spec.first_slice * spec.growth ** n_cuts < largest:
        n_cuts += 1
    if not n_cuts:
        return nodes.withColumn("slice", F.lit(0)), 0
    shares = [spec.growth ** -k for k in range(n_cuts, 0, -1)]
    cuts = nodes.groupBy("block").agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("vid", shares).alias("_cuts"))
    # a block keeps the cuts that leave its first slice no smaller than the others of that step
    least = spec.first_slice / spec.growth
    kept = F.filter("_cuts", lambda _, i: F.col("_n") * F.get(F.lit(shares), i) > least)
    cuts = cuts.select("block", kept.alias("_cuts"))
    placed = nodes.join(cuts, "block").withColumn(
        "slice", F.size(F.filter("_cuts", lambda c: c < F.col("vid")))).drop("_cuts")
    return materialise(placed, "nodes"), n_cuts


def claim_nodes(nodes: DataFrame, spec: MatchSpec = MatchSpec()) -> DataFrame:
    """(vid, leader) of every claimed node of a written node table."""
    shapes = block_shapes(nodes, spec.address_threshold)
    largest, without_floor, some_exact = shapes.agg(F.max("n"), F.sum("open"), F.max("exact")).first()
    nodes = materialise(with_parts(nodes, shapes, spec), "nodes")
    texts = materialise(text_keys(nodes, spec, shapes), "texts")
    waiting, last = with_slices(nodes, largest or 0, spec)

    def edges_of(left, right, itself):
        some = texts
        if itself and last:
            some = texts.join(left.select("block", "part", "text").distinct(), ["block", "part", "text"], "left_semi")
        return match_edges(left, right, some, spec, itself, largest or 0, (without_floor or 0) > 0,
                           scored=False, some_exact=bool(some_exact))

    found = []
    for step in range(last + 1):
        now = waiting.where(F.col("slice") == step)
        own = materialise(
            resolve_claims(materialise(edges_of(now, now, True), "edges"), spec), "claims")
        found.append(own)
        if step == last:
            break
        leaders = now.join(own, "vid", "left_anti")
        later = waiting.where(F.col("slice") > step)
        taken = materialise(
            edges_of(leaders, later, False).groupBy(F.col("right").alias("vid"))
            .agg(F.min("left").alias("leader")), "claims")
        found.append(taken)
        waiting = materialise(later.join(taken, "vid", "left_anti"), "nodes")
    return reduce(DataFrame.unionByName, found)


def find_duplicates(df: DataFrame, f: Fields = Fields(), spec: MatchSpec = MatchSpec()) -> DataFrame:
    """Add ``address_text``, ``flag_fuzzy_duplicate``, ``fuzzy_partner_id`` and
    ``fuzzy_is_leader``. A claimed record's partner is its leader, the leader's partner is the
    last record it claimed."""
    units = materialise(match_units(df, f, spec), "units")
    n_records, without_floor = units.agg(
        F.sum("n"), F.count_if(F.col("floor") == "")).first()
    n_records = n_records or 0
    units = node_keys(units, without_floor > 0)
    nodes = materialise(match_nodes(units), "nodes")
    members = nodes.join(claim_nodes(nodes, spec), "vid", "left").withColumn("leader", F.coalesce("leader", "vid"))
    stars = members.groupBy("leader").agg(F.sum("n").alias("size"), F.max("last_pos").alias("last_pos"))
    stars = stars.where(F.col("size") > 1)
    hot_leaders = hot_only(stars, "size", spec.hot_rows, n_records).select("leader")
    named = (stars.join(df.select(F.col(f.pos).alias("leader"), F.col(f.id).alias("leader_id")), "leader")
             .join(df.select(F.col(f.pos).alias("last_pos"), F.col(f.id).alias("last_id")), "last_pos")
             .select("leader", "leader_id", "last_id"))
    grouped = ["block", "text", "floor", "by"]
    placed = lookup(members.select("vid", *grouped, "leader"), named, ["leader"], hot_leaders, "vid")
    placed = placed.where(F.col("leader_id").isNotNull()).drop("vid")
    found = units.select("n", *UNIT, "by").join(placed, grouped)
    found = materialise(found.select("n", *[F.col(k).alias(f"_m_{k}") for k in UNIT], "leader",
                                     "leader_id", "last_id"), "found")

    keys = [f"_m_{k}" for k in UNIT]
    tagged = df.withColumns({f"_m_{k}": F.when(matchable(f), c)
                             for k, c in unit_columns(f, spec).items()})
    hot = hot_only(found, "n", spec.hot_rows, n_records).select(*keys)
    out = lookup(tagged, found.drop("n"), keys, hot, f.pos)
    leads = F.col(f.pos) == F.col("leader")
    return out.select(
        *df.columns, address_text(f).alias("address_text"),
        F.col("leader").isNotNull().alias("flag_fuzzy_duplicate"),
        F.when(leads, F.col("last_id")).otherwise(F.col("leader_id")).alias("fuzzy_partner_id"),
        F.coalesce(leads, F.lit(False)).alias("fuzzy_is_leader"))
