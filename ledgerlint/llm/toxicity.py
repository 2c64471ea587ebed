"""Toxicity by boosted trees over dense features, calibrated by isotonic regression (operator 9).

Labelled documents outside the held-out fold are split in three by a hash: one part teaches the
lexicon (words and word beginnings seen in far more toxic than other documents), one the trees, one
the calibration, so that no step is fitted on what an earlier one has already seen. The features
of a text are lexicon densities, lexicon words near the second person, capitals, punctuation and
obfuscated words. Only they enter a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlint.sources.tables import materialise

LABELLED_ROWS = 20_000  # labelled rows the model is fitted on, at most
LEXICON_SIZE = 600  # units of the lexicon, at most
LEAST_DOCS, LEAST_ODDS = 6, 2.0  # toxic documents with a unit, and its log odds ratio, at least
PREFIXES = (4, 5)
NEAR = 5  # words
FEATURES = ["word_density", "prefix_density", "n_word_hits", "n_prefix_hits", "near_second_person",
            "second_person", "capitals", "punctuation", "obfuscated", "log_words"]
# Second-person words of the languages served.
SECOND_PERSON = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer "
                 "ti tú tus usted ustedes vosotros su").split()
WORD = regex.compile(r"[\p{L}\p{M}\p{N}@$*!_'’-]+")
LOOK_ALIKE = str.maketrans("013457@$!", "oleastasi")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: str) -> list[str]:
    return [w.strip("'’-_!*") for w in WORD.findall(text.lower())]


def units(word: str) -> list[str]:
    """The word and its beginnings (marked by a trailing ``+``)."""
    return [word] + [word[:k] + "+" for k in PREFIXES if len(word) > k]


def plain(word: str) -> str:
    """Look-alike digits and signs read as letters, inner stars left out."""
    return word.translate(LOOK_ALIKE).replace("*", "")


def features(text: str | None, lexicon: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    words = words_of(text)
    n = max(1, len(words))
    hits, near, prefix, odd, second = [], 0, 0, 0, []
    you = set(SECOND_PERSON)
    for i, w in enumerate(words):
        if not w:
            continue
        if not w.isalpha() and not w.isdigit() and any(map(str.isalpha, w)) and "'" not in w and "-" not in w:
            clear = plain(w)
            odd += clear != w
            w = clear
        if w in you:
            second.append(i)
        if w in lexicon:
            hits.append(i)
        elif len(w) > PREFIXES[0] and any(w[:k] + "+" in lexicon for k in PREFIXES if len(w) > k):
            prefix += 1
            hits.append(i)
    if second and hits:
        at = np.searchsorted(second, hits)
        lists = np.array([-10**9, *second, 10**9])
        near = int((np.minimum(np.array(hits) - lists[at], lists[at + 1] - np.array(hits)) <= NEAR).sum())
    word_hits = len(hits) - prefix
    letters = max(1, len(text))
    return (word_hits / n, prefix / n, math.log1p(word_hits), math.log1p(prefix), near / n, len(second) / n,
            sum(map(str.isupper, text)) / letters, (text.count("!") + text.count("?")) / letters, odd / n, math.log1p(len(words)))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """doc_id, text, toxic, part (0 lexicon, 1 trees, 2 calibration) of the labelled rows used."""
    marked = (labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(9))).orderBy("h", "doc_id").limit(sample))
    part = F.pmod("h", F.lit(3)).cast("int").alias("part")
    return docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("doc_id", "text", "toxic", part)


def learned_lexicon(rows: DataFrame) -> frozenset[str]:
    """Units of the toxic documents of a labelled table, by smoothed log odds; LEXICON_SIZE at most."""
    def found(batches):
        for batch in batches:
            out, toxic = [], []
            for text, mark in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                seen = {u for w in words_of(text or "") if len(w) > 2 for u in units(w)}
                out += seen
                toxic += [mark] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int64())], ["unit", "toxic"])

    sides = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sides.get(0) or not sides.get(1):
        return frozenset()
    counted = rows.select("text", F.col("toxic").cast("long")).mapInArrow(found, "unit string, toxic long").groupBy(
        "unit").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (sides[1] + 1)) - F.log((F.col("good") + 0.5) / (sides[0] + 1))
    best = (counted.where(F.col("bad") >= LEAST_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
            .orderBy(F.desc(F.col("odds") * F.log("bad")), "unit").limit(LEXICON_SIZE).select("unit"))
    return frozenset(r["unit"] for r in best.collect())


def text_features(docs: DataFrame, lexicon: frozenset[str], keep: list[str]) -> DataFrame:
    """FEATURES of every row next to the columns ``keep``; the lexicon is of bounded size."""
    shipped = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measured(batches):
        for batch in batches:
            rows = [features(t, shipped.value) for t in batch["text"].to_pylist()]
            columns = list(zip(*rows)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keep], *[pa.array(c, pa.float64()) for c in columns]],
                                             [*keep, *FEATURES])

    kept = docs.select(*[F.col(k).cast("long") for k in keep], F.col("text").cast("string"))
    return kept.mapInArrow(measured, ", ".join([f"{k} long" for k in keep] + [f"{f} double" for f in FEATURES]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = LABELLED_ROWS, trees: int = 20, depth: int = 3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row. A null text is scored as an empty one.
    Without labels of both kinds every score is the share of toxic labels (0 without any)."""
    spark = docs.sparkSession
    training = _training(docs, labels, sample)
    lexicon = learned_lexicon(training.where("part = 0"))
    known = materialise(text_features(training.where("part > 0"), lexicon, ["doc_id", "toxic", "part"]), "toxicity-features")
    known = materialise(known.repartition(1).sortWithinPartitions("doc_id", "toxic", "part", *FEATURES), "toxicity-rows")  # numbers only
    sides = {(r["part"], r["toxic"]): r["count"] for r in known.groupBy("part", "toxic").count().collect()}
    scored = text_features(docs, lexicon, ["doc_id"])
    marks = ["doc_id", held_out(F.col("doc_id")).alias("held_out")]
    if not all(sides.get((p, t)) for p in (1, 2) for t in (0, 1)):
        bad, all_rows = sum(v for (_, t), v in sides.items() if t), sum(sides.values())
        score = F.lit(bad / all_rows if all_rows else 0.0)
        return scored.select(*marks, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")
    fitted = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=trees, maxDepth=depth, seed=9).fit(
        assemble.transform(known.where("part = 1")))
    margin = lambda df: fitted.transform(assemble.transform(df)).withColumn(
        "margin", vector_to_array("rawPrediction")[1])
    level = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="level").fit(
        margin(known.where("part = 2")).select("margin", F.col("toxic").cast("double")))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("level")))
    return level.transform(margin(scored)).select(
        *marks, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
