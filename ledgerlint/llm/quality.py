"""Quality rules as a learned decision list (operator 3).

Counts are taken from whole texts once. Sequential covering then learns an ordered list of
conjunctions of thresholds from labelled documents: a rule is grown on two thirds of the rows left,
one condition at a time by information gain, pruned on the other third, and kept if it is precise
there; what it covers is taken out before the next. The list becomes one conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlint.llm.worker import release

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next"]
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
LABELLED_ROWS = 20_000  # labelled rows the list is learned from, at most


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text: words, their characters, symbols, lines with a word that repeat an
    earlier line, words inside 8-word windows found twice, lines with a word, words equal to the
    word before."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    chars = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    same = int((ids[1:] == ids[:-1]).sum())
    repeated = 0
    if n > WINDOW and len(number) < n:
        keys = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
        keys *= np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(32)
        m = n - WINDOW + 1
        hashes, factor = np.zeros(m, np.uint64), 1
        for i in range(WINDOW):
            hashes += keys[i: i + m] * np.uint64(factor)
            factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        order = np.argsort(hashes, kind="stable")
        equal = hashes[order][1:] == hashes[order][:-1]
        if equal.any():
            twice = np.zeros(m, bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            edge = np.zeros(n + 1, np.int64)
            edge[:m] += twice
            edge[WINDOW:] -= twice
            repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), same


def with_counts(docs: DataFrame) -> DataFrame:
    """Add COUNTS of ``text`` to every row (null text: all zero)."""
    schema = StructType([*docs.schema.fields, *[StructField(c, LongType()) for c in COUNTS]])

    def counted(batches):
        release()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                columns = zip(*[counts(t) for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in columns]],
                                                 [*part.schema.names, *COUNTS])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(counted, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The statistics that conditions are about."""
    of = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": of("n_symbols", "word_chars"), "dup_line_share": of("n_dup_lines", "n_lines"),
            "repeat_share": of("n_repeat_words", "n_words"), "same_next_share": of("n_same_next", "n_words"),
            "mean_word": of("word_chars", "n_words"), "n_words": F.col("n_words").cast("double")}


@dataclass(frozen=True)
class ListSpec:
    """``precision`` is what a rule must reach on the rows it is pruned on, ``cover`` the rows it
    must cover there, ``rules``/``conditions`` the most that are kept, ``cuts`` the thresholds
    tried for a statistic."""

    precision: float = 0.9
    cover: int = 5
    rules: int = 12
    conditions: int = 4
    cuts: int = 64


Condition = tuple[str, str, float]


def _holds(x: dict[str, np.ndarray], rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for name, sign, cut in rule:
        out &= x[name] > cut if sign == ">" else x[name] <= cut
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, cuts: dict[str, np.ndarray], spec: ListSpec) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < spec.conditions and bad[inside].any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name, points in cuts.items():
            for cut in points:
                above = inside & (x[name] > cut)
                for sign, hit in ((">", above), ("<=", inside & ~above)):
                    p, n = (hit & bad).sum(), (hit & ~bad).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - before)
                        if gain > best[0]:
                            best = (gain, (name, sign, float(cut)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(x, [best[1]])
    return rule


def _worth(x: dict[str, np.ndarray], bad: np.ndarray, rule: list[Condition]) -> tuple[float, int]:
    hit = _holds(x, rule)
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return ((p - n) / (p + n) if p + n else -1.0), p


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, fold: np.ndarray, spec: ListSpec = ListSpec()) -> list[list[Condition]]:
    """Ordered rules that reject; ``fold`` 0 or 1 grows, 2 prunes."""
    cuts = {}
    for name, v in x.items():
        values = np.unique(v)
        middles = (values[1:] + values[:-1]) / 2
        picked = np.linspace(0, max(len(middles) - 1, 0), min(spec.cuts, len(middles))).round().astype(int)
        cuts[name] = middles[np.unique(picked)]
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < spec.rules:
        grow, prune = left & (fold < 2), left & (fold == 2)
        if not bad[grow].any():
            break
        at = lambda mask: ({k: v[mask] for k, v in x.items()}, bad[mask])
        rule = _grow(*at(grow), cuts, spec)
        if not rule:
            break
        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (_worth(*at(prune), r)[0], -len(r)))
        worth, found = _worth(*at(prune), rule)
        if worth < 2 * spec.precision - 1 or found < spec.cover:
            break
        rules.append(rule)
        left &= ~_holds(x, rule)
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional: the first rule that holds rejects, none keeps."""
    out, columns = None, shares()
    for rule in rules:
        holds = F.lit(True)
        for name, sign, cut in rule:
            holds = holds & (columns[name] > F.lit(cut) if sign == ">" else columns[name] <= F.lit(cut))
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learned_rules(docs: DataFrame, labels: DataFrame, spec: ListSpec = ListSpec(),
                  sample: int = LABELLED_ROWS) -> list[list[Condition]]:
    """Rules from the documents of at most ``sample`` labels (doc_id, quality 0 or 1), those first in
    the order of a hash of doc_id. Rows that fail the base rules teach nothing; no labels, no rules."""
    columns = shares()
    marked = (labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample))
    known = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    rows = (with_counts(known).where(~base_failed())
            .select("h", "doc_id", "quality", *[c.alias(f"x_{k}") for k, c in columns.items()])
            .orderBy("h", "doc_id", "x_n_words", "x_mean_word").limit(sample).toPandas())
    if not len(rows):
        return []
    x = {k: rows[f"x_{k}"].to_numpy(float) for k in columns}
    return learn_list(x, (rows["quality"] == 0).to_numpy(), (rows["h"] % 3).to_numpy(), spec)


def judged(docs: DataFrame, labels: DataFrame, spec: ListSpec = ListSpec()) -> DataFrame:
    """The rows of ``docs`` with COUNTS, base_failed and kept. Repeated rows are judged alike; a null
    or empty text has no words and fails the base rules; an empty table gives no rows. Columns of
    these names that ``docs`` already has are replaced."""
    rules = learned_rules(docs, labels, spec)
    rows = with_counts(docs.drop(*COUNTS, "base_failed", "kept"))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & verdict(rules))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs.select(F.col("doc_id").cast("long"), "text"), labels).drop("text")
