"""Personal data by bootstrapped contextual extraction, in Spark expressions only (operator 7).

Four kinds are found by their form. They are the seeds, whether or not they hold blanks or touch
other signs: the words left and right of seeds are lexical patterns, and other identifier-like words
met in the same patterns are instances to be judged. Patterns and instances score each other in
rounds over their graph: a pattern by the mean score of its distinct instances, an instance by its
best well-supported pattern. Instances that reach the confidence are spans of the kind ``id`` and
count as seeds when the rounds start again, until no more join.

Positions come from the pieces of a text between its matches: a match starts after all pieces and
matches before it. Patterns are written so that no text makes them try a place twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlint.sources.tables import materialise

WS, NOT_WS = r"\x20\x09-\x0D", r"[^\x20\x09-\x0D]"
KINDS = ["email", "ip", "card", "phone", "id"]
LOCAL = r"[A-Za-z0-9._%+-]"
FORMS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TRIGGERS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = rf"(?<!{NOT_WS}){NOT_WS}*[0-9@]{NOT_WS}*+"
SEED, GLUE, BLANK = "\ue000", "\ue001", "\ue002"  # marks in texts that only context words are taken from
KEY = ["doc_id", "h", "n"]


@dataclass(frozen=True)
class BootSpec:
    """``support`` distinct seeds a pattern needs, ``confidence`` an instance, ``rounds`` of scoring from
    one set of trusted words, ``digits`` and ``length`` the least of an identifier-like word."""

    support: int = 5
    confidence: float = 0.9
    rounds: int = 3
    digits: int = 4
    length: int = 6


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    values = F.transform(backwards, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        low = lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255
        return F.forall(F.split(match, r"\."), lambda p: F.when(small(p), low(p)).otherwise(F.lit(False)))
    if kind == "card":
        d = _digits(match)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tidy(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[^\p{L}]++|(?<![^\p{L}:=])[^\p{L}:=]++$", ""))


def _unmarked(c: Column) -> Column:
    return F.translate(c, SEED + GLUE + BLANK, "\ufffd" * 3)


def _context(before: Column, after: Column) -> list[Column]:
    """left, right and left2 from the words before and after, joined by blanks."""
    return [_tidy(F.substring_index(before, " ", -1)).alias("left"),
            _tidy(F.substring_index(after, " ", 1)).alias("right"),
            _tidy(F.when(F.contains(before, F.lit(" ")), F.substring_index(before, " ", -2)).otherwise(F.lit(""))).alias("left2")]


def _around(pieces: Column, matches: Column, rest: Column) -> Column:
    """(before, after) of each match: the two words before and the word after it in the text. Matches
    are words of their own, and signs that touch them are no words."""
    marked = F.concat(F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(
        _unmarked(p), F.lit(f"{GLUE} {SEED}"), F.translate(m, " ", BLANK), F.lit(f" {GLUE}"))), ""), _unmarked(rest))
    signs = lambda t: F.contains(t, F.lit(GLUE)) & ~t.rlike(r"[\p{L}\p{N}]")
    shown = lambda t: F.translate(t, BLANK + SEED + GLUE, " ")
    return _let(F.filter(F.split(marked, rf"[{WS}]+"), lambda t: (t != "") & ~signs(t)), lambda words: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.startswith(F.get(words, i), F.lit(SEED))),
        lambda i: F.struct(
            shown(F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1))).alias("before"),
            shown(F.coalesce(F.get(words, i + 1), F.lit(""))).alias("after"))))


def _tokens(spec: BootSpec) -> Column:
    """The words with a digit or ``@`` in order, with the length of the piece before each; those long
    enough with enough digits also with their text and the words around them in the whole text."""
    def token(words: Column, i: Column) -> Column:
        m = F.get(words, i)
        before = _unmarked(F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)))
        after = _unmarked(F.coalesce(F.get(words, i + 1), F.lit("")))
        like = (F.length(m) >= spec.length) & (F.length(_digits(m)) >= spec.digits)
        return F.struct(F.length(m).alias("l"), F.when(like, F.struct(m.alias("m"), *_context(before, after))).alias("x"))

    words = F.filter(F.split("text", rf"[{WS}]+"), lambda w: w != "")
    found = _let(words, lambda ws: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: F.get(ws, i).rlike("[0-9@]")), lambda i: token(ws, i)))
    pieces = F.transform(F.split("text", TOKEN, -1), F.length)
    return F.when(F.col("text").rlike("[0-9@]"), _let(found, lambda ts: F.zip_with(F.slice(pieces, 1, F.size(ts)), ts, lambda p, t: F.struct(
        p.alias("p"), t["l"].alias("l"), t["x"].alias("x")))))


def _found(docs: DataFrame, spec: BootSpec = BootSpec()) -> DataFrame:
    """KEY and, for each kind and the tokens, the matches in order with the piece before each; valid
    matches with their text and the words around them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumns(
        {"h": F.xxhash64("text"), "n": F.length("text")})
    some_digit = F.col("text").rlike("[0-9]")
    cases = {k: F.col("text").contains(t) & some_digit if t in (".", "+") else F.col("text").contains(t) if t else some_digit
             for k, t in TRIGGERS.items()}
    matched = {f"m_{k}": F.when(cases[k], F.regexp_extract_all("text", F.lit(FORMS[k]), F.lit(0))) for k in FORMS}
    rows = rows.withColumns(matched)
    def placed(kind: str) -> Column:
        matches = F.col(f"m_{kind}")

        def match(x: Column) -> Column:
            return F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("l"), x["ok"].alias("ok"), F.when(
                x["ok"], F.struct(x["m"].alias("word"), *_context(x["around"]["before"], x["around"]["after"]))).alias("seed"))

        def with_words(parts: Column) -> Column:
            pieces, rest = F.slice(parts, 1, F.size(matches)), F.element_at(parts, -1)
            judged = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m"), valid(kind, m).alias("ok")))
            none = F.array().cast("array<struct<before:string,after:string>>")
            return _let(judged, lambda js: F.transform(F.zip_with(
                js, F.when(F.exists(js, lambda j: j["ok"]), _around(pieces, matches, rest)).otherwise(none),
                lambda j, a: F.struct(j["p"].alias("p"), j["m"].alias("m"), j["ok"].alias("ok"), a.alias("around"))), match))

        return F.when(F.size(matches) > 0, _let(F.split("text", FORMS[kind], -1), with_words)).alias(kind)

    return rows.select(*KEY, *[placed(k) for k in FORMS], _tokens(spec).alias("token"))


def _starts(rows: DataFrame, group: list[str]) -> DataFrame:
    """Add ``start`` to rows (group, i, p, l): all pieces up to and all matches before the i-th."""
    w = Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("start", (F.sum(F.col("p") + F.col("l")).over(w) - F.col("l")).cast("int"))


def base_spans(found: DataFrame) -> DataFrame:
    """(KEY, kind, start, stop, seed) of the valid matches; seed has their text and context."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in FORMS])
    some = F.greatest(*[F.coalesce(F.size(k), F.lit(-1)) for k in FORMS])
    rows = (found.where(some > 0).select(*KEY, F.explode(kinds).alias("k"))
            .select(*KEY, "k.kind", F.posexplode("k.found").alias("i", "x"))
            .select(*KEY, "kind", "i", "x.p", "x.l", "x.ok", "x.seed").distinct())
    return _starts(rows, [*KEY, "kind"]).where("ok").select(
        *KEY, "kind", "start", (F.col("start") + F.col("l")).alias("stop"), "seed")


def seeds(base: DataFrame) -> DataFrame:
    """(KEY, start, stop, word, left, right, left2) of the base spans that lie in no other one."""
    before = Window.partitionBy(*KEY).orderBy("start", F.desc("stop"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max("stop").over(before) >= F.col("stop"), F.lit(False))
    return base.withColumn("inside", inside).where(~F.col("inside")).select(*KEY, "start", "stop", "seed.*")


def occurrences(found: DataFrame, base: DataFrame, spec: BootSpec) -> DataFrame:
    """(KEY, start, stop, word, left, right, left2, seed): identifier-like words outside the base
    spans, and the base spans themselves (seeds), with the words around them."""
    rows = (found.where(F.size("token") > 0).select(*KEY, F.posexplode("token").alias("i", "t"))
            .select(*KEY, "i", "t.*").distinct())
    rows = _starts(rows, KEY).where(F.col("x").isNotNull()).select(*KEY, "start", "x.*")
    lead = F.length(F.regexp_extract("m", r"^[\"'(\[<{]*+", 0))
    last = r"[\"')\]>}.,;:!?]"
    rows = rows.withColumn("start", F.col("start") + lead).withColumn(
        "word", F.regexp_replace("m", rf"^[\"'(\[<{{]++|(?<!{last}){last}++$", ""))
    rows = rows.withColumn("stop", F.col("start") + F.length("word")).where(F.length("word") >= spec.length)
    spans = base.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    spans = spans.select(*[F.col(k).alias(f"_{k}") for k in KEY], "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,stop:int>>"))
    apart = ~F.exists(spans, lambda s: (s["start"] < F.col("stop")) & (s["stop"] > F.col("start")))
    like = F.length(_digits(F.col("word"))) >= spec.digits
    columns = [*KEY, "start", "stop", "word", "left", "right", "left2"]
    return joined.where(apart & like).select(*columns, F.lit(False).alias("seed")).unionByName(
        seeds(base).select(*columns, F.lit(True).alias("seed")))


def discovered(words: DataFrame, spec: BootSpec) -> DataFrame:
    """The words (not seeds) that reach the confidence. Rounds over the pattern-instance graph start
    from the trusted words; those that reach the confidence are trusted as seeds from then on, also
    for the support of patterns, and the rounds start again, until no word joins. A pattern joins only
    over words that have, so then none of them does either."""
    patterns = F.array(*[F.when(F.col(c) != "", F.concat(F.lit(f"{c}:"), F.col(c))) for c in ("left", "right", "left2")])
    links = words.select("word", "seed", F.explode(patterns).alias("pattern")).where(F.col("pattern").isNotNull())
    links = materialise(links.groupBy("pattern", "word").agg(F.max("seed").alias("seed")), "pattern-instances")
    trusted = materialise(links.groupBy("word").agg(F.max("seed").alias("trusted")).withColumn("is_seed", F.col("trusted")), "trusted-0")
    number, k = trusted.where("trusted").count(), 0
    while True:
        own = F.col("trusted").cast("double")
        scores = trusted.withColumn("score", own)
        for r in range(spec.rounds):
            strong = links.join(scores, "word").groupBy("pattern").agg(
                F.avg("score").alias("trust"), F.count_if("trusted").alias("support")).where(F.col("support") >= spec.support)
            best = links.join(strong, "pattern").groupBy("word").agg(F.max("trust").alias("trust"))
            scores = trusted.join(best, "word", "left").select(
                "word", "trusted", "is_seed", F.greatest(own, F.coalesce("trust", F.lit(0.0))).alias("score"))
            scores = materialise(scores, f"instance-scores-{k}-{r}")
        k += 1
        trusted = materialise(scores.select(
            "word", (F.col("trusted") | (F.col("score") >= spec.confidence)).alias("trusted"), "is_seed"), f"trusted-{k}")
        before, number = number, trusted.where("trusted").count()
        if number == before:
            return trusted.where("trusted and not is_seed").select("word")


def spans(docs: DataFrame, spec: BootSpec = BootSpec()) -> tuple[DataFrame, DataFrame]:
    """(keys, spans): KEY of every row; (KEY, kind, start, stop) of all spans of distinct documents,
    in code points, end exclusive. KEY is doc_id, a hash of the text and its length."""
    found = materialise(_found(docs, spec), "pii-found")
    base = materialise(base_spans(found), "pii-base")
    words = materialise(occurrences(found, base, spec), "pii-words")
    new = words.where(~F.col("seed")).join(discovered(words, spec), "word").select(
        *KEY, F.lit("id").alias("kind"), "start", "stop")
    return found.select(*KEY), base.drop("seed").unionByName(new.distinct())


def _by_document(all_spans: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("rank")
    return all_spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(rank, "start", "stop", "kind"))).alias("s"))


def _joined(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    g = grouped.select(*[F.col(k).alias(f"_{k}") for k in KEY], "s")
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("n") == F.col("_n"))
    return docs.join(g, on, "left").drop(*[f"_{k}" for k in KEY])


def pii_digest(docs: DataFrame, spec: BootSpec = BootSpec()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row. A null text is an
    empty one; repeated rows get equal results; an empty table gives no rows."""
    keys, every = spans(docs, spec)
    out = _joined(keys, _by_document(every)).withColumn(
        "s", F.coalesce("s", F.array().cast("array<struct<rank:int,start:int,stop:int,kind:string>>")))
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    number = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in FORMS]
    base = F.filter("s", lambda x: x["kind"] != "id")
    return out.select("doc_id", *counts, F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("s")).alias("spans"))


def redacted(docs: DataFrame, spec: BootSpec = BootSpec()) -> DataFrame:
    """The same rows with every span of ``text`` replaced by its kind in brackets; overlapping spans
    are replaced together, under the first one's kind. Null texts stay null."""
    _, every = spans(docs, spec)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    once = every.withColumn("r", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")))
    before = Window.partitionBy(*KEY).orderBy("start", "r").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*KEY).orderBy("start", "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    once = once.withColumn("fresh", (F.col("start") >= F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("int"))
    once = once.withColumn("run", F.sum("fresh").over(upto)).groupBy(*KEY, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.min_by("kind", F.struct("start", "r")).alias("kind"))
    grouped = once.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", "stop", "kind"))).alias("s"))
    rows = docs.withColumns({"_h": F.xxhash64(text), "_n": F.length(text)})
    g = grouped.select(F.col("doc_id").alias("_id"), F.col("h").alias("_gh"), F.col("n").alias("_gn"), "s")
    joined = rows.join(g, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_gh")) & (F.col("_n") == F.col("_gn")), "left")
    cut = F.transform(F.col("s"), lambda x, i: F.concat(
        F.substring("text", F.coalesce(F.get("s", i - 1)["stop"], F.lit(0)) + 1,
                    x["start"] - F.coalesce(F.get("s", i - 1)["stop"], F.lit(0))),
        F.lit("["), F.upper(x["kind"]), F.lit("]")))
    rest = F.substring("text", F.element_at("s", -1)["stop"] + 1, F.length("text"))
    new = F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(cut, ""), rest))
    return joined.withColumn("text", new).select(*docs.columns)
