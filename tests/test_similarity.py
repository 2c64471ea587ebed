import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ledgerlint.functions import similarity as sim, text
from ledgerlint.operators.matching import _lost_grams


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abc é𝒳", max_size=9), st.text("abc é𝒳", max_size=9)), min_size=1, max_size=8))
def test_vectorised_lcs_equals_plain(pairs):
    import pandas as pd
    got = sim.lcs_lengths(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]))
    assert got.tolist() == [plain_lcs(a, b) for a, b in pairs]


def words(rng, n):
    return ["".join(rng.choices("abcd é𝒳", k=rng.randint(0, 14))) for _ in range(n)]


def test_both_forms_and_necessary_tests(spark):
    rng = random.Random(3)
    pairs = list(zip(words(rng, 400), words(rng, 400)))
    pairs += [(a, a[: len(a) // 2] + "x" + a[len(a) // 2:]) for a, _ in pairs]
    a, b = F.col("a"), F.col("b")
    for t in (50, 85, 90):
        rows = spark.createDataFrame(pairs, "a string, b string").select(
            a, b, sim.lcs(a, b).alias("x"), sim.lcs_native(a, b).alias("y"), sim.ratio(a, b).alias("r"),
            sim.ratio(b, a).alias("s"), sim.lengths_allow(F.length(a), F.length(b), t).alias("len"),
            sim.edits_allow(a, b, t).alias("edit"), sim.edits_suffice(a, b, t).alias("sure"), sim.reaches(sim.lcs(a, b), a, b, t).alias("hit")).collect()
        for q in rows:
            assert q.x == q.y == plain_lcs(q.a, q.b)
            assert q.r == q.s and 0 <= q.r <= 100
            assert q.hit == (200 * q.x >= t * (len(q.a) + len(q.b)))
            if q.hit:
                assert q.len and q.edit
            if q.sure:
                assert q.hit


def test_known_ratio(spark):
    df = spark.createDataFrame([("Level 1 Block 51", "Level 2 Block 51"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(sim.ratio(F.col("a"), F.col("b"))).collect()] == [93.75, 100.0]


def test_bigram_bound_holds(spark):
    """Similar texts never lose more distinct bigrams than the bound says."""
    rng = random.Random(5)
    bounds = {}
    for t in (70, 90):
        ls = spark.range(1, 40).select("id", _lost_grams(F.col("id"), t).alias("n")).collect()
        bounds[t] = {r["id"]: r["n"] for r in ls}
    grams = lambda s: {s[i:i + 2] for i in range(len(s) - 1)}
    for _ in range(4000):
        a = "".join(rng.choices("abcdef", k=rng.randint(2, 30)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(b) + 1)
            if rng.random() < 0.5 and i < len(b):
                del b[i]
            else:
                b.insert(i, rng.choice("abcdefg"))
        b = "".join(b)
        for t in (70, 90):
            if b and 200 * plain_lcs(a, b) >= t * (len(a) + len(b)):
                assert len(grams(a) - grams(b)) <= bounds[t][len(a)]


def test_text_functions(spark):
    one = spark.range(1).select(
        text.swap_middle(F.lit("Plaza")), text.capitalised(F.lit("hello World")), text.strip(F.lit("　 x \t")))
    assert tuple(one.first()) == ("Plzaa", "Hello world", "x")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 128, 200])
def test_bits_are_carried_from_word_to_word(n):
    rng = random.Random(n)
    left = ["".join(rng.choices("ab🙂é", k=rng.randint(0, n))) for _ in range(40)] + ["", "a" * n, "a" * n]
    right = ["".join(rng.choices("ab🙂é", k=rng.randint(0, n))) for _ in range(40)] + ["", "a" * n, ""]
    assert sim._lcs_block(left, right).tolist() == [plain_lcs(x, y) for x, y in zip(left, right)]
