"""The matcher against a plain sequential reading of its definition."""

import random

import pytest
from pyspark.sql import functions as F
from test_similarity import plain_lcs

from ledgerlint.operators import matching, queue
from ledgerlint.specs import MatchSpec


def reach(a, b, t):
    return 200 * plain_lcs(a, b) >= t * (len(a) + len(b))


def match(a, b, mode):
    fill = "nan" if mode == "literal" else ""
    floor = lambda r: (fill if r["floor_level"] is None else r["floor_level"]).strip().lower()
    descr = lambda r: fill if r["location_description"] is None else r["location_description"]
    address = lambda r: (r["building_name"] + " " + r["road_name"]).strip()
    if not reach(address(a), address(b), 90):
        return False
    if floor(a) and floor(b):
        return floor(a) == floor(b)
    return bool(descr(a) and descr(b) and reach(descr(a), descr(b), 85))


def one_by_one(rows, mode):
    """Records in order; each unclaimed one claims every later unclaimed match of its road."""
    claimed, partner = set(), {}
    for i, a in enumerate(rows):
        if not a["building_name"] or not (a["road_name"] or "").strip() or i in claimed:
            continue
        for j in range(i + 1, len(rows)):
            b = rows[j]
            same = (a["road_name"] or "").strip().lower() == (b["road_name"] or "").strip().lower()
            if same and b["building_name"] and j not in claimed and match(a, b, mode):
                claimed.add(j)
                partner[j], partner[i] = i, j
    return partner


def random_rows(seed, n):
    rng = random.Random(seed)
    names = ["Block 1", "Block 12", "Blk 12", "Blk 13", "Mall", "Malls", "Big Mall", "aaaaaaaaaa", "aaaaaaaab",
             "bbbbbbbbbbbb", "Tower", "tower", "Centre 5", "Centre 55", "", None, " ", "A", "B", "Bee"]
    return [dict(building_name=rng.choice(names),
                 road_name=rng.choice(["Main Road", " MAIN ROAD ", "A", "Long Winding Valley Road", None, " "]),
                 floor_level=rng.choice(["1", " 1", "2", None, "", " ", "B1", "b1"]),
                 location_description=rng.choice(["Lobby", "Lobby 1", "Lobby 2", None, "", "At the lift"]))
            for _ in range(n)]


PLANS = [
    {}, {"fold_edges": 0}, {"first_slice": 5, "growth": 2}, {"hot_rows": 2, "task_pairs": 4},
    {"first_slice": 7, "growth": 3, "fold_edges": 3, "hot_rows": 3, "task_pairs": 1},
]


@pytest.mark.parametrize("mode", ["literal", "unknown"])
@pytest.mark.parametrize("plan", range(len(PLANS)))
def test_claims_equal_the_sequential_reading(spark, registry, mode, plan):
    rows = random_rows(plan, 70)
    df = registry(rows).repartition(5)
    got = matching.find_duplicates(df, spec=MatchSpec(null_units=mode, **PLANS[plan])).collect()
    expected = one_by_one(rows, mode)
    assert {r["pos"]: r["fuzzy_partner_id"] for r in got if r["flag_fuzzy_duplicate"]} == {
        i: f"R{j:03d}" for i, j in expected.items()}
    assert len(got) == len(rows)
    assert {r["pos"] for r in got if r["fuzzy_is_leader"]} == {i for i, j in expected.items() if j > i}


def test_rounds_equal_fold_on_random_graphs(spark):
    rng = random.Random(11)
    for _ in range(3):
        edges = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)})
        df = spark.createDataFrame([("b", i, j) for i, j in edges], "block string, left long, right long")
        fold = {tuple(r) for r in matching.resolve_claims(df, MatchSpec()).select("vid", "leader").collect()}
        rounds = matching.resolve_claims(df, MatchSpec(fold_edges=0)).select("vid", "leader")
        assert fold == {tuple(r) for r in rounds.collect()}
        claimed = {}
        for i, j in edges:
            if i not in claimed and j not in claimed:
                claimed[j] = i
        assert fold == set(claimed.items())


def test_edges_equal_all_pairs(spark, registry):
    """Random texts of many lengths, with few distinct characters and shared road names."""
    rng = random.Random(2)
    rows = []
    for _ in range(160):
        name = "".join(rng.choices("ab" if rng.random() < 0.3 else "abcdefgh ", k=rng.randint(1, 25))).strip() or "x"
        rows.append(dict(building_name=name, road_name=rng.choice(["R", "Upper Valley Road"])))
        if rng.random() < 0.6:
            i = rng.randrange(len(name))
            rows.append(dict(rows[-1], building_name=name[:i] + rng.choice("abz") + name[i + rng.randint(0, 1):]))
    df = registry(rows)
    for spec in (MatchSpec(), MatchSpec(address_threshold=70), MatchSpec(task_pairs=9)):
        nodes = matching.match_nodes(matching.node_keys(matching.match_units(df, spec=spec), False)).cache()
        texts = matching.text_keys(nodes, spec)
        n = None if spec.task_pairs == 9 else 0
        got = sorted(tuple(r) for r in matching.similar_texts(texts, texts, spec, True, n)
                     .select("text_a", "text_b").collect())
        by_road = {}
        for r in rows:
            by_road.setdefault(r["road_name"], set()).add((r["building_name"] + " " + r["road_name"]).strip())
        want = sorted((a, b) for ts in by_road.values() for a in ts for b in ts
                      if a < b and reach(a, b, spec.address_threshold))
        assert got == want and len(want) > 20
        unscored = matching.similar_texts(texts, texts, spec, True, n, scored=False)
        assert sorted(tuple(r)[1:] for r in unscored.collect()) == want
        nodes.unpersist()


def test_one_block_of_copies_stays_linear(spark, registry):
    """Copies collapse to one node: no pair of them is ever written."""
    df = registry([{} for _ in range(500)])
    nodes = matching.match_nodes(matching.node_keys(matching.match_units(df), False))
    assert nodes.count() == 1 and nodes.first()["n"] == 500
    got = matching.find_duplicates(df, spec=MatchSpec(hot_rows=100))
    assert got.where("fuzzy_partner_id = 'R000'").count() == 499
    assert got.where("pos = 0").first()["fuzzy_partner_id"] == "R499"


def test_descriptions_do_not_split_nodes_where_floors_decide(spark, registry):
    """A building with one description per record: one node where all records have a floor, and
    the same claims either way."""
    rows = [dict(building_name="Tower", road_name="Main Road", floor_level="1",
                 location_description=f"Shop number {i * 7919 % 1000} of the mall") for i in range(40)]
    units = matching.match_units(registry(rows))
    assert units.count() == 40 and matching.match_nodes(matching.node_keys(units, False)).count() == 1
    rows[20]["floor_level"] = " "
    nodes = matching.match_nodes(matching.node_keys(matching.match_units(registry(rows)), True))
    assert nodes.count() == 40
    got = matching.find_duplicates(registry(rows)).where("flag_fuzzy_duplicate").collect()
    assert {r["pos"]: r["fuzzy_partner_id"] for r in got} == {
        i: f"R{j:03d}" for i, j in one_by_one(rows, "literal").items()}


def test_dense_block_is_claimed_slice_by_slice(spark, registry):
    """All names alike but distinct: slices must give the same as one pass, writing fewer edges."""
    rows = [dict(building_name=f"Harbour Front Centre Tower {i:03d}", road_name="Long Winding Valley Road")
            for i in range(200)]
    df = registry(rows)
    written = []
    original = matching.materialise

    def counting(d, label):
        out = original(d, label)
        if label == "edges":
            written.append(out.count())
        return out

    matching.materialise = counting
    try:
        def run(**kw):
            written.clear()
            out = matching.find_duplicates(df, spec=MatchSpec(**kw)).select("pos", "fuzzy_partner_id").collect()
            return {tuple(r) for r in out}, sum(written)
        whole, all_edges = run()
        sliced, few_edges = run(first_slice=10, growth=4)
    finally:
        matching.materialise = original
    assert whole == sliced
    assert few_edges < all_edges / 5


def test_slices_keep_the_record_order_of_every_block(spark):
    rows = [("big", v) for v in range(0, 2000, 2)] + [("small", v) for v in range(1, 40, 2)]
    nodes = spark.createDataFrame(rows, "block string, vid long")
    spec = MatchSpec(first_slice=50, growth=4)
    out, last = matching.with_slices(nodes, 1000, spec)
    got = sorted((r["block"], r["vid"], r["slice"]) for r in out.collect())
    assert [r[:2] for r in got] == sorted(rows)
    big = [s for b, _, s in got if b == "big"]
    assert big == sorted(big) and set(big) == set(range(last + 1)) and big.count(0) <= 50
    assert {s for b, _, s in got if b == "small"} == {0}


def test_crowded_keys_are_split_on_both_sides(spark):
    """One key with 400 x 300 pairs and one with 5 x 600: every pair once, no cell too large."""
    a = spark.createDataFrame([("x", i) for i in range(400)] + [("y", i) for i in range(5)], "k string, a long")
    b = spark.createDataFrame([("x", i) for i in range(300)] + [("y", i) for i in range(600)], "k string, b long")
    left, right = matching.split_crowded(a, b, ["k"], "a", "b", MatchSpec(task_pairs=1000))
    pairs = left.join(right, ["k", *matching.CELL])
    assert pairs.count() == pairs.distinct().count() == 400 * 300 + 5 * 600
    cells = pairs.groupBy("k", *matching.CELL).count().collect()
    assert max(r["count"] for r in cells) <= 4000 and len(cells) > 100
    assert max(left.groupBy("k", "a").count().where("k = 'y'").toPandas()["count"]) <= 3


def test_comparisons_of_a_dense_block_grow_with_its_texts(spark, registry):
    """Twice the distinct names of one road must not give four times the similar pairs."""
    original, seen = matching.similar_texts, []

    def counting(*args, **kw):
        out = original(*args, **kw)
        seen.append(out.count())
        return out

    def made(n):
        seen.clear()
        matching.find_duplicates(
            registry([dict(building_name=f"Harbour Front Centre Tower {i:03d}",
                           road_name="Long Winding Valley Road") for i in range(n)]),
            spec=MatchSpec(first_slice=32, growth=8)).count()
        return sum(seen)

    matching.similar_texts = counting
    try:
        few, many = made(250), made(500)
    finally:
        matching.similar_texts = original
    assert few < 250 * 20 and many < 2.6 * few


def test_floor_conflict_and_missing_floors(spark, registry):
    def flagged(rows, mode="literal"):
        out = matching.find_duplicates(registry(rows), spec=MatchSpec(null_units=mode))
        return [r[0] for r in out.orderBy("pos").select("flag_fuzzy_duplicate").collect()]
    assert flagged([dict(building_name="Level 1 Block 51", floor_level="1"),
                    dict(building_name="Level 2 Block 51", floor_level="2")]) == [False, False]
    both, one = [dict(floor_level=None)] * 2, [dict(floor_level=None), dict(floor_level="1")]
    assert flagged(both) == [True, True] and flagged(one) == [False, False]
    assert flagged(both, "unknown") == [True, True] and flagged(one, "unknown") == [True, True]
    far = [dict(floor_level=None, location_description="Lobby"), dict(floor_level="1", location_description="Roof")]
    assert flagged(far, "unknown") == [False, False]


def test_star_partners_and_collapse(spark, registry):
    """Leader R5 with leaves R2 and R3: both leaves stay under ``pair``, the leader under ``cluster``."""
    df = registry([dict(record_id=i) for i in ("R5", "R2", "R3")])
    out = matching.find_duplicates(df)
    partner = {r["record_id"]: r["fuzzy_partner_id"] for r in out.collect()}
    assert partner == {"R5": "R3", "R2": "R5", "R3": "R5"}
    kept = lambda mode: {r["record_id"] for r in queue.collapsed(out, mode).collect()}
    assert kept("pair") == {"R2", "R3"} and kept("cluster") == {"R5"}


def test_order_not_layout_decides(spark, registry):
    """a-b-c where only neighbours match: a claims b, c stays; whatever the row layout."""
    a, b, c = "Harbour Tower Eleven", "Harbour Tower Elevenxxxxx", "Harbour Tower Elevenxxxxxxxxxx"
    df = registry([dict(building_name=n) for n in (a, b, c)])
    for layout in (df, df.orderBy(F.desc("pos")), df.repartition(3)):
        out = matching.find_duplicates(layout).orderBy("pos")
        flags = [r["flag_fuzzy_duplicate"] for r in out.collect()]
        assert flags == [True, True, False]


def test_pairs_compared_on_a_long_road_grow_with_its_names(spark):
    """Pairs that meet under a key, for 500 and 1,000 names of which many are alike: below the square."""
    rng = random.Random(9)
    words = ["Harbour", "Front", "Garden", "Tower", "Plaza", "Court", "Central", "North", "Block", "Lodge"]
    road = " Long Winding Valley Road"
    names = sorted({" ".join(rng.sample(words, 3)) + f" {rng.randrange(900):03d}" + road for _ in range(4000)})
    rng.shuffle(names)
    original, met = matching.similar_texts, []

    def counting(left, right, spec, itself=False, *args, **kw):
        count = lambda df: df.withColumn("key", F.explode("keys")).groupBy("block", "part", "key").count()
        pairs = count(left).join(count(right).withColumnRenamed("count", "other"), ["block", "part", "key"])
        met.append((pairs.agg(F.sum(F.col("count") * F.col("other"))).first()[0] or 0) / (2 if itself else 1))
        return original(left, right, spec, itself, *args, **kw)

    def compared(n):
        met.clear()
        rows = [("r", name, "1", "", i, i, 1) for i, name in enumerate(names[:n])]
        nodes = spark.createDataFrame(rows, "block string, text string, floor string, by string, vid long, last_pos long, n long")
        matching.claim_nodes(matching.materialise(nodes, "nodes"), MatchSpec(first_slice=64)).count()
        return sum(met)

    matching.similar_texts = counting
    try:
        few, more = compared(500), compared(1000)
    finally:
        matching.similar_texts = original
    assert more < 3.4 * few


def test_common_ends_and_floors_leave_the_result(spark, registry):
    """A block whose texts begin and end alike, with many floors: compared floor by floor on what differs."""
    rng = random.Random(3)
    rows = [dict(building_name=f"Customer#0000{rng.randrange(10**5):05d}", road_name="Main Road", floor_level=rng.choice("123"), location_description=None)
            for _ in range(150)]
    shapes = matching.block_shapes(matching.match_nodes(matching.node_keys(matching.match_units(registry(rows)), False)), 90).first()
    assert (shapes["left"], shapes["right"]) == (len("Customer#0000"), len(" Main Road")) and shapes["by_floor"] and shapes["all_weak"]
    got = matching.find_duplicates(registry(rows), spec=MatchSpec(first_slice=40)).where("flag_fuzzy_duplicate").collect()
    assert {r["pos"]: r["fuzzy_partner_id"] for r in got} == {i: f"R{j:03d}" for i, j in one_by_one(rows, "literal").items()}
    for texts in (["same"], ["", "a"], ["ab", "ab"], ["aa", "aaa"], ["é🙂x", "é🙂y"]):
        df = spark.createDataFrame([("r", t, "1", "", i, i, 1) for i, t in enumerate(texts)],
                                   "block string, text string, floor string, by string, vid long, last_pos long, n long")
        s = matching.block_shapes(df, 90).first()
        assert s["left"] + s["right"] <= min(map(len, texts))
        assert all(t[:s["left"]] == texts[0][:s["left"]] and t[len(t) - s["right"]:] == texts[0][len(texts[0]) - s["right"]:] for t in texts)


def test_short_cores_meet_by_what_similar_texts_share(spark):
    """Numbered names of one road and floor: the pairs that meet under a key stay far below the square, and claims are whole."""
    rng = random.Random(4)
    numbers = rng.sample(range(10**6), 1200)
    names = [f"Customer#{i:09d} Nation 3" for i in numbers]
    rows = [("nation 3", name, "1", "", i, i, 1) for i, name in enumerate(names)]
    nodes = matching.materialise(spark.createDataFrame(
        rows, "block string, text string, floor string, by string, vid long, last_pos long, n long"), "nodes")
    texts = matching.text_keys(nodes)
    keys = texts.select("text", F.explode("keys").alias("key")).groupBy("key").count()
    assert keys.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 1200 * 1200 / 4
    claimed = {r["vid"]: r["leader"] for r in matching.claim_nodes(nodes, MatchSpec(first_slice=100)).collect()}
    expected = {}
    for i in range(len(names)):
        if i not in expected:
            for j in range(i + 1, len(names)):
                if j not in expected and reach(f"{numbers[i]:06d}", f"{numbers[j]:06d}", 100 * 4 / 6):
                    expected[j] = i
    assert all(reach(names[i], names[j], 90) for j, i in list(expected.items())[:50])
    assert claimed == expected


def test_subsequence_keys_of_texts_of_several_lengths(spark):
    """The pairs of a block with lengths 9 to 14, by subsequences, are those of the plain definition; also for repeated characters."""
    rng = random.Random(5)
    names = sorted({"Harbour " + "".join(rng.choice("ab1é") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    nodes = spark.createDataFrame([("r", t, "1", "", i, i, 1) for i, t in enumerate(names)],
                                  "block string, text string, floor string, by string, vid long, last_pos long, n long")
    texts = matching.text_keys(nodes, MatchSpec(address_threshold=90)).cache()
    assert texts.where("exact").count() == len(names)
    got = sorted((r["text_a"], r["text_b"]) for r in matching.similar_texts(texts, texts, MatchSpec(), True).collect())
    assert got == [(a, b) for a in names for b in names if a < b and reach(a, b, 90)]
