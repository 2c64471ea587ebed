"""Centroid clustering, packing and fill-in-middle next to plain definitions."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from compare import connection, difference
from tokenizers import Tokenizer

from ledgerlint.llm import centroids, infilling, packing, queries
from ledgerlint.llm.presplit import Generations, PieceEncoder, distinct_words, gathered

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.mark.parametrize("name", ["op11_heap_centroids", "op13_infilling"])
def test_equal_sql(spark, name):
    assert difference(spark, connection(SF), SF, queries.QUERIES[name], queries.SQL[name]) is None


# ---------------------------------------------------------------------------------- clustering

SMALL = centroids.ClusterSpec(clusters=3, rounds=6, components=4, scale=8)


def plain_clusters(rows, spec):
    """(vec_id, cluster, distance) of the kept rows, in Python's integers, every round in full."""
    kept = [(i, [int(np.floor(spec.scale * x)) if abs(x) < 1e290 else int(x) * spec.scale for x in v]) for i, v in rows
            if v is not None and len(v) == spec.components and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{spec.salt}{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[: spec.clusters]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(spec.rounds + 1):
        own = [min((apart(v, c), i) for i, c in enumerate(centres)) for _, v in kept]
        if k < spec.rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), (_, i) in zip(kept, own) if i == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, own)], centres


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string")


@pytest.mark.parametrize("block", [5, 2048])
def test_clusters_equal_plain(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) + 3 * rng.integers(0, 3, 4)).tolist()) for i in range(400)]
    rows += [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])] + [(500 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [float("inf")] + [0.0] * 3)]
    found, centres = centroids.clustered(vectors_of(spark, rows), SMALL)
    plain, plain_centres = plain_clusters(rows, SMALL)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain, key=key)
    assert centres == plain_centres


def test_clusters_of_few_equal_huge_or_no_vectors(spark):
    for rows in ([(1, [0.0] * 4), (2, [9.0] * 4)], [(i, [2.5] * 4) for i in range(9)],
                 [(i, [float(i) * 1e300, -1e30 * i, 0.1, 5e8 * (i % 4)]) for i in range(30)]):
        found, centres = centroids.clustered(vectors_of(spark, rows), SMALL)
        plain, plain_centres = plain_clusters(rows, SMALL)
        assert sorted(map(tuple, found.collect())) == sorted((i, c, d if d < 1 << 63 else None) for i, c, d in plain)
        assert centres == plain_centres
        assert centroids.cluster_digest(vectors_of(spark, rows), SMALL).count() == len(rows)
    assert centroids.cluster_digest(vectors_of(spark, [(1, None)]), SMALL).collect() == []
    assert centroids.cluster_digest(vectors_of(spark, []).limit(0), SMALL).collect() == []


def test_only_expired_vectors_are_rescanned(monkeypatch):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(3000, 8)) * 100 + 1000 * rng.integers(0, 4, (3000, 1))).astype(np.int64)
    centres, drift = rows[:4].copy(), np.zeros(4)
    heaps = centroids.Heaps.empty(4)
    centroids.rescan(rows, np.full(3000, -1), np.arange(3000), heaps, centres, drift)
    scanned = []
    for _ in range(12):
        member = np.full(3000, -1)
        for c, m in enumerate(heaps.members):
            member[m] = c
            assert (np.diff(heaps.keys[c]) >= 0).all()
        assert (member == centroids.squared(rows, centres).argmin(axis=1)).all()
        moved = np.array([rows[member == c].sum(axis=0) // max(1, (member == c).sum()) for c in range(4)])
        far = np.sqrt(((moved - centres) ** 2).sum(axis=1)) * (1 + 1e-9)
        centres, drift = moved, drift + far + np.array([np.delete(far, c).max() for c in range(4)])
        at, old = heaps.pop(drift)
        scanned.append(len(at))
        centroids.rescan(rows, old, at, heaps, centres, drift)
    assert scanned[-1] < 300 and sum(scanned) < 12 * 3000 / 2


# ---------------------------------------------------------------------------------- packing

def test_fullest_equals_brute_force():
    random.seed(4)
    for _ in range(300):
        lengths = sorted(random.sample(range(1, 40), 5), reverse=True)
        counts, room = [random.randint(1, 3) for _ in lengths], random.randint(1, 90)
        chosen = packing.fullest(lengths, counts, room)
        sums = {0}
        for length, n in zip(lengths, counts):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert sum(chosen) == max(s for s in sums if s <= room)
        assert all(chosen.count(x) <= n for x, n in zip(lengths, counts))


def test_places_fill_sequences_without_gaps():
    random.seed(6)
    for capacity, histogram in ((50, {x: random.randint(1, 40) for x in range(1, 51)}), (64, {7: 1000, 3: 1, 64: 5}), (9, {}), (8, {8: 3})):
        key, sequence, offset, times = packing.places(histogram, capacity)
        filled = defaultdict(list)
        for length, n in histogram.items():
            for nth in range(n):
                own = length << packing.NUMBER_BITS | nth
                i = np.searchsorted(key, own, "right") - 1
                copy, t = divmod(own - int(key[i]), int(times[i]))
                filled[int(sequence[i]) + t].append((int(offset[i]) + copy * length, length))
        for parts in filled.values():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at <= capacity
        total = sum(x * n for x, n in histogram.items())
        assert sorted(filled) == list(range(len(filled)))
        assert len(filled) <= -(-total // capacity) * 1.05 + 1


def test_packing_equals_library(spark, docs, awkward, library):
    spec = packing.PackSpec(capacity=64)
    texts = awkward + ["some words of a text " * (i % 9) for i in range(300)] + ["equal"] * 200
    df = docs(texts).unionByName(docs(["twice", None]).limit(2))
    rows = packing.packing_digest(df, WORDS, spec).collect()
    wanted = defaultdict(int)
    for r in df.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            own = ids[k: k + 64]
            wanted[r["doc_id"], k // 64, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    found = defaultdict(int)
    for r in rows:
        found[tuple(r)[:5]] += 1
    assert found == wanted
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        assert [a for a, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
        assert sum(n for _, n in parts) <= 64
    assert len(filled) <= -(-sum(r["length"] for r in rows) // 64) + 2
    assert packing.packing_digest(df.limit(0), WORDS, spec).collect() == []


def test_sequences_hold_their_pieces(spark, docs, library):
    spec = packing.PackSpec(capacity=32, end_id=1)
    texts = ["a few words here", None, "b " * 100, "c", "c"]
    got = defaultdict(dict)
    for r in packing.sequences(docs(texts), WORDS, spec).collect():
        ids = np.frombuffer(r["token_ids"], "<u4").tolist()
        assert len(ids) == sum(p["length"] for p in r["pieces"]) <= 32
        for p in r["pieces"]:
            got[p["doc_id"]][p["start"]] = ids[p["offset"]: p["offset"] + p["length"]]
    for i, t in enumerate(texts):
        whole = [x for _, own in sorted(got[i].items()) for x in own]
        assert whole == library.encode(t or "", add_special_tokens=False).ids + [1]


def test_pieces_of_many_words_equal_library(awkward, library):
    import pyarrow as pa
    texts = awkward + ["a <|endoftext|>b é Ünï <x> 漢字 \tq İstanbul don't 'Tis 12.5", "<|startoftext|>", "ǅ ŉ ſ ĳ ẞ İ a<b 'S x'RE"] * 2
    with open(WORDS, encoding="utf-8") as f:
        encoder = PieceEncoder(f.read(), cached=4)  # forgets all the time
    for part in (texts, texts[:3], [None], []):
        starts, codes, words = distinct_words(pa.array(part, pa.string()))
        data, at = gathered(encoder.encode(words), codes, starts)
        ids = data[: at[-1]].view("<u4")
        assert [ids[a:b].tolist() for a, b in zip(at[:-1] // 4, at[1:] // 4)] == [
            library.encode(t or "", add_special_tokens=False).ids for t in part]


def test_generations_keep_what_is_used():
    memory, built = Generations(4), []
    build = lambda keys: built.extend(keys) or [k * 2 for k in keys]
    for k in range(20):
        assert memory.values([0, k + 1], build) == [0, 2 * k + 2]
    assert built.count(0) == 1 and len(memory.young) + len(memory.old) <= 6


# ---------------------------------------------------------------------------------- fill-in-middle

def plain_infill(doc_id, text, spec):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"{spec.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[k: k + 8], 16) for k in (0, 8, 16, 24))
    x, y = sorted((a % (n + 1), b % (n + 1)))
    p, s, m = spec.sentinels
    if not n or any(t in text for t in spec.sentinels) or c % 100 >= 100 - spec.plain:
        return "plain", n, None, None, text
    if d % 100 < spec.suffix_first:
        return "spm", n, x, y - x, s + text[y:] + p + text[:x] + m + text[x:y]
    return "psm", n, x, y - x, p + text[:x] + s + text[y:] + m + text[x:y]


@pytest.mark.parametrize("slice_bytes", [1, 4 << 20])
def test_infilling_equals_plain(spark, docs, awkward, monkeypatch, slice_bytes):
    monkeypatch.setattr(infilling, "SLICE_BYTES", slice_bytes)
    spec = infilling.InfillSpec()
    random.seed(8)
    texts = awkward + ["".join(random.choice("ab<P>SM é漢🙂\n") for _ in range(random.randint(0, 40))) for _ in range(300)] + [
        "has <M> inside", "<", "<P", "🙂", "é" * 50000, "a<P><S>", "\x00é"]
    df = docs(texts).withColumnRenamed("h", "infill").unionByName(docs(texts[:9]).withColumnRenamed("h", "infill"))
    out = infilling.infilled(df, spec)
    assert out.columns == df.columns
    back = out.withColumn("back", infilling.rebuilt(out["infill.text"], out["infill.form"], spec))
    for r in back.collect():
        assert tuple(r["infill"]) == plain_infill(r["doc_id"], r["text"], spec)
        assert tuple(r["back"]) == (r["text"] or "", r["infill"]["prefix_chars"], r["infill"]["middle_chars"])


def test_infilling_without_ids_and_rows(spark, docs):
    df = spark.createDataFrame([(None, "no id é"), (None, None), (3, "x")], "doc_id long, text string")
    for r in infilling.infill_digest(df).collect():
        text = {"x": "x"}.get(r["n"] == 1 and "x", "no id é" if r["n"] else "")
        form, n, x, y, output = plain_infill(r["doc_id"], text, infilling.InfillSpec())
        assert (r["form"], r["n"], r["prefix_chars"], r["middle_chars"]) == (form, n, x, y)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert infilling.infill_digest(df.limit(0)).collect() == []


def test_cuts_turn_both_ways():
    text = "aé漢🙂b" * 20 + "plain"
    data = np.frombuffer(text.encode(), np.uint8)
    index = infilling.Excess(data)
    cuts = np.arange(len(text) + 1)
    places = np.array([len(text[:c].encode()) for c in cuts])
    assert (index.to_bytes(cuts) == places).all() and (index.to_points(places) == cuts).all()
    assert len(index.total) == 61  # only the multibyte characters are held
