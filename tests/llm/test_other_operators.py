"""Embeddings, toxicity, archives, components and the pipeline."""

import base64
import hashlib
import json
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from ledgerlint.llm import simhash, toxicity, vectors, warc
from ledgerlint.llm.components import components

SF = "/root/testdata/sf0.001"


def test_components(spark):
    random.seed(3)
    edges = [tuple(sorted(random.sample(range(300), 2))) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(40)] + [(0, k) for k in range(2000, 2100)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges + [(5, 5)], "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_vectors_equal_all_pairs(spark, monkeypatch, small):
    if small:  # many cells and blocks
        for name, value in (("CELL_ROWS", 20), ("BLOCK_ROWS", 16), ("SAMPLE_ROWS", 100)):
            monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(centres[rng.integers(6)] + 0.35 * rng.normal(size=8)).astype(np.float32).tolist() for _ in range(300)]
    rows += rows[:20] + [[0.0] * 8, None, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [1.0] * 7, [1.0] * 4, [], [1e-30] * 8, [1e30] * 8]
    labels = [None if i % 41 == 0 else i % 3 for i in range(len(rows))]
    found = {r["vec_id"]: r for r in vectors.vector_digest(spark.createDataFrame(
        [(i, v, lab, "n") for i, (v, lab) in enumerate(zip(rows, labels))], "vec_id long, embedding array<float>, label int, id string")).collect()}
    unit = []
    for v, lab in zip(rows, labels):
        a = None if v is None or lab is None or len(v) == 0 or any(x is None for x in v) else np.array(v, np.float32).astype(float)
        unit.append(None if a is None or not np.isfinite(a).all() or not a.any() else a / np.abs(a).max() / np.linalg.norm(a / np.abs(a).max()))
    n, parent = len(rows), list(range(len(rows)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and labels[i] == labels[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    assert sum(links) > 100
    for i in range(n):
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (links[i], root(i), root(i) == i)
    assert vectors.vector_digest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_toxicity_on_held_out_documents(spark):
    random.seed(9)
    words = ["w" + "".join(random.choices("abcdefg", k=5)) for _ in range(300)]
    bad = ["vil" + "".join(random.choices("xyz", k=4)) for _ in range(60)]
    rows = []
    for i in range(900):
        t = random.choices(words, k=40)
        if i % 4 == 0:
            for _ in range(5):
                t[random.randrange(40)] = random.choice(bad)
        rows.append((i, " ".join(t), int(i % 4 == 0), 1))
    rows += [(900, None, 0, 1), (901, "", 0, 1), (902, "x" * 100000, 0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score int")
    found = {r["doc_id"]: r for r in toxicity.toxicity(df.select("doc_id", "text", "score"), df.select("doc_id", "toxic").limit(900)).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.5) for i, r in found.items())
    held = [i for i in range(900) if found[i]["held_out"]]
    assert np.mean([found[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert [found[i]["predicted"] for i in (900, 901, 902)] == [0, 0, 0]
    none = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("false")).collect()
    assert len(none) == len(rows) and {r["score"] for r in none} == {0.0}


def test_toxicity_reads_texts_in_parallel(spark, monkeypatch):
    seen = []

    def watched(df, label, write=toxicity.materialise):
        seen.append(("MapInArrow" in df._jdf.queryExecution().toString(), df.rdd.getNumPartitions()))
        return write(df, label)

    monkeypatch.setattr(toxicity, "materialise", watched)
    docs = spark.createDataFrame([(i, f"word{i} text") for i in range(60)], "doc_id long, text string").repartition(4)
    toxicity.toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")).count()
    assert [n > 1 for texts, n in seen if texts] == [True]


def test_warc(spark, tmp_path):
    page = "<html><head><title>A &amp; B</title><script>x<1</script></head><body><p>One&nbsp;<a class=c href='/u?a=1&amp;b=2'>two</a><br>three<!-- no --></p></body></html>"
    rows = [(1, "http://a/", page, "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX-Own: yes\r\n", 7), (2, None, None, None, None, 7), (3, "u", "x" * 300000 + "<", None, None, 7), (1, "http://a/", page, "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nX-Own: yes\r\n", 7)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, warc_date string, http_headers string, block int")
    index = warc.write_warc(df, str(tmp_path)).collect()
    assert len(index) == 8
    for r in index:
        head, _, block = warc.read_member(r["file"], r["offset"], r["length"]).partition(b"\r\n\r\n")
        block = block[: r["content_length"]]
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1" and f"WARC-Refers-To: {r['refers_to']}" in lines
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        if r["page_id"] == 1:
            assert r["payload_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
            if r["warc_type"] == "conversion":
                assert block.decode() == "One two\nthree"
            else:
                inside = json.loads(block)["Envelope"]
                assert inside["WARC-Header-Metadata"]["WARC-Record-ID"] == r["refers_to"]
                http = inside["Payload-Metadata"]["HTTP-Response-Metadata"]
                assert http["Headers"] == {"X-Own": "yes"} and http["HTML-Metadata"] == {
                    "Title": "A & B", "Links": [{"path": "A@/href", "url": "/u?a=1&b=2"}]}
    assert len({r["record_id"] for r in index}) == 6
    assert warc.warc_digest(df.limit(0)).count() == 0


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SF)
        assert rows.columns == docs.columns
        assert {r[0] for r in rows.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, SF).count() == rows.count()
    assert "pipeline" in entry_module.queries() and len([q for q in entry_module.queries() if q.startswith("op")]) == 10


def test_one_row_of_each_component_stays(spark):
    random.seed(6)
    text = lambda: " ".join("w" + "".join(random.choices("abcdefghij", k=6)) for _ in range(300))
    a, b, c, d, e = (text() for _ in range(5))
    near = " ".join(["new", *b.split()[1:]])
    assert (simhash.fingerprint(b) ^ simhash.fingerprint(near)).bit_count() <= 3
    rows = [(5, a, "x"), (3, a, "x"), (5, b, "x"), (8, near, "x"), (7, c, "x"), (7, c, "x"), (7, c, "y"), (None, d, "x"), (None, d, "x"),
            (None, e, "x"), (2, e, "x"), (None, a, "x"), (9, None, "x"), (9, "", "x"), (None, text(), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = [(r[0], r[1] or "") for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted([(3, a), (5, b), (7, c), (None, d), (2, e), (9, ""), (None, rows[-1][1])], key=repr)
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), SF).count() == 0
