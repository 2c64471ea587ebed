"""Operators over texts next to plain definitions, on awkward and on random texts."""

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from ledgerlint.llm import bpe, mixing, pii, quality, repeats, simhash, tokenfile
from ledgerlint.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
sha = lambda b: hashlib.sha256(b).hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_files(docs, awkward):
    library, start = Tokenizer.from_file(PATH), 0
    found = by_id(tokenfile.token_digest(docs(awkward), PATH))
    for i, t in enumerate(awkward):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        crc = zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        assert tuple(found[i]) == (i, start, len(ids), crc)
        start += len(ids)


def test_token_files_of_nothing(docs):
    assert tokenfile.token_digest(docs([]), PATH).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packed_ids_come_back(tmp_path, width):
    rng, path = np.random.default_rng(width), f"file://{tmp_path}/x.ids"
    texts = [rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 7, 20000, 3)]
    with tokenfile._open(path, "write") as out:
        w = tokenfile.PackWriter(out, width)
        for i, ids in enumerate(texts):
            w.add(i if i else None, ids)
        w.close()
    with tokenfile._open(path, "read") as source:
        r = tokenfile.PackReader(source)
        back = list(r.documents(at_once=100))
        assert [d for d, _, _ in back] == [None, 1, 2, 3, 4]
        assert all((a == b).all() for a, (_, _, b) in zip(texts, back))
        assert (r.ids(5000, 9000) == np.concatenate(texts)[5000:9000]).all()


def test_automaton_equals_the_library(docs, awkward):
    random.seed(2)
    parts = ["a", "B", "é", "İ", "Σ", "ﬁ", "́", " ", "\x1c", "1", "²", "漢", "🙂", "'s", "'T", "<|endoftext|>", "<|", " ", "\n", "\t", "the", "__", "-!", "</w>"]
    texts = awkward + ["".join(random.choices(parts, k=random.randint(0, 20))) for _ in range(500)]
    library, found = Tokenizer.from_file(PATH), by_id(bpe.bpe_digest(docs(texts), PATH))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert tuple(found[i]) == (i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(back.encode()))


def test_automaton_of_a_small_vocabulary():
    vocab = {"a": 0, "b": 1, "aa": 2, "ab": 3, "aab": 4}
    automaton = bpe.Automaton(vocab, ["a a", "a b", "aa b"])
    names = {i: label for label, i in vocab.items()}
    show = lambda text: [names[i] for i in automaton.encode(text)]
    assert show("aaa") == ["aa", "a"] and show("aab") == ["aab"] and show("aaab") == ["aa", "ab"]


def test_columns_encode_and_decode(docs):
    df = docs(["The end.", None, ""])
    coded = bpe.decode_column(bpe.encode_column(df, PATH), PATH)
    library = Tokenizer.from_file(PATH)
    rows = by_id(coded)
    ids = library.encode("The end.", add_special_tokens=False).ids
    assert rows[0]["token_ids"] == ids and rows[0]["decoded"] == library.decode(ids)
    assert rows[1]["token_ids"] == [] and rows[2]["decoded"] == ""


def brute_repeats(texts, length):
    seen = collections.Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                gone[i: i + length] = b"\1" * length
        runs = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        yield len(t), sum(gone), runs, sha(bytes(c for c, g in zip(t, gone) if not g))


@pytest.mark.parametrize("crowded", [8192, 2])
def test_repeats(docs, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    random.seed(crowded)
    text = lambda n: "".join(random.choices("abcdé \n", k=n))
    shared = [text(random.randint(60, 250)) for _ in range(6)]
    pick = lambda: random.choice([text(random.randint(1, 80)), random.choice(shared), random.choice(shared)[random.randint(0, 30): 150], "z" * random.randint(1, 90)])
    texts = [None, "", "short"] + ["".join(pick() for _ in range(random.randint(0, 5))) for _ in range(60)]
    texts += [texts[9], texts[9]]
    found = by_id(repeats.repeat_digest(docs(texts), repeats.RepeatSpec(64, 16)))
    for i, expected in enumerate(brute_repeats([(t or "").encode() for t in texts], 64)):
        assert tuple(found[i])[1:] == expected
    assert repeats.repeat_digest(docs([])).count() == 0


def plain_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_verdict(spark, docs, awkward):
    random.seed(4)
    clean = [" ".join(random.choices("one two three four five six seven".split(), k=40)) for _ in range(90)]
    junk = [" ".join(w + random.choice("%$#") for w in t.split()) for t in clean[:45]]
    texts = awkward[:4] + awkward[6:] + ["a b\na b\n\n c c c c c c c c c c #"] + clean + junk
    labels = spark.createDataFrame([(i, int("%" not in (t or "") and "$" not in (t or "") and "#" not in (t or "")), 0) for i, t in enumerate(texts)],
                                   "doc_id long, quality int, toxic int")
    found = by_id(quality.quality_digest(docs(texts), labels))
    for i, t in enumerate(texts):
        n = plain_counts(t or "")
        assert tuple(found[i][c] for c in quality.COUNTS[:5]) == n
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        assert found[i]["base_failed"] == failed and not (failed and found[i]["kept"])
    kept = [found[i]["kept"] for i in range(len(texts))]
    first = len(texts) - 135
    assert all(kept[i] or found[i]["base_failed"] for i in range(first, first + 90))
    assert not any(kept[first + 90:])
    assert quality.quality_digest(docs([]), labels).count() == 0
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_digest(docs(texts), labels.where("false")).collect())


def test_mixture_meets_its_targets(docs):
    random.seed(6)
    source = random.choices(["a", "b", "\U0001F642", None, "￿"], [50, 10, 20, 10, 3], k=400)
    texts = [None if k % 50 == 0 else "w " * random.randint(0, 60) for k in range(400)]
    rows = docs(texts, source)
    found = mixing.mix_digest(rows).collect()
    again = mixing.mix_digest(rows.repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, again))
    order = ["a", "b", "￿", "\U0001F642", None]
    size = {s: sum(len((t or "").split()) for t, x in zip(texts, source) if x == s) for s in order}
    expected = dict(zip(order, mixing.water_fill([size[s] for s in order], [1, 2, 3, 1, 2], 3)))
    taken = collections.Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == len((texts[r["doc_id"]] or "").split()) and r["source_size"] == size[s]
        assert r["target"] == pytest.approx(expected[s]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 1 for s in order)
    words = sum(len(r["text"].split()) for r in mixing.mixed_documents(rows).collect())
    assert words == sum(taken.values())
    assert mixing.mixed_documents(rows).columns == rows.columns
    assert mixing.mix_digest(docs([])).count() == 0


def test_water_fill_and_tree():
    assert mixing.water_fill([100, 1, 100], [1, 2, 3], 3) == [pytest.approx(198 / 4), 3.0, pytest.approx(198 * 3 / 4)]
    counts = mixing.split_tree(np.array([7, 0, 30]), 5, np.random.default_rng(0))
    assert counts.sum(axis=0).tolist() == [7, 0, 30] and set(counts.sum(axis=1)) <= {7, 8}


def test_every_shard_is_a_partition_with_its_share_of_blocks(spark, docs):
    """Quotas are split exactly, no block of a copy is in two shards, and a partition holds one shard."""
    texts = [f"w{i} " * (1 + i % 7) for i in range(3000)]
    rows = docs(texts, source=[f"s{i % 3}" for i in range(3000)]).withColumnRenamed("size", "shard")
    spec = mixing.MixSpec(shards=5, blocks=40)
    _, draws, sources = mixing.mixture(rows, spec)
    placed = [tuple(r) for r in draws.select("_source", "_block", "copy", "shard").collect()]
    assert len(placed) == len(set(placed)) == len({p[:3] for p in placed})
    sizes = [sum(p[3] == s for p in placed) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    mixed = mixing.mixed_documents(rows, spec)
    assert mixed.columns == rows.columns and mixed.rdd.getNumPartitions() == 5
    counts = [r["count"] for r in mixed.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()]
    assert len(counts) == 5 and max(counts) < 1.6 * min(counts)
    shown = mixing.mix_digest(rows, spec).collect()
    assert all((r["taken"] == 0) == (r["first_shard"] is None) for r in shown)
    assert {r["first_shard"] for r in shown if r["taken"]} <= set(range(5))


def test_mixed_documents_can_stay_whole(docs):
    random.seed(5)
    texts = [" ".join(f"{i}w{k}" for k in range(random.randint(1, 90))) for i in range(60)]
    rows = docs(texts, source=[random.choice("abc") for _ in texts])
    cut, whole = ([r["text"] for r in mixing.mixed_documents(rows, whole=w).collect()] for w in (False, True))
    assert any(t not in texts for t in cut) and all(t in texts for t in whole)
    part = collections.Counter(t for t in cut if t not in texts)
    full = lambda t: next(x for x in texts if x.startswith(t + " "))
    rounded = collections.Counter(t for t in cut if t in texts) + collections.Counter(
        full(t) for t in part.elements() if 2 * len(t.split()) >= len(full(t).split()))
    assert collections.Counter(whole) == rounded


FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    for kind, form in FORMS.items():
        for m in re.finditer(form, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                    "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data(docs, awkward):
    random.seed(1)
    parts = ["a", "b@", "@", ".", "c.d", "1", "255", "300", "4111 1111 1111 1111", "+1 (132) 555-0271", "+", " ", "-", "🙂", "_", "x@y.z", "10.0.0.1", "1.2.3.4.5.6.7.8", "007.1.2.3"]
    texts = [t for t in awkward if t != "x" * 200000] + ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(400)]
    found = by_id(pii.pii_digest(docs(texts)))
    for i, t in enumerate(texts):
        base = list(plain_spans(t or ""))
        assert found[i]["base_sha256"] == sha(",".join(base).encode())
        assert [s for s in found[i]["spans"].split(",") if s and not s.startswith("id:")] == base
        assert [found[i][f"n_{k}"] for k in FORMS] == [sum(b.startswith(k) for b in base) for k in FORMS]
    assert pii.pii_digest(docs([])).count() == 0


def test_contexts_find_more(docs):
    texts = [f"please wire via account {4539578763621486 if k % 2 else 4111111111111111} now {k}" for k in range(3)]
    texts += [f"wire via mail user{k}@mail.example or pay" for k in range(8)] + ["via mail AB-1234-77, or", "the number 123456 here"]
    found = by_id(pii.pii_digest(docs(texts)))
    i = len(texts) - 2
    assert found[i]["spans"] == "id:9:19" and found[i + 1]["spans"] == ""
    clear = by_id(pii.redacted(docs(texts)))
    assert clear[i]["text"] == "via mail [ID], or" and clear[3]["text"] == "wire via mail [EMAIL] or pay"


def test_spans_with_blanks_or_signs_are_seeds(docs):
    texts = [f"ring me under +1 (743) 555-38{k:02d} tonight" for k in range(6)] + [f"from host 10.0.0.{k}###\nsays" for k in range(6)]
    texts += ["me under AB-1234-77 please", "host CD-5678-99 x", "by AB-1234-78 please"]
    found = by_id(pii.pii_digest(docs(texts)))
    assert [found[i]["spans"] for i in (12, 13, 14)] == ["id:9:19", "id:5:15", ""]
    rows = docs(["id, (+1 (743) 555-3824), +1 (743) 555-3825 see mail:a@b.example;c@d.example end 1.2.3.4@e.example"])
    spans = pii.seeds(pii.base_spans(pii._found(rows)))
    assert [tuple(r) for r in spans.orderBy("start").select("word", "left", "right", "left2").collect()] == [
        ("+1 (743) 555-3824", "id", "", ""), ("+1 (743) 555-3825", "", "see", ""), ("a@b.example", "mail:", "c@d.example", "see mail:"),
        ("c@d.example", "a@b.example", "end", "mail: a@b.example"), ("1.2.3.4@e.example", "end", "", "c@d.example end")]


def test_contexts_of_long_words_far_words_and_words_with_digits(docs):
    key = "1234-" + "k" * 300
    texts = [f"token{' ' * 90}u{k}@mail.example" for k in range(6)] + [f"acct#2 v{k}@mail.example" for k in range(6)]
    texts += [f"token {key}", f"token{' ' * 90}AB-1234-77", "acct#2 99887766", "room#3 99887766x", "q4 acct#2 (1234567) acct#2 7654321."]
    found = by_id(pii.pii_digest(docs(texts)))
    assert [found[i]["spans"] for i in range(12, 17)] == [
        f"id:6:{6 + len(key)}", "id:95:105", "id:7:15", "", "id:11:18,id:27:34"]


def test_discovered_words_make_patterns(docs):
    texts = [f"mail u{k}@mail.example ." for k in range(12)]
    texts += [f"{w} MX-1000{k} ." for w in ("mail", "order") for k in range(8)]
    texts += [f"{w} OX-2000{k} ." for w in ("order", "badge") for k in range(5)]
    texts += ["badge ZZ-123456 .", "bus QQ-123456 ."]
    found = by_id(pii.pii_digest(docs(texts)))
    assert [bool(found[i]["spans"]) for i in range(len(texts))] == [True] * (len(texts) - 1) + [False]
    assert found[len(texts) - 2]["spans"] == "id:6:15"


def plain_fingerprint(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    s = [b" ".join(w[i: i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, awkward):
    random.seed(8)
    base = [random.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(random.randint(0, 40)) for _ in range(120)]
    texts = awkward + [" ".join(base[:k] + ["new"] + base[k + 1:]) for k in range(0, 120, 3)] + [" ".join(base)] * 3
    found, f = by_id(simhash.simhash_digest(docs(texts))), [plain_fingerprint(t) for t in texts]
    parent = list(range(len(f)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    for i in range(len(f)):
        assert (found[i]["fingerprint"], found[i]["component_id"]) == (f"{f[i]:016x}", root(i))
    assert simhash.simhash_digest(docs([])).count() == 0
