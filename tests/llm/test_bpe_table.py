"""The character table of the token automaton next to merging pairs one after the other."""

import json
import random
import time

import public_tokenizers

from ledgerlint.llm import bpe


def merged(word, pairs, suffix):
    """Merges in order of rank, leftmost first, until none applies."""
    parts = list(word[:-1]) + [word[-1] + suffix]
    rank = {p: i for i, p in reversed(list(enumerate(pairs)))}
    while True:
        found = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        best = min(found)[0]
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and rank.get((parts[i], parts[i + 1])) == best:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out


def random_model(seed, suffix):
    rng = random.Random(seed)
    base = list("abc") + ([c + suffix for c in "abc"] if suffix else [])
    labels, pairs = list(base), []
    while len(pairs) < 25:
        u, v = rng.choice([x for x in labels if not suffix or not x.endswith(suffix)]), rng.choice(labels)
        if u + v not in labels and len(u + v) < 9:
            pairs.append((u, v))
            labels.append(u + v)
    return {x: i for i, x in enumerate(labels)}, pairs


def test_table_equals_merging_pairs():
    rng = random.Random(5)
    for seed in range(40):
        suffix = "$" if seed % 2 else ""
        vocab, pairs = random_model(seed, suffix)
        automaton = bpe.Automaton(vocab, [list(p) for p in pairs], suffix)
        name = {i: x for x, i in vocab.items()}
        for _ in range(150):
            word = "".join(rng.choices("abc", k=rng.randint(1, 14)))
            assert [name[i] for i in automaton.encode(word)] == merged(word, pairs, suffix)


def test_one_piece_of_many_letters_takes_linear_time():
    codec = bpe.Codec(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    rng = random.Random(3)
    word = "".join(rng.choices("etaoinshr", k=400_000))
    codec.automaton.encode(word[:1000])
    seconds = []
    for n in (100_000, 400_000):
        start = time.perf_counter()
        ids = codec.automaton.encode(word[:n])
        seconds.append(time.perf_counter() - start)
        assert codec.split.tokenizer.encode(word[:2000], add_special_tokens=False).ids[:300] == ids[:300]
    assert seconds[1] < 10 * seconds[0] + 1 and seconds[1] < 20


def test_a_full_table_is_begun_anew(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_STATES", 5)
    vocab, pairs = random_model(1, "$")
    automaton, fresh = bpe.Automaton(vocab, [list(p) for p in pairs], "$"), []
    for word in ("abcabcabc", "ccbbaa", "a", "bacabacab") * 3:
        fresh.append(automaton.encode(word) == bpe.Automaton(vocab, [list(p) for p in pairs], "$").encode(word))
        assert len(automaton.table) <= 5 + len(word) + 1
    assert all(fresh)


def test_tokenizer_has_every_base_symbol():
    model = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))["model"]
    assert model["end_of_word_suffix"] == "</w>"
