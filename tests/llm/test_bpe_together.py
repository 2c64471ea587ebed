"""Many pieces read together next to single ones, to merging pairs and to the library."""

import random
import time

import public_tokenizers
import pytest

from ledgerlint.llm import bpe
from tests.llm.test_bpe_table import merged, random_model


def codec():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return bpe.Codec(f.read())


def invented(n):
    rng = random.Random(7)
    parts = ["an", "er", "th", "schaft", "tion", "l", "o", "q", "ung", "re", "s", "keit", "ou"]
    return list({"".join(rng.choices(parts, k=rng.randint(2, 7))) for _ in range(n)})


def split(ids, counts):
    flat, at, out = ids.tolist(), 0, []
    for n in counts.tolist():
        out.append(flat[at: at + n])
        at += n
    return out


@pytest.mark.parametrize("together, long", [(100_000, 256), (7, 256), (50, 6)])
def test_pieces_together_equal_merging_pairs(monkeypatch, together, long):
    monkeypatch.setattr(bpe, "TOGETHER", together)
    monkeypatch.setattr(bpe, "LONG", long)
    rng = random.Random(6)
    for seed in range(30):
        suffix = "$" if seed % 2 else ""
        vocab, pairs = random_model(seed, suffix)
        automaton = bpe.Automaton(vocab, [list(p) for p in pairs], suffix)
        name = {i: x for x, i in vocab.items()}
        pieces = ["".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(100)] + ["", 3, "a" * 300, 0, ""]
        found = split(*automaton.encode_all(pieces))
        assert len(found) == len(pieces) and found[-5] == found[-1] == [] and found[-4] == [3] and found[-2] == [0]
        for piece, ids in zip(pieces, found):
            if isinstance(piece, str) and piece:
                assert [name[i] for i in ids] == merged(piece, pairs, suffix) and ids == automaton.encode(piece)
        assert [len(x) for x in automaton.encode_all([])] == [0, 0] and split(*automaton.encode_all([""])) == [[]]


def test_a_piece_without_a_path_is_told():
    vocab, pairs = random_model(1, "$")
    automaton = bpe.Automaton(vocab, [list(p) for p in pairs], "$")
    with pytest.raises(ValueError, match="abxa"):
        automaton.encode_all(["abc", "abxa", "c"])


def test_pieces_together_equal_the_library():
    c, words = codec(), invented(3000) + ["é", "naïve", "x" * 300, "don't", "<|endoftext|>", "漢字"]
    library = c.split.tokenizer
    assert c.encode(words) == [library.encode(w, add_special_tokens=False).ids for w in words]
    numbers, labels = c.rendered(words)
    for w, n, d in zip(words, numbers.to_pylist(), labels.to_pylist()):
        ids = library.encode(w, add_special_tokens=False).ids
        assert n.decode().split() == [str(i) for i in ids] and d.decode() == "".join(f"{library.id_to_token(i)} " for i in ids)


def test_new_pieces_cost_less_together():
    rng = random.Random(8)
    c, words = codec(), ["".join(rng.choices("etaoinshrdlucmfwy", k=rng.randint(5, 15))) for _ in range(30_000)]
    start = time.process_time()
    c.rendered(words)
    together = time.process_time() - start
    start = time.process_time()
    for w in words:
        c.automaton.encode(w)
    assert together < 0.7 * (time.process_time() - start)
