"""From whole texts to the pieces a byte-level BPE model merges, one distinct word at a time.

Both BPE operators work on the distinct words of an Arrow batch and gather the results, so a word
is normalised, split and encoded once per batch at most. Blanks and line feeds are white space to
every normaliser handled here and never part of a piece, so texts may be cut at them first.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

CACHED_PIECES = 500_000  # pieces a worker remembers before it starts anew


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for the
    code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class Presplitter:
    """Normalisation and pre-tokenisation of a tokenizer file.

    Words of letters below U+0250 (where normal form C changes nothing) are lowered and split
    here; all others go through the file's own normaliser and pre-tokenizer. Strings of added
    tokens are cut out of the raw text first and given as their ids.
    """

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        self.known = (kinds == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed"
                      and split["invert"] and not level["add_prefix_space"] and not level["use_regex"])
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.simple = regex.compile(r"[\x21-\x7e\xa1-ɏ]+")
        self.words_and_ends = regex.compile(r"\n|" + self.pattern.pattern)
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}

    def pieces(self, word: str) -> list:
        """Byte-level pieces of a word, added tokens as ids."""
        if self.known and "<" not in word and self.simple.fullmatch(word):
            if word.isalpha() and "İ" not in word:  # which has no single small letter
                found = [word.lower()]
            else:
                found = self.pattern.findall(word.lower())
            if word.isascii():
                return found
            return [p.encode().decode("latin-1").translate(self.letters) for p in found]
        out: list = []
        for part in self.cut.split(word) if self.cut else [word]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part)
                out += [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return out


    def all_pieces(self, words: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """The same for many words at once: distinct pieces, a code for each piece of each word, and
        how many pieces each word has. Words of the simple kind are joined and split together."""
        simple = np.zeros(len(words), bool)
        if self.known and words:
            simple = pc.match_substring_regex(
                pa.array(words, pa.large_string()), "^[!-;=-~\u00a1-\u024f]+$").to_numpy(zero_copy_only=False)
        together = [words[i] for i in np.flatnonzero(simple).tolist()]
        found = self.words_and_ends.findall("\n".join(together).lower()) + ["\n"] if together else []
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
        end = names.index("\n") if found else 0
        ends = np.flatnonzero(codes == end) if found else np.zeros(0, np.int64)
        flat = np.delete(codes, ends)
        flat -= flat > end
        names = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in names if p != "\n"]
        counts = np.zeros(len(words), np.int64)
        counts[simple] = np.diff(ends, prepend=-1) - 1
        if not simple.all():
            number = {p: i for i, p in enumerate(names)}
            at = np.cumsum(counts) - counts
            odd = [(i, [number.setdefault(p, len(number)) for p in self.pieces(words[i])])
                   for i in np.flatnonzero(~simple).tolist()]
            flat = np.insert(flat, [at[i] for i, own in odd for _ in own], [c for _, own in odd for c in own])
            counts[~simple] = [len(own) for _, own in odd]
            names = list(number)
        return names, flat.astype(np.int64), counts


def spelled(split: Presplitter, words: list[str], spell: Callable[[list], Sequence[list[bytes]]]) -> list[pa.Array]:
    """``spell`` gives one or more lists of bytes for distinct pieces; the result has, for each list, the
    bytes of all pieces of each word joined."""
    names, codes, counts = split.all_pieces(words)
    return [grouped(pa.array(values, pa.large_binary()), codes, counts) for values in spell(names)]


def grouped(values: pa.Array, codes: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values of codes, joined in groups of as many as ``counts`` says."""
    taken = values.take(pa.array(codes))
    at = np.zeros(1, np.int64) if not len(taken) else np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    data = taken.buffers()[2] if len(taken) else None
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(at[ends].tobytes()), data or pa.py_buffer(b"")])


class PieceEncoder:
    """Ids of words by the ``tokenizers`` library, for many words at once. Pieces are remembered in two
    generations: when the younger is full it becomes the older, whose pieces come back as they are used."""

    def __init__(self, tokenizer_json: str, cached: int = CACHED_PIECES):
        self.split = Presplitter(tokenizer_json)
        self.model = Tokenizer(self.split.tokenizer.model)
        self.memory = Generations(cached)

    def encode(self, words: list[str]) -> pa.Array:
        """Little-endian unsigned 32-bit ids of each word."""
        return spelled(self.split, words, lambda names: [self.memory.values(names, self._coded)])[0]

    def _coded(self, pieces: list) -> list[bytes]:
        texts = [p for p in pieces if isinstance(p, str)]
        coded = self.model.encode(texts, is_pretokenized=True, add_special_tokens=False)
        data = np.array(coded.ids, "<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(texts)))
        found = iter(data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()))
        return [next(found) if isinstance(p, str) else np.uint32(p).astype("<u4").tobytes() for p in pieces]


class Generations:
    """A memory of at most ``size`` values in two halves. What is asked for moves to the younger half; when
    that is full the older one goes, so values in use are not lost all at once."""

    def __init__(self, size: int):
        self.half, self.young, self.old = max(1, size // 2), {}, {}

    def values(self, keys: list, build: Callable[[list], list]) -> list:
        """Values of distinct keys; those not known are built together."""
        young, old = self.young, self.old
        found = [young.get(k) for k in keys]
        missing = [i for i, v in enumerate(found) if v is None]
        new = []
        for i in missing:
            found[i] = v = old.get(keys[i])
            if v is None:
                new.append(i)
        if new:
            for i, v in zip(new, build([keys[i] for i in new])):
                found[i] = v
        young.update((keys[i], found[i]) for i in missing)
        if len(young) > self.half:
            self.young, self.old = {}, young
        return found


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, list[str]]:
    """Word offsets of each text, the words as codes, and the distinct words (null: empty)."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
    words = pc.split_pattern(texts, " ")
    codes = words.flatten().dictionary_encode()
    return np.asarray(words.offsets), codes.indices, codes.dictionary.to_pylist()


def gathered(values: list[bytes] | pa.Array, codes: pa.Array, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all words in one byte array, and where each text begins in it."""
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.large_binary())
    taken = values.take(codes)
    if not len(taken):
        return np.zeros(0, np.uint8), np.zeros(len(starts), np.int64)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8) if taken.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets[starts - starts[0]]
