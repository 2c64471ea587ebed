"""BPE by a deterministic automaton over tokens (operator 5).

The automaton accepts exactly the token sequences that applying the merges in order gives. It
begins as one state with a loop for every base symbol. For each merge (u, v) in turn a gadget is
put in: the state that arcs labelled u lead to is replaced by a copy without an arc for v, so
that v never follows u again, and every state with an arc for u gets an arc for the joined token,
to where v led from there. As all arcs of a label lead to one state, a merge adds one state.

The arcs a gadget takes away are stored, with its place in the order; whether a state has an arc
follows from the parts of both labels.

Words come as characters, of which labels are made. As a character sequence has one accepted path only,
so has each beginning of it, and where a label ends at a character, whether it is the last of that path
follows from the label before it. Many pieces are read together: all labels in their characters are found
by the tree of labels, kept in an array, and then the pieces go on by one character at a time, each
keeping the one label with which its path may end there. The path is read off backwards.

A very long piece goes alone, by a deterministic automaton over characters: its states are the labels that
may be under way, each as a place in the tree and the label before it, and a transition gives the next state
and the label, if any, of a path that ends there. Transitions are entered in a table when they are first
taken. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlint.llm.presplit import Presplitter, distinct_words, gathered, grouped
from ledgerlint.llm.worker import kept

SLICE_ROWS = 1_000  # texts whose distinct words are encoded together
TOGETHER = 100_000  # characters of the pieces read together
LONG = 256  # characters beyond which a piece goes alone, at most 32,767
MOST_STATES = 80_000  # entries of the table, beyond which it is begun anew


class Numbers:
    """A fixed mapping of integers to integers not below 0, looked up for many at once; -1 where there is none."""

    def __init__(self, known: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(known)) for x in (known.keys(), known.values()))
        self.bits = max(4, (4 * len(known)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)
        at = self._place(keys)
        while len(keys):  # the first to come takes a free place, the others go to the next
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]
            done = self.keys[at] == keys
            self.values[at[done]] = values[done]
            keys, values, at = keys[~done], values[~done], (at[~done] + 1) & (1 << self.bits) - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            there = self.keys[at[left]]
            found = there == keys[left]
            out[left[found]] = self.values[at[left[found]]]
            left = left[~found & (there >= 0)]
        return out


class Automaton:
    """The token automaton of a BPE model: {label: id}, merges in order, suffix of word ends.

    A state is named by the label that leads to it. ``gadget`` holds the arcs taken away, (u, v)
    by merge; ``made`` the merge of a joined token, ``left`` and ``right`` its parts.
    """

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.n = max(vocab.values(), default=-1) + 1
        self.bits = self.n.bit_length()  # those of a label + 1
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in merges]
        joined = {a + b for a, b in pairs}
        self.alive = [False] * self.n  # whether any arc has this label
        for label, i in vocab.items():
            self.alive[i] = label not in joined
        self.left, self.right, self.made = [-1] * self.n, [-1] * self.n, [-1] * self.n
        self.gadget: dict[int, int] = {}
        for k, (a, b) in enumerate(pairs):
            self._insert(k, vocab[a], vocab[b], vocab[a + b])
        # the tree of labels: children by character, the label that ends at a node, and the one that ends
        # there if the word does; a label's characters are counted without the suffix
        self.kids: list[dict[str, int] | None] = [{}]
        self.inside, self.at_end, self.chars = [-1], [-1], [0] * self.n
        for label, i in vocab.items():
            if self.alive[i]:
                last = bool(suffix) and label.endswith(suffix) and label != suffix
                body = label[: len(label) - len(suffix)] if last else label
                self.chars[i] = len(body)
                (self.at_end if last else self.inside)[self._node(body)] = i
        if not suffix:
            self.at_end = self.inside
        self._compile()
        self._forget()

    def _node(self, body: str) -> int:
        node = 0
        for c in body:
            own = self.kids[node]
            if own is None:
                own = self.kids[node] = {}
            if c not in own:
                own[c] = len(self.kids)
                self.kids.append(None)
                self.inside.append(-1)
                self.at_end.append(-1)
            node = own[c]
        return node

    def _forget(self) -> None:
        """An empty table: per state what is under way, the transitions and the labels at a word's last character.
        Both are one dictionary by state and character of numbers, not objects of their own for every state."""
        self.numbers: dict[tuple, int] = {}
        self.under_way: list[tuple] = []
        self.table: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self._number(((0, -1),))

    def _number(self, under_way: tuple) -> int:
        state = self.numbers.get(under_way)
        if state is None:
            state = self.numbers[under_way] = len(self.under_way)
            self.under_way.append(under_way)
        return state

    def _insert(self, k: int, u: int, v: int, uv: int) -> None:
        if self.alive[uv]:
            raise ValueError("two merges make one token")
        if self.alive[u] and self.alive[v] and self._has_arc(u, v):
            self.gadget[u * self.n + v] = k
            self.alive[uv], self.left[uv], self.right[uv], self.made[uv] = True, u, v, k
        # else u is never followed by v and the merge never applies

    def _has_arc(self, last: int, label: int) -> bool:
        """Whether ``label`` may follow ``last``. The state after a joined token is that after its
        second part as it was then, so of the gadgets of that part only earlier ones count; a
        joined token has arcs where its first part had them then. Both are taken apart in the
        order they were made, the later first."""
        until_last = until = len(self.gadget) + len(self.vocab)
        while True:
            k = self.gadget.get(last * self.n + label)
            if k is not None and k < until_last and k <= until:
                return False
            made_last, made = self.made[last], self.made[label]
            if made_last > made:
                until_last, last = made_last, self.right[last]
            elif made >= 0:
                until, label = made, self.left[label]
            else:
                return True

    def _compile(self) -> None:
        """The tree of labels, the gadgets and the parts of labels as arrays."""
        self.step = Numbers({node << 21 | ord(c): to for node, own in enumerate(self.kids) for c, to in (own or {}).items()})
        self.taken = Numbers(self.gadget)
        self.ends = np.array([self.inside, self.at_end], np.int32)
        self.parts = np.array([self.left, self.right, self.made], np.int32)
        self.widths = np.array(self.chars, np.int32)

    def _have_arcs(self, last: np.ndarray, label: np.ndarray) -> np.ndarray:
        """``_has_arc`` of many pairs."""
        out, live = np.ones(len(last), bool), np.arange(len(last))
        until_last = until = np.full(len(last), len(self.gadget) + len(self.vocab), np.int32)
        left, right, made = self.parts
        while len(live):
            k = self.taken(last.astype(np.int64) * self.n + label)
            gone = (k >= 0) & (k < until_last) & (k <= until)
            out[live[gone]] = False
            made_last, made_label = made[last], made[label]
            go = np.flatnonzero(~gone & ((made_last >= 0) | (made_label >= 0)))
            live, last, label, until_last, until = live[go], last[go], label[go], until_last[go], until[go]
            made_last, made_label = made_last[go], made_label[go]
            later = made_last > made_label
            until_last, until = np.where(later, made_last, until_last), np.where(later, until, made_label)
            last, label = np.where(later, right[last], last), np.where(later, label, left[label])
        return out

    def encode_all(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the accepted paths along pieces, one after the other, and their number for each; a
        piece given as a number is that label."""
        sizes = np.array([len(p) if isinstance(p, str) else 1 for p in pieces], np.int64)
        cuts = [0, *np.searchsorted(np.cumsum(sizes), np.arange(TOGETHER, sizes.sum(), TOGETHER)).tolist(), len(pieces)]
        done = [self._together(pieces[a:b], sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
        return np.concatenate([labels for labels, _ in done]), np.concatenate([n for _, n in done])

    def _together(self, pieces: list, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        path = np.full(sizes.sum() + 1, -1, np.int32)  # the label with which a path ends at a place
        chosen = np.zeros(len(path), bool)
        alone = np.array([not isinstance(p, str) or len(p) > LONG for p in pieces], bool)
        for i in np.flatnonzero(alone).tolist():
            labels = self.encode(pieces[i]) if isinstance(pieces[i], str) else [pieces[i]]
            first = ends[i] - sizes[i] + 1
            path[first: first + len(labels)], chosen[first: first + len(labels)] = labels, True
        chars = np.frombuffer("".join(p if isinstance(p, str) else " " for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        self._extend(chars.astype(np.int64), ends - sizes, ends, ~alone, path)
        at, first = ends[~alone & (sizes > 0)], (ends - sizes)[~alone & (sizes > 0)]
        while len(at):  # backwards, by a label of every piece at a time
            label = path[at]
            if (label < 0).any():
                raise ValueError(f"no path for {pieces[int(np.searchsorted(ends, at[np.argmin(label)]))]!r}")
            chosen[at] = True
            at = at - self.widths[label]
            more = at > first
            at, first = at[more], first[more]
        return path[chosen], np.diff(np.cumsum(chosen)[ends], prepend=0)

    def _extend(self, chars, firsts, ends, use, path) -> None:
        """Enter the last label of the path to each place of the pieces in use."""
        sizes = ends - firsts
        place = np.flatnonzero(np.repeat(use, sizes))
        first, end = (np.repeat(x[use], sizes[use]) for x in (firsts, ends))
        begin, node, found = place, np.zeros(len(place), np.int64), []
        while len(place):  # labels of one more character, from every place
            node = self.step(node << 21 | chars[place])
            place = place + 1
            label = self.ends[(place == end).astype(np.int64), node]
            hit = np.flatnonzero((node >= 0) & (label >= 0))
            found.append((place[hit], begin[hit], first[hit], label[hit]))
            go = np.flatnonzero((node >= 0) & (place < end))
            place, begin, first, end, node = place[go], begin[go], first[go], end[go], node[go].astype(np.int64)
        if not found:
            return
        place, begin, first, label = (np.concatenate(x) for x in zip(*found))
        order = np.argsort((place - first).astype(np.int16), kind="stable")
        place, begin, label, starts = place[order], begin[order], label[order], (begin == first)[order]
        a = 0
        for b in np.cumsum(np.bincount(place - first[order])).tolist():  # places a character further on
            fits, before = starts[a:b].copy(), path[begin[a:b]]
            inner = np.flatnonzero(~fits & (before >= 0))
            fits[inner] = self._have_arcs(before[inner], label[a:b][inner])
            path[place[a:b][fits]] = label[a:b][fits]
            a = b

    def _enter(self, state: int, c: str) -> int:
        """Enter a transition: the next state and, in the low bits, 1 + the label that ends an accepted path there or 0."""
        label, out = -1, []
        for node, before in self.under_way[state]:
            at = self.kids[node].get(c) if self.kids[node] else None
            if at is not None:
                if self.kids[at] or self.at_end[at] >= 0:
                    out.append((at, before))
                if label < 0 <= self.inside[at] and (before < 0 or self._has_arc(before, self.inside[at])):
                    label = self.inside[at]
        if label >= 0:
            out.append((0, label))
        found = self.table[state << 21 | ord(c)] = self._number(tuple(out)) << self.bits | label + 1
        return found

    def _enter_last(self, state: int, c: str) -> int:
        """Enter the label of a path that ends with the word, at its last character."""
        for node, before in self.under_way[state]:
            at = self.kids[node].get(c) if self.kids[node] else None
            if at is not None and self.at_end[at] >= 0 and (before < 0 or self._has_arc(before, self.at_end[at])):
                self.last[state << 21 | ord(c)] = self.at_end[at]
                return self.at_end[at]
        return -1

    def encode(self, piece: str) -> list[int]:
        """The labels of the accepted path along a piece."""
        if not piece:
            return []
        if len(self.table) > MOST_STATES:
            self._forget()
        state, table, labels, bits, low = 0, self.table, [], self.bits, (1 << self.bits) - 1
        for c in piece[:-1]:
            found = table.get(state << 21 | ord(c))
            if found is None:
                found = self._enter(state, c)
            state = found >> bits
            labels.append((found & low) - 1)
        at = len(piece)
        label = self.last.get(state << 21 | ord(piece[-1]))
        if label is None:
            label = self._enter_last(state, piece[-1])
        path, chars = [], self.chars
        while True:
            if label < 0:
                raise ValueError(f"no path for {piece!r}")
            path.append(label)
            at -= chars[label]
            if not at:
                break
            label = labels[at - 1]
        path.reverse()
        return path


class Codec:
    """Encoder and decoder of a tokenizer file whose model is BPE over pre-split words."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        self.split = Presplitter(tokenizer_json)
        self.automaton = Automaton(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.labels = {i: label for label, i in {**model["vocab"], **self.split.added}.items()}
        every = range(max(self.labels, default=-1) + 1)
        self.spellings = [pa.array([f"{x} ".encode() for x in spelling], pa.large_binary())
                          for spelling in (every, [self.labels.get(i, "") for i in every])]

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        names, codes, counts = self.split.all_pieces(words)
        ids, numbers = self.automaton.encode_all(names)
        flat, ends = ids.tolist(), np.cumsum(numbers).tolist()
        coded = [flat[b - n: b] for b, n in zip(ends, numbers.tolist())]
        flat, out, at = codes.tolist(), [], 0
        for n in counts.tolist():
            out.append([i for c in flat[at: at + n] for i in coded[c]])
            at += n
        return out

    def rendered(self, words: list[str]) -> list[pa.Array]:
        """The decimal ids and the labels of each word, a blank behind each."""
        names, codes, counts = self.split.all_pieces(words)
        ids, numbers = self.automaton.encode_all(names)
        return [grouped(grouped(x, ids, numbers), codes, counts) for x in self.spellings]

    def decode(self, ids: list[int]) -> str:
        """The arc labels, joined as the library joins tokens where a file names no decoder."""
        labels = self.labels
        return " ".join([labels[i] for i in ids])


def _codec(tokenizer_json: str) -> Codec:
    return kept("codec", tokenizer_json, lambda: Codec(tokenizer_json))


def _tokenizer_json(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if json.loads(text).get("decoder") is not None:
        raise ValueError("only files without a decoder of their own are handled")
    return text


def _joined(values: pa.Array, codes: pa.Array, starts) -> Iterator[bytes]:
    """Rendered words of each text, joined by single blanks; words without tokens leave none."""
    data, at = gathered(values, codes, starts)
    raw = data.tobytes()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield raw[a: b - 1] if b > a else b""


def bpe_digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one blank) and decoded_sha256 of whole
    texts. A null text is empty: no tokens, the digests of nothing. Rows keep their number."""
    shipped = docs.sparkSession.sparkContext.broadcast(_tokenizer_json(tokenizer_path))

    def digest(batches):
        codec = _codec(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                starts, codes, words = distinct_words(part["text"])
                numbers, labels = (_joined(v, codes, starts) for v in codec.rendered(words))
                rows = [(n.count(b" ") + 1 if n else 0, hashlib.sha256(n).hexdigest(), hashlib.sha256(d).hexdigest())
                        for n, d in zip(numbers, labels)]
                counts, ids_sha, text_sha = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                     pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, tokenizer_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add ``out``, the ids of a text column as array<int>; other columns stay as they are."""
    shipped = docs.sparkSession.sparkContext.broadcast(_tokenizer_json(tokenizer_path))

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = _codec(shipped.value)
        starts, codes, words = distinct_words(pa.array(texts, pa.string()))
        coded, order = codec.encode(words), codes.to_pylist()
        return _series([[i for c in order[a:b] for i in coded[c]] for a, b in zip(starts[:-1] - starts[0], starts[1:] - starts[0])])

    return docs.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the labels of an array of ids (null: null)."""
    shipped = df.sparkSession.sparkContext.broadcast(_tokenizer_json(tokenizer_path))

    @F.pandas_udf("string")
    def labels(column):
        codec = _codec(shipped.value)
        return _series([None if x is None else codec.decode(list(x)) for x in column])

    return df.withColumn(out, labels(F.col(ids)))


def _series(values: list):
    import pandas as pd
    return pd.Series(values, dtype=object)
