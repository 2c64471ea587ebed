"""Token ids of a corpus as bit-packed binary files (operator 1).

The texts are range partitioned and sorted by ``doc_id``; each partition encodes its texts with
the ``tokenizers`` library and writes one file. A file holds

* ``magic`` and blocks of ``BLOCK`` ids, each id in ``width`` bits, least significant bit first,
* a footer with the documents' ids and first positions and the byte offset of every block,
* a fixed trailer that says where the footer begins and how wide an id is.

So a reader unpacks whole blocks with numpy and finds any document or position without reading
the rest. A task writes under a new name and reports it in its output row; only rows that Spark
commits to the manifest count, so retried and speculative tasks leave no trace in the result.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from ledgerlint.llm.presplit import CACHED_PIECES, Presplitter, distinct_words, gathered
from ledgerlint.llm.worker import kept
from ledgerlint.sources.tables import fresh_path, materialise

MAGIC = b"LLPACK01"
BLOCK = 8192  # ids of a block; a multiple of 8, so that blocks begin at whole bytes
TRAILER = "<QQQHQ"  # footer offset, documents, ids, width, ids of a block


def bits_needed(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width in width bits each; the last byte is padded with zeros."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little")
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    return (bits.reshape(n, width).astype(np.uint64) @ weights).astype(np.uint32)


class PackWriter:
    """Writes documents one after the other; holds one open block and 16 bytes a document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.docs: list[int | None] = []
        self.firsts, self.offsets = [0], []
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.at = len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.firsts.append(self.firsts[-1] + len(ids))
        self.open.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 16 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            data = pack(ids[k: min(k + BLOCK, whole)], self.width)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.open, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes())
        self.out.write(np.array(self.firsts, "<u8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self.out.write(struct.pack(TRAILER, self.at, len(self.docs), self.firsts[-1], self.width, BLOCK) + MAGIC)


class PackReader:
    """Random access to a file of :class:`PackWriter`."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._bytes(size - struct.calcsize(TRAILER) - len(MAGIC), struct.calcsize(TRAILER) + len(MAGIC))
        if tail[-len(MAGIC):] != MAGIC:
            raise ValueError("not a file of packed ids, or cut short")
        footer, n, self.n_ids, self.width, self.block = struct.unpack(TRAILER, tail[: struct.calcsize(TRAILER)])
        data = self._bytes(footer, size - footer - struct.calcsize(TRAILER) - len(MAGIC))
        docs, known = np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n)
        self.docs = [int(d) if k else None for d, k in zip(docs, known)]
        self.firsts = np.frombuffer(data, "<u8", n + 1, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(data[9 * n + 8 * (n + 1):], "<u8").astype(np.int64)

    def _bytes(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids at the positions from start to stop, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        begin = first * self.block
        n = min((last + 1) * self.block, self.n_ids) - begin
        data = self._bytes(int(self.offsets[first]), (n * self.width + 7) // 8)
        return unpack(data, self.width, n)[start - begin: stop - begin]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position, ids) of each document; about at_once ids are read together."""
        k, n = 0, len(self.docs)
        while k < n:
            stop = max(k + 1, int(np.searchsorted(self.firsts, self.firsts[k] + at_once, "right")) - 1)
            base, run = int(self.firsts[k]), self.ids(int(self.firsts[k]), int(self.firsts[stop]))
            for i in range(k, stop):
                a, b = int(self.firsts[i]), int(self.firsts[i + 1])
                yield self.docs[i], a, run[a - base: b - base]
            k = stop


class WordEncoder:
    """Ids of words by the ``tokenizers`` library. Each piece is encoded once while it is cached."""

    def __init__(self, tokenizer_json: str):
        self.split = Presplitter(tokenizer_json)
        self.model = Tokenizer(self.split.tokenizer.model)
        self.known: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if len(self.known) > CACHED_PIECES:
            self.known = {}
        known = self.known
        split = [self.split.pieces(w) for w in words]
        pieces = list({p for found in split for p in found if p not in known})
        if pieces:
            texts = [p for p in pieces if isinstance(p, str)]
            known.update((p, struct.pack("<I", p)) for p in pieces if not isinstance(p, str))
            coded = self.model.encode(texts, is_pretokenized=True, add_special_tokens=False)
            data = np.array(coded.ids, "<u4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(texts)))
            start = 0
            for piece, end in zip(texts, ends.tolist()):
                known[piece] = data[start:end]
                start = end
        return [known[s[0]] if len(s) == 1 else b"".join([known[p] for p in s]) for s in split]


def _encoder(tokenizer_json: str) -> WordEncoder:
    return kept("word encoder", tokenizer_json, lambda: WordEncoder(tokenizer_json))


def encode_texts(texts: pa.Array, tokenizer_json: str) -> list[np.ndarray]:
    """Ids of whole texts, as the library's ``encode`` gives them without special tokens."""
    starts, codes, words = distinct_words(texts)
    data, at = gathered(_encoder(tokenizer_json).encode(words), codes, starts)
    ids, at = data[: at[-1]].view("<u4"), at // 4
    return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _open(uri: str, how: str):
    store, path = fs.FileSystem.from_uri(uri)
    if how == "read":
        return store.open_input_file(path)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # whatever the name ends in


def as_uri(path: str) -> str:
    return path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace(":/", ":///", 1)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write packed files below ``folder``, a place all
    executors share and ``pyarrow.fs`` can write to. Returns the manifest, one row per file:
    shard, path, n_docs, n_ids. Files follow each other in ascending doc_id order (null first);
    rows with equal doc_id are ordered by their text.

    A null text is empty: only the end id. An empty table gives no file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    vocabulary = Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True)
    width = bits_needed(max(vocabulary, end_id + 1))
    shipped = spark.sparkContext.broadcast(tokenizer_json)  # one file of a fixed vocabulary
    folder = as_uri(folder)
    end = np.array([end_id], np.uint32)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, writer, out = f"{folder}/{uuid.uuid4().hex}.ids", None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                if writer is None and part.num_rows:
                    out = _open(path, "write")
                    writer = PackWriter(out, width)
                for doc_id, ids in zip(part["doc_id"].to_pylist(),
                                       encode_texts(part["text"], shipped.value)):
                    writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            out.close()
            row = [TaskContext.get().partitionId(), path, len(writer.docs), writer.firsts[-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int64()), pa.array([path]), pa.array([row[2]], pa.int64()),
                 pa.array([row[3]], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
               .withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
               .select("doc_id", "text"))
    return materialise(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long"),
                       "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files of a manifest: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and shard; each file is read by one task, block by block."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for files in batches:
            for shard, path, base in zip(files["shard"].to_pylist(), files["path"].to_pylist(),
                                         files["base"].to_pylist()):
                with _open(path, "read") as source:
                    rows = []
                    for doc_id, first, ids in PackReader(source).documents():
                        rows.append((doc_id, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    n = max(1, manifest.count())
    return placed.repartitionByRange(n, "shard").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def token_digest(docs: DataFrame, tokenizer_path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the ids of a corpus and read them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or fresh_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer_path, end_id)).drop("shard")
