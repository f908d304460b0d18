"""Operator 4: BPE encoding and decoding over a distinct-word table.

Documents are read in blocks.  A block's distinct words go, packed by a hash of
the word, to the encoders; each distinct word of some hundred partitions meets one
encoder and is encoded once there, so there are as many encoders as the input needs.  The ids come back to the block and are put in place by
position.  Only distinct words of a block and the packed word positions move, so
what is shuffled stays below the input, whatever the word frequencies: a word
that every document holds counts once a block.

Decoding joins ids to their pieces; the table of pieces is bounded by the
vocabulary and lies in each worker.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bpe import Splitter, alphabet_bytes
from catalith.llm.common import bound_batches, map_batches, tidy

#: Characters of text in a block; a document is never split.
BLOCK_CHARS = 12_000_000
#: Documents and word positions that are packed together, at most; a longer document stands alone.
CHUNK_DOCS, CHUNK_WORDS = 256, 60_000
#: Packets into which a block's distinct words are dealt, and partitions whose packets go together.
PACKETS, TOGETHER = 256, 512
#: Distinct words that one encoder keeps; beyond it the table starts anew.
KEPT_WORDS = 1_000_000

DICT = "packet int, together int, block string, digest string, places binary, words binary"
IDS = "block string, digest string, places binary, ids binary"
SEQ = "block string, digest string, doc_ids array<long>, sizes binary, places binary"
OUT = "doc_id long, n_tokens long, ids binary, text binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def pack(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, words), "<u4", len(words)).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(words).to_bytes(4, "little") + sizes + b"".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    out, at = [], 4 + 4 * n
    for end in ends.tolist():
        out.append(raw[at:end])
        at = end
    return out


class Numbered(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def word_lists(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[str, list]]:
    """(name, words) of block after block; words in order of their first place, as ``blocks`` numbers them."""
    splitter, part, run = Splitter(path), TaskContext.get().partitionId(), 0
    seen, some, chars = {}, False, 0
    for batch in batches:
        for text in batch.column(1).to_pylist():
            text, some = text or "", True
            seen.update(dict.fromkeys(splitter.pieces(text)))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield f"{part}-{run}", list(seen)
                seen, some, chars, run = {}, False, 0, run + 1
    if some:
        yield f"{part}-{run}", list(seen)


def blocks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[str, list[int], list[np.ndarray], list]]:
    """(name, document ids, word numbers of each, words) of block after block."""
    splitter, part, run = Splitter(path), TaskContext.get().partitionId(), 0
    ids, places, numbers, chars = [], [], Numbered(), 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            words = splitter.pieces(text)
            ids.append(doc_id)
            places.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
            chars += len(text)
            if chars >= BLOCK_CHARS:
                yield f"{part}-{run}", ids, places, list(numbers)
                ids, places, numbers, chars, run = [], [], Numbered(), 0, run + 1
    if ids:
        yield f"{part}-{run}", ids, places, list(numbers)


def as_bytes(word) -> bytes:
    """A special token, which comes as its id, is marked by a byte that UTF-8 never has."""
    return b"\xff%d" % word if isinstance(word, int) else word.encode("utf-8", "surrogatepass")


def digest_of(words: list[bytes]) -> str:
    return hashlib.md5(b"\xfe".join(words)).hexdigest()


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


DICT_ARROW = pa.schema([("packet", pa.int32()), ("together", pa.int32()), ("block", pa.string()), ("digest", pa.string()), ("places", pa.binary()), ("words", pa.binary())])
IDS_ARROW = pa.schema([("block", pa.string()), ("digest", pa.string()), ("places", pa.binary()), ("ids", pa.binary())])
SEQ_ARROW = pa.schema([("block", pa.string()), ("digest", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("places", pa.binary())])
OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("text", pa.binary())])
DIGESTS_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def distinct_words(docs: DataFrame, path: str) -> DataFrame:
    """The distinct words of each block, dealt into packets by a hash of the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = TaskContext.get().partitionId() // TOGETHER
        for block, words in word_lists(batches, path):
            raw = [as_bytes(w) for w in words]
            digest = digest_of(raw)
            packet = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % PACKETS
            order = np.argsort(packet, kind="stable")
            bounds = np.searchsorted(packet[order], np.arange(PACKETS + 1))
            rows = []
            for k in range(PACKETS):
                own = order[bounds[k] : bounds[k + 1]]
                if len(own):
                    rows.append((k, together, block, digest, pack(own), pack_words([raw[i] for i in own.tolist()])))
            yield batch_of(rows, DICT_ARROW)

    return map_batches(docs, run, DICT)


def word_positions(docs: DataFrame, path: str) -> DataFrame:
    """The numbers of each document's words in its block, in order of position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, places, words in blocks(batches, path):
            digest = digest_of([as_bytes(w) for w in words])
            at = size = 0
            for end in range(1, len(ids) + 1):
                size += len(places[end - 1])
                if end == len(ids) or end - at >= CHUNK_DOCS or size + len(places[end]) > CHUNK_WORDS:
                    own = places[at:end]
                    row = (block, digest, ids[at:end], pack(np.fromiter(map(len, own), np.uint32, len(own))), pack(np.concatenate(own)))
                    yield batch_of([row], SEQ_ARROW)
                    at, size = end, 0

    return map_batches(docs, run, SEQ)


def encode_words(packets: DataFrame, path: str) -> DataFrame:
    """Encode each distinct word once; ``ids`` holds, packed, the counts and then all ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Splitter(path).tokenizer
        tokenizer.encode_special_tokens = True
        known: dict[bytes, bytes] = {}
        for batch in batches:
            rows = []
            for block, digest, places, words in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                words = unpack_words(words)
                new = [w for w in words if w not in known]
                if new:
                    if len(known) >= KEPT_WORDS:
                        known.clear()
                        new = words
                    marks = [w for w in new if w[:1] == b"\xff"]
                    known.update((w, int(w[1:]).to_bytes(4, "little")) for w in marks)
                    new = [w for w in new if w[:1] != b"\xff"]
                    encoded = tokenizer.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
                    known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, encoded, strict=True))
                ids = [known[w] for w in words]
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                rows.append((block, digest, places, pack(np.concatenate([sizes, np.frombuffer(b"".join(ids), "<u4")]))))
            yield batch_of(rows, IDS_ARROW)

    return map_batches(packets, run, IDS)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes of runs laid end to end."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - sizes), sizes)


class Pieces:
    """The id-to-piece table, as one buffer of bytes."""

    def __init__(self, path: str):
        tokenizer = Splitter(path).tokenizer
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        added = {i for i in tokenizer.get_added_tokens_decoder()}
        table, pieces = alphabet_bytes(), [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            pieces[i] = piece.encode() if i in added else bytes([table[c] for c in piece])
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buffer = np.frombuffer(b"".join(pieces), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        sizes = self.sizes[ids]
        return self.buffer[ragged(self.starts[ids], sizes)].tobytes(), sizes


def place_ids(ids: DataFrame, positions: DataFrame, path: str, digests: bool) -> DataFrame:
    """Put the ids of each block's words in place, and decode them through the pieces."""
    schema = DIGESTS_ARROW if digests else OUT_ARROW

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces, out = _pieces(path), []
        names = set(left.column("digest").to_pylist()) | set(right.column("digest").to_pylist())
        if right.num_rows and len(names) > 1:
            raise RuntimeError("a block was read twice with different rows; write the documents to a table first")
        at, sizes, flat, total = [], [], [], 0
        for places, packed in zip(left.column("places").to_pylist(), left.column("ids").to_pylist(), strict=True):
            own, values = unpack(places), unpack(packed)
            at.append(own)
            sizes.append(values[: len(own)].astype(np.int64))
            flat.append(values[len(own) :])
        if at:
            at, sizes, flat = np.concatenate(at), np.concatenate(sizes), np.concatenate(flat)
            size_of = np.zeros(len(at), np.int64)
            start_of = np.zeros(len(at), np.int64)
            size_of[at], start_of[at] = sizes, np.cumsum(sizes) - sizes
        else:
            size_of = start_of = np.zeros(0, np.int64)
            flat = np.zeros(0, np.uint32)
        for doc_ids, counts, places in zip(right.column("doc_ids").to_pylist(), right.column("sizes").to_pylist(), right.column("places").to_pylist(), strict=True):
            counts, places = unpack(counts).astype(np.int64), unpack(places)
            lengths = size_of[places]
            tokens = flat[ragged(start_of[places], lengths)].astype("<u4")
            text, bytes_of = pieces.join(tokens)
            words_at = np.concatenate([[0], np.cumsum(counts)])
            tokens_at = np.concatenate([[0], np.cumsum(lengths)])[words_at].tolist()
            text_at = np.concatenate([[0], np.cumsum(bytes_of)])[tokens_at].tolist()
            raw = tokens.tobytes()
            for i, doc_id in enumerate(doc_ids):
                a, b = tokens_at[i], tokens_at[i + 1]
                decoded = text[text_at[i] : text_at[i + 1]].decode("utf-8", "replace").encode()
                own = raw[4 * a : 4 * b]
                out.append((doc_id, b - a, hashlib.sha256(own).hexdigest(), hashlib.sha256(decoded).hexdigest()) if digests else (doc_id, b - a, own, decoded))
        table = pa.Table.from_batches([batch_of(out, schema)])
        del left, right, out
        tidy()
        return table

    return ids.groupBy("block").cogroup(positions.groupBy("block")).applyInArrow(run, DIGESTS if digests else OUT)


_PIECES: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def bpe_round_trip(docs: DataFrame, path: str, digests: bool = True) -> DataFrame:
    """Encode every whole text and decode it again.

    One row per row of ``docs``: its number of tokens and either the ids (as
    little-endian unsigned 32-bit integers) and the decoded text in UTF-8, or the
    SHA-256 of both.  Null and empty texts have no tokens.  Repeated rows give
    repeated rows.  ``docs`` must be a table (read twice, with the same rows): a
    block that changes between the reads raises an error rather than mixing ids.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packets = distinct_words(docs, path).repartition("packet", "together")
    return place_ids(encode_words(packets, path), word_positions(docs, path), path, digests)
