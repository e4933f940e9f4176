"""Byte-level BPE over a global table of distinct words.

Each task cuts its documents into pre-tokens, numbers the distinct ones of a block of documents and keeps every document
as the sequence of its word numbers, by position. One shuffle brings equal words of all blocks together, where each
distinct word is encoded once; the ids join the blocks that hold the word, and every document is reassembled by position.
Decoding looks the ids up in the token-byte table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, tasks_for, text_of

#: Bytes of text in one block of documents, and bytes of all text for one bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank, the leftmost of equals, until no pair has a rank. O(n log n)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


#: A pattern over \p{L} and \p{N} and one for Python's faster re module; on texts in which _ODD finds nothing, they agree.
_SLOW = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_ODD = re.compile("[^\x00-\x1b\x20-ɏ]|[\xb2\xb3\xb9\xbc-\xbe]").search


@functools.lru_cache(4)
def splitter(text: str):
    """text -> its pre-tokens."""
    slow = regex.compile(text).findall
    if text != _SLOW:
        return slow
    return lambda s: slow(s) if _ODD(s) else _FAST(s)


@functools.lru_cache(4)
def _ranks(path: str, name: str) -> dict[bytes, int]:
    return load_ranks(path or SparkFiles.get(name))


@functools.lru_cache(4)
def _token_bytes(path: str, name: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path, name).items()}


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of int32, byte planes apart, compressed."""
    one = np.concatenate([np.array([len(arrays), *map(len, arrays)], np.int32), *(a.astype(np.int32) for a in arrays)])
    return zstandard.ZstdCompressor(level=9).compress(np.ascontiguousarray(one.view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(data: bytes) -> list[np.ndarray]:
    one = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).view(np.int32).ravel()
    sizes = one[1 : one[0] + 1]
    return np.split(one[one[0] + 1 :], np.cumsum(sizes)[:-1])


_CUT = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("ids", pa.list_(pa.int64())), ("numbers", pa.binary()), ("words", pa.binary())])
_CUT_SQL = "block long, bucket int, ids array<long>, numbers binary, words binary"


def _cut(split: str, block_bytes: int, buckets: int):
    """Documents to blocks: a row (bucket -1) with the word numbers of the documents, and the words by bucket."""

    def rows(block: int, ids: list, sequences: list[np.ndarray], known: dict) -> Iterator[pa.RecordBatch]:
        flat = np.concatenate(sequences)
        often = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")  # frequent words get small numbers
        number = np.empty(len(often), np.int32)
        number[often] = np.arange(len(often), dtype=np.int32)
        words = [w.encode() for w in known]
        place = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
        order = np.lexsort((number, place))  # the words by bucket, the block keeps their numbers
        out = [(block, -1, ids, _pack(np.array([len(s) for s in sequences]), number[flat], np.diff(number[order], prepend=0)), None)]
        cuts = np.flatnonzero(np.append(True, place[order][1:] != place[order][:-1])) if len(order) else []
        for own in np.split(order, cuts[1:]) if len(order) else []:
            lengths = np.array([len(words[k]) for k in own])
            out.append((block, int(place[own[0]]), None, _pack(lengths), zstandard.ZstdCompressor(level=12).compress(b"".join([words[k] for k in own]))))
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 256], strict=True), _CUT, strict=True)], schema=_CUT)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = splitter(split)
        block = TaskContext.get().partitionId() << 32
        ids, sequences, known, size = [], [], _Numbers(), 0
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = parts(text)
                    ids.append(doc_id)
                    sequences.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    size += len(text)
                    if size > block_bytes:
                        yield from rows(block, ids, sequences, known)
                        block += 1
                        ids, sequences, known, size = [], [], _Numbers(), 0
        if ids:
            yield from rows(block, ids, sequences, known)

    return cut


def _split_words(data: bytes, lengths: np.ndarray) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data) if len(lengths) and lengths.sum() else b""
    ends = np.cumsum(lengths).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _encode(path: str, name: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket: each distinct word of a bucket is encoded once and joins all blocks that hold it."""
        ranks = _ranks(path, name)
        bucket, known = None, {}
        for b in batches:
            out = []
            for block, own, numbers, words in zip(*(b.column(x).to_pylist() for x in ("block", "bucket", "numbers", "words")), strict=True):
                if own != bucket:
                    bucket, known = own, {}
                (lengths,) = _unpack(numbers)
                found = []
                for w in _split_words(words, lengths):
                    if (ids := known.get(w)) is None:
                        ids = known[w] = encode_word(w, ranks)
                    found.append(ids)
                out.append((block, own, _pack(np.array([len(x) for x in found]), np.array([i for x in found for i in x]))))
            blocks, of, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(of, pa.int32()), pa.array(data, pa.binary())], names=["block", "bucket", "encoded"])

    return encode


def _assemble(path: str, name: str, whole: bool):
    def assemble(docs: pa.Table, words: pa.Table) -> pa.Table:
        bytes_of = _token_bytes(path, name)
        parts = [_unpack(x) for _, x in sorted(zip(words.column("bucket").to_pylist(), words.column("encoded").to_pylist(), strict=True))]
        held = [(ids, _unpack(numbers)) for ids, numbers in zip(docs.column("ids").to_pylist(), docs.column("numbers").to_pylist(), strict=True)]
        n = sum(len(p[0]) for p in parts)
        counts = np.zeros(n, np.int64)
        listed, decoded, ids_of = np.empty(n, object), np.empty(n, object), np.empty(n, object)
        number = iter(np.cumsum(held[0][1][2]).tolist() if held else ())  # a block is one row
        for sizes, ids in parts:
            ends = np.cumsum(sizes).tolist()
            for a, b in zip([0, *ends], ends, strict=False):
                k, own = next(number), ids[a:b].tolist()
                counts[k] = b - a
                listed[k] = b"%d" % own[0] if b - a == 1 else " ".join(map(str, own)).encode()
                decoded[k] = bytes_of[own[0]] if b - a == 1 else b"".join([bytes_of[i] for i in own])
                if whole:
                    ids_of[k] = own
        out: dict[str, list] = {x: [] for x in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")} | ({"ids": [], "decoded": []} if whole else {})
        for ids, (sizes, flat, _) in held:
            for doc_id, own in zip(ids, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                text = b"".join(decoded[own].tolist())
                out["doc_id"].append(doc_id)
                out["n_tokens"].append(int(counts[own].sum()))
                out["ids_sha256"].append(hashlib.sha256(b" ".join(listed[own].tolist())).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                if whole:
                    out["ids"].append([i for k in own.tolist() for i in ids_of[k]])
                    out["decoded"].append(text)
        types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.binary()}
        return pa.table({x: pa.array(v, types.get(x, pa.string())) for x, v in out.items()})

    return assemble


def encode_documents(docs: DataFrame, path: str | None = None, split: str | None = None, whole: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; whole adds ids and decoded themselves.

    Null texts count as empty and have no tokens. Repeated rows are encoded each. path is a file of base64 tokens and ranks
    that every executor has at the same place; if it is another, give it to addFile and pass its name. Texts of any length
    are whole; a block holds one document at least. Other columns are ignored.
    """
    path, split = path or vocabulary(), split or pattern()
    at, name = (path, "") if "/" in path else ("", path)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    cut = checkpoint(docs.mapInArrow(_cut(split, block_bytes, tasks_for(size, bucket_bytes)), _CUT_SQL))  # block numbers must not change
    words = cut.where("bucket >= 0").select("block", "bucket", "numbers", "words").repartition("bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(_encode(at, name), "block long, bucket int, encoded binary")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * whole
    blocks = cut.where("bucket < 0").select("block", "ids", "numbers")
    return blocks.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(_assemble(at, name, whole), schema)


def decode_ids(rows: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """Adds decoded, the bytes of each row's token ids; null ids give null, unknown ids raise an error."""
    path = path or vocabulary()
    at, name = (path, "") if "/" in path else ("", path)

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        table = _token_bytes(at, name)
        return ids.map(lambda x: None if x is None else b"".join([table[i] for i in x]))

    return rows.withColumn("decoded", decoded(F.col(column)))
