"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide counts of linked ids.

Texts are cut before every space that follows a visible character: there both tokenizers end a token, and neither looks
across. So a document's alignment is that of its segments in order, and each distinct segment of a block of documents is
encoded and aligned once, all of them in whole arrays.

The first pass gives each task's distinct pairs of linked ids with their counts. The distinct pairs of all tasks fall into
CELLS cells by hash, and each cell gets a minimal perfect hash. Counts become dense vectors by that hash, which are summed
in a tree: a row's task adds what it holds, and FAN vectors at a time are added until one is left for a cell. Keys stand
at their index beside the counts, so a look-up is verified. The second pass aligns the documents again and looks the pairs
of each block up.

The table has a row for each distinct pair, so its size is bounded by the two vocabularies, whatever the corpus. It is
broadcast in groups of cells of at most TABLE_PAIRS pairs (16 bytes each), however many groups that takes; a task holds one
group at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, text_of
from flowkit.llm.perfect_hash import PerfectHash, mixed
from flowkit.operators.components import release

#: Bytes of text of one block, pairs that a task gathers before it gives them out, cells of pairs, rows of a first vector,
#: vectors that are added at a time, and pairs in one broadcast.
BLOCK_BYTES, TASK_PAIRS, CELLS, VECTOR_ROWS, FAN, TABLE_PAIRS = 12 << 20, 1 << 21, 64, 1 << 21, 8, 1 << 22

#: Visible characters after which a space starts a segment: no white space in any definition, and not U+2581.
_RANGES = ((0x21, 0x7E), (0xA1, 0x167F), (0x1681, 0x180D), (0x180F, 0x1FFF), (0x3001, 0xD7FF))
_CUT = re.compile(f"(?<=[{''.join(f'{chr(a)}-{chr(b)}' for a, b in _RANGES)}]) ")
#: Texts with another space than those, and segments that the fast encoder is not trusted with.
_ODD_SPACE = rf"(^|[^{''.join(rf'\x{{{a:x}}}-\x{{{b:x}}}' for a, b in _RANGES)}]) "
_ODD_SEGMENT = r"[^ -~\n\t\x{a1}-\x{24f}]|[^ \n\t]{200}"


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 is itself, the rest follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """The two tokenizers, the bytes of their tokens, and segments to flat ids."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_level()
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, k in vocab.items():
            self.a_bytes[k] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        pieces = range(self.b.get_piece_size())
        text = [self.b.id_to_piece(k) for k in pieces]
        self.b_bytes = [bytes([int(text[k][3:5], 16)]) if self.b.is_byte(k) else text[k].replace("▁", " ").encode() for k in pieces]
        if any(re.search("[^▁]▁", t) for t in text):
            raise ValueError("a piece goes on after a word's end: texts can't be cut at spaces")
        self.a_len, self.b_len = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.fast = self._ranks(spec)
        n = len(self.a_bytes)
        self.written = [b"%d%s" % (k, end) for k in range(n) for end in (b",", b"|")] + [b"%d%s" % (k, end) for k in pieces for end in (b",", b";", b"\n")]

    def _ranks(self, spec: dict):
        """An encoder by ranks, if merges are listed by the ids of what they make, so that ranks say the same as merges."""
        import public_tokenizers
        import tiktoken

        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        ranks = {self.a_bytes[k]: k for k in vocab.values()}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, segments: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat A ids, their number in each segment, the same for B, and whether the segment's bytes came back from both."""
        odd = np.asarray(pc.match_substring_regex(segments, _ODD_SEGMENT)) | (self.fast is None)
        texts = [" " + x for x in segments.to_pylist()]
        sizes = np.asarray(pc.binary_length(segments)).astype(np.int64) + 1
        n = len(texts)
        a_parts: list = [None] * n
        ordinary = np.flatnonzero(~odd)
        whole = bool(len(ordinary) == n)
        ids = np.array(self.fast("".join(texts if whole else [texts[k] for k in ordinary.tolist()])), np.int64) if len(ordinary) else np.empty(0, np.int64)
        ends = np.cumsum(self.a_len[ids])
        stops = np.searchsorted(ends, np.cumsum(sizes[ordinary]), side="right")
        if whole:
            a, a_n = ids, np.diff(stops, prepend=0)
        else:
            for k, part in zip(ordinary.tolist(), np.split(ids, stops[:-1]), strict=True) if len(ordinary) else ():
                a_parts[k] = part
            others = np.flatnonzero(odd).tolist()
            for k, e in zip(others, self.a.encode_batch([texts[k] for k in others], add_special_tokens=False), strict=True):
                a_parts[k] = e.ids
            a, a_n = _flat(a_parts)
        space = [self.b.piece_to_id("▁")]  # a space alone, which the model doesn't add to an empty text
        b, b_n = _flat([x or space for x in self.b.encode([t[1:] for t in texts], num_threads=1)])
        good = np.ones(n, bool)
        source = "".join(texts).encode()
        for table, flat, count in ((self.a_bytes, a, a_n), (self.b_bytes, b, b_n)):
            if b"".join(map(table.__getitem__, flat.tolist())) != source:
                cuts = np.cumsum(count)[:-1]
                good &= np.array([b"".join([table[i] for i in part]) == t.encode() for part, t in zip(np.split(flat, cuts), texts, strict=True)], bool)
        return a, a_n, b, b_n, good


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def _sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of x, of counts values each."""
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class Aligned:
    """The alignment of distinct segments: counts for each, and links as pairs of ids, A in the upper half."""

    def __init__(self, t: Tokenizers, segments: pa.Array, written: bool = False, chunk: int = 1 << 16) -> None:
        parts = [self._align(t, segments.slice(k, chunk), written) for k in range(0, max(1, len(segments)), chunk)]
        self.good, self.n_a, self.n_b, self.n_groups, self.n_links, self.pairs = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:6])
        self.written = [x for p in parts for x in p[6]]

    @staticmethod
    def _align(t: Tokenizers, segments: pa.Array, written: bool):
        a, a_n, b, b_n, good = t.encode(segments)
        if not good.all():
            a, b = a[np.repeat(good, a_n)], b[np.repeat(good, b_n)]
            a_n, b_n = a_n * good, b_n * good
        a_end, b_end = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
        first = np.searchsorted(b_end, a_end - t.a_len[a], side="right")
        after = np.searchsorted(b_end - t.b_len[b], a_end, side="left")
        n = after - first
        links = np.cumsum(n)
        to = np.arange(links[-1] if len(n) else 0) - np.repeat(links - n - first, n)
        pairs = (np.repeat(a, n) << 32) | b[to]
        b_before = np.searchsorted(b_end, a_end, side="right")  # B tokens that end by the end of each A token
        shared = b_end[np.maximum(b_before - 1, 0)] == a_end if len(b) else np.zeros(len(a), bool)
        groups = _sums(shared.astype(np.int64), a_n)
        text: list[bytes] = []
        if written:
            a_ends, b_ends = np.flatnonzero(shared), b_before[shared] - 1
            a_group = np.cumsum(shared) - shared
            b_shared = np.zeros(len(b), np.int64)
            b_shared[b_ends] = 1
            b_group = np.cumsum(b_shared) - b_shared
            code = np.empty(len(a) + len(b), np.int64)
            code[np.arange(len(a)) + np.concatenate([[0], b_ends + 1])[a_group]] = 2 * a + shared
            b_shared[np.cumsum(b_n)[b_n > 0] - 1] = 2  # the last of a segment
            code[np.arange(len(b)) + (a_ends + 1)[b_group] if len(b) else []] = 2 * len(t.a_bytes) + 3 * b + b_shared
            found = iter(b"".join(map(t.written.__getitem__, code.tolist())).split(b"\n"))
            text = [next(found) if g else b"" for g in good.tolist()]
        return good, a_n, b_n, groups, _sums(n, a_n), pairs, text


class Block:
    """Documents of one block: for each the distinct segments that it is made of, by number; documents without text have none."""

    def __init__(self, ids: pa.Array, texts: pa.Array) -> None:
        self.ids = ids
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        odd = np.asarray(pc.match_substring_regex(texts, _ODD_SPACE)) & ~empty
        plain, odd = np.flatnonzero(~odd & ~empty), np.flatnonzero(odd)
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        parts = [_CUT.split(x) for x in texts.take(pa.array(odd)).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        counts[plain] = np.asarray(pc.list_value_length(lists))
        counts[odd] = [len(p) for p in parts]
        flat = pa.concat_arrays([lists.flatten(), pa.array(itertools.chain.from_iterable(parts), pa.string())]).dictionary_encode()
        order = np.concatenate([plain, odd])
        self.segments = flat.dictionary
        numbers = np.asarray(flat.indices)
        if len(odd):  # the segments of each document in the order of the documents
            starts = np.concatenate([[0], np.cumsum(counts[order])])[:-1]
            at = np.zeros(len(texts), np.int64)
            at[order] = starts
            shift = np.repeat(at - (np.cumsum(counts) - counts), counts)
            numbers = numbers[np.arange(len(numbers)) + shift]
        self.numbers, self.counts = numbers, counts

    def whole(self, good: np.ndarray) -> np.ndarray:
        """Which documents have tokens: all their segments came back."""
        return (_sums((~good[self.numbers]).astype(np.int64), self.counts) == 0) & (self.counts > 0)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return _sums(values[self.numbers], self.counts)


def blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    size = 0

    def made() -> Block:
        t = pa.Table.from_batches(held).combine_chunks()
        return Block(t.column(0).chunk(0), t.column(1).chunk(0))

    for b in batches:
        for k in range(0, b.num_rows, 128):
            part = b.slice(k, 128)
            held.append(part)
            size += part.column(1).nbytes
            if size > block_bytes:
                yield made()
                held, size = [], 0
    if held:
        yield made()


@functools.lru_cache(2)
def _tokenizers(paths: tuple[str, str]) -> Tokenizers:
    return Tokenizers(*(p if "/" in p else SparkFiles.get(p) for p in paths))


def cell_of(pairs: np.ndarray) -> np.ndarray:
    return (mixed(pairs, -1) >> np.uint64(58)).astype(np.int32)  # 64 cells


def counted(pairs: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the sum of their weights."""
    order = np.argsort(pairs, kind="stable")
    pairs, weights = pairs[order], weights[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pairs[first], np.add.reduceat(weights, first) if len(first) else weights


def _task_pairs(paths: tuple[str, str], block_bytes: int, task_pairs: int):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            cells = cell_of(pairs)
            for k in range(0, len(pairs), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(cells[part]), pa.array(pairs[part]), pa.array(n[part])], names=["cell", "pair", "n"])

        pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for block in blocks(batches, block_bytes):
            aligned = Aligned(_tokenizers(paths), block.segments)
            kept = np.repeat(block.whole(aligned.good), block.counts)
            times = np.bincount(block.numbers[kept], minlength=len(block.segments)).astype(np.int64)
            weights = np.repeat(times, aligned.n_links)
            own, more = counted(aligned.pairs[weights > 0], weights[weights > 0])
            pairs, n = counted(np.concatenate([pairs, own]), np.concatenate([n, more]))
            if len(pairs) > task_pairs:
                yield from out(pairs, n)
                pairs, n = np.empty(0, np.int64), np.empty(0, np.int64)
        yield from out(pairs, n)

    return find


def _build(keys: pa.Table) -> pa.Table:
    found = np.asarray(keys.column("pair").combine_chunks())
    hashed = PerfectHash.build(found)
    placed = np.empty_like(found)
    placed[hashed.index(found)] = found
    return pa.table({"cell": keys.column("cell")[:1].cast(pa.int32()), "hash": pa.array([hashed.dump()], pa.binary()), "keys": pa.array([placed.tobytes()], pa.binary())})


def _vector(rows: pa.Table, cell: pa.Table) -> pa.Table:
    """What these rows add to their cell's counts, as a vector by the cell's hash; keys are verified."""
    if not rows.num_rows:
        return pa.table({"cell": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
    pairs, n = (np.asarray(rows.column(x).combine_chunks()) for x in ("pair", "n"))
    keys = np.frombuffer(cell.column("keys")[0].as_py(), np.int64)
    at = PerfectHash.load(cell.column("hash")[0].as_py()).index(pairs)
    if (keys[at] != pairs).any():
        raise RuntimeError("a pair is missing from the table of pairs")
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, n)
    return pa.table({"cell": rows.column("cell")[:1].cast(pa.int32()), "part": rows.column("part")[:1].cast(pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})


def _added(vectors: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in vectors.column("counts").to_pylist())
    return pa.table({"cell": vectors.column("cell")[:1], "part": vectors.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def pair_table(docs: DataFrame, paths: tuple[str, str] | None = None, block_bytes: int = BLOCK_BYTES, task_pairs: int = TASK_PAIRS, vector_rows: int = VECTOR_ROWS) -> DataFrame:
    """A row for each cell of pairs: cell, its hash, keys by index and counts by index. The rows are checkpointed.

    docs has a column text; nulls and empty texts add nothing, repeated rows count each.
    """
    found = docs.select(F.lit(0).alias("id"), text_of().alias("text")).mapInArrow(_task_pairs(paths or default_paths(), block_bytes, task_pairs), "cell int, pair long, n long")
    found = checkpoint(found)
    n = found.count()
    parts = max(1, -(-n // (CELLS * vector_rows)))  # vectors of a cell to begin with
    hashes = checkpoint(found.select("cell", "pair").distinct().groupBy("cell").applyInArrow(_build, "cell int, hash binary, keys binary"))
    spread = found.withColumn("part", F.pmod(F.xxhash64("pair", "n"), F.lit(parts)).cast("int"))
    each = hashes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kind = "cell int, part int, counts binary"
    vectors = spread.groupBy("cell", "part").cogroup(each.groupBy("cell", "part")).applyInArrow(_vector, kind)
    while parts > 1:
        vectors = vectors.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("cell", "part").applyInArrow(_added, kind)
        parts = -(-parts // FAN)
    table = checkpoint(hashes.join(vectors.select("cell", "counts"), "cell"))
    release(found, hashes)
    return table


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for keys, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            pairs, n = np.frombuffer(keys, np.int64), np.frombuffer(counts, np.int64)
            for k in range(0, len(pairs), 1 << 16):
                own = pairs[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array((own >> 32).astype(np.int32)), pa.array((own & 0xFFFFFFFF).astype(np.int32)), pa.array(n[k : k + (1 << 16)])], names=["a_id", "b_id", "n"])


def pair_counts(table: DataFrame) -> DataFrame:
    """a_id, b_id and n, the links of the corpus that hold them, from pair_table()."""
    return table.select("keys", "counts").mapInArrow(_listed, "a_id int, b_id int, n long")


class _Counts:
    """Counts of pairs, from one broadcast of cells after the other."""

    def __init__(self, groups: list) -> None:
        self.groups = groups

    def of(self, pairs: np.ndarray) -> np.ndarray:
        out, cells = np.full(len(pairs), -1, np.int64), cell_of(pairs)
        for held in self.groups:
            for cell, hashed, keys, counts in held.value:
                own = np.flatnonzero(cells == cell)
                keys = np.frombuffer(keys, np.int64)
                at = PerfectHash.load(hashed).index(pairs[own])
                if (at < 0).any() or (keys[at] != pairs[own]).any():
                    raise RuntimeError("a pair is missing from the table of pairs")
                out[own] = np.frombuffer(counts, np.int64)[at]
            if len(self.groups) > 1:
                held.__dict__.pop("_value", None)  # read again from the executor's copy when it is next needed
        return out


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(paths: tuple[str, str], block_bytes: int, groups: list, best, whole: bool):
    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(groups)
        for block in blocks(batches, block_bytes):
            x = Aligned(_tokenizers(paths), block.segments, written=True)
            kept = block.whole(x.good)
            used = np.bincount(block.numbers[np.repeat(kept, block.counts)], minlength=len(block.segments)) > 0
            asked = np.repeat(used, x.n_links)
            pairs, place = np.unique(x.pairs[asked], return_inverse=True)
            n = np.zeros(len(x.pairs), np.int64)
            top = np.zeros(len(x.pairs), np.int64)
            found = counts.of(pairs)
            n[asked] = found[place]
            top[asked] = (found == best.value[pairs & 0xFFFFFFFF])[place]
            columns = [block.sums(v) * kept for v in (x.n_a, x.n_b, x.n_groups, x.n_links, _sums(top, x.n_links), _sums(n, x.n_links))]
            stops = np.cumsum(block.counts).tolist()
            numbers = block.numbers.tolist()
            written = [b";".join(map(x.written.__getitem__, numbers[a:b])) if ok else None for a, b, ok in zip([0, *stops], stops, kept.tolist(), strict=False)]
            digest = ["" if w is None else hashlib.sha256(w).hexdigest() for w in written]
            arrays = [block.ids, *map(pa.array, columns), pa.array(digest, pa.string())] + ([pa.array([(w or b"").decode() for w in written], pa.string())] if whole else [])
            out = pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in (_RESULT + ", groups string" * whole).split(", ")])
            yield from (out.slice(k, 4096) for k in range(0, out.num_rows, 4096))

    return look


def align_documents(docs: DataFrame, paths: tuple[str, str] | None = None, whole: bool = False, block_bytes: int = BLOCK_BYTES, table_pairs: int = TABLE_PAIRS, table: DataFrame | None = None) -> DataFrame:
    """doc_id, token, group and link counts of every document, the links that are best for their B id, the sum of the
    links' corpus counts, and the digest of the groups; whole adds the groups themselves as text.

    A is a byte-level BPE file of the tokenizers library and takes a space and the text; B is a sentencepiece model that
    adds the space itself. Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have no
    tokens: zeros and an empty digest. Repeated rows and ids are counted and returned each; null ids stay null. Texts of any
    length are whole. An empty table gives no rows. Other columns are ignored. Files at a path must be at the same place on
    every executor; a bare name is one given to addFile. table is a pair_table() of a larger corpus that holds these docs.
    """
    paths = paths or default_paths()
    sc = docs.sparkSession.sparkContext
    own = table is None
    table = pair_table(docs, paths, block_bytes) if own else table
    best = np.zeros(1 + (1 << 16), np.int64)
    for r in pair_counts(table).groupBy("b_id").agg(F.max("n").alias("n")).toLocalIterator():  # a row for each piece of B at most
        if r.b_id >= len(best):
            best = np.concatenate([best, np.zeros(r.b_id, np.int64)])
        best[r.b_id] = r.n
    groups, held = [[]], 0
    for r in table.select("cell", (F.octet_length("keys") / 8).cast("long").alias("n")).orderBy("cell").collect():  # CELLS rows at most
        if held and held + r.n > table_pairs:
            groups, held = [*groups, []], 0
        groups[-1].append(r.cell)
        held += r.n
    sent = [sc.broadcast([(r.cell, bytes(r.hash), bytes(r["keys"]), bytes(r.counts)) for r in table.where(F.col("cell").isin(g)).collect()]) for g in groups if g]
    if own:
        release(table)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_look_up(paths, block_bytes, sent, sc.broadcast(best), whole), _RESULT + ", groups string" * whole)
