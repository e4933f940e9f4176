"""Removal of byte strings that an earlier document has too, over a sparse suffix array with deep-shallow sorting.

Every window of WINDOW bytes owns one anchor: the start of the least GRAM-byte string in it by hash, the leftmost of equals.
Equal windows have equal anchors at equal offsets, so only suffixes that start at anchors are sorted, and only those whose
GRAM bytes occur in two documents.

1. Documents are cut into blocks, which keep the places of their anchors. A block asks, for the hashes of its anchors, which of them other documents have too; it
   sends sorted differences to buckets by hash range and gets a bit for each.
2. For each distinct context of a shared anchor it asks which is the least document with that context, and for each shared
   anchor how many contexts there are. Documents greater than the least one of their context lose all its windows.
3. The contexts of one anchor string are the suffixes to sort, each once: multikey quicksort on eight-byte characters to a
   shallow depth, then a blind trie for each group that is still equal. Common prefixes of neighbours and hashes of what
   stands before the anchor tell which windows a lesser document has. An anchor string with very many contexts is not
   sorted in one task: its blocks ask for the least document of each of its windows instead, with the same result.
4. The blocks remove what the answers cover.

Blocks hold many documents each, and a bucket hears of a hash once a block, so no key gathers more than a word per block.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, tasks_for, text_of
from flowkit.operators.components import release

#: Bytes of a window, of an anchor string; starts of anchor strings in a window.
WINDOW, GRAM = 50, 20
STARTS = WINDOW - GRAM + 1
#: Bytes of text in a block, for a bucket of anchor hashes, and worked on at once; contexts of one anchor sorted in a task.
BLOCK_BYTES, BUCKET_BYTES, RUN_BYTES, GROUP_LIMIT = 8 << 20, 8 << 20, 1 << 18, 20_000
#: Characters (of eight bytes) behind the anchor string up to which multikey quicksort goes.
SHALLOW = 2
_LAST = (1 << 63) - 1
_KEY_BITS = 40
_U = np.uint64
_MIX1, _MIX2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MIX1
    x = (x ^ (x >> _U(27))) * _MIX2
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For bytes of documents [start, end): the starts of their windows, each window's anchor, and the anchor strings' hashes by place."""
    n = len(raw)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # hashes of all GRAM-byte strings, from those of 1, 4 (=1+1+1+1), 16 and 20 bytes
    h = _BYTE[raw]
    one = h
    step = lambda a, b, k: a[: len(b) - k] * _U(pow(_BASE, k, 1 << 64)) + b[k:]
    h2 = step(one, one, 1)
    h4 = step(h2, h2, 2)
    h8 = step(h4, h4, 4)
    h16 = step(h8, h8, 8)
    h20 = h16[: n - GRAM + 1] * _U(pow(_BASE, 4, 1 << 64)) + h4[16 : n - GRAM + 17]
    h20 = _mix(h20)
    v = (h20 & ~_U((1 << 28) - 1)) | np.arange(len(h20), dtype=np.uint64)
    m = v
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    m = np.minimum(m[: len(v) - STARTS + 1], m[STARTS - 16 : len(v) - STARTS + 1 + STARTS - 16])
    inside = np.zeros(n + 1, np.int8)
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        if b - a >= WINDOW:
            inside[a : b - WINDOW + 1] = 1
    windows = np.flatnonzero(inside[: len(m)])
    return windows, (m[windows] & _U((1 << 28) - 1)).astype(np.int64), h20


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _short(h: np.ndarray) -> np.ndarray:
    """The bits of an anchor string's hash that tell whether it may be shared."""
    return (h >> _U(64 - _KEY_BITS)).astype(np.int64)


def anchor_places(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of the anchors of documents [start, end), in order; long documents go piece by piece."""
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(raw) - WINDOW + 1, RUN_BYTES):
        piece = raw[a : a + RUN_BYTES + WINDOW - 1]
        x, y = np.searchsorted(ends, a, side="right"), np.searchsorted(starts, a + len(piece))
        owner = anchors(piece, np.maximum(starts[x:y] - a, 0), np.minimum(ends[x:y] - a, len(piece)))[1]
        new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, bool)  # a later window's anchor is no earlier
        found.append(owner[new] + a)
    return np.unique(np.concatenate(found))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a piece with the contexts at its edges."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.ones(1, np.uint64)
        while len(x) < RUN_BYTES + 2 * WINDOW:
            x = np.concatenate([x, x * _U(pow(base, len(x), 1 << 64))])
        out.append(x[: RUN_BYTES + 2 * WINDOW])
    return tuple(out)


class _Run:
    """A few documents of a block as one array of bytes: places, hashes, contexts' hashes and documents of their anchors, and
    the windows each anchor owns, first to last. Owners follow from the hashes of neighbours: the lesser one keeps a window
    as long as both are in it."""

    def __init__(self, ids: list[int], texts: list[bytes], places: np.ndarray | None = None) -> None:
        self.ids = np.array(ids, np.int64)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], np.int64)
        self.places = anchor_places(self.raw, self.starts, self.ends) if places is None else places
        self.doc = np.searchsorted(self.ends, self.places, side="right").astype(np.int32)
        p, start, end = self.places, self.starts[self.doc], self.ends[self.doc]
        self.left, self.right = np.minimum(p - start, WINDOW - GRAM).astype(np.uint8), np.minimum(end - p, WINDOW).astype(np.uint8)
        self.keys, self.context_ids = self._hashes()
        new = np.append(True, self.doc[1:] != self.doc[:-1]) if len(p) else np.zeros(0, bool)
        rank = self.keys >> _U(28)
        stays = np.append(False, rank[:-1] <= rank[1:]) if len(p) else new
        self.first = np.where(new, start, np.where(stays, np.append(0, p[:-1]) + 1, p - (STARTS - 1))) if len(p) else p
        self.last = np.where(np.append(new[1:], True), end - WINDOW, np.append(self.first[1:], 0) - 1) if len(p) else p

    def _hashes(self) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers()
        keys, contexts = np.zeros(len(self.places), np.uint64), np.zeros(len(self.places), np.uint64)
        for a in range(0, len(self.raw), RUN_BYTES):
            x, y = np.searchsorted(self.places, [a, a + RUN_BYTES]).tolist()
            if x == y:
                continue
            low = max(a - WINDOW, 0)
            piece = self.raw[low : a + RUN_BYTES + WINDOW]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE[piece] * inverse[: len(piece)], out=sums[1:])
            p = self.places[x:y] - low
            begin, stop = p - self.left[x:y], p + self.right[x:y]
            keys[x:y] = _mix((sums[p + GRAM] - sums[p]) * power[p + GRAM - 1])
            shape = _mix(self.left[x:y].astype(np.uint64) * _U(256) + self.right[x:y])
            contexts[x:y] = _mix((sums[stop] - sums[begin]) * power[stop - 1] ^ shape)
        return keys, contexts

    def contexts(self, at: np.ndarray) -> np.ndarray:
        """Of the anchors at these indices of places: lengths to the left and right, and bytes, the left ones backwards first."""
        p, left, right = self.places[at], self.left[at], self.right[at]
        width = WINDOW - GRAM
        padded = np.concatenate([np.zeros(width, np.uint8), self.raw, np.zeros(WINDOW, np.uint8)])
        view = np.lib.stride_tricks.sliding_window_view(padded, width + WINDOW)[p]
        lefts = view[:, :width][:, ::-1] * (np.arange(width) < left[:, None])
        rights = view[:, width:] * (np.arange(WINDOW) < right[:, None])
        return np.concatenate([left[:, None], right[:, None], lefts, rights], axis=1)

    def covered(self, mask: np.ndarray) -> np.ndarray:
        """Which bytes are in a window that goes; bit o of an anchor's mask tells that its window o bytes before it goes."""
        out = np.zeros(len(self.raw) + 1, np.int32)
        whole = mask == (1 << STARTS) - 1
        out[self.first[whole]] += 1
        out[self.last[whole] + WINDOW] -= 1
        some = np.flatnonzero((mask != 0) & ~whole)
        n = self.last[some] - self.first[some] + 1
        own = np.repeat(some, n)
        window = self.first[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        window = window[(mask[own] >> (self.places[own] - window) & 1).astype(bool)]
        out[window] += 1
        out[window + WINDOW] -= 1
        return np.cumsum(out[:-1], dtype=np.int32) > 0


def _runs(row: dict) -> Iterator[_Run]:
    """A block's documents, with the places of anchors that the block knows."""
    raw = zstandard.ZstdDecompressor().decompress(row["data"])
    places = np.cumsum(_unpack(row["places"]))
    ends = np.cumsum(row["sizes"]).tolist()
    texts: list[bytes] = []
    base = 0
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
        texts.append(raw[a:b])
        if b - base > RUN_BYTES or k + 1 == len(ends):
            x, y = np.searchsorted(places, [base, b])
            yield _Run(row["ids"][k + 1 - len(texts) : k + 1], texts, places[x:y] - base)
            texts, base = [], b


_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("places", pa.binary())])
_BLOCK_SQL = "block long, ids array<long>, sizes array<long>, data binary, places binary"


def _cut(block_bytes: int):
    def row(block: int, ids: list, texts: list[bytes]) -> pa.RecordBatch:
        raw = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts]).astype(np.int64)
        sizes = np.diff(ends, prepend=0)
        places = _pack(np.diff(anchor_places(np.frombuffer(raw, np.uint8), ends - sizes, ends), prepend=0))
        row = {"block": block, "ids": ids, "sizes": sizes.tolist(), "data": zstandard.ZstdCompressor(level=5).compress(raw), "places": places}
        return pa.RecordBatch.from_pylist([row], schema=_BLOCK)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(doc_id)
                    texts.append(text.encode())
                    size += len(texts[-1])
                    if size > block_bytes:
                        yield row(block, ids, texts)
                        block += 1
                        ids, texts, size = [], [], 0
        if ids:
            yield row(block, ids, texts)
        pa.default_memory_pool().release_unused()  # the worker lives on, and needs less from here

    return cut


# --- questions and answers. A question is (block, kind, bucket, data): hashes with an integer each, sorted by hash. Its
# answer, in the same order and with the same block, kind and bucket, is an integer for each hash.

_ASK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())])
_ASK_SQL = "block long, kind int, bucket int, data binary"
#: SHARED: two documents or blocks have the anchor string. LEAST: the least document. COUNT: the sum over blocks.
_SHARED, _LEAST, _COUNT, _WINDOW, _BITS = range(5)


def _questions(block: int, kind: int, hashes: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for sorted hashes below 2**_KEY_BITS or 2**62 (by kind)."""
    top = _bound(kind)
    cuts = np.searchsorted(hashes, np.array([-(-(b * top) // buckets) for b in range(buckets + 1)], np.int64))
    return [(block, kind, b, _pack(np.concatenate([np.diff(hashes[x:y], prepend=0), values[x:y]]))) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if y > x]


def _bound(kind: int) -> int:
    return 1 << (_KEY_BITS if kind in (_SHARED, _COUNT) else _ENTRY_BITS)


def _asked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = _unpack(data)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _answer(table: pa.Table) -> pa.Table:
    """All questions of one kind and bucket."""
    kind = table.column("kind")[0].as_py()
    asked = [_asked(x) for x in table.column("data").to_pylist()]
    every, at = np.unique(np.concatenate([h for h, _ in asked]), return_inverse=True)
    values = np.concatenate([v for _, v in asked])
    if kind in (_LEAST, _WINDOW):
        found = np.full(len(every), _LAST)
        np.minimum.at(found, at, values)
    else:
        found = np.zeros(len(every), np.int64)
        np.add.at(found, at, values)
        if kind == _SHARED:
            found = (found > 1).astype(np.int64)
    out = np.split(found[at], np.cumsum([len(h) for h, _ in asked])[:-1])
    return table.select(["block", "kind", "bucket"]).append_column("data", pa.array([_pack(x) for x in out], pa.binary()))


def _batch(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 4, _ASK, strict=True)], schema=_ASK)


def _answers(table: pa.Table, kind: int) -> np.ndarray:
    """The answers of one kind to one block, in the order of its sorted hashes."""
    rows = [(r["bucket"], r["data"]) for r in table.select(["kind", "bucket", "data"]).to_pylist() if r["kind"] == kind]
    return np.concatenate([_unpack(d) for _, d in sorted(rows)]) if rows else np.zeros(0, np.int64)


def _anchor_hashes(runs: Iterable[_Run]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted anchor hashes of a block and the number of its documents (2 at most) that have each."""
    keys = []
    for run in runs:
        k = _short(run.keys)
        order = np.argsort(k, kind="stable")  # documents are in order already
        k, d = k[order], run.doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        keys.append(k[new])
    k, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return k, np.minimum(n, 2)


_ENTRY_BITS = 60


def _entry(key: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """One number for a context of an anchor string."""
    return (_mix(key ^ (cid * _MIX2)) >> _U(64 - _ENTRY_BITS)).astype(np.int64)


class _Held:
    """The contexts of a block's shared anchors: for each run the anchors, the places of their entries and their documents;
    and the distinct entries of the block in order, with their least document."""

    def __init__(self, row: dict, answers: pa.Table) -> None:
        runs = list(_runs(row))
        none = [np.zeros(0, np.int64)]
        _, at = np.unique(np.concatenate(none + [_short(r.keys) for r in runs]), return_inverse=True)
        shared = (_answers(answers, _SHARED) > 0)[at] if len(at) else np.zeros(0, bool)
        cuts = np.cumsum([len(r.places) for r in runs])[:-1]
        own = [np.flatnonzero(x) for x in np.split(shared, cuts)]
        e = np.concatenate(none + [_entry(r.keys[x], r.context_ids[x]) for r, x in zip(runs, own, strict=True)])
        d = np.concatenate(none + [r.ids[r.doc[x]] for r, x in zip(runs, own, strict=True)])
        k = np.concatenate(none + [_short(r.keys[x]) for r, x in zip(runs, own, strict=True)])
        order = np.lexsort((d, e))
        new = np.append(True, e[order][1:] != e[order][:-1]) if len(e) else np.zeros(0, bool)
        self.entries, self.least, self.keys = e[order][new], d[order][new], k[order][new]
        place = np.empty(len(e), np.int64)
        place[order] = np.cumsum(new) - 1
        cuts = np.cumsum([len(x) for x in own])[:-1]
        self.runs = list(zip(runs, own, np.split(place, cuts), np.split(d, cuts), strict=True))


def _ask_anchors(buckets: int):
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from _batch(_questions(row["block"], _SHARED, *_anchor_hashes(_runs(row)), buckets)).to_batches(256)

    return ask


def _ask_contexts(buckets: int):
    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for row in blocks.to_pylist():
            held = _Held(row, answers)
            rows += _questions(row["block"], _LEAST, held.entries, held.least, buckets)
            rows += _questions(row["block"], _COUNT, *np.unique(held.keys, return_counts=True), buckets)
        return _batch(rows)

    return ask


_OPEN = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("key", pa.int64()), ("entry", pa.int64()), ("doc", pa.int64()), ("context", pa.binary())])
_OPEN_SQL = "block long, kind int, bucket int, data binary, key long, entry long, doc long, context binary"


def _windows_of(row: np.ndarray) -> dict[int, int]:
    """Offset to hash of each window in a context."""
    left, right, side = int(row[0]), int(row[1]), WINDOW - GRAM
    out = {}
    for o in range(STARTS):
        if left >= o and right >= WINDOW - o:
            w = row[2 : 2 + o][::-1].tobytes() + row[2 + side : 2 + side + WINDOW - o].tobytes()
            out[o] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "big") >> (64 - _ENTRY_BITS)
    return out


def _open_contexts(held: _Held, answers: pa.Table, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """What is still open in a block: contexts of anchors with several of them, whose least document is here. Arrays of
    keys, places of entries, documents and contexts, and whether they are of anchors with more contexts than limit."""
    least, counts = _answers(answers, _LEAST), _answers(answers, _COUNT)
    keys = np.unique(held.keys)
    n = counts[np.searchsorted(keys, held.keys)] if len(keys) else counts
    todo = (held.least == least) & (n > 1)
    for run, at, place, d in held.runs:
        own = np.flatnonzero(todo[place] & (d == held.least[place]))
        own = own[np.unique(place[own], return_index=True)[1]]
        todo[place[own]] = False
        large = n[place[own]] > limit
        for some, many in ((own[~large], False), (own[large], True)):
            if len(some):
                yield run.keys[at[some]].view(np.int64), place[some], d[some], run.contexts(at[some]), many


def _ask_open(buckets: int, limit: int):
    def ask(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in blocks.to_pylist():
            held = _Held(row, answers)
            windows: dict[int, int] = {}
            for key, place, d, contexts, many in _open_contexts(held, answers, limit):
                if many:
                    for doc, context in zip(d.tolist(), contexts, strict=True):
                        for h in _windows_of(context).values():
                            windows[h] = min(doc, windows.get(h, doc))
                    continue
                n = len(key)
                offsets = np.arange(n + 1, dtype=np.int32) * contexts.shape[1]
                flat = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(contexts.tobytes())])
                columns = [np.full(n, row["block"]), np.full(n, _BITS, np.int32), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), key, held.entries[place], d, flat]
                tables.append(pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_OPEN))
            asked = _questions(row["block"], _WINDOW, np.array(sorted(windows), np.int64), np.array([windows[h] for h in sorted(windows)], np.int64), buckets)
            if asked:
                t = _batch(asked)
                tables.append(pa.Table.from_arrays([*t.columns, *(pa.nulls(len(t), f.type) for f in list(_OPEN)[4:])], schema=_OPEN))
        return pa.concat_tables(tables) if tables else _OPEN.empty_table()

    return ask


def multikey_quicksort(words: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of eight-byte characters inside their groups (group is non-decreasing): the order, and for each place of it
    a number that equal rows share. All groups take a partitioning step together: less than, equal to, greater than the pivot.
    """
    order = np.arange(len(group))
    label = np.unique(group, return_inverse=True)[1] if len(group) else group  # equal so far
    for level in range(words.shape[1]):
        segment = label.copy()  # still to be partitioned at this level
        active = np.ones(len(order), bool)
        while True:
            first = np.ones(len(order), bool)
            first[1:] = segment[1:] != segment[:-1]
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(order)))
            todo = active & np.repeat(sizes > 1, sizes)
            if not todo.any():
                break
            middle = np.repeat(starts + sizes // 2, sizes)[todo]
            own, pivot = words[order[todo], level], words[order[middle], level]
            side = (own > pivot).astype(np.int64) - (own < pivot) + 1
            at = np.flatnonzero(todo)
            turn = np.argsort(segment[todo] * 3 + side, kind="stable")
            order[at] = order[todo][turn]
            side = side[turn]
            split = segment * 3 + 1
            split[at] = segment[at] * 3 + side
            active[at[side == 1]] = False
            active &= todo
            segment = np.cumsum(np.append(True, split[1:] != split[:-1])) - 1
        label = segment
    return order, label


class BlindTrie:
    """Patricia trie over strings of one length: nodes know the byte that tells their children apart, leaves hold members.

    A search looks at those bytes alone and ends at some leaf; one comparison with it finds the place to insert.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # [byte place, {byte: node}] or [None, string, members]

    def add(self, s: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = [None, s, [member]]
            return
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = node[1]
        if t == s:
            node[2].append(member)
            return
        at = next(k for k, (x, y) in enumerate(zip(s, t, strict=True)) if x != y)
        parent, node = None, self.root
        while node[0] is not None and node[0] < at:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == at:
            node[1][s[at]] = [None, s, [member]]
            return
        new = [at, {s[at]: [None, s, [member]], t[at]: node}]
        if parent is None:
            self.root = new
        else:
            parent[1][s[parent[0]]] = new

    def members(self) -> Iterator[int]:
        """In the order of their strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield from node[2]
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))


def deep_shallow(group: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """The order that sorts the suffixes (rows of bytes) inside their groups, which are contiguous."""
    characters = suffixes[:, : 8 * SHALLOW]
    words = np.ascontiguousarray(characters).view(">u8").astype(np.uint64)
    order, label = multikey_quicksort(words, group)
    first = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    sizes = np.diff(np.append(first, len(label)))
    rest = np.ascontiguousarray(suffixes[:, 8 * SHALLOW :])
    width = rest.shape[1]
    for a, n in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own = order[a : a + n]
        flat = rest[own].tobytes()
        if n == 2:
            if flat[:width] > flat[width:]:
                order[a : a + 2] = own[::-1]
            continue
        trie = BlindTrie()
        for k, m in enumerate(own.tolist()):
            trie.add(flat[k * width : (k + 1) * width], m)
        order[a : a + n] = list(trie.members())
    return order


def covered_offsets(key: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For contexts of anchors (key non-decreasing): bit o is set if the window that starts o bytes before the anchor is
    also in the context of a lesser document."""
    left, right = context[:, 0].astype(np.int64), context[:, 1].astype(np.int64)
    lefts, rights = context[:, 2 : 2 + WINDOW - GRAM], context[:, 2 + WINDOW - GRAM :]
    order = deep_shallow(key, rights[:, GRAM:])
    s = rights[order]
    same = np.full(len(order), 0)
    if len(order) > 1:
        differ = s[1:] != s[:-1]
        same[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WINDOW)
        same[1:][key[order][1:] != key[order][:-1]] = 0
    left, right, lefts, doc = left[order], right[order], lefts[order], doc[order]
    bits = np.zeros(len(order), np.int64)
    before = np.zeros(len(order), np.uint64)
    for o in range(STARTS):
        if o:
            before = _mix(before + _BYTE[lefts[:, o - 1]])
        group = np.cumsum(same < WINDOW - o)
        fits = np.flatnonzero((left >= o) & (right >= WINDOW - o))
        if len(fits) < 2:
            continue
        g = _mix(before[fits] ^ (group[fits].astype(np.uint64) * _U(_BASE)))
        turn = np.lexsort((doc[fits], g))
        new = np.append(True, g[turn][1:] != g[turn][:-1])
        least = doc[fits][turn][np.flatnonzero(new)][np.cumsum(new) - 1]
        bits[fits[turn]] |= (doc[fits][turn] > least).astype(np.int64) << o
    out = np.zeros(len(order), np.int64)
    out[order] = bits
    return out


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, bucket and key: questions about windows, bucket by bucket, and contexts, key by key. Gives
    answers for the blocks: those to windows, and (entry, bits) of contexts."""
    width = 2 + WINDOW - GRAM + WINDOW

    def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        for kind in (_WINDOW, _BITS):
            own = t.filter(pa.compute.equal(t.column("kind"), kind))
            if not len(own):
                continue
            if kind == _WINDOW:
                bucket = own.column("bucket").to_numpy()
                for b in np.unique(bucket):
                    yield from _answer(own.select(["block", "kind", "bucket", "data"]).filter(pa.array(bucket == b))).to_batches()
                continue
            key = own.column("key").to_numpy()
            context = np.frombuffer(b"".join(own.column("context").to_pylist()), np.uint8).reshape(-1, width)
            bits = covered_offsets(key, context, own.column("doc").to_numpy())
            hit = np.flatnonzero(bits)
            block, entry = own.column("block").to_numpy()[hit], own.column("entry").to_numpy()[hit]
            order = np.argsort(block, kind="stable")
            block, entry, bits = block[order], entry[order], bits[hit][order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else []
            rows = [(int(block[a]), _BITS, 0, _pack(np.concatenate([entry[a:z], bits[a:z]]))) for a, z in zip(first, [*first[1:], len(block)], strict=True)]
            yield from _batch(rows).to_batches()

    held: list[pa.RecordBatch] = []
    n = 0

    def label(b: pa.RecordBatch, k: int) -> tuple:
        return tuple(b.column(c)[k].as_py() for c in ("kind", "bucket", "key"))

    for b in batches:
        if not b.num_rows:
            continue
        if n > GROUP_LIMIT:
            last, cut = label(held[-1], held[-1].num_rows - 1), 0
            while cut < b.num_rows and label(b, cut) == last:
                cut += 1
            if cut < b.num_rows:
                yield from solved([*held, b.slice(0, cut)])
                held, n, b = [], 0, b.slice(cut)
        held.append(b)
        n += b.num_rows
    if held:
        yield from solved(held)


def _finish(limit: int, whole: bool):
    def finish(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        """One block: documents without the bytes that lesser ones have."""
        out: dict[str, list] = {x: [] for x in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")} | ({"kept": []} if whole else {})
        every = (1 << STARTS) - 1
        for row in blocks.to_pylist():
            held = _Held(row, answers)
            least = _answers(answers, _LEAST)
            bits = np.zeros(len(held.entries), np.int64)
            for r in answers.filter(pa.compute.equal(answers.column("kind"), _BITS)).column("data").to_pylist():
                entry, found = np.split(_unpack(r), 2)
                bits[np.searchsorted(held.entries, entry)] = found
            many = [(place, d, [_windows_of(c) for c in contexts]) for _, place, d, contexts, large in _open_contexts(held, answers, limit) if large]
            asked = sorted({h for _, _, x in many for w in x for h in w.values()})
            known = dict(zip(asked, _answers(answers, _WINDOW).tolist(), strict=True))
            for place, d, x in many:
                bits[place] = [sum(1 << o for o, h in w.items() if known[h] < doc) for doc, w in zip(d.tolist(), x, strict=True)]
            for run, at, place, d in held.runs:
                raw = run.raw
                mask = np.zeros(len(run.places), np.int64)
                mask[at] = np.where(d > least[place], every, bits[place])
                gone = run.covered(mask)
                total = np.append(0, np.cumsum(gone))
                for doc, a, b in zip(run.ids.tolist(), run.starts.tolist(), run.ends.tolist(), strict=True):
                    lost = gone[a:b]
                    n = int(total[b] - total[a])
                    kept = raw[a:b][~lost].tobytes() if n else raw[a:b].tobytes()
                    out["doc_id"].append(doc if doc != _LAST else None)
                    out["n_bytes"].append(b - a)
                    out["n_removed"].append(n)
                    out["n_spans"].append(int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum()) if n else 0)
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if whole:
                        out["kept"].append(kept)
        types = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.table({x: pa.array(v, types.get(x, pa.int64())) for x, v in out.items()})

    return finish


def remove_repeats(docs: DataFrame, whole: bool = False, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; whole adds the kept bytes themselves.

    Every byte goes that is in a 50-byte string which also starts in a document with a lesser doc_id. Null texts count as
    empty. A null doc_id is greater than all others; rows that repeat a doc_id don't take from each other. Texts shorter
    than 50 bytes stay whole. Other columns are ignored.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), text_of().alias("text"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = tasks_for(size, bucket_bytes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpoint(docs.mapInArrow(_cut(block_bytes), _BLOCK_SQL))  # block numbers must not change
    blocks = cut.repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)  # each step goes over them

    def answered(questions: DataFrame) -> DataFrame:
        return questions.groupBy("kind", "bucket").applyInArrow(_answer, _ASK_SQL)

    def ask(how, known: DataFrame, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(how, schema)

    first = checkpoint(answered(blocks.mapInArrow(_ask_anchors(buckets), _ASK_SQL)))
    second = checkpoint(first.unionByName(answered(ask(_ask_contexts(buckets), first, _ASK_SQL))))
    release(first)
    left = ask(_ask_open(buckets, group_limit), second, _OPEN_SQL)
    left = left.repartition("kind", "bucket", "key").sortWithinPartitions("kind", "bucket", "key")
    known = second.unionByName(left.mapInArrow(_solve, _ASK_SQL))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole
    out = ask(_finish(group_limit, whole), known, schema)
    if not whole:  # small rows: with them kept, the blocks can go
        out = checkpoint(out)
        blocks.unpersist()
        release(cut, second)
    return out
