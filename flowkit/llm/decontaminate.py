"""Benchmark decontamination with generalised suffix automata of the test items.

Items are normalised to words and dealt to blocks of about BLOCK_WORDS words; a task builds the automaton of a block. An
item longer than a block is cut into pieces that overlap by a window less one word, so that no window is lost and every
block is bounded. Documents stay where they are: each task streams their words through one block's automaton after the
other and keeps, at every word, the state of the longest match that ends there. A match of a window or more, or of a
whole short item, marks its words. Words that no item holds lead back to the root, so only runs of known words that could
hold a window are walked.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, tasks_for, text_of

WINDOW, BLOCK_WORDS = 10, 1 << 17
#: Bytes to words: capitals are lowered, digits and bytes of other alphabets stay, all else parts words.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


class Automaton:
    """All substrings of some word sequences. Shorter sequences than a window count as a whole."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set] = {}  # of the window that ends in a state
        self.short: dict[int, dict[int, set]] = {}  # short items that end in a state, by length
        self.least = window

    @classmethod
    def of(cls, sequences: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> Automaton:
        x = cls(window)
        sequences = [(item, [x.number.setdefault(w, len(x.number)) for w in words]) for item, words in sequences if words]
        for _, words in sequences:
            last = 0
            for w in words:
                last = x._extend(last, w)
        for item, words in sequences:
            state = 0
            for k, w in enumerate(words):
                state = x.next[state][w]
                size = min(window, len(words))
                if k + 1 >= size:
                    while x.length[x.link[state]] >= size:
                        state = x.link[state]
                    own = x.items.setdefault(state, set()) if size == window else x.short.setdefault(state, {}).setdefault(size, set())
                    own.update(() if item is None else (item,))
            x.least = min(x.least, len(words))
        x._shortcuts()
        return x

    def _extend(self, last: int, w: int) -> int:
        """The state of the sequence so far with w behind it."""
        known = self.next[last].get(w)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is None:
            new = self._state({}, self.length[last] + 1)
            while last >= 0 and w not in self.next[last]:
                self.next[last][w] = new
                last = self.link[last]
            self.link[new] = 0 if last < 0 else self._exact(last, w)
            return new
        return self._exact(last, w)

    def _state(self, to: dict[int, int], length: int) -> int:
        self.next.append(to)
        self.link.append(-1)
        self.length.append(length)
        return len(self.link) - 1

    def _exact(self, p: int, w: int) -> int:
        """The state that p's longest string with w ends in as its longest: its own, or one split off for it."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        split = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[split], self.link[q] = self.link[q], split
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = split
            p = self.link[p]
        return split

    def _shortcuts(self) -> None:
        """For each state: the one that holds its suffix of a window, and the nearest at or above it where short items end."""
        self.at_window, self.at_short = [-1] * len(self.link), [-1] * len(self.link)
        for s in np.argsort(self.length, kind="stable").tolist()[1:]:
            above = self.link[s]
            if self.length[s] >= self.window:
                self.at_window[s] = s if self.length[above] < self.window else self.at_window[above]
            self.at_short[s] = s if s in self.short else self.at_short[above]

    def find(self, words: list[bytes], hit: np.ndarray, items: set) -> int:
        """Mark in hit the words of document inside windows, add the items to items; the longest match that held one."""
        ids = np.fromiter(map(self.number.get, words, itertools.repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        first, after = edges[::2], edges[1::2]
        long = after - first >= self.least
        longest, states = 0, set()
        for a, b in zip(first[long].tolist(), after[long].tolist(), strict=True):
            state, size, marked = 0, 0, a
            for k, w in enumerate(ids[a:b].tolist(), a + 1):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                state, size = self.next[state][w], size + 1
                if size >= self.window:
                    states.add(self.at_window[state])
                    hit[max(marked, k - self.window) : k] = True
                    marked, longest = k, max(longest, size)
                at = self.at_short[state]
                while at > 0:
                    for n, own in self.short[at].items():
                        if n <= size:
                            items.update(own)
                            hit[k - n : k] = True
                            longest = max(longest, n)
                    at = self.at_short[self.link[at]]
        for s in states:
            items.update(self.items[s])
        return longest


def _pieces(window: int, block_words: int):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                step = max(block_words, window) - window + 1
                for k in range(0, max(1, len(words) - window + 1), step):
                    part = words[k : k + step + window - 1]
                    rows.append((item, b" ".join(part), len(part)))
            items, parts, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64())], names=["item", "words", "n"])

    return cut


def build_automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """block and automaton, a pickled Automaton over about block_words words of items. The rows are checkpointed."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), text_of().alias("text"))
    pieces = checkpoint(items.mapInArrow(_pieces(window, block_words), "item string, words binary, n long"))
    blocks = tasks_for(pieces.agg(F.sum("n").alias("n")).first()["n"] or 0, block_words)

    def build(rows: pa.Table) -> pa.Table:
        made = Automaton.of([(i, w.split()) for i, w in zip(rows.column("item").to_pylist(), rows.column("words").to_pylist(), strict=True)], window)
        return pa.table({"block": rows.column("block")[:1], "automaton": pa.array([pickle.dumps(made, protocol=5)], pa.binary())})

    dealt = pieces.where("n > 0").withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int"))
    return checkpoint(dealt.groupBy("block").applyInArrow(build, "block int, automaton binary"))


def _sent(benchmark: DataFrame, window: int, block_words: int) -> list:
    """A broadcast for each block, whose size block_words bounds; the driver holds one at a time."""
    built = build_automata(benchmark, window, block_words)
    return [built.sparkSession.sparkContext.broadcast(bytes(r.automaton)) for r in built.sort("block").toLocalIterator()]


def _parts(b: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch of about as many bytes of text, or of one long text; null texts are empty."""
    texts = pc.fill_null(b.column(column), "").cast(pa.binary())
    start, size = 0, 0
    for k, n in enumerate([*pc.binary_length(texts).to_pylist(), None]):
        if n is None or (size and size + n > most):
            if k > start:
                yield b.slice(start, k - start), texts.slice(start, k - start).to_pylist()
            start, size = k, 0
        size += n or 0


class _Scanner:
    """Texts through the automata; a lone automaton stays, of several the one in use."""

    def __init__(self, sent: list) -> None:
        self.sent, self.lone = sent, pickle.loads(sent[0].value) if len(sent) == 1 else None

    def scan(self, texts: list[bytes]) -> list[list]:
        """For each text: the words, which of them are hit, items and the longest match that holds a window."""
        out = [[w := words_of(t), np.zeros(len(w), bool), set(), 0] for t in texts]
        for block in self.sent:
            automaton = self.lone or pickle.loads(block.value)
            for x in out:
                x[3] = max(x[3], automaton.find(x[0], x[1], x[2]))
            if self.lone is None:
                block.__dict__.pop("_value", None)
        return out


def _runs(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges[::2].tolist(), edges[1::2].tolist()


_FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int64()),
    ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
])


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items, longest and spans of every document.

    A word is hit if it stands in an occurrence of a window: so many consecutive words of an item, or all words of an item
    that has fewer. items are the ids, as sorted strings, of the items with windows in the document; longest is the longest
    match of an item's words that holds a window, spans are the places of the first and last word of each hit run, from 0.

    Null and empty texts have no words; items without words have no windows. Repeated documents give rows each, repeated
    items one id; an item with a null id marks words and isn't listed. Texts and items of any length are whole. Without
    documents there are no rows, without items no hits. Other columns are ignored. What is broadcast is bounded by
    block_words; a larger benchmark takes more blocks, one after the other.
    """
    sent = _sent(benchmark, window, block_words)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(sent)
        for b in batches:
            for part, texts in _parts(b, 1):
                rows = []
                for doc_id, (words, hit, items, longest) in zip(part.column(0).to_pylist(), scanner.scan(texts), strict=True):
                    spans = [{"first": a, "last": e - 1} for a, e in zip(*_runs(hit), strict=True)] if longest else []
                    rows.append((doc_id, len(words), int(hit.sum()) if longest else 0, sorted(items), longest, spans))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FOUND, strict=True)], schema=_FOUND)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(find, "doc_id long, n_words long, n_hit long, items array<string>, longest long, spans array<struct<first:long,last:long>>")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """find_contamination() with a count and a digest of the items, and whether any word is hit."""
    found = find_contamination(docs, benchmark)
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_span: int = WINDOW, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without hit runs of least_span words or more, and without documents of which more than most_coverage is hit.

    A run goes from its first word to its last; what stands around it stays. All columns stay as they are but text. Null and
    empty texts stay. The other cases are those of find_contamination().
    """
    sent, at = _sent(benchmark, window, block_words), docs.columns.index("text")

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _Scanner(sent)
        for b in batches:
            for part, texts in _parts(b, at):
                kept, cleaned = [], part.column(at).to_pylist()
                for k, (words, hit, _, _) in enumerate(scanner.scan(texts)):
                    n = int(hit.sum())
                    kept.append(n <= most_coverage * len(words))
                    if n and kept[-1]:
                        places = [m.span() for m in _WORD.finditer(cleaned[k])]
                        for a, e in reversed(list(zip(*_runs(hit), strict=True))):
                            if e - a >= least_span:
                                cleaned[k] = cleaned[k][: places[a][0]] + cleaned[k][places[e - 1][1] :]
                columns = [*part.columns]
                columns[at] = pa.array(cleaned, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names).filter(pa.array(kept))

    return docs.mapInArrow(clean, docs.schema)


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_STARTS = "unnest(range(1, len(words) - k + 2)) AS i"
ORACLE = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS words FROM benchmark),
cut AS (SELECT item_id, k, words, {_STARTS} FROM (SELECT *, least({WINDOW}, len(words)) AS k FROM items WHERE len(words) > 0)),
windows AS (SELECT DISTINCT item_id, k, array_to_string(words[i : i + k - 1], ' ') AS w FROM cut),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS words FROM documents),
places AS (SELECT r, k, words, {_STARTS} FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(words) >= k),
found AS (SELECT r, k, i, item_id FROM (SELECT r, k, i, array_to_string(words[i : i + k - 1], ' ') AS w FROM places) JOIN windows USING (k, w)),
hit AS (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM found),
counted AS (SELECT r, count(*) AS n FROM hit GROUP BY r),
runs AS (SELECT r, count(*) AS n FROM hit WHERE (r, p - 1) NOT IN (SELECT (r, p) FROM hit) GROUP BY r),
listed AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256, c.n IS NOT NULL AS contaminated,
       coalesce(s.n, 0) AS n_spans
FROM docs LEFT JOIN counted c USING (r) LEFT JOIN listed l USING (r) LEFT JOIN runs s USING (r)
"""
