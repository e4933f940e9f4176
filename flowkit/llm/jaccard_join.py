"""Exact Jaccard join of word n-gram sets by set-relation skipping.

Sets that are equal become one class. The n-grams of a class are ordered from rare to frequent, by a fixed-size sketch of
their counts over all documents, and only a prefix is indexed. An entry of an index list knows its set's size and its
position, and sizes are cut into blocks, so whole blocks and positions that cannot reach the threshold are skipped.

Answers are derived from similar sets: each list's most typical set is compared with the others first. Sets that link to
it share its component and are not compared with each other. For the rest, overlaps with that set bound the overlaps with
one another from both sides; only pairs between components that the bounds leave open are compared.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint, text_of
from flowkit.operators.components import connected_components, release

#: Words of an n-gram; the threshold as numerator and denominator; slots of the count sketch as a power of two, and parts it is sent in.
N, THRESHOLD = 4, (85, 100)
SKETCH_BITS, SKETCH_PARTS = 20, 32
#: Bits of the filter of the texts that are compared, as a power of two.
FILTER_BITS = 26
_RUN_BYTES = 1 << 20
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> np.ndarray:
    """Odd base to the powers 0 .. n-1, modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(_BASE, len(out), 1 << 64))])
    return out[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z in lower case) of all texts, and the number of words of each text."""
    raws = [t.encode() for t in texts]
    flat = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    gap = _GAP[flat]
    edge = np.diff(gap.astype(np.int8), prepend=1)
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power = _powers(len(flat) + 1)
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE[flat] * power[: len(flat)], out=sums[1:])
    # a word's sum times a power that depends on its end alone: the same for equal words
    inverse = pow(_BASE, -1, 1 << 64)
    back = np.ones(1, np.uint64)
    while len(back) < len(flat) + 1:
        back = np.concatenate([back, back * np.uint64(pow(inverse, len(back), 1 << 64))])
    words = _mix((sums[last] - sums[first]) * back[first] + (last - first).astype(np.uint64) * _MIX2)
    ends = np.cumsum([len(r) + 1 for r in raws])
    return words, np.diff(np.searchsorted(first, ends), prepend=0)


def shingle_sets(texts: list[str], n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text with fewer words has its whole sequence as one."""
    words, counts = word_hashes(texts)
    weights = [np.uint64(pow(_BASE, 3 + 2 * k, 1 << 64)) for k in range(n)]
    if len(words) >= n:
        grams = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            grams += words[k : len(words) - n + 1 + k] * weights[k]
        grams = _mix(grams)
    at = 0
    for c in counts:
        if c >= n:
            yield np.unique(grams[at : at + c - n + 1])
        elif c:
            whole = sum(int(w) * int(weights[k]) for k, w in enumerate(words[at : at + c])) + int(c)
            yield _mix(np.array([whole % (1 << 64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += c


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    keys: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for k in range(0, b.num_rows, 256):
            part = b.slice(k, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text)
                size += len(text)
                if size > _RUN_BYTES:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if texts:
        yield keys, texts


def _signature(s: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit hashes of a set."""
    if not len(s):
        return 0, 0
    sums = np.array([s.sum(dtype=np.uint64), _mix(s ^ _MIX2).sum(dtype=np.uint64)]) * _MIX1 + np.uint64(len(s))
    return tuple(sums.view(np.int64).tolist())


_SURVEY = "key long, n long, set1 long, set2 long, part int, counts binary"


def _survey(n: int, bits: int):
    def survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = [x.split()[0] for x in _SURVEY.split(", ")]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for keys, texts in _runs(batches):
            rows = []
            for key, s in zip(keys, shingle_sets(texts, n), strict=True):
                np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
                rows.append((key, len(s), *_signature(s), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        if counts.any():
            parts = [(None, None, None, None, k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(np.split(counts, SKETCH_PARTS))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

    return survey


def _add_up(table: pa.Table) -> pa.Table:
    total = None
    for x in table.column("counts").to_pylist():
        one = np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64)
        total = one if total is None else total + one
    total = np.minimum(total, 2**31 - 1).astype(np.int32)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def required(a: Column, b: Column, threshold: tuple[int, int]) -> Column:
    """The least overlap o that links sets of sizes a and b: o at least the threshold's part of a + b - o."""
    x, y = threshold
    total = x * (a + b) + (x + y - 1)
    return (total - total % (x + y)) / (x + y)


def prefix_length(n: int, threshold: tuple[int, int]) -> int:
    """Members of a set of n that must hold one shared with any linked set."""
    return n - -(-threshold[0] * n // threshold[1]) + 1


def _index(n: int, bits: int, sketch, threshold: tuple[int, int]):
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        seen: set = set()  # equal sets give the same entries: one copy a task is enough
        for _, texts in _runs(batches):
            out: list[list[np.ndarray]] = []
            for s in shingle_sets(texts, n):
                if not len(s) or (sig := _signature(s)) in seen:
                    continue
                seen.add(sig)
                often = counts[(s >> np.uint64(64 - bits)).astype(np.int64)]
                p = prefix_length(len(s), threshold)
                order = np.lexsort((s, often))[:p]
                typical = int(1000 * np.log2(often).mean())
                out.append([s[order].view(np.int64), np.full(p, sig[0]), np.full(p, len(s)), np.arange(p), np.full(p, typical)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["token", "node", "n", "at", "typical"])

    return index


_ENTRY = "token long, node long, n long, at long, typical long"


def _in_lists(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by token and node, those whose token has two nodes at least, each once. Most tokens have one.

    Lists stream by: what is held is the first entry of the last token.
    """
    held: pa.RecordBatch | None = None  # the last entry so far, if its token has no other node yet
    last = (None, None)
    for b in batches:
        if not b.num_rows:
            continue
        token, node = b.column("token").to_numpy(), b.column("node").to_numpy()
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        new[0] = (token[0], node[0]) != last
        if not new.any():
            continue
        b = b.filter(pa.array(new))
        token, node = token[new], node[new]
        same = token[1:] == token[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if last[0] == token[0]:
            keep[0] = True
            if held is not None:
                yield held
            held = None
        last = (token[-1], node[-1])
        alone = not keep[-1]
        if keep.any():
            yield b.filter(pa.array(keep))
        held = b.slice(b.num_rows - 1) if alone else None


def _bits_of(bits: int):
    def bits_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits - 3, np.uint8)
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(seen, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        if seen.any():
            parts = np.split(seen, SKETCH_PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts])], names=["part", "counts"])

    return bits_of


def _either(table: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), np.uint8) for x in table.column("counts").to_pylist()])
    return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _probably_in(keys: DataFrame, bits: int = FILTER_BITS):
    """A predicate on hashed keys that holds for all of these and few others; the filter has 2**bits bits for any input."""
    seen = np.zeros((1 << bits) // 8, np.uint8)
    for r in keys.mapInArrow(_bits_of(bits), "part int, counts binary").groupBy("part").applyInArrow(_either, "part int, counts binary").collect():
        size = len(seen) // SKETCH_PARTS
        seen[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint8)
    shared = keys.sparkSession.sparkContext.broadcast(seen)

    @F.pandas_udf("boolean")
    def holds(key: pd.Series) -> pd.Series:
        at = (key.to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        return pd.Series((shared.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

    return holds


def _overlap(n: int):
    def overlap(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = part.column(2).to_pylist(), part.column(3).to_pylist()
                new = list(dict.fromkeys([*texts[0], *texts[1]]))
                known = dict(zip(new, shingle_sets(new, n), strict=True))
                both = [len(np.intersect1d(known[x], known[y], assume_unique=True)) for x, y in zip(*texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int64())], names=["a", "b", "both"])

    return overlap


def _compare(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """pairs (a, b, na, nb) with both, the size of their intersection, counted on the whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    wanted = checkpoint(wanted)
    some = docs.where(_probably_in(wanted.select("key"))(F.col("key")))  # few texts are in a pair, and only they are shuffled
    texts = some.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("node", "text")
    x = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    # both sides of this join come straight from a shuffle, so that Spark can split a b with many pairs over tasks
    x = x.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    counted = x.select("a", "b", "x", "y").mapInArrow(_overlap(n), "a long, b long, both long")
    out = checkpoint(counted)
    release(wanted)
    return out


def _first() -> Column:
    """Orders rows by doc_id, those without one last, then by key."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")


def _in_components(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """rows (key, doc_id, node, n) and nodes (node, n, key, doc_id, component); a component is one of its nodes.

    A node is a class of equal sets, with its least doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    survey = checkpoint(docs.select("key", "text").mapInArrow(_survey(n, sketch_bits), _SURVEY))
    rows = survey.where(F.col("key").isNotNull()).select("key", F.col("set1").alias("node"), "set2", "n")
    ids = docs.select("key", "doc_id").distinct()
    rows = rows.distinct().join(ids, "key")
    nodes = rows.where(F.col("n") > 0).groupBy("node").agg(F.max("n").alias("n"), F.min(_first()).alias("__least"))
    nodes = nodes.select("node", "n", F.col("__least.key").alias("key"), F.col("__least.doc_id").alias("doc_id"))

    counts = np.zeros(1 << sketch_bits, np.int32)
    parts = survey.where(F.col("part").isNotNull()).select("part", "counts").groupBy("part").applyInArrow(_add_up, "part int, counts binary")
    for r in parts.collect():  # the sketch has 2**sketch_bits counters, whatever the input
        size = len(counts) // SKETCH_PARTS
        counts[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.int32)
    sketch = spark.sparkContext.broadcast(np.maximum(counts, 1))

    entries = docs.select("key", "text").mapInArrow(_index(n, sketch_bits, sketch, threshold), _ENTRY)
    entries = checkpoint(entries.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_in_lists, _ENTRY))
    leads = entries.groupBy("token").agg(F.max(F.struct("typical", "node", "n", "at")).alias("lead"))
    leads = leads.select("token", F.col("lead.node").alias("b"), F.col("lead.n").alias("nb"), F.col("lead.at").alias("atb"))
    shared = checkpoint(entries.join(leads, "token"))

    def open_pair(na: Column, ata: Column, nb: Column, atb: Column) -> Column:
        return F.least(na - ata, nb - atb, na, nb) >= required(na, nb, threshold)

    first = shared.where((F.col("node") != F.col("b")) & open_pair(F.col("n"), F.col("at"), F.col("nb"), F.col("atb")))
    first = checkpoint(first.select(F.col("node").alias("a"), "b", F.col("n").alias("na"), "nb").distinct())
    compared = _compare(first, nodes, docs, n)
    known = first.join(compared, ["a", "b"])
    linked = F.col("both") >= required(F.col("na"), F.col("nb"), threshold)
    links = known.where(linked).select("a", "b")

    groups = checkpoint(connected_components(links))
    lists = shared.join(groups.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))
    torn = lists.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).where(F.col("g") != F.col("h")).select("token")
    lists = lists.join(torn, "token", "left_semi").join(known.select(F.col("a").alias("node"), "b", "both"), ["node", "b"], "left")
    lists = lists.withColumn("both", F.when(F.col("node") == F.col("b"), F.col("n")).otherwise(F.col("both")))
    # two linked sets are in the same size block or in neighbouring ones
    block = F.floor(F.log(F.col("n").cast("double")) / math.log(threshold[1] / threshold[0]))
    lists = checkpoint(lists.distinct().withColumn("block", block))
    x = lists.select("token", "block", F.col("node").alias("a"), F.col("n").alias("na"), F.col("at").alias("ata"), F.col("group").alias("ga"), F.col("both").alias("oa"))
    y = lists.select("token", F.explode(F.array(F.col("block") - 1, "block", F.col("block") + 1)).alias("block"), F.col("node").alias("b"), F.col("n").alias("nb_"), F.col("at").alias("atb_"), F.col("group").alias("gb"), F.col("both").alias("ob"), F.col("nb").alias("lead_n"))
    need = required(F.col("na"), F.col("nb_"), threshold)
    upper = F.least("oa", "ob") + F.least(F.col("na") - F.col("oa"), F.col("nb_") - F.col("ob"))
    pairs = x.join(y, ["token", "block"]).where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & open_pair(F.col("na"), F.col("ata"), F.col("nb_"), F.col("atb_")) & F.coalesce(upper >= need, F.lit(True)))
    pairs = pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb_").alias("nb"), F.max(F.col("oa") + F.col("ob") - F.col("lead_n")).alias("at_least"))
    pairs = checkpoint(pairs.join(known.select("a", "b"), ["a", "b"], "left_anti").join(known.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti"))
    derived = F.coalesce(F.col("at_least") >= required(F.col("na"), F.col("nb"), threshold), F.lit(False))
    rest = pairs.where(~derived)
    more = rest.join(_compare(rest, nodes, docs, n), ["a", "b"]).where(linked).select("a", "b")
    links = pairs.where(derived).select("a", "b").unionByName(more)
    # what the first links connect is one node now
    g = groups.withColumnRenamed("component", "group")
    ends = links.join(g.withColumnRenamed("node", "a"), "a", "left").select(F.coalesce("group", "a").alias("a"), "b")
    ends = ends.join(g.withColumnRenamed("node", "b"), "b", "left").select("a", F.coalesce("group", "b").alias("b"))
    wider = connected_components(ends).select(F.col("node").alias("group"), F.col("component").alias("wider"))
    nodes = nodes.join(g, "node", "left").withColumn("group", F.coalesce("group", "node")).join(wider, "group", "left")
    nodes = checkpoint(nodes.select("node", "n", "key", "doc_id", F.coalesce("wider", "group").alias("component")))
    release(entries, shared, first, compared, groups, lists, pairs)
    return rows, nodes


def components(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Null texts count as empty; texts without words have no n-grams, link with nothing and are their own component. Rows
    without doc_id link like others; a component_id is null only if no row of the component has an id. Repeated rows give
    rows each. Extra columns are ignored.
    """
    rows, nodes = _in_components(docs, n, threshold, sketch_bits)
    nodes = nodes.select("node", "doc_id", "component")
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = nodes.join(least, "component").select("node", "component_id")
    found = rows.where(F.col("n") > 0).join(named, "node").select("key", "n", "component_id")
    found = found.unionByName(rows.where(F.col("n") == 0).select("key", "n", F.col("doc_id").alias("component_id")))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("key"))
    return ids.join(found, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """The row with the least doc_id of every component, with its columns; see components. Repeats of it are dropped.

    Rows are told apart by doc_id and text: a row without doc_id is kept only if its whole component has none, and of rows
    that share the least doc_id one is kept. A near-duplicate stage takes five words and a similarity of 0.8.
    """
    rows, nodes = _in_components(docs, n, threshold)
    kept = nodes.groupBy("component").agg(F.min(_first()).alias("__least")).select(F.col("__least.key").alias("__key"))
    kept = kept.unionByName(rows.where(F.col("n") == 0).select(F.col("key").alias("__key")))
    found = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), text_of())).join(kept, "__key")
    return found.dropDuplicates(["__key"]).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * o >= 85 * (na + nb - o)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(s.s) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
