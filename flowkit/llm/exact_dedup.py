"""Exact deduplication by Grace hashing.

Map tasks first fold the copies that they see into an open-addressing table, so that a group of any size sends at most one
record per table to the next stage. Records then go to partitions by content hash. Each partition streams into another
open-addressing table; when the table is full, its records and the rest of the stream are partitioned into spill files by
the next bits of the hash, and each file is treated in the same way, until its table fits. Tables compare the complete
content; a hash only chooses the place where the comparison starts.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import SPACE, text_of

#: Bytes of content that one table holds before it is flushed (map side) or partitioned (reduce side).
TABLE_BYTES = 48 << 20
#: Spill files of one level: the next BITS bits of the hash choose among them.
BITS = 4
_ENTRY_BYTES = 200

_GROUPS = pa.schema([("place", pa.int64()), ("digest", pa.string()), ("content", pa.string()), ("keep_id", pa.int64()), ("n", pa.int64())])


class OpenTable:
    """Distinct contents with the least id and the number of rows of each; linear probing, at most half full."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.rows: list[list] = []
        self.n_bytes = 0

    def _slot(self, place: int, content: str) -> int:
        mask = len(self.slots) - 1
        # the upper bits choose partitions and spill files, so probing starts from mixed bits
        k = (place * 0x9E3779B97F4A7C15 >> 20) & mask
        while (at := self.slots[k]) >= 0:
            row = self.rows[at]
            if row[0] == place and row[2] == content:
                return k
            k = (k + 1) & mask
        return k

    def add(self, place: int, digest: str, content: str, keep_id: int | None, n: int) -> None:
        k = self._slot(place, content)
        if (at := self.slots[k]) >= 0:
            row = self.rows[at]
            row[4] += n
            if keep_id is not None and (row[3] is None or keep_id < row[3]):
                row[3] = keep_id
            return
        self.slots[k] = len(self.rows)
        self.rows.append([place, digest, content, keep_id, n])
        self.n_bytes += len(content) + _ENTRY_BYTES
        if 2 * len(self.rows) > len(self.slots):
            self.slots = [-1] * (4 * len(self.slots))
            for i, row in enumerate(self.rows):
                self.slots[self._slot(row[0], row[2])] = i


def _batches(rows: Iterable[list], content: bool) -> Iterator[pa.RecordBatch]:
    part: list[list] = []
    size = 0
    for row in rows:
        part.append(row if content else [*row[:2], None, *row[3:]])
        size += len(row[2]) if content else 64
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), _GROUPS, strict=True)], schema=_GROUPS)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), _GROUPS, strict=True)], schema=_GROUPS)


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for k in range(0, b.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in b.slice(k, 512).columns), strict=True)


def _fold(limit: int):
    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for place, digest, content, doc_id in _records(batches):
            table.add(place, digest, content, doc_id, 1)
            if table.n_bytes > limit:
                yield from _batches(table.rows, True)
                table = OpenTable()
        yield from _batches(table.rows, True)

    return fold


def grace(records: Iterable[tuple], limit: int = TABLE_BYTES, level: int = 0) -> Iterator[list]:
    """Rows [place, digest, content, least id, n] of the distinct contents among the records, in bounded memory.

    A single content never overfills a table, so the recursion ends when the hash has no further bits: contents that
    share all 64 bits stay in one table.
    """
    table = OpenTable()
    records = iter(records)
    for r in records:
        table.add(*r)
        if table.n_bytes > limit and len(table.rows) > 1 and (level + 1) * BITS <= 60:
            break
    else:
        yield from table.rows
        return
    shift = 64 - (level + 1) * BITS
    files = [tempfile.TemporaryFile() for _ in range(1 << BITS)]  # private to this task, gone when closed
    try:
        for rows in (table.rows, records):
            for r in rows:
                pickle.dump(tuple(r), files[(r[0] >> shift) & ((1 << BITS) - 1)])
        del table
        for f in files:
            f.seek(0)
            yield from grace(_unpickled(f), limit, level + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _unpickled(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _resolve(limit: int):
    def resolve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(grace(_records(batches), limit), False)

    return resolve


def text_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: digest (SHA-256, hex), keep_id (least doc_id) and group_size.

    Texts are equal when they are identical after each run of white space became one space; null counts as empty.
    """
    rows = docs.select(F.regexp_replace(text_of(), SPACE, " ").alias("content"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.select(F.xxhash64("content").alias("place"), F.sha2("content", 256).alias("digest"), "content", "doc_id")
    schema = "place long, digest string, content string, keep_id long, n long"
    folded = rows.mapInArrow(_fold(table_bytes), schema).repartition("place")
    found = folded.mapInArrow(_resolve(table_bytes), schema)
    return found.select("digest", "keep_id", F.col("n").alias("group_size"))


def label_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row, dropped ones too.

    Of equal texts the row with the least doc_id is kept. Null texts count as empty. A row without doc_id is kept only if
    its whole group has none. Rows that repeat both doc_id and text: one of them is kept. An empty table gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256).alias("digest"))
    rows = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("repeats"))
    rows = rows.join(text_groups(docs, table_bytes), "digest")
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("nth"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The kept rows with all their columns; see label_copies for which they are."""
    digest = "__digest"
    rows = docs.withColumn(digest, F.sha2(F.regexp_replace(text_of(), SPACE, " "), 256))
    groups = text_groups(docs, table_bytes).select(F.col("digest").alias(digest), F.col("keep_id").alias("__keep"))
    kept = rows.join(groups, digest).where(F.col("doc_id").cast("long").eqNullSafe(F.col("__keep")))
    return kept.dropDuplicates([digest]).select(*[kept[c] for c in docs.columns])


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY content ORDER BY doc_id) = 1 AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""
