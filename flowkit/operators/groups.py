"""Duplicates, groups that must stay together, and leakage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkit.operators.components import connected_components


def duplicate_profile(rows: DataFrame, hash_column: str = "hash", label: str = "label") -> DataFrame:
    """Duplicate groups and rows, their share, the largest group, duplicates by hash and label, and label conflicts."""
    g = rows.groupBy(hash_column).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels"))
    same = rows.groupBy(hash_column, label).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_same_label"))
    out = g.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("dup_rows"), F.max("n").alias("largest"), F.count_if(F.col("labels") > 1).alias("conflicts"))
    return out.withColumn("percent", 100 * F.col("dup_rows") / F.col("rows")).join(F.broadcast(same))  # one row each


def group_size_histogram(rows: DataFrame, group: str = "group", label: str = "label") -> DataFrame:
    """size, groups of that size, and how many of them mix labels."""
    g = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.count_distinct(label).alias("labels"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("labels") > 1).alias("mixed"))


def label_fingerprint(df: DataFrame, row: str, label: str) -> DataFrame:
    """A digest of the label sequence that depends on the order of rows but not on the partitioning: partial sums of row
    hashes as decimals."""
    h = F.xxhash64(F.col(row), F.col(label)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("fingerprint"))


def label_digest(df: DataFrame, row: str, label: str) -> DataFrame:
    """SHA-256 of the labels in the order of rows, joined by commas; null labels are left out.

    Tasks sort ranges of rows and join their labels to blocks. SHA-256 of one text is a chain, so a last task hashes the
    blocks in order, as a stream: it holds one batch of them, never the labels.
    """

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            text = [x for x in b.column(0).to_pylist() if x is not None]
            made = pa.array([",".join(text) if text else None], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([k]), pa.array([b.num_rows]), made], names=["part", "k", "n", "text"])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, rows, first = hashlib.sha256(), 0, True
        for b in batches:
            rows += sum(b.column(0).to_pylist())
            for text in b.column(1):
                if text.is_valid:
                    h.update((("" if first else ",") + text.as_py()).encode())
                    first = False
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([h.hexdigest()])], names=["rows", "digest"])

    sort = df.select(F.col(row).alias("r"), F.col(label).alias("l")).repartitionByRange("r", "l").sortWithinPartitions("r", "l")
    made = sort.select(F.col("l").cast("string")).mapInArrow(blocks, "part long, k long, n long, text string")
    chain = made.repartition(1).sortWithinPartitions("part", "k").select("n", "text").mapInArrow(digest, "rows long, digest string")
    return chain.agg(F.coalesce(F.max("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), F.sha2(F.lit(""), 256)).alias("digest"))


def occurrence_number(df: DataFrame, key: list[str], order: str) -> DataFrame:
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(order)))


def align_by_content(new: DataFrame, live: DataFrame, key: list[str], row: str) -> DataFrame:
    """new_row and live_row: the nth occurrence of a content in its class on both sides; unmatched rows have a null."""
    a = occurrence_number(new.select(*key, row), key, row).withColumnRenamed(row, "new_row")
    b = occurrence_number(live.select(*key, row), key, row).withColumnRenamed(row, "live_row")
    return a.join(b, [*key, "occurrence"], "full").select("new_row", "live_row")


#: Links of duplicate rows that one task may join at the end: some 150 MB, a few seconds.
FINISH_LINKS = 1 << 19


def duplicate_groups(rows: DataFrame, row: str, hash_columns: list[str], finish_links: int = FINISH_LINKS) -> DataFrame:
    """row and group, the least row reachable through equal hashes in any of the columns.

    Each hash value links its rows to their least one, so edges grow with the rows, not with pairs.
    """
    pairs = rows.select(F.col(row).alias("row"), F.inline(F.array(*[F.struct(F.lit(k).alias("which"), F.col(c).cast("string").alias("value")) for k, c in enumerate(hash_columns)])))
    least = pairs.groupBy("which", "value").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").drop("most")
    edges = pairs.join(least, ["which", "value"]).select(F.col("row").alias("a"), F.col("least").alias("b"))
    found = connected_components(edges, finish_edges=finish_links)
    return rows.select(F.col(row)).distinct().join(found, F.col(row) == F.col("node"), "left").select(row, F.coalesce("component", row).alias("group"))


def ambiguous_groups(rows: DataFrame, key: list[str], group: str) -> DataFrame:
    """Rows whose content occurs in more than one group of its class."""
    many = rows.groupBy(*key).agg(F.count_distinct(group).alias("n")).where("n > 1").select(*key)
    return rows.join(many, key, "left_semi")


def leaked_duplicates(train: DataFrame, val: DataFrame, key: list[str]) -> DataFrame:
    """Validation rows that are copies of a training row, and their share."""
    leaked = val.join(train.select(*key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    return leaked.agg(F.count(F.lit(1)).alias("rows"), F.count("__seen").alias("leaked"), (F.count("__seen") / F.count(F.lit(1))).alias("share"))


def straddling_groups(split: DataFrame, group: str = "group", side: str = "side") -> DataFrame:
    """Groups with rows on both sides, among all."""
    g = split.groupBy(group).agg(F.count_distinct(side).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("n") > 1).alias("straddling"))
