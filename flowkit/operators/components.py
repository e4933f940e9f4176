"""Checkpoints, places over ranges, and connected components by rounds of hooking and contraction."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges that one task may join at the end, when rounds would cost more than their work.
FINISH_EDGES = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a local session takes a temporary one and a cluster,
    whose executors would not share that, gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(*frames: DataFrame) -> None:
    """Delete the files of frames from checkpoint() that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def before_in_range(parts: DataFrame, n: Column, *keys: str) -> DataFrame:
    """(keys, __part), __before and __total: sums of n over the earlier ranges and over all ranges of the same keys."""
    sizes = parts.groupBy(*keys, "__part").agg(F.sum(n).alias("__size"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__size").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select(*keys, "__part", before.alias("__before"), F.sum("__size").over(w).alias("__total"))


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with its place by order, from 1: ranges are counted first, then each is numbered by itself."""
    r = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    r = r.withColumn("__in", inside).join(before_in_range(r, F.lit(1)), "__part")
    return r.withColumn(name, F.col("__in") + F.col("__before")).select(*df.columns, name)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """node and component, the least node reachable from it, for every node of an edge; loops and repeats don't matter.

    Every round hooks each node to its neighbour of least hash, or to itself, and contracts the edges along the hooks, so
    that edges and nodes shrink by a factor whatever the order of the nodes. Partial aggregates find the least
    neighbour; a hub's edges meet one row on the other side, so Spark can split them over tasks. When at most finish_edges
    edges are left, one task joins them; more never meet in one task. The hooks of all rounds are put together backwards.
    Rows with a null end are ignored. No edges give no rows.
    """
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    kind = e.select(F.coalesce(a, b).alias("node")).schema["node"].dataType.simpleString()
    e = checkpoint(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    hooks: list[DataFrame] = []
    while (n := e.count()) > finish_edges:
        both = e.select(F.inline(F.array(F.struct("u", F.col("v").alias("w")), F.struct(F.col("v").alias("u"), F.col("u").alias("w")))))
        least = F.least(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("w")), F.min(F.struct(F.xxhash64("w").alias("h"), "w")))
        hook = checkpoint(both.groupBy("u").agg(least.alias("least")).select("u", F.col("least.w").alias("w")))
        to = e.join(hook.withColumnRenamed("w", "a"), "u").join(hook.select(F.col("u").alias("v"), F.col("w").alias("b")), "v")
        to = checkpoint(to.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        release(e)
        e = to
        hooks.append(hook)
    roots = e.coalesce(1).mapInArrow(_joined, f"u {kind}, w {kind}") if n else None
    for hook in reversed(hooks):
        if roots is None:
            roots = hook
        else:
            further = roots.select(F.col("u").alias("w"), F.col("w").alias("r"))
            roots = hook.join(further, "w", "left").select("u", F.coalesce("r", "w").alias("w"))
    if roots is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if not hooks:  # the task names components by their least node
        return roots.select(F.col("u").alias("node"), F.col("w").alias("component"))
    roots = checkpoint(roots)
    release(e, *hooks)
    least = roots.groupBy("w").agg(F.min("u").alias("component"))
    return roots.join(least, "w").select(F.col("u").alias("node"), "component")


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of these edges with the least node of their component, by union-find."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    schema = None
    for b in batches:
        schema = schema or b.schema
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    if up:
        nodes = list(up)
        columns = [pa.array(nodes, schema.field(0).type), pa.array([root(x) for x in nodes], schema.field(0).type)]
        yield pa.RecordBatch.from_arrays(columns, names=["u", "w"])
