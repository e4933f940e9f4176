"""Streams that take packets by time, against the batch form, whatever the order of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from flowkit.operators import flows, slots
from flowkit.streaming import slots as stream

SCHEMA = "capture_id string, ip_a string, port_a int, ip_b string, port_b int, proto int, src string, t_ns long, row_pos long, payload double"
SECOND, HORIZON = 1_000_000_000, 20_000_000_000


@pytest.fixture(scope="module")
def packets():
    """Flows that start at different times; one packet beyond the horizon, ties, one exactly at the horizon."""
    rng, rows = random.Random(8), []
    for f in range(7):
        key, start = (f"c{f % 3}", "a", f, "b", 80, 6), 100 * SECOND + rng.randrange(15 * SECOND)
        times = [start, start, *(start + rng.randrange(19 * SECOND) for _ in range(rng.randrange(1, 12))), start + HORIZON, start + HORIZON + 3 * SECOND]
        rows += [(*key, rng.choice("ab"), t, 0, float(rng.randrange(100))) for t in (times if f != 3 else times[:1])]
    return [(*r[:8], k, r[9]) for k, r in enumerate(rows)]


def run(spark, tmp_path, make, packets, disorder, seed, name):
    """The packets shuffled within disorder seconds, in files of a few, and newer ones of another capture to end all flows."""
    rng = random.Random(seed)
    shuffled = sorted(packets, key=lambda r: r[7] + rng.random() * disorder * SECOND)
    parts = [shuffled[k : k + 7] for k in range(0, len(shuffled), 7)] + [[("end", "a", 0, "b", 0, 6, "a", t * SECOND, t, 0.0)] for t in (400, 600)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    q = None
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    for part in (parts[:3], parts[3:-2], parts[-2:-1], parts[-1:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if q is None:
            q = make(s).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
    kept = [o.numRowsTotal for o in q.lastProgress.stateOperators] if hasattr(q.lastProgress, "stateOperators") else None
    q.stop()
    return [r for r in spark.table(name).collect() if r.capture_id != "end"], kept


def batch(spark, packets):
    return flows.clip_horizon(flows.flow_packets(spark.createDataFrame(packets, SCHEMA)), HORIZON)


@pytest.mark.parametrize("seed", [1])
def test_packets_in_order(spark, tmp_path, packets, seed):
    pytest.importorskip("google.protobuf")
    found, _ = run(spark, tmp_path, lambda s: stream.relative_slots_in_order(s, 2 * SECOND, HORIZON, "10 seconds"), packets, 9, seed, f"in_order_{seed}")
    nth = {r.row_pos: r.nth for r in flows.time_sorted(spark.createDataFrame(packets, SCHEMA)).collect()}
    want = {r.row_pos: (min(r.elapsed_ns // (2 * SECOND), 10), r.fwd, r.payload, nth[r.row_pos]) for r in batch(spark, packets).collect()}
    assert {r.row_pos: (r.slot, r.fwd, r.payload, r.nth) for r in found} == want and len(found) == len(want)


def test_features_of_relative_slots(spark, tmp_path, packets):
    pytest.importorskip("google.protobuf")
    found, _ = run(spark, tmp_path, lambda s: stream.slot_features_stream(s, 2 * SECOND, HORIZON, "10 seconds"), packets, 9, 3, "relative_features")
    want = slots.densify_slots(slots.slot_features(batch(spark, packets), 2 * SECOND, HORIZON), 11, 2.0)
    names = [*stream.KEY, "slot", *[f"f{k}" for k in range(8)]]
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(tuple(r[n] for n in names) for r in want.collect())


def test_features_of_absolute_slots(spark, tmp_path, packets):
    pytest.importorskip("google.protobuf")
    wide = 1000 * SECOND
    found, _ = run(spark, tmp_path, lambda s: stream.slot_features_stream(s, 2 * SECOND, wide // 10, "10 seconds", True), packets, 9, 4, "absolute_features")
    p = flows.flow_packets(spark.createDataFrame(packets, SCHEMA)).withColumn("elapsed_ns", F.col("t_ns") - F.floor((F.col("t_ns") - F.col("elapsed_ns")) / (2 * SECOND)) * (2 * SECOND))
    sparse = slots.slot_features(p, 2 * SECOND, wide)
    last = {tuple(r[k] for k in stream.KEY): r.m for r in sparse.groupBy(*stream.KEY).agg(F.max("slot").alias("m")).collect()}
    names = [*stream.KEY, "slot", *[f"f{k}" for k in range(8)]]
    want = [tuple(r[n] for n in names) for r in slots.densify_slots(sparse, 20, 2.0).collect() if r.slot <= last[tuple(r[k] for k in stream.KEY)]]
    assert sorted(tuple(r[n] for n in names) for r in found) == sorted(want)


def test_late_packets_and_freed_state(spark, tmp_path):
    """What comes after the watermark is dropped, a flow that paused starts anew, and ended flows leave no state."""
    pytest.importorskip("google.protobuf")
    packet = lambda src, t, k: ("c", "a", 1, "b", 2, 6, src, t * SECOND, k, 1.0)
    rows = [packet("b", 101, 0), packet("a", 100, 1), packet("b", 150, 2), packet("a", 102, 3), packet("a", 151, 4)]
    found, kept = run(spark, tmp_path, lambda s: stream.relative_slots_in_order(s, SECOND, HORIZON, "10 seconds"), rows, 0, 1, "late_packets")
    got = sorted((r.row_pos, r.slot, r.fwd, r.nth) for r in found)
    assert got[:2] == [(0, 1, False, 2), (1, 0, True, 1)] and got[-1] == (4, 1, False, 2)  # anew at 150, from b
    assert kept is None or sum(kept) <= 4
