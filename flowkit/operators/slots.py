"""Slot features of flows: fixed grids, many widths in one pass, dense grids and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators.flows import KEY

#: Names of the eight features by their number; forward packets have the suffix -1.
FEATURES = ("total_size_dir_-1", "packet_count_dir_-1", "avg_payload_dir_-1", "total_size_dir_1", "packet_count_dir_1", "avg_payload_dir_1", "upstream_downstream_ratio", "time_from_start")
#: Features of the short configuration.
THREE = (1, 4, 6)


def _eight(df: DataFrame, w_seconds: Column) -> DataFrame:
    """f0 .. f7 from the sums f0, f3 and counts f1, f4."""
    df = df.withColumns({"f2": scalar.safe_div(F.col("f0"), F.col("f1")), "f5": scalar.safe_div(F.col("f3"), F.col("f4"))})
    ratio = F.when(F.col("f3") > 0, F.col("f0") / F.col("f3")).otherwise(0.0)
    return df.withColumns({"f6": ratio, "f7": F.col("slot") * w_seconds})


def slot_features(packets: DataFrame, w_ns: int, horizon_ns: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """Eight features for each slot that has packets. packets: elapsed_ns, fwd, payload within the horizon."""
    return slot_features_multi(packets, [w_ns], horizon_ns, key).drop("w_ns")


def slot_features_multi(packets: DataFrame, widths_ns: list[int], horizon_ns: int, key: tuple[str, ...] = KEY) -> DataFrame:
    """slot_features for several widths at once: each packet becomes one row per width, in one shuffle with partial sums."""
    p = packets.withColumn("w_ns", F.explode(F.array(*[F.lit(w).cast("long") for w in widths_ns])))
    slots = scalar.num_slots(F.lit(horizon_ns).cast("long"), F.col("w_ns"))
    p = p.withColumn("slot", scalar.slot_exact(F.col("elapsed_ns"), F.col("w_ns"), slots))
    fwd = F.col("fwd")
    out = p.groupBy(*key, "w_ns", "slot").agg(
        F.sum(F.when(fwd, F.col("payload")).otherwise(0.0)).alias("f0"), F.count_if(fwd).cast("double").alias("f1"), F.sum(F.when(~fwd, F.col("payload")).otherwise(0.0)).alias("f3"), F.count_if(~fwd).cast("double").alias("f4")
    )
    out = _eight(out, F.col("w_ns") / 1e9)
    return out.select(*key, "w_ns", "slot", *[f"f{k}" for k in range(8)])


def densify_slots(features: DataFrame, slots: int, w_seconds: float, key: tuple[str, ...] = KEY, extra: tuple[str, ...] = ()) -> DataFrame:
    """Every slot 0 .. slots-1 of every flow; missing ones are zero but for the time axis, extra columns null.

    A flow's slots, at most as many as the grid has, become one map, which the grid looks up: features are read once, and
    where they are partitioned by flow nothing is shuffled. Slots are distinct in a flow; those off the grid are dropped.
    """
    kept = [*[f"f{k}" for k in range(7)], *extra]
    on_grid = F.when(F.col("slot").between(0, slots - 1), F.struct(F.col("slot").cast("long"), F.struct(*kept).alias("x")))
    flows = features.groupBy(*key).agg(F.map_from_entries(F.collect_list(on_grid)).alias("__has"))

    def row(slot: Column) -> Column:
        x = F.element_at("__has", slot)
        zeros = [F.coalesce(x[f"f{k}"], F.lit(0.0)).alias(f"f{k}") for k in range(7)]
        return F.struct(slot.alias("slot"), *zeros, *[x[c].alias(c) for c in extra], (slot * w_seconds).alias("f7"))

    grid = F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))
    return flows.select(*key, F.explode(grid).alias("__slot"), "__has").select(*key, row(F.col("__slot")).alias("__row")).select(*key, "__row.*")


def join_direction_stats(packets: DataFrame, key: list[str]) -> DataFrame:
    """Totals and counts of both directions: what a join of two aggregates gives, as one conditional aggregate, which reads
    and shuffles the packets once. A packet without a direction counts in neither, a null payload not in the totals."""
    out = []
    for name, own in (("up", F.col("fwd")), ("down", ~F.col("fwd"))):
        out += [F.coalesce(F.sum(F.when(own, F.col("payload"))), F.lit(0.0)).alias(f"{name}_size"), F.count_if(own).alias(f"{name}_count")]
    return packets.groupBy(*key).agg(*out)


def select_features(slots: DataFrame, numbers: tuple[int, ...], key: tuple[str, ...] = KEY) -> DataFrame:
    return slots.select(*key, "slot", *[f"f{k}" for k in numbers])


def flatten_series(slots: DataFrame, numbers: tuple[int, ...] = tuple(range(8)), key: tuple[str, ...] = KEY) -> DataFrame:
    """One array per flow, slot by slot."""
    row = F.struct("slot", F.array(*[F.col(f"f{k}") for k in numbers]).alias("x"))
    return slots.groupBy(*key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["x"])).alias("features"))


def unflatten(flat: DataFrame, n: int, column: str = "features") -> DataFrame:
    """Arrays back to rows: slot, feature, value."""
    keep = [c for c in flat.columns if c != column]
    out = flat.select(*keep, F.posexplode(column).alias("pos", "value"))
    pos = F.col("pos").cast("long")
    return out.select(*keep, scalar.integer_div(pos, F.lit(n)).alias("slot"), F.pmod(pos, F.lit(n)).alias("feature"), "value")


def undirected_slot_stats(pk: DataFrame, key: str, time: str, size: str, direction: str, order: str, w: float, empty_direction: int = -1) -> DataFrame:
    """Totals, counts, means and the most common direction per slot of a file, from its first slot to its last.

    Slots come from floor division of doubles. Of directions that are equally common the one seen first counts.
    """
    p = pk.withColumn("slot", scalar.slot_float_floor(F.col(time), F.lit(float(w))))
    each = p.groupBy(key, "slot", direction).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.min(order).alias("seen"))
    mode = F.max_by(direction, F.struct(F.col("n"), -F.col("seen")))
    stats = each.groupBy(key, "slot").agg(F.sum("size").alias("total_size"), F.sum("n").alias("packets_count"), mode.alias("most_common_direction"))
    bounds = p.groupBy(key).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    grid = bounds.select(key, F.explode(F.sequence("lo", "hi")).alias("slot"))
    out = grid.join(stats, [key, "slot"], "left")
    n, d = F.coalesce("packets_count", F.lit(0)), F.coalesce(F.col("most_common_direction").cast("int"), F.lit(empty_direction))
    return out.select(
        key, "slot", F.coalesce("total_size", F.lit(0.0)).alias("total_size"), n.alias("packets_count"), scalar.safe_div(F.col("total_size"), n).alias("average_size"), d.alias("most_common_direction"),
        (F.col("slot") * w).alias("time_from_start"), F.when(n > 0, (n - d) / n).otherwise(0.0).alias("direction_0_ratio"), F.when(n > 0, d / n).otherwise(0.0).alias("direction_1_ratio"),
    )


def slot_range(pk: DataFrame, key: str, slot: str = "slot") -> DataFrame:
    return pk.groupBy(key).agg(F.min(slot).alias("lo"), F.max(slot).alias("hi"))


def head_slots(slots: DataFrame, key: str, n: int = 30_000) -> DataFrame:
    """The first n slots of each file."""
    return slots.withColumn("__nth", F.row_number().over(Window.partitionBy(key).orderBy("slot"))).where(F.col("__nth") <= n).drop("__nth")


def filter_series_length(slots: DataFrame, horizon: float, key: str) -> DataFrame:
    """Samples that reach the horizon, cut at it."""
    reach = F.max("time_from_start").over(Window.partitionBy(key))
    return slots.withColumn("__reach", reach).where((F.col("__reach") >= horizon) & (F.col("time_from_start") <= horizon)).drop("__reach")


def list_column_slots(flows: DataFrame, w_s: float, horizon_s: float, key: str = "flow") -> DataFrame:
    """Slot features of flows whose sizes, times (ms) and directions are lists in JSON text with single quotes.

    Direction 0 means no packet; packets beyond the grid are dropped; forward is direction +1. The grid ends at the last
    slot that any flow reaches within the horizon, and every flow has all of it.
    """
    lists = {c: F.from_json(F.regexp_replace(c, "'", '"'), "array<double>") for c in ("sizes", "times", "dirs")}
    p = flows.select(key, *[x.alias(c) for c, x in lists.items()])
    most = scalar.slot_float_floor(F.lit(float(horizon_s)), F.lit(float(w_s)))
    reach = F.least(scalar.slot_float_floor(F.array_max("times") / 1000, F.lit(float(w_s))), most)
    top = p.agg(F.max(reach).alias("hi"))  # one row
    p = p.select(key, F.explode(F.arrays_zip("sizes", "times", "dirs")).alias("x"), reach.alias("reach"))
    p = p.select(key, "reach", F.col("x.sizes").alias("size"), F.col("x.dirs").alias("dir"), scalar.slot_float_floor(F.col("x.times") / 1000, F.lit(float(w_s))).alias("slot"))
    p = p.where((F.col("dir") != 0) & (F.col("slot") <= F.col("reach")))
    up, down = F.col("dir") == 1, F.col("dir") == -1
    sums = p.groupBy(key, "slot").agg(F.sum(F.when(up, F.col("size")).otherwise(0.0)).alias("f0"), F.count_if(up).cast("double").alias("f1"), F.sum(F.when(down, F.col("size")).otherwise(0.0)).alias("f3"), F.count_if(down).cast("double").alias("f4"))
    grid = flows.select(key).distinct().join(F.broadcast(top)).select(key, F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("slot"))
    out = grid.join(sums, [key, "slot"], "left").na.fill(0.0, ["f0", "f1", "f3", "f4"])
    return _eight(out, F.lit(float(w_s))).select(key, "slot", *[f"f{k}" for k in range(8)])


def pad_to_longest(slots: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Every sample padded with zeros to the longest one, and mask, which is 1 where the sample has data."""
    top = slots.agg(F.max("slot").alias("hi"))  # one row
    lengths = slots.groupBy(key).agg(F.max("slot").alias("last"))
    grid = lengths.join(F.broadcast(top)).select(key, "last", F.explode(F.sequence(F.lit(0).cast("long"), "hi")).alias("slot"))
    out = grid.join(slots.select(key, "slot", *values), [key, "slot"], "left").na.fill(0.0, values)
    return out.withColumn("mask", (F.col("slot") <= F.col("last")).cast("int")).drop("last")
