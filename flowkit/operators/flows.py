"""Bidirectional flows: keys, elapsed time, direction, eligibility and horizon."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A flow never spans captures and has no idle timeout.
KEY = ("capture_id", "ip_a", "port_a", "ip_b", "port_b", "proto")


def build_biflows(pk: DataFrame, carry: tuple[str, ...] = ("part", "app")) -> DataFrame:
    """One row per flow: packets, times, payload and the source of its first packet; ties in time go by row_pos."""
    first = F.min_by("src", F.struct("t_ns", "row_pos")).alias("first_src")
    flows = pk.groupBy(*KEY, *carry).agg(F.count(F.lit(1)).alias("packets"), F.min("t_ns").alias("start_ns"), (F.max("t_ns") - F.min("t_ns")).alias("duration_ns"), F.sum("payload").alias("payload_total"), first)
    return flows.withColumns({"duration_s": F.col("duration_ns") / 1e9, "is_dns": (F.col("port_a") == 53) | (F.col("port_b") == 53)})


def _flow() -> Window:
    return Window.partitionBy(*KEY)


def elapsed_ns(pk: DataFrame) -> DataFrame:
    """Adds elapsed_ns since the first packet of the flow."""
    return pk.withColumn("elapsed_ns", F.col("t_ns") - F.min("t_ns").over(_flow()))


def first_packet_direction(pk: DataFrame) -> DataFrame:
    """Adds fwd: the source is that of the flow's first packet."""
    return pk.withColumn("fwd", F.col("src") == F.first_value("src").over(_flow().orderBy("t_ns", "row_pos")))


def flow_packets(pk: DataFrame) -> DataFrame:
    """Adds elapsed_ns, fwd, packets_full and duration_ns; the windows share one shuffle by flow."""
    flow = _flow()
    out = pk.withColumns({"first_src": F.min_by("src", F.struct("t_ns", "row_pos")).over(flow), "start_ns": F.min("t_ns").over(flow), "duration_ns": F.max("t_ns").over(flow) - F.min("t_ns").over(flow), "packets_full": F.count(F.lit(1)).over(flow)})
    return out.withColumns({"elapsed_ns": F.col("t_ns") - F.col("start_ns"), "fwd": F.col("src") == F.col("first_src")}).drop("first_src", "start_ns")


def filter_min_packets(flows: DataFrame, n: int, column: str = "packets") -> DataFrame:
    return flows.where(F.col(column) >= n)


def filter_duration(flows: DataFrame, horizon_ns: int, strict: bool = True) -> DataFrame:
    d = F.col("duration_ns")
    return flows.where(d > horizon_ns if strict else d >= horizon_ns)


def duration_report(flows: DataFrame, horizon_ns: int) -> DataFrame:
    """Flows above, at and below the horizon, and the durations next to it."""
    d = F.col("duration_ns")
    return flows.agg(F.count_if(d > horizon_ns).alias("above"), F.count_if(d == horizon_ns).alias("exactly"), F.count_if(d < horizon_ns).alias("below"), F.max(F.when(d < horizon_ns, d)).alias("nearest_below"), F.min(F.when(d > horizon_ns, d)).alias("nearest_above"))


def clip_horizon(packets: DataFrame, horizon_ns: int) -> DataFrame:
    """A packet exactly at the horizon stays."""
    return packets.where(F.col("elapsed_ns") <= horizon_ns)


def horizon_meta(packets: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return packets.groupBy(*key).agg(F.count(F.lit(1)).alias("packets_in_d"), F.sum("payload").alias("payload_in_d"), F.count_if("fwd").alias("fwd_in_d"), F.count_if(~F.col("fwd")).alias("rev_in_d"))


def lookup_flow_id(pk: DataFrame, index: DataFrame) -> DataFrame:
    """Packets with the flow_id of their flow's row in the index, whose key columns are KEY."""
    return pk.join(index.select(*KEY, "flow_id"), list(KEY))


def time_sorted(pk: DataFrame) -> DataFrame:
    """Adds nth: the place of a packet in its flow by time, ties by row_pos."""
    return pk.withColumn("nth", F.row_number().over(_flow().orderBy("t_ns", "row_pos")))


def eligible_packets(pk: DataFrame, horizon_ns: int, min_packets: int, strict: bool = True) -> DataFrame:
    """Packets within the horizon of flows that are long enough; counts and durations are those of the whole flow."""
    p = filter_duration(filter_min_packets(flow_packets(pk), min_packets, "packets_full"), horizon_ns, strict)
    return clip_horizon(p, horizon_ns)


def latest_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("__nth = 1").drop("__nth")
