"""Packet cleaning: filters, transport fields and canonical endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.functions import scalar



def _loopback(address: Column) -> Column:
    """A missing address is not a loopback one: such packets stay."""
    return F.coalesce(address, F.lit("")).startswith("127.")


def filter_background(pk: DataFrame) -> DataFrame:
    """Packets to or from us (type 0 or 4) without a loopback end; types that are no numbers go."""
    kind = F.col("pkttype").try_cast("int")
    return pk.where(kind.isin(0, 4) & ~_loopback(F.col("src")) & ~_loopback(F.col("dst")))


def filter_malformed_only(pk: DataFrame) -> DataFrame:
    """Packets whose type is one of 0 .. 4."""
    return pk.where(F.col("pkttype").try_cast("int").isin(0, 1, 2, 3, 4))


def select_transport_fields(raw: DataFrame) -> DataFrame:
    """sport, dport and payload by protocol: TCP payload length or UDP length; a missing payload is 0."""
    proto = F.col("ip_proto").try_cast("int")

    def pick(tcp: str, udp: str, kind: str) -> Column:
        return F.when(proto == 6, F.col(tcp).try_cast(kind)).when(proto == 17, F.col(udp).try_cast(kind))

    return raw.withColumns({"proto": proto, "sport": pick("tcp_srcport", "udp_srcport", "int"), "dport": pick("tcp_dstport", "udp_dstport", "int"), "payload": F.coalesce(pick("tcp_len", "udp_length", "double"), F.lit(0.0))})


def usable_transport(pk: DataFrame) -> DataFrame:
    """TCP or UDP packets with both ports and both addresses."""
    present = F.col("sport").isNotNull() & F.col("dport").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    return pk.where(F.col("proto").isin(6, 17) & present)


def canonical_endpoints(pk: DataFrame) -> DataFrame:
    """ip_a, port_a, ip_b, port_b: the two ends in order (addresses as text), alike for both directions."""
    one, two = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    a, b = F.least(one, two), F.greatest(one, two)
    return pk.withColumns({"ip_a": a["ip"], "port_a": a["port"], "ip_b": b["ip"], "port_b": b["port"]})


def filter_apps(df: DataFrame, keep: list[str], excluded: list[str] = ()) -> DataFrame:
    return df.where(F.col("app").isin(list(keep)) & ~F.col("app").isin(list(excluded)))


def reject_bad_timestamps(pk: DataFrame, year: int, text: str = "frame_time") -> DataFrame:
    """Adds t_ns; rows whose time can't be parsed or lies in another year go. The time is parsed once: it leaves an array
    of one value or none, as a filter on the column would be pushed below it and parse the text again for each use."""
    of_year = F.filter(F.array(scalar.parse_frame_time_ns(F.col(text))), lambda t: F.year(F.timestamp_seconds(scalar.integer_div(t, F.lit(scalar.NS)))) == year)
    return pk.withColumn("t_ns", F.explode(of_year))


def filter_protocol(flows: DataFrame, proto: int) -> DataFrame:
    return flows.where(F.col("proto") == proto)


def map_class(df: DataFrame, classes: dict[str, str], column: str = "app") -> DataFrame:
    """Adds class; rows whose value has no class go."""
    table = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    return df.withColumn("class", table[F.col(column)]).where(F.col("class").isNotNull())


def population_funnel(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """step, name, surviving and removed for each filter applied after the ones before it, in one pass."""
    total, counts = F.lit(True), [F.count(F.lit(1)).alias("s0")]
    for k, p in enumerate(steps.values()):
        total = total & F.coalesce(p, F.lit(False))
        counts.append(F.count_if(total).alias(f"s{k + 1}"))
    names = ["all", *steps]
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.lit(x).alias("name"), F.col(f"s{k}").alias("surviving"), (F.col(f"s{max(0, k - 1)}") - F.col(f"s{k}")).alias("removed")) for k, x in enumerate(names)])
    return df.agg(*counts).select(F.inline(rows))


def flag_dns(flows: DataFrame) -> DataFrame:
    return flows.withColumns({"is_dns": (F.col("port_a") == 53) | (F.col("port_b") == 53), "is_mdns": (F.col("port_a") == 5353) | (F.col("port_b") == 5353)})


def drop_incomplete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows with all required values; a table that lacks a required column gives no rows."""
    missing = [c for c in required if c not in df.columns]
    return df.limit(0) if missing else df.dropna(subset=required)


def filter_stats(pk: DataFrame, key: str = "capture_id") -> DataFrame:
    """Per capture what each rule of the cleaning drops, volumes each way and the span of time, in one aggregation."""
    kind = F.col("pkttype").try_cast("int")
    loop = _loopback(F.col("src")) | _loopback(F.col("dst"))
    good = F.coalesce(kind.isin(0, 4), F.lit(False))
    kept = good & ~loop
    return pk.groupBy(key).agg(
        F.count(F.lit(1)).alias("packets_raw"), F.count_if(~good).alias("dropped_pkttype"), F.count_if(good & loop).alias("dropped_loopback"),
        F.count_if(F.coalesce(kind.isin(1, 2, 3), F.lit(False))).alias("background"), F.count_if(~F.coalesce(kind.isin(0, 1, 2, 3, 4), F.lit(False))).alias("malformed_pkttype"),
        F.count_if(kept & (kind == 4)).alias("upstream"), F.count_if(kept & (kind == 0)).alias("downstream"),
        F.coalesce(F.max(F.when(kept, F.col("t_ns"))) - F.min(F.when(kept, F.col("t_ns"))), F.lit(0)).alias("duration_ns"),
    )


def packet_accounting(raw: DataFrame, key: str = "capture_id") -> DataFrame:
    """Per capture: raw, non TCP/UDP, missing port or address, usable packets and flows; the parts add up to the whole."""
    other = ~F.coalesce(F.col("proto").isin(6, 17), F.lit(False))
    whole = F.col("sport").isNotNull() & F.col("dport").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    ends = F.when(~other & whole, F.struct("ip_a", "port_a", "ip_b", "port_b", "proto"))
    out = canonical_endpoints(raw).groupBy(key).agg(
        F.count(F.lit(1)).alias("packets_raw"), F.count_if(other).alias("non_tcp_udp"), F.count_if(~other & ~whole).alias("missing_port_or_ip"), F.count_if(~other & whole).alias("usable"), F.count_distinct(ends).alias("n_flows")
    )
    same = F.col("packets_raw") == F.col("non_tcp_udp") + F.col("missing_port_or_ip") + F.col("usable")
    return out.where(F.assert_true(same, F.lit("packets are lost")).isNull())
