"""The packet view over the events table, and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events are minutes apart, so horizons are days.
DAY_NS = 86_400_000_000_000
HORIZON_NS, MIN_PACKETS = 9 * DAY_NS, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """capture_id, part, app, src, sport, dst, dport, proto, pkttype, payload, t_ns, row_pos, user_id, k, ts, out."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.withColumns({"k": k, "out": F.col("event_type").isin("click", "purchase", "signup")})
    port = F.lit(40000) + F.col("k") % 3
    return e.select(
        F.concat(F.lit("cap_"), F.col("user_id").cast("string")).alias("capture_id"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("part"), F.concat(F.lit("app_"), (F.col("user_id") % 5).cast("string")).alias("app"),
        F.when(F.col("out"), "10.0.0.1").otherwise("93.0.0.1").alias("src"), F.when(F.col("out"), port).otherwise(443).alias("sport"),
        F.when(F.col("out"), "93.0.0.1").otherwise("10.0.0.1").alias("dst"), F.when(F.col("out"), 443).otherwise(port).alias("dport"),
        F.when(F.col("k") % 10 == 0, 17).otherwise(6).alias("proto"), F.when(F.col("k") % 25 == 0, 1).when(F.col("k") % 25 == 1, 2).when(F.col("out"), 4).otherwise(0).alias("pkttype"),
        F.floor(F.col("value") * 10).cast("double").alias("payload"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("t_ns"), F.col("event_id").alias("row_pos"), "user_id", "k", "ts", "out",
    )


PK = """
pk AS (SELECT 'cap_' || user_id AS capture_id, 'p' || (user_id % 3) AS part, 'app_' || (user_id % 5) AS app,
  CASE WHEN out THEN '10.0.0.1' ELSE '93.0.0.1' END AS src, CASE WHEN out THEN 40000 + k % 3 ELSE 443 END AS sport,
  CASE WHEN out THEN '93.0.0.1' ELSE '10.0.0.1' END AS dst, CASE WHEN out THEN 443 ELSE 40000 + k % 3 END AS dport,
  CASE WHEN k % 10 = 0 THEN 17 ELSE 6 END AS proto, CASE WHEN k % 25 = 0 THEN 1 WHEN k % 25 = 1 THEN 2 WHEN out THEN 4 ELSE 0 END AS pkttype,
  CAST(floor(value * 10) AS DOUBLE) AS payload, epoch_us(ts) * 1000 AS t_ns, event_id AS row_pos, user_id, k, ts, out
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_type IN ('click', 'purchase', 'signup') AS out FROM events))"""


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets as a capture file has them: all text, with missing and broken values."""
    p = packets(spark, sf_dir)
    udp, k = F.col("proto") == 17, F.col("k")
    return p.select(
        "capture_id", "row_pos", F.concat(F.date_format("ts", "MMM d, yyyy HH:mm:ss.SSSSSS"), F.lit("000 CDT")).alias("frame_time"),
        F.when(k == 98, None).when(k == 97, "127.0.0.1").otherwise(F.col("src")).alias("src"), "dst", F.when(k == 96, "1").otherwise(F.col("proto").cast("string")).alias("ip_proto"), F.when(k == 99, "abc").otherwise(F.col("pkttype").cast("string")).alias("pkttype"),
        F.when(~udp & (k != 94), F.col("sport").cast("string")).alias("tcp_srcport"), F.when(~udp, F.col("dport").cast("string")).alias("tcp_dstport"), F.when(~udp & (k != 95), F.col("payload").cast("long").cast("string")).alias("tcp_len"),
        F.when(udp, F.col("sport").cast("string")).alias("udp_srcport"), F.when(udp, F.col("dport").cast("string")).alias("udp_dstport"), F.when(udp, F.col("payload").cast("long").cast("string")).alias("udp_length"), "t_ns",
    )


RAW = (
    PK
    + """,
raw AS (SELECT capture_id, row_pos, strftime(ts, '%b %-d, %Y %H:%M:%S.%f') || '000 CDT' AS frame_time,
  CASE WHEN k = 98 THEN NULL WHEN k = 97 THEN '127.0.0.1' ELSE src END AS src, dst, CASE WHEN k = 96 THEN 1 ELSE proto END AS proto_,
  CASE WHEN k = 99 THEN NULL ELSE pkttype END AS kind, CASE WHEN proto = 17 OR k <> 94 THEN sport END AS sport, dport,
  CASE WHEN proto = 17 OR k <> 95 THEN payload ELSE 0 END AS payload, proto, t_ns, k FROM pk)"""
)

FLOWS = (
    PK
    + """,
bg AS (SELECT * FROM pk WHERE pkttype IN (0, 4) AND NOT starts_with(src, '127.') AND NOT starts_with(dst, '127.')),
ends AS (SELECT *, CASE WHEN (src, sport) <= (dst, dport) THEN src ELSE dst END AS ip_a, CASE WHEN (src, sport) <= (dst, dport) THEN sport ELSE dport END AS port_a,
  CASE WHEN (src, sport) <= (dst, dport) THEN dst ELSE src END AS ip_b, CASE WHEN (src, sport) <= (dst, dport) THEN dport ELSE sport END AS port_b FROM bg),
fp AS (SELECT *, t_ns - min(t_ns) OVER f AS elapsed_ns, max(t_ns) OVER f - min(t_ns) OVER f AS duration_ns, count(*) OVER f AS packets_full,
  src = first_value(src) OVER (PARTITION BY capture_id, ip_a, port_a, ip_b, port_b, proto ORDER BY t_ns, row_pos) AS fwd
  FROM ends WINDOW f AS (PARTITION BY capture_id, ip_a, port_a, ip_b, port_b, proto)),
el AS (SELECT * FROM fp WHERE packets_full >= 5 AND duration_ns > 777600000000000 AND elapsed_ns <= 777600000000000),
flows AS (SELECT capture_id, ip_a, port_a, ip_b, port_b, proto, part, app, count(*) AS packets, min(t_ns) AS start_ns, max(t_ns) - min(t_ns) AS duration_ns, sum(payload) AS payload_total,
  arg_min(src, (t_ns, row_pos)) AS first_src, (max(t_ns) - min(t_ns)) / 1e9 AS duration_s, port_a = 53 OR port_b = 53 AS is_dns FROM ends GROUP BY capture_id, ip_a, port_a, ip_b, port_b, proto, part, app)"""
)

KEY = "capture_id, ip_a, port_a, ip_b, port_b, proto"


def slots_sql(w: str = "86400000000000") -> str:
    """The dense-free slot table of eligible flows as CTE s."""
    return (
        FLOWS
        + f""",
s0 AS (SELECT {KEY}, least(elapsed_ns // {w}, 777600000000000 // {w}) AS slot, sum(CASE WHEN fwd THEN payload ELSE 0 END) AS f0, CAST(count(*) FILTER (fwd) AS DOUBLE) AS f1,
  sum(CASE WHEN NOT fwd THEN payload ELSE 0 END) AS f3, CAST(count(*) FILTER (NOT fwd) AS DOUBLE) AS f4 FROM el GROUP BY ALL),
s AS (SELECT {KEY}, slot, f0, f1, CASE WHEN f1 > 0 THEN f0 / f1 ELSE 0 END AS f2, f3, f4, CASE WHEN f4 > 0 THEN f3 / f4 ELSE 0 END AS f5, CASE WHEN f3 > 0 THEN f0 / f3 ELSE 0 END AS f6, slot * ({w} / 1e9) AS f7 FROM s0)"""
    )


DENSE = (
    slots_sql()
    + f""",
dense AS (SELECT {KEY}, slot, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2, coalesce(f3, 0) AS f3, coalesce(f4, 0) AS f4, coalesce(f5, 0) AS f5, coalesce(f6, 0) AS f6, slot * 86400.0::DOUBLE AS f7
  FROM (SELECT DISTINCT {KEY} FROM s) g CROSS JOIN (SELECT unnest(range(0, 10)) AS slot) LEFT JOIN s USING ({KEY}, slot))"""
)
