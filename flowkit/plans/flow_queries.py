"""Queries of cleaning, flows and slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators import clean, flows, slots
from flowkit.plans.packets import DAY_NS, DENSE, FLOWS, HORIZON_NS, KEY, MIN_PACKETS, PK, RAW, packets, raw_packets, slots_sql
from flowkit.plans.registry import query

K = list(flows.KEY)


def background(spark, sf_dir):
    return clean.canonical_endpoints(clean.filter_background(packets(spark, sf_dir)))


def eligible(spark, sf_dir):
    return flows.eligible_packets(background(spark, sf_dir), HORIZON_NS, MIN_PACKETS)


def sparse(spark, sf_dir):
    return slots.slot_features(eligible(spark, sf_dir), DAY_NS, HORIZON_NS)


def dense(spark, sf_dir):
    return slots.densify_slots(sparse(spark, sf_dir), 10, 86400.0)


def biflows(spark, sf_dir):
    return flows.build_biflows(background(spark, sf_dir))


def text_packets(spark, sf_dir):
    return clean.select_transport_fields(raw_packets(spark, sf_dir))


F8 = ", ".join(f"f{k}" for k in range(8))
query("slot_features", f"WITH {DENSE} SELECT {KEY}, slot, {F8} FROM dense")(dense)
query("b1_filter_background", f"WITH {RAW} SELECT row_pos, src, kind AS pkttype FROM raw WHERE kind IN (0, 4) AND NOT starts_with(coalesce(src, ''), '127.') AND NOT starts_with(dst, '127.')")(
    lambda s, d: clean.filter_background(raw_packets(s, d)).select("row_pos", "src", F.col("pkttype").cast("int").alias("pkttype"))
)
query("b2_filter_malformed_only", f"WITH {RAW} SELECT row_pos FROM raw WHERE kind IN (0, 1, 2, 3, 4)")(lambda s, d: clean.filter_malformed_only(raw_packets(s, d)).select("row_pos"))
query("b3_usable_transport", f"WITH {RAW} SELECT row_pos FROM raw WHERE proto_ IN (6, 17) AND src IS NOT NULL AND sport IS NOT NULL")(lambda s, d: clean.usable_transport(text_packets(s, d)).select("row_pos"))
query("b4_select_transport_fields", f"WITH {RAW} SELECT row_pos, proto_ AS proto, CASE WHEN proto_ = 1 THEN NULL WHEN proto_ = proto THEN sport END AS sport, CASE WHEN proto_ = proto THEN dport END AS dport, CASE WHEN proto_ = proto THEN payload ELSE 0 END AS payload FROM raw")(
    lambda s, d: text_packets(s, d).select("row_pos", "proto", "sport", "dport", "payload")
)
query("b5_canonical_endpoints", f"WITH {FLOWS} SELECT row_pos, ip_a, port_a, ip_b, port_b FROM ends")(lambda s, d: background(s, d).select("row_pos", "ip_a", "port_a", "ip_b", "port_b"))
query("b6_filter_apps", f"WITH {PK} SELECT app, count(*) AS n FROM pk WHERE app IN ('app_0', 'app_1', 'app_2') AND app NOT IN ('app_2') GROUP BY app")(
    lambda s, d: clean.filter_apps(packets(s, d), ["app_0", "app_1", "app_2"], ["app_2"]).groupBy("app").agg(F.count(F.lit(1)).alias("n"))
)
query("b7_filter_min_packets", f"WITH {FLOWS} SELECT {KEY}, packets FROM flows WHERE packets >= 5")(lambda s, d: flows.filter_min_packets(biflows(s, d), MIN_PACKETS).select(*K, "packets"))
query("b8_filter_duration", f"WITH {FLOWS} SELECT count(*) FILTER (duration_ns > {HORIZON_NS}) AS above, count(*) FILTER (duration_ns = {HORIZON_NS}) AS exactly, count(*) FILTER (duration_ns < {HORIZON_NS}) AS below, max(duration_ns) FILTER (duration_ns < {HORIZON_NS}) AS nearest_below, min(duration_ns) FILTER (duration_ns > {HORIZON_NS}) AS nearest_above FROM flows")(
    lambda s, d: flows.duration_report(biflows(s, d), HORIZON_NS)
)
query("b9_clip_horizon", f"WITH {FLOWS} SELECT row_pos, elapsed_ns FROM fp WHERE elapsed_ns <= {HORIZON_NS}")(lambda s, d: flows.clip_horizon(flows.elapsed_ns(background(s, d)), HORIZON_NS).select("row_pos", "elapsed_ns"))
query("b10_reject_bad_timestamps", f"WITH {RAW} SELECT row_pos, t_ns FROM raw WHERE year(make_timestamp(t_ns // 1000)) = 2024")(
    lambda s, d: clean.reject_bad_timestamps(raw_packets(s, d).drop("t_ns"), 2024).select("row_pos", "t_ns")
)
query("b11_map_class", f"WITH {PK} SELECT class, count(*) AS n FROM (SELECT CASE app WHEN 'app_0' THEN 'chat' WHEN 'app_1' THEN 'stream' WHEN 'app_2' THEN 'stream' END AS class FROM pk WHERE proto = 6) WHERE class IS NOT NULL GROUP BY class")(
    lambda s, d: clean.map_class(clean.filter_protocol(packets(s, d), 6), {"app_0": "chat", "app_1": "stream", "app_2": "stream"}).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
)
query("b12_population_funnel", f"WITH {FLOWS} SELECT 0 AS step, 'all' AS name, count(*) AS surviving, 0 AS removed FROM flows UNION ALL SELECT 1, 'tcp', count(*) FILTER (proto = 6), count(*) FILTER (proto <> 6) FROM flows UNION ALL SELECT 2, 'packets', count(*) FILTER (proto = 6 AND packets >= 5), count(*) FILTER (proto = 6 AND packets < 5) FROM flows")(
    lambda s, d: clean.population_funnel(biflows(s, d), {"tcp": F.col("proto") == 6, "packets": F.col("packets") >= 5})
)
_NAME = "'timeseries_' || app || '_open_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_dev' || user_id || '.csv'"


def _names(s, d):
    form = F.concat(F.lit("timeseries_"), F.col("app"), F.lit("_open_"), F.date_format("ts", "yyyy-MM-dd_HH-mm-ss"), F.lit("_dev"), F.col("user_id").cast("string"), F.lit(".csv"))
    return packets(s, d).select("row_pos", *[c.alias(n) for n, c in scalar.parse_capture_name(form).items()])


query("b13_parse_capture_name", f"WITH {PK} SELECT row_pos, app, 'open' AS action, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H-%M-%S') AS time, 'dev' || user_id AS device, app || '_open_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_dev' || user_id AS capture_group FROM pk")(_names)
query("b14_split_name_marker", f"WITH {PK} SELECT row_pos, CASE WHEN k % 2 = 0 THEN 'vpn' ELSE 'nonvpn' END AS marker, 'skype' || user_id AS app FROM pk")(
    lambda s, d: packets(s, d).select("row_pos", *[c.alias(n) for n, c in scalar.split_name_marker(F.concat(F.when(F.col("k") % 2 == 0, "vpn_skype").otherwise("nonvpn_skype"), F.col("user_id").cast("string"), F.lit("_chat_7.pcap"))).items()])
)
query("b15_flag_dns", f"WITH {FLOWS} SELECT {KEY}, port_a = 53 OR port_b = 53 AS is_dns, port_a = 5353 OR port_b = 5353 AS is_mdns FROM flows")(lambda s, d: clean.flag_dns(biflows(s, d)).select(*K, "is_dns", "is_mdns"))
query("b16_select_features", f"WITH {slots_sql()} SELECT {KEY}, slot, f1, f4, f6 FROM s")(lambda s, d: slots.select_features(sparse(s, d), slots.THREE))
query("b17_drop_incomplete", f"WITH {RAW} SELECT row_pos FROM raw WHERE src IS NOT NULL AND kind IS NOT NULL OR (src IS NOT NULL AND k = 99)")(lambda s, d: clean.drop_incomplete(raw_packets(s, d), ["src", "pkttype"]).select("row_pos"))
query("b18_filter_series_length", f"WITH {slots_sql()} SELECT {KEY}, slot FROM (SELECT *, max(f7) OVER (PARTITION BY {KEY}) AS reach FROM s) WHERE reach >= 691200.0 AND f7 <= 691200.0")(
    lambda s, d: slots.filter_series_length(sparse(s, d).withColumn("id", F.struct(*K)).withColumnRenamed("f7", "time_from_start"), 691200.0, "id").select(*K, "slot")
)
query("e1_build_biflows", f"WITH {FLOWS} SELECT * FROM flows")(biflows)
query("e2_slot_features", f"WITH {slots_sql()} SELECT {KEY}, slot, {F8} FROM s")(sparse)
_WIDTHS = [DAY_NS * k // 4 for k in (1, 2, 3, 4, 5, 6, 8, 12, 16)]
query(
    "e3_slot_features_multi",
    f"WITH {FLOWS}, w AS (SELECT unnest([{', '.join(map(str, _WIDTHS))}]) AS w_ns), m AS (SELECT {KEY}, w_ns, least(elapsed_ns // w_ns, {HORIZON_NS} // w_ns) AS slot, sum(CASE WHEN fwd THEN payload ELSE 0 END) AS f0, CAST(count(*) FILTER (fwd) AS DOUBLE) AS f1, sum(CASE WHEN NOT fwd THEN payload ELSE 0 END) AS f3, CAST(count(*) FILTER (NOT fwd) AS DOUBLE) AS f4 FROM el CROSS JOIN w GROUP BY ALL) SELECT {KEY}, w_ns, slot, f0, f1, CASE WHEN f1 > 0 THEN f0 / f1 ELSE 0 END AS f2, f3, f4, CASE WHEN f4 > 0 THEN f3 / f4 ELSE 0 END AS f5, CASE WHEN f3 > 0 THEN f0 / f3 ELSE 0 END AS f6, slot * (w_ns / 1e9) AS f7 FROM m",
)(lambda s, d: slots.slot_features_multi(eligible(s, d), _WIDTHS, HORIZON_NS))


def _timed(s, d):
    p = packets(s, d)
    return p.withColumn("t", (F.col("t_ns") - F.lit(1_700_000_000_000_000_000)) / 1e9).withColumn("direction", F.col("out").cast("int"))


_W = 432000.0
_STATS = f"""WITH {PK}, t AS (SELECT *, CAST(out AS INT) AS direction, (t_ns - 1700000000000000000) / 1e9 AS t FROM pk), u AS (SELECT *, CAST(round((t - ((t % {_W}) + {_W}) % {_W}) / {_W}) AS BIGINT) AS slot FROM t),
e AS (SELECT capture_id, slot, direction, count(*) AS n, sum(payload) AS size, min(row_pos) AS seen FROM u GROUP BY ALL),
a AS (SELECT capture_id, slot, sum(size) AS total_size, CAST(sum(n) AS BIGINT) AS packets_count, arg_max(direction, (n, -seen)) AS d FROM e GROUP BY ALL),
g AS (SELECT capture_id, unnest(range(min(slot), max(slot) + 1)) AS slot FROM u GROUP BY capture_id),
r AS (SELECT capture_id, slot, coalesce(total_size, 0) AS total_size, coalesce(packets_count, 0) AS packets_count, coalesce(d, -1) AS d FROM g LEFT JOIN a USING (capture_id, slot))"""
query("e4_undirected_slot_stats", _STATS + f" SELECT capture_id, slot, total_size, packets_count, CASE WHEN packets_count > 0 THEN total_size / packets_count ELSE 0 END AS average_size, d AS most_common_direction, slot * {_W}::DOUBLE AS time_from_start, CASE WHEN packets_count > 0 THEN (packets_count - d) / packets_count ELSE 0 END AS direction_0_ratio, CASE WHEN packets_count > 0 THEN d / packets_count ELSE 0 END AS direction_1_ratio FROM r")(
    lambda s, d: slots.undirected_slot_stats(_timed(s, d), "capture_id", "t", "payload", "direction", "row_pos", _W)
)
query("f3_slot_range", _STATS + " SELECT capture_id, min(slot) AS lo, max(slot) AS hi FROM u GROUP BY capture_id")(
    lambda s, d: slots.slot_range(_timed(s, d).withColumn("slot", scalar.slot_float_floor(F.col("t"), F.lit(_W))), "capture_id")
)
query("g2_head_slots", _STATS + " SELECT capture_id, slot FROM (SELECT capture_id, slot, row_number() OVER (PARTITION BY capture_id ORDER BY slot) AS n FROM r) WHERE n <= 5")(
    lambda s, d: slots.head_slots(slots.undirected_slot_stats(_timed(s, d), "capture_id", "t", "payload", "direction", "row_pos", _W), "capture_id", 5).select("capture_id", "slot")
)


def list_flows(s, d):
    p = packets(s, d)
    row = F.struct("t_ns", "row_pos", "payload", F.when(F.col("k") % 9 == 0, 0).when(F.col("out"), 1).otherwise(-1).alias("dir"))
    p = p.groupBy(F.col("user_id").alias("flow")).agg(F.array_sort(F.collect_list(row)).alias("x"))
    time = F.transform("x", lambda r: (r["t_ns"] - F.col("x")[0]["t_ns"]) / 1e9)
    return p.select("flow", F.to_json(F.transform("x", lambda r: r["payload"])).alias("sizes"), F.to_json(time).alias("times"), F.to_json(F.transform("x", lambda r: r["dir"])).alias("dirs"))


query(
    "e5_list_column_slots",
    f"""WITH {PK}, p AS (SELECT user_id AS flow, payload AS size, CASE WHEN k % 9 = 0 THEN 0 WHEN out THEN 1 ELSE -1 END AS dir, (t_ns - min(t_ns) OVER (PARTITION BY user_id)) / 1e9 / 1000 AS t FROM pk),
    q AS (SELECT *, CAST(round((t - t % 86.4) / 86.4) AS BIGINT) AS slot FROM p), r AS (SELECT flow, least(max(slot), CAST(round((777.6::DOUBLE - 777.6::DOUBLE % 86.4::DOUBLE) / 86.4::DOUBLE) AS BIGINT)) AS reach FROM q GROUP BY flow),
    c AS (SELECT flow, slot, sum(CASE WHEN dir = 1 THEN size ELSE 0 END) AS f0, CAST(count(*) FILTER (dir = 1) AS DOUBLE) AS f1, sum(CASE WHEN dir = -1 THEN size ELSE 0 END) AS f3, CAST(count(*) FILTER (dir = -1) AS DOUBLE) AS f4 FROM q JOIN r USING (flow) WHERE dir <> 0 AND slot <= reach GROUP BY ALL),
    g AS (SELECT flow, unnest(range(0, (SELECT max(reach) FROM r) + 1)) AS slot FROM r),
    z AS (SELECT flow, slot, coalesce(f0, 0) AS f0, coalesce(f1, 0) AS f1, coalesce(f3, 0) AS f3, coalesce(f4, 0) AS f4 FROM g LEFT JOIN c USING (flow, slot))
    SELECT flow, slot, f0, f1, CASE WHEN f1 > 0 THEN f0 / f1 ELSE 0 END AS f2, f3, f4, CASE WHEN f4 > 0 THEN f3 / f4 ELSE 0 END AS f5, CASE WHEN f3 > 0 THEN f0 / f3 ELSE 0 END AS f6, slot * 86.4::DOUBLE AS f7 FROM z""",
)(lambda s, d: slots.list_column_slots(list_flows(s, d), 86.4, 777.6))
query("e6_packet_accounting", f"WITH {RAW} SELECT capture_id, count(*) AS packets_raw, count(*) FILTER (proto_ NOT IN (6, 17)) AS non_tcp_udp, count(*) FILTER (proto_ IN (6, 17) AND (src IS NULL OR sport IS NULL)) AS missing_port_or_ip, count(*) FILTER (proto_ IN (6, 17) AND src IS NOT NULL AND sport IS NOT NULL) AS usable, count(DISTINCT CASE WHEN proto_ IN (6, 17) AND src IS NOT NULL AND sport IS NOT NULL THEN least(src || ':' || sport, dst || ':' || dport) || greatest(src || ':' || sport, dst || ':' || dport) || proto_ END) AS n_flows FROM raw GROUP BY capture_id")(
    lambda s, d: clean.packet_accounting(text_packets(s, d))
)
query("e7_filter_stats", f"WITH {RAW}, m AS (SELECT *, coalesce(kind IN (0, 4), FALSE) AS good, starts_with(coalesce(src, ''), '127.') AS loop FROM raw) SELECT capture_id, count(*) AS packets_raw, count(*) FILTER (NOT good) AS dropped_pkttype, count(*) FILTER (good AND loop) AS dropped_loopback, count(*) FILTER (kind IN (1, 2, 3)) AS background, count(*) FILTER (kind IS NULL) AS malformed_pkttype, count(*) FILTER (good AND NOT loop AND kind = 4) AS upstream, count(*) FILTER (good AND NOT loop AND kind = 0) AS downstream, coalesce(max(t_ns) FILTER (good AND NOT loop) - min(t_ns) FILTER (good AND NOT loop), 0) AS duration_ns FROM m GROUP BY capture_id")(
    lambda s, d: clean.filter_stats(raw_packets(s, d))
)
query("e8_horizon_meta", f"WITH {FLOWS} SELECT {KEY}, count(*) AS packets_in_d, sum(payload) AS payload_in_d, count(*) FILTER (fwd) AS fwd_in_d, count(*) FILTER (NOT fwd) AS rev_in_d FROM el GROUP BY ALL")(lambda s, d: flows.horizon_meta(eligible(s, d)))
query("f1_elapsed_ns", f"WITH {FLOWS} SELECT row_pos, elapsed_ns FROM fp")(lambda s, d: flows.elapsed_ns(background(s, d)).select("row_pos", "elapsed_ns"))
query("f2_first_packet_direction", f"WITH {FLOWS} SELECT row_pos, fwd FROM fp")(lambda s, d: flows.first_packet_direction(background(s, d)).select("row_pos", "fwd"))
query("g1_stable_time_sort", f"WITH {FLOWS} SELECT row_pos, row_number() OVER (PARTITION BY {KEY} ORDER BY t_ns, row_pos) AS nth FROM ends")(lambda s, d: flows.time_sorted(background(s, d)).select("row_pos", "nth"))
query("g7_dedupe_captures", f"WITH {FLOWS} SELECT DISTINCT capture_id FROM flows")(lambda s, d: biflows(s, d).select("capture_id").dropDuplicates(["capture_id"]))
query("d2_join_direction_stats", f"WITH {FLOWS} SELECT {KEY}, coalesce(sum(payload) FILTER (fwd), 0) AS up_size, count(*) FILTER (fwd) AS up_count, coalesce(sum(payload) FILTER (NOT fwd), 0) AS down_size, count(*) FILTER (NOT fwd) AS down_count FROM fp GROUP BY ALL")(
    lambda s, d: slots.join_direction_stats(flows.first_packet_direction(background(s, d)), K)
)
query("d1_densify_slots", f"WITH {DENSE} SELECT {KEY}, slot, {F8} FROM dense")(dense)


def _index(s, d):
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in K])
    return biflows(s, d).withColumn("flow_id", F.sha2(key, 256))


query("d10_lookup_flow_id", f"WITH {FLOWS} SELECT row_pos, sha256(concat_ws('|', capture_id, ip_a, port_a, ip_b, port_b, proto)) AS flow_id FROM ends")(lambda s, d: flows.lookup_flow_id(background(s, d), _index(s, d)).select("row_pos", "flow_id"))
query("c21_flatten_series", f"WITH {DENSE} SELECT {KEY}, slot, u.feature, u.value FROM dense, LATERAL (SELECT unnest(range(0, 8)) AS feature, unnest([f0, f1, f2, f3, f4, f5, f6, f7]) AS value) u")(lambda s, d: slots.unflatten(slots.flatten_series(dense(s, d)), 8))
query("i18_pad_to_longest", f"WITH {slots_sql()}, l AS (SELECT {KEY}, max(slot) AS last FROM s GROUP BY ALL) SELECT {KEY}, g.slot, coalesce(s.f0, 0) AS f0, CAST(g.slot <= last AS INT) AS mask FROM l CROSS JOIN (SELECT unnest(range(0, (SELECT max(slot) FROM s) + 1)) AS slot) g LEFT JOIN s USING ({KEY}, slot)")(
    lambda s, d: slots.pad_to_longest(sparse(s, d).withColumn("id", F.struct(*K)), "id", ["f0"]).select("id.*", "slot", "f0", "mask")
)
