"""Queries of scalar functions, evaluation and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators import flows, fourier, metrics, series, splits
from flowkit.operators.repair import repair_impossible_bytes
from flowkit.plans.packets import PK, RAW, packets, raw_packets, table
from flowkit.plans.registry import query

# --- scalar functions
query("c1_parse_frame_time_ns", f"WITH {PK} SELECT row_pos, t_ns FROM pk")(lambda s, d: raw_packets(s, d).select("row_pos", scalar.parse_frame_time_ns(F.col("frame_time")).alias("t_ns")))
query("c2_days_from_civil", "SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", scalar.days_from_civil(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")).alias("day"))
)
query("c3_seconds_of_day", "SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + (epoch_us(ts) % 60000000) / 1e6 AS s FROM events")(lambda s, d: table(s, d, "events").select("event_id", scalar.seconds_of_day(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("s")))
query("c4_slot_exact", f"WITH {PK} SELECT row_pos, least((t_ns % 1000000000000) // 20000000, 40000) AS slot FROM pk")(lambda s, d: packets(s, d).select("row_pos", scalar.slot_exact(F.col("t_ns") % 1_000_000_000_000, F.lit(20_000_000), F.lit(40_001)).alias("slot")))
query("c5_slot_float_floor", "SELECT event_id, CAST(round((value - value % 0.05::DOUBLE) / 0.05::DOUBLE) AS BIGINT) AS slot FROM events")(lambda s, d: table(s, d, "events").select("event_id", scalar.slot_float_floor(F.col("value"), F.lit(0.05)).alias("slot")))
query("c6_slot_naive_division", f"WITH {PK} SELECT row_pos, CAST(trunc((t_ns % 1000000000000) / 1e9 / (30 / 1000)) AS BIGINT) AS slot FROM pk")(lambda s, d: packets(s, d).select("row_pos", scalar.slot_naive_division(F.col("t_ns") % 1_000_000_000_000, F.lit(30)).alias("slot")))
query("c7_num_slots", "SELECT n_nationkey, (n_nationkey + 1) * 1000 // 30 + 1 AS slots FROM nation")(lambda s, d: table(s, d, "nation").select("n_nationkey", scalar.num_slots((F.col("n_nationkey") + 1) * 1000, F.lit(30)).alias("slots")))
query("c8_safe_div", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount ELSE 0 END AS q FROM lineitem")(lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.safe_div(F.col("l_tax"), F.col("l_discount")).alias("q")))
query("c9_direction_pkttype", f"WITH {PK} SELECT row_pos, CASE WHEN pkttype = 4 THEN -1 ELSE 1 END AS dir FROM pk")(lambda s, d: packets(s, d).select("row_pos", scalar.direction_pkttype(F.col("pkttype")).alias("dir")))
query("c10_direction_zero_ip", f"WITH {PK} SELECT row_pos, CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END AS dir FROM pk")(lambda s, d: packets(s, d).select("row_pos", scalar.direction_zero_ip(F.when(F.col("k") % 6 == 0, "0.0.0.0").otherwise(F.col("src"))).alias("dir")))
query("c11_log1p_features", "SELECT event_id, ln(1 + greatest(value - 100, 0)) AS x FROM events")(lambda s, d: table(s, d, "events").select("event_id", scalar.log1p_bytes(F.col("value") - 100).alias("x")))


def _repair(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"), (F.col("o_orderkey") % 3).cast("double").alias("count"))
    return repair_impossible_bytes(o, "size", "count", "mean").select("o_orderkey", "size", "mean", "touched")


query("c12_repair_impossible_bytes", "WITH o AS (SELECT o_orderkey, o_totalprice AS size, CAST(o_orderkey % 3 AS DOUBLE) AS c FROM orders) SELECT o_orderkey, least(size, c * 65535) AS size, CASE WHEN c > 0 THEN least(size, c * 65535) / c ELSE 0 END AS mean, size > c * 65535 AS touched FROM o")(_repair)
query("c13_calendar_fields", "SELECT event_id, month(ts) AS month, day(ts) AS day, (dayofweek(ts) + 6) % 7 AS weekday, hour(ts) AS hour, minute(ts) // 15 AS quarter_hour FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", *[c.alias(n) for n, c in scalar.calendar_fields(F.col("ts")).items()])
)
query("c14_time_features", "SELECT event_id, second(ts) / 59.0 - 0.5 AS second_pos, minute(ts) / 59.0 - 0.5 AS minute_pos, hour(ts) / 23.0 - 0.5 AS hour_pos, ((dayofweek(ts) + 6) % 7) / 6.0 - 0.5 AS weekday_pos, (day(ts) - 1) / 30.0 - 0.5 AS day_pos, (dayofyear(ts) - 1) / 365.0 - 0.5 AS year_pos FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", *[c.alias(n) for n, c in scalar.time_features(F.col("ts"), "S").items()])
)
query("c14_time_features_weekly", "SELECT event_id, (day(ts) - 1) / 30.0 - 0.5 AS day_pos, (week(ts) - 1) / 52.0 - 0.5 AS week_pos FROM events")(lambda s, d: table(s, d, "events").select("event_id", *[c.alias(n) for n, c in scalar.time_features(F.col("ts"), "W").items()]))
query("c15_parse_label", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey END AS label FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", scalar.parse_label(F.when(F.col("n_nationkey") % 5 == 4, F.col("n_name")).when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("class "), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_nationkey").cast("string"))).alias("label"))
)
query("c16_parse_percent", "SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey + 0.25 END AS percent, CASE WHEN n_nationkey % 6 = 5 THEN NULL ELSE n_nationkey % 3 * 86400 + n_nationkey * 3600 + 8 * 60 + 15 END AS seconds FROM nation")(
    lambda s, d: (
        lambda n, k: n.select(
            "n_nationkey", scalar.parse_percent(F.when(k % 6 == 5, "Error").otherwise(F.concat(k.cast("string"), F.lit(".25%")))).alias("percent"),
            scalar.parse_duration(F.when(k % 6 == 5, "Missing").otherwise(F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "1 day, ").otherwise("2 days, "), k.cast("string"), F.lit(":08:15")))).alias("seconds"),
        )
    )(table(s, d, "nation"), F.col("n_nationkey"))
)
query("c18_softmax_argmax", "SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS cls, round(exp(CAST(embedding[1] AS DOUBLE) - list_max(embedding)) / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding)))), 9) AS p0 FROM embeddings")(
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).select("vec_id", scalar.argmax(F.col("e")).alias("cls"), F.round(scalar.softmax(F.col("e"))[0], 9).alias("p0"))
)
query("c19_classify_failure", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'CUDA OOM' WHEN 1 THEN 'FD EXHAUSTION' ELSE 'FAILED' END AS kind FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", scalar.classify_failure(F.when(F.col("n_nationkey") % 3 == 0, "CUDA Out of Memory").when(F.col("n_nationkey") % 3 == 1, "OSError: Too many open files")).alias("kind"))
)
query("c20_capture_key", f"WITH {PK} SELECT row_pos, part || '||' || capture_id AS key FROM pk")(lambda s, d: packets(s, d).select("row_pos", scalar.capture_key(F.col("part"), F.col("capture_id")).alias("key")))
query("c22_timestamp_precision", f"WITH {RAW} SELECT row_pos, 9 AS digits, FALSE AS sub_us, length(rtrim(split_part(split_part(frame_time, '.', 2), ' ', 1), '0')) AS finest FROM raw")(
    lambda s, d: raw_packets(s, d).select("row_pos", *[c.alias(n) for n, c in scalar.timestamp_precision(F.col("frame_time")).items()])
)

# --- classification
PRED = PK + ", preds AS (SELECT row_pos, capture_id, user_id % 5 AS y_true, (user_id + CASE WHEN k < 20 THEN 1 ELSE 0 END) % 5 AS y_pred, k FROM pk)"


def predictions(s, d):
    p = packets(s, d)
    return p.select("row_pos", "capture_id", (F.col("user_id") % 5).cast("int").alias("y_true"), ((F.col("user_id") + F.when(F.col("k") < 20, 1).otherwise(0)) % 5).cast("int").alias("y_pred"), "k")


query("e23_confusion_matrix", f"WITH {PRED}, g AS (SELECT a.x AS y_true, b.x AS y_pred FROM (SELECT unnest(range(0, 5)) AS x) a, (SELECT unnest(range(0, 5)) AS x) b), c AS (SELECT g.y_true, g.y_pred, count(row_pos) AS n FROM g LEFT JOIN preds USING (y_true, y_pred) GROUP BY ALL) SELECT *, 100 * n / sum(n) OVER (PARTITION BY y_true) AS percent FROM c")(
    lambda s, d: metrics.confusion_matrix(predictions(s, d), 5)
)
query(
    "e24_classification_report",
    f"""WITH {PRED}, l AS (SELECT label, (SELECT count(*) FROM preds WHERE y_true = label AND y_pred = label) AS tp, (SELECT count(*) FROM preds WHERE y_true = label) AS support, (SELECT count(*) FROM preds WHERE y_pred = label) AS said FROM (SELECT unnest(range(0, 5)) AS label)),
    m AS (SELECT label, tp, support, CASE WHEN said > 0 THEN tp / said ELSE 0 END AS p, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS r FROM l), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
    SELECT CAST(label AS VARCHAR) AS label, p AS precision, r AS recall, f AS f1, support FROM f UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM f UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support), sum(f * support) / sum(support), sum(support) FROM f UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM f""",
)(lambda s, d: metrics.classification_report(predictions(s, d)))
query("e25_accuracy", f"WITH {PRED} SELECT avg(CAST(y_true = y_pred AS INT)) AS accuracy FROM preds")(lambda s, d: metrics.accuracy(predictions(s, d)))


def _probs(s, d):
    return predictions(s, d).withColumn("probs", F.transform(F.sequence(F.lit(0), F.lit(4)), lambda c: F.when(c == F.col("y_pred"), F.col("k") + 10).otherwise((F.col("k") + c) % 7).cast("double")))


query("e33_capture_mean_probability", f"WITH {PRED}, x AS (SELECT capture_id, y_true, c, avg(CASE WHEN c = y_pred THEN k + 10 ELSE (k + c) % 7 END) AS p FROM preds, (SELECT unnest(range(0, 5)) AS c) GROUP BY ALL) SELECT capture_id, y_true, arg_max(c, (round(p, 12), -c)) AS y_pred FROM x GROUP BY ALL")(lambda s, d: metrics.capture_mean_probability(_probs(s, d)))
query("e33_capture_vote", f"WITH {PRED}, x AS (SELECT capture_id, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL) SELECT capture_id, y_true, arg_max(y_pred, (n, -y_pred)) AS y_pred FROM x GROUP BY ALL")(lambda s, d: metrics.capture_vote(predictions(s, d)))

# --- forecasts: a supplier's quantities against those before them
PAIRS = "pairs AS (SELECT l_suppkey AS series, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS step, l_quantity AS truth, coalesce(lag(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice), 1) AS pred, l_linenumber AS channel, l_orderkey % 3 AS mask FROM lineitem)"


def pairs(s, d):
    w = series.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    li = table(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("series"), F.row_number().over(w).alias("step"), F.col("l_quantity").alias("truth"), F.coalesce(F.lag("l_quantity").over(w), F.lit(1.0)).alias("pred"), F.col("l_linenumber").alias("channel"), (F.col("l_orderkey") % 3).alias("mask"))


_ERR = "avg(abs(pred - truth)) AS mae, avg((pred - truth) ** 2) AS mse, sqrt(avg((pred - truth) ** 2)) AS rmse, avg(abs((pred - truth) / truth)) AS mape, avg(((pred - truth) / truth) ** 2) AS mspe"
query("d15_pred_true_join", f"WITH {PAIRS} SELECT series, step, pred, truth FROM pairs")(lambda s, d: (lambda p: p.select("series", "step", "pred").join(p.select("series", "step", "truth"), ["series", "step"]))(pairs(s, d)))
query("e26_forecast_errors", f"WITH {PAIRS} SELECT {_ERR} FROM pairs")(lambda s, d: metrics.forecast_errors(pairs(s, d)))
query("e27_rse_corr", f"WITH {PAIRS}, c AS (SELECT channel, sum((truth - mt) * (pred - mp)) / sqrt(sum((truth - mt) ** 2 * (pred - mp) ** 2)) AS c FROM (SELECT *, avg(truth) OVER (PARTITION BY channel) AS mt, avg(pred) OVER (PARTITION BY channel) AS mp FROM pairs) GROUP BY channel) SELECT (SELECT sqrt(sum((truth - pred) ** 2)) / sqrt(sum((truth - m) ** 2)) FROM pairs, (SELECT avg(truth) AS m FROM pairs)) AS rse, avg(c) AS corr FROM c")(
    lambda s, d: metrics.rse_corr(pairs(s, d), "channel")
)
query("e28_masked_errors", f"WITH {PAIRS} SELECT {_ERR} FROM pairs WHERE mask = 0")(lambda s, d: metrics.masked_errors(pairs(s, d)))
_M4 = "f AS (SELECT series, avg(200 * abs(pred - truth) / (abs(truth) + abs(pred))) AS smape, avg(100 * abs(pred - truth) / abs(truth)) AS mape, avg(abs(pred - truth)) AS mae FROM pairs WHERE step % 5 = 0 GROUP BY series), nv AS (SELECT series, avg(d) AS naive FROM (SELECT series, abs(truth - lag(truth, 2) OVER (PARTITION BY series ORDER BY step)) AS d FROM pairs WHERE step % 5 <> 0) GROUP BY series), m4 AS (SELECT series, smape, mape, CASE WHEN naive <> 0 THEN mae / naive ELSE 0 END AS mase FROM f JOIN nv USING (series))"


def m4(s, d):
    p = pairs(s, d)
    return metrics.m4_scores(p.where("step % 5 = 0"), p.where("step % 5 <> 0").select("series", "step", F.col("truth").alias("value")), 2)


query("e29_m4_scores", f"WITH {PAIRS}, {_M4} SELECT * FROM m4")(m4)


def _owa(s, d):
    g = F.element_at(F.array(*[F.lit(x) for x in ("Yearly", "Monthly", "Weekly", "Daily")]), (F.col("series") % 4 + 1).cast("int"))
    scores = m4(s, d).withColumn("group", g)
    return metrics.m4_owa_summary(scores, scores.select("series", (F.col("smape") + 1).alias("smape"), (F.col("mase") * 2).alias("mase")))


query("e30_m4_owa_summary", f"WITH {PAIRS}, {_M4}, g AS (SELECT *, CASE series % 4 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'Monthly' ELSE 'Others' END AS g FROM m4), u AS (SELECT * FROM g UNION ALL SELECT * REPLACE ('Average' AS g) FROM g) SELECT g AS \"group\", count(*) AS n, avg(smape) AS smape, avg(mase) AS mase, (avg(smape) / avg(smape + 1) + CASE WHEN avg(mase) > 0 THEN 0.5 ELSE 0 END) / 2 AS owa FROM u GROUP BY g")(_owa)
query("e31_masked_losses", f"WITH {PAIRS} SELECT avg(abs((pred - truth) * mask / truth)) AS mape, 200 * avg(abs(pred - truth) / (abs(pred) + abs(truth)) * mask) AS smape, avg(CASE WHEN channel > 2 THEN abs(pred - truth) * mask / (channel - 2) ELSE 0 END) AS mase FROM pairs")(
    lambda s, d: metrics.masked_losses(pairs(s, d).withColumn("scale", F.greatest(F.col("channel") - 2, F.lit(0))))
)
query("e32_latency_summary", "SELECT event_type, count(*) AS n, avg(value) AS mean_ms, stddev_samp(value) AS std_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, quantile_cont(value, 0.99) AS p99_ms, min(value) AS min_ms, max(value) AS max_ms, avg(value) / 32 AS per_item_ms, 32000 / avg(value) AS items_per_s FROM events GROUP BY event_type")(
    lambda s, d: metrics.latency_summary(table(s, d, "events").withColumn("batch", F.lit(32)), "event_type", "value", "batch")
)

# --- ledgers: a run for each supplier, part and seed that lineitem has
LEDGER = "ledger AS (SELECT 'm' || l_suppkey % 4 AS model, CAST([20, 50, 100][l_partkey % 3 + 1] AS INT) AS \"window\", l_orderkey % 3 AS seed, max(l_orderkey) AS file, round(avg(l_quantity), 6) AS f1, CASE WHEN max(l_orderkey) % 4 = 0 THEN 'Error' ELSE CAST(floor(avg(l_quantity)) AS INT) || '.5%' END AS val_acc FROM lineitem GROUP BY ALL)"


def ledger(s, d):
    w = F.element_at(F.array(F.lit(20), F.lit(50), F.lit(100)), (F.col("l_partkey") % 3 + 1).cast("int"))
    li = table(s, d, "lineitem").groupBy(F.concat(F.lit("m"), (F.col("l_suppkey") % 4).cast("string")).alias("model"), w.alias("window"), (F.col("l_orderkey") % 3).alias("seed"))
    acc = F.when(F.max("l_orderkey") % 4 == 0, "Error").otherwise(F.concat(F.floor(F.avg("l_quantity")).cast("string"), F.lit(".5%")))
    return li.agg(F.max("l_orderkey").alias("file"), F.round(F.avg("l_quantity"), 6).alias("f1"), acc.alias("val_acc"))


def _grid(s, d):
    return splits.experiment_grid(s, {"model": ["m0", "m1", "m2", "m3", "m9"], "window": [20, 50, 100], "seed": [0, 1, 2]}, ledger(s, d))


query("d11_experiment_grid", f"WITH {LEDGER} SELECT m AS model, w AS \"window\", sd AS seed, f1, CASE WHEN f1 IS NULL THEN 'PENDING' ELSE 'OK' END AS status FROM (SELECT unnest(['m0', 'm1', 'm2', 'm3', 'm9']) AS m), (SELECT unnest([20, 50, 100]) AS w), (SELECT unnest([0, 1, 2]) AS sd) LEFT JOIN ledger ON model = m AND \"window\" = w AND seed = sd")(
    lambda s, d: _grid(s, d).select("model", "window", "seed", "f1", "status")
)
query("d12_pending_work", "SELECT 'm9' AS model, w AS \"window\", sd AS seed FROM (SELECT unnest([20, 50, 100]) AS w), (SELECT unnest([0, 1, 2]) AS sd)")(lambda s, d: splits.pending_work(_grid(s, d), ledger(s, d), ["model", "window", "seed"]).select("model", "window", "seed"))
query("e34_status_summary", f"WITH {LEDGER} SELECT 'OK' AS status, count(*) AS runs, count(*) FILTER (val_acc = 'Error') AS unreadable FROM ledger")(lambda s, d: metrics.status_summary(ledger(s, d).withColumn("status", F.lit("OK"))))
query("e35_seed_statistics", f"WITH {LEDGER} SELECT model, \"window\", count(*) AS seeds, avg(f1) AS mean, stddev_samp(f1) AS std FROM ledger GROUP BY ALL")(lambda s, d: metrics.seed_statistics(ledger(s, d), ["model", "window"], "f1"))
query("g4_best_window_per_model", f"WITH {LEDGER} SELECT model, arg_max(\"window\", (f1, -\"window\")) AS \"window\", max(f1) AS f1 FROM ledger GROUP BY model")(lambda s, d: metrics.best_window_per_model(ledger(s, d), "f1"))
query("g5_latest_result_per_key", f"WITH {LEDGER} SELECT model, max(file) AS file FROM ledger GROUP BY model")(lambda s, d: flows.latest_per_key(ledger(s, d), ["model"], "file").select("model", "file"))

# --- anomalies: a user's values in order of time
SCORED = "scored AS (SELECT event_id, user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS energy, CAST(event_id % 17 < 5 OR event_type = 'error' AS INT) AS gt FROM events)"
_ADJ = "a0 AS (SELECT *, coalesce(CAST(gt <> lag(gt) OVER w AS INT), 0) AS ch FROM pr WINDOW w AS (PARTITION BY series ORDER BY step)), a1 AS (SELECT *, sum(ch) OVER (PARTITION BY series ORDER BY step) AS run FROM a0), adj AS (SELECT *, CASE WHEN gt = 1 AND step > 1 THEN max(pred) OVER (PARTITION BY series, run) ELSE pred END AS adjusted FROM a1)"


def scored(s, d):
    e = table(s, d, "events")
    w = series.Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", F.col("user_id").alias("series"), F.row_number().over(w).alias("step"), F.col("value").alias("energy"), ((F.col("event_id") % 17 < 5) | (F.col("event_type") == "error")).cast("int").alias("gt"))


query("f11_point_adjust", f"WITH {SCORED}, pr AS (SELECT *, CAST(energy > 400 AS INT) AS pred FROM scored), {_ADJ} SELECT event_id, adjusted FROM adj")(
    lambda s, d: metrics.point_adjust(scored(s, d).withColumn("pred", (F.col("energy") > 400).cast("int")), "series", "step").select("event_id", "adjusted")
)
query("g6_anomaly_threshold", f"WITH {SCORED} SELECT quantile_cont(energy, 0.9) AS threshold FROM scored")(lambda s, d: metrics.anomaly_threshold(scored(s, d), "energy", 10))
query("h3_concat_energy", f"WITH {SCORED} SELECT count(*) AS n, quantile_cont(e, 0.9) AS threshold FROM (SELECT energy AS e FROM scored WHERE series % 2 = 0 UNION ALL SELECT energy FROM scored WHERE step % 2 = 0)")(
    lambda s, d: (lambda x: x.where("series % 2 = 0").select("energy").unionAll(x.where("step % 2 = 0").select("energy")).transform(lambda e: e.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(metrics.anomaly_threshold(e, "energy", 10)))))(scored(s, d))
)
query("j18_reconstruction_energy", f"WITH {PAIRS} SELECT series, step, (truth - pred) ** 2 AS energy FROM pairs")(lambda s, d: metrics.reconstruction_energy(pairs(s, d).withColumnsRenamed({"truth": "x", "pred": "x_hat"}), ["series", "step"]))
query("j19_anomaly_report", f"WITH {SCORED}, th AS (SELECT quantile_cont(energy, 0.9) AS th FROM scored), pr AS (SELECT scored.*, CAST(energy > th AS INT) AS pred FROM scored, th), {_ADJ}, c AS (SELECT count(*) FILTER (adjusted = 1 AND gt = 1) AS tp, count(*) FILTER (adjusted = 1 AND gt = 0) AS fp, count(*) FILTER (adjusted = 0 AND gt = 1) AS fn, avg(CAST(adjusted = gt AS INT)) AS acc FROM adj) SELECT th AS threshold, acc AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c, th")(
    lambda s, d: metrics.anomaly_report(scored(s, d), "series", "step", "energy", 10)
)

# --- series: the embeddings as series of 64 steps
VEC = "vec AS (SELECT vec_id AS series, label, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(0, 64)) AS step, embedding FROM embeddings)"


def vectors(s, d):
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("series"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("step", "value"))
    return e


query("f4_supervised_windows", f"WITH {VEC}, w AS (SELECT series, step, list(value) OVER (PARTITION BY series ORDER BY step ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS x, list(value) OVER (PARTITION BY series ORDER BY step ROWS BETWEEN 12 FOLLOWING AND 19 FOLLOWING) AS y FROM vec) SELECT series, step AS start, round(list_sum(x), 6) AS sx, round(list_sum(y), 6) AS sy FROM w WHERE len(x) = 16 AND len(y) = 8 AND step % 4 = 0")(
    lambda s, d: (lambda t: t.select("series", "start", *[F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(n) for c, n in (("seq_x", "sx"), ("seq_y", "sy"))]))(series.supervised_windows(vectors(s, d), 16, 4, 4, 4))
)
_MA = "ma AS (SELECT a.series, a.step, avg(b.value) AS trend FROM (SELECT series, step, unnest([greatest(0, least(63, step + o)) FOR o IN range(-2, 3)]) AS at FROM vec) a JOIN vec b ON a.series = b.series AND a.at = b.step GROUP BY ALL)"
query("f5_moving_average", f"WITH {VEC}, {_MA} SELECT series, step, round(trend, 9) AS trend FROM ma")(lambda s, d: series.moving_average(vectors(s, d), 5).select("series", "step", F.round("trend", 9).alias("trend")))
query("f6_decompose", f"WITH {VEC}, {_MA} SELECT series, step, round((trend + value) / 2, 9) AS trend, round(value - (trend + value) / 2, 9) AS season FROM ma JOIN vec USING (series, step)")(
    lambda s, d: series.decompose(vectors(s, d), [5, 1]).select("series", "step", F.round("trend", 9).alias("trend"), F.round("season", 9).alias("season"))
)
query("f7_revin", f"WITH {VEC} SELECT series, step, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) AS normed, round(value, 6) AS restored FROM vec WINDOW w AS (PARTITION BY series)")(
    lambda s, d: series.revin_inverse(series.revin(vectors(s, d))).select("series", "step", F.round("normed", 6).alias("normed"), (F.round("restored", 6)).alias("restored"))
)
query("f7_revin_last", f"WITH {VEC} SELECT series, step, round((value - max(value) FILTER (step = 63) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) AS normed FROM vec WINDOW w AS (PARTITION BY series)")(lambda s, d: series.revin(vectors(s, d), last=True).select("series", "step", F.round("normed", 6).alias("normed")))
query("j20_instance_norm", f"WITH {VEC} SELECT series, step, round((value - avg(value) OVER w) / sqrt(var_pop(value) OVER w + 1e-5), 6) AS normed FROM vec WINDOW w AS (PARTITION BY series)")(lambda s, d: series.instance_norm(vectors(s, d), "series", "value").select("series", "step", F.round("normed", 6).alias("normed")))


def arrays(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("series"), F.slice(F.col("embedding").cast("array<double>"), 1, (F.col("vec_id") % 60 + 1).cast("int")).alias("values"))


query("f9_insample_last_window", "WITH a AS (SELECT vec_id AS series, list_transform(embedding[1:vec_id % 60 + 1], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings) SELECT series, unnest(range(0, 16)) AS pos, unnest(list_transform(range(0, 16), lambda i: CASE WHEN i < 16 - len(v) THEN 0 ELSE v[len(v) - 15 + i] END)) AS x, unnest(list_transform(range(0, 16), lambda i: CASE WHEN i < 16 - len(v) THEN 0 ELSE 1 END)) AS mask FROM a")(
    lambda s, d: series.insample_last_window(arrays(s, d), 16).select("series", F.posexplode(F.arrays_zip("window", "mask")).alias("pos", "z")).select("series", "pos", F.col("z.window").alias("x"), F.col("z.mask").alias("mask"))
)
query("f10_random_cut_window")(lambda s, d: series.random_cut_window(arrays(s, d), 16, 4, 8, 24, 3).select("series", "cut", *[F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 9).alias(c) for c in ("insample", "insample_mask", "outsample", "outsample_mask")]))
query("f12_lag_autocorrelation", f"WITH {VEC}, c AS (SELECT a.series, (b.step - a.step + 64) % 64 AS lag, avg(a.value * b.value) AS corr FROM vec a JOIN vec b ON a.series = b.series GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(corr, 9) DESC, lag) AS r FROM c) SELECT series, lag, round(corr, 9) AS corr, round(exp(corr - max(corr) OVER w) / sum(exp(corr)) OVER w * exp(max(corr) OVER w), 6) AS weight FROM t WHERE r <= 4 WINDOW w AS (PARTITION BY series)")(
    lambda s, d: fourier.lag_autocorrelation(vectors(s, d), 64, 1.0).select("series", "lag", F.round("corr", 9).alias("corr"), F.round("weight", 6).alias("weight"))
)
query("f13_interpolate_missing", f"WITH {VEC}, v AS (SELECT series, step, CASE WHEN (step * 7 + series) % 5 < 2 THEN NULL ELSE value END AS v FROM vec), n AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS a, last_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER b AS ta, first_value(v IGNORE NULLS) OVER f AS z, first_value(CASE WHEN v IS NOT NULL THEN step END IGNORE NULLS) OVER f AS tz FROM v WINDOW b AS (PARTITION BY series ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY series ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT series, step, round(coalesce(v, a + (z - a) * (step - ta) / (tz - ta), a, z), 9) AS value FROM n")(
    lambda s, d: series.interpolate_missing(vectors(s, d).withColumn("value", F.when((F.col("step") * 7 + F.col("series")) % 5 < 2, float("nan")).otherwise(F.col("value"))), "series", "step", "value").select("series", "step", F.round("value", 9).alias("value"))
)
query("f14_adf_statistic")(lambda s, d: series.adf_statistic(vectors(s, d)).select("series", F.round("statistic", 9).alias("statistic")))
_DFT = f"{VEC}, sp AS (SELECT series, f, sum(value * cos(2 * pi() * ((f * step) % 64) / 64)) AS re, sum(-value * sin(2 * pi() * ((f * step) % 64) / 64)) AS im FROM vec, (SELECT unnest(range(1, 33)) AS f) GROUP BY ALL)"
query("g3_topk_periods", f"WITH {_DFT} SELECT f AS freq, round(avg(sqrt(re ** 2 + im ** 2)), 6) AS amplitude, 64 // f AS period FROM sp GROUP BY f ORDER BY round(avg(sqrt(re ** 2 + im ** 2)), 9) DESC, f LIMIT 5")(lambda s, d: fourier.topk_periods(vectors(s, d), 64, 5).select("freq", F.round("amplitude", 6).alias("amplitude"), "period"))
query("j13_dft_decompose", f"WITH {_DFT}, t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(sqrt(re ** 2 + im ** 2), 9) DESC, f) AS r FROM sp) SELECT v.series, v.step, round(sum(CASE WHEN f = 32 THEN 1 ELSE 2 END / 64 * (re * cos(2 * pi() * ((f * step) % 64) / 64) - im * sin(2 * pi() * ((f * step) % 64) / 64))), 6) AS season FROM vec v JOIN t ON t.series = v.series AND r <= 5 GROUP BY ALL")(
    lambda s, d: fourier.dft_decompose(vectors(s, d), 64, 5).select("series", "step", F.round("season", 6).alias("season"))
)
query("j14_multi_scale_downsample", f"WITH {VEC} SELECT series, l AS level, step // CAST(3 ** l AS BIGINT) AS step, round(avg(value), 9) AS value FROM vec, (SELECT unnest([0, 1, 2]) AS l) WHERE (step // CAST(3 ** l AS BIGINT) + 1) * CAST(3 ** l AS BIGINT) <= 64 GROUP BY ALL")(
    lambda s, d: series.multi_scale_downsample(vectors(s, d), 3, 2).select("series", "level", "step", F.round("value", 9).alias("value"))
)
query("j15_patch_series", "WITH a AS (SELECT vec_id AS series, list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(range(0, 8), lambda i: CAST(embedding[64] AS DOUBLE))) AS v FROM embeddings) SELECT series, patch, pos, v[patch * 8 + pos + 1] AS value FROM a, (SELECT unnest(range(0, 8)) AS patch), (SELECT unnest(range(0, 16)) AS pos)")(
    lambda s, d: series.patch_series(table(s, d, "embeddings").select(F.col("vec_id").alias("series"), F.col("embedding").cast("array<double>").alias("values")), 16, 8, 8).select("series", F.posexplode("patches").alias("patch", "p")).select("series", "patch", F.posexplode("p").alias("pos", "value"))
)
_H = "sqrt(0.5)"
query("j16_haar_dwt", f"WITH {VEC}, l1 AS (SELECT series, step // 2 AS step, sum(value * {_H}) AS a, sum(CASE WHEN step % 2 = 0 THEN value ELSE -value END * {_H}) AS d FROM vec GROUP BY ALL), l2 AS (SELECT series, step // 2 AS step, sum(a * {_H}) AS a, sum(CASE WHEN step % 2 = 0 THEN a ELSE -a END * {_H}) AS d FROM l1 GROUP BY ALL) SELECT series, 1 AS level, 'd' AS band, step, round(d, 6) AS value FROM l1 UNION ALL SELECT series, 2, 'd', step, round(d, 6) FROM l2 UNION ALL SELECT series, 2, 'a', step, round(a, 6) FROM l2")(
    lambda s, d: series.haar_dwt(vectors(s, d), 2).select("series", "level", "band", "step", F.round("value", 6).alias("value"))
)
query("j16_haar_idwt", f"WITH {VEC} SELECT series, step, round(value, 6) AS value FROM vec")(lambda s, d: series.haar_idwt(series.haar_dwt(vectors(s, d), 3), 3).select("series", "step", F.round("value", 6).alias("value")))
query("j17_random_mask")(lambda s, d: series.random_mask(vectors(s, d), 0.25, 5).select("series", "step", "mask", "masked"))
