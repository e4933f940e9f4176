"""Queries of audits, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators import flows, groups, quality, slots, splits
from flowkit.operators.components import numbered
from flowkit.plans.flow_queries import K, background, biflows, dense, eligible, sparse
from flowkit.plans.packets import DAY_NS, DENSE, FLOWS, HORIZON_NS, KEY, PK, packets, raw_packets, slots_sql, table
from flowkit.plans.registry import query

_Z = " + ".join(f"count(*) FILTER (f{k} = 0)" for k in range(8))
_EMPTY = " AND ".join(f"f{k} = 0" for k in range(8))
query("e11_zero_ratio", f"WITH {DENSE} SELECT count(*) // 10 AS flows, ({_Z}) / (count(*) * 8) AS zero_ratio, count(*) FILTER ({_EMPTY}) AS all_zero_slots, min(least(f0, f1, f2, f3, f4, f5, f6, f7)) AS min, max(greatest(f0, f1, f2, f3, f4, f5, f6, f7)) AS max FROM dense")(
    lambda s, d: quality.zero_ratio(sparse(s, d), 10, 86400.0)
)
query("e12_nonempty_slots", f"WITH {slots_sql()} SELECT avg(n) AS mean_slots, avg(n) * 10 AS percent FROM (SELECT {KEY}, count(*) AS n FROM s GROUP BY ALL)")(lambda s, d: quality.nonempty_slots(sparse(s, d), 10))


def _zero_table(s, d):
    rows = None
    for days in (3, 9):
        p = flows.eligible_packets(background(s, d), days * DAY_NS, 5)
        for w in (1, 3):
            n = days // w + 1
            one = quality.zero_ratio(slots.slot_features(p, w * DAY_NS, days * DAY_NS), n, w * 86400.0, slots.THREE).select(F.lit(w).alias("window"), F.lit(days).alias("duration"), "zero_ratio")
            rows = one if rows is None else rows.unionByName(one)
    return quality.zero_ratio_pivot(rows, [3, 9])


def _zero_sql(days: int, w: int) -> str:
    n, h = days // w + 1, days * DAY_NS
    return f"SELECT {w} AS w, 1 - sum(nz) / (count(DISTINCT ({KEY})) * {3 * n}) AS z FROM (SELECT {KEY}, least(elapsed_ns // {w * DAY_NS}, {n - 1}) AS slot, CAST(count(*) FILTER (fwd) > 0 AS INT) + CAST(count(*) FILTER (NOT fwd) > 0 AS INT) + CAST(sum(CASE WHEN fwd THEN payload ELSE 0 END) > 0 AND sum(CASE WHEN fwd THEN 0 ELSE payload END) > 0 AS INT) AS nz FROM fp WHERE packets_full >= 5 AND duration_ns > {h} AND elapsed_ns <= {h} GROUP BY ALL)"


query("e13_zero_ratio_pivot", f"WITH {FLOWS}, a AS ({_zero_sql(3, 1)} UNION ALL {_zero_sql(3, 3)}), b AS ({_zero_sql(9, 1)} UNION ALL {_zero_sql(9, 3)}) SELECT a.w AS \"window\", a.z AS \"3\", b.z AS \"9\" FROM a JOIN b USING (w)")(_zero_table)
_SUM = " + ".join(f"f{k}" for k in range(8))
query("e14_sum_per_sample", f"WITH {DENSE} SELECT {KEY}, sum({_SUM}) AS total, avg({_SUM}) AS mean FROM dense GROUP BY ALL")(lambda s, d: quality.sum_per_sample(dense(s, d)))
query("e15_quality_profile", f"WITH {DENSE} SELECT count(*) AS rows, 0 AS nan, 0 AS inf, 0 AS negative, 0 AS missing FROM dense")(lambda s, d: quality.quality_profile(dense(s, d)))
_MS = [20, 30, 50, 75, 150]
query("e16_slot_mismatch_audit", f"WITH {FLOWS}, w AS (SELECT unnest({_MS}) AS w_ms) SELECT w_ms, count(*) AS packets, count(*) FILTER (least(elapsed_ns // (w_ms * 1000000), 777600000 // w_ms) <> least(CAST(trunc(elapsed_ns / 1e9 / (w_ms / 1000)) AS BIGINT), 777600000 // w_ms)) AS misplaced FROM el, w GROUP BY w_ms")(
    lambda s, d: quality.slot_mismatch_audit(eligible(s, d), _MS, HORIZON_NS // 1_000_000)
)
query("e17_boundary_adjacency", f"WITH {FLOWS} SELECT count(*) FILTER (elapsed_ns % 20000000 = 0) AS exactly, count(*) FILTER (elapsed_ns % 20000000 = 19999000) AS below, count(*) FILTER (elapsed_ns % 20000000 = 1000) AS above FROM el")(lambda s, d: quality.boundary_adjacency(eligible(s, d), 20_000_000))
query("e18_window_invariance", f"WITH {FLOWS} SELECT count(DISTINCT ({KEY})) AS flows, 0 AS varying, count(*) AS packets, sum(payload) AS payload FROM el")(
    lambda s, d: quality.window_invariance(slots.slot_features_multi(eligible(s, d), [DAY_NS // 4, DAY_NS, 3 * DAY_NS], HORIZON_NS))
)
query("e19_timestamp_precision_profile", f"WITH {PK}, f AS (SELECT rtrim(strftime(ts, '%f'), '0') AS f FROM pk) SELECT 9 AS digits, count(*) AS rows, max(length(f)) AS finest, 0 AS sub_us FROM f")(lambda s, d: quality.timestamp_precision_profile(raw_packets(s, d)))
query("e36_inline_assert", f"WITH {slots_sql()} SELECT 'counts' AS name, 0 AS failures, 'PASS' AS verdict UNION ALL SELECT 'forward', count(*) FILTER (f1 = 0), CASE WHEN count(*) FILTER (f1 = 0) = 0 THEN 'PASS' ELSE 'FAIL' END FROM s")(
    lambda s, d: quality.check_table(sparse(s, d), {"counts": F.col("f1") + F.col("f4") >= 1, "forward": F.col("f1") > 0})
)


def _float_slots(s, d):
    p = eligible(s, d).withColumn("slot", scalar.slot_naive_division(F.col("elapsed_ns"), F.lit(86_400_000)))
    return p.groupBy(*K, "slot").agg(F.count(F.lit(1)).alias("n"), F.sum("payload").alias("size"))


def _exact_slots(s, d):
    return sparse(s, d).select(*K, "slot", (F.col("f1") + F.col("f4")).cast("long").alias("n"), (F.col("f0") + F.col("f3")).alias("size"))


query("d9_compare_implementations", f"WITH {slots_sql()} SELECT 0 AS only_a, 0 AS only_b, count(*) AS common, 0 AS n_differs, 0.0 AS size_max_diff, 0 AS size_beyond FROM s")(lambda s, d: quality.compare_implementations(_exact_slots(s, d), _float_slots(s, d), [*K, "slot"], ["n"], {"size": 1e-6}))
_TWO = f"{FLOWS}, a AS (SELECT * FROM flows WHERE packets >= 5), b AS (SELECT * EXCLUDE (app), CASE WHEN packets % 7 = 0 THEN 'x' ELSE app END AS app FROM flows WHERE duration_ns > {HORIZON_NS})"


def _two(s, d):
    f = biflows(s, d)
    return f.where("packets >= 5"), f.where(F.col("duration_ns") > HORIZON_NS).withColumn("app", F.when(F.col("packets") % 7 == 0, "x").otherwise(F.col("app")))


query("d6_common_population", f"WITH {_TWO} SELECT {KEY}, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS \"where\" FROM (SELECT {KEY}, 1 AS k FROM a) a FULL JOIN (SELECT {KEY}, 1 AS k FROM b) b USING ({KEY})")(lambda s, d: quality.common_population(*_two(s, d), K))
query("d7_field_disagreement", f"WITH {_TWO}, j AS (SELECT a.app, a.packets, b.app AS app2, b.packets AS packets2 FROM a JOIN b USING ({KEY})) SELECT 'app' AS \"column\", count(*) FILTER (app IS DISTINCT FROM app2) AS mismatches FROM j UNION ALL SELECT 'packets', count(*) FILTER (packets IS DISTINCT FROM packets2) FROM j")(
    lambda s, d: quality.field_disagreement(*_two(s, d), K, ["app", "packets"])
)
query("h1_intersect_keys", f"WITH {_TWO} SELECT capture_id FROM a INTERSECT SELECT capture_id FROM b")(lambda s, d: (lambda a, b: a.select("capture_id").intersect(b.select("capture_id")))(*_two(s, d)))
query("h1_except_keys", f"WITH {_TWO} SELECT capture_id FROM a EXCEPT ALL SELECT capture_id FROM b")(lambda s, d: (lambda a, b: a.select("capture_id").exceptAll(b.select("capture_id")))(*_two(s, d)))
query("h2_union_captures", f"WITH {PK} SELECT part, count(*) AS n FROM pk GROUP BY part")(
    lambda s, d: (lambda p: p.where("part = 'p0'").unionByName(p.where("part = 'p1'")).unionByName(p.where("part = 'p2'")).groupBy("part").agg(F.count(F.lit(1)).alias("n")))(packets(s, d))
)
query("h4_multiset_equal", f"WITH {slots_sql()} SELECT 0 AS only_a, 0 AS only_b, TRUE AS equal")(lambda s, d: quality.multiset_equal(_exact_slots(s, d), _float_slots(s, d)))
query("d14_hash_drift", "SELECT 'n' || n_nationkey AS file, CASE WHEN n_nationkey % 5 = 0 THEN 'MISSING' WHEN n_nationkey % 7 = 0 THEN 'CHANGED' ELSE 'OK' END AS status FROM nation")(
    lambda s, d: (
        lambda n: quality.hash_drift(n.select("file", F.sha2("n_name", 256).alias("sha256")), n.where("n_nationkey % 5 <> 0").select("file", F.when(F.col("n_nationkey") % 7 == 0, "x").otherwise(F.sha2("n_name", 256)).alias("sha256")))
    )(table(s, d, "nation").withColumn("file", F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
)

ROWS = """rows AS (SELECT o_orderkey AS row, o_orderstatus || o_orderpriority || strftime(o_orderdate, '%Y-%m') || CAST(floor(o_totalprice / 10000) AS BIGINT) AS h1, o_orderpriority || strftime(o_orderdate, '%Y-%m-%d') || CAST(floor(o_totalprice / 2000) AS BIGINT) AS h2, o_custkey % 4 AS label, o_custkey % 50 AS grp FROM orders)"""


def order_rows(s, d):
    o = table(s, d, "orders")
    h1 = F.concat("o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM"), F.floor(F.col("o_totalprice") / 10000).cast("string"))
    h2 = F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.floor(F.col("o_totalprice") / 2000).cast("string"))
    return o.select(F.col("o_orderkey").alias("row"), h1.alias("h1"), h2.alias("h2"), (F.col("o_custkey") % 4).alias("label"), (F.col("o_custkey") % 50).alias("grp"))


query("e20_duplicate_profile", f"WITH {ROWS}, g AS (SELECT h1, count(*) AS n, count(DISTINCT label) AS l FROM rows GROUP BY h1), s AS (SELECT h1, label, count(*) AS n FROM rows GROUP BY ALL) SELECT sum(n) AS rows, count(*) FILTER (n > 1) AS groups, sum(n) FILTER (n > 1) AS dup_rows, max(n) AS largest, count(*) FILTER (l > 1) AS conflicts, 100 * sum(n) FILTER (n > 1) / sum(n) AS percent, (SELECT sum(n) FILTER (n > 1) FROM s) AS dup_same_label FROM g")(
    lambda s, d: groups.duplicate_profile(order_rows(s, d), "h1")
)
query("e21_group_size_histogram", f"WITH {ROWS}, g AS (SELECT h1, count(*) AS size, count(DISTINCT label) AS l FROM rows GROUP BY h1) SELECT size, count(*) AS groups, count(*) FILTER (l > 1) AS mixed FROM g GROUP BY size")(lambda s, d: groups.group_size_histogram(order_rows(s, d), "h1"))
query("e22_label_digest", f"WITH {ROWS} SELECT count(*) AS rows, sha256(string_agg(label, ',' ORDER BY row)) AS digest FROM rows")(lambda s, d: groups.label_digest(order_rows(s, d), "row", "label"))
query("e22_label_fingerprint")(lambda s, d: groups.label_fingerprint(order_rows(s, d), "row", "label"))
query("f8_occurrence_number", f"WITH {ROWS} SELECT row, row_number() OVER (PARTITION BY label, h1 ORDER BY row) AS occurrence FROM rows")(lambda s, d: groups.occurrence_number(order_rows(s, d), ["label", "h1"], "row").select("row", "occurrence"))
query("d5_align_by_content", f"WITH {ROWS}, a AS (SELECT row, label, h1, row_number() OVER (PARTITION BY label, h1 ORDER BY row) AS n FROM rows), b AS (SELECT -row AS row, label, h1, row_number() OVER (PARTITION BY label, h1 ORDER BY -row) AS n FROM rows WHERE row % 11 <> 0) SELECT a.row AS new_row, b.row AS live_row FROM a FULL JOIN b USING (label, h1, n)")(
    lambda s, d: (lambda r: groups.align_by_content(r, r.where("row % 11 <> 0").withColumn("row", -F.col("row")), ["label", "h1"], "row"))(order_rows(s, d))
)
query(
    "i6_duplicate_groups",
    "WITH RECURSIVE " + ROWS + ", e AS (SELECT a.row AS a, b.row AS b FROM rows a JOIN (SELECT h1, min(row) AS row FROM rows GROUP BY h1) b USING (h1) UNION SELECT a.row, b.row FROM rows a JOIN (SELECT h2, min(row) AS row FROM rows GROUP BY h2) b USING (h2)), l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), reach(a, b) AS (SELECT row, row FROM rows UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a AS row, min(b) AS \"group\" FROM reach GROUP BY a",
)(lambda s, d: groups.duplicate_groups(order_rows(s, d), "row", ["h1", "h2"]))
query("i7_ambiguous_groups", f"WITH {ROWS} SELECT row FROM rows WHERE (label, h1) IN (SELECT (label, h1) FROM rows GROUP BY label, h1 HAVING count(DISTINCT grp) > 1)")(lambda s, d: groups.ambiguous_groups(order_rows(s, d), ["label", "h1"], "grp").select("row"))
query("d13_leaked_duplicates", f"WITH {ROWS} SELECT count(*) AS rows, count(*) FILTER (hit) AS leaked, count(*) FILTER (hit) / count(*) AS share FROM (SELECT EXISTS (SELECT 1 FROM rows t WHERE t.row % 5 <> 0 AND t.h1 = v.h1 AND t.label = v.label) AS hit FROM rows v WHERE v.row % 5 = 0)")(
    lambda s, d: (lambda r: groups.leaked_duplicates(r.where("row % 5 <> 0"), r.where("row % 5 = 0"), ["h1", "label"]))(order_rows(s, d))
)
query("c17_row_content_hash", "SELECT o_orderkey, sha256(concat_ws('|', CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR), CAST(CAST(o_orderkey % 7 AS DOUBLE) AS VARCHAR))) AS hash FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", scalar.row_content_hash([F.col("o_custkey").cast("double"), (F.col("o_orderkey") % 7).cast("double")]).alias("hash"))
)

F_ = f"{FLOWS}, c AS (SELECT app AS label, count(*) AS n FROM flows GROUP BY app), t AS (SELECT CAST(ceil(round(sum(n) * 0.3, 9)) AS BIGINT) AS total, sum(n) AS al FROM c), q AS (SELECT label, n, floor(total * n / al) AS base, round(total * n / al - floor(total * n / al), 9) AS rest, total FROM c, t), quota AS (SELECT label, n, CAST(base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"


def labelled(s, d):
    return biflows(s, d).withColumn("id", F.concat_ws("|", *[F.col(c).cast("string") for c in K])).withColumnRenamed("app", "label")


def held_out(s, d):
    return splits.stratified_holdout(labelled(s, d), "id", "label", 0.3, 7)


query("i1_stratified_holdout", f"WITH {F_} SELECT label, 'val' AS side, quota AS n FROM quota UNION ALL SELECT label, 'train', n - quota FROM quota")(lambda s, d: held_out(s, d).groupBy("label", "side").agg(F.count(F.lit(1)).alias("n")))
query("i1_members")(lambda s, d: held_out(s, d).select("id", "side"))
query("i2_capture_holdout", f"WITH {FLOWS} SELECT count(*) AS flows, 0 AS straddling FROM flows")(
    lambda s, d: splits.capture_holdout(labelled(s, d), "capture_id", "label", 0.3, 7).withColumn("k", F.count(F.lit(1)).over(splits.Window.partitionBy("id"))).agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("k") > 1).alias("straddling"))
)
GROUPS = f"{FLOWS}, gr AS (SELECT 'c' || (CAST(replace(capture_id, 'cap_', '') AS BIGINT) % 9) AS label, 'g' || (CAST(replace(capture_id, 'cap_', '') AS BIGINT) // 9 % 6) AS grp, count(*) AS n FROM flows GROUP BY ALL)"


def group_sizes(s, d):
    u = F.replace(F.col("capture_id"), F.lit("cap_"), F.lit("")).cast("long")
    return biflows(s, d).groupBy(F.concat(F.lit("c"), (u % 9).cast("string")).alias("label"), F.concat(F.lit("g"), (scalar.integer_div(u, F.lit(9)) % 6).cast("string")).alias("group")).agg(F.count(F.lit(1)).alias("n"))


query(
    "i3_grouped_exhaustive_split",
    f"""WITH {GROUPS}, o AS (SELECT label, list(grp ORDER BY grp) AS g, list(n ORDER BY grp) AS ns, sum(n) AS total, count(*) AS k FROM gr GROUP BY label),
    m AS (SELECT *, unnest(range(1, 1 << k)) AS mask FROM o), v AS (SELECT *, list_filter(g, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS names, list_sum(list_filter(ns, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS v FROM m WHERE mask < (1 << k) - 1),
    f AS (SELECT *, round(abs(v / total - 0.2), 12) AS diff FROM v WHERE total - v >= 3), a AS (SELECT label, arg_min(names, (diff, len(names), names)) AS names, arg_min(v / total, (diff, len(names), names)) AS share FROM f WHERE v >= 2 GROUP BY label), b AS (SELECT label, arg_min(names, (diff, len(names), names)) AS names, arg_min(v / total, (diff, len(names), names)) AS share FROM f GROUP BY label)
    SELECT o.label, array_to_string(coalesce(a.names, b.names), ',') AS groups, coalesce(a.share, b.share) AS share, a.names IS NULL AS relaxed FROM o LEFT JOIN a USING (label) LEFT JOIN b USING (label)""",
)(lambda s, d: splits.grouped_exhaustive_split(group_sizes(s, d), 0.2, 2, 3).withColumn("groups", F.array_join("groups", ",")))
query("i4_matched_control_split", f"WITH {F_} SELECT label, 'val' AS side, quota AS n FROM quota UNION ALL SELECT label, 'train', n - quota FROM quota")(
    lambda s, d: (lambda r: splits.matched_control_split(r, "id", "label", splits.quotas(r.groupBy("label").agg(F.count(F.lit(1)).alias("n")), 0.3).withColumnRenamed("quota", "n_val"), 11).groupBy("label", "side").agg(F.count(F.lit(1)).alias("n")))(labelled(s, d))
)


def folds(s, d):
    return splits.stratified_group_kfold(labelled(s, d), "capture_id", "label", 5, 3)


query("i5_stratified_group_kfold")(lambda s, d: folds(s, d).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")))
query("i5_pick_fold")(lambda s, d: splits.pick_fold(folds(s, d), "label", 5))
query("i8_split_audit", "SELECT unnest(['coverage', 'overlap', 'straddling', 'both_sides']) AS name, 0 AS failures, 'PASS' AS verdict")(
    lambda s, d: (lambda f: splits.split_audit(f.select("id", F.when(F.col("fold") == 0, "val").otherwise("train").alias("side")), f.select("id", "capture_id", "label"), "id", "capture_id", "label"))(folds(s, d))
)


def _registry(s, d):
    r = order_rows(s, d)
    expected = groups.label_fingerprint(r, "row", "label").first()["fingerprint"]
    return splits.split_registry_load(r.select("row", F.when(F.col("row") % 5 == 0, "val").otherwise("train").alias("side")), r, "row", "label", expected).select("row", "side")


query("i9_split_registry_load", f"WITH {ROWS} SELECT row, CASE WHEN row % 5 = 0 THEN 'val' ELSE 'train' END AS side FROM rows")(_registry)
query("i10_straddling_groups", f"WITH {ROWS}, g AS (SELECT grp, count(DISTINCT row % 5 = 0) AS n FROM rows GROUP BY grp) SELECT count(*) AS groups, count(*) FILTER (n > 1) AS straddling FROM g")(
    lambda s, d: groups.straddling_groups(order_rows(s, d).select(F.col("grp").alias("group"), (F.col("row") % 5 == 0).alias("side")))
)
query("i11_undersample_balance", f"WITH {F_} SELECT label, (SELECT min(n) FROM c) AS n FROM c")(lambda s, d: splits.undersample_balance(labelled(s, d), "id", "label", 5).groupBy("label").agg(F.count(F.lit(1)).alias("n")))
query("i12_label_encode", f"WITH {FLOWS} SELECT {KEY}, dense_rank() OVER (ORDER BY app) - 1 AS code FROM flows")(lambda s, d: splits.label_encode(biflows(s, d), "app").select(*K, "code"))


def _cells(s, d):
    return dense(s, d).select(*K, "slot", F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(f"f{k}").alias("x")) for k in (0, 1, 3)]))).withColumn("train", F.length("capture_id") % 2 == 0)


_CELLS = f"{DENSE}, cells AS (SELECT {KEY}, slot, u.feature, u.x, length(capture_id) % 2 = 0 AS train FROM dense, LATERAL (SELECT unnest([0, 1, 3]) AS feature, unnest([f0, f1, f3]) AS x) u), sc AS (SELECT feature, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS v FROM cells WHERE train GROUP BY feature)"
query("i13_standardize", f"WITH {_CELLS} SELECT {KEY}, slot, feature, round((x - m) / v, 6) AS x FROM cells JOIN sc USING (feature)")(
    lambda s, d: (lambda c: splits.standardize(c, splits.scaler(c.where("train"), ["feature"], "x"), ["feature"], "x").select(*K, "slot", "feature", F.round("x", 6).alias("x")))(_cells(s, d))
)
query("i16_inverse_standardize", f"WITH {_CELLS} SELECT {KEY}, slot, feature, round(x, 6) AS x FROM cells WHERE feature IN (SELECT feature FROM sc)")(
    lambda s, d: (lambda c, f: splits.inverse_standardize(splits.standardize(c, f, ["feature"], "x"), f, ["feature"], "x").select(*K, "slot", "feature", (F.round("x", 6) + 0.0).alias("x")))(*(lambda c: (c, splits.scaler(c.where("train"), ["feature"], "x")))(_cells(s, d)))
)
query("i14_normalise", f"WITH {DENSE} SELECT {KEY}, slot, round((f0 - min(f0) OVER ()) / (max(f0) OVER () - min(f0) OVER () + 2.220446049250313e-16), 6) AS g, round((f0 - avg(f0) OVER w) / (stddev_samp(f0) OVER w + 2.220446049250313e-16), 6) AS p FROM dense WINDOW w AS (PARTITION BY {KEY})")(
    lambda s, d: splits.normalise(splits.normalise(dense(s, d).select(*K, F.struct(*K).alias("id"), "slot", F.col("f0").alias("g"), F.col("f0").alias("p")), "g", "minmax"), "p", "standardization", "id").select(*K, "slot", F.round("g", 6).alias("g"), F.round("p", 6).alias("p"))
)
query("i15_chronological_split", "WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) SELECT event_id, 'train' AS part FROM r WHERE n < 12 UNION ALL SELECT event_id, 'val' FROM r WHERE n >= 8 AND n < 16 UNION ALL SELECT event_id, 'test' FROM r WHERE n >= 12")(
    lambda s, d: splits.chronological_split(table(s, d, "events").withColumn("at", F.struct("ts", "event_id")), "at", (12, 16), 4, "user_id").select("event_id", "part")
)
query("i17_subsample_long", f"WITH {slots_sql()} SELECT {KEY}, slot FROM (SELECT *, count(*) OVER (PARTITION BY {KEY}) AS n FROM s) WHERE n <= 4 OR slot % 2 = 0")(lambda s, d: splits.subsample_long(sparse(s, d).withColumn("id", F.struct(*K)), "id", "slot", 4, 2).select(*K, "slot"))
query("e9_class_counts", f"WITH {FLOWS} SELECT app, count(*) FILTER (v) AS val_rows, count(DISTINCT capture_id) FILTER (v) AS val_captures, count(*) FILTER (NOT v) AS train_rows, count(DISTINCT capture_id) FILTER (NOT v) AS train_captures FROM (SELECT *, packets % 4 = 0 AS v FROM flows) GROUP BY app")(
    lambda s, d: splits.class_counts(biflows(s, d).withColumn("side", F.when(F.col("packets") % 4 == 0, "val").otherwise("train")), "app", "side", "capture_id")
)
query("e10_class_weights", f"WITH {FLOWS} SELECT app, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM flows GROUP BY app")(lambda s, d: splits.class_weights(biflows(s, d), "app"))
query("d3_attach_labels", f"WITH {slots_sql()} SELECT {KEY}, slot, app FROM s JOIN flows USING ({KEY})")(lambda s, d: sparse(s, d).join(biflows(s, d).select(*K, "app"), K).select(*K, "slot", "app"))
query("d4_select_by_ids", f"WITH {FLOWS} SELECT row_pos FROM ends WHERE ({KEY}) IN (SELECT ({KEY}) FROM flows WHERE packets >= 5)")(lambda s, d: background(s, d).join(flows.filter_min_packets(biflows(s, d), 5).select(*K), K, "left_semi").select("row_pos"))
query("h5_side_complement", f"WITH {ROWS} SELECT row FROM rows WHERE row % 5 <> 0")(lambda s, d: (lambda r: splits.side_complement(r, r.where("row % 5 = 0"), "row").select("row"))(order_rows(s, d)))
query("d8_map_split_to_order", f"WITH {ROWS}, b AS (SELECT row, row_number() OVER (ORDER BY h1, row) AS row_b FROM rows) SELECT row_b, CASE WHEN row % 5 = 0 THEN 'val' ELSE 'train' END AS side FROM b")(
    lambda s, d: (
        lambda r: splits.map_split_to_order(r.select("row", F.when(F.col("row") % 5 == 0, "val").otherwise("train").alias("side")), r.select("row", F.col("row").alias("key")), numbered(r.select("h1", F.col("row").alias("key")), "row", "h1", "key").select("row", "key"), ["key"])
    )(order_rows(s, d))
)

# Audits of tables that do differ, so that each count has something to find.


def _orders(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _changed(o):
    key = F.col("o_orderkey")
    kept = o.where(key % 5 != 0).withColumns({"o_custkey": F.when(key % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_totalprice": F.col("o_totalprice") + (key % 3) * 0.25})
    return kept.unionByName(o.where(key % 11 == 0).withColumn("o_orderkey", -key))


_CHANGED = """a AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderstatus AS s FROM orders),
b AS (SELECT k, CASE WHEN k % 7 = 0 THEN c + 1 ELSE c END AS c, p + (k % 3) * 0.25 AS p, s FROM a WHERE k % 5 <> 0 UNION ALL SELECT -k, c, p, s FROM a WHERE k % 11 = 0)"""
query(
    "d9_compare_differences",
    f"""WITH {_CHANGED} SELECT count(*) FILTER (b.k IS NULL) AS only_a, count(*) FILTER (a.k IS NULL) AS only_b, count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS common, count(*) FILTER (a.c <> b.c) AS o_custkey_differs,
    round(max(abs(a.p - b.p)), 6) AS o_totalprice_max_diff, count(*) FILTER (abs(a.p - b.p) > 0.3) AS o_totalprice_beyond FROM a FULL JOIN b ON a.k = b.k""",
)(lambda s, d: (lambda o: quality.compare_implementations(o, _changed(o), ["o_orderkey"], ["o_custkey"], {"o_totalprice": 0.3}).withColumn("o_totalprice_max_diff", F.round("o_totalprice_max_diff", 6)))(_orders(s, d)))
query(
    "h4_multiset_differs",
    """WITH a AS (SELECT o_custkey AS c, o_orderstatus AS s FROM orders), b AS (SELECT o_custkey AS c, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 13 = 0),
    n AS (SELECT c, s, sum(x) AS x FROM (SELECT c, s, 1 AS x FROM a UNION ALL SELECT c, s, -1 FROM b) GROUP BY ALL) SELECT count(*) FILTER (x > 0) AS only_a, count(*) FILTER (x < 0) AS only_b, count(*) FILTER (x <> 0) = 0 AS equal FROM n""",
)(lambda s, d: (lambda o: quality.multiset_equal(o.select("o_custkey", "o_orderstatus"), o.where("o_orderkey % 10 <> 0").unionByName(o.where("o_orderkey % 13 = 0")).select("o_custkey", "o_orderstatus")))(_orders(s, d)))
query(
    "i8_split_audit_failures",
    """WITH r AS (SELECT o_orderkey AS row, o_custkey AS grp, o_orderstatus || o_custkey % 9 AS label FROM orders), sp AS (SELECT row, CASE WHEN row % 5 = 0 THEN 'val' ELSE 'train' END AS side FROM r WHERE row % 101 <> 0 UNION ALL SELECT row, 'val' FROM r WHERE row % 97 = 0),
    j AS (SELECT r.*, side FROM r LEFT JOIN sp USING (row)), c AS (SELECT 'coverage' AS name, count(*) FILTER (side IS NULL) AS failures FROM j
    UNION ALL SELECT 'overlap', count(*) FROM (SELECT row FROM sp GROUP BY row HAVING count(DISTINCT side) > 1) UNION ALL SELECT 'straddling', count(*) FROM (SELECT grp FROM j GROUP BY grp HAVING count(DISTINCT side) > 1)
    UNION ALL SELECT 'both_sides', count(*) FROM (SELECT label FROM j GROUP BY label HAVING count(DISTINCT side) < 2)) SELECT name, failures, CASE WHEN failures = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""",
)(
    lambda s, d: (
        lambda r: splits.split_audit(
            r.where("row % 101 <> 0").select("row", F.when(F.col("row") % 5 == 0, "val").otherwise("train").alias("side")).unionByName(r.where("row % 97 = 0").select("row", F.lit("val").alias("side"))), r, "row", "grp", "label"
        )
    )(_orders(s, d).select(F.col("o_orderkey").alias("row"), F.col("o_custkey").alias("grp"), F.concat("o_orderstatus", (F.col("o_custkey") % 9).cast("string")).alias("label")))
)
query("d12_pending_customers", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(
    lambda s, d: splits.pending_work(table(s, d, "customer").select("c_custkey"), _orders(s, d).select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])
)
