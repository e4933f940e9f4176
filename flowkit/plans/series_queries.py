"""Queries of augmentation and warping: rows only where a hash decides, SQL twins where the result is fixed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from flowkit.operators import augment, warping
from flowkit.plans.evaluation_queries import VEC, vectors
from flowkit.plans.packets import PK, packets, table
from flowkit.plans.registry import query
from flowkit.sources import files


def plain(s, d):
    return vectors(s, d).select("series", "step", "value")


def long_arrays(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("series"), "label", F.col("embedding").cast("array<double>").alias("values"))


query("j1_jitter")(lambda s, d: augment.jitter(plain(s, d), 0.03, 1))
query("j1_scaling")(lambda s, d: augment.scaling(plain(s, d), 0.1, 1))
query("j2_rotation", f"WITH {VEC} SELECT series, count(*) AS n, round(sum(abs(value)), 6) AS size FROM vec GROUP BY series")(
    lambda s, d: augment.rotation(plain(s, d).withColumnsRenamed({"step": "channel"}), 64, 3).groupBy("series").agg(F.count_distinct("channel").alias("n"), F.round(F.sum(F.abs("value")), 6).alias("size"))
)
query("j3_permutation", f"WITH {VEC} SELECT series, count(*) AS n, round(sum(value), 6) AS total FROM vec GROUP BY series")(
    lambda s, d: augment.permutation(plain(s, d), 64, 5, 3).groupBy("series").agg(F.count_distinct("step").alias("n"), F.round(F.sum("value"), 6).alias("total"))
)
query("j3_permutation_random", f"WITH {VEC} SELECT series, count(*) AS n, round(sum(value), 6) AS total FROM vec GROUP BY series")(
    lambda s, d: augment.permutation(plain(s, d), 64, 5, 3, "random").groupBy("series").agg(F.count_distinct("step").alias("n"), F.round(F.sum("value"), 6).alias("total"))
)
query("j4_magnitude_warp")(lambda s, d: augment.magnitude_warp(plain(s, d), 64, seed=2))
query("j4_time_warp")(lambda s, d: augment.time_warp(plain(s, d), 64, seed=2))
query("j5_window_slice")(lambda s, d: augment.window_slice(plain(s, d), 64, 0.9, 2))
query("j5_window_warp")(lambda s, d: augment.window_warp(plain(s, d), 64, 0.1, (0.5, 2.0), 2))
query("j6_spawner")(lambda s, d: augment.spawner(long_arrays(s, d), 3))
query("j6_random_guided_warp")(lambda s, d: augment.random_guided_warp(long_arrays(s, d), 3))
query("j6_random_guided_warp_shape")(lambda s, d: augment.random_guided_warp(long_arrays(s, d), 3, shape=5))
query("j7_wdba")(lambda s, d: augment.wdba(long_arrays(s, d), 6, 3))
query("j8_discriminative_guided_warp")(lambda s, d: augment.discriminative_guided_warp(long_arrays(s, d), 8, 3))
query("j8_discriminative_guided_warp_shape")(lambda s, d: augment.discriminative_guided_warp(long_arrays(s, d), 8, 3, shape=5))


def _pairs(s, d):
    return augment.same_class_partner(long_arrays(s, d), 5).select("series", "partner", F.col("values").alias("a"), F.col("partner_values").alias("b"))


query("j7_wdba_class")(lambda s, d: augment.wdba(long_arrays(s, d), None, 3))
query("j9_dtw_join")(lambda s, d: warping.dtw_join(_pairs(s, d)).select("series", "partner", "distance"))
query("j9_dtw_asymmetric")(lambda s, d: warping.dtw_join(_pairs(s, d), slope="asymmetric").select("series", "partner", "distance"))
query("j10_shape_dtw_join")(lambda s, d: warping.dtw_join(_pairs(s, d), shape=5).select("series", "partner", "distance"))
query("j11_dtw_metric", "SELECT count(*) AS pairs, 0.0 AS dtw FROM embeddings")(lambda s, d: (lambda a: warping.dtw_metric(a, a))(long_arrays(s, d).select("series", "values")))
query("j11_dtw_metric_partner")(
    lambda s, d: (lambda p: warping.dtw_metric(p.select("series", F.col("a").alias("values")), p.select("series", F.col("b").alias("values"))).withColumn("dtw", F.round("dtw", 6)))(_pairs(s, d))
)

# Warping in SQL: a recursion over the fronts of each pair, with lists by place in a. The searches take every series whose id
# is divisible by 100 as a query against all others; the other pairs are a series and the next of its class by id.
WINDOW, LIMIT, NEAREST = 8, 6.0, 3
SERIES = "series AS (SELECT vec_id AS series, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
ASKED = "pairs AS (SELECT q.series, p.series AS partner, q.v AS a, p.v AS b FROM series q JOIN series p ON q.series % 100 = 0 AND q.series <> p.series AND len(q.v) = len(p.v))"
NEXT = "pairs AS (SELECT series, partner, a, b FROM (SELECT series, v AS a, lead(series) OVER w AS partner, lead(v) OVER w AS b FROM series WINDOW w AS (PARTITION BY label ORDER BY series)) WHERE partner IS NOT NULL)"


def sql_fronts(pairs: str, cost: str, band: str = "len(a) + len(b)") -> str:
    """warped (series, partner, distance) of pairs; cost is that of places i + 1 and j + 1 of a and b."""
    inf = "CAST('inf' AS DOUBLE)"
    near = "least(two[i + 1], one[i + 1], one[i + 2])"  # cell i of a front is at i + 2, after an infinite one
    step = f"CASE WHEN d + 1 - i BETWEEN 0 AND len(b) - 1 AND abs(d + 1 - 2 * i) <= {band} THEN {cost} + {near} ELSE {inf} END".replace("{j}", "(d + 1 - i)")
    first = f"CASE WHEN i = 0 THEN {cost} ELSE {inf} END".replace("{j}", "0")
    return f"""{SERIES}, {pairs},
walk(series, partner, a, b, d, one, two) AS (
    SELECT series, partner, a, b, CAST(0 AS BIGINT), list_concat([{inf}], list_transform(range(len(a)), lambda i: {first})), list_transform(range(len(a) + 1), lambda i: {inf}) FROM pairs
    UNION ALL
    SELECT series, partner, a, b, d + 1, list_concat([{inf}], list_transform(range(len(a)), lambda i: {step})), one FROM walk WHERE d < len(a) + len(b) - 2),
warped AS (SELECT series, partner, one[len(a) + 1] AS distance, len(a) + len(b) AS steps FROM walk WHERE d = len(a) + len(b) - 2)"""


PLAIN = "abs(a[i + 1] - b[{j} + 1])"
SHAPE = "sqrt(list_sum(list_transform(range(-2, 3), lambda o: pow(a[greatest(1, least(len(a), i + 1 + o))] - b[greatest(1, least(len(b), {j} + 1 + o))], 2))))"


def _asked(s, d):
    series = long_arrays(s, d).select("series", "values")
    return series.where("series % 100 = 0"), series


def _next_of_class(s, d):
    w = Window.partitionBy("label").orderBy("series")
    next_ = long_arrays(s, d).select("series", F.lead("series").over(w).alias("partner"), F.col("values").alias("a"), F.lead("values").over(w).alias("b"))
    return next_.where("partner IS NOT NULL")


query("j9_dtw_within", f"WITH RECURSIVE {sql_fronts(ASKED, PLAIN, str(WINDOW))} SELECT series, partner, round(distance, 6) AS distance FROM warped WHERE distance <= {LIMIT}")(
    lambda s, d: warping.dtw_within(*_asked(s, d), LIMIT, WINDOW, digits=6)
)
query("j9_dtw_nearest", f"WITH RECURSIVE {sql_fronts(ASKED, PLAIN, str(WINDOW))}, placed AS (SELECT series, partner, distance, row_number() OVER (PARTITION BY series ORDER BY distance, partner) AS place FROM warped) SELECT series, partner, round(distance, 6) AS distance, place FROM placed WHERE place <= {NEAREST}")(
    lambda s, d: warping.dtw_nearest(*_asked(s, d), NEAREST, WINDOW).withColumn("distance", F.round("distance", 6))
)
query("j9_dtw_bounds", f"""WITH RECURSIVE {sql_fronts(ASKED, PLAIN, str(WINDOW))},
bounded AS (SELECT series, partner, abs(a[1] - b[1]) + abs(a[len(a)] - b[len(b)]) AS ends, list_sum(list_transform(range(1, len(b) + 1), lambda i: greatest(b[i] - list_max(a[greatest(1, i - {WINDOW}) : i + {WINDOW}]), list_min(a[greatest(1, i - {WINDOW}) : i + {WINDOW}]) - b[i], 0.0))) AS outside FROM pairs)
SELECT series, count(*) AS pairs, count(*) FILTER (ends <= {LIMIT}) AS by_ends, count(*) FILTER (ends <= {LIMIT} AND outside <= {LIMIT}) AS by_envelope, count(*) FILTER (distance <= {LIMIT}) AS "within" FROM bounded JOIN warped USING (series, partner) GROUP BY series""")(
    lambda s, d: warping.dtw_bounds(*_asked(s, d), LIMIT, WINDOW)
)
query("j9_dtw_join_next", f"WITH RECURSIVE {sql_fronts(NEXT, PLAIN)} SELECT series, partner, round(distance, 6) AS distance FROM warped")(
    lambda s, d: warping.dtw_join(_next_of_class(s, d)).select("series", "partner", F.round("distance", 6).alias("distance"))
)
query("j10_shape_dtw_join_next", f"WITH RECURSIVE {sql_fronts(NEXT, SHAPE)} SELECT series, partner, round(distance, 6) AS distance FROM warped")(
    lambda s, d: warping.dtw_join(_next_of_class(s, d), shape=5).select("series", "partner", F.round("distance", 6).alias("distance"))
)
query("j11_dtw_metric_next", f"WITH RECURSIVE {sql_fronts(NEXT, PLAIN)} SELECT count(*) AS pairs, round(avg(distance / steps), 6) AS dtw FROM warped")(
    lambda s, d: (lambda p: warping.dtw_metric(p.select("series", F.col("a").alias("values")), p.select("series", F.col("b").alias("values"))).withColumn("dtw", F.round("dtw", 6)))(_next_of_class(s, d))
)
query("j12_augment_rounds", f"WITH {VEC} SELECT copy, CASE WHEN copy = 0 THEN 'original' ELSE 'jitter' END AS tag, count(*) AS n FROM vec, (SELECT unnest([0, 1, 2]) AS copy) GROUP BY ALL")(
    lambda s, d: augment.augment_rounds(plain(s, d), 2, lambda x, k: augment.jitter(x, 0.03, k), "jitter").groupBy("copy", "tag").agg(F.count(F.lit(1)).alias("n"))
)
query("a15_file_digests")(lambda s, d: files.file_digests(s, d, "*.parquet"))
query("a16_limit_rows_read", f"WITH {PK} SELECT 40 AS n FROM pk LIMIT 1")(lambda s, d: files.limit_rows_read(packets(s, d), 40).agg(F.count(F.lit(1)).alias("n")))
query("a10_read_ragged_series", "SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_custkey % 3 = 0 AND o_totalprice > 100000 GROUP BY o_custkey")(
    lambda s, d: (
        lambda o: files.read_ragged_series(
            o.select("id", "group").distinct(), o.groupBy("id").agg(F.collect_list(F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(float("nan"))).alias("values")), "Yearly"
        ).select("id", F.size("values").cast("long").alias("n")).where("n > 0")
    )(table(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_totalprice", F.when(F.col("o_custkey") % 3 == 0, "Yearly").otherwise("Monthly").alias("group")))
)
