"""Random choices with SQL: drawn from MD5 instead of Spark's own hash, so that the SQL draws the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.functions.scalar import hashed_by, md5_hash
from flowkit.operators import augment, series, splits
from flowkit.plans.audit_queries import F_, labelled
from flowkit.plans.evaluation_queries import VEC, arrays, vectors
from flowkit.plans.packets import FLOWS
from flowkit.plans.registry import query


def drawn(name: str, sql: str):
    """Register a query whose random choices come from MD5."""

    def put(fn: Callable[[SparkSession, str], DataFrame]):
        def run(s: SparkSession, d: str) -> DataFrame:
            with hashed_by(md5_hash):
                return fn(s, d)

        return query(name, sql)(run)

    return put


def bits(seed: int | str, *keys: str) -> str:
    """The 64 bits of md5_hash() without a sign."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join([repr(str(seed)), *(f'CAST({k} AS VARCHAR)' for k in keys)])})), 1, 16) AS UBIGINT)"


def signed(seed: int | str, *keys: str) -> str:
    h = bits(seed, *keys)
    return f"(CAST({h} AS HUGEINT) - CASE WHEN {h} >= 9223372036854775808 THEN 18446744073709551616 ELSE 0 END)"


def uniform(seed: int | str, *keys: str) -> str:
    return f"(CAST({bits(seed, *keys)} >> 11 AS DOUBLE) / 9007199254740992)"


def normal(seed: int, *keys: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(seed, chr(39) + 'u' + chr(39), *keys)})) * cos(2 * 3.141592653589793 * {uniform(seed, chr(39) + 'v' + chr(39), *keys)}))"


def plain(s, d):
    return vectors(s, d).select("series", "step", "value")


_ID = "concat_ws('|', CAST(capture_id AS VARCHAR), CAST(ip_a AS VARCHAR), CAST(port_a AS VARCHAR), CAST(ip_b AS VARCHAR), CAST(port_b AS VARCHAR), CAST(proto AS VARCHAR))"
_MEMBERS = f"WITH {F_}, ids AS (SELECT {_ID} AS id, app AS label FROM flows), nth AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {{hash}}, id) AS nth FROM ids) SELECT id, CASE WHEN nth <= quota THEN 'val' ELSE 'train' END AS side FROM nth JOIN quota USING (label)"
drawn("i1_members_drawn", _MEMBERS.format(hash=bits(7, "id")))(lambda s, d: splits.stratified_holdout(labelled(s, d), "id", "label", 0.3, 7).select("id", "side"))
drawn("i4_members_drawn", _MEMBERS.format(hash=bits(11, "id")))(
    lambda s, d: (lambda r: splits.matched_control_split(r, "id", "label", splits.quotas(r.groupBy("label").agg(F.count(F.lit(1)).alias("n")), 0.3).withColumnRenamed("quota", "n_val"), 11).select("id", "side"))(labelled(s, d))
)
drawn(
    "i2_members_drawn",
    f"""WITH {FLOWS}, caps AS (SELECT DISTINCT capture_id, app AS label FROM flows), c AS (SELECT label, count(*) AS n FROM caps GROUP BY label), t AS (SELECT CAST(ceil(round(sum(n) * 0.3, 9)) AS BIGINT) AS total, sum(n) AS al FROM c),
    q AS (SELECT label, n, floor(total * n / al) AS base, round(total * n / al - floor(total * n / al), 9) AS rest, total FROM c, t), quota AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= total - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q),
    nth AS (SELECT capture_id, label, row_number() OVER (PARTITION BY label ORDER BY {bits(7, "capture_id")}, capture_id) AS nth FROM caps)
    SELECT {_ID} AS id, CASE WHEN nth <= quota THEN 'val' ELSE 'train' END AS side FROM flows JOIN nth USING (capture_id) JOIN quota USING (label)""",
)(lambda s, d: splits.capture_holdout(labelled(s, d), "capture_id", "label", 0.3, 7).select("id", "side"))
drawn(
    "i5_folds_drawn",
    f"""WITH {FLOWS}, per AS (SELECT capture_id, app AS label, count(*) AS n FROM flows GROUP BY ALL), main AS (SELECT capture_id, arg_max(label, (n, label)) AS main, sum(n) AS size FROM per GROUP BY capture_id),
    placed AS (SELECT capture_id, (row_number() OVER (PARTITION BY main ORDER BY size DESC, {signed(3, "capture_id")}, capture_id) - 1) % 10 AS turn FROM main)
    SELECT {_ID} AS id, CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS fold FROM flows JOIN placed USING (capture_id)""",
)(lambda s, d: splits.stratified_group_kfold(labelled(s, d), "capture_id", "label", 5, 3).select("id", F.col("fold").cast("long").alias("fold")))

drawn("j1_jitter_drawn", f"WITH {VEC} SELECT series, step, round(value + 0.03 * {normal(1, 'series', 'step')}, 6) AS value FROM vec")(lambda s, d: augment.jitter(plain(s, d), 0.03, 1).withColumn("value", F.round("value", 6)))
drawn("j1_scaling_drawn", f"WITH {VEC} SELECT series, step, round(value * (1 + 0.1 * {normal(1, 'series')}), 6) AS value FROM vec")(lambda s, d: augment.scaling(plain(s, d), 0.1, 1).withColumn("value", F.round("value", 6)))
drawn(
    "j2_rotation_drawn",
    f"""WITH {VEC}, turned AS (SELECT c, row_number() OVER (ORDER BY {signed(3, "c")}, c) - 1 AS place FROM (SELECT unnest(range(64)) AS c))
    SELECT series, t.c AS channel, value * CASE WHEN {uniform(4, "series", "step")} < 0.5 THEN -1 ELSE 1 END AS value FROM vec JOIN turned t ON t.place = step""",
)(lambda s, d: augment.rotation(plain(s, d).withColumnsRenamed({"step": "channel"}), 64, 3).withColumn("channel", F.col("channel").cast("long")))
_SEGMENTS = """SELECT series, row_number() OVER (PARTITION BY series ORDER BY {hash}, segment, step) - 1 AS step, value FROM cut"""
_COUNT = f"1 + CAST(floor({uniform(3, 'series')} * 4) AS BIGINT)"
drawn("j3_permutation_drawn", f"WITH {VEC}, cut AS (SELECT series, step, value, step * ({_COUNT}) // 64 AS segment FROM vec) {_SEGMENTS.format(hash=signed(4, 'series', 'segment'))}")(
    lambda s, d: augment.permutation(plain(s, d), 64, 5, 3).select("series", F.col("step").cast("long").alias("step"), "value")
)
drawn(
    "j3_permutation_random_drawn",
    f"""WITH {VEC}, s AS (SELECT DISTINCT series, {_COUNT} AS n FROM vec), place AS (SELECT series, n, c, row_number() OVER (PARTITION BY series ORDER BY {signed(5, "series", "c")}, c) AS k FROM s, (SELECT unnest(range(62)) AS c)),
    cut AS (SELECT v.series, step, value, (SELECT count(*) FROM place p WHERE p.series = v.series AND k <= n - 1 AND c <= step) AS segment FROM vec v) {_SEGMENTS.format(hash=signed(4, "series", "segment"))}""",
)(lambda s, d: augment.permutation(plain(s, d), 64, 5, 3, "random").select("series", F.col("step").cast("long").alias("step"), "value"))
_AT = "sampled AS (SELECT series, step, spot, greatest(0, least(CAST(floor(spot) AS BIGINT), 62)) AS lo FROM spots), line AS (SELECT a.series, a.step, round(x.value + (y.value - x.value) * least(greatest(spot - lo, 0), 1), 6) AS value FROM sampled a JOIN vec x ON x.series = a.series AND x.step = lo JOIN vec y ON y.series = a.series AND y.step = lo + 1) SELECT * FROM line"
drawn("j5_window_slice_drawn", f"WITH {VEC}, spots AS (SELECT series, step, floor({uniform(2, 'series')} * 7) + step * 57 / 63.0::DOUBLE AS spot FROM vec), {_AT}")(lambda s, d: augment.window_slice(plain(s, d), 64, 0.9, 2).select("series", "step", F.round("value", 6).alias("value")))
drawn(
    "j5_window_warp_drawn",
    f"""WITH {VEC}, p AS (SELECT series, step, 1 + floor({uniform(2, "series")} * 57) AS start, CASE WHEN {uniform(3, "series")} < 0.5 THEN 0.5 ELSE 2.0 END AS pick FROM vec), t AS (SELECT *, 6 * pick AS long, step * (64 - 6 + 6 * pick - 1) / 63.0::DOUBLE AS t FROM p),
    spots AS (SELECT series, step, least(63.0, CASE WHEN t < start THEN t WHEN t < start + long THEN start + (t - start) / pick ELSE t - long + 6 END) AS spot FROM t), {_AT}""",
)(lambda s, d: augment.window_warp(plain(s, d), 64, 0.1, (0.5, 2.0), 2).select("series", "step", F.round("value", 6).alias("value")))
drawn("j12_augment_rounds_drawn", f"WITH {VEC}, k AS (SELECT unnest([0, 1, 2]) AS copy) SELECT series, step, copy, CASE WHEN copy = 0 THEN 'original' ELSE 'jitter' END AS tag, round(CASE copy WHEN 0 THEN value WHEN 1 THEN value + 0.03 * {normal(1, 'series', 'step')} ELSE value + 0.03 * {normal(2, 'series', 'step')} END, 6) AS value FROM vec, k")(
    lambda s, d: augment.augment_rounds(plain(s, d), 2, lambda x, k: augment.jitter(x, 0.03, k), "jitter").withColumn("value", F.round("value", 6))
)
drawn("j17_random_mask_drawn", f"WITH {VEC}, m AS (SELECT series, step, value, {uniform(5, 'series', 'step')} > 0.25 AS keep FROM vec) SELECT series, step, CAST(keep AS INTEGER) AS mask, CASE WHEN keep THEN value ELSE 0 END AS masked FROM m")(
    lambda s, d: series.random_mask(vectors(s, d), 0.25, 5).select("series", "step", "mask", "masked")
)
drawn(
    "f10_random_cut_window_drawn",
    f"""WITH a AS (SELECT vec_id AS series, list_transform(embedding[1 : vec_id % 60 + 1], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    c AS (SELECT series, v, len(v) AS n, least(greatest(1, len(v) - 24) + CAST(floor({uniform(3, "series")} * (len(v) - greatest(1, len(v) - 24))) AS BIGINT), len(v) - 1) AS cut FROM a),
    w AS (SELECT *, least(cut, 16) AS n_in, least(n - cut + least(cut, 4), 12) AS n_out, greatest(0, cut - 4) AS start FROM c)
    SELECT series, CAST(cut AS INTEGER) AS cut, round(coalesce(list_sum(v[cut - n_in + 1 : cut]), 0), 6) AS insample, CAST(n_in AS DOUBLE) AS insample_mask, round(coalesce(list_sum(v[start + 1 : start + n_out]), 0), 6) AS outsample, CAST(n_out AS DOUBLE) AS outsample_mask FROM w""",
)(lambda s, d: series.random_cut_window(arrays(s, d), 16, 4, 8, 24, 3).select("series", "cut", *[F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6).alias(c) for c in ("insample", "insample_mask", "outsample", "outsample_mask")]))

_MOMENTS = "n, (sxx - sx * sx / n) AS xx, (sxz - sx * sz / n) AS xz, (szz - sz * sz / n) AS zz, (sxy - sx * sy / n) AS xy, (syz - sy * sz / n) AS yz, (syy - sy * sy / n) AS yy"
query(
    "f14_adf_statistic_moments",
    f"""WITH {VEC}, d AS (SELECT series, step, value - lag(value) OVER w AS y, lag(value) OVER w AS x FROM vec WINDOW w AS (PARTITION BY series ORDER BY step)), e AS (SELECT series, y, x, lag(y) OVER (PARTITION BY series ORDER BY step) AS z FROM d),
    m AS (SELECT series, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(z) AS sz, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(x * z) AS sxz, sum(y * y) AS syy, sum(y * z) AS syz, sum(z * z) AS szz FROM e WHERE z IS NOT NULL GROUP BY series),
    c AS (SELECT series, {_MOMENTS} FROM m), b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - yz * xz) / (xx * zz - xz * xz) AS b, (yz * xx - xy * xz) / (xx * zz - xz * xz) AS g FROM c)
    SELECT series, round(b / sqrt((yy - b * xy - g * yz) / (n - 3) * zz / det), 6) AS statistic FROM b""",
)(lambda s, d: series.adf_statistic(vectors(s, d)).select("series", F.round("statistic", 6).alias("statistic")))


def _sql_curve(n: int, sigma: float, knots: int, seed: int) -> str:
    """The smooth curve about 1 of a series: each step weighs the random values at the knots."""
    basis = augment._spline_basis(n, knots + 2)
    rows = "[" + ", ".join("[" + ", ".join(f"{x!r}::DOUBLE" for x in r) + "]" for r in basis.tolist()) + "]"
    at = " + ".join(f"b.w[step + 1][{k + 1}] * (1 + {sigma} * k{k})" for k in range(knots + 2))
    values = ", ".join(f"{normal(seed, 'series', str(k))} AS k{k}" for k in range(knots + 2))
    return f"knots AS (SELECT series, {values} FROM (SELECT DISTINCT series FROM vec)), curve AS (SELECT v.series, v.step, v.value, {at} AS curve FROM vec v JOIN knots USING (series), (SELECT {rows} AS w) b)"


_CURVE = _sql_curve(64, 0.2, 4, 2)
drawn("j4_magnitude_warp_drawn", f"WITH {VEC}, {_CURVE} SELECT series, step, round(value * curve, 6) AS value FROM curve")(lambda s, d: augment.magnitude_warp(plain(s, d), 64, seed=2).select("series", "step", F.round("value", 6).alias("value")))
drawn(
    "j4_time_warp_drawn",
    f"""WITH {VEC}, {_CURVE}, speed AS (SELECT series, step, greatest(curve, 0.01) AS speed FROM curve), run AS (SELECT series, step, sum(speed) OVER (PARTITION BY series ORDER BY step) - first_value(speed) OVER (PARTITION BY series ORDER BY step) AS run FROM speed),
    spots AS (SELECT series, step, run * 63 / max(run) OVER (PARTITION BY series) AS spot FROM run), {_AT}""",
)(lambda s, d: augment.time_warp(plain(s, d), 64, seed=2).select("series", "step", F.round("value", 6).alias("value")))
