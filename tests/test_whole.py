"""Operators that do the whole job: cases that a cut would lose."""

import hashlib
import math
import re

from pyspark.sql import functions as F

from flowkit.operators import augment, groups, metrics, warping
from flowkit.operators.components import numbered
from flowkit.plans import catalog, series_queries

SF = "/root/testdata/sf0.001"


def warped(a, b):
    d = {(-1, -1): 0.0}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i, j] = abs(x - y) + min(d.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    return d[len(a) - 1, len(b) - 1]


def test_warping_takes_whole_embeddings(spark):
    whole = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r.series: r["values"] for r in series_queries.long_arrays(spark, SF).collect()} == whole
    found = catalog.QUERIES["j9_dtw_join"](spark, SF).collect()
    assert len(found) > 100 and all(r.series != r.partner for r in found)
    by_hand = {r.series: warped(whole[r.series], whole[r.partner]) for r in found}
    assert all(abs(r.distance - by_hand[r.series]) < 1e-6 for r in found)
    one = catalog.QUERIES["j11_dtw_metric_partner"](spark, SF).first()
    again = [warped(whole[r.series], whole[r.partner]) / 128 for r in series_queries.augment.same_class_partner(series_queries.long_arrays(spark, SF), 5).select("series", "partner").collect()]
    assert one.pairs == len(again) and abs(one.dtw - sum(again) / len(again)) < 2e-6 and one.dtw > 0
    for q in ("j6_spawner", "j6_random_guided_warp_shape", "j7_wdba"):
        assert catalog.QUERIES[q](spark, SF).select(F.min(F.size("values"))).first()[0] == 64


def test_guided_warps_are_sliced_by_amount(spark):
    rows = [(k, 0, [float(x) for x in range(10)], a) for k, a in enumerate((0.0, 1.0, 2.0))]
    df = spark.createDataFrame(rows, "series long, label int, values array<double>, amount double")
    found = {r.series: r["values"] for r in augment.variable_slice(df, 1).collect()}
    for k, length in ((0, 9), (1, 10), (2, 10)):  # ceil(10 * (0.9, 0.95, 1))
        v = found[k]
        assert len(v) == 10 and abs(v[-1] - v[0] - (length - 1)) < 1e-9 and abs(v[5] - v[4] - (length - 1) / 9) < 1e-9
    still = augment.variable_slice(df.withColumn("amount", F.lit(0.0)), 1).collect()
    assert all(abs(r["values"][-1] - r["values"][0] - 8) < 1e-9 for r in still)
    two = spark.createDataFrame([(k, k % 2, [float((x * (k + 3)) % 7) for x in range(20)]) for k in range(12)], "series long, label long, values array<double>")
    whole = {r.series: r for r in augment.discriminative_guided_warp(two, 12, 3, slices=False).collect()}
    cut = {r.series: r for r in augment.discriminative_guided_warp(two, 12, 3).collect()}
    assert {k: r.amount for k, r in whole.items()} == {k: r.amount for k, r in cut.items()} and any(whole[k]["values"] != cut[k]["values"] for k in cut)


def test_random_segments(spark):
    df = spark.createDataFrame([(s, k, float(k)) for s in range(40) for k in range(20)], "series long, step int, value double")
    lengths = set()
    v = augment.permutation(df, 20, 5, 3, "random").groupBy("series").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("v")).collect()
    for r in v:
        x = [p["value"] for p in r.v]
        runs = [0, *[k for k in range(1, 20) if x[k] != x[k - 1] + 1], 20]
        assert len(runs) - 1 <= 4 and sorted(x) == [float(k) for k in range(20)]
        lengths |= {b - a for a, b in zip(runs, runs[1:], strict=False)}
    assert len(lengths) > 6  # equal segments have 5, 6, 7, 10 or 20 steps, or sums of them


def test_warping_paths_and_bands(spark):
    import numpy as np

    pairs = spark.createDataFrame([(1, [0.0, 1.0, 5.0], [0.0, 0.0, 5.0])], "series long, a array<double>, b array<double>")
    r = warping.dtw_join(pairs, path=True).first()
    assert r.distance == 1 and [(p.a, p.b) for p in r.path] == warping.dtw_path(np.array([[0.0], [1], [5]]), np.array([[0.0], [0], [5]]))[1]
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=9)
    tables = [spark.createDataFrame([(1, x.tolist())], "series long, values array<double>") for x in (a, b)]
    assert abs(warping.dtw_metric(*tables, band=8).first().dtw - warped(a, b) / 18) < 1e-9
    assert abs(warping.dtw_metric(*tables, band=0).first().dtw - np.abs(a - b).sum() / 18) < 1e-9
    assert abs(warping.dtw_metric(*tables, weight=1e9).first().dtw - np.abs(a - b).sum() / 18) < 1e-9
    assert warping.dtw_metric(*tables, warp=2).first().dtw <= warping.dtw_metric(*tables).first().dtw + 1e-9


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_table_in_one_task(spark):
    for q in ("g6_anomaly_threshold", "h3_concat_energy", "j19_anomaly_report", "e32_latency_summary", "e22_label_digest"):
        assert not re.search(r"percentile|collect_list", plan(catalog.QUERIES[q](spark, SF))), q
    assert not re.search(r"row_number\(\) windowspecdefinition\((?!__part)", plan(catalog.QUERIES["d8_map_split_to_order"](spark, SF)))


def test_places_percentiles_and_digests_by_ranges(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    rows = [(k % 3 or None, int(rng.integers(0, 40)) * 0.5 if k % 11 else None, k, None if k % 7 == 0 else k % 4) for k in range(900)]
    df = spark.createDataFrame(rows, "k long, v double, row long, label long").repartition(7)
    places = {"a": 0.0, "b": 0.137, "c": 0.9, "d": 1.0}
    for key in (None, 1, 2):
        v = [r[1] for r in rows if r[0] == key and r[1] is not None]
        one = metrics.exact_percentiles(df, "v", places, "k").where(F.col("k").eqNullSafe(key)).first()
        assert all(abs(one[c] - np.quantile(v, p)) < 1e-9 for c, p in places.items())
    one = metrics.exact_percentiles(df, "v", places).first()
    assert all(abs(one[c] - np.quantile([r[1] for r in rows if r[1] is not None], p)) < 1e-9 for c, p in places.items())
    assert metrics.exact_percentiles(df.where("v > 1e9"), "v", places).first().c is None
    found = {r.row: r.place for r in numbered(df, "place", "v", "row").collect()}
    by_hand = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    assert found == {r[2]: k + 1 for k, r in enumerate(by_hand)}
    text = ",".join(str(r[3]) for r in rows if r[3] is not None)
    assert tuple(groups.label_digest(df, "row", "label").first()) == (900, hashlib.sha256(text.encode()).hexdigest())
    assert tuple(groups.label_digest(df.limit(0), "row", "label").first()) == (0, hashlib.sha256(b"").hexdigest())


def test_one_scan_and_one_shuffle(spark):
    for q in ("slot_features", "d1_densify_slots", "d2_join_direction_stats"):
        df = catalog.QUERIES[q](spark, SF)
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("FileScan") == 1 and physical.count("Exchange hashpartitioning") == 1 and "Join" not in physical, q


def test_dense_slots(spark):
    from flowkit.operators import slots

    columns = "flow string, slot long, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double, f6 double, f7 double, note string"
    rows = [("a", 1, *[float(k) for k in range(8)], "x"), ("a", 7, *[1.0] * 8, "off"), (None, 0, *[2.0] * 8, "y"), ("b", 9, *[1.0] * 8, "off")]
    found = slots.densify_slots(spark.createDataFrame(rows, columns), 3, 0.5, ("flow",), ("note",))
    assert found.columns == ["flow", "slot", *[f"f{k}" for k in range(7)], "note", "f7"]
    zero = lambda flow, slot: (flow, slot, *[0.0] * 7, None, slot * 0.5)
    want = [zero("a", 0), ("a", 1, *[float(k) for k in range(7)], "x", 0.5), zero("a", 2), (None, 0, *[2.0] * 7, "y", 0.0), zero(None, 1), zero(None, 2), *[zero("b", k) for k in range(3)]]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    directions = spark.createDataFrame([("a", True, 1.0), ("a", None, 5.0), ("a", True, None), (None, False, 2.0)], "flow string, fwd boolean, payload double")
    assert sorted((tuple(r) for r in slots.join_direction_stats(directions, ["flow"]).collect()), key=str) == sorted([("a", 1.0, 2, 0.0, 0), (None, 0.0, 0, 2.0, 1)], key=str)
