"""Published constants and hand-made edge cases."""

import pytest
from pyspark.sql import functions as F

from flowkit.functions import scalar
from flowkit.operators import augment, clean, flows, metrics, repair, series, slots, splits, warping

MS = (20, 30, 40, 50, 75, 100, 150, 200, 250)


def values(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("seconds", "expected"), [(1, (51, 34, 26, 21, 14, 11, 7, 6, 5)), (3, (151, 101, 76, 61, 41, 31, 21, 16, 13))])
def test_num_slots(spark, seconds, expected):
    assert values(spark, *[scalar.num_slots(F.lit(seconds * 1000), F.lit(w)) for w in MS]) == expected


def test_float_grid(spark):
    assert values(spark, *[scalar.num_slots_float(F.lit(5.0), F.lit(w / 1000)) for w in MS])[0] in (250, 251)
    assert values(spark, scalar.slot_float_floor(F.lit(5.0), F.lit(0.05)), F.floor(F.lit(5.0) / F.lit(0.05))) == (99, 100)


def test_quotas(spark):
    c = spark.createDataFrame([("a", 505), ("b", 604), ("c", 133), ("d", 1179)], "label string, n long")
    assert {r.label: r.quota for r in splits.quotas(c, 0.3).collect()} == {"a": 152, "b": 181, "c": 40, "d": 354}


def test_class_weights(spark):
    n = {"a": 349, "b": 502, "c": 80, "d": 655}
    df = spark.createDataFrame([(k,) for k, m in n.items() for _ in range(m)], "label string")
    assert {r.label: round(r.weight, 6) for r in splits.class_weights(df, "label").collect()} == {"a": 1.136103, "b": 0.789841, "c": 4.95625, "d": 0.605344}


def test_group_choice(spark):
    rows = [("s", "a", 126), ("s", "b", 126), ("s", "c", 1), ("t", "a", 152), ("t", "b", 134), ("t", "c", 1), ("t", "d", 1), ("h", "a", 108), ("h", "b", 8), ("h", "c", 1)]
    g = spark.createDataFrame(rows, "label string, group string, n long")
    size = {(x, y): n for x, y, n in rows}
    found = {r.label: (sum(size[r.label, k] for k in r.groups), r.relaxed) for r in splits.grouped_exhaustive_split(g, 0.2, 20, 50).collect()}
    assert found["h"] == (9, True) and found["s"][0] > 1 and found["t"][0] > 2 and not found["s"][1]


def test_repair(spark):
    df = spark.createDataFrame([(2147483647.0, 1.0, 2147483647.0)], "size double, n double, mean double")
    r = repair.repair_impossible_bytes(df, "size", "n", "mean").first()
    assert (r["size"], r["mean"], r["touched"]) == (65535.0, 65535.0, True)


def test_times(spark):
    ns = lambda t: values(spark, scalar.parse_frame_time_ns(F.lit(t)))[0]
    assert ns("Jan  1, 1970 00:00:00.000000001 UTC") == 1
    assert ns("Jun  5, 2019 07:51:15.381121789 CDT") % 10**9 == 381121789
    assert ns("Dec 31, 1969 23:59:59.999999999 UTC") == -1
    assert ns("nonsense") is None


def test_times_are_parsed_once(spark):
    """The filter by year shares the parsed time: the text is made and cleaned once in the plan, not for each use."""
    from flowkit.plans import catalog

    pk = spark.createDataFrame([(k, t) for k, t in enumerate(["Feb 29, 2024 23:59:59.9 CST", "Dec 31, 2023 23:59:59.999999999 CST", "Jan  1, 2024 00:00:00", "Feb 30, 2024 00:00:00.1 CST", "Apr 3, 2024|07|51|15|3", "nonsense", "", None, "x Apr 3, 2024 07:51:15", "Apr 30, 2024 07:51:15.3811210009 a|b"])], "k long, frame_time string")
    assert sorted((r.k, r.t_ns) for r in clean.reject_bad_timestamps(pk, 2024).collect()) == [(0, 1709251199900000000), (2, 1704067200000000000), (9, 1714463475381121000)]
    plan = catalog.QUERIES["b10_reject_bad_timestamps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 1 and plan.count("try_to_timestamp") == 1


def packet(flow, t, src, n, size=10.0):
    dst = "b" if src == "a" else "a"
    return ("cap", src, 1 if src == "a" else 2, dst, 2 if src == "a" else 1, 6, t, n, size)


def test_boundaries(spark):
    w, horizon = 1_000_000, 5_000_000
    times = [0, w - 1000, w, w + 1000, horizon, horizon + 1]
    pk = spark.createDataFrame([packet(0, t, "a" if k % 2 == 0 else "b", k) for k, t in enumerate(times)], "capture_id string, src string, sport int, dst string, dport int, proto int, t_ns long, row_pos long, payload double")
    p = flows.eligible_packets(clean.canonical_endpoints(pk), horizon, 5)
    s = {r.slot: (r.f1, r.f4) for r in slots.slot_features(p, w, horizon).collect()}
    assert s == {0: (1.0, 1.0), 1: (1.0, 1.0), 5: (1.0, 0.0)}
    assert flows.eligible_packets(clean.canonical_endpoints(pk), horizon + 1, 5).count() == 0
    assert flows.eligible_packets(clean.canonical_endpoints(pk), horizon + 1, 5, strict=False).count() == 6
    assert flows.eligible_packets(clean.canonical_endpoints(pk), horizon, 7).count() == 0


def test_ties_go_by_row(spark):
    pk = spark.createDataFrame([packet(0, 5, "b", 0), packet(0, 5, "a", 1)], "capture_id string, src string, sport int, dst string, dport int, proto int, t_ns long, row_pos long, payload double")
    for parts in (1, 4):
        found = {r.src: r.fwd for r in flows.first_packet_direction(clean.canonical_endpoints(pk.repartition(parts))).collect()}
        assert found == {"a": False, "b": True}


def test_missing_addresses_stay(spark):
    pk = spark.createDataFrame([(None, "x", "4"), ("127.0.0.1", "x", "4"), ("y", None, "abc"), ("y", "127.1.1.1", "0"), ("y", "x", "0")], "src string, dst string, pkttype string")
    assert sorted(str(r.src) for r in clean.filter_background(pk).collect()) == ["None", "y"]


def test_capture_names(spark):
    df = spark.createDataFrame([("timeseries_google-maps_open_2019-04-30_07-51-15_dev1.csv",), ], "name string")
    r = df.select(*[c.alias(n) for n, c in scalar.parse_capture_name(F.col("name")).items()]).first()
    assert (r.app, r.action, r.date, r.device) == ("google-maps", "open", "2019-04-30", "dev1")
    with pytest.raises(Exception, match="not a capture name"):
        spark.createDataFrame([("x.csv",)], "name string").select(scalar.parse_capture_name(F.col("name"))["app"]).collect()


def test_point_adjust(spark):
    gt, pred = [1, 1, 0, 1, 1, 1, 0, 1], [0, 1, 1, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([("s", k, g, p) for k, (g, p) in enumerate(zip(gt, pred, strict=True))], "series string, step int, gt int, pred int")
    found = [r.adjusted for r in metrics.point_adjust(df, "series", "step").orderBy("step").collect()]
    assert found == [0, 1, 1, 1, 1, 1, 0, 0]


def test_adf_against_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    v = np.cumsum(rng.normal(size=80))
    df = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate(v)], "series int, step int, value double")
    d = np.diff(v)
    x = np.column_stack([np.ones(78), v[1:-1], d[:-1]])
    beta, *_ = np.linalg.lstsq(x, d[1:], rcond=None)
    e = d[1:] - x @ beta
    t = beta[1] / np.sqrt((e @ e) / 75 * np.linalg.inv(x.T @ x)[1, 1])
    assert abs(series.adf_statistic(df).first()["statistic"] - t) < 1e-8


def test_warping(spark):
    import numpy as np

    a, b = np.array([[0.0], [1], [2], [3]]), np.array([[0.0], [0], [1], [2], [3], [3]])
    assert warping.dtw_path(a, b)[0] == 0
    d, path = warping.dtw_path(a, b[:5], slope="asymmetric")
    assert [i for i, _ in path] == [0, 1, 2, 3] and d <= 1
    assert warping.dtw_path(a, b, window=0, slope="asymmetric")[0] == float("inf")
    pairs = spark.createDataFrame([([0.0, 1.0, 2.0], [0.0, 2.0, 2.0])], "a array<double>, b array<double>")
    low = pairs.select(warping.lb_keogh("a", "b", 1)).first()[0]
    assert low <= warping.dtw_join(pairs, window=1).first()["distance"]


def test_kernels_by_name(spark):
    augment.register_kernel("total", lambda pdf: pdf.groupby("k", as_index=False)["v"].sum(), "k long, v double")
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "k long, v double")
    assert sorted(tuple(r) for r in augment.apply_kernel(df, "total", "k").collect()) == [(1, 5.0), (2, 4.0)]


@pytest.mark.parametrize("parts", [1, 5, 16])
def test_hashes_do_not_depend_on_partitions(spark, parts):
    df = spark.range(300).select(F.col("id").alias("series"), F.lit(0).alias("step"), F.lit(1.0).alias("value")).repartition(parts)
    assert abs(augment.jitter(df, 1.0, 4).agg(F.sum("value")).first()[0] - augment.jitter(df.coalesce(1), 1.0, 4).agg(F.sum("value")).first()[0]) < 1e-9


def test_splits_are_exact_and_repeatable(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("label"))
    one = {r.id for r in splits.stratified_holdout(df, "id", "label", 0.3, 1).where("side = 'val'").collect()}
    two = {r.id for r in splits.stratified_holdout(df.repartition(9), "id", "label", 0.3, 1).where("side = 'val'").collect()}
    assert one == two and len(one) == 300
