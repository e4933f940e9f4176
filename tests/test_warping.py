"""Warping of batches against recursion over the cells, and searches against all pairs."""

import functools
import math

import numpy as np
import pytest

from flowkit.operators import augment, warping


def by_hand(a, b, window=None, slope="symmetric", dist=warping.euclidean):
    moves = {"symmetric": [(1, 1), (1, 0), (0, 1)], "asymmetric": [(1, 0), (1, 1), (1, 2)]}[slope]
    window = max(len(a), len(b)) if window is None else window
    window = max(window, abs(len(a) - len(b))) if slope == "symmetric" else window

    @functools.cache
    def least(i, j):
        if (i, j) == (-1, -1):
            return 0.0
        if i < 0 or j < 0 or abs(i - j) > window:
            return math.inf
        return float(dist(a[i], b[j])) + min(least(i - p, j - q) for p, q in moves)

    return least(len(a) - 1, len(b) - 1)


def ahead_by_hand(a, b, warp, band, weight):
    """The recurrence of look_ahead's docstring, cell by cell."""
    n, m = len(a), len(b)
    c = lambda i, j: float(np.abs(a[i] - b[j]).sum()) if band is None or abs(i - j) <= band else math.inf

    @functools.cache
    def total(i, j):
        if (i, j) == (-1, -1):
            return 0.0
        if i < 0 or j < 0 or c(i, j) == math.inf:
            return math.inf
        aside = [total(i, j - 1), total(i - 1, j)]
        for k in range(2, warp + 1):
            aside.append(total(i - 1, min(j - 1 + k, m - 1)))
            down = min(i - 1 + k, n - 1)
            aside.append(math.inf if j == 0 else c(down, j - 1) if down > i else total(i, j - 1))
        return c(i, j) + min(total(i - 1, j - 1), weight * min(aside))

    return total(n - 1, m - 1)


def series(rng, lengths, channels=1):
    return [np.round(np.cumsum(rng.normal(size=(n, channels)), axis=0), 3) for n in lengths]


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("slope", ["symmetric", "asymmetric"])
@pytest.mark.parametrize("window", [None, 0, 2, 5])
def test_batches(channels, slope, window):
    rng = np.random.default_rng(channels)
    a, b = series(rng, rng.integers(1, 14, 60), channels), series(rng, rng.integers(1, 14, 60), channels)
    found, paths = warping.warp_batch(a, b, window, slope, path=True)
    plain, _ = warping.warp_batch(a, b, window, slope)
    moves = {"symmetric": {(1, 1), (1, 0), (0, 1)}, "asymmetric": {(1, 0), (1, 1), (1, 2)}}[slope]
    for k, d in enumerate(found.tolist()):
        want = by_hand(a[k], b[k], window, slope)
        assert (math.isinf(want) and math.isinf(d) and len(paths[k]) == 0) or abs(d - want) < 1e-9
        assert plain[k] == d
        if len(paths[k]):
            p = [tuple(x) for x in paths[k].tolist()]
            assert p[-1] == (len(a[k]) - 1, len(b[k]) - 1) and p[0][0] == 0
            assert {(x[0] - y[0], x[1] - y[1]) for y, x in zip(p, p[1:], strict=False)} <= moves
            assert abs(sum(warping.euclidean(a[k][i], b[k][j]) for i, j in p) - d) < 1e-9


def test_other_distances_and_empty_series():
    rng = np.random.default_rng(3)
    a, b = series(rng, [5, 0, 7, 4], 2), series(rng, [6, 3, 7, 0], 2)
    found, paths = warping.warp_batch(a, b, dist=lambda x, y: ((x - y) ** 2).sum(axis=-1), path=True)
    assert [math.isinf(x) for x in found] == [False, True, False, True] and len(paths[1]) == 0
    assert abs(found[0] - by_hand(a[0], b[0], dist=lambda x, y: ((x - y) ** 2).sum())) < 1e-9


@pytest.mark.parametrize("warp", [1, 2, 3, 5])
@pytest.mark.parametrize("band", [None, 2, 6])
@pytest.mark.parametrize("weight", [1.0, 1.7, 0.4])
def test_look_ahead(warp, band, weight):
    rng = np.random.default_rng(warp)
    for n, m in ((1, 1), (4, 4), (7, 6), (6, 8), (9, 9)):
        a, b = np.stack(series(rng, [n] * 5, 2)), np.stack(series(rng, [m] * 5, 2))
        found = warping.look_ahead(a, b, warp, band, weight)
        want = [ahead_by_hand(x, y, warp, band, weight) for x, y in zip(a, b, strict=True)]
        assert np.allclose(found, want)
        if warp == 1:
            size = np.full(5, n), np.full(5, m), np.full(5, 99 if band is None else band)
            assert np.allclose(warping.fronts(a, b, *size, warping.manhattan, weight), want)


def test_envelopes():
    x = np.random.default_rng(0).normal(size=(4, 30))
    for window in (0, 1, 2, 5, 40):
        low, high = warping.envelope(x, window)
        for i in range(30):
            near = x[:, max(0, i - window) : i + window + 1]
            assert (low[:, i] == near.min(axis=1)).all() and (high[:, i] == near.max(axis=1)).all()


@pytest.fixture(scope="module")
def walks(spark):
    rng = np.random.default_rng(9)
    base = [np.round(np.cumsum(rng.normal(size=24)), 2) for _ in range(12)]
    rows = [(k, [float(v) for v in base[k % 12] + rng.normal(size=24) * 0.1]) for k in range(240)]
    rows += [(900 + k, [float(v) for v in rng.normal(size=5)]) for k in range(6)]
    rows += [(950, None), (951, []), (952, rows[3][1]), (953, rows[3][1])]
    return spark.createDataFrame(rows, "series long, values array<double>").repartition(5), rows


def all_pairs(rows, asked, window):
    out = {}
    for i, a in rows:
        for j, b in rows if i in asked else ():
            if i != j and a and b and len(a) == len(b):
                out[i, j] = by_hand(np.array(a)[:, None], np.array(b)[:, None], window)
    return out


def test_searches(walks):
    df, rows = walks
    asked = {0, 3, 60, 61, 900, 952, 950}
    queries = df.where(df.series.isin(list(asked)))
    want = all_pairs(rows, asked, 3)
    limit = sorted(want.values())[len(want) // 20]
    for block in (2, 128):
        found = {(r.series, r.partner): r.distance for r in warping.dtw_within(queries, df, limit, 3, block).collect()}
        assert found.keys() == {k for k, d in want.items() if d <= limit} and all(abs(d - want[k]) < 1e-9 for k, d in found.items())
        near = {}
        for r in warping.dtw_nearest(queries, df, 4, 3, block).collect():
            near.setdefault(r.series, []).append((r.place, r.partner, r.distance))
        for i in asked - {950}:
            best = sorted((d, j) for (a, j), d in want.items() if a == i)[:4]
            assert [(p, j) for p, j, _ in sorted(near[i])] == [(k + 1, j) for k, (_, j) in enumerate(best)]
    left = {r.series: r for r in warping.dtw_bounds(queries, df, limit, 3).collect()}
    assert all(r.pairs >= r.by_ends >= r.by_envelope >= r.within for r in left.values())
    assert sum(r.within for r in left.values()) == len(found) and sum(r.by_envelope for r in left.values()) < 0.2 * len(want)


def test_nothing_to_search(walks):
    df, _ = walks
    none = df.where("false")
    for q, s in ((none, df), (df, none), (none, none)):
        assert warping.dtw_within(q, s, 1.0, 3).collect() == [] and warping.dtw_nearest(q, s, 2, 3).collect() == []


def test_nulls_in_pairs(spark):
    pairs = spark.createDataFrame([([1.0], [3.0]), (None, [1.0]), ([], [1.0])], "a array<double>, b array<double>")
    assert [r.distance for r in warping.dtw_join(pairs.coalesce(1)).collect()] == [2.0, None, None]
    found = warping.dtw_join(pairs.coalesce(1), path=True).collect()
    assert [r.path and [tuple(p) for p in r.path] for r in found] == [[(0, 0)], None, None]


def test_barycentres(spark):
    rng = np.random.default_rng(6)
    rows = [(k, k % 2 if k < 70 else None, [float(v) for v in np.sin(np.arange(16) / 2 + (k % 2)) + rng.normal(size=16) * 0.05]) for k in range(90)]
    df = spark.createDataFrame([*rows, (99, 0, None), (98, 1, [])], "series long, label int, values array<double>").repartition(4)
    whole = {r.label: r["values"] for r in augment.wdba(df, None, 3).collect()}
    assert set(whole) == {0, 1, None}
    for label in (0, 1):
        assert np.abs(np.array(whole[label]) - np.sin(np.arange(16) / 2 + label)).mean() < 0.08
    parts = augment.wdba(df, 6, 3).collect()
    assert sorted((str(r.label), r.batch) for r in parts) == sorted((c, b) for c, n in (("0", 35), ("1", 35), ("None", 20)) for b in range(-(-n // 6)))
    # one round from a start, by hand: the class in one batch
    few = df.where("label = 0 AND series < 12")
    x = {r.series: np.array(r["values"]) for r in few.collect()}
    d = {i: {j: by_hand(a[:, None], b[:, None]) for j, b in x.items()} for i, a in x.items()}
    m = min(x, key=lambda i: (sum(d[i].values()), i))
    near = min(v for j, v in d[m].items() if j != m)
    total, mass = np.zeros(16), np.zeros(16)
    for j, v in x.items():
        w = 0.5 ** (d[m][j] / near)
        for p, q in warping.dtw_path(x[m][:, None], v[:, None])[1]:
            total[p] += w * v[q]
            mass[p] += w
    assert np.allclose(augment.wdba(few, None, 3, rounds=1).first()["values"], total / mass)


def test_partners(spark):
    df = spark.createDataFrame([(k, "hot" if k < 60 else k % 7, [float(k)]) for k in range(100)] + [(200, None, [1.0]), (201, None, [2.0]), (202, "alone", [3.0])], "series long, label string, values array<double>").repartition(6)
    found = augment.same_class_partner(df, 1).collect()
    label = {r.series: r.label for r in df.collect()}
    assert all(label[r.series] == label[r.partner] and r.partner_values == [{200: 1.0, 201: 2.0}.get(r.partner, float(r.partner))] for r in found)
    assert sorted(r.partner for r in found) == sorted(r.series for r in found) == [k for k in sorted(label) if k != 202]


def test_fronts_of_a_search_hold_the_band_alone():
    rng = np.random.default_rng(12)
    for n, window in ((1, 0), (2, 1), (7, 0), (20, 3), (33, 8), (16, 40)):
        a, b = (rng.normal(size=(n, 60)) for _ in range(2))
        want = warping.fronts(a.T[:, :, None], b.T[:, :, None], *(np.full(60, k) for k in (n, n, window)), warping.manhattan)
        assert (warping.near_fronts(a, b, window, np.full(60, np.inf)) == want).all()
        limit = np.quantile(want, rng.random(60) * 0.5)
        found = warping.near_fronts(a, b, window, limit)
        assert (found[want <= limit] == want[want <= limit]).all() and ((found == want) | (found == np.inf)).all()


def test_searches_of_one_file_run_in_many_tasks(walks):
    df, _ = walks
    q = df.where("series < 3")
    for found in (warping.dtw_within(q, df.coalesce(1), 5.0, 3), warping.dtw_bounds(q, df.coalesce(1), 5.0, 3)):
        assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()
    near = warping.dtw_nearest(q, df.coalesce(1), 2, 3)
    assert near.count() == 6 and "RoundRobinPartitioning" in near._jdf.queryExecution().toString()


def test_kernels_take_arrow_batches_in_parts(spark):
    import pyarrow as pa

    long = pa.array([[1.0, None], None, []] * 400 + [[3.0]], pa.list_(pa.float64())).slice(1)
    parts = list(warping.series_parts(long))
    assert max(map(len, parts)) <= warping.SERIES and sum(map(len, parts)) == 1200
    rows = [x for p in parts for x in p]
    assert rows[0] is None and rows[1].shape[0] == 0 and rows[-1].tolist() == [[3.0]] and np.isnan(rows[2][1, 0])
    two = next(warping.series_parts(pa.array([[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0]]])))
    assert [x.tolist() for x in two] == [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0]]]
    mean, b, w = pa.array([[0.0, 1.0]] * 1100), pa.array([[0.0, 0.0, 1.0]] * 1100), pa.array(np.arange(1100.0))
    added = augment._added(mean, b, w)
    assert isinstance(added, pa.Array) and added.type.value_type.num_fields == 2  # no Python objects for cells
    assert all(r == [{"total": 0.0, "mass": 2.0 * k}, {"total": float(k), "mass": float(k)}] for k, r in enumerate(added.to_pylist()))


def exactly(monkeypatch, ids, values, asked, run):
    """Rows of a search's task over all series in one batch, in this process, and how many pairs it measured in floats."""
    import types

    import pyarrow as pa

    task, pairs = [], []
    at = [ids.index(i) for i in asked]
    queries = warping.Queries(list(asked), np.array([values[k] for k in at]), 8)
    measure, band = warping.Queries.measure, warping._band

    def counted(a, b, window, limit=None, every=False):
        pairs.append((a.shape[1] * b.shape[1] if every else a.shape[1]) if a.dtype == float else 0)
        return band(a, b, window, limit, every)

    monkeypatch.setattr(warping, "_query_blocks", lambda *_: [types.SimpleNamespace(value=queries)])
    monkeypatch.setattr(warping, "_id_types", lambda *_: (["long"] * 2, [pa.int64()] * 2))
    monkeypatch.setattr(warping, "_spread", lambda _: types.SimpleNamespace(mapInArrow=lambda f, _: (task.append(f), 1 / 0)))
    monkeypatch.setattr(warping, "_band", counted)
    monkeypatch.setattr(warping.Queries, "measure", measure)
    with pytest.raises(ZeroDivisionError):
        run()
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(values)], names=["series", "values"])
    return [r for b in task[0]([batch]) for r in b.to_pylist()], sum(pairs)


def noise(count, seed=4, steps=24):
    rng = np.random.default_rng(seed)
    return list(range(count)), [[float(v) for v in x] for x in rng.normal(size=(count, steps)).astype(np.float32)]


@pytest.mark.parametrize("level, spread", [(0.0, 1.0), (1e6, 1.0), (-3.0, 1e-9), (0.0, 1e9)])
def test_whole_numbers_bound_distances(level, spread):
    rng = np.random.default_rng(8)
    for n, window in ((1, 0), (2, 1), (24, 8), (24, 0), (40, 60)):
        x, y = level + spread * rng.normal(size=(50, n)), level + spread * rng.normal(size=(9, n))
        x[3], x[4, 0], x[5, -1], y[2, 0] = x[6], np.nan, np.inf, np.nan
        q, rows = warping.Queries(list(range(9)), y, window), np.ones((9, 50), bool)
        rough = warping.Rough(q, x)
        assert rough.fine and (rough.odd == ([k == 2 for k in range(9)] | np.isin(np.arange(50), (4, 5))[:, None]).T).all()
        fine = ~rough.odd
        with np.errstate(invalid="ignore"):
            d, out = q.measure(*np.nonzero(rows), x, np.full(450, np.inf)).reshape(9, 50), q.outside(x)
        assert (np.abs(rough.outside() - out * rough.scale)[fine] < rough.slack).all()
        limit = np.median(d[fine])
        for left in (rows, rows & (rng.random((9, 50)) < 0.2)):
            assert (np.abs(rough.distances(left) - d * rough.scale)[fine & left] < rough.slack).all()
            some = rough.distances(left, np.full(9, rough.units(limit)))
            assert (some <= rough.units(limit))[fine & left & (d <= limit)].all()


def test_numbers_that_whole_ones_cannot_tell():
    x = np.zeros((3, 8))
    assert warping.Rough(warping.Queries([0], x[:1], 2), x).fine
    x[0, 0] = 1e308
    y = -x
    assert not warping.Rough(warping.Queries([0], y, 2), x).fine and not warping.Rough(warping.Queries([0], np.full((1, 8), np.nan), 2), x).fine
    assert not warping.Rough(warping.Queries([0], np.zeros((1, 20000)), 2), np.zeros((1, 20000))).fine


def test_nearest_measures_few_pairs(monkeypatch):
    ids, values = noise(500)
    asked = ids[:500:50]
    rows, pairs = exactly(monkeypatch, ids, values, asked, lambda: warping.dtw_nearest(None, None, 3, 8))
    assert pairs < 0.02 * 5000  # before: all pairs that two bounds left, nearly all of noise
    v = np.array(values)[:, :, None]
    d = {i: np.array([by_hand(v[i], v[j], 8) if i != j else np.inf for j in range(60)]) for i in asked[:1]}
    got = sorted((r["distance"], r["partner"]) for r in rows if r["series"] == 0)
    assert len(rows) == 30 and sum(x <= got[-1][0] for x in d[0]) == sum(p < 60 for _, p in got) and all(abs(x - by_hand(v[0], v[p], 8)) < 1e-9 for x, p in got)


def test_nearest_of_odd_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in 1e5 + rng.normal(size=12)]) for k in range(40)]
    rows += [(40, [1e12] * 12), (41, [1e12] * 12), (42, [float("nan")] * 12), (43, [1e300] * 12), (44, rows[0][1])]
    df = spark.createDataFrame(rows, "series long, values array<double>").repartition(3)
    want = {}
    for (i, j), d in all_pairs(rows, {0, 41, 42}, 3).items():
        if not math.isnan(d):
            want.setdefault(i, []).append((d, j))
    found = warping.dtw_nearest(df.where("series IN (0, 41, 42)"), df, 3, 3).collect()
    for i in (0, 41):
        assert [j for _, j in sorted(want[i])[:3]] == [r.partner for r in sorted((r for r in found if r.series == i), key=lambda r: r.place)]
    assert {r.series for r in found} == {0, 41}


def test_bounds_count_exactly_and_measure_few_pairs(monkeypatch):
    ids, values = noise(300)
    asked = ids[:300:60]
    v = np.array(values)
    q, own = warping.Queries(asked, v[asked], 8), np.array([[i != j for j in ids] for i in asked])
    d = q.measure(*np.nonzero(np.ones((5, 300), bool)), v, np.full(1500, np.inf)).reshape(5, 300)
    for limit in (float(np.sort(d[own])[700]), float(np.sort(q.outside(v)[own])[300])):  # one pair lies on it
        with monkeypatch.context() as m:
            rows, pairs = exactly(m, ids, values, asked, lambda: warping.dtw_bounds(None, None, limit, 8))  # noqa: B023
        ends = own & (q.ends(v) <= limit)
        near = ends & (q.outside(v) <= limit)
        want = [f.sum(axis=1).tolist() for f in (own, ends, near, near & (d <= limit))]
        assert [[r[c] for r in rows] for c in ("pairs", "by_ends", "by_envelope", "within")] == want
        assert pairs < 0.05 * 1500  # before: all pairs that the bounds left


def test_rounding_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.random(3000) * 8, np.round(rng.random(3000), 6) + 5e-7, [0.0, 5e-7, 4.9999999e-7, 1.0000005, 2.5, 123456.7890125, 1e9 + 0.1234565, 1e13 + 0.3, 1e300]])
    want = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(F.round("x", 6)).collect()]
    assert warping.half_up(x, 6).tolist() == want
    assert np.isnan(warping.half_up(np.array([np.nan, np.inf]), 6)[0]) and len(warping.half_up(np.array([]), 6)) == 0


def test_within_of_loose_and_of_tight_limits(monkeypatch):
    ids, values = noise(1200, steps=16)
    asked = ids[:1200:240]
    v = np.array(values)
    d = warping.Queries(asked, v[asked], 8).measure(*np.nonzero(np.ones((5, 1200), bool)), v, np.full(6000, np.inf)).reshape(5, 1200)
    for limit, most in ((float(np.quantile(d, 0.02)), 0.05), (float(np.quantile(d, 0.98)), 1.0)):
        with monkeypatch.context() as m:
            rows, pairs = exactly(m, ids, values, asked, lambda: warping.dtw_within(None, None, limit, 8, digits=6))  # noqa: B023
        want = {(i, j): d[a, j] for a, i in enumerate(asked) for j in ids if i != j and d[a, j] <= limit}
        assert {(r["series"], r["partner"]): r["distance"] for r in rows} == {k: round(float(x), 6) for k, x in want.items()}
        assert len(rows) == len(want) and pairs <= most * 6000
