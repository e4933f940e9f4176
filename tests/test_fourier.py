"""Native Fourier transforms against numpy, for powers of two and other lengths."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.operators import fourier
from flowkit.plans import catalog

SF = "/root/testdata/sf0.001"


def walks(spark, n, count=6):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.normal(size=(count, n)), axis=1)
    rows = [(s, t, float(x[s, t])) for s in range(count) for t in range(n)]
    return x, spark.createDataFrame(rows, "series long, step long, value double").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 12, 37, 64, 100])
def test_transform(spark, n):
    x, df = walks(spark, n)
    for r in fourier.spectra(df, n).collect():
        found = np.array([complex(z["re"], z["im"]) for z in r.coefficients])
        assert np.allclose(found, np.fft.fft(x[r.series]), atol=1e-9)


@pytest.mark.parametrize("n", [4, 15, 32])
def test_uses(spark, n):
    x, df = walks(spark, n)
    amplitude = np.abs(np.fft.rfft(x))[:, 1:]
    mean = amplitude.mean(axis=0)
    best = sorted(range(len(mean)), key=lambda k: (-round(mean[k], 9), k))[:3]
    assert [(r.freq, r.period) for r in fourier.topk_periods(df, n, 3).collect()] == [(k + 1, n // (k + 1)) for k in best]
    season = {(r.series, r.step): (r.season, r.trend) for r in fourier.dft_decompose(df, n, 2).collect()}
    for s in range(len(x)):
        kept = np.zeros(n // 2 + 1, complex)
        for k in sorted(range(len(mean)), key=lambda k: (-round(amplitude[s, k], 9), k))[:2]:
            kept[k + 1] = np.fft.rfft(x[s])[k + 1]
        want = np.fft.irfft(kept, n)
        assert all(abs(season[s, t][0] - want[t]) < 1e-9 and abs(sum(season[s, t]) - x[s, t]) < 1e-9 for t in range(n))
    top = {}
    for r in fourier.lag_autocorrelation(df, n, 2.0).collect():
        top.setdefault(r.series, []).append((r.lag, r.corr, r.weight))
    for s in range(len(x)):
        corr = [float(np.mean(x[s] * np.roll(x[s], -lag))) for lag in range(n)]
        lags = sorted(range(n), key=lambda k: (-round(corr[k], 9), k))[: int(2 * math.log(n))]
        assert [lag for lag, _, _ in top[s]] == lags and all(abs(c - corr[lag]) < 1e-9 for lag, c, _ in top[s])
        weight = np.exp([corr[k] for k in lags]) / np.exp([corr[k] for k in lags]).sum() if max(corr) < 300 else None
        assert weight is None or np.allclose([w for _, _, w in top[s]], weight)


def test_gaps_and_repeats(spark):
    rows = [(1, 0, 2.0), (1, 3, None), (1, 1, 1.0), (1, 1, 0.5), (1, 9, 7.0), (2, None, 1.0), (2, 2, 1.0), (None, 0, 1.0)]
    df = spark.createDataFrame(rows, "series long, step long, value double")
    assert {r.series: r["values"] for r in fourier.series_arrays(df, 4).collect()} == {1: [2.0, 1.5, 0.0, 0.0], 2: [0.0, 0.0, 1.0, 0.0], None: [1.0, 0.0, 0.0, 0.0]}
    assert fourier.spectrum(df.where("false"), 4).collect() == []


def test_one_row_a_series(spark):
    for q in ("f12_lag_autocorrelation", "j13_dft_decompose", "g3_topk_periods"):
        plan = catalog.QUERIES[q](spark, SF)._jdf.queryExecution().toString()
        assert "Join" not in plan and len(re.findall("FileScan", plan.split("Physical Plan")[1])) == 1, q
    x, df = walks(spark, 16)
    shuffles = fourier.dft_decompose(df.where(F.col("series") >= 0), 16, 2)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles == 1
