"""Discrete Fourier transforms of array columns as native expressions, in n log n steps, one row per series.

A transform of a power of two runs in stages over the whole array: a stage reads the two halves of the array side by side
and writes sums and turned differences in runs of 1, 2, 4, ..., so that the order comes out right. Any other length becomes a
convolution with a chirp, whose own transform is a constant of the plan.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _numbers(values) -> Column:
    return F.lit([float(x) for x in values])


def _stages(z: Column, n: int) -> Column:
    """The transform of n = 2^k complex numbers."""
    half = n // 2

    def stage(z: Column, run: Column) -> Column:
        def cell(o: Column) -> Column:
            j = F.floor(o / (2 * run)).cast("int")
            at = j * run + o % run
            a, b = F.get(z, at), F.get(z, at + half)
            re, im = a["re"] - b["re"], a["im"] - b["im"]
            angle = j * run * (-2 * math.pi / n)
            turned = _complex(re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle))
            return F.when(F.floor(o / run) % 2 == 0, _complex(a["re"] + b["re"], a["im"] + b["im"])).otherwise(turned)

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)

    return F.aggregate(F.lit([1 << s for s in range(n.bit_length() - 1)]), z, stage) if n > 1 else z


def transform(values: Column, n: int) -> Column:
    """The n coefficients (re, im) of an array of n doubles, from the constant on."""
    if n & (n - 1) == 0:
        return _stages(F.transform(values, lambda x: _complex(x, F.lit(0.0))), n)
    size = 1 << (2 * n - 2).bit_length()
    k = np.arange(n)
    chirp = np.exp(-1j * np.pi * ((k * k) % (2 * n)) / n)
    other = np.zeros(size, complex)
    other[:n] = chirp.conj()
    other[size - n + 1 :] = chirp[1:][::-1].conj()
    other = np.fft.fft(other)
    c, s, p, q = (_numbers(x) for x in (chirp.real, chirp.imag, other.real, other.imag))
    zero = F.lit(0.0)
    padded = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i < n, _complex(F.get(values, i) * F.get(c, i), F.get(values, i) * F.get(s, i))).otherwise(_complex(zero, zero)))
    # the inverse transform is that of the conjugate, conjugated and divided by the size
    product = F.transform(_stages(padded, size), lambda z, i: _complex(z["re"] * F.get(p, i) - z["im"] * F.get(q, i), -(z["re"] * F.get(q, i) + z["im"] * F.get(p, i))))
    back = F.slice(_stages(product, size), 1, n)
    return F.transform(back, lambda z, i: _complex((z["re"] * F.get(c, i) + z["im"] * F.get(s, i)) / size, (z["re"] * F.get(s, i) - z["im"] * F.get(c, i)) / size))


def series_arrays(df: DataFrame, n: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series and values, the array of its n steps; a step that is missing or null counts as zero, repeats are added."""
    cells = df.where(F.col(step).between(0, n - 1)).groupBy(series).agg(F.array_sort(F.collect_list(F.struct(F.col(step).cast("int").alias("at"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x")))).alias("cells"))
    plain = (F.size("cells") == n) & (F.size(F.array_distinct(F.col("cells")["at"])) == n)
    placed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.aggregate(F.filter("cells", lambda c: c["at"] == i), F.lit(0.0), lambda s, c: s + c["x"]))
    return cells.select(series, F.when(plain, F.col("cells")["x"]).otherwise(placed).alias("values"))


def spectra(df: DataFrame, n: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, values and coefficients: one row per series, one shuffle."""
    return series_arrays(df, n, series, step, value).withColumn("coefficients", transform(F.col("values"), n))


def _frequencies(n: int) -> Column:
    """freq (1 .. n/2), re, im and amplitude, from the column coefficients; the constant is left out."""

    def one(f: Column) -> Column:
        z = F.get("coefficients", f)
        return F.struct(f.alias("freq"), z["re"].alias("re"), z["im"].alias("im"), F.sqrt(z["re"] ** 2 + z["im"] ** 2).alias("amplitude"))

    return F.transform(F.sequence(F.lit(1), F.lit(n // 2)), one)


def _strongest(cells: Column, score: str, key: str, k: int) -> Column:
    """The k cells with the highest score to nine digits; of equal ones the lowest key."""
    ranked = F.array_sort(F.transform(cells, lambda x: F.struct((-F.round(x[score], 9)).alias("rank"), x[key].alias("key"), x.alias("cell"))))
    return F.slice(ranked, 1, k)["cell"]


def spectrum(df: DataFrame, n: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, freq (1 .. n/2), re, im and amplitude of the discrete Fourier transform; the constant is left out."""
    if n < 2:
        raise ValueError("a series of one step has no frequencies")
    return spectra(df, n, series, step, value).select(series, F.inline(_frequencies(n)))


def topk_periods(df: DataFrame, n: int, k: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """freq, amplitude (mean over all series) and period of the k strongest frequencies."""
    a = spectrum(df, n, series, step, value).groupBy("freq").agg(F.avg("amplitude").alias("amplitude"))
    return a.orderBy(F.round("amplitude", 9).desc(), "freq").limit(k).withColumn("period", F.floor(F.lit(n) / F.col("freq")))


def dft_decompose(df: DataFrame, n: int, k: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, step, value, season, the part of the k strongest frequencies of each series, and trend, the rest.

    Each series has its own frequencies and keeps its mean in the trend; it is one row until its steps are given back.
    """
    d = spectra(df, n, series, step, value).withColumn("top", _strongest(_frequencies(n), "amplitude", "freq", k))

    def season(t: Column) -> Column:
        def add(total: Column, z: Column) -> Column:
            angle = 2 * math.pi * ((z["freq"] * t) % n) / n
            weight = F.when(z["freq"] * 2 == n, 1.0).otherwise(2.0) / n
            return total + weight * (z["re"] * F.cos(angle) - z["im"] * F.sin(angle))

        return F.aggregate("top", F.lit(0.0), add)

    cells = F.transform("values", lambda x, t: F.struct(t.alias(step), x.alias(value), season(t).alias("season")))
    return d.select(series, F.inline(cells)).withColumn("trend", F.col(value) - F.col("season"))


def lag_autocorrelation(df: DataFrame, n: int, c: float, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, lag, corr and weight of the int(c ln n) lags with the highest mean circular product; weights are a softmax.

    The products of all lags are the transform of the power spectrum, which is its own inverse but for the scale."""
    d = spectra(df, n, series, step, value)
    power = F.transform("coefficients", lambda z: z["re"] ** 2 + z["im"] ** 2)
    d = d.select(series, power.alias("power")).select(series, transform(F.col("power"), n).alias("products"))
    lags = F.transform("products", lambda z, lag: F.struct(lag.alias("lag"), (z["re"] / (n * n)).alias("corr")))
    d = d.select(series, _strongest(lags, "corr", "lag", int(c * math.log(n))).alias("top"))
    d = d.withColumn("most", F.array_max(F.col("top")["corr"])).withColumn("mass", F.aggregate("top", F.lit(0.0), lambda s, x: s + F.exp(x["corr"] - F.col("most"))))
    cells = F.transform("top", lambda x: F.struct(x["lag"].alias("lag"), x["corr"].alias("corr"), (F.exp(x["corr"] - F.col("most")) / F.col("mass")).alias("weight")))
    return d.select(series, F.inline(cells))
