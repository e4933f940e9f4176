"""Operators on many series at once, rows being (series, step, value) unless said otherwise."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions import scalar


def _by(series: str, step: str) -> Window:
    return Window.partitionBy(series).orderBy(step)


def supervised_windows(df: DataFrame, seq: int, label: int, pred: int, stride: int = 1, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, start, seq_x and seq_y of every complete window: seq steps, and the last label of them with pred more."""
    w = _by(series, step)
    d = df.withColumns({"seq_x": F.collect_list(value).over(w.rowsBetween(0, seq - 1)), "seq_y": F.collect_list(value).over(w.rowsBetween(seq - label, seq + pred - 1)), "start": F.row_number().over(w) - 1})
    full = (F.size("seq_x") == seq) & (F.size("seq_y") == label + pred) & (F.col("start") % stride == 0)
    return d.where(full).select(series, "start", "seq_x", "seq_y")


def moving_average(df: DataFrame, k: int, series: str = "series", step: str = "step", value: str = "value", out: str = "trend") -> DataFrame:
    """Centred mean of k values, the ends repeated: rows that the frame lacks weigh as the end's value."""
    half = (k - 1) // 2
    w, whole = _by(series, step), Window.partitionBy(series)
    ends = Window.partitionBy(series).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumns({"__p": F.row_number().over(w) - 1, "__n": F.count(F.lit(1)).over(whole), "__a": F.first_value(value).over(ends), "__z": F.last_value(value).over(ends), "__s": F.sum(value).over(w.rowsBetween(-half, half))})
    low, high = F.greatest(F.lit(0), half - F.col("__p")), F.greatest(F.lit(0), F.col("__p") + half - F.col("__n") + 1)
    return d.withColumn(out, (F.col("__s") + low * F.col("__a") + high * F.col("__z")) / k).drop("__p", "__n", "__a", "__z", "__s")


def decompose(df: DataFrame, widths: list[int], series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """Adds trend, the mean of the moving averages of all widths, and season, the rest."""
    names = [f"__t{k}" for k in range(len(widths))]
    for k, name in zip(widths, names, strict=True):
        df = moving_average(df, k, series, step, value, name)
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return df.withColumn("trend", total / len(widths)).withColumn("season", F.col(value) - F.col("trend")).drop(*names)


def revin(df: DataFrame, series: str = "series", step: str = "step", value: str = "value", last: bool = False, eps: float = 1e-5) -> DataFrame:
    """Adds normed, centre and scale: value less the mean (or the last value) by the biased deviation."""
    w = Window.partitionBy(series)
    ends = Window.partitionBy(series).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centre = F.last_value(value).over(ends) if last else F.avg(value).over(w)
    d = df.withColumns({"centre": centre, "scale": F.sqrt(F.var_pop(value).over(w) + eps)})
    return d.withColumn("normed", (F.col(value) - F.col("centre")) / F.col("scale"))


def revin_inverse(df: DataFrame, value: str = "normed") -> DataFrame:
    return df.withColumn("restored", F.col(value) * F.col("scale") + F.col("centre"))


def instance_norm(df: DataFrame, sample: str, value: str, eps: float = 1e-5) -> DataFrame:
    w = Window.partitionBy(sample)
    return df.withColumn("normed", (F.col(value) - F.avg(value).over(w)) / F.sqrt(F.var_pop(value).over(w) + eps))


def insample_last_window(df: DataFrame, length: int, values: str = "values") -> DataFrame:
    """Adds window, the last values padded on the left with zeros, and mask, 1 where it holds data."""
    n = F.least(F.size(values), F.lit(length))
    own = F.when(n > 0, F.slice(values, F.size(values) - n + 1, n)).otherwise(F.array().cast("array<double>"))
    zeros = F.array_repeat(F.lit(0.0), length - n)
    return df.withColumns({"window": F.concat(zeros, own), "mask": F.concat(zeros, F.array_repeat(F.lit(1.0), n))})


def random_cut_window(df: DataFrame, seq: int, label: int, pred: int, window: int, seed: int, key: str = "series", values: str = "values") -> DataFrame:
    """A training sample per series: a cut by hash in its last window values, what comes before it and after it, padded,
    with masks."""
    size = F.size(values)
    low = F.greatest(F.lit(1), size - window)
    cut = low + F.floor(scalar.hash_uniform(seed, F.col(key)) * (size - low)).cast("int")
    d = df.withColumn("cut", F.when(size > 0, F.least(cut, size - 1)).otherwise(0))
    n_in, n_out = F.least(F.col("cut"), F.lit(seq)), F.least(size - F.col("cut") + F.least(F.col("cut"), F.lit(label)), F.lit(label + pred))
    start = F.greatest(F.lit(0), F.col("cut") - label)
    x = F.slice(values, F.col("cut") - n_in + 1, n_in)
    y = F.slice(values, start + 1, n_out)
    zero, one = F.lit(0.0), F.lit(1.0)
    return d.select(
        key, "cut", F.concat(F.array_repeat(zero, seq - n_in), x).alias("insample"), F.concat(F.array_repeat(zero, seq - n_in), F.array_repeat(one, n_in)).alias("insample_mask"),
        F.concat(y, F.array_repeat(zero, label + pred - n_out)).alias("outsample"), F.concat(F.array_repeat(one, n_out), F.array_repeat(zero, label + pred - n_out)).alias("outsample_mask"),
    )


def interpolate_missing(df: DataFrame, sample: str, step: str, value: str) -> DataFrame:
    """Missing values (null or NaN) on the line between their neighbours; at the ends the nearest value."""
    v = F.when(~F.isnan(value), F.col(value))
    before = Window.partitionBy(sample).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(sample).orderBy(step).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col(step))
    d = df.withColumns({"__a": F.last_value(v, True).over(before), "__ta": F.last_value(at, True).over(before), "__b": F.first_value(v, True).over(after), "__tb": F.first_value(at, True).over(after)})
    line = F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col(step) - F.col("__ta")) / (F.col("__tb") - F.col("__ta"))
    return d.withColumn(value, F.coalesce(v, line, F.col("__a"), F.col("__b"))).drop("__a", "__ta", "__b", "__tb")


def adf_statistic(df: DataFrame, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series and statistic: the t value of the level in a regression of the change on a constant, the level and the change
    before, from moments by Cramer's rule."""
    w = _by(series, step)
    d = df.withColumn("d", F.col(value) - F.lag(value).over(w))
    d = d.select(series, F.col("d").alias("y"), F.lag(value).over(w).alias("x"), F.lag("d").over(w).alias("z")).where(F.col("z").isNotNull())
    terms = {"n": F.count(F.lit(1)), **{a + b: F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}, **{a: F.sum(a) for a in "xyz"}}
    m = d.groupBy(series).agg(*[e.alias(f"s{k}") for k, e in terms.items()])
    n = F.col("sn")
    cov = lambda a, b: F.col(f"s{a}{b}") - F.col(f"s{a}") * F.col(f"s{b}") / n
    xx, xz, zz, xy, yz, yy = cov("x", "x"), cov("x", "z"), cov("z", "z"), cov("x", "y"), cov("y", "z"), cov("y", "y")
    det = xx * zz - xz * xz
    b, g = (xy * zz - yz * xz) / det, (yz * xx - xy * xz) / det
    s2 = (yy - b * xy - g * yz) / (n - 3)
    return m.select(series, (b / F.sqrt(s2 * zz / det)).alias("statistic"))


def multi_scale_downsample(df: DataFrame, factor: int, levels: int, how: str = "avg", series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, level, step and value of a series pooled again and again; incomplete pools at the end are dropped."""
    length = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(series)))
    d = length.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    size = F.pow(F.lit(float(factor)), F.col("level")).cast("long")
    pool = scalar.integer_div(F.col(step).cast("long"), size)
    d = d.withColumns({"__size": size, "__pool": pool}).where((F.col("__pool") + 1) * F.col("__size") <= F.col("__n"))
    return d.groupBy(series, "level", F.col("__pool").alias(step)).agg((F.avg(value) if how == "avg" else F.max(value)).alias(value))


def patch_series(df: DataFrame, length: int, stride: int, pad: int, values: str = "values") -> DataFrame:
    """Adds patches: the values, the last repeated pad times, in overlapping pieces."""
    padded = F.concat(values, F.array_repeat(F.element_at(values, -1), pad))
    count = F.floor((F.size(values) + pad - length) / stride).cast("int")
    return df.withColumn("__v", padded).withColumn("patches", F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(F.col("__v"), i * stride + 1, length))).drop("__v")


def haar_dwt(df: DataFrame, levels: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """series, level, band (a or d), step and value: details of each level and the approximation of the last.

    An odd end is padded with a zero. Each level is one aggregation of half the rows.
    """
    r = math.sqrt(0.5)
    a, out = df.select(series, step, value), None
    for level in range(1, levels + 1):
        even = F.col(step) % 2 == 0
        g = a.groupBy(series, scalar.integer_div(F.col(step).cast("long"), F.lit(2)).alias("__s"))
        g = g.agg(F.sum(F.col(value) * r).alias("a"), F.sum(F.when(even, F.col(value) * r).otherwise(-F.col(value) * r)).alias("d"))
        detail = g.select(series, F.lit(level).alias("level"), F.lit("d").alias("band"), F.col("__s").alias(step), F.col("d").alias(value))
        out = detail if out is None else out.unionByName(detail)
        a = g.select(series, F.col("__s").alias(step), F.col("a").alias(value))
    return out.unionByName(a.select(series, F.lit(levels).alias("level"), F.lit("a").alias("band"), step, value))


def haar_idwt(bands: DataFrame, levels: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """The series of haar_dwt's bands; a padded end stays."""
    r = math.sqrt(0.5)
    a = bands.where((F.col("band") == "a") & (F.col("level") == levels)).select(series, step, value)
    for level in range(levels, 0, -1):
        d = bands.where((F.col("band") == "d") & (F.col("level") == level)).select(series, step, F.col(value).alias("__d"))
        j = a.join(d, [series, step])
        pair = F.array(F.struct((F.col(step) * 2).alias("s"), ((F.col(value) + F.col("__d")) * r).alias("v")), F.struct((F.col(step) * 2 + 1).alias("s"), ((F.col(value) - F.col("__d")) * r).alias("v")))
        a = j.select(series, F.inline(pair)).withColumnsRenamed({"s": step, "v": value})
    return a


def random_mask(df: DataFrame, rate: float, seed: int, series: str = "series", step: str = "step", value: str = "value") -> DataFrame:
    """Adds mask (0 where the hash falls below rate) and the value with masked cells at 0."""
    keep = scalar.hash_uniform(seed, F.col(series), F.col(step)) > rate
    return df.withColumn("mask", keep.cast("int")).withColumn("masked", F.when(keep, F.col(value)).otherwise(0.0))
