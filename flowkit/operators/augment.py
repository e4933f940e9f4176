"""Augmentation of series and dynamic time warping. Rows are (series, step, value), all series having n steps unless said
otherwise; every random choice is a hash of its keys and a seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.functions.scalar import hash64, hash_normal, hash_uniform
from flowkit.operators.components import checkpoint, numbered
from flowkit.operators.warping import dtw_join, list_array, series_parts, shape_of, warp_batch


def jitter(df: DataFrame, sigma: float, seed: int) -> DataFrame:
    return df.withColumn("value", F.col("value") + sigma * hash_normal(seed, F.col("series"), F.col("step")))


def scaling(df: DataFrame, sigma: float, seed: int) -> DataFrame:
    """One factor about 1 for each series (and channel, if there is one)."""
    keys = [F.col(c) for c in ("series", "channel") if c in df.columns]
    return df.withColumn("value", F.col("value") * (1 + sigma * hash_normal(seed, *keys)))


def rotation(df: DataFrame, channels: int, seed: int) -> DataFrame:
    """A random sign for each series and channel, and one permutation of the channels for all series."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.struct(hash64(seed, c).alias("h"), c.alias("c"))))
    sign = F.when(hash_uniform(seed + 1, F.col("series"), F.col("channel")) < 0.5, -1.0).otherwise(1.0)
    return df.withColumns({"value": F.col("value") * sign, "channel": order[F.col("channel")]["c"]})


def permutation(df: DataFrame, n: int, most: int, seed: int, mode: str = "equal") -> DataFrame:
    """The steps of each series cut into 1 .. most-1 segments, which change places: equal ones, or random ones, cut before
    different places out of 0 .. n-3."""
    count = 1 + F.floor(hash_uniform(seed, F.col("series")) * (most - 1))
    segment = F.floor(F.col("step") * count / n)
    if mode == "random":
        order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 3)), lambda c: F.struct(hash64(seed + 2, F.col("series"), c).alias("h"), c.alias("c"))))
        cuts = df.select("series").distinct().withColumn("__cuts", F.slice(order, F.lit(1), (count - 1).cast("int"))["c"])
        df = df.join(cuts, "series")
        segment = F.size(F.filter("__cuts", lambda c: c <= F.col("step")))
    d = df.withColumns({"__h": hash64(seed + 1, F.col("series"), segment), "__g": segment})
    return d.withColumn("step", F.row_number().over(Window.partitionBy("series").orderBy("__h", "__g", "step")) - 1).drop("__h", "__g", "__cuts")


def _spline_basis(n: int, knots: int) -> np.ndarray:
    """n by knots: the values at 0 .. n-1 of the natural cubic spline that is 1 at one of the even knots and 0 at the others."""
    x = np.linspace(0, n - 1, knots)
    h = np.diff(x)
    a = np.zeros((knots, knots))
    b = np.zeros((knots, knots))
    a[0, 0] = a[-1, -1] = 1
    for i in range(1, knots - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1], b[i, i], b[i, i + 1] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    m = np.linalg.solve(a, b)  # second derivatives by knot values
    t = np.arange(n)
    k = np.clip(np.searchsorted(x, t, side="right") - 1, 0, knots - 2)
    u, v, w, e = x[k + 1] - t, t - x[k], h[k], np.eye(knots)
    return m[k] * (u**3 / (6 * w))[:, None] + m[k + 1] * (v**3 / (6 * w))[:, None] + (e[k] / w[:, None] - m[k] * w[:, None] / 6) * u[:, None] + (e[k + 1] / w[:, None] - m[k + 1] * w[:, None] / 6) * v[:, None]


def _curve(df: DataFrame, n: int, sigma: float, knots: int, seed: int) -> Column:
    """A smooth curve about 1 through random knots, at the row's step: linear in the knot values."""
    basis = _spline_basis(n, knots + 2)
    rows = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in basis])
    total = F.lit(0.0)
    for k in range(knots + 2):
        total = total + rows[F.col("step")][k] * (1 + sigma * hash_normal(seed, F.col("series"), F.lit(k)))
    return total


def magnitude_warp(df: DataFrame, n: int, sigma: float = 0.2, knots: int = 4, seed: int = 0) -> DataFrame:
    return df.withColumn("value", F.col("value") * _curve(df, n, sigma, knots, seed))


def interpolate_at(df: DataFrame, n: int, at: str) -> DataFrame:
    """The value of each series at fractional steps, linear between its steps."""
    whole = F.least(F.greatest(F.floor(F.col(at)), F.lit(0)), F.lit(n - 2))
    v = df.select("series", F.col("step").alias("__s"), F.col("value").alias("__v"))
    d = df.drop("value").withColumns({"__lo": whole, "__f": F.least(F.greatest(F.col(at) - whole, F.lit(0.0)), F.lit(1.0))})
    d = d.join(v.withColumnsRenamed({"__s": "__lo", "__v": "__a"}), ["series", "__lo"]).withColumn("__hi", F.col("__lo") + 1)
    d = d.join(v.withColumnsRenamed({"__s": "__hi", "__v": "__b"}), ["series", "__hi"])
    return d.withColumn("value", F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__f")).drop("__lo", "__hi", "__a", "__b", "__f", at)


def time_warp(df: DataFrame, n: int, sigma: float = 0.2, knots: int = 4, seed: int = 0) -> DataFrame:
    """Time runs by a smooth random speed and still ends at the last step."""
    w = Window.partitionBy("series")
    d = df.withColumn("__speed", F.greatest(_curve(df, n, sigma, knots, seed), F.lit(0.01)))
    d = d.withColumn("__at", F.sum("__speed").over(w.orderBy("step")) - F.first_value("__speed").over(w.orderBy("step")))
    d = d.withColumn("__at", F.col("__at") * (n - 1) / F.max("__at").over(w)).drop("__speed")
    return interpolate_at(d, n, "__at")


def window_slice(df: DataFrame, n: int, ratio: float, seed: int) -> DataFrame:
    """A part of ratio * n steps stretched back to n."""
    length = max(2, -int(-ratio * n // 1))
    start = F.floor(hash_uniform(seed, F.col("series")) * (n - length + 1))
    return interpolate_at(df.withColumn("__at", start + F.col("step") * (length - 1) / (n - 1)), n, "__at")


def window_warp(df: DataFrame, n: int, ratio: float, scales: tuple[float, ...], seed: int) -> DataFrame:
    """A part of ratio * n steps runs at one of the speeds, and the whole is brought back to n steps."""
    length = max(2, int(ratio * n))
    start = 1 + F.floor(hash_uniform(seed, F.col("series")) * (n - length - 1))
    pick = F.element_at(F.array(*[F.lit(float(s)) for s in scales]), (F.floor(hash_uniform(seed + 1, F.col("series")) * len(scales)) + 1).cast("int"))
    stretched = length * pick
    t = F.col("step") * (n - length + stretched - 1) / (n - 1)
    at = F.when(t < start, t).when(t < start + stretched, start + (t - start) / pick).otherwise(t - stretched + length)
    return interpolate_at(df.withColumn("__at", F.least(at, F.lit(float(n - 1)))), n, "__at")


def augment_rounds(df: DataFrame, rounds: int, op: Callable[[DataFrame, int], DataFrame], tag: str) -> DataFrame:
    """df with copy 0 and as many augmented copies, tagged; op takes the rows and a seed."""
    out = df.withColumns({"copy": F.lit(0), "tag": F.lit("original")})
    for k in range(1, rounds + 1):
        out = out.unionByName(op(df, k).withColumns({"copy": F.lit(k), "tag": F.lit(tag)}))
    return out


# --- augmentation along warping paths


def _in_class(df: DataFrame, seed: int) -> DataFrame:
    """df with __k, the place in its class in hash order from 0, and __n, the size of the class: counted over ranges, so no
    task holds a class."""
    r = numbered(df.withColumn("__h", hash64(seed, F.col("series"))), "__at", "label", "__h", "series")
    first = r.groupBy(F.col("label").alias("__l")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    r = r.join(first, F.col("label").eqNullSafe(F.col("__l")))
    return r.withColumn("__k", F.col("__at") - F.col("__first")).drop("__h", "__at", "__l", "__first")


def same_class_partner(df: DataFrame, seed: int) -> DataFrame:
    """df (series, label, values) with partner and partner_values: the next of the class in hash order, the last one taking
    the first. A class of one has no partner."""
    r = _in_class(df, seed)
    other = r.select(F.col("label").alias("__l"), F.col("__k").alias("__o"), F.col("series").alias("partner"), F.col("values").alias("partner_values"))
    r = r.withColumn("__k", (F.col("__k") + 1) % F.col("__n"))
    return r.join(other, F.col("label").eqNullSafe(F.col("__l")) & (F.col("__k") == F.col("__o"))).where("partner <> series").drop("__k", "__n", "__l", "__o")


def _resampled(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    where = np.linspace(0, len(at) - 1, n)
    places = np.interp(where, np.arange(len(at)), at)
    return np.interp(places, np.arange(len(x)), x)


def _means(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Each x averaged with its y along their path, at the length of x."""
    _, paths = warp_batch([v[:, None] for v in x], [v[:, None] for v in y], path=True)
    means = [(v[p[:, 0]] + w[p[:, 1]]) / 2 for v, w, p in zip(x, y, paths, strict=True)]
    return [_resampled(m, np.arange(len(m)), len(v)) for m, v in zip(means, x, strict=True)]


def _guided(x: list[np.ndarray], y: list[np.ndarray], shape: int | None = None) -> list[np.ndarray]:
    """Each x with the time of its y."""
    a, b = ([shape_of(v[:, None], shape) if shape else v[:, None] for v in s] for s in (y, x))
    _, paths = warp_batch(a, b, path=True)
    return [_resampled(v, p[:, 1].astype(float), len(v)) for v, p in zip(x, paths, strict=True)]


def _with_partner(df: DataFrame, seed: int, kernel: Callable[[list[np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> DataFrame:
    @F.arrow_udf("array<double>")
    def made(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [pa.array([], pa.list_(pa.float64()))]
        for v, w in zip(series_parts(x), series_parts(y), strict=True):
            found = kernel([r[:, 0] for r in v], [r[:, 0] for r in w])
            out.append(list_array([len(r) for r in found], pa.array(np.concatenate(found))))
        return pa.concat_arrays(out)

    pairs = same_class_partner(df, seed).where("size(values) > 0 AND size(partner_values) > 0")
    return pairs.select("series", "label", "partner", made("values", "partner_values").alias("values"))


def spawner(df: DataFrame, seed: int) -> DataFrame:
    """Each series averaged with a partner of its class along their warping path; series without values have none."""
    return _with_partner(df, seed, _means)


def random_guided_warp(df: DataFrame, seed: int, shape: int | None = None) -> DataFrame:
    """Each series with the time of a partner of its class, by plain or shape warping; series without values have none."""
    return _with_partner(df, seed, lambda x, y: _guided(x, y, shape))


#: Series of a group from which wdba() takes its start.
STARTERS = 16


def wdba(df: DataFrame, size: int | None, seed: int, rounds: int = 3) -> DataFrame:
    """A weighted barycentre under warping of each batch of up to size series of a class, or of whole classes if size is
    None: label, batch and values.

    The medoid of the first STARTERS series of a batch, in hash order, starts; the others weigh less with their distance from
    it: half, at that of the nearest. In each round every series is warped to its batch's mean, and what it adds to each
    place of the mean is a row that Spark sums, so a class of any size is spread over tasks. Series without values are left out.
    """
    key = ["label", "batch"]
    d = df.where("size(values) > 0").select("series", "label", "values")
    if size is None:
        d = d.withColumn("batch", F.lit(0).cast("long"))
        d = d.withColumn("__h", hash64(seed, F.col("series")))
        place = F.row_number().over(Window.partitionBy(*key).orderBy("__h", "series"))  # limited before it is shuffled
        first = d.withColumn("__place", place).where(F.col("__place") <= STARTERS)
    else:
        d = checkpoint(_in_class(d, seed).withColumns({"batch": F.floor(F.col("__k") / size), "__k": F.col("__k") % size}))
        first = d.where(F.col("__k") < STARTERS)
    first = checkpoint(first.select(*key, "series", "values"))
    pairs = _of_batch(first.withColumnRenamed("values", "a"), first.select(*key, F.col("values").alias("b")))
    sums = dtw_join(pairs).groupBy(*key, "series").agg(F.sum("distance").alias("d"), F.first("a").alias("a"))
    start = sums.groupBy(*key).agg(F.min_by(F.struct("series", "a"), F.struct("d", "series")).alias("m"))
    start = checkpoint(start.select(*key, F.col("m.series").alias("__m"), F.col("m.a").alias("a")))
    near = dtw_join(_of_batch(d.select(*key, "series", F.col("values").alias("b")), start)).drop("a")
    nearest = near.where("series <> __m").groupBy(*key).agg(F.min("distance").alias("__near"))
    share = F.when(F.col("__near") > 0, F.exp(F.log(F.lit(0.5)) * F.col("distance") / F.col("__near"))).otherwise(1.0)
    weighed = _of_batch(near, nearest, "left").select(*key, "b", share.alias("w"))
    weighed = checkpoint(weighed)
    means, added_to = start.select(*key, F.col("a").alias("mean")), F.arrow_udf(_added, "array<struct<total:double,mass:double>>")
    for _ in range(rounds):
        added = _of_batch(weighed, means).select(*key, added_to("mean", "b", "w").alias("x"))
        at = added.select(*key, F.posexplode("x")).groupBy(*key, "pos").agg((F.sum("col.total") / F.sum("col.mass")).alias("v"))
        means = checkpoint(at.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "v")))["v"].alias("mean")))
    return means.select(*key, F.col("mean").alias("values"))


def _of_batch(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """a joined with the rows of b of the same label, nulls being equal, and the same batch."""
    b = b.withColumnsRenamed({"label": "__l", "batch": "__b"})
    return a.join(b, F.col("label").eqNullSafe(F.col("__l")) & (F.col("batch") == F.col("__b")), how).drop("__l", "__b")


def _added(mean: pa.Array, values: pa.Array, weight: pa.Array) -> pa.Array:
    """For each place of the mean: the weighted values that meet it, and their weights."""
    out, w = [], weight.to_numpy(zero_copy_only=False)
    for a, b in zip(series_parts(mean), series_parts(values), strict=True):
        sums = []
        for x, y, own, p in zip(a, b, w, warp_batch(a, b, path=True)[1]):  # noqa: B905 - weights of later parts remain
            sums.append([np.bincount(p[:, 0], weights=v, minlength=len(x)) for v in (own * y[p[:, 1], 0], np.full(len(p), own))])
        w = w[len(a) :]
        total, mass = (pa.array(np.concatenate(v)) for v in zip(*sums, strict=True))
        out.append(list_array([len(x) for x in a], pa.StructArray.from_arrays([total, mass], names=["total", "mass"])))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([("total", pa.float64()), ("mass", pa.float64())])))


def variable_slice(df: DataFrame, seed: int) -> DataFrame:
    """Cuts values as window_slice does, by 0.9 + 0.1 * amount / the greatest amount of all rows, or by 0.9 if that is 0."""
    top = df.agg(F.max("amount").alias("__top"))
    n, v, at = F.size("values"), F.col("values"), F.col("__start")
    ratio = F.when(F.col("__top") > 0, 0.9 + 0.1 * F.col("amount") / F.col("__top")).otherwise(0.9)
    d = df.join(F.broadcast(top)).withColumn("__length", F.greatest(F.lit(2), F.ceil(ratio * n)))  # one row
    d = d.withColumn("__start", F.floor(hash_uniform(seed, F.col("series")) * (n - F.col("__length") + 1)))

    def value(i: Column) -> Column:
        place = at + i * (F.col("__length") - 1) / (n - 1)
        low = F.least(F.floor(place), n - 2).cast("int")
        return F.get(v, low) + (F.get(v, low + 1) - F.get(v, low)) * (place - low)

    cut = F.transform(F.sequence(F.lit(0), n - 1), value)
    return d.withColumn("values", F.when(n > 1, cut).otherwise(v)).drop("__top", "__length", "__start")


def discriminative_guided_warp(df: DataFrame, size: int, seed: int, shape: int | None = None, slices: bool = True) -> DataFrame:
    """Each series warped by the member of its batch that lies nearest to its own class and farthest from the others.

    Batches hold size series in hash order over all classes, so a series meets some of its own class and of others. Where a
    batch has one class only, the series nearest to its fellows guides. Gives series, label, guide, amount (the mean shift)
    and values, which variable_slice cuts unless slices is False.
    """

    def warp(pdf: pd.DataFrame) -> pd.DataFrame:
        x = [np.asarray(v, float) for v in pdf["values"]]
        y, ids = pdf["label"].tolist(), pdf["series"].tolist()
        desc = [shape_of(v[:, None], shape) if shape else v[:, None] for v in x]
        k = len(desc)
        d = warp_batch([a for a in desc for _ in desc], desc * k)[0].reshape(k, k)
        out, guides = [], {}
        for i in range(k):
            own = np.array([j for j in range(k) if y[j] == y[i] and j != i], int)
            rest = np.array([j for j in range(k) if y[j] != y[i]], int)
            if len(own):
                guides[i] = int(own[np.argmax((d[np.ix_(own, rest)].mean(axis=1) if len(rest) else 0.0) - d[np.ix_(own, own)].mean(axis=1))])
        paths = dict(zip(guides, warp_batch([desc[g] for g in guides.values()], [desc[i] for i in guides], path=True)[1], strict=True))
        for i, v in enumerate(x):
            if i not in guides:
                out.append((ids[i], y[i], None, 0.0, v.tolist()))
                continue
            path = paths[i][:, 1].astype(float)
            shift = np.abs(np.interp(np.linspace(0, len(path) - 1, len(v)), np.arange(len(path)), path) - np.arange(len(v))).mean()
            out.append((ids[i], y[i], ids[guides[i]], float(shift), _resampled(v, path, len(v)).tolist()))
        return pd.DataFrame(out, columns=["series", "label", "guide", "amount", "values"])

    s, t = (df.schema[c].dataType.simpleString() for c in ("series", "label"))
    df = df.where("size(values) > 0")
    buckets = F.pmod(hash64(seed, F.col("series")), F.greatest(F.lit(1), F.ceil(F.col("__rows") / size)))
    d = df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("__rows")))).withColumn("batch", buckets)  # one row
    d = d.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("batch").orderBy("series")) - 1) / (2 * size)))
    d = d.select("batch", "part", "series", "label", "values").groupBy("batch", "part").applyInPandas(warp, f"series {s}, label {t}, guide {s}, amount double, values array<double>")
    return variable_slice(checkpoint(d), seed + 1) if slices else d  # the greatest amount and the rows come from one run


#: Kernels by name, for series in long arrays: functions from a pandas group to a pandas group.
KERNELS: dict[str, tuple[Callable[[pd.DataFrame], pd.DataFrame], str]] = {}


def register_kernel(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> None:
    KERNELS[name] = (fn, schema)


def apply_kernel(df: DataFrame, name: str, key: str) -> DataFrame:
    """A registered kernel on each group of key."""
    fn, schema = KERNELS[name]
    return df.groupBy(key).applyInPandas(fn, schema)
