"""Dynamic time warping of many pairs at once, and searches that compare few of them.

A batch of pairs is worked on by wavefronts: all cells of one front depend on earlier fronts only, so a front of all pairs is
one array operation. Series are arrays of numbers, or of arrays with a number for each channel.

Searches hold a stated set of queries against all series. Queries travel in blocks of bounded size; a task streams its
series past them. Three bounds come before a measure: the differences of the first and of the last steps, the distance of one
series from the envelope of the other, and the distance of both as whole numbers of 16 bits (Rough), which is off by a known
amount at most. Measuring few pairs stops when a front exceeds the limit, which in a nearest search is the k-th best so far;
where most pairs are left, all of a tile are measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Cells of fronts that are held at once, pairs of a batch, queries of a block, series of a block, pairs of a search's fronts
#: (what a core's cache holds), bytes of one cell of a tile's pairs, rows of a batch of results.
CELLS, PAIRS, QUERIES, SERIES, FRONT, TILE, ROWS = 1 << 22, 2048, 128, 512, 1024, 1 << 15, 1 << 14

Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    return np.abs(x - y)[..., 0] if x.shape[-1] == 1 else np.sqrt(((x - y) ** 2).sum(axis=-1))


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y).sum(axis=-1)


def matrix(values) -> np.ndarray:
    """One series as steps by channels."""
    x = np.array([np.atleast_1d(v) for v in values], float)
    return x.reshape(len(values), -1)


def shape_of(a: np.ndarray, width: int) -> np.ndarray:
    """Each step described by the steps around it, the ends repeated."""
    left = width // 2
    padded = np.concatenate([np.repeat(a[:1], left, 0), a, np.repeat(a[-1:], width - 1 - left, 0)])
    return np.stack([padded[i : i + width].ravel() for i in range(len(a))])


def _stacked(series: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Series of one number of channels as one array that ends in zeros, and their lengths."""
    sizes = np.array([len(x) for x in series])
    out = np.zeros((len(series), sizes.max(), series[0].shape[1]))
    for k, x in enumerate(series):
        out[k, : len(x)] = x
    return out, sizes


class Steps:
    """The step taken into each cell, two bits each, four cells of a column in a byte; walked back for all pairs at once."""

    def __init__(self, pairs: int, n: int, m: int) -> None:
        self.packed = np.zeros((pairs, -(-n // 4), m), np.uint8)

    def put(self, i: np.ndarray, j: np.ndarray, step: np.ndarray) -> None:
        for r in range(4):
            own = i % 4 == r
            self.packed[:, i[own] // 4, j[own]] |= step[:, own].astype(np.uint8) << np.uint8(2 * r)

    def paths(self, n: np.ndarray, m: np.ndarray, moves: tuple) -> list[np.ndarray]:
        """For each pair its cells from first to last; moves has what (i, j) lose by steps 0, 1 and 2."""
        at, pairs = np.stack([n - 1, m - 1], axis=1), np.arange(len(n))
        moves, taken = np.array(moves), [at]
        while (at >= 0).all(axis=1).any():
            i, j = np.maximum(at, 0).T
            step = (self.packed[pairs, i // 4, j] >> (2 * (i % 4)).astype(np.uint8)) & 3
            at = np.where((at >= 0).all(axis=1)[:, None], at - moves[step], -1)
            taken.append(at)
        cells = np.stack(taken, axis=1)
        return [c[(c >= 0).all(axis=1)][::-1] for c in cells]


def fronts(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, band: np.ndarray, dist: Distance = euclidean, weight: float = 1.0, limit: np.ndarray | None = None, steps: Steps | None = None) -> np.ndarray:
    """Least sums of distances over paths from the first to the last cells, for pairs of n and m steps.

    A path goes on by one step of a, of b, or of both; steps of one only have their sum so far multiplied by weight. Cells
    with |i - j| > band are out; no path gives infinity. Front d holds the cells with i + j = d by i. A pair whose last two
    fronts exceed its limit gets infinity: every path crosses one of the two.
    """
    pairs, size, other = len(a), a.shape[1], b.shape[1]
    inf = float("inf")
    out, alive = np.full(pairs, inf), np.arange(pairs)
    one, two = (np.full((pairs, size + 1), inf) for _ in range(2))  # fronts d - 1 and d - 2, cell i at i + 1
    two[:, 0] = 0.0  # before the first cell
    for d in range(size + other - 1):
        i = np.arange(max(0, d - other + 1), min(size - 1, d) + 1)
        j = d - i
        both, up, left = two[:, i], one[:, i], one[:, i + 1]
        if weight != 1.0:
            up, left = up * weight, left * weight
        before = np.minimum(np.minimum(both, up), left)
        if steps is not None:
            steps.put(i, j, np.where(both <= np.minimum(up, left), 0, np.where(up <= left, 1, 2)))
        cost = dist(a[:, i], b[:, j]) + before
        if (band < max(size, other)).any():
            cost[np.abs(i - j)[None, :] > band[:, None]] = inf
        new = np.full_like(one, inf)
        new[:, i + 1] = cost
        two, one = one, new
        done = np.flatnonzero(n + m - 2 == d)
        out[alive[done]] = one[done, n[done]]
        if limit is not None and d % 8 == 7:
            keep = (np.minimum(one.min(axis=1), two.min(axis=1)) <= limit) & (n + m - 2 > d)
            if keep.sum() < 0.8 * len(keep):
                a, b, n, m, band, limit, one, two, alive = (x[keep] for x in (a, b, n, m, band, limit, one, two, alive))
        if not len(alive):
            break
    return out


def rows_only(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, band: np.ndarray, dist: Distance = euclidean, steps: Steps | None = None) -> np.ndarray:
    """As fronts(), but each step of a is used once and b goes on by none, one or two: a front is a row."""
    pairs, size, other = len(a), a.shape[1], b.shape[1]
    inf = float("inf")
    out, row, j = np.full(pairs, inf), np.full((pairs, other + 2), inf), np.arange(other)
    row[:, 1] = 0.0  # cell j of the row before at j + 2; the place before the first cell at 1
    for i in range(size):
        stay, one, two = row[:, 2:], row[:, 1:-1], row[:, :-2]
        before = np.minimum(np.minimum(stay, one), two)
        if steps is not None:
            steps.put(np.full(other, i), j, np.where(stay <= np.minimum(one, two), 0, np.where(one <= two, 1, 2)))
        cost = dist(a[:, i : i + 1], b) + before
        cost[np.abs(i - j)[None, :] > band[:, None]] = inf
        row = np.concatenate([np.full((pairs, 2), inf), cost], axis=1)
        done = np.flatnonzero(n - 1 == i)
        out[done] = row[done, m[done] + 1]
    return out


def look_ahead(a: np.ndarray, b: np.ndarray, warp: int, band: int | None, weight: float, dist: Distance = manhattan) -> np.ndarray:
    """The metric with look-ahead, of pairs of one shape (n, m).

    With c the distances and D the sums, D(i, j) = c(i, j) + min of D(i-1, j-1) and weight times: D(i, j-1); D(i-1, j); and
    for k from 2 to warp D(i-1, j') with j' = min(j-1+k, m-1), and c(i', j-1) with i' = min(i-1+k, n-1), or D(i, j-1)
    where i' = i. Before the first row and column all is infinite but the corner, 0; so is what lies beyond the band. D(i, j)
    needs D(i, j-1) and row i-1 up to j-1+warp, so cells with the same warp * i + j make a front.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    inf = float("inf")
    sums = np.full((pairs, n + 1, m + 1), inf)
    near = dist(a[:, :, None], b[:, None])
    if band is not None:
        near[:, np.abs(np.arange(n)[:, None] - np.arange(m)) > band] = inf
    sums[:, 0, 0] = 0.0
    for t in range(warp * (n - 1) + m):
        i = np.arange(max(0, -(-(t - m + 1) // warp)), min(n - 1, t // warp) + 1)
        j = t - warp * i
        aside = [sums[:, i + 1, j], sums[:, i, j + 1]]
        for k in range(2, warp + 1):
            ahead = np.minimum(i - 1 + k, n - 1)
            aside.append(sums[:, i, np.minimum(j - 1 + k, m - 1) + 1])
            aside.append(np.where(ahead > i, np.where(j > 0, near[:, ahead, j - 1], inf), sums[:, i + 1, j]))
        sums[:, i + 1, j + 1] = near[:, i, j] + np.minimum(sums[:, i, j], weight * np.min(aside, axis=0))
    return sums[:, n, m]


_MOVES = {"symmetric": ((1, 1), (1, 0), (0, 1)), "asymmetric": ((1, 0), (1, 1), (1, 2))}


def warp_batch(a: list[np.ndarray], b: list[np.ndarray], window: int | None = None, slope: str = "symmetric", dist: Distance | None = None, path: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distances of pairs (steps by channels each), and with path their cells. A symmetric window is at least the difference
    of the lengths. Asymmetric steps use each step of a once and may skip one of b. Without a path within the window the
    distance is infinite and the path empty; so it is with an empty series. Pairs are worked on by length, in bounded parts."""
    distance, paths = np.full(len(a), np.inf), [np.empty((0, 2), int)] * len(a)
    order = sorted((k for k in range(len(a)) if len(a[k]) and len(b[k])), key=lambda k: (a[k].shape[1], len(a[k]), len(b[k])))
    start = 0
    while start < len(order):
        stop, channels, widest = start, a[order[start]].shape[1], 0
        while stop < len(order) and a[order[stop]].shape[1] == channels and stop - start < PAIRS:
            widest = max(widest, len(b[order[stop]]))
            if (stop - start + 1) * len(a[order[stop]]) * (widest if path else channels) > CELLS:
                break
            stop += 1
        own = order[start : max(stop, start + 1)]
        start += len(own)
        (x, n), (y, m) = _stacked([a[k] for k in own]), _stacked([b[k] for k in own])
        band = np.full(len(own), max(x.shape[1], y.shape[1])) if window is None else np.full(len(own), window)
        steps = Steps(len(own), x.shape[1], y.shape[1]) if path else None
        if slope == "symmetric":
            found = fronts(x, y, n, m, np.maximum(band, np.abs(n - m)), dist or euclidean, steps=steps)
        else:
            found = rows_only(x, y, n, m, band, dist or euclidean, steps=steps)
        distance[own] = found
        if path:
            for k, cells, d in zip(own, steps.paths(n, m, _MOVES[slope]), found.tolist(), strict=True):
                paths[k] = cells if np.isfinite(d) else paths[k]
    return distance, paths


def dtw_path(a: np.ndarray, b: np.ndarray, window: int | None = None, slope: str = "symmetric", dist: Distance | None = None) -> tuple[float, list[tuple[int, int]]]:
    """Distance and path of one pair."""
    distance, paths = warp_batch([a], [b], window, slope, dist, True)
    return float(distance[0]), [(i, j) for i, j in paths[0].tolist()]


def series_parts(column: pa.Array) -> Iterator[list[np.ndarray | None]]:
    """The rows of a column of arrays as steps by channels, SERIES of them at a time, so that what a task makes of them stays
    small whatever the size of Arrow's batches."""
    for s in range(0, len(column), SERIES):
        part = column.slice(s, SERIES)
        at, flat = part.offsets.to_numpy(), part.values
        if pa.types.is_list(flat.type) or pa.types.is_large_list(flat.type):  # a number for each channel
            inner, flat = flat.offsets.to_numpy(), flat.values
        else:
            inner = None
        flat = flat.to_numpy(zero_copy_only=False)
        places = at if inner is None else inner[at]
        lengths = np.diff(at)
        yield [np.asarray(flat[a:b], float).reshape(n, -1 if n else 1) if ok else None for a, b, n, ok in zip(places[:-1].tolist(), places[1:].tolist(), lengths.tolist(), part.is_valid().to_pylist(), strict=True)]


def list_array(sizes: np.ndarray, values: pa.Array, null: np.ndarray | None = None) -> pa.Array:
    """Arrays of the sizes, cut from values one after another."""
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(at, values, mask=None if null is None else pa.array(null))


def dtw_join(pairs: DataFrame, window: int | None = None, slope: str = "symmetric", shape: int | None = None, dist: Distance | None = None, path: bool = False) -> DataFrame:
    """pairs (with array columns a and b) with distance, and with path (places in a and b, from 0) if asked for; shape
    compares local descriptors of that width instead of steps. dist takes two arrays and gives their distances over the last
    axis. A pair with a null or empty array has no distance and no path."""

    def parts(a: pa.Array, b: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, list]]:
        """For some rows at a time: which have a distance, the distances of those, and their paths."""
        for x, y in zip(series_parts(a), series_parts(b), strict=True):
            ok = np.array([v is not None and w is not None and len(v) > 0 and len(w) > 0 for v, w in zip(x, y, strict=True)], bool)
            x, y = ([s[k] for k in np.flatnonzero(ok)] for s in (x, y))
            if shape:
                x, y = [shape_of(v, shape) for v in x], [shape_of(v, shape) for v in y]
            yield ok, *warp_batch(x, y, window, slope, dist, path)

    def spread(ok: np.ndarray, found: np.ndarray) -> pa.Array:
        out = np.zeros(len(ok))
        out[ok] = found
        return pa.array(out, mask=~ok)

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.float64()), *(spread(ok, found) for ok, found, _ in parts(a, b))])

    @F.arrow_udf("distance double, path array<struct<a:int,b:int>>")
    def with_path(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for ok, found, cells in parts(a, b):
            sizes = np.zeros(len(ok), int)
            sizes[ok] = [len(p) for p in cells]
            i, j = np.concatenate([np.empty((0, 2), int), *cells]).astype(np.int32).T
            paths = list_array(sizes, pa.StructArray.from_arrays([pa.array(i), pa.array(j)], names=["a", "b"]), ~ok)
            out.append(pa.StructArray.from_arrays([spread(ok, found), paths], names=["distance", "path"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("distance", pa.float64()), ("path", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))

    if path:
        return pairs.withColumn("__w", with_path("a", "b")).withColumns({"distance": F.col("__w.distance"), "path": F.col("__w.path")}).drop("__w")
    return pairs.withColumn("distance", distance("a", "b"))


def dtw_metric(pred: DataFrame, truth: DataFrame, warp: int = 1, band: int | None = None, weight: float = 1.0) -> DataFrame:
    """The mean warping distance (sums of absolute differences, normed by both lengths) between (series, values) tables.

    warp looks that many cells aside (look_ahead), band is the greatest difference of places, and weight multiplies the sums
    of steps off the diagonal. A band narrower than the difference of the lengths is an error."""
    pairs = pred.select("series", F.col("values").alias("a")).join(truth.select("series", F.col("values").alias("b")), "series")

    @F.pandas_udf("double")
    def cost(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = [matrix(v) for v in a], [matrix(v) for v in b]
        out, groups = np.full(len(x), np.inf), {}
        for k, (v, w) in enumerate(zip(x, y, strict=True)):
            if band is not None and band < abs(len(v) - len(w)):
                raise ValueError("the band is narrower than the difference of the lengths")
            groups.setdefault((v.shape, w.shape), []).append(k)
        for (v, w), own in groups.items():
            step = max(1, min(PAIRS, CELLS // (v[0] * w[0] * v[1])))
            for s in range(0, len(own), step):
                part = own[s : s + step]
                a_, b_ = np.stack([x[k] for k in part]), np.stack([y[k] for k in part])
                if warp == 1:
                    n, m, off = (np.full(len(part), k) for k in (v[0], w[0], max(v[0], w[0]) if band is None else band))
                    out[part] = fronts(a_, b_, n, m, off, manhattan, weight)
                else:
                    out[part] = look_ahead(a_, b_, warp, band, weight)
        return pd.Series(out)

    d = pairs.withColumn("normed", cost("a", "b") / (F.size("a") + F.size("b")))
    return d.agg(F.count(F.lit(1)).alias("pairs"), F.avg("normed").alias("dtw"))


def lb_keogh(a: str, b: str, window: int) -> Column:
    """A lower bound of the distance of equally long one-dimensional arrays under the sum of absolute differences; it prunes
    pairs before they reach dtw_join."""
    def part(x: Column, i: Column) -> Column:
        near = F.slice(F.col(b), F.greatest(i - window + 1, F.lit(1)), F.lit(2 * window + 1) - F.greatest(F.lit(0), window - i))
        return F.greatest(x - F.array_max(near), F.array_min(near) - x, F.lit(0.0))

    return F.aggregate(F.transform(a, part), F.lit(0.0), lambda s, x: s + x)


# --- searches: queries against all series, one channel, absolute differences


def envelope(x: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value within window steps of each step (last axis), by doubling spans: log(window) passes."""
    width, low, high, span = 2 * window + 1, x, x, 1
    pad = [(0, 0)] * (x.ndim - 1) + [(window, window)]
    low, high = np.pad(x, pad, constant_values=np.inf), np.pad(x, pad, constant_values=-np.inf)
    while span < width:
        step = min(span, width - span)
        low, high = np.minimum(low[..., :-step], low[..., step:]), np.maximum(high[..., :-step], high[..., step:])
        span += step
    return low, high


def _band(a: np.ndarray, b: np.ndarray, window: int, limit: np.ndarray | None = None, every: bool = False) -> np.ndarray:
    """As fronts() by absolute differences, for series of one length, steps by pairs, or with every for all pairs of a column
    of a and one of b, by a. Whole numbers of 16 bits give sums of 16 bits without sign, whose highest is infinity.

    The cells of a front are held by i - j, so two arrays, one for even and one for odd differences, are updated in place:
    cell i - j = t depends on t - 1 and t + 1 of the front before and on t of the one before that."""
    n, window = len(a), min(window, len(a) - 1)
    kind, inf = (np.uint16, 65535) if a.dtype == np.int16 else (a.dtype, np.inf)
    shape = (a.shape[1], b.shape[1])
    pairs = shape[0] * shape[1] if every else shape[0]
    b, alive, middle = np.ascontiguousarray(b[::-1]), None, (window + 2) // 2  # step d - i of b then rises with i
    even, odd = (np.full((2 * middle + 2, pairs), inf, kind) for _ in range(2))  # difference 2t at middle + t, 2t + 1 as well
    cost = np.empty((window + 1, pairs), a.dtype)
    even[middle] = 0  # before the first cell
    for d in range(2 * n - 1):
        low, high = max(0, d - n + 1, (d - window + 1) // 2), min(n - 1, d, (d + window) // 2)
        if low > high:
            continue
        size, at = high - low + 1, (2 * low - d) // 2 + middle
        c, x, y = cost[:size], a[low : high + 1], b[n - 1 - d + low : n - d + high]
        if every:
            np.subtract(x[:, :, None], y[:, None], out=c.reshape(size, *shape))
        else:
            np.subtract(x, y, out=c)
        np.abs(c, out=c)
        own, other, first = (odd, even, at) if d % 2 else (even, odd, at - 1)
        own = own[at : at + size]
        np.minimum(own, other[first : first + size], out=own)
        np.minimum(own, other[first + 1 : first + 1 + size], out=own)
        np.add(own, c.view(kind), out=own)
        if limit is not None and d % 8 == 6 and 8 < d < 2 * n - 2:
            keep = np.flatnonzero(np.minimum(even.min(axis=0), odd.min(axis=0)) <= limit)
            if len(keep) < 0.4 * even.shape[1]:
                q, k = np.divmod(keep, shape[1]) if every else (keep, keep)
                a, b, even, odd = np.take(a, q, axis=1), np.take(b, k, axis=1), np.take(even, keep, axis=1), np.take(odd, keep, axis=1)
                limit, alive, cost, every = limit[keep], keep if alive is None else alive[keep], cost[:, : len(keep)].copy(), False
            if not len(keep):
                break
    if alive is None:
        return even[middle]
    out = np.full(pairs, inf, kind)
    out[alive] = even[middle]
    return out


def near_fronts(a: np.ndarray, b: np.ndarray, window: int, limit: np.ndarray) -> np.ndarray:
    """As fronts() by absolute differences, for pairs of one length and band, steps by pairs: a front holds only the cells of
    the band, and its cells of one step lie side by side, so every operation runs over memory in order."""
    return _band(a, b, window, limit)


def all_fronts(a: np.ndarray, b: np.ndarray, window: int, limit: np.ndarray | None = None) -> np.ndarray:
    """As near_fronts(), for each column of a with each of b, in tiles of bounded size; limit is a by b."""
    out = np.empty((a.shape[1], b.shape[1]), np.uint16 if a.dtype == np.int16 else a.dtype)
    pairs = max(1, min(TILE // a.dtype.itemsize, CELLS // 4 // (min(window, len(a)) + 2)))
    wide = min(pairs, b.shape[1])
    for k in range(0, b.shape[1], wide):
        y = b[:, k : k + wide]
        for q in range(0, a.shape[1], max(1, pairs // wide)):
            tile = slice(q, q + max(1, pairs // wide)), slice(k, k + wide)
            part = out[tile]
            part[:] = _band(a[:, tile[0]], y, window, None if limit is None else limit[tile].ravel(), True).reshape(part.shape)
    return out


def steps_outside(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Queries by series: how far the series leave the envelopes of the queries, added step by step; all steps first."""
    out = np.zeros((low.shape[1], x.shape[1]), np.uint16 if x.dtype == np.int16 else x.dtype)
    above, below = (np.empty(out.shape, x.dtype) for _ in range(2))
    for v, least, most in zip(x, low, high, strict=True):
        np.maximum(np.subtract(v, most[:, None], out=above), np.subtract(least[:, None], v, out=below), out=above)
        out += np.maximum(above, 0, out=above).view(out.dtype)
    return out


class Queries:
    """A block of queries of one length, with their envelopes."""

    def __init__(self, ids: list, values: np.ndarray, window: int) -> None:
        self.ids, self.values, self.window = ids, values, window
        self.low, self.high = envelope(values, window)
        self.places: dict = {}  # id -> its queries
        for k, i in enumerate(ids):
            self.places.setdefault(i, []).append(k)

    def others(self, ids: list) -> np.ndarray:
        """Queries by series: whether their ids differ."""
        out = np.ones((len(self.ids), len(ids)), bool)
        for k, i in enumerate(ids):
            if i in self.places:
                out[self.places[i], k] = False
        return out

    def ends(self, x: np.ndarray) -> np.ndarray:
        """Queries by series: what the first and the last cells cost at least."""
        first = np.abs(self.values[:, None, 0] - x[None, :, 0])
        return first + np.abs(self.values[:, None, -1] - x[None, :, -1]) if x.shape[1] > 1 else first

    def outside(self, x: np.ndarray) -> np.ndarray:
        """Queries by series: how far the series leave the envelopes of the queries, step by step."""
        return steps_outside(np.ascontiguousarray(x.T), self.low.T, self.high.T)

    def measure(self, q: np.ndarray, k: np.ndarray, x: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Distances of queries q from series k of x; infinite where they exceed their limit."""
        out, values, x = np.empty(len(q)), np.ascontiguousarray(self.values.T), np.ascontiguousarray(x.T)
        for s in range(0, len(q), FRONT):
            part = slice(s, s + FRONT)
            out[part] = near_fronts(np.take(values, q[part], axis=1), np.take(x, k[part], axis=1), self.window, limit[part])
        return out

    def measure_where(self, left: np.ndarray, x: np.ndarray, limit: float) -> np.ndarray:
        """Queries by series: the distances where left, or above the limit (where not left, anything above it)."""
        if left.mean() > 0.4:
            return np.where(left, all_fronts(np.ascontiguousarray(self.values.T), np.ascontiguousarray(x.T), self.window), np.inf)
        q, k = np.nonzero(left)
        out = np.full(left.shape, np.inf)
        out[q, k] = self.measure(q, k, x, np.full(len(q), limit))
        return out


class Rough:
    """A block of queries and one of series as whole numbers of 16 bits, which numpy adds and compares several times as fast.

    Values lose their common middle, are multiplied by scale and rounded, so a difference is off by at most one unit and the sum
    over a path by at most one for each of its cells, 2n - 1 at most. slack is one more, for the rounding of floats. The scale
    is chosen so that no sum leaves 16 bits: the sum up to a cell is at most that over the diagonal and then aside. Rows with
    values that aren't finite have no bounds, and neither has anything if fine is False."""

    def __init__(self, queries: Queries, x: np.ndarray) -> None:
        y, n = queries.values, x.shape[1]
        self.window = min(queries.window, n - 1)
        self.odd = ~np.isfinite(y).all(axis=1)[:, None] | ~np.isfinite(x).all(axis=1)
        y, x = (np.where(np.isfinite(v).all(axis=1)[:, None], v, 0.0) for v in (y, x))
        self.slack, low, high = 2.0 * n, min(y.min(), x.min()), max(y.max(), x.max())
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            span, middle = high - low, low / 2 + high / 2
            far = span * self.window + min(span * n, sum(np.abs(v - middle).sum(axis=1).max() for v in (y, x)))
            self.scale = float(np.minimum(32000 / span, (65000 - 4 * n) / far)) if span > 0 else 1.0
        self.fine = bool(0 < self.scale < np.inf and 4 * n < 65000 and not self.odd.all())
        if self.fine:
            whole = lambda v: np.ascontiguousarray(np.rint((v - middle) * self.scale).astype(np.int16).T)
            self.y, self.x = whole(y), whole(x)
            self.low, self.high = (np.ascontiguousarray(v.T) for v in envelope(self.y.T.astype(float), self.window))
            self.low, self.high = self.low.astype(np.int16), self.high.astype(np.int16)

    def units(self, limit: np.ndarray | float) -> np.ndarray:
        """Distances above the limit have more units than this."""
        return np.asarray(limit, float) * self.scale + self.slack

    def outside(self) -> np.ndarray:
        """Queries.outside() in units, off by less than slack."""
        return steps_outside(self.x, self.low, self.high)

    def distances(self, left: np.ndarray, units: np.ndarray | None = None) -> np.ndarray:
        """Queries by series: distances in units, off by less than slack, where left; with units, for each query, those above
        may be 65535, and elsewhere too. Pairs that are worth it are worked on in tiles, few of them one by one."""
        limit = None
        if units is not None and np.isfinite(units).any():  # fronts before the last can do without what the last cell costs
            last = np.abs(self.y[-1][:, None] - self.x[-1]) if len(self.x) > 1 else 0
            limit = np.where(left, np.clip(units[:, None] - last, 0, 65534), 0).astype(np.uint16)
        if left.mean() > 0.3:
            return all_fronts(self.y, self.x, self.window, limit)
        out = np.full(left.shape, 65535, np.uint16)
        q, k = np.nonzero(left)
        for s in range(0, len(q), 4 * FRONT):
            a, b = q[s : s + 4 * FRONT], k[s : s + 4 * FRONT]
            out[a, b] = _band(np.take(self.y, a, axis=1), np.take(self.x, b, axis=1), self.window, None if limit is None else limit[a, b])
        return out


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from 0 rounded as round() of Spark does: by their decimal text, halves up."""
    if not len(x):
        return x
    shifted = x * 10.0**digits
    out = np.floor(shifted + 0.5) / 10.0**digits
    with np.errstate(invalid="ignore"):
        close = (np.abs(shifted - np.floor(shifted) - 0.5) < 1e-5) | ~(shifted < 1e9)
    for k in np.flatnonzero(close):
        if np.isfinite(x[k]):
            out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400)))
        else:
            out[k] = x[k]
    return out


def _query_blocks(queries: DataFrame, window: int, block: int) -> list:
    """Broadcasts of at most block queries of one length each; the driver holds one block at a time."""
    sc = queries.sparkSession.sparkContext
    sent, held = [], {}

    def send(rows: list) -> None:
        sent.append(sc.broadcast(Queries([i for i, _ in rows], np.array([v for _, v in rows], float), window)))

    for r in queries.select("series", "values").where("size(values) > 0").toLocalIterator():
        rows = held.setdefault(len(r["values"]), [])
        rows.append((r.series, r["values"]))
        if len(rows) == block:
            send(held.pop(len(r["values"])))
        elif sum(map(len, held.values())) >= 8 * block:
            for k in list(held):
                send(held.pop(k))
    for rows in held.values():
        send(rows)
    return sent


def _series_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray]]:
    """Series of one length at a time: ids and values."""
    for b in batches:
        for s in range(0, b.num_rows, SERIES):
            part = b.slice(s, SERIES)
            by: dict[int, tuple[list, list]] = {}
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if v:
                    own = by.setdefault(len(v), ([], []))
                    own[0].append(i)
                    own[1].append(v)
            yield from ((ids, np.array(v, float)) for ids, v in by.values())


def _spread(series: DataFrame) -> DataFrame:
    """The series in tasks of about equal shares, some for each core: each one meets every query, which costs far more than
    its move, and a table of short rows lies in few files or row groups."""
    spark = series.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return series.select("series", "values").where("size(values) > 0").repartition(tasks)


def _id_types(*tables: DataFrame) -> tuple[list[str], list[pa.DataType]]:
    kinds = [t.schema["series"].dataType for t in tables]
    return [k.simpleString() for k in kinds], [to_arrow_type(k) for k in kinds]


def _blocks_met(batches: Iterable[pa.RecordBatch], sent: list) -> Iterator[tuple[int, Queries, list, np.ndarray]]:
    """Each block of series with each block of queries of its length, and the place of that."""
    for ids, x in _series_blocks(batches):
        for at, held in enumerate(sent):
            if held.value.values.shape[1] == x.shape[1]:
                yield at, held.value, ids, x


def dtw_within(queries: DataFrame, series: DataFrame, limit: float, window: int, block: int = QUERIES, digits: int | None = None) -> DataFrame:
    """All pairs of a query and another series of its length with a distance of at most limit: series (the query's), partner
    and distance, rounded to digits if asked for, as round() does. Exact: bounds drop only pairs that are farther. queries and
    series are (series, values) tables of numbers without nulls; null and empty arrays match nothing. Repeated rows give
    repeated pairs."""
    sent, (kinds, types) = _query_blocks(queries, window, block), _id_types(queries, series)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: dict[int, int] = {}  # block of queries -> blocks of series to go until bounds are tried again
        for at, own, ids, x in _blocks_met(batches, sent):
            left = own.others(ids) & (own.ends(x) <= limit)
            turn[at] = turn.get(at, 0) - 1
            rough = Rough(own, x) if turn[at] < 0 else None
            if rough and rough.fine:
                most = rough.units(limit)
                left &= (rough.outside() <= most) | rough.odd
                left &= (rough.distances(left & ~rough.odd, np.full(len(own.ids), most)) <= most) | rough.odd
                turn[at] = 16 if left.mean() > 0.6 else 0  # bounds that leave most pairs cost more than they save
            d = own.measure_where(left, x, limit)
            q, k = np.nonzero(d <= limit)
            d, names = d[q, k], pa.array(own.ids, types[0])
            partners = pa.array(ids, types[1])
            for s in range(0, len(q), ROWS):
                part = slice(s, s + ROWS)
                columns = [names.take(pa.array(q[part])), partners.take(pa.array(k[part])), pa.array(d[part] if digits is None else half_up(d[part], digits))]
                yield pa.RecordBatch.from_arrays(columns, names=["series", "partner", "distance"])

    return _spread(series).mapInArrow(search, f"series {kinds[0]}, partner {kinds[1]}, distance double")


def dtw_bounds(queries: DataFrame, series: DataFrame, limit: float, window: int, block: int = QUERIES) -> DataFrame:
    """How many pairs of dtw_within() each step leaves, by query: pairs, by_ends, by_envelope and within. Whole numbers tell
    most pairs apart; those near the limit are measured exactly."""
    sent, (kinds, types) = _query_blocks(queries, window, block), _id_types(queries)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}  # block of queries -> four counts of each
        for at, own, ids, x in _blocks_met(batches, sent):
            other = own.others(ids)
            ends = other & (own.ends(x) <= limit)
            rough = Rough(own, x)
            if rough.fine:
                most, least = rough.units(limit), rough.units(limit) - 2 * rough.slack
                outside = rough.outside()
                near, open_ = ends & ~rough.odd & (outside <= least), ends & (rough.odd | (outside > least) & (outside <= most))
                if open_.any():
                    some = open_.any(axis=0)
                    near[:, some] |= open_[:, some] & (own.outside(x[some]) <= limit)
                d = rough.distances(near & ~rough.odd, np.full(len(own.ids), most))
                close, open_ = near & ~rough.odd & (d <= least), near & (rough.odd | (d > least) & (d <= most))
                q, k = np.nonzero(open_)
                close[q, k] = own.measure(q, k, x, np.full(len(q), limit)) <= limit
            else:
                near = ends & (own.outside(x) <= limit)
                close = own.measure_where(near, x, limit) <= limit
            counts[at] = counts.get(at, 0) + np.stack([f.sum(axis=1) for f in (other, ends, near, close)])
        for at, found in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(sent[at].value.ids, types[0]), *(pa.array(c.astype(np.int64)) for c in found)], names=["series", "pairs", "by_ends", "by_envelope", "within"])

    found = _spread(series).mapInArrow(search, f"series {kinds[0]}, pairs long, by_ends long, by_envelope long, within long")
    return found.groupBy("series").agg(*[F.sum(c).alias(c) for c in ("pairs", "by_ends", "by_envelope", "within")])


def dtw_nearest(queries: DataFrame, series: DataFrame, k: int, window: int, block: int = QUERIES) -> DataFrame:
    """The k nearest other series of its length of each query: series, partner, distance and place from 1; equals by partner.

    Each task keeps the k best that it has met and prunes by the worst of them; the best of all tasks are the answer. It is
    exact. Distances in whole numbers tell for each block how far the k best lie at most, and few others are measured, in the
    order of their bound. Ids of queries must be distinct."""
    sent, (kinds, types) = _query_blocks(queries, window, block), _id_types(queries, series)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}  # query id -> at most k (distance, partner)
        worst: dict[int, np.ndarray] = {}  # block of queries -> what the answers of each don't exceed
        for at, own, ids, x in _blocks_met(batches, sent):
            now = worst.setdefault(at, np.full(len(own.ids), np.inf))
            left = own.others(ids) & (own.ends(x) <= now[:, None])
            rough = Rough(own, x)
            if rough.fine:
                most = rough.units(now)
                left &= (rough.outside() <= most[:, None]) | rough.odd
                found = np.where(left & ~rough.odd, rough.distances(left & ~rough.odd, most), 65535)
                if found.shape[1] >= k:
                    last = np.partition(found, k - 1, axis=1)[:, k - 1]
                    now[:] = np.where(last < 65535, np.minimum(now, (last + rough.slack) / rough.scale), now)
                bounds = np.where(rough.odd, 0.0, np.maximum(0.0, found - rough.slack) / rough.scale)
                left &= bounds <= now[:, None]
            else:
                bounds = own.outside(x)
                left &= ~(bounds > now[:, None])
            q, s = np.nonzero(left)
            bound = bounds[q, s]
            order = np.argsort(bound, kind="stable")
            q, s, bound = q[order], s[order], bound[order]
            start = 0
            while start < len(q):
                part = slice(start, start + (FRONT if np.isfinite(now).all() else max(16, 2 * len(own.ids))))
                near = np.flatnonzero(bound[part] <= now[q[part]]) + start
                d = own.measure(q[near], s[near], x, now[q[near]])
                good = np.isfinite(d) & (d <= now[q[near]])
                for a, b, v in zip(q[near[good]].tolist(), s[near[good]].tolist(), d[good].tolist(), strict=True):
                    kept = best.setdefault(own.ids[a], [])
                    kept.append((v, ids[b]))
                    kept.sort(key=lambda r: (r[0], r[1] is None, r[1]))
                    del kept[k:]
                    if len(kept) == k:
                        now[a] = min(now[a], kept[-1][0])
                start = part.stop
        rows = [(i, p, d) for i, kept in best.items() for d, p in kept]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*types, pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["series", "partner", "distance"])

    found = _spread(series).mapInArrow(search, f"series {kinds[0]}, partner {kinds[1]}, distance double")
    place = F.row_number().over(Window.partitionBy("series").orderBy("distance", F.col("partner").asc_nulls_last()))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k)
