"""Product codes of integer vectors by exact nearest entries over an integer Walsh-Hadamard transform.

Parts and entries are padded with zeros to a power of two, p, and transformed by additions alone. The squared distance of
two parts is the sum of the squared differences of their transforms, divided by p; the differences are added in the order of
sequency, the number of sign changes, which puts what smooth parts differ in first. The entry that leads after the first
difference is measured in full, and every entry whose sum exceeds p times that distance is out, so few entries are added up
to the end. All is done in whole numbers, so results don't depend on order or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowkit.llm.common import checkpoint

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that a task holds in whole arrays.
BATCH = 4096


def is_finite(column: str) -> Column:
    """The vector is there and holds neither null nor non-finite components."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    return F.coalesce(fine, F.lit(False))


def sequency(p: int) -> np.ndarray:
    """The rows of the Hadamard matrix of Sylvester's order, by their number of sign changes: the bit-reversed Gray code."""
    k = np.arange(p)
    gray, bits, out = k ^ (k >> 1), p.bit_length() - 1, np.zeros(p, np.int64)
    for b in range(bits):
        out |= ((gray >> b) & 1) << (bits - 1 - b)
    return out


def walsh(x: np.ndarray) -> np.ndarray:
    """The transform of the last axis, whose length is a power of two, by sequency."""
    p, shape, h = x.shape[-1], x.shape, 1
    while h < p:
        pairs = x.reshape(*shape[:-1], p // (2 * h), 2, h)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(shape)
        h *= 2
    return x[..., sequency(p)]


def padded(x: np.ndarray) -> np.ndarray:
    p = 1 << max(0, x.shape[-1] - 1).bit_length()
    return np.concatenate([x, np.zeros((*x.shape[:-1], p - x.shape[-1]), x.dtype)], axis=-1)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each part (rows) the nearest entry, the lower index of equals, its squared distance, and the differences added."""
    n = len(parts)
    a, b = walsh(padded(parts)), walsh(padded(entries))
    p = a.shape[1]
    total = (a[:, :1] - b[None, :, 0]) ** 2
    lead = parts - entries[total.argmin(axis=1)]
    bound = p * (lead * lead).sum(axis=1)
    row, entry = np.nonzero((total <= bound[:, None]).astype(bool))
    left, work = total[row, entry], total.size
    for k in range(1, p):
        left = left + (a[row, k] - b[entry, k]) ** 2
        work += len(row)
        stay = (left <= bound[row]).astype(bool)
        row, entry, left = row[stay], entry[stay], left[stay]
    least = np.minimum.reduceat(left, np.searchsorted(row, np.arange(n))) if n else left
    best = np.flatnonzero((left == least[row]).astype(bool))
    _, first = np.unique(row[best], return_index=True)
    return entry[best[first]], least // p, work


def _matrices(batches: Iterable[pa.RecordBatch], parts: int, width: int, exact: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with a last column v of integer lists, and those as an array vectors x parts x width; short ones end in zeros."""
    for b in batches:
        for k in range(0, b.num_rows, BATCH):
            part = b.slice(k, BATCH)
            lists = part.column(part.num_columns - 1)
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            flat = np.array(lists.flatten().to_pylist(), object) if exact else np.asarray(lists.flatten())
            out = np.zeros((part.num_rows, parts * width), flat.dtype if len(flat) else np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield part, out.reshape(part.num_rows, parts, width)


class Codebooks:
    """An array parts x entries x width of whole numbers, trained on vectors and used to encode them."""

    def __init__(self, books: np.ndarray, exact: bool) -> None:
        self.books, self.exact = books, exact

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def sums(self, whole: DataFrame) -> DataFrame:
        """slot (part by entries), place and total: sums of the parts nearest to each entry; place width counts them."""
        books, exact = self.books, self.exact
        parts, entries, width = books.shape

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, entries, width + 1), object)
            for _, x in _matrices(batches, parts, width, exact):
                for j in range(parts):
                    found, _, _ = nearest(x[:, j], books[j])
                    own = np.zeros((entries, width + 1), x.dtype)
                    np.add.at(own, found, np.concatenate([x[:, j], np.ones((len(x), 1), x.dtype)], axis=1))
                    total[j] += own.astype(object)
            used = np.flatnonzero(total[:, :, width].ravel())
            values = total.reshape(-1, width + 1)[used].ravel().tolist()
            places = np.tile(np.arange(width + 1, dtype=np.int32), len(used))
            columns = [pa.array(np.repeat(used, width + 1).astype(np.int32)), pa.array(places), pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "place", "total"])

        return whole.select("v").mapInArrow(add, "slot int, place int, total decimal(38,0)").groupBy("slot", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"))

    def improved(self, whole: DataFrame) -> Codebooks:
        """Each entry becomes the floor of the mean of its parts; unused ones stay."""
        parts, entries, width = self.books.shape
        total = np.zeros((parts * entries, width + 1), object)
        for r in self.sums(whole).collect():  # parts x entries x (width + 1) rows at most
            total[r.slot, r.place] = int(r.total)
        books = self.books.reshape(-1, width).copy()
        for slot in np.flatnonzero(total[:, width]).tolist():
            books[slot] = [x // total[slot, width] for x in total[slot, :width]]
        return Codebooks(books.reshape(parts, entries, width), self.exact)

    def encode(self, whole: DataFrame) -> DataFrame:
        """The other columns of whole with code and error."""
        books, exact = self.books, self.exact
        parts, _, width = books.shape
        kept = [c for c in whole.columns if c != "v"]

        def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in _matrices(batches, parts, width, exact):
                found = [nearest(x[:, j], books[j])[:2] for j in range(parts)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = sum(f[1] for f in found)
                text = codes.tobytes().hex()
                code = [text[2 * parts * k : 2 * parts * (k + 1)] for k in range(len(codes))]
                columns = [*part.columns[:-1], pa.array(code, pa.string()), pa.array(error.tolist(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, "code", "error"])

        schema = whole.select(*kept).schema.add("code", "string").add("error", "long")
        return whole.select(*kept, "v").mapInArrow(encode, schema)


def whole_vectors(vectors: DataFrame, column: str = "embedding", scale: int = SCALE, *keys: str) -> DataFrame:
    """keys and v, the floors of scale times the components, of vectors that are there and finite."""
    v = F.transform(column, lambda x: F.floor(x.cast("double") * scale))
    return vectors.where(is_finite(column)).select(*keys, v.alias("v"))


def train(whole: DataFrame, order: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that start as the parts of the first vectors by order (nulls last, equals by vector) and are improved in
    rounds over all vectors. None without vectors."""
    facts = whole.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if facts.d is None:
        return None
    width = max(1, -(-facts.d // parts))
    p = 1 << (width - 1).bit_length()
    exact = 4 * int(facts.most or 0) ** 2 * p**3 >= 1 << 62 or int(facts.most or 0) >= 1 << 46  # too much for 64 bits
    first = [r.v for r in whole.orderBy(F.col(order).asc_nulls_last(), "v").limit(entries).collect()]
    books = np.array([x + [0] * (parts * width - len(x)) for x in first], object if exact else np.int64)
    made = Codebooks(np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2)), exact)
    for _ in range(rounds):
        made = made.improved(whole)
    return made


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is there and finite.

    Codebooks start as the vectors of least vec_id; those with a null id come last, equal ids by their vectors. With
    fewer vectors than entries, codebooks are shorter. Vectors of differing lengths count as ended by zeros, to the next
    multiple of 16 from the longest; empty ones are zeros. Repeated rows count and are returned each. Errors are summed over
    equal labels, nulls together, even if a label has most rows. Without vectors there are no rows. Components beyond 64-bit
    arithmetic are worked on as unbounded integers; an error that a long can't hold fails. Other columns are ignored.
    """
    whole = whole_vectors(vectors, "embedding", SCALE, "vec_id", "label")
    books = train(whole, "vec_id")
    if books is None:
        return whole.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    coded = checkpoint(books.encode(whole))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest).alias("codebooks_sha256"))


def _rounds() -> str:
    """Common table expressions of the rounds: near<k> has each part's distance and entry, book<k> the codebooks."""
    out = []
    for k in range(ROUNDS + 1):
        squares = "list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
        out.append(f"far{k} AS (SELECT r, j, e, list_sum({squares}) AS d FROM parts a JOIN book{k} b USING (j))")
        out.append(f"near{k} AS (SELECT r, j, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e FROM far{k} GROUP BY r, j)")
        if k < ROUNDS:
            out.append(f"""mean{k} AS (SELECT j, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p
                FROM (SELECT j, e, i, sum(p[i]) AS s, count(*) AS n FROM (SELECT j, e, p, unnest(range(1, len(p) + 1)) AS i FROM near{k} JOIN parts USING (r, j)) GROUP BY j, e, i) GROUP BY j, e)""")
            out.append(f"book{k + 1} AS (SELECT j, e, coalesce(m.p, b.p) AS p FROM book{k} b LEFT JOIN mean{k} m USING (j, e))")
    return ",\n".join(out)


ORACLE = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, j, v[j * w + 1 : (j + 1) * w] AS p FROM (SELECT r, v, len(v) // {PARTS} AS w, unnest(range({PARTS})) AS j FROM kept)),
book0 AS (SELECT j, r - 1 AS e, p FROM parts WHERE r <= {ENTRIES}),
{_rounds()},
codes AS (SELECT r, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY j) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY j, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (r), digest
"""
