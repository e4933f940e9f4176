"""Codes of vectors against plain loops in whole numbers, and the transform against its definition."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowkit.llm import vector_codes

SF = "/root/testdata/sf0.001"
NAMES = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def by_hand(rows, parts=16, entries=64, rounds=2):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not rows:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in rows) // parts))
    cut = [[(v + [0] * (parts * width - len(v)))[j * width : (j + 1) * width] for j in range(parts)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[cut[k][j] for k in order] for j in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(c[j], e, strict=True)), k) for k, e in enumerate(books[j])) for j in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for j in range(parts):
            for e in range(len(books[j])):
                own = [c[j] for c, f in zip(cut, found, strict=True) if f[j][1] == e]
                if own:
                    books[j][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    of = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        of[label] = of.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{k:02x}" for _, k in f), e, of[label], digest) for (i, _, label), f, e in zip(rows, found, error, strict=True)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_transform():
    for p in (1, 2, 4, 8, 16, 32):
        h = vector_codes.walsh(np.eye(p, dtype=np.int64)).T
        assert (h @ h.T == p * np.eye(p)).all() and set(np.unique(h)) <= {-1, 1}
        assert [(np.diff(r) != 0).sum() for r in h] == list(range(p))


@pytest.mark.parametrize("width", [1, 3, 4, 7, 16])
def test_nearest(width):
    rng = np.random.default_rng(width)
    base = np.cumsum(rng.integers(-9, 10, (300, width)), axis=1)
    entries = np.concatenate([base[:30], base[:3], base[5:8] + 1])
    found, distance, work = vector_codes.nearest(base, entries)
    want = ((base[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (found == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()
    p = 1 << max(0, width - 1).bit_length()
    assert p < 4 or work < 0.8 * want.size * p  # most entries are out early
    exact = vector_codes.nearest(base.astype(object) << 70, entries.astype(object) << 70)
    assert (exact[0] == found).all() and [x >> 140 for x in exact[1]] == distance.tolist()


def test_given_vectors(spark, duck, spark_rows):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = vector_codes.compress_vectors(vectors.repartition(3))
    assert rows_of(got) == by_hand([(r.vec_id, [float(x) for x in r.embedding], r.label) for r in vectors.collect()])
    assert spark_rows(got) == duck(SF, vector_codes.ORACLE)


def test_odd_vectors(spark):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    vec = lambda n, scale=1.0: [rng.choice([-1, 1]) * rng.random() * scale for _ in range(n)]
    rows = [(k, vec(48), rng.choice([1, 2, None])) for k in range(90)]
    rows += [(None, vec(48), 1), (7, vec(48), 1), rows[8], rows[8], (100, None, 1), (101, [None, *vec(47)], 1), (102, [nan, *vec(47)], 1), (103, [inf] * 48, 2), (104, [-inf] * 48, None), (105, [], 2), (106, vec(31), 3), (-5, [0.0] * 48, 1), (107, vec(48, 1e4), 3)]
    kind = "vec_id long, embedding array<double>, label int, v long, code string, slot int, of int"
    odd = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], kind).repartition(4)
    assert rows_of(vector_codes.compress_vectors(odd)) == by_hand(rows)
    few = odd.where("vec_id < 5 or vec_id in (105, 100)")
    assert rows_of(vector_codes.compress_vectors(few)) == by_hand([r for r in rows if r[0] is not None and (r[0] < 5 or r[0] in (105, 100))])
    for none in (odd.where("false"), odd.where("vec_id = 100")):
        assert vector_codes.compress_vectors(none).collect() == [] and vector_codes.compress_vectors(none).columns == NAMES
    empty = odd.where("vec_id = 105")
    assert rows_of(vector_codes.compress_vectors(empty)) == by_hand([(105, [], 2)])


def test_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice([-1, 1]) * rng.randrange(1 << 20) / 3 for _ in range(256)], 0) for k in range(70)]
    rows += [(k, [float(1 << 22)] * 256, 0) for k in (-1, 200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = vector_codes.whole_vectors(vectors, "embedding", 256, "vec_id", "label")
    assert vector_codes.train(whole, "vec_id", rounds=0).exact
    assert rows_of(vector_codes.compress_vectors(vectors)) == by_hand(rows)


def test_a_hot_label(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: F.rand(3) * k).alias("embedding"), F.when(F.col("id") % 3 > 0, 1).alias("label"))
    got = vector_codes.compress_vectors(rows)
    sums = {r.of: r.s for r in got.join(rows, "vec_id").groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("s")).collect()}
    assert {r.label: r.label_error for r in got.join(rows, "vec_id").select("label", "label_error").distinct().collect()} == sums
