"""Components against union-find, with and without the task that joins the last edges."""

import random

import pytest

from flowkit.operators.components import connected_components


def by_hand(edges):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            up.setdefault(u, u)
            up.setdefault(v, v)
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    return {x: root(x) for x in up}


_rng = random.Random(1)
GRAPHS = {
    "sorted path": [(k, k + 1) for k in range(60)],
    "nulls and loops": [(None, 1), (2, 2), (3, None), (5, 4), (4, 5)],
    "sparse": [(_rng.randrange(200), _rng.randrange(200)) for _ in range(170)],
    "hubs": [(0, k) for k in range(1, 100)] + [(500, k) for k in range(80, 200)],
    "none": [],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_components(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "a long, b long")
    for finish in (0, 1 << 14):
        found = {r.node: r.component for r in connected_components(df, finish_edges=finish).collect()}
        assert found == by_hand(GRAPHS[name])


def test_strings(spark):
    edges = [(f"k{_rng.randrange(80)}", f"k{_rng.randrange(80)}") for _ in range(60)]
    found = connected_components(spark.createDataFrame(edges, "a string, b string"), finish_edges=5)
    assert {r.node: r.component for r in found.collect()} == by_hand(edges)
