"""Grouped splits: the table of sums against all subsets, and against a search by sums for many groups."""

import random

import pytest

from flowkit.operators import splits


def rows_of(df):
    return sorted(((r.label, r.groups, r.share and round(r.share, 12), r.relaxed) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def groups(spark):
    rng = random.Random(1)
    rows = []
    for label in ("a", "b", "c", None, "tiny", "one", "pinned"):
        k = {"tiny": 3, "one": 1}.get(label, rng.randrange(6, 13))
        rows += [(label, f"g{rng.randrange(10**6):06d}", rng.randrange(1, 9 if label in ("b", "tiny") else 90), label == "pinned" or rng.random() < 0.15, 1) for _ in range(k)]
    return spark.createDataFrame(rows, "label string, group string, n long, stays boolean, v int").repartition(3)


@pytest.mark.parametrize("pinned", ["stays"])
@pytest.mark.parametrize("floors", [(20, 50), (5, 30), (10_000, 5)])
def test_tables_of_sums_and_masks_agree(groups, pinned, floors):
    masks = splits.grouped_exhaustive_split(groups, 0.2, *floors, pinned)
    assert rows_of(splits.grouped_exhaustive_split(groups, 0.2, *floors, pinned, mask_groups=0)) == rows_of(masks)


def test_many_groups(spark):
    rng = random.Random(2)
    sizes = {"big": [rng.randrange(3, 60) for _ in range(200)], "even": [10] * 40, "few": [30, 40, 50, 60, 70]}
    rows = [(label, f"g{k:03d}", n) for label, own in sizes.items() for k, n in enumerate(own)]
    found = {r.label: r for r in splits.grouped_exhaustive_split(spark.createDataFrame(rows, "label string, group string, n long")).collect()}
    for label, own in sizes.items():
        best = {0: ()}  # the best subset by sum, in plain Python
        for k, n in enumerate(own):
            for v, names in list(best.items()):
                new = (*names, f"g{k:03d}")
                if v + n not in best or (len(new), new) < (len(best[v + n]), best[v + n]):
                    best[v + n] = new
        total = sum(own)
        want = min(((round(abs(v / total - 0.2), 12), len(g), g) for v, g in best.items() if v >= 20 and total - v >= 50))
        assert tuple(found[label].groups) == want[2] and not found[label].relaxed


def test_no_groups(groups):
    assert splits.grouped_exhaustive_split(groups.where("false")).collect() == []
