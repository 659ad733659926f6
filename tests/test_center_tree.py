"""The centre tree and the bounded passes against every centre."""

import numpy as np
import pytest

from trailframe.operators import clustering as C
from trailframe.operators.center_tree import CenterTree


def every(cs, x, y):
    """Squared distances to all centres, the lowest id at the least one."""
    cs = sorted(cs)
    d2 = np.stack([(x - cx) * (x - cx) + (y - cy) * (y - cy) for _, cx, cy in cs], axis=1)
    return d2, np.array([c[0] for c in cs])[d2.argmin(axis=1)]


def plain(x, y, cs, passes):
    for _ in range(passes):
        _, cid = every(cs, x, y)
        cs = [(c, x[cid == c].mean(), y[cid == c].mean()) if (cid == c).any() else (c, cx, cy) for c, cx, cy in cs]
    return cs


@pytest.mark.parametrize("k,grid", [(1, 0), (7, 0), (300, 0), (300, 4), (40, 1)])
def test_tree_equals_every_centre(k, grid):
    rng = np.random.default_rng(k + grid)
    # a grid makes equal centres and ties; ids are not in the order of places
    cs = rng.uniform(-5, 25, (k, 2)) if not grid else rng.integers(0, 5 * grid, (k, 2)).astype(float)
    cs = [(int(c), *p) for c, p in zip(rng.permutation(k) + 3, cs)]
    x, y = rng.uniform(-10, 30, (2, 2000)) if not grid else rng.integers(0, 10 * grid, (2, 2000)) / 2
    d2, cid = every(cs, x, y)
    tree = CenterTree(cs)
    got = tree.nearest(x, y)
    assert (got[0] == d2.min(axis=1)).all() and (got[1] == cid).all()
    got = tree.nearest(x, y, second=True)
    assert (got[0] == d2.min(axis=1)).all() and (got[1] == cid).all()
    assert (got[2] == (np.partition(d2, 1, axis=1)[:, 1] if k > 1 else np.inf)).all()


def test_tree_coordinates_that_are_no_numbers():
    tree = CenterTree([(4, 0.0, 0.0), (2, 1.0, 1.0), (9, 5.0, 5.0)])
    d2, cid, _, _ = tree.nearest(np.array([np.nan, np.inf, 1.0]), np.array([0.0, 0.0, 1.0]))
    assert np.isnan(d2[0]) and d2[1] == np.inf and d2[2] == 0.0
    assert list(cid) == [2, 2, 2]
    assert all(len(a) == 0 for a in tree.nearest(np.array([]), np.array([])))
    with pytest.raises(ValueError):
        CenterTree([])


def test_assignment_by_tree_equals_the_array_form(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (3000, 2)))]
    rows += [(5000, None, 1.0), (5001, 1.0, None), (5002, None, None)]
    pts = spark.createDataFrame(rows, "id long, x double, y double").repartition(5)
    cs = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 60, (500, 2)))]
    a, b = ({r.id: (r.cid, r.d2) for r in C.assign_nearest(pts, cs, method=m).collect()} for m in ("array", "tree"))
    assert a == b and len(a) == 3003 and a[5000] == (None, None)


@pytest.mark.parametrize("rewrite", [0.1, 2.0])
def test_bounded_passes_give_the_plain_centres(spark, rewrite, monkeypatch):
    from functools import partial

    monkeypatch.setattr(C, "bounded_lloyd", partial(C.bounded_lloyd, rewrite=rewrite))
    rng = np.random.default_rng(9)
    spots = rng.uniform(0, 1000, (300, 2))
    x, y = (spots[rng.integers(0, 300, 6000)] + rng.normal(0, 8, (6000, 2))).T
    pts = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double").repartition(4)
    init = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x[:300], y[:300]))]
    got = C.lloyd(pts, init, max_iter=25, tol=1e-9)
    want = plain(x, y, init, got.iterations)
    assert [c for c, *_ in got.centers] == [c for c, *_ in want]
    assert np.abs(np.array(got.centers) - np.array(want)).max() < 1e-6
    # under a tenth of all distances over the passes, a fiftieth in the last one
    assert len(got.tests) == got.iterations > 5
    assert sum(got.tests) < 0.1 * 6000 * 300 * got.iterations
    if rewrite < 1:
        assert got.tests[-1] < 0.02 * 6000 * 300


def test_bounded_passes_on_ties_copies_and_missing_values(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, (2, 3000)).astype(float)
    x[:1000], y[:1000] = 3.0, 3.0
    rows = list(zip(x.tolist(), y.tolist())) + [(None, 1.0), (1.0, None), (float("nan"), 1.0)]
    pts = spark.createDataFrame(rows, "x double, y double").repartition(3)
    # equal centres: the lower id takes the points, the other stays empty
    init = [(i, float(i % 12), float(i // 12 % 3)) for i in range(60)]
    got = C.lloyd(pts, init, max_iter=8, tol=-1.0, method="bounds")
    want = plain(x, y, init, 8)
    assert np.abs(np.array(got.centers) - np.array(want)).max() < 1e-9
    assert sum(got.sizes.values()) == 3000
    kept = C.lloyd(pts, init, max_iter=8, tol=-1.0, method="bounds", on_empty="drop")
    assert {c for c, *_ in kept.centers} < {c for c, *_ in want}
    empty = C.lloyd(pts.where("x > 99"), init, max_iter=3, method="bounds")
    assert empty.centers == init and empty.converged and empty.sizes == {}
    assert C.lloyd(pts.where("x > 99"), init, max_iter=3, method="bounds", on_empty="drop").centers == []
