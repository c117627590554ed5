"""The tree of squares against all distances, on sets with clusters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbors, trees


@pytest.fixture(scope="module")
def sets():
    """Two thirds of the searched places in a spot a millionth wide, others spread; equal places; points all over."""
    g = np.random.default_rng(3)
    tight = 0.37 + 1e-6 * g.random((600, 2))
    wide = g.random((300, 2)) * 2 - 0.5
    others = np.concatenate([tight, wide, wide[:40]])
    points = np.concatenate([g.random((150, 2)) * 3 - 1, 0.37 + 2e-6 * g.random((100, 2)), wide[:20], wide[:5]])
    return points, others


def _frames(spark, sets, keys):
    points, others = sets
    p = [(i, i % keys, *map(float, v)) for i, v in enumerate(points)]
    o = [(i, i % keys, *map(float, v)) for i, v in enumerate(others)]
    odd = [(9000, 0, None, 0.1), (9001, 0, float("nan"), 0.1), (9002, 0, 0.3, float("inf")), (9003, 77, 0.5, 0.5)]
    return spark.createDataFrame(p + odd, "id long, g long, x double, y double"), spark.createDataFrame(o + odd[:3], "o long, g long, x double, y double")


@pytest.mark.parametrize("keys, radius, cap", [(1, None, 8), (3, None, 8), (3, 0.05, 8), (1, 1e-7, 64)])
def test_nearest_is_that_of_all_distances(spark, sets, monkeypatch, keys, radius, cap):
    points, others = sets
    p, o = _frames(spark, sets, keys)
    monkeypatch.setattr(trees.build, "__defaults__", (cap,))
    by = ["g"] if keys > 1 else []
    p = p if by else p.where("g < 77")
    got = {r.id: (r.near_id, r.near_distance) for r in neighbors.nearest(p, o, "o", by, radius, small=0).collect()}
    assert len(got) == p.count()
    index = np.arange(len(others))
    for i, v in enumerate(points):
        mine = index[index % keys == i % keys]
        d = np.hypot(*(others[mine] - v).T)
        best = d.argmin()  # the first, so the lowest id
        if radius is not None and d[best] > radius:
            assert got[i] == (None, None)
        else:
            assert got[i][1] == pytest.approx(d[best], abs=1e-15) and got[i][0] == mine[np.flatnonzero(d == d[best])[0]]
    for i in set(got) - set(range(len(points))):
        assert got[i] == (None, None)


@pytest.mark.parametrize("factor", [1.0, 1.3])
def test_alias_flags_do_not_depend_on_size(spark, sets, factor):
    p, o = _frames(spark, sets, 3)
    small, tree = ({r.id: r.aliased for r in neighbors.alias_flags(p, o, "o", ["g"], factor, small=k).collect()} for k in (10**6, 0))
    assert small == tree and len(tree) == p.count() and any(tree.values()) and not all(tree.values())


def test_leaves_and_frontiers_stay_small(spark, sets):
    p, o = _frames(spark, sets, 1)
    tree = trees.build(o, "o", [], cap=8)
    assert tree.members.agg(F.max(F.size("places"))).first()[0] <= 8
    assert tree.members.select(F.explode("places").alias("v")).agg(F.sum("v.n")).first()[0] == len(sets[1])
    found = trees.search(p.where("g < 77"), tree, [], 2)
    assert found.groupBy("x", "y").count().where("count <> 2").isEmpty()


def test_equal_places_and_none(spark):
    p = spark.createDataFrame([(1, 0.5, 0.5), (2, None, 1.0)], "id long, x double, y double")
    o = spark.createDataFrame([(7, 0.1, 0.1), (3, 0.1, 0.1), (9, 0.1, 0.1)], "o long, x double, y double")
    for small in (0, 100):
        assert sorted((r.id, r.near_id) for r in neighbors.nearest(p, o, "o", small=small).collect()) == [(1, 3), (2, None)]
        assert sorted(map(tuple, neighbors.alias_flags(p, o, "o", small=small).select("id", "aliased").collect())) == [(1, True), (2, False)]
        empty = o.where("o < 0")
        assert [r.near_id for r in neighbors.nearest(p, empty, "o", small=small).collect()] == [None, None]
        assert [r.aliased for r in neighbors.alias_flags(p, empty, "o", small=small).collect()] == [False, False]


def test_boundary_distance_at_any_size(spark, monkeypatch):
    """A mask in parts: against all bins of the other kind, with the edge packed and with it in a tree."""
    from tessera.operators import geometry

    g = np.random.default_rng(5)
    mask = g.random((24, 20)) < 0.3
    rows = [(1, int(i), int(j)) for i, j in zip(*np.nonzero(mask))] + [(2, i, j) for i in range(24) for j in range(20)]
    at = g.random((80, 2)) * [19, 23]
    points = [(k, i, float(x), float(y), int(round(y)), int(round(x))) for k in (1, 2, 3) for i, (x, y) in enumerate(at)]
    m = spark.createDataFrame(rows, "cell_id long, iy int, ix int")
    p = spark.createDataFrame(points, "cell_id long, point_id long, bx double, by_ double, iy int, ix int")
    results = []
    for small in (10**6, 0):
        monkeypatch.setattr(neighbors.nearest, "__defaults__", ([], None, small))
        got = {(r.cell_id, r.point_id): r.distance for r in geometry.boundary_distance(p, m, 24, 20).collect()}
        results.append(got)
        for i, (x, y) in enumerate(at):
            own = mask[round(y), round(x)]
            d = min(np.hypot(b - x, a - y) for a, b in zip(*np.nonzero(mask != own)))
            assert got[1, i] == pytest.approx(d if own else -d) and got[2, i] is None
        assert len(got) == 160
    assert results[0] == pytest.approx(results[1])


def test_square_bins(spark):
    from tessera.operators import geometry

    a = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 1.0, 10, 20), (2, 0.0, 2.0, 0.0, 1.0, 10, 21)], "cell_id long, x0 double, x1 double, y0 double, y1 double, h int, w int")
    assert geometry.square_bins(a).count() == 2 and len(geometry.square_bins(a).collect()) == 2
    with pytest.raises(Exception, match="aspect"):
        geometry.square_bins(a.withColumn("w", F.lit(24))).collect()


@pytest.mark.parametrize("size, factor, circular", [(7, 4, True), (8, 3, True), (5, 2, False), (6, 5, False)])
def test_upsample(spark, size, factor, circular):
    from tessera.operators import series

    x = np.random.default_rng(size).random(size)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "cell_id long, i int, v double")
    got = [r.v for r in series.upsample(df, size, factor, circular).orderBy("i").collect()]
    both = x if circular else np.concatenate([x[::-1], x])
    n, wide = len(both), len(both) * factor
    f = np.fft.fftshift(np.fft.fft(both)) * np.hanning(n)
    want = [(f * np.exp(2j * np.pi * (np.arange(n) - n // 2) * j / wide)).sum().real / n for j in range(wide)]
    assert got == pytest.approx(want if circular else want[wide // 2 :], abs=1e-12)
