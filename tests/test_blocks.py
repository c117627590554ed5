"""Blocks of points by place: matches, nearest points and walks against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, neighbors

SCHEMA = "g int, id long, x double, y double"


def table(spark, sets):
    return spark.createDataFrame([(g, i, float(x), float(y)) for g, points in enumerate(sets) for i, x, y in points], SCHEMA)


def greedy(a, b, radius):
    """Pairs in the order of distance, src and dst, each point once."""
    near = sorted((np.hypot(u - x, v - y), i, j) for i, x, y in a for j, u, v in b)
    src, dst, out = set(), set(), set()
    for d, i, j in near:
        if d <= radius and i not in src and j not in dst:
            src.add(i), dst.add(j), out.add((i, j, float(d)))
    return out


def places(kind, n, r):
    if kind == "uniform":
        xy = r.random((n, 2))
    elif kind == "clustered":
        xy = r.random((n, 2)) ** 12
    elif kind == "copies":  # some twenty places
        xy = r.random((20, 2))[r.integers(0, 20, n)]
    else:  # lattice: many equal distances
        xy = r.integers(0, 8, (n, 2)) / 8.0
    return [(int(i), x, y) for i, (x, y) in zip(r.permutation(10 * n)[:n], xy)]


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies", "lattice"])
@pytest.mark.parametrize("radius", [0.1, 5.0])
def test_match_in_blocks_is_greedy(spark, kind, radius):
    r = np.random.default_rng(3)
    a, b = ([places(kind, n, r) for n in sizes] for sizes in ((150, 90), (110, 120)))
    got = neighbors.match_blocks(table(spark, a), table(spark, b), ["g"], radius, cap=48).collect()
    assert len(got) == len({(x.g, x.src) for x in got}) == len({(x.g, x.dst) for x in got})
    for g in (0, 1):
        assert {(x.src, x.dst, x.dist) for x in got if x.g == g} == greedy(a[g], b[g], radius)


def test_match_takes_groups_of_copies_at_once(spark):
    """Two places with thousands of copies each, unlike rounds that match one pair of them at a time."""
    left = spark.range(6000).select(F.lit(0).alias("g"), "id", (F.col("id") % 2).cast("double").alias("x"), F.lit(0.0).alias("y"))
    right = spark.range(5000).select(F.lit(0).alias("g"), "id", (F.col("id") % 2 + 0.25).alias("x"), F.lit(0.0).alias("y"))
    got = neighbors.match(left, right, ["g"], 0.3)
    assert got.count() == 5000 and got.where("src <> dst").count() == 0


def test_match_does_not_list_the_pairs(spark, monkeypatch):
    """8,000 points a side within the radius of all others: 64 million pairs, of which no table is made."""
    monkeypatch.setattr(neighbors, "near_pairs", None)
    r = np.random.default_rng(1)
    a, b = ([(i, x, y) for i, (x, y) in enumerate(r.random((8000, 2)))] for _ in "ab")
    got = neighbors.match(table(spark, [a]), table(spark, [b]), ["g"], 2.0)
    assert got.count() == got.select("dst").distinct().count() == 8000


def test_match_of_nothing(spark):
    none = table(spark, [])
    some = table(spark, [[(k, 0.1 * k, 0.0) for k in range(9)]])
    odd = spark.createDataFrame([(0, 1, float("nan"), 0.0), (0, 2, None, 0.0), (None, 3, 0.0, 0.0)], SCHEMA)
    for a, b in ((none, none), (some, none), (none, some), (some, odd)):
        assert neighbors.match(a, b, ["g"], 1.0).count() == 0
        assert neighbors.match(a, b, ["g"], 1.0, small=1).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "clustered", "copies", "lattice"])
@pytest.mark.parametrize("radius", [None, 0.05])
def test_nearest_in_blocks(spark, monkeypatch, kind, radius):
    monkeypatch.setattr(blocks, "CAP", 48)
    r = np.random.default_rng(4)
    a, b = ([places(kind, n, r) for n in sizes] for sizes in ((150, 90), (110, 120)))
    got = neighbors.nearest(table(spark, a), table(spark, b), "id", ["g"], radius, small=0).collect()
    assert len(got) == 240
    for x in got:
        d, i = min((np.hypot(u - x.x, v - x.y), i) for i, u, v in b[x.g])
        assert x.near_id == (i if radius is None or d <= radius else None)
        assert x.near_distance == (pytest.approx(d, abs=1e-12) if x.near_id is not None else None)


def test_walks_of_paths_and_loops(spark):
    """One long path, one loop and pieces of a random permutation, whose ends are found in a logarithmic number of rounds."""
    r = np.random.default_rng(2)
    names = r.permutation(3000).tolist()
    steps = list(zip(names[:999], names[1:1000])) + list(zip(names[1000:1700], names[1001:1700] + names[1000:1001]))
    turned = dict(zip(names[1700:], r.permutation(names[1700:]).tolist()))
    steps += [(a, b) for a, b in turned.items() if a % 7 and a != b]
    after, before = dict(steps), {b: a for a, b in steps}
    want = {}
    for n in sorted({*after, *before}):
        if n in want:
            continue
        start = n
        while start in before and before[start] != n:
            start = before[start]
        start = n if start in before else start
        walk = [start]
        while walk[-1] in after and after[walk[-1]] != start:
            walk.append(after[walk[-1]])
        want |= {m: (min(walk), k, len(walk)) for k, m in enumerate(walk)}
    got = neighbors._walked(spark.createDataFrame(steps, "a long, b long")).collect()
    assert {x.node: (x.label, x.pos, x.size) for x in got} == want and len(got) == len(want)
