"""Nearest neighbours, Voronoi regions, mutual matching, alias flags and chains over point sets per key.

Small searched sides (grid points, centroids, peaks: at most SMALL points in all) are packed into one array a key and
broadcast.  Larger ones are dealt to tasks by place (`blocks`), where most points find their closest; the others are searched
in a tree of squares split by counts (`trees`) from there.  Matches of large sets are settled in blocks of open points, too.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks, trees
from tessera.runtime import cut, ship


SMALL = 4096


def _few(others: DataFrame, small: int) -> bool:
    """Whether a searched side has at most `small` points; reads no more than that."""
    return others.limit(small + 1).count() <= small


def _packed(others: DataFrame, key: str, by: list[str]) -> DataFrame:
    points = F.struct(F.col(key).alias("id"), F.col("x").alias("x"), F.col("y").alias("y"))
    return others.groupBy(*by).agg(F.collect_list(points).alias("others")) if by else others.agg(F.collect_list(points).alias("others"))


def _spread(others: DataFrame, key: str, by: list[str], side: float) -> DataFrame:
    """(by, _bx, _by, _o: struct of id, x, y): every other in its own and the eight neighbouring buckets."""
    turns = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    point = F.struct(F.col(key).alias("id"), F.col("x").alias("x"), F.col("y").alias("y"))
    spread = others.select(*by, point.alias("_o"), F.inline(turns))
    return spread.select(*by, (F.floor(F.col("_o.x") / side) + F.col("_i")).alias("_bx"), (F.floor(F.col("_o.y") / side) + F.col("_j")).alias("_by"), "_o")


def _bucketed(points: DataFrame, side: float) -> DataFrame:
    return points.withColumn("_bx", F.floor(F.col("x") / side)).withColumn("_by", F.floor(F.col("y") / side))


def nearest(points: DataFrame, others: DataFrame, key: str, by: list[str] = [], radius: float | None = None, small: int = SMALL) -> DataFrame:  # noqa: B006
    """points with near_id, near_x, near_y and near_distance of the closest other (ties: lowest id), nulls beyond the radius.
    Others without a finite place are left out, points without one get nulls.

    Beyond `small` others, a tree of squares split by counts is searched by branch and bound (`trees`)."""
    others = others.where(trees.placed())
    if not _few(others, small):
        return _nearest_tree(points, others, key, by, radius)
    packed = _packed(others, key, by)
    joined = points.join(F.broadcast(packed), by, "left") if by else points.crossJoin(F.broadcast(packed))
    best = F.array_min(F.transform("others", lambda o: F.struct(F.hypot(o["x"] - F.col("x"), o["y"] - F.col("y")).alias("d"), o["id"].alias("id"), o["x"].alias("x"), o["y"].alias("y"))))
    out = joined.withColumn("_b", F.when(trees.placed(), best)).drop("others")
    return out.select(*points.columns, *_near(radius))


def _near(radius: float | None) -> list[Column]:
    fine = F.col("_b.d").isNotNull() if radius is None else F.col("_b.d") <= radius
    return [F.when(fine, F.col(f"_b.{a}")).alias(b) for a, b in (("id", "near_id"), ("x", "near_x"), ("y", "near_y"), ("d", "near_distance"))]


def _back(points: DataFrame, found: DataFrame, by: list[str], column: str) -> DataFrame:
    """points with a column of what was found at their key and place; null where nothing was."""
    at = [*by, "x", "y"]
    found = found.select(*[F.col(c).alias(f"_at{i}") for i, c in enumerate(at)], column)
    condition = points[at[0]].eqNullSafe(found["_at0"])
    for i, c in enumerate(at[1:], 1):
        condition = condition & points[c].eqNullSafe(found[f"_at{i}"])
    return points.join(found, condition, "left").drop(*[f"_at{i}" for i in range(len(at))])


def _nearest_tree(points: DataFrame, others: DataFrame, key: str, by: list[str], radius: float | None) -> DataFrame:
    """Each place looks among the others of its block of places; only where a closer one may lie beyond, the tree is
    searched, from the distance found."""
    kind = others.schema[key].dataType
    where = blocks.frame(others)
    if where is None:
        return points.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("near_id", kind), ("near_x", "double"), ("near_y", "double"), ("near_distance", "double"))])
    ship(points.sparkSession)
    reach = float("inf") if radius is None else float(radius)
    places = points.where(trees.placed()).select(*by, F.lit(0).alias("side"), F.lit(0).cast(kind).alias("id"), "x", "y").distinct()
    both = cut(places.unionByName(others.select(*by, F.lit(1).alias("side"), F.col(key).alias("id"), "x", "y")).dropna(subset=[*by, "id"]))
    tasks = max(1, -(-both.count() // blocks.CAP))

    def look(batches):
        for g, far in blocks.groups(batches, by, where, tasks):
            yield blocks.nearest(g, far, by, reach)

    types = "".join(f"{k} {points.schema[k].dataType.simpleString()}, " for k in by)
    seen = cut(blocks.dealt(both, by, where, tasks).mapInPandas(look, f"{types}x double, y double, d double, id {kind.simpleString()}, ox double, oy double, done boolean"))
    best = F.struct("d", "id", F.col("ox").alias("x"), F.col("oy").alias("y")).alias("_b")
    found, rest = seen.where("done").where(F.col("d") < float("inf")).select(*by, "x", "y", best), seen.where("not done")
    if not rest.isEmpty():
        tree = trees.build(others, key, by)
        found = found.unionByName(cut(trees.search(rest.select(*by, "x", "y", F.col("d").alias("_reach")), tree, by, 1, radius)).select(*by, "x", "y", "_b"))
    return _back(points, found, by, "_b").select(*points.columns, *_near(radius))


def voronoi(points: DataFrame, regions: DataFrame, key: str, by: list[str] = [], radius: float | None = None) -> DataFrame:  # noqa: B006
    """points with region, the closest region's id, or -1."""
    near = nearest(points, regions, key, by, radius)
    return near.select(*points.columns, F.coalesce("near_id", F.lit(-1)).cast("long").alias("region"))


def candidate_pairs(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """All (src, dst, dist) of two layers of a key; layers hold at most thousands of points."""
    a = left.select(*by, F.col("id").alias("src"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = right.select(*by, F.col("id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(b, by).select(*by, "src", "dst", F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")).alias("dist"))


def mutual(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that are each other's nearest (ties: lowest id)."""
    a = Window.partitionBy(*by, "src").orderBy("dist", "dst")
    b = Window.partitionBy(*by, "dst").orderBy("dist", "src")
    return pairs.withColumn("_a", F.row_number().over(a)).withColumn("_b", F.row_number().over(b)).where("_a = 1 and _b = 1").drop("_a", "_b")


def mutual_nearest(left: DataFrame, right: DataFrame, by: list[str], radius: float | None = None) -> DataFrame:
    """(by, src, dst, dist): points (by, id, x, y) of two layers that are each other's nearest (ties: lowest id), by two
    searches for the nearest instead of all pairs of a layer."""
    to = nearest(left.select(*by, "id", "x", "y"), right, "id", by, radius).where("near_id is not null")
    back = nearest(right.select(*by, "id", "x", "y"), left, "id", by, radius).where("near_id is not null")
    to = to.select(*by, F.col("id").alias("src"), F.col("near_id").alias("dst"), F.col("near_distance").alias("dist"))
    return to.join(back.select(*by, F.col("near_id").alias("src"), F.col("id").alias("dst")), [*by, "src", "dst"]).select(*by, "src", "dst", "dist")


def near_pairs(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """(src, dst, dist) of the pairs within the radius, by equi-joins on buckets of that side."""
    if not math.isfinite(radius):
        return candidate_pairs(left, right, by)
    side = radius if radius > 0 else 1.0
    joined = _bucketed(left, side).join(_spread(right, "id", by, side), [*by, "_bx", "_by"])
    dist = F.hypot(F.col("x") - F.col("_o.x"), F.col("y") - F.col("_o.y"))
    return joined.select(*by, F.col("id").alias("src"), F.col("_o.id").alias("dst"), dist.alias("dist")).where(F.col("dist") <= radius)


def match(left: DataFrame, right: DataFrame, by: list[str], radius: float, small: int = 2048) -> DataFrame:
    """Repeated mutual matching until a side is used up, and of that the pairs within the radius.  Points that are each
    other's nearest beyond the radius have no partner within it, so only pairs within the radius need to be looked at.
    Keys of up to `small` points are matched in one task each; if any is larger, all run in blocks of points."""
    left, right = (df.where(trees.placed()).dropna(subset=by) if by else df.where(trees.placed()) for df in (left, right))
    largest = left.unionByName(right).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > small:
        return match_blocks(left, right, by, radius)
    ship(left.sparkSession)

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = (t.rename(columns=lambda c: c[2:]).sort_values("id") for t in (a, b))
        dist = np.hypot(a["x"].to_numpy()[:, None] - b["x"].to_numpy(), a["y"].to_numpy()[:, None] - b["y"].to_numpy())
        open_, pairs = np.where(dist <= radius, dist, np.inf), []
        while np.isfinite(open_).any():  # the closest open pair is mutual, so every round finds one
            to, back = open_.argmin(axis=1), open_.argmin(axis=0)
            i = np.flatnonzero((back[to] == np.arange(len(to))) & np.isfinite(open_[np.arange(len(to)), to]))
            pairs += zip(i.tolist(), to[i].tolist())
            open_[i, :], open_[:, to[i]] = np.inf, np.inf
        ids = lambda t, k: t["id"].to_numpy()[[p[k] for p in pairs]] if pairs else np.zeros(0, dtype=np.int64)
        out = pd.DataFrame({"src": ids(a, 0), "dst": ids(b, 1), "dist": np.array([dist[p] for p in pairs], dtype=float)})
        for k in by[::-1]:
            out.insert(0, k, a[k].iloc[0] if len(a) else b[k].iloc[0])
        return out

    keys = ", ".join(f"{k} {left.schema[k].dataType.simpleString()}" for k in by)
    # fresh names, as both sides may come from one table
    sides = [df.select(*[F.col(k).alias(f"{s}_{k}") for k in by], *[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y")]) for s, df in (("l", left), ("r", right))]
    grouped = [df.groupBy(*[f"{s}_{k}" for k in by]) for s, df in zip("lr", sides)]
    return grouped[0].cogroup(grouped[1]).applyInPandas(work, f"{keys}, src long, dst long, dist double")


def match_rounds(left: DataFrame, right: DataFrame, by: list[str], radius: float) -> DataFrame:
    """`match` as rounds of window ranks and anti-joins over the pairs within the radius, each checkpointed, for keys of any
    size; every round matches at least the closest open pair of each key."""
    pairs = cut(near_pairs(left, right, by, radius))
    found = None
    while True:
        new = cut(mutual(pairs, by))
        if new.isEmpty():
            return new if found is None else found
        found = new if found is None else found.unionByName(new)
        pairs = cut(pairs.join(new.select(*by, "src"), [*by, "src"], "left_anti").join(new.select(*by, "dst"), [*by, "dst"], "left_anti"))


def match_blocks(left: DataFrame, right: DataFrame, by: list[str], radius: float, cap: int = blocks.CAP) -> DataFrame:
    """`match` for keys of any size without a list of the pairs within the radius, whose number grows with the square of the
    points: each round deals the open points to tasks of about `cap` by place, a task takes the pairs that no other task
    can disturb (`blocks.pair_off`), and the rest is dealt again with shifted edges, until one task holds it.  Where a round
    settles little, as in chains of pairs that wait for each other, the tasks double."""
    ship(left.sparkSession)
    types = "".join(f"{k} {left.schema[k].dataType.simpleString()}, " for k in by)

    def task(batches, where, tasks):
        for g, far in blocks.groups(batches, by, where, tasks):
            src, dst, dist, rest = blocks.pair_off(g, far, radius)
            pairs = pd.DataFrame({"side": 2, "id": src, "dst": dst, "x": dist, "y": 0.0})
            out = pd.concat([pairs, rest.assign(dst=0)], ignore_index=True)
            for k in by:
                out[k] = g[k].iloc[0]
            yield out[[*by, "side", "id", "dst", "x", "y"]].astype({"side": "int32", "id": "int64", "dst": "int64"})

    sides = [df.select(*by, F.lit(k).alias("side"), "id", "x", "y") for k, df in enumerate((left, right))]
    open_, found, turn = cut(sides[0].unionByName(sides[1])), [], 0
    n = open_.count()
    while n or not found:
        where, tasks = blocks.frame(open_, turn) or blocks.Frame(0.0, 0.0, 1.0, (0.0, 0.0)), max(1, -(-n // cap))
        work = lambda batches, where=where, tasks=tasks: task(batches, where, tasks)
        out = cut(blocks.dealt(open_, by, where, tasks).mapInPandas(work, f"{types}side int, id long, dst long, x double, y double"))
        found.append(out.where("side = 2").select(*by, F.col("id").alias("src"), "dst", F.col("x").alias("dist")))
        open_ = out.where("side < 2").drop("dst")
        rest = open_.count()
        cap, n, turn = cap * 2 if rest > 0.7 * n else cap, rest, turn + 1
    return reduce(DataFrame.unionByName, found)


def match_layers(layers: DataFrame, count: int, radius: float) -> DataFrame:
    """Matches layer, id with layer + 1 (cyclic): edges (layer, src, dst, dist)."""
    after = layers.withColumn("layer", F.pmod(F.col("layer") - 1, F.lit(count)))
    return match(layers, after, ["layer"], radius)


def alias_flags(points: DataFrame, others: DataFrame, key: str, by: list[str] = [], factor: float = 1.05, small: int = SMALL) -> DataFrame:  # noqa: B006
    """points with aliased: whether more than one other lies within factor times the smallest distance; false for points
    without a place or without others.

    Beyond `small` others, the two closest are found in the tree: the second decides."""
    others = others.where(trees.placed())
    if _few(others, small):
        packed = _packed(others, key, by)
        joined = points.join(F.broadcast(packed), by, "left") if by else points.crossJoin(F.broadcast(packed))
        d = joined.withColumn("_d", F.when(trees.placed(), F.col("others")))
        d = d.withColumn("_d", F.transform("_d", lambda o: F.hypot(o["x"] - F.col("x"), o["y"] - F.col("y"))))
        d = d.withColumn("_m", F.array_min("_d"))
        return d.select(*points.columns, F.coalesce(F.size(F.filter("_d", lambda v: v <= F.col("_m") * factor)) > 1, F.lit(False)).alias("aliased"))
    tree = trees.build(others, key, by)
    if tree is None:
        return points.select("*", F.lit(False).alias("aliased"))
    two = trees.search(points, tree, by, 2).groupBy(*by, "x", "y").agg(F.min("_b.d").alias("_first"), F.max("_b.d").alias("_last"), F.max("rank").alias("_rank"))
    flags = cut(two.select(*by, "x", "y", ((F.col("_rank") > 1) & (F.col("_last") <= F.col("_first") * factor)).alias("_flag")))
    return _back(points, flags, by, "_flag").select(*points.columns, F.coalesce("_flag", F.lit(False)).alias("aliased"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of every connected component of edges(a, b), by rounds of minimum labels with
    pointer jumping, each checkpointed."""
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(new.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def _walked(steps: DataFrame) -> DataFrame:
    """(node, label, pos, size) along steps(a, b) with at most one way into and out of every node: the smallest node of the
    node's path or loop, its place from the path's open end (of a loop: from the smallest node) and their number of nodes.

    Pointer doubling: a round's `up` is twice as far back as the last one's, so a path of n nodes takes log2(n) checkpointed
    rounds of one join.  `low` is the smallest node from here to before `up` and the way to it.  A loop is done when no node's
    `low` differs from its `up`'s: windows of one length, laid end to end, then all have the loop's."""
    both = steps.select(F.col("b").alias("node"), F.col("a").alias("up")).unionByName(steps.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("up")))
    state = both.groupBy("node").agg(F.max("up").alias("up"))
    low = F.struct(F.col("node").alias("low"), F.lit(0).cast("long").alias("way")).alias("low")
    head = F.when(F.col("up").isNull(), F.col("node")).alias("head")
    state = cut(state.select("node", "up", head, F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("pos"), low, F.lit(True).alias("moved")))
    while True:
        above = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("head").alias("_head"), F.col("pos").alias("_pos"), F.col("low").alias("_low"))
        further = F.struct(F.col("_low.low").alias("low"), (F.col("_low.way") + F.col("pos")).alias("way"))
        # while paths are open, some node of them comes to its end in every round
        moved = F.col("_up").isNull() | (F.col("low.low") != F.col("_low.low"))
        going = state.where("up is not null").join(above, "up").select("node", F.col("_up").alias("up"), F.col("_head").alias("head"), (F.col("pos") + F.col("_pos")).alias("pos"), F.least("low", further).alias("low"), moved.alias("moved"))
        state = cut(state.where("up is null").withColumn("moved", F.lit(False)).unionByName(going))
        waiting, moving = state.agg(F.count_if(F.col("up").isNotNull()), F.count_if("moved")).first()
        if not waiting or not moving:
            break
    own = state.withColumn("_of", F.coalesce("head", F.col("low.low")))
    sizes = own.groupBy("_of").agg(F.min("node").alias("label"), F.count(F.lit(1)).alias("size"))
    return own.join(sizes, "_of").select("node", "label", F.when(F.col("up").isNull(), F.col("pos")).otherwise(F.col("low.way")).alias("pos"), "size")


def chains(edges: DataFrame, count: int, shortest: int) -> DataFrame:
    """Paths over cyclic layers: edges(layer, src, dst) join (layer, src) to (layer + 1, dst); connected components with at
    least `shortest` nodes as (chain_id, layer, id, pos), pos counting along the path from its open end (a closed loop
    starts at its smallest node).  Matched layers give every node at most one edge either way."""
    node = lambda layer, i: i * count + layer
    steps = edges.select(node(F.col("layer"), F.col("src")).cast("long").alias("a"), node((F.col("layer") + 1) % count, F.col("dst")).cast("long").alias("b"))
    long_ = _walked(steps).where(F.col("size") >= shortest)
    return long_.select(F.col("label").alias("chain_id"), (F.col("node") % count).alias("layer"), F.floor(F.col("node") / count).cast("long").alias("id"), "pos")


def opposite(edges: DataFrame, count: int, start: int, radius: float, peaks: DataFrame) -> DataFrame:
    """Nodes of layer `start` with the node half a turn away: edges followed forwards and backwards, the closer end within
    the radius, each end used once (closest first)."""
    half = count // 2
    origin = peaks.where(F.col("layer") == start).select(F.col("id").alias("origin"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    ahead, back = origin.withColumn("at", F.col("origin")), origin.withColumn("at", F.col("origin"))
    for k in range(half):
        f = edges.where(F.col("layer") == (start + k) % count).select(F.col("src").alias("at"), F.col("dst").alias("to"))
        b = edges.where(F.col("layer") == (start - k - 1) % count).select(F.col("dst").alias("at"), F.col("src").alias("to"))
        ahead = ahead.join(f, "at").drop("at").withColumnRenamed("to", "at")
        back = back.join(b, "at").drop("at").withColumnRenamed("to", "at")
    ends = peaks.where(F.col("layer") == (start + half) % count).select(F.col("id").alias("at"), "x", "y")
    met = ahead.unionByName(back).join(ends, "at").withColumn("dist", F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).where(F.col("dist") <= radius)
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("origin").orderBy("dist", "at"))).where("_r = 1")
    met = met.withColumn("_r", F.row_number().over(Window.partitionBy("at").orderBy("dist", "origin"))).where("_r = 1")
    return met.select("origin", F.col("at").alias("opposite"), "dist")


def cardinal_points(chained: DataFrame, layers: dict[str, int]) -> DataFrame:
    """One row a chain with the node id at each named layer (null where the chain skips it)."""
    return chained.groupBy("chain_id").agg(*[F.min(F.when(F.col("layer") == k, F.col("id"))).alias(n) for n, k in layers.items()])


def at_bins(points: DataFrame, grid: DataFrame, by: list[str]) -> DataFrame:
    """Grid values at the points' bins (equi-join on the bin)."""
    return points.join(grid, [*by, "iy", "ix"])


def inside_radius(distance: Column, radius: float) -> Column:
    return F.coalesce(distance <= radius, F.lit(False))
