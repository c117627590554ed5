"""An index of points that follows their density: squares are split where they hold many places, and the nearest points
are found by branch and bound, a level of squares a round, by equi-joins.

A square side for all points would put a cluster in one bucket; here a leaf holds at most `CAP` different places wherever
they lie (but for places closer than 2^-DEPTH of the whole extent, which no further split parts).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import cut

CAP = 64  # places of a leaf
STEP = 3  # levels a split: 8 x 8 squares
DEPTH = 48
CELL = ["_cx", "_cy"]
FEW = 8192  # squares of a level up to which it is broadcast (about a MB); counted


def placed() -> Column:
    """Whether x and y are finite numbers."""
    fine = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in "xy"]
    return fine[0] & fine[1]


@dataclass
class Tree:
    """levels[i]: squares of level i * STEP (by, _cx, _cy, bounds of their places, n points, leaf), to be broadcast where
    they are FEW, as the upper levels are, of which every square holds many rows; members: places of each leaf as an array
    of (x, y, id, n)."""

    levels: list[DataFrame]
    members: DataFrame


def _at(level: int) -> list[Column]:
    return [F.shiftright(F.col(f"_g{c}"), DEPTH - level).alias(f"_c{c}") for c in "xy"]


def build(others: DataFrame, key: str, by: list[str], cap: int = CAP) -> Tree | None:
    """Index of others (key, x, y, by); None if none has a finite place.  Equal places are one, with their lowest key and
    their number.  Rounds go on only for squares with more than `cap` places."""
    places = others.where(placed()).groupBy(*by, "x", "y").agg(F.min(key).alias("id"), F.count(F.lit(1)).alias("n"))
    box = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return None
    side = max(box[1] - box[0], box[3] - box[2]) or 1.0
    deep = lambda c, low: F.least(F.floor((F.col(c) - low) / side * 2.0**DEPTH), F.lit(2**DEPTH - 1)).cast("long")
    rest = cut(places.select("*", deep("x", box[0]).alias("_gx"), deep("y", box[2]).alias("_gy")))
    levels, leaves, level = [], [], 0
    while True:
        here = rest.select("*", *_at(level))
        last = level >= DEPTH
        squares = here.groupBy(*by, *CELL).agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.sum("n").alias("n"),
            (F.lit(last) | (F.count(F.lit(1)) <= cap)).alias("leaf"),
        )
        squares = cut(squares)
        kinds = {r["leaf"]: r["count"] for r in squares.groupBy("leaf").count().collect()}
        squares = F.broadcast(squares) if sum(kinds.values()) <= FEW else squares
        levels.append(squares)
        place = F.struct("x", "y", "id", "n")
        parted = here.join(squares.select(*by, *CELL, "leaf"), [*by, *CELL])
        mine = parted.where("leaf").drop("leaf")
        leaves.append(mine.groupBy(*by, *CELL).agg(F.collect_list(place).alias("places")).withColumn("_level", F.lit(level)))
        if not kinds.get(False):
            break
        rest = cut(parted.where("not leaf").drop("leaf", *CELL))
        level += STEP
    members = leaves[0]
    for more in leaves[1:]:
        members = members.unionByName(more)
    return Tree(levels, cut(members))


def search(points: DataFrame, tree: Tree, by: list[str], k: int = 1, radius: float | None = None) -> DataFrame:
    """(by, x, y, rank, _b: struct of d, id, x, y) for every different finite place of points: its k closest others within
    the radius (ties: lowest id; equal others count one by one but bear one id).  A column _reach of points, the same for
    equal places, is a distance within which k others are known to lie.

    A row of the frontier is a place and a square that may hold one of its k closest: its least distance is not above the
    bound, the smallest of the greatest distances of squares with at least k others."""
    spot = [*by, "_px", "_py"]
    lo = F.hypot(F.greatest(F.col("x0") - F.col("_px"), F.col("_px") - F.col("x1"), F.lit(0.0)), F.greatest(F.col("y0") - F.col("_py"), F.col("_py") - F.col("y1"), F.lit(0.0)))
    hi = F.hypot(F.greatest(F.abs(F.col("x0") - F.col("_px")), F.abs(F.col("x1") - F.col("_px"))), F.greatest(F.abs(F.col("y0") - F.col("_py")), F.abs(F.col("y1") - F.col("_py"))))
    carried = [*spot, "_level", *CELL, "leaf", "_lo", "_bound"]
    bound = F.lit(float("inf") if radius is None else radius).cast("double")
    bound = F.least(bound, "_reach") if "_reach" in points.columns else bound
    start = points.where(placed()).select(*by, F.col("x").alias("_px"), F.col("y").alias("_py"), bound.alias("_bound")).distinct()
    frontier = None
    for i, squares in enumerate(tree.levels):
        if frontier is None:
            met = start.join(squares, by) if by else start.crossJoin(squares)  # the root is one square a key
            done = None
        else:
            up = [F.shiftright(c, STEP).alias(f"_u{c[-1]}") for c in CELL]
            inner = frontier.where("not leaf").select(*spot, "_bound", F.col("_cx").alias("_ux"), F.col("_cy").alias("_uy"))
            met = inner.join(squares.select("*", *up), [*by, "_ux", "_uy"])
            done = frontier.where("leaf")
        # a margin for rounding: a place on the bound itself must stay
        far = F.when(F.col("n") >= k, hi * (1 + 1e-12))
        met = met.select(*spot, F.lit(i * STEP).alias("_level"), *CELL, "leaf", lo.alias("_lo"), F.least("_bound", F.coalesce(far, "_bound")).alias("_bound"))
        both = met if done is None else met.unionByName(done.select(*carried))
        bound = F.min("_bound").over(Window.partitionBy(*spot))
        frontier = cut(both.withColumn("_bound", bound).where(F.col("_lo") <= F.col("_bound") * (1 + 1e-12)))
    found = frontier.select(*spot, "_level", *CELL).join(tree.members, [*by, "_level", *CELL])
    distance = lambda o: F.hypot(o["x"] - F.col("_px"), o["y"] - F.col("_py"))
    near = lambda o: F.struct(distance(o).alias("d"), o["id"].alias("id"), o["x"].alias("x"), o["y"].alias("y"))
    within = F.col("_b.d") <= float("inf" if radius is None else radius)
    names = [*by, F.col("_px").alias("x"), F.col("_py").alias("y")]
    if k == 1:
        best = found.select(*spot, F.array_min(F.transform("places", near)).alias("_b")).groupBy(*spot).agg(F.min("_b").alias("_b"))
        return best.where(within).select(*names, F.lit(1).alias("rank"), "_b")
    copies = F.flatten(F.transform("places", lambda o: F.array_repeat(near(o), F.least(o["n"], F.lit(k)).cast("int"))))
    best = found.select(*spot, F.explode(F.slice(F.array_sort(copies), 1, k)).alias("_b"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*spot).orderBy("_b")))
    return ranked.where((F.col("rank") <= k) & within).select(*names, "rank", "_b")
