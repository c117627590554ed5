"""Points dealt to tasks by place: ranges of a curve through squares (Morton order), about `cap` points each however they
cluster, by one range shuffle.  What a task does not hold lies in squares outside its range, so every point knows how far
it is from the next place that its task cannot see (its horizon); what is closer than that is settled there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAP = 4096  # points of a task
BITS = 25  # squares an axis over the extent; twice as many with the shift
CHUNK = 1 << 22  # distances held at a time
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


@dataclass
class Frame:
    """Lowest x and y, side of the extent and shift of the squares (0 to 1 of the extent), which moves their edges."""

    x: float
    y: float
    side: float
    shift: tuple[float, float]

    def at(self, c, axis: int):
        """Coordinate in squares, of a column or an array."""
        return (c - (self.x, self.y)[axis]) / self.side * 2.0**BITS + self.shift[axis] * 2.0**BITS


def frame(points: DataFrame, turn: int = 0) -> Frame | None:
    """Frame of points with finite places; None if there are none.  Every turn has another shift."""
    box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        return None
    shift = np.random.default_rng(turn).random(2)
    return Frame(box[0], box[2], max(box[1] - box[0], box[3] - box[2]) or 1.0, (float(shift[0]), float(shift[1])))


def _code(where: Frame) -> Column:
    parts = []
    for axis, c in enumerate("xy"):
        v = F.least(F.greatest(F.floor(where.at(F.col(c), axis)), F.lit(0)), F.lit(2 ** (BITS + 1) - 1)).cast("long")
        for by, mask in _SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        parts.append(v)
    return parts[0].bitwiseOR(F.shiftleft(parts[1], 1))


def dealt(points: DataFrame, by: list[str], where: Frame, tasks: int) -> DataFrame:
    """points with _code in `tasks` ranges of key and code, sorted inside."""
    coded = points.withColumn("_code", _code(where))
    ranged = coded.repartitionByRange(tasks, *by, "_code") if tasks > 1 else coded.coalesce(1)
    return ranged.sortWithinPartitions(*by, "_code")


def _squares(start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(x, y, size) of the squares that fill codes start to stop - 1."""
    while start < stop:
        k = 0
        while k <= BITS and start % 4 ** (k + 1) == 0 and start + 4 ** (k + 1) <= stop:
            k += 1
        x = sum((start >> 2 * i & 1) << i for i in range(BITS + 1))
        y = sum((start >> 2 * i + 1 & 1) << i for i in range(BITS + 1))
        yield x, y, 1 << k
        start += 4**k


def horizon(g: pd.DataFrame, where: Frame, first: bool, last: bool) -> np.ndarray:
    """Distance from every row to the next place that may hold points of its key in other tasks; first, last: whether
    there may be rows of smaller and of larger codes."""
    u, v = where.at(g["x"].to_numpy(), 0), where.at(g["y"].to_numpy(), 1)
    out = np.full(len(g), np.inf)
    codes = g["_code"]
    outside = [(0, int(codes.iloc[0]))] if first else []
    outside += [(int(codes.iloc[-1]) + 1, 4 ** (BITS + 1))] if last else []
    for start, stop in outside:
        for x, y, size in _squares(start, stop):
            dx, dy = np.maximum(np.maximum(x - u, u - x - size), 0), np.maximum(np.maximum(y - v, v - y - size), 0)
            np.minimum(out, np.hypot(dx, dy), out=out)
    # less a margin for rounding
    return np.maximum(out - 1e-6, 0) * (where.side / 2.0**BITS) * (1 - 1e-9)


def groups(batches: Iterator[pd.DataFrame], by: list[str], where: Frame, tasks: int) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows of one key, their horizons) of a task's batches."""
    parts = [b for b in batches if len(b)]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    keyed = [g for _, g in rows.groupby(by, sort=False, dropna=False)] if by else [rows]
    for i, g in enumerate(keyed):
        yield g, horizon(g, where, tasks > 1 and i == 0, tasks > 1 and i == len(keyed) - 1)


def closest(x: np.ndarray, y: np.ndarray, ox: np.ndarray, oy: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, distance, whether others are as close) of the closest other of every place; ties: the lowest rank.  Distances
    are computed in pieces of bounded size."""
    at, far, tied = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros(len(x), dtype=bool)
    if not len(ox):
        return at, far, tied
    step = max(1, CHUNK // len(ox))
    for i in range(0, len(x), step):
        # squares find the candidates, of which the distances then decide
        d, e = ox - x[i : i + step, None], oy - y[i : i + step, None]
        d = d * d + e * e
        best = d.argmin(axis=1)
        near = d <= d[np.arange(len(d)), best][:, None] * (1 + 1e-12) + 1e-290
        far[i : i + step] = np.hypot(ox[best] - x[i : i + step], oy[best] - y[i : i + step])
        for r in np.flatnonzero(np.count_nonzero(near, axis=1) > 1):
            some = np.flatnonzero(near[r])
            exact = np.hypot(ox[some] - x[i + r], oy[some] - y[i + r])
            same = some[exact == exact.min()]
            best[r], far[i + r], tied[i + r] = same[rank[same].argmin()], exact.min(), len(same) > 1
        at[i : i + step] = best
    return at, far, tied


class _Side:
    """Places of one side with their ids in order: `next` is the first id that is still open."""

    def __init__(self, g: pd.DataFrame, hor: np.ndarray):
        order = np.lexsort((g["id"].to_numpy(), g["y"].to_numpy() + 0.0, g["x"].to_numpy() + 0.0))
        self.ids, x, y = g["id"].to_numpy()[order], g["x"].to_numpy()[order] + 0.0, g["y"].to_numpy()[order] + 0.0
        new = np.ones(len(order), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        self.next = np.flatnonzero(new)
        self.end = np.append(self.next[1:], len(order)) if len(order) else self.next
        self.x, self.y, self.horizon = x[self.next], y[self.next], hor[order][self.next]
        n = len(self.next)
        self.to, self.far, self.tied = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros(n, dtype=bool)

    def open(self) -> np.ndarray:
        return np.flatnonzero(self.next < self.end)

    def look(self, rows: np.ndarray, other: _Side) -> None:
        there = other.open()
        at, self.far[rows], self.tied[rows] = closest(self.x[rows], self.y[rows], other.x[there], other.y[there], other.ids[other.next[there]])
        self.to[rows] = there[at] if len(there) else -1

    def stale(self, other: _Side, used: np.ndarray) -> np.ndarray:
        """Open places whose closest was used, or of whose equally close ones one was."""
        mine = self.open()
        hit = np.zeros(len(other.next) + 1, dtype=bool)
        hit[used] = True
        hit = hit[self.to[mine]]
        even = np.flatnonzero(self.tied[mine] & ~hit)
        step = max(1, CHUNK // max(1, len(used)))
        for i in range(0, len(even), step):
            rows = mine[even[i : i + step]]
            d = np.hypot(other.x[used] - self.x[rows, None], other.y[used] - self.y[rows, None])
            hit[even[i : i + step]] = (d == self.far[rows, None]).any(axis=1)
        return mine[hit]


def pair_off(g: pd.DataFrame, hor: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """(src, dst, dist, rows still open) of repeated mutual matching of sides 0 and 1 of one key.  Pairs are taken only if
    both are closer to each other than to their horizons, so that no other task can hold a closer one; rows without
    an open partner within the radius, and with none beyond the horizon, are dropped.

    Pairs go by (dist, src, dst), which both sides' order of preference follows; so equal places are matched in the order of
    their ids, all at once unless another place is as close."""
    side = g["side"].to_numpy()
    a, b = (_Side(g[side == k], hor[side == k]) for k in (0, 1))
    src, dst, dist = [], [], []
    a.look(a.open(), b)
    b.look(b.open(), a)
    while True:
        i = a.open()
        if not len(i) or not len(b.open()):
            break
        j, d = a.to[i], a.far[i]
        fine = (b.to[j] == i) & (b.next[j] < b.end[j]) & (d <= radius) & (d < np.minimum(a.horizon[i], b.horizon[j]))
        i, j, d = i[fine], j[fine], d[fine]
        if not len(i):
            break
        n = np.where(a.tied[i] | b.tied[j], 1, np.minimum(a.end[i] - a.next[i], b.end[j] - b.next[j]))
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        src.append(a.ids[np.repeat(a.next[i], n) + within])
        dst.append(b.ids[np.repeat(b.next[j], n) + within])
        dist.append(np.repeat(d, n))
        a.next[i] += n
        b.next[j] += n
        a.look(a.stale(b, j), b)
        b.look(b.stale(a, i), a)
    left = []
    for k, s, o in ((0, a, b), (1, b, a)):
        at = s.open()
        far = s.far[at] if len(o.open()) else np.full(len(at), np.inf)
        settled = [(d > radius) | np.isinf(d) for d in (far, s.horizon[at])]
        at = at[~(settled[0] & settled[1])]
        n = s.end[at] - s.next[at]
        ids = s.ids[np.repeat(s.next[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        left.append(pd.DataFrame({"side": k, "id": ids, "x": np.repeat(s.x[at], n), "y": np.repeat(s.y[at], n)}))
    join = lambda parts, t: np.concatenate(parts) if parts else np.zeros(0, dtype=t)
    return join(src, np.int64), join(dst, np.int64), join(dist, float), pd.concat(left, ignore_index=True)


def nearest(g: pd.DataFrame, hor: np.ndarray, by: list[str], radius: float) -> pd.DataFrame:
    """Places of side 0 (by, x, y) with d, id, ox, oy of the closest of side 1 in the task (d is infinite where there is none)
    and `done`: whether no other task can hold a closer one within the radius."""
    points, others = (g["side"] == 0).to_numpy(), (g["side"] == 1).to_numpy()
    q, o = g[points], g[others].reset_index(drop=True)
    at, far, _ = closest(q["x"].to_numpy(), q["y"].to_numpy(), o["x"].to_numpy(), o["y"].to_numpy(), o["id"].to_numpy())
    out = q[[*by, "x", "y"]].copy()
    here = o.iloc[at] if len(o) else q
    return out.assign(d=far, id=here["id"].to_numpy(), ox=here["x"].to_numpy(), oy=here["y"].to_numpy(), done=(far < hor[points]) | (hor[points] > radius) | np.isinf(hor[points]))
