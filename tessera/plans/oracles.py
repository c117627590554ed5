"""DuckDB SQL with the same columns and rounding as the registered queries."""

from __future__ import annotations

from tessera.functions import savgol
from tessera.plans.queries import DEGREE, DRAWS, FS, M

PTS = """pts AS (
  SELECT (l_suppkey % 4)::BIGINT AS cell_id, (l_quantity::DOUBLE - 1) / 49.0::DOUBLE AS x, (l_extendedprice::DOUBLE - mn) / (mx - mn) AS y,
         CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s, 1.0::DOUBLE - l_discount::DOUBLE AS w,
         (l_linenumber::DOUBLE - 1) / 7.0::DOUBLE AS h
  FROM lineitem, (SELECT min(l_extendedprice::DOUBLE) AS mn, max(l_extendedprice::DOUBLE) AS mx FROM lineitem))"""
TRK = """trk AS (
  SELECT user_id AS cell_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS t,
         CASE WHEN event_type = 'error' THEN NULL ELSE value / 100 END AS x, json_extract_string(props, '$.k')::DOUBLE / 100 AS y,
         CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM events)"""
EMB = """raw_ AS (SELECT vec_id::BIGINT AS vec_id, label::BIGINT AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
emb AS (SELECT vec_id, label AS cell_id, (x - a) / (b - a) AS x, (y - c) / (e - c) AS y
        FROM raw_, (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS e FROM raw_))"""
CEN = "cen AS (SELECT cell_id AS id, avg(x) AS x, avg(y) AS y FROM emb GROUP BY 1)"


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE"


def lin(size: int, source: str = "pts", weight: str = "1.0::DOUBLE", name: str = "grid", by: str = "cell_id", open_: bool = False) -> str:
    """CTE of n and k by bilinear shares."""
    scale = f"{float(size if open_ else size - 1)}::DOUBLE"
    at = lambda low, d: f"(({low} + {d}) % {size})::INT" if open_ else f"({low} + {d})::INT"
    return f"""{name} AS (
  SELECT {by}, {at('ly', 'a.d')} AS iy, {at('lx', 'b.d')} AS ix, sum(wt * share_y * share_x) AS n, sum(wt * s * share_y * share_x) AS k
  FROM (SELECT *, {weight} AS wt, floor(y * {scale}) AS ly, y * {scale} - floor(y * {scale}) AS py, floor(x * {scale}) AS lx, x * {scale} - floor(x * {scale}) AS px FROM {source}),
       (VALUES (0), (1)) AS a(d), (VALUES (0), (1)) AS b(d),
       LATERAL (SELECT CASE WHEN a.d = 0 THEN 1 - py ELSE py END AS share_y, CASE WHEN b.d = 0 THEN 1 - px ELSE px END AS share_x)
  WHERE share_y * share_x > 0 GROUP BY ALL)"""


def div(a: str, b: str) -> str:
    return f"CASE WHEN abs({b}) < pow(2, -63) THEN CASE WHEN abs({a}) < pow(2, -63) THEN 0.0::DOUBLE ELSE sign({a}) * pow(2, 64) END ELSE ({a}) / ({b}) END"


def field(size: int) -> str:
    """CTE field: y = k / n on every bin."""
    return f"""keys_ AS (SELECT DISTINCT cell_id FROM grid),
field AS (SELECT keys_.cell_id, a.i::INT AS iy, b.i::INT AS ix, coalesce({div('k', 'n')}, 0.0::DOUBLE) AS y
  FROM keys_, range({size}) AS a(i), range({size}) AS b(i) LEFT JOIN grid ON grid.cell_id = keys_.cell_id AND grid.iy = a.i AND grid.ix = b.i)"""


def blurred(size: int, sigma: float, half: bool = True, unit: bool = False, source: str = "grid", name: str = "soft") -> str:
    g = f"exp({-0.5 if half else -1.0}::DOUBLE * pow(least(i, {size} - i), 2) / pow({sigma}::DOUBLE, 2))"
    g = f"{g} / sum({g}) OVER ()" if unit else g
    return f"""taps AS (SELECT i AS o, {g} AS g FROM range({size}) AS q(i)),
{name}_x AS (SELECT cell_id, iy, ((ix + o) % {size})::INT AS ix, sum(n * g) AS n, sum(k * g) AS k FROM {source}, taps GROUP BY ALL),
{name} AS (SELECT cell_id, ((iy + o) % {size})::INT AS iy, ix, sum(n * g) AS n, sum(k * g) AS k FROM {name}_x, taps GROUP BY ALL)"""


def kde(size: int, sigma: float, name: str = "kde_") -> str:
    return f"""{blurred(size, sigma)},
mu_ AS (SELECT cell_id, sum(k) / sum(n) AS mu FROM grid GROUP BY 1),
{name} AS (SELECT cell_id, iy, ix, (k + mu * 0.5) / (n + 0.5) AS rate FROM soft JOIN mu_ USING (cell_id))"""


GRID_OUT = f"SELECT cell_id, iy, ix, {r('n')} AS n, {r('k')} AS k FROM grid"
ARENA = """wide AS (SELECT * REPLACE (x * (cell_id + 1) AS x) FROM pts),
box_ AS (SELECT cell_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM wide GROUP BY 1),
pad_ AS (SELECT *, b - a + greatest(b - a, d - c) * 0.3::DOUBLE AS sx, d - c + greatest(b - a, d - c) * 0.3::DOUBLE AS sy FROM box_),
dim_ AS (SELECT *, CASE WHEN sx >= sy THEN 64 ELSE round(sx / sy * 64) END::INT AS w, CASE WHEN sx >= sy THEN round(sy / sx * 64) ELSE 64 END::INT AS h FROM pad_),
arena AS (SELECT *, greatest(sx / w, sy / h) AS edge FROM dim_)"""
HULL = """hull AS (
  SELECT p.cell_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM emb p JOIN emb q ON p.cell_id = q.cell_id AND p.vec_id <> q.vec_id
  WHERE NOT EXISTS (SELECT 1 FROM emb o WHERE o.cell_id = p.cell_id AND o.vec_id <> p.vec_id AND o.vec_id <> q.vec_id
                    AND (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0))"""
CLUSTERED = """away_ AS (SELECT *, min(d) OVER (PARTITION BY vec_id) AS m FROM (SELECT e.vec_id, o.vec_id AS id, sqrt(pow(o.x * o.x * o.x * o.x - e.x, 2) + pow(o.y * o.y * o.y * o.y - e.y, 2)) AS d FROM emb e, emb o))"""
NEAREST = """ranked AS (SELECT e.vec_id, e.x, e.y, c.id, sqrt(pow(c.x - e.x, 2) + pow(c.y - e.y, 2)) AS d FROM emb e, cen c),
near_ AS (SELECT vec_id, any_value(x) AS x, any_value(y) AS y, arg_min(id, (d, id)) AS id, min(d) AS d FROM ranked GROUP BY 1)"""
MUTUAL = """pairs_ AS (SELECT a.cell_id AS layer, a.vec_id AS src, b.vec_id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist
  FROM emb a JOIN emb b ON b.cell_id = (a.cell_id + 1) % 10),
order_ AS (SELECT *, row_number() OVER (PARTITION BY layer, src ORDER BY dist, dst) AS p, row_number() OVER (PARTITION BY layer, dst ORDER BY dist, src) AS q FROM pairs_),
mutual_ AS (SELECT layer, src, dst, dist FROM order_ WHERE p = 1 AND q = 1)"""


def fir(source: str, column: str, derivative: int | None, odd: bool, name: str) -> str:
    w = savgol.weights(M, DEGREE, derivative or 0) * (FS if derivative else 1.0)
    rows = ", ".join(f"({lag}, {x!r}::DOUBLE)" for lag, x in zip(range(-M, M + 1), w.tolist()))
    value = "CASE WHEN p.t + lag < 0 THEN 2 * e.lo - v.v WHEN p.t + lag > p.n - 1 THEN 2 * e.hi - v.v ELSE v.v END" if odd else "v.v"
    return f"""{name}_v AS (SELECT cell_id, t, {column} AS v, count(*) OVER (PARTITION BY cell_id) AS n FROM {source}),
{name}_e AS (SELECT cell_id, arg_min(v, t) AS lo, arg_max(v, t) AS hi FROM {name}_v GROUP BY 1),
{name} AS (
  SELECT p.cell_id, p.t, sum(wt * ({value})) AS v FROM {name}_v p JOIN {name}_e e USING (cell_id), (VALUES {rows}) AS q(lag, wt),
       LATERAL (SELECT greatest(0, least(p.n - 1, CASE WHEN p.t + lag < 0 THEN -(p.t + lag) WHEN p.t + lag > p.n - 1 THEN 2 * (p.n - 1) - (p.t + lag) ELSE p.t + lag END)) AS pos_) AS a_, {name}_v v
  WHERE v.cell_id = p.cell_id AND v.t = pos_ GROUP BY 1, 2)"""


def gaps(source: str, column: str, compat: bool, name: str) -> str:
    less = 1 if compat else 0
    lead = f"WHEN first_ > 1 AND i <= first_ THEN (max(CASE WHEN i = first_ THEN coalesce(next_, v) END) OVER (PARTITION BY cell_id))" if compat else ""
    return f"""{name}_a AS (SELECT cell_id, t, {column} AS v, row_number() OVER (PARTITION BY cell_id ORDER BY t) AS i FROM {source}),
{name}_b AS (
  SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY cell_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS p,
         min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY cell_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q,
         min(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY cell_id) AS first_, lead(v) OVER (PARTITION BY cell_id ORDER BY t) AS next_ FROM {name}_a),
{name}_c AS (SELECT b.*, x.v AS pv, y.v AS qv FROM {name}_b b LEFT JOIN {name}_a x ON x.cell_id = b.cell_id AND x.i = b.p LEFT JOIN {name}_a y ON y.cell_id = b.cell_id AND y.i = b.q),
{name} AS (
  SELECT cell_id, t, CASE {lead} WHEN v IS NOT NULL THEN v WHEN p IS NULL THEN qv WHEN q IS NULL THEN pv
         ELSE pv + (qv - pv) * ((i - p - {less}) / (q - p - {less})::DOUBLE) END AS v FROM {name}_c)"""


RUNS = """flag_ AS (SELECT cell_id, t, s = 1 AS f FROM trk),
turn_ AS (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY cell_id ORDER BY t) IS NOT DISTINCT FROM f THEN 0 ELSE 1 END AS c FROM flag_),
run_ AS (SELECT *, sum(c) OVER (PARTITION BY cell_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g, min(t) OVER (PARTITION BY cell_id) AS lo, max(t) OVER (PARTITION BY cell_id) AS hi FROM turn_),
edge_ AS (SELECT cell_id, g, min(t) AS start, max(t) + 1 AS stop, any_value(lo) AS lo, any_value(hi) AS hi FROM run_ WHERE f GROUP BY 1, 2)"""
TURN = "2 * pi() * (ky * iy % 8 / 8.0::DOUBLE + kx * ix % 8 / 8.0::DOUBLE)"
AROUND = lambda radius: ", ".join(f"({i}, {j})" for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 < i * i + j * j <= radius * radius)


def peaks(radius: float) -> str:
    n = AROUND(radius).count("(")
    return f"""sent_ AS (SELECT cell_id, iy + a AS iy, ix + b AS ix, max(rate) AS top, count(*) AS seen FROM kde_, (VALUES {AROUND(radius)}) AS o(a, b) GROUP BY ALL),
peak_ AS (SELECT k.* FROM kde_ k JOIN sent_ s USING (cell_id, iy, ix) WHERE rate > CASE WHEN seen < {n} THEN greatest(top, 0) ELSE top END)"""


STENCIL = [(f"{a}{b}", a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
REFINED = f"""{peaks(1.0)},
high_ AS (SELECT p.* FROM peak_ p JOIN (SELECT cell_id, quantile_cont(rate, 0.25) AS low FROM kde_ GROUP BY 1) USING (cell_id) WHERE rate > low),
near9 AS (SELECT h.cell_id, h.iy, h.ix, {', '.join(f"max(CASE WHEN o.a = {a} AND o.b = {b} THEN v.rate END) AS q{i}" for i, (_, a, b) in enumerate(STENCIL))}
  FROM high_ h, (VALUES {', '.join(f'({a}, {b})' for _, a, b in STENCIL)}) AS o(a, b)
  JOIN kde_ v ON v.cell_id = h.cell_id AND v.iy = least(greatest(h.iy + o.a, 0), 15) AND v.ix = least(greatest(h.ix + o.b, 0), 15) GROUP BY 1, 2, 3),
d_ AS (SELECT *, (q5 - q3) / 2 AS dx, (q7 - q1) / 2 AS dy, q5 - q4 * 2 + q3 AS xx, q7 - q4 * 2 + q1 AS yy, (q8 - q6 - q2 + q0) / 4 AS xy FROM near9),
o_ AS (SELECT *, {div('yy * dx - xy * dy', 'xx * yy - xy * xy')} AS ox, {div('xx * dy - xy * dx', 'xx * yy - xy * xy')} AS oy FROM d_),
fine_ AS (SELECT cell_id, iy, ix, (ix - ox + 0.5) / 16 AS x, (iy - oy + 0.5) / 16 AS y, q4 - (dx * ox + dy * oy) / 2 AS height FROM o_)"""
#: weights of 200 resamples of 15 blocks in 16 draws, seed 7
DRAWN = """first_ AS (SELECT i // 16 AS sample_id, i % 16 AS pos, (8 * 48271 % 2147483647 + i // 16) % 2147483647 * 16807 % 2147483647 AS v FROM range(3200) AS q(i)),
second_ AS (SELECT sample_id, (v * v % 2147483647 + pos) % 2147483647 * 69621 % 2147483647 AS v FROM first_),
weight_ AS (SELECT sample_id, ((v * v % 2147483647 * 48271 + 11) % 2147483647 // 1024 % 15)::BIGINT AS block_id, count(*)::DOUBLE AS weight FROM second_ GROUP BY 1, 2)"""
FIELDS = f"""{EMB},
third_ AS (SELECT (vec_id % 3)::BIGINT AS cell_id, (vec_id // 3 % 8)::BIGINT AS sample_id, vec_id, cell_id AS label, x, y FROM emb),
spot_ AS (SELECT cell_id, label AS id, avg(x) AS x, avg(y) AS y FROM third_ GROUP BY 1, 2),
dist_ AS (SELECT t.cell_id, sample_id, vec_id, t.x, t.y, id, sqrt(pow(s.x - t.x, 2) + pow(s.y - t.y, 2)) AS d FROM third_ t JOIN spot_ s USING (cell_id)),
own_ AS (SELECT cell_id, any_value(sample_id) AS sample_id, vec_id, any_value(x) AS x, any_value(y) AS y, arg_min(id, (d, id))::BIGINT AS field FROM dist_ GROUP BY cell_id, vec_id HAVING min(d) <= 0.15),
side_ AS (SELECT p.cell_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM third_ p JOIN third_ q ON p.cell_id = q.cell_id AND p.vec_id <> q.vec_id
  WHERE NOT EXISTS (SELECT 1 FROM third_ o WHERE o.cell_id = p.cell_id AND o.vec_id <> p.vec_id AND o.vec_id <> q.vec_id AND (q.x - p.x) * (o.y - p.y) - (q.y - p.y) * (o.x - p.x) < 0)),
field_ AS (SELECT cell_id, field, count(*) / 8.0::DOUBLE AS total, count(DISTINCT sample_id) / 8.0::DOUBLE AS probability, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, covar_pop(x, y) AS xy, var_pop(y) AS yy FROM own_ GROUP BY 1, 2),
kept_ AS (SELECT * FROM field_ f WHERE probability >= 0.5 AND sqrt((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)) <= 0.11
  AND (SELECT min(((bx - ax) * (f.my - ay) - (by_ - ay) * (f.mx - ax)) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2))) FROM side_ s WHERE s.cell_id = f.cell_id) >= 0.1 - 1e-12)"""
ROOT2 = "sqrt(-2 * ln(1 - 0.95::DOUBLE))"


def bits(y: str, rate: str) -> str:
    return f"sum(n * ({y} * ln(greatest({rate}, 1e-10)) - {rate})) / sum(n) * (50.0 / ln(2))"


def scaled(source: str, columns: list[str]) -> str:
    each = ", ".join(f"least(greatest(({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p), 0), 1) AS {c}" for c in columns)
    return f"unit_ AS (SELECT cell_id, iy, ix, {each} FROM {source} WINDOW p AS (PARTITION BY cell_id))"


def halves() -> str:
    return f"{PTS}, first_ AS (SELECT * FROM pts WHERE h < 0.4), last_ AS (SELECT * FROM pts WHERE h >= 0.4), {lin(8, 'first_', name='one')}, {lin(8, 'last_', name='two')}"


W3 = """c3 AS (SELECT cell_id, s, floor(h * 6.0::DOUBLE) AS lh, h * 6.0::DOUBLE - floor(h * 6.0::DOUBLE) AS ph, floor(y * 5.0::DOUBLE) AS ly, y * 5.0::DOUBLE - floor(y * 5.0::DOUBLE) AS py,
  floor(x * 5.0::DOUBLE) AS lx, x * 5.0::DOUBLE - floor(x * 5.0::DOUBLE) AS px FROM pts)"""

def inside(scale: str = "", edge: float = 0.0) -> str:
    """Condition on hull edges (ax, ay, bx, by_) and a point (px, py): at least `edge` inside."""
    return f"bool_and(((by_ - ay) * (px - ax) - (bx - ax) * (py - ay)) / sqrt(pow(bx - ax, 2) + pow(by_ - ay, 2)) <= -{edge} + 1e-12)"


LABEL_MASK = "mask AS (SELECT DISTINCT cell_id, least(floor(y * 16), 15)::INT AS iy, least(floor(x * 16), 15)::INT AS ix FROM emb)"


def corner_hull(shift: float) -> str:
    """CTE of the hull edges of each label's mask; of points on one line only the outermost two make an edge."""
    return f"""spot_ AS (SELECT cell_id, (ix + {shift}) / 16.0::DOUBLE AS x, (iy + {shift}) / 16.0::DOUBLE AS y FROM mask),
side_ AS (SELECT p.cell_id, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by_ FROM spot_ p JOIN spot_ q ON p.cell_id = q.cell_id AND (p.x <> q.x OR p.y <> q.y)),
bad_ AS (SELECT DISTINCT s.cell_id, ax, ay, bx, by_ FROM side_ s JOIN spot_ o ON o.cell_id = s.cell_id
  WHERE (bx - ax) * (o.y - ay) - (by_ - ay) * (o.x - ax) < 0
     OR ((bx - ax) * (o.y - ay) - (by_ - ay) * (o.x - ax) = 0 AND ((o.x - ax) * (bx - ax) + (o.y - ay) * (by_ - ay)) NOT BETWEEN 0 AND pow(bx - ax, 2) + pow(by_ - ay, 2))),
hull AS (SELECT * FROM side_ EXCEPT SELECT * FROM bad_)"""


LABEL_DIST = f"""{LABEL_MASK},
cells AS (SELECT c.cell_id, a.i::INT AS iy, b.i::INT AS ix, mask.iy IS NOT NULL AS inside FROM (SELECT DISTINCT cell_id FROM mask) c, range(16) AS a(i), range(16) AS b(i)
  LEFT JOIN mask ON mask.cell_id = c.cell_id AND mask.iy = a.i AND mask.ix = b.i),
spots AS (SELECT (cell_id + 1) % 10 AS cell_id, vec_id, x * 16 - 0.5 AS bx, y * 16 - 0.5 AS by_, least(floor(y * 16), 15)::INT AS iy, least(floor(x * 16), 15)::INT AS ix FROM emb),
owned AS (SELECT spots.*, cells.inside AS own FROM spots JOIN cells USING (cell_id, iy, ix)),
far_ AS (SELECT o.cell_id, vec_id, own, min(sqrt(pow(c.iy - by_, 2) + pow(c.ix - bx, 2))) AS dist FROM owned o JOIN cells c ON c.cell_id = o.cell_id AND c.inside <> own GROUP BY ALL),
dist_ AS (SELECT cell_id, vec_id AS point_id, CASE WHEN own THEN dist ELSE -dist END AS distance FROM far_)"""


def matched(radius: float, shift: int = 1) -> str:
    """CTEs of the edges (layer, src, dst, dist) of repeated mutual matching between layers, within the radius."""
    return f"""near0 AS (SELECT * FROM (SELECT a.cell_id AS layer, a.vec_id AS src, b.vec_id AS dst, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist
  FROM emb a JOIN emb b ON b.cell_id = (a.cell_id + {shift}) % 10) WHERE dist <= {radius}),
round_ AS (
  SELECT layer, src, dst, dist, false AS done FROM near0
  UNION ALL
  SELECT layer, src, dst, dist, m FROM (
    SELECT *, bool_or(m) OVER (PARTITION BY layer, src) AS su, bool_or(m) OVER (PARTITION BY layer, dst) AS du FROM (
      SELECT layer, src, dst, dist, row_number() OVER (PARTITION BY layer, src ORDER BY dist, dst) = 1 AND row_number() OVER (PARTITION BY layer, dst ORDER BY dist, src) = 1 AS m
      FROM round_ WHERE NOT done)) WHERE m OR NOT (su OR du)),
edge AS (SELECT layer, src, dst, dist FROM round_ WHERE done)"""


CHAINS = f"""{matched(0.08)},
st AS (SELECT src * 10 + layer AS a, dst * 10 + (layer + 1) % 10 AS b FROM edge),
und AS (SELECT a, b FROM st UNION SELECT b, a FROM st),
reach AS (SELECT a AS node, a AS seen FROM und UNION SELECT reach.node, und.b FROM reach JOIN und ON und.a = reach.seen),
comp AS (SELECT node, min(seen) AS label, count(*) AS size FROM reach GROUP BY 1),
loop_ AS (SELECT label FROM comp JOIN st ON st.a = node GROUP BY label, size HAVING count(*) >= size),
step_ AS (SELECT a, b FROM st WHERE b NOT IN (SELECT label FROM loop_)),
walk AS (SELECT node, 0::BIGINT AS pos FROM comp WHERE node NOT IN (SELECT b FROM step_) UNION ALL SELECT b, pos + 1 FROM walk JOIN step_ ON a = node),
chain AS (SELECT label AS chain_id, node % 10 AS layer, node // 10 AS id, pos FROM walk JOIN comp USING (node) WHERE size >= 3)"""


def trimmed(reach: float) -> str:
    return f"""list_ AS (SELECT chain_id, list(x ORDER BY pos) AS xs, list(y ORDER BY pos) AS ys, list(c.layer ORDER BY pos) AS ls, list(id ORDER BY pos) AS ids FROM chain c JOIN emb ON vec_id = id GROUP BY 1),
cut_ AS (
  SELECT chain_id, 0 AS a, len(xs)::INT AS b FROM list_
  UNION ALL
  SELECT chain_id, CASE WHEN first_ THEN a + 1 ELSE a END, CASE WHEN first_ THEN b ELSE b - 1 END FROM (
    SELECT chain_id, a, b, sqrt(pow(xs[a + 1] - list_avg(xs[a + 1:b]), 2) + pow(ys[a + 1] - list_avg(ys[a + 1:b]), 2)) > sqrt(pow(xs[b] - list_avg(xs[a + 1:b]), 2) + pow(ys[b] - list_avg(ys[a + 1:b]), 2)) AS first_
    FROM cut_ JOIN list_ USING (chain_id) WHERE b - a > 1 AND (b - a > 11 OR sqrt(pow(xs[a + 1] - xs[b], 2) + pow(ys[a + 1] - ys[b], 2)) > {reach}))),
last_ AS (SELECT chain_id, max(a) AS a, min(b) AS b FROM cut_ GROUP BY 1),
kept AS (SELECT chain_id, unnest(xs[a + 1:b]) AS x, unnest(ys[a + 1:b]) AS y, unnest(ls[a + 1:b]) AS layer, unnest(ids[a + 1:b]) AS id, unnest(range(0, b - a)) AS pos FROM last_ JOIN list_ USING (chain_id) WHERE b - a >= 5)"""


HEX = "cos((b.i - 12) * 2 * pi() / 8) + cos(((b.i - 12) * cos(pi() / 3) + (a.i - 12) * sin(pi() / 3)) * 2 * pi() / 8) + cos(((b.i - 12) * cos(2 * pi() / 3) + (a.i - 12) * sin(2 * pi() / 3)) * 2 * pi() / 8)"
KERNELS = """off_ AS (SELECT i, CASE WHEN i < 4 THEN i ELSE i - 8 END AS d FROM range(8) AS q(i)),
cell_ AS (SELECT a.i AS iy, b.i AS ix, (0.5 - 0.5 * cos(2 * pi() * (a.d + 4) / 7)) * (0.5 - 0.5 * cos(2 * pi() * (b.d + 4) / 7)) AS hann,
  (b.d * cos(0.3::DOUBLE) - a.d * sin(0.3::DOUBLE)) * pi() / 2 AS x, (b.d * sin(0.3::DOUBLE) + a.d * cos(0.3::DOUBLE)) * pi() / 2 AS y FROM off_ a, off_ b),
bessel_ AS (SELECT iy, ix, avg(cos(sqrt(x * x + y * y) * sin((i + 0.5) * pi() / 256))) AS j FROM cell_, range(256) AS q(i) GROUP BY 1, 2),
raw_k AS (SELECT style, iy, ix, hann * CASE WHEN sqrt(x * x + y * y) < 5.520078110286311::DOUBLE THEN 1 ELSE 0 END * CASE style WHEN 'radial' THEN j WHEN 'band' THEN cos(x) WHEN 'square' THEN cos(x) + cos(y)
  WHEN 'rbf' THEN exp(-0.25 * (x * x + y * y)) ELSE cos(x) + cos(x * cos(pi() / 3) - y * sin(pi() / 3)) + cos(x * cos(pi() / 3) + y * sin(pi() / 3)) END AS k
  FROM cell_ JOIN bessel_ USING (iy, ix), (VALUES ('radial'), ('grid'), ('band'), ('square'), ('rbf')) AS t(style)),
soft_k AS (SELECT r.style, a.i AS iy, b.i AS ix, sum(r.k * exp(-0.5 * (pow(least(abs(a.i - r.iy), 8 - abs(a.i - r.iy)), 2) + pow(least(abs(b.i - r.ix), 8 - abs(b.i - r.ix)), 2)) * pi() * pi() / 8)) AS k
  FROM raw_k r, range(8) AS a(i), range(8) AS b(i) WHERE r.style <> 'rbf' GROUP BY 1, 2, 3 UNION ALL SELECT style, iy, ix, k FROM raw_k WHERE style = 'rbf'),
unit_k AS (SELECT style, iy, ix, k / max(k) OVER (PARTITION BY style) AS k FROM soft_k),
spec_k AS (SELECT style, a.i AS u, b.i AS v, greatest(sum(k * cos(2 * pi() * (a.i * iy + b.i * ix) / 8)), 1e-9) AS f FROM unit_k, range(8) AS a(i), range(8) AS b(i) GROUP BY 1, 2, 3)"""
def profile(size: int) -> str:
    """CTEs up to prof_(cell_id, r, value): the radial autocorrelation of a kernel-density map."""
    half = size // 2
    return f"""{kde(size, 2.0)},
seen_ AS (SELECT kde_.cell_id, kde_.iy, kde_.ix, rate, coalesce(grid.n, 0) > 0 AS own FROM kde_ LEFT JOIN grid USING (cell_id, iy, ix)),
stat_ AS (SELECT cell_id, avg(rate) AS m, var_pop(rate) AS v FROM seen_ WHERE own GROUP BY 1),
tap_ AS (SELECT cell_id, iy, ix, v, CASE WHEN own THEN rate - m ELSE 0 END * (0.5 - 0.5 * cos(2 * pi() * iy / {size - 1})) * (0.5 - 0.5 * cos(2 * pi() * ix / {size - 1})) AS y FROM seen_ JOIN stat_ USING (cell_id)),
lag_ AS (SELECT p.cell_id, ((p.iy - q.iy + {size + half}) % {size})::INT AS iy, ((p.ix - q.ix + {size + half}) % {size})::INT AS ix, sum(p.y * q.y) AS ac, any_value(p.v) AS v FROM tap_ p JOIN tap_ q USING (cell_id) GROUP BY ALL),
auto_ AS (SELECT cell_id, iy, ix, ac * v / max(ac) OVER (PARTITION BY cell_id) AS ac FROM lag_),
prof_ AS (SELECT cell_id, round(sqrt(pow(iy - {half}, 2) + pow(ix - {half}, 2)))::INT AS r, avg(ac) AS value FROM auto_ GROUP BY 1, 2)"""


PROFILE = profile(16)


def kde_by_key(name: str, sigma: str, size: int = 16) -> str:
    """KDE with a deviation of each key's own (column of table per_)."""
    g = f"exp(-0.5 * (pow(least(abs(a.i - iy), {size} - abs(a.i - iy)), 2) + pow(least(abs(b.i - ix), {size} - abs(b.i - ix)), 2)) / pow({sigma}, 2))"
    return f"""{name}_s AS (SELECT cell_id, a.i::INT AS iy2, b.i::INT AS ix2, sum(n * {g}) AS n, sum(k * {g}) AS k FROM grid JOIN per_ USING (cell_id), range({size}) AS a(i), range({size}) AS b(i) GROUP BY ALL),
{name} AS (SELECT cell_id, iy2 AS iy, ix2 AS ix, (k + mu * 0.5) / (n + 0.5) AS rate FROM {name}_s JOIN mu_ USING (cell_id))"""


def heuristics(size: int) -> str:
    """CTEs up to per_(p), spread_(variance), angle_(w) and wide_(the rate behind the prior mean) by cell_id."""
    half = size // 2
    return f"""{profile(size)},
both_ AS (SELECT cell_id, r AS i, value AS y FROM prof_ WHERE r < {half} UNION ALL SELECT cell_id, {size - 1} - r, value FROM prof_ WHERE r < {half}),
freq_ AS (SELECT cell_id, f, sum(y * cos(2 * pi() * f * i / {size})) AS c, sum(y * sin(2 * pi() * f * i / {size})) AS s FROM both_, range({half + 1}) AS q(f) GROUP BY 1, 2),
fine_p AS (SELECT cell_id, j, sum(CASE WHEN f = 0 THEN c ELSE 2 * (c * cos(2 * pi() * f * j / {8 * size}) + s * sin(2 * pi() * f * j / {8 * size})) END) / {size} AS y FROM freq_, range({8 * half}) AS q(j) GROUP BY 1, 2),
turn_p AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM fine_p WINDOW w AS (PARTITION BY cell_id ORDER BY j)),
peak_p AS (SELECT cell_id, min(CASE WHEN y > p AND y > q THEN j END) / 8.0::DOUBLE AS hi, min(CASE WHEN y < p AND y < q THEN j END) / 8.0::DOUBLE AS lo FROM turn_p GROUP BY 1),
per_ AS (SELECT cell_id, least(greatest(coalesce(CASE WHEN hi IS NULL THEN lo * 2 * pi() / 3.831705970207512 WHEN lo IS NULL THEN hi * 2 * pi() / 7.015586669815619
  ELSE (hi * 2 * pi() / 7.015586669815619 + lo * 2 * pi() / 3.831705970207512) / 2 END, {half}), 3), {size}) AS p FROM peak_p),
{kde_by_key('wide_', '5 * p / pi()', size)}, {kde_by_key('tight_', 'p / (pi() * sqrt(2))', size)},
spread_ AS (SELECT cell_id, greatest(var_pop(ln(t.rate) - ln(w.rate)), 1e-3) AS variance FROM tight_ t JOIN wide_ w USING (cell_id, iy, ix) JOIN seen_ USING (cell_id, iy, ix) WHERE own GROUP BY 1),
stat2 AS (SELECT cell_id, avg(t.rate) AS m FROM tight_ t JOIN seen_ USING (cell_id, iy, ix) WHERE own GROUP BY 1),
tap2 AS (SELECT cell_id, iy, ix, CASE WHEN own THEN t.rate - m ELSE 0 END * (0.5 - 0.5 * cos(2 * pi() * iy / {size - 1})) * (0.5 - 0.5 * cos(2 * pi() * ix / {size - 1})) AS y FROM tight_ t JOIN seen_ USING (cell_id, iy, ix) JOIN stat2 USING (cell_id)),
lag2 AS (SELECT p.cell_id, ((p.iy - q.iy + {size + half}) % {size})::INT - {half} AS dy, ((p.ix - q.ix + {size + half}) % {size})::INT - {half} AS dx, sum(p.y * q.y) AS ac FROM tap2 p JOIN tap2 q USING (cell_id) GROUP BY ALL),
on_ AS (SELECT cell_id, dy, dx, CASE WHEN abs(sqrt(dx * dx + dy * dy) - p * 7.015586669815619 / (2 * pi())) <= sqrt(2) / 2 + 1e-9 THEN ac ELSE 0 END AS ac FROM lag2 JOIN per_ USING (cell_id)),
ring_ AS (SELECT cell_id, sum(ac * cos(6 * atan2(dy, dx))) AS c, sum(ac * sin(6 * atan2(dy, dx))) AS s FROM on_ GROUP BY 1),
angle_ AS (SELECT cell_id, pi() / 6 - atan2(s, c) / 6 AS w FROM ring_)"""


HEURISTICS = heuristics(16)
SCALAR = """pt_ AS (SELECT cell_id, iy, ix, round(k / 100) AS y FROM grid),
it_ AS (SELECT cell_id, iy, ix, y, 0.0::DOUBLE AS mu, 1.0::DOUBLE AS v, 0 AS i FROM pt_
  UNION ALL
  SELECT cell_id, iy, ix, y, m, CASE WHEN i % 10 = 9 THEN 1 / (1 + exp(least(greatest(m + v / 2, -10), 10))) ELSE v END, i + 1 FROM (
    SELECT *, mu - (exp(least(greatest(mu + v / 2, -10), 10)) - y + mu) / (exp(least(greatest(mu + v / 2, -10), 10)) + 1) AS m FROM it_ WHERE i < 200))"""
HART = f"""h_ AS (SELECT cell_id, a.i::INT AS ky, b.i::INT AS kx, sum(y * (cos({TURN.replace('ky', 'a.i').replace('kx', 'b.i')}) - sin({TURN.replace('ky', 'a.i').replace('kx', 'b.i')}))) / 8 AS c
  FROM field, range(8) AS a(i), range(8) AS b(i) GROUP BY 1, 2, 3)"""
REC = f"""t_ AS (SELECT cell_id, t, coalesce(x, 0) * 0.2 AS x, y * 0.01 AS y, s, 2.0::DOUBLE + (cell_id % 3) * 4 AS fs, count(*) OVER (PARTITION BY cell_id) AS n FROM trk),
u_ AS (SELECT cell_id, n, t + (t % 5) / 4.0::DOUBLE AS u FROM t_ WHERE s = 1),
two_ AS (SELECT cell_id, CASE WHEN floor(u)::BIGINT + d = n THEN n - 1 ELSE floor(u)::BIGINT + d END AS t, CASE WHEN d = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END AS c FROM u_, (VALUES (0), (1)) AS o(d) WHERE floor(u)::BIGINT + d <= n),
cnt_ AS (SELECT cell_id, t, sum(c) AS c FROM two_ GROUP BY ALL),
jump_ AS (SELECT *, coalesce(sqrt(pow(lead(x) OVER o - x, 2) + pow(lead(y) OVER o - y, 2)) > 1 / fs, false) AS bad FROM t_ WINDOW o AS (PARTITION BY cell_id ORDER BY t)),
holes AS (SELECT cell_id, t, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM jump_), {gaps('holes', 'x', True, 'gx')}, {gaps('holes', 'y', True, 'gy')}"""

ORACLES = {
    "rate_histogram": f"WITH {PTS}, {lin(16)} SELECT cell_id, iy, ix, {r('n')} AS n, {r('k')} AS k, {r(div('k', 'n'))} AS y FROM grid",
    "bin_linear": f"WITH {PTS}, {lin(16, weight='w')} {GRID_OUT}",
    "bin_nearest": f"WITH {PTS}, grid AS (SELECT cell_id, least(floor(y * 16), 15)::INT AS iy, least(floor(x * 16), 15)::INT AS ix, count(*)::DOUBLE AS n, sum(s) AS k FROM pts GROUP BY ALL) {GRID_OUT}",
    "bin_linear_lattice_l": f"WITH {PTS}, below AS (SELECT * FROM pts WHERE x < 1 AND y < 1), {lin(16, 'below', open_=True)} {GRID_OUT}",
    "bin_linear_3d_wrap": f"""WITH {PTS}, {W3} SELECT cell_id, ((lh + c.d) % 6)::INT AS ih, (ly + a.d)::INT AS iy, (lx + b.d)::INT AS ix, {r('sum(share)')} AS n, {r('sum(share * s)')} AS k
      FROM c3, (VALUES (0), (1)) AS a(d), (VALUES (0), (1)) AS b(d), (VALUES (0), (1)) AS c(d),
      LATERAL (SELECT (CASE WHEN c.d = 0 THEN 1 - ph ELSE ph END) * (CASE WHEN a.d = 0 THEN 1 - py ELSE py END) * (CASE WHEN b.d = 0 THEN 1 - px ELSE px END) AS share) WHERE share > 0 GROUP BY 1, 2, 3, 4""",
    "bin_weighted_reweighted": f"WITH {PTS}, turned AS (SELECT *, pow(greatest(cos(h * 2 * pi() - 1.0), 0), 2) AS hw FROM pts), kept AS (SELECT * FROM turned WHERE hw > 0), {lin(16, 'kept', 'hw')} {GRID_OUT}",
    "arena_geometry": f"""WITH {PTS}, {ARENA} SELECT cell_id, {r('(a + b) / 2 - edge * w / 2')} AS x0, {r('(a + b) / 2 + edge * w / 2')} AS x1, {r('(c + d) / 2 - edge * h / 2')} AS y0,
      {r('(c + d) / 2 + edge * h / 2')} AS y1, h, w, {r('1 / edge')} AS res FROM arena""",
    "unit_meter_bin_roundtrip": f"""WITH {PTS}, {ARENA}, u_ AS (SELECT wide.cell_id, arena.w AS bins, (x - ((a + b) / 2 - edge * arena.w / 2)) / (edge * arena.w) AS u FROM wide JOIN arena USING (cell_id))
      SELECT cell_id, {r('avg(u)')} AS mean_unit, {r('avg(u * bins)')} AS mean_bin, 0.0::DOUBLE AS worst FROM u_ GROUP BY 1""",
    "normalised_square": f"""WITH {PTS}, wide AS (SELECT cell_id, x * (cell_id + 1) AS x, y FROM pts),
      e_ AS (SELECT cell_id, (min(x) + max(x)) / 2 AS mx, (min(y) + max(y)) / 2 AS my, (1 - 1e-6::DOUBLE) / (greatest(max(x) - min(x), max(y) - min(y)) * 0.6 * 2) AS f FROM wide GROUP BY 1),
      n_ AS (SELECT cell_id, (x - mx) * f + 0.5 AS x, (y - my) * f + 0.5 AS y FROM wide JOIN e_ USING (cell_id))
      SELECT cell_id, {', '.join(f'{r(f"{f}({c})")} AS {f}_{c}' for c in 'xy' for f in ('min', 'max', 'avg'))} FROM n_ GROUP BY 1""",
    "safe_math": f"""SELECT event_id, {r('exp(least(greatest(value / 10 - 5, -10), 10))')} AS e, {r('ln(greatest(value - 20, 1e-10))')} AS l,
      {r('exp(-0.5 * pow((value - 20) / 10, 2)) / (10 * sqrt(2 * pi()))')} AS pdf, {r('10 * log10(exp(value / 100) * 50)')} AS db FROM events""",
    "safe_div_cases": f"SELECT id::INT AS id, {div('a', 'b')} AS q FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 2.0, 0.0), (2, -2.0, 0.0), (3, 6.0, 3.0), (4, 0.0, 5.0)) AS t(id, a, b)",
    "lgamma_table": f"SELECT i::BIGINT AS id, {r('lgamma(i / 4.0::DOUBLE + 0.5)', 5)} AS v FROM range(1, 200) AS t(i)",
    "unitscale_percentile": f"""WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM events GROUP BY 1)
      SELECT event_id, event_type, {r('least(greatest((value - a) / (b - a), 0), 1)')} AS value FROM events JOIN q USING (event_type)""",
    "lognormal_moments": f"""WITH {PTS}, {lin(8)}, m AS (SELECT cell_id, iy, ix, ln(greatest(k / n, 1e-10)) AS mu, 1 / (k + 1) AS v FROM grid)
      SELECT cell_id, iy, ix, {r('exp(mu + v / 2)')} AS mean_rate, {r('exp(2 * mu + v) * (exp(v) - 1)')} AS variance, {r('sqrt(exp(v) - 1)')} AS cv, {r('exp(mu + v / 2) * 50')} AS mean_hz,
      {r('exp(2 * mu + v) * (exp(v) - 1) * 2500')} AS variance_hz FROM m""",
    "hex_grid": f"""SELECT a.i::INT AS iy, b.i::INT AS ix, {r("cos((b.i - 12) * 2 * pi() / 8) + cos(((b.i - 12) * cos(pi() / 3) + (a.i - 12) * sin(pi() / 3)) * 2 * pi() / 8) + cos(((b.i - 12) * cos(2 * pi() / 3) + (a.i - 12) * sin(2 * pi() / 3)) * 2 * pi() / 8)")} AS value
      FROM range(24) AS a(i), range(24) AS b(i)""",
    "simulated_rate_map": f"""WITH h AS (SELECT a.i::INT AS iy, b.i::INT AS ix, exp(0.8 * (cos((b.i - 12) * 2 * pi() / 8) + cos(((b.i - 12) * cos(pi() / 3) + (a.i - 12) * sin(pi() / 3)) * 2 * pi() / 8) + cos(((b.i - 12) * cos(2 * pi() / 3) + (a.i - 12) * sin(2 * pi() / 3)) * 2 * pi() / 8))) AS v,
      a.i BETWEEN 2 AND 21 AND b.i BETWEEN 2 AND 21 AS inside FROM range(24) AS a(i), range(24) AS b(i))
      SELECT iy, ix, {r('CASE WHEN inside THEN v / (SELECT avg(v) FROM h WHERE inside) * 0.02 ELSE 0 END')} AS rate FROM h""",
    "bin_coordinates": f"SELECT a.i::INT AS iy, b.i::INT AS ix, {r('(a.i + 0.5) / 9')} AS y, {r('(b.i + 0.5) / 7')} AS x, {r('a.i / 8.0::DOUBLE')} AS y_end, {r('b.i / 6.0::DOUBLE')} AS x_end FROM range(9) AS a(i), range(7) AS b(i)",
    "hull_edges_coarse": f"WITH {EMB}, {HULL} SELECT cell_id, {r('ax')} AS ax, {r('ay')} AS ay, {r('bx')} AS bx, {r('by_')} AS by FROM hull",
    "in_hull": f"""WITH {EMB}, {HULL} SELECT e.vec_id, bool_and((bx - ax) * (e.y - ay) - (by_ - ay) * (e.x - ax) >= -1e-12) AS inside FROM emb e JOIN hull ON hull.cell_id = (e.cell_id + 9) % 10 GROUP BY 1""",
    "mask_from_hull": f"""WITH {EMB}, {HULL} SELECT cell_id, a.i::INT AS iy, b.i::INT AS ix FROM hull, range(16) AS a(i), range(16) AS b(i)
      GROUP BY ALL HAVING bool_and((bx - ax) * ((a.i + 0.5) / 16 - ay) - (by_ - ay) * ((b.i + 0.5) / 16 - ax) >= -1e-12)""",
    "spike_times_to_counts": f"""WITH spk AS (SELECT user_id AS cell_id, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE / 3600.0::DOUBLE AS u FROM events WHERE event_type = 'click'),
      two AS (SELECT cell_id, floor(u)::BIGINT + d AS t, CASE WHEN d = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END AS c FROM spk, (VALUES (0), (1)) AS o(d)),
      got AS (SELECT cell_id, CASE WHEN t = 720 THEN 719 ELSE t END AS t, sum(c) AS c FROM two WHERE t <= 720 GROUP BY ALL),
      full_ AS (SELECT cell_id, i AS t FROM (SELECT DISTINCT cell_id FROM spk), range(720) AS q(i))
      SELECT cell_id, t, {r('coalesce(c, 0)')} AS count FROM full_ LEFT JOIN got USING (cell_id, t)""",
    "run_edges": f"WITH {TRK}, {RUNS} SELECT cell_id, start, stop FROM edge_",
    "run_edges_inner": f"WITH {TRK}, {RUNS} SELECT cell_id, start, stop FROM edge_ WHERE start > lo AND stop <= hi",
    "interpolate_gaps": f"WITH {TRK}, {gaps('trk', 'x', True, 'g')} SELECT cell_id, t, {r('v', 9)} AS x FROM g",
    "interpolate_gaps_linear": f"WITH {TRK}, {gaps('trk', 'x', False, 'g')} SELECT cell_id, t, {r('v', 9)} AS x FROM g",
    "glitch_patch": f"""WITH {TRK}, zero_ AS (SELECT cell_id, t, coalesce(x, 0) AS x, y FROM trk),
      step_ AS (SELECT *, coalesce(sqrt(pow(lead(x) OVER o - x, 2) + pow(lead(y) OVER o - y, 2)) > 0.5, false) AS bad FROM zero_ WINDOW o AS (PARTITION BY cell_id ORDER BY t)),
      holes AS (SELECT cell_id, t, CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM step_), {gaps('holes', 'x', False, 'gx')}, {gaps('holes', 'y', False, 'gy')}
      SELECT gx.cell_id, gx.t, {r('gx.v', 9)} AS x, {r('gy.v', 9)} AS y FROM gx JOIN gy USING (cell_id, t)""",
    "sg_smooth": f"WITH {TRK}, {fir('trk', 'y', None, False, 'f')} SELECT cell_id, t, {r('v')} AS v FROM f",
    "sg_derivative": f"WITH {TRK}, {fir('trk', 'y', 1, True, 'f')} SELECT cell_id, t, {r('v')} AS v FROM f",
    "heading_angle": f"""WITH {TRK}, {gaps('trk', 'x', False, 'g')}, {fir('g', 'v', 1, True, 'fx')}, {fir('trk', 'y', 1, True, 'fy')}
      SELECT fx.cell_id, fx.t, {r('atan2(fy.v, fx.v)', 5)} AS heading FROM fx JOIN fy USING (cell_id, t)""",
    "block_resample_fixed": f"""WITH {TRK} SELECT cell_id, a::BIGINT AS sample_id, (p * 8 + t % 8)::BIGINT AS pos_t, {r('y')} AS y FROM trk JOIN (VALUES {', '.join(map(str, DRAWS))}) AS d(a, p, b) ON b = t // 8""",
    "cv_folds": f"""WITH {TRK}, c AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM trk), o AS (SELECT *, least(floor(t * 5 / n::DOUBLE), 4)::INT AS own FROM c)
      SELECT cell_id, f::INT AS fold, count(*) FILTER (WHERE own = f) AS tests, {r('avg(y) FILTER (WHERE own <> f)')} AS train_mean FROM o, range(5) AS q(f) GROUP BY ALL""",
    "learning_curve": f"WITH {TRK} SELECT cell_id, u::INT AS used, {r('avg(y)')} AS mean, count(*) AS rows FROM trk JOIN (VALUES (10), (20), (40)) AS q(u) ON t < u GROUP BY ALL",
    "circular_smooth": f"""WITH {PTS}, {lin(16)}, v AS (SELECT cell_id, ix, sum(n) AS v FROM grid GROUP BY ALL), k AS (SELECT i, exp(-0.5 * pow(least(i, 16 - i) / 1.5, 2)) AS g FROM range(16) AS q(i))
      SELECT cell_id, ((ix + k.i) % 16)::INT AS i, {r('sum(v * g / (SELECT sum(g) FROM k))')} AS v FROM v, k GROUP BY 1, 2""",
    "blur_grid": f"WITH {PTS}, {lin(16)}, {blurred(16, 1.5)} SELECT cell_id, iy, ix, {r('n')} AS n, {r('k')} AS k FROM soft",
    "kde_rate_map": f"WITH {PTS}, {lin(16)}, {kde(16, 2.0)} SELECT cell_id, iy, ix, {r('rate')} AS rate FROM kde_",
    "kde_packed": f"WITH {PTS}, {lin(16)}, {kde(16, 2.0)} SELECT cell_id, iy, ix, {r('rate')} AS rate FROM kde_",
    "kde_v1": f"""WITH {PTS}, {lin(16)}, {blurred(16, 2.0, False, True)}, mu_ AS (SELECT cell_id, sum(k) / sum(n) AS mu FROM grid GROUP BY 1)
      SELECT cell_id, iy, ix, {r('(k + 0.9 * mu + 0.05) / (n + 0.9)')} AS rate FROM soft JOIN mu_ USING (cell_id)""",
    "kde_v1_masked": f"""WITH {PTS}, {lin(16)}, {blurred(16, 2.0, False, True)}, mu_ AS (SELECT cell_id, sum(k) / sum(n) AS mu, avg(n) AS m FROM grid GROUP BY 1)
      SELECT cell_id, iy, ix, CASE WHEN g.n > m + 1e-6 THEN {r('(soft.k + 0.9 * mu + 0.05) / (soft.n + 0.9)')} ELSE 0.0::DOUBLE END AS rate
      FROM soft JOIN mu_ USING (cell_id) LEFT JOIN grid g USING (cell_id, iy, ix)""",
    "blur_covariance": f"""WITH {PTS}, {lin(16)}, off_ AS (SELECT i AS o, CASE WHEN i < 8 THEN i ELSE i - 16 END AS d FROM range(16) AS q(i)),
      taps AS (SELECT a.o AS oy, b.o AS ox, exp(-0.5 * (2.0::DOUBLE * b.d * b.d - 2.0 * a.d * b.d + 3.0 * a.d * a.d) / 5.0::DOUBLE) AS g FROM off_ a, off_ b)
      SELECT cell_id, ((iy + oy) % 16)::INT AS iy, ((ix + ox) % 16)::INT AS ix, {r('sum(n * g)')} AS n, {r('sum(k * g)')} AS k FROM grid, taps GROUP BY 1, 2, 3""",
    "upsampled_profile": f"""WITH {PTS}, {lin(16)}, v_ AS (SELECT cell_id, ix AS i, sum(n) AS v FROM grid GROUP BY ALL),
      long_ AS (SELECT cell_id, TRUE AS circular, 16 AS n, 0 AS skip, i AS place, v FROM v_ UNION ALL SELECT cell_id, FALSE, 32, 48, i + 16, v FROM v_ UNION ALL SELECT cell_id, FALSE, 32, 48, 15 - i, v FROM v_),
      wave_ AS (SELECT n, m - n // 2 AS f, 0.5 - 0.5 * cos(2 * pi() * m / (n - 1)) AS h FROM (VALUES (16), (32)) AS s(n), range(32) AS q(m) WHERE m < n),
      part_ AS (SELECT cell_id, circular, n, skip, f, any_value(h) AS h, sum(v * cos(2 * pi() * f * place / n)) AS re, sum(v * sin(2 * pi() * f * place / n)) AS im FROM long_ JOIN wave_ USING (n) GROUP BY ALL)
      SELECT cell_id, circular, (j - skip)::INT AS i, {r('sum(h * (re * cos(2 * pi() * f * j / (3 * n)) + im * sin(2 * pi() * f * j / (3 * n)))) / any_value(n)')} AS v
      FROM part_, range(96) AS q(j) WHERE j >= skip AND j < 3 * n GROUP BY 1, 2, 3""",
    "acorr_grid": f"""WITH {PTS}, {lin(8)}, {field(8)}, m AS (SELECT cell_id, avg(y) AS m, var_pop(y) AS v FROM field GROUP BY 1),
      t AS (SELECT cell_id, iy, ix, v, (y - m) * 0.25 * (1 - cos(2 * pi() * iy / 7)) * (1 - cos(2 * pi() * ix / 7)) AS y FROM field JOIN m USING (cell_id)),
      a AS (SELECT p.cell_id, ((p.iy - q.iy + 12) % 8)::INT AS iy, ((p.ix - q.ix + 12) % 8)::INT AS ix, sum(p.y * q.y) AS ac, any_value(p.v) AS v FROM t p JOIN t q USING (cell_id) GROUP BY ALL)
      SELECT cell_id, iy, ix, {r('ac * v / max(ac) OVER (PARTITION BY cell_id)')} AS ac FROM a""",
    "radial_average": f"WITH {PTS}, {lin(16)}, {field(16)} SELECT cell_id, round(sqrt(pow(iy - 8, 2) + pow(ix - 8, 2)))::INT AS r, {r('avg(y)')} AS y FROM field GROUP BY 1, 2",
    "hartley_transform": f"""WITH {PTS}, {lin(8)}, {field(8)} SELECT cell_id, a.i::INT AS ky, b.i::INT AS kx, {r(f"sum(y * (cos({TURN.replace('ky', 'a.i').replace('kx', 'b.i')}) - sin({TURN.replace('ky', 'a.i').replace('kx', 'b.i')}))) / 8")} AS c
      FROM field, range(8) AS a(i), range(8) AS b(i) GROUP BY 1, 2, 3""",
    "hessian_grid": f"""WITH {PTS}, {lin(8)}, {field(8)} SELECT f.cell_id, f.iy, f.ix, {r('sum(CASE WHEN a.i = 0 THEN (CASE abs(b.i) WHEN 2 THEN 0.25 WHEN 0 THEN -0.5 ELSE 0 END) * g.y ELSE 0 END)')} AS xx,
      {r('sum(CASE WHEN abs(a.i) = 1 AND abs(b.i) = 1 THEN 0.25 * a.i * b.i * g.y ELSE 0 END)')} AS xy, {r('sum(CASE WHEN b.i = 0 THEN (CASE abs(a.i) WHEN 2 THEN 0.25 WHEN 0 THEN -0.5 ELSE 0 END) * g.y ELSE 0 END)')} AS yy
      FROM field f, range(-2, 3) AS a(i), range(-2, 3) AS b(i) JOIN field g ON g.cell_id = f.cell_id AND g.iy = (f.iy + a.i + 8) % 8 AND g.ix = (f.ix + b.i + 8) % 8 GROUP BY 1, 2, 3""",
    "peaks_local_max": f"WITH {PTS}, {lin(16)}, {kde(16, 1.0)}, {peaks(1.5)} SELECT cell_id, iy, ix, {r('rate')} AS rate FROM peak_",
    "peaks_interpolated": f"""WITH {PTS}, {lin(16)}, {kde(16, 1.0)}, {REFINED} SELECT cell_id, iy, ix, {r('x', 5)} AS x, {r('y', 5)} AS y, {r('height', 5)} AS height,
      row_number() OVER (PARTITION BY cell_id ORDER BY height DESC, iy, ix) AS rank FROM fine_ WHERE x BETWEEN 0 AND 1 - 1 / 16.0::DOUBLE AND y BETWEEN 0 AND 1 - 1 / 16.0::DOUBLE""",
    "packed_roundtrip": f"""WITH {PTS}, {lin(8)} SELECT c.cell_id, a.i::INT AS iy, b.i::INT AS ix, {r('coalesce(n, 0)')} AS n, {r('coalesce(k, 0)')} AS k
      FROM (SELECT DISTINCT cell_id FROM grid) c, range(8) AS a(i), range(8) AS b(i) LEFT JOIN grid g ON g.cell_id = c.cell_id AND g.iy = a.i AND g.ix = b.i""",
    "nearest_point": f"WITH {EMB}, {CEN}, {NEAREST} SELECT vec_id, CASE WHEN d <= 0.12 THEN id END AS near_id, CASE WHEN d <= 0.12 THEN {r('d')} END AS near_distance FROM near_",
    "voronoi_assign": f"WITH {EMB}, {CEN}, {NEAREST} SELECT vec_id, CASE WHEN d <= 0.3 THEN id ELSE -1 END::BIGINT AS region FROM near_",
    "region_moments": f"""WITH {EMB}, {CEN}, {NEAREST} SELECT id::BIGINT AS region, count(*) AS n, {r('avg(x)')} AS mx, {r('avg(y)')} AS my, {r('var_samp(x)')} AS xx, {r('covar_samp(x, y)')} AS xy, {r('var_samp(y)')} AS yy FROM near_ GROUP BY 1""",
    "weighted_region_moments": f"""WITH {EMB}, {CEN}, {NEAREST}, m AS (SELECT id, sum(x * y) AS total, sum(x * y * x) / sum(x * y) AS mx, sum(x * y * y) / sum(x * y) AS my FROM near_ GROUP BY 1 HAVING sum(x * y) > 0)
      SELECT id::BIGINT AS region, {r('any_value(total)')} AS total, {r('any_value(mx)')} AS mx, {r('any_value(my)')} AS my, {r('sum(x * y / total * (x - mx) * (x - mx))')} AS xx,
      {r('sum(x * y / total * (x - mx) * (y - my))')} AS xy, {r('sum(x * y / total * (y - my) * (y - my))')} AS yy FROM near_ JOIN m USING (id) GROUP BY 1""",
    "mutual_nn_round1": f"WITH {EMB}, {MUTUAL} SELECT layer, src, dst, {r('dist')} AS dist FROM mutual_",
    "chain_components": f"""WITH RECURSIVE {EMB}, {MUTUAL}, e AS (SELECT src AS a, dst AS b FROM mutual_ WHERE dist < 0.02 UNION SELECT dst, src FROM mutual_ WHERE dist < 0.02),
      reach AS (SELECT a AS node, a AS seen FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen) SELECT node, min(seen) AS label FROM reach GROUP BY 1""",
    "alias_flags": f"WITH {EMB}, {CEN}, ranked AS (SELECT e.vec_id, sqrt(pow(c.x - e.x, 2) + pow(c.y - e.y, 2)) AS d FROM emb e, cen c), low AS (SELECT vec_id, min(d) AS m FROM ranked GROUP BY 1) SELECT vec_id, count(*) FILTER (WHERE d <= m * 1.05) > 1 AS aliased FROM ranked JOIN low USING (vec_id) GROUP BY 1",
    "nearest_clustered": f"WITH {EMB}, {CLUSTERED} SELECT vec_id, min(id) FILTER (WHERE d = m AND d <= 0.2) AS near_id, {r('min(d) FILTER (WHERE d <= 0.2)')} AS near_distance FROM away_ GROUP BY 1",
    "alias_flags_clustered": f"WITH {EMB}, {CLUSTERED} SELECT vec_id, count(*) FILTER (WHERE d <= m * 1.2) > 1 AS aliased FROM away_ GROUP BY 1",
    "confidence_ellipse": f"""WITH {EMB}, g AS (SELECT cell_id, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, covar_samp(x, y) AS xy, var_samp(y) AS yy FROM emb GROUP BY 1),
      v AS (SELECT *, (xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy) AS major, greatest((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy), 0) AS minor, atan2(2 * xy, xx - yy) / 2 AS angle FROM g)
      SELECT cell_id, i::INT AS pos, {r(f'mx + sqrt(major) * cos(i * pi() / 6) * {ROOT2} * cos(angle) - sqrt(minor) * sin(i * pi() / 6) * {ROOT2} * sin(angle)')} AS x,
      {r(f'my + sqrt(major) * cos(i * pi() / 6) * {ROOT2} * sin(angle) + sqrt(minor) * sin(i * pi() / 6) * {ROOT2} * cos(angle)')} AS y FROM v, range(12) AS q(i)""",
    "map_similarity": f"""WITH {halves()}, m AS (SELECT cell_id, {div('one.k', 'one.n')} AS a, {div('two.k', 'two.n')} AS b FROM one JOIN two USING (cell_id, iy, ix))
      SELECT cell_id, {r('avg(pow(a - b, 2)) / avg(a * a)')} AS nmse, {r('corr(a, b)')} AS r FROM m GROUP BY 1""",
    "poisson_deviance_cv": f"""WITH {halves()}, t AS (SELECT two.cell_id, two.n, two.k, (one.k + 0.5) / (one.n + 1) AS rate FROM two JOIN one USING (cell_id, iy, ix)),
      m AS (SELECT cell_id, sum(k) / sum(n) AS mean, sum(n * rate) / sum(n) AS mr FROM t GROUP BY 1), f AS (SELECT t.*, mean, rate * mean / mr AS fit, k / n AS y FROM t JOIN m USING (cell_id)),
      b AS (SELECT cell_id, {bits('y', 'fit')} AS ll, {bits('y', 'mean')} AS null_ll, {bits('y', 'y')} AS saturated_ll FROM f GROUP BY 1)
      SELECT cell_id, {r('ll')} AS ll, {r('null_ll')} AS null_ll, {r('saturated_ll')} AS saturated_ll, {r('ll - null_ll')} AS delta, {r('(ll - null_ll) / (saturated_ll - null_ll)')} AS explained FROM b""",
    "density_rgb_mix": f"""WITH {PTS}, {lin(8)}, {blurred(8, 1.0)}, {scaled('soft', ['n', 'k'])} SELECT cell_id, iy, ix, {r('least(n, 1)')} AS r, {r('least(n * 0.5 + k * 0.5, 1)')} AS g, {r('least(k, 1)')} AS b FROM unit_""",
    "estimator_spread": f"""WITH {PTS}, smp AS (SELECT *, round(h * 7)::INT AS sample FROM pts), {lin(6, 'smp', name='each', by='cell_id, sample')}, {lin(6)},
      b AS (SELECT e.cell_id, e.iy, e.ix, var_pop(({div('e.k', 'e.n')}) / ({div('g.k', 'g.n')})) AS v, avg(({div('e.k', 'e.n')}) / ({div('g.k', 'g.n')})) AS m FROM each e JOIN grid g USING (cell_id, iy, ix) GROUP BY 1, 2, 3)
      SELECT cell_id, {r('avg(v)')} AS variance, {r('avg(m - 1) * 100')} AS bias_percent FROM b GROUP BY 1""",
    "streaming_counts_batch": f"""WITH ev AS (SELECT (epoch_us(ts) // 1000000 // 604800 * 604800)::BIGINT AS start, user_id % 3 AS cell_id, least(value / 100, 1.0) AS x, json_extract_string(props, '$.k')::DOUBLE / 100 AS y,
      CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM events WHERE value IS NOT NULL), {lin(8, 'ev', by='start, cell_id')} SELECT start, cell_id, iy, ix, {r('n')} AS n, {r('k')} AS k FROM grid""",
    "heading_rate_maps": f"""WITH {PTS}, spread AS (SELECT pts.* EXCLUDE (w), l::BIGINT AS layer, pow(greatest(cos(h * 2 * pi() - l * pi() / 2), 0), 2) AS w FROM pts, range(4) AS q(l)),
      kept AS (SELECT * FROM spread WHERE w > 0), {lin(8, 'kept', 'w', by='cell_id, layer')} SELECT cell_id, layer, iy, ix, {r('n')} AS n, {r('k')} AS k FROM grid""",
    "tracked_matches_labels": f"""WITH {EMB}, d AS (SELECT a.vec_id AS tracked, b.vec_id AS sampled, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM emb a JOIN emb b ON b.cell_id = a.cell_id + 1),
      o AS (SELECT *, row_number() OVER (PARTITION BY tracked ORDER BY distance, sampled) AS p, row_number() OVER (PARTITION BY sampled ORDER BY distance, tracked) AS q FROM d)
      SELECT tracked, sampled, {r('distance')} AS distance FROM o WHERE p = 1 AND q = 1 AND distance <= 0.2""",
    "mask_dilate_labels": f"""WITH {EMB}, mask AS (SELECT DISTINCT cell_id, least(floor(y * 16), 15)::INT AS iy, least(floor(x * 16), 15)::INT AS ix FROM emb)
      SELECT DISTINCT cell_id, (iy + a.i)::INT AS iy, (ix + b.i)::INT AS ix FROM mask, range(-2, 3) AS a(i), range(-2, 3) AS b(i)
      WHERE a.i * a.i + b.i * b.i <= 4 AND iy + a.i BETWEEN 0 AND 15 AND ix + b.i BETWEEN 0 AND 15""",
    "value_histogram_whole": """SELECT event_type, CASE WHEN value < 0 THEN -1 WHEN value > 60 THEN 12 ELSE least(floor(value / 5), 11) END::INT AS bin, count(*) AS count
      FROM events WHERE value IS NOT NULL GROUP BY ALL""",
    "mahalanobis_displacement": f"""WITH {EMB}, g AS (SELECT cell_id, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, covar_samp(x, y) AS xy, var_samp(y) AS yy FROM emb GROUP BY 1)
      SELECT vec_id, {r('sqrt((yy * pow(x - mx, 2) - 2 * xy * (x - mx) * (y - my) + xx * pow(y - my, 2)) / (xx * yy - xy * xy))')} AS displacement FROM emb JOIN g USING (cell_id)""",
    "zero_lag": f"""WITH {PTS}, {lin(16)}, {field(16)}, a AS (SELECT cell_id, round(sqrt(pow(iy - 8, 2) + pow(ix - 8, 2)))::INT AS r, avg(y) AS y FROM field GROUP BY 1, 2)
      SELECT cell_id, {r('regr_intercept(y, (r * r)::DOUBLE)')} AS zero_lag FROM a WHERE r BETWEEN 1 AND 3 GROUP BY 1""",
    "box_statistics": f"""SELECT event_type, count(value) AS n, {', '.join(f"{r(f'quantile_cont(value, {q})')} AS {n}" for n, q in (('low', 0.05), ('q1', 0.25), ('median', 0.5), ('q3', 0.75), ('high', 0.95)))} FROM events GROUP BY 1""",
    "match_adjacent_layers": f"WITH RECURSIVE {EMB}, {matched(0.1)} SELECT layer, src, dst, {r('dist')} AS dist FROM edge",
    "point_pairs": f"WITH RECURSIVE {EMB}, {matched(0.06, 5)} SELECT layer, src, dst, {r('dist')} AS dist FROM edge",
    "chain_positions": f"WITH RECURSIVE {EMB}, {CHAINS} SELECT chain_id, layer, id, pos FROM chain",
    "cardinal_nodes": f"""WITH RECURSIVE {EMB}, {CHAINS} SELECT chain_id, {', '.join(f"min(CASE WHEN layer = {k} THEN id END) AS {n}" for n, k in (('east', 0), ('north', 2), ('west', 5), ('south', 7)))} FROM chain GROUP BY 1""",
    "linked_edges": f"""WITH RECURSIVE {EMB}, {CHAINS}, {trimmed(0.04)}, n_ AS (SELECT layer, id AS src, lead(id) OVER (PARTITION BY chain_id ORDER BY pos) AS dst FROM kept) SELECT layer, src, dst FROM n_ WHERE dst IS NOT NULL""",
    "tracked_chains": f"""WITH RECURSIVE {EMB}, {CEN}, {CHAINS}, {trimmed(2.0)}, mid AS (SELECT chain_id, avg(x) AS x, avg(y) AS y, count(*) AS nodes FROM kept GROUP BY 1),
      reg AS (SELECT mid.chain_id, any_value(mid.x) AS x, any_value(mid.y) AS y, any_value(nodes) AS nodes, arg_min(cen.id, (sqrt(pow(cen.x - mid.x, 2) + pow(cen.y - mid.y, 2)), cen.id)) AS region FROM mid, cen GROUP BY 1)
      SELECT chain_id, {r('x')} AS x, {r('y')} AS y, nodes, region, count(*) OVER (PARTITION BY region) > 1 AS shared FROM reg""",
    "locate_opposites": f"""WITH RECURSIVE {EMB}, {matched(0.1)}, go_ AS (SELECT vec_id AS origin, vec_id AS f, 0 AS i FROM emb WHERE cell_id = 0 UNION ALL SELECT origin, dst, i + 1 FROM go_ JOIN edge ON src = f AND layer = i WHERE i < 5),
      back_ AS (SELECT vec_id AS origin, vec_id AS f, 0 AS i FROM emb WHERE cell_id = 0 UNION ALL SELECT origin, src, i + 1 FROM back_ JOIN edge ON dst = f AND layer = 9 - i WHERE i < 5),
      end_ AS (SELECT origin, f, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM (SELECT * FROM go_ WHERE i = 5 UNION ALL SELECT * FROM back_ WHERE i = 5) JOIN emb a ON a.vec_id = origin JOIN emb b ON b.vec_id = f),
      one_ AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY dist, f) AS p FROM end_ WHERE dist <= 0.5), best_ AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY dist, origin) AS q FROM one_ WHERE p = 1)
      SELECT origin, f AS opposite, {r('dist')} AS dist FROM best_ WHERE q = 1""",
    "grid_kernel": f"WITH {KERNELS} SELECT style, a.i::INT AS iy, b.i::INT AS ix, {r('sum(f * cos(2 * pi() * (u * a.i + v * b.i) / 8)) / 64')} AS value FROM spec_k, range(8) AS a(i), range(8) AS b(i) GROUP BY 1, 2, 3",
    "recording_track": f"""WITH {TRK}, {REC} SELECT gx.cell_id, gx.t, {r('gx.v')} AS x, {r('gy.v')} AS y, {r('coalesce(c, 0)')} AS s FROM gx JOIN gy USING (cell_id, t) LEFT JOIN cnt_ USING (cell_id, t)""",
    "silent_recordings": f"WITH {TRK} SELECT DISTINCT cell_id FROM trk WHERE cell_id NOT IN (SELECT cell_id FROM trk WHERE y > 0.97)",
    "rates_at_points": f"""WITH {PTS}, {lin(16)}, {kde(16, 2.0)} SELECT p.cell_id, {r('avg(rate)')} AS mean_rate, {r('avg(rate * s)')} AS at_events FROM pts p JOIN kde_ k ON k.cell_id = p.cell_id AND k.iy = least(floor(p.y * 16), 15) AND k.ix = least(floor(p.x * 16), 15) GROUP BY 1""",
    "head_direction": f"""WITH {TRK}, turned AS (SELECT cell_id, t, cos(radians(-y * 360)) AS c, sin(radians(-y * 360)) AS s FROM trk), {fir('turned', 'c', None, False, 'fc')}, {fir('turned', 's', None, False, 'fs')}
      SELECT fc.cell_id, fc.t, {r('atan2(fs.v, fc.v)', 5)} AS direction FROM fc JOIN fs USING (cell_id, t)""",
    "skip_statistics": f"""WITH v_ AS (SELECT event_type, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN value END AS v FROM events)
      SELECT event_type, {r('coalesce(sum(v), 0)')} AS total, {r('avg(v)')} AS mean, {r("CASE WHEN event_type = 'error' THEN -1 ELSE avg(v) END")} AS mean_or FROM v_ GROUP BY 1""",
    "zscored": f"SELECT event_id, event_type, {r('(value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10)')} AS z, {r('value - avg(value) OVER w')} AS centred FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type)",
    "pending_keys": f"WITH {TRK} SELECT DISTINCT cell_id FROM trk WHERE cell_id NOT IN (SELECT cell_id FROM trk WHERE y < 0.03)",
    "ends_mask": f"""WITH {EMB}, {HULL} SELECT cell_id, a.i::INT AS iy, b.i::INT AS ix FROM hull, range(12) AS a(i), range(12) AS b(i)
      GROUP BY ALL HAVING bool_and((bx - ax) * (a.i / 11.0::DOUBLE - ay) - (by_ - ay) * (b.i / 11.0::DOUBLE - ax) >= -1e-12)""",
    "mask_hull": f"WITH {EMB}, {LABEL_MASK}, {corner_hull(0.5)} SELECT cell_id, {r('ax')} AS ax, {r('ay')} AS ay, {r('bx')} AS bx, {r('by_')} AS by FROM hull",
    "arena_of_mask": f"""WITH {EMB}, {LABEL_MASK}, {corner_hull(0.0)}, g_ AS (SELECT h.*, a.i::INT AS iy, b.i::INT AS ix, (b.i + 0.5) / 48 AS px, (a.i + 0.5) / 48 AS py FROM hull h, range(48) AS a(i), range(48) AS b(i))
      SELECT cell_id, iy, ix FROM g_ GROUP BY ALL HAVING {inside()}""",
    "boundary_distance_labels": f"WITH {EMB}, {LABEL_DIST} SELECT cell_id, point_id, {r('distance')} AS distance FROM dist_",
    "near_boundary_filter_labels": f"WITH {EMB}, {LABEL_DIST} SELECT cell_id, point_id FROM dist_ WHERE abs(distance) > 1.0",
    "contains_units": f"""WITH {EMB}, {HULL}, h_ AS (SELECT e.vec_id, bool_and((bx - ax) * (e.y - ay) - (by_ - ay) * (e.x - ax) >= -1e-12) AS inside FROM emb e JOIN hull ON hull.cell_id = (e.cell_id + 9) % 10 GROUP BY 1)
      SELECT vec_id, inside AS unit, inside AS bin, inside AS meter FROM h_""",
    "physical_units": f"WITH {EMB} SELECT vec_id, {r('x / 0.8 + 0.4')} AS x, {r('y / 0.8 + 0.6')} AS y FROM emb",
    "centred_grid": f"""SELECT a.i::INT AS iy, b.i::INT AS ix, (a.i - 3)::INT AS y, (b.i - 4)::INT AS x, {r('sqrt(pow(a.i - 3, 2) + pow(b.i - 4, 2))')} AS r, CASE WHEN a.i < 3 THEN a.i ELSE a.i - 6 END::INT AS fy, CASE WHEN b.i < 5 THEN b.i ELSE b.i - 9 END::INT AS fx FROM range(6) AS a(i), range(9) AS b(i)""",
    "masked_rates": f"""WITH {PTS}, grid AS (SELECT cell_id, least(floor(y * 16), 15)::INT AS iy, least(floor(x * 16), 15)::INT AS ix, count(*)::DOUBLE AS n, sum(s) AS k FROM pts GROUP BY ALL)
      SELECT c.cell_id, a.i::INT AS iy, b.i::INT AS ix, {r('CASE WHEN n > 20 THEN k / n END')} AS rate FROM (SELECT DISTINCT cell_id FROM grid) c, range(16) AS a(i), range(16) AS b(i) LEFT JOIN grid g ON g.cell_id = c.cell_id AND g.iy = a.i AND g.ix = b.i""",
    "elbo_bits": f"WITH {PTS}, {lin(8)} SELECT cell_id, {r('((-1000.0 - cell_id) / sum(n) - sum(n * lgamma(k / n + 1)) / sum(n)) * (50.0 / ln(2))', 5)} AS bits FROM grid GROUP BY 1",
    "bessel_variance": f"""WITH RECURSIVE it_ AS (SELECT * FROM (VALUES (0, 0.05::DOUBLE, 0.01::DOUBLE, 1.0::DOUBLE, 0), (1, 0.1, 0.02, 1.0, 0), (2, 0.02, 0.001, 1.0, 0)) AS t(id, mean, observed, s, i)
      UNION ALL SELECT id, mean, observed, s * observed / (mean * mean * (exp(0.3001157525261326::DOUBLE * s) - exp(-0.402759395702553::DOUBLE * s))), i + 1 FROM it_ WHERE i < 10)
      SELECT id::INT AS id, {r('mean')} AS mean, {r('observed')} AS observed, {r('s')} AS variance FROM it_ WHERE i = 10""",
    "simulated_background": f"""WITH h AS (SELECT a.i::INT AS iy, b.i::INT AS ix, exp(0.5 * ({HEX})) * greatest(1 - sqrt(pow(a.i - 12, 2) + pow(b.i - 12, 2)) / 18.0::DOUBLE, 0) AS v, a.i BETWEEN 3 AND 20 AND b.i BETWEEN 3 AND 20 AS inside FROM range(24) AS a(i), range(24) AS b(i))
      SELECT iy, ix, {r('CASE WHEN inside THEN v / (SELECT avg(v) FROM h WHERE inside) * 1.2 ELSE 0 END')} AS rate FROM h""",
    "peak_filters": f"""WITH {PTS}, {lin(16)}, {kde(16, 1.0)}, {REFINED}, {EMB}, {HULL}, all_ AS (SELECT * FROM fine_ WHERE x BETWEEN 0 AND 1 - 1 / 16.0::DOUBLE AND y BETWEEN 0 AND 1 - 1 / 16.0::DOUBLE),
      low_ AS (SELECT cell_id, quantile_cont(height, 0.5) AS low FROM all_ GROUP BY 1), in_ AS (SELECT p.cell_id, iy, ix, p.x AS px, p.y AS py, height, ax, ay, bx, by_ FROM all_ p JOIN hull USING (cell_id)),
      ok_ AS (SELECT cell_id, iy, ix, px, py, height FROM in_ GROUP BY ALL HAVING {inside(edge=0.05)})
      SELECT cell_id, iy, ix, {r('px', 5)} AS x, {r('py', 5)} AS y, {r('height', 5)} AS height FROM ok_ JOIN low_ USING (cell_id) WHERE height >= low""",
    "truncated_spectrum": f"""WITH {PTS}, {lin(8)}, {field(8)}, {HART}, m AS (SELECT cell_id, max(c * c) AS top FROM h_ WHERE ky <> 0 OR kx <> 0 GROUP BY 1) SELECT cell_id, ky, kx, {r('c * c', 9)} AS power FROM h_ JOIN m USING (cell_id) WHERE c * c >= 0.1 * top""",
    "top_frequencies": f"""WITH {PTS}, {lin(8)}, {field(8)}, {HART}, p AS (SELECT cell_id, ky, kx, {r('c * c', 9)} AS power FROM h_) SELECT cell_id, ky, kx, power FROM p QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY power DESC, ky, kx) <= 10""",
    "upsampled_field": f"""WITH {PTS}, {lin(8)}, {field(8)}, f_ AS (SELECT a.i - 4 AS u, b.i - 4 AS v FROM range(8) AS a(i), range(8) AS b(i) WHERE sqrt(pow((a.i - 3.5) / 8, 2) + pow((b.i - 3.5) / 8, 2)) < 0.5),
      o_ AS (SELECT a.i AS oy, b.i AS ox FROM range(16) AS a(i), range(16) AS b(i))
      SELECT cell_id, oy::INT AS iy, ox::INT AS ix, {r('sum(y * cos(2 * pi() * (u * (oy / 16.0::DOUBLE - iy / 8.0::DOUBLE) + v * (ox / 16.0::DOUBLE - ix / 8.0::DOUBLE)))) / 64')} AS y FROM field, f_, o_ GROUP BY 1, 2, 3""",
    "noise_draw_blocks": "SELECT i::BIGINT AS sample_id, (6 - k)::BIGINT AS draws, k = 0 AS replace, (k * 5)::BIGINT AS distinct_blocks FROM range(3) AS a(i), range(2) AS b(k)",
    "overlapping_folds": f"""WITH {TRK}, c AS (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM trk)
      SELECT cell_id, f::INT AS fold, count(*) FILTER (WHERE t BETWEEN n * f // 5 AND n * (f + 1) // 5) AS tests, {r('avg(y) FILTER (WHERE NOT (t BETWEEN n * f // 5 AND n * (f + 1) // 5))')} AS train_mean FROM c, range(5) AS q(f) GROUP BY ALL""",
    "scalar_variational": f"WITH RECURSIVE {PTS}, {lin(4)}, {SCALAR} SELECT cell_id, iy, ix, 0.0::DOUBLE AS m, 1.0::DOUBLE AS p, {r('y')} AS y, {r('mu')} AS mu, {r('v')} AS v FROM it_ WHERE i = 200",
    "autocorrelation_profile": f"WITH {PTS}, {lin(16)}, {PROFILE} SELECT cell_id, r, {r('value', 9)} AS value FROM prof_",
    "heuristic_parameters": f"""WITH {PTS}, {lin(16)}, {HEURISTICS} SELECT cell_id, {r('p')} AS period, {r('variance')} AS variance, {r('w - floor(w / (pi() / 3)) * (pi() / 3)')} AS angle FROM per_ JOIN spread_ USING (cell_id) JOIN angle_ USING (cell_id)""",
    "fraction_within_arena": f"""WITH {EMB}, {HULL}, g AS (SELECT cell_id, avg(x) AS mx, avg(y) AS my, sqrt(var_samp(x)) AS a, covar_samp(x, y) / sqrt(var_samp(x)) AS b, var_samp(y) AS yy FROM emb GROUP BY 1),
      d AS (SELECT cell_id, i, mx + a * u AS px, my + b * u + sqrt(greatest(yy - b * b, 0)) * v AS py FROM g, (SELECT i, sqrt(-2 * ln((i + 0.5) / 200)) * cos(2 * pi() * (i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE))) AS u,
        sqrt(-2 * ln((i + 0.5) / 200)) * sin(2 * pi() * (i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE))) AS v FROM range(200) AS q(i))),
      o AS (SELECT d.cell_id, i, {inside()} AS own FROM d JOIN hull USING (cell_id) GROUP BY 1, 2) SELECT cell_id, 0::BIGINT AS field, {r('avg(own::INT)')} AS fraction FROM o GROUP BY 1""",
    "early_spectrum": f"""WITH off_ AS (SELECT i, CASE WHEN i < 4 THEN i ELSE i - 8 END AS d FROM range(8) AS q(i)),
      cell_ AS (SELECT a.i AS iy, b.i AS ix, (0.5 - 0.5 * cos(2 * pi() * (a.d + 4) / 7)) * (0.5 - 0.5 * cos(2 * pi() * (b.d + 4) / 7)) AS hann, sqrt(a.d * a.d + b.d * b.d) * pi() / 2 AS r FROM off_ a, off_ b),
      raw_ AS (SELECT iy, ix, any_value(hann) * CASE WHEN any_value(r) < 5.520078110286311::DOUBLE THEN 1 ELSE 0 END * avg(cos(r * sin((i + 0.5) * pi() / 256))) AS k FROM cell_, range(256) AS q(i) GROUP BY 1, 2),
      g_ AS (SELECT a.i AS iy, b.i AS ix, exp(-(a.d * a.d + b.d * b.d) * pi() * pi() / 16) AS g FROM off_ a, off_ b),
      soft_ AS (SELECT a.i AS iy, b.i AS ix, sum(k * g) / (SELECT sum(g) FROM g_) AS k FROM raw_ r, range(8) AS a(i), range(8) AS b(i) JOIN g_ ON g_.iy = (a.i - r.iy + 8) % 8 AND g_.ix = (b.i - r.ix + 8) % 8 GROUP BY 1, 2),
      spec_ AS (SELECT a.i AS iy, b.i AS ix, greatest(sum(k / (SELECT max(k) FROM soft_) * cos(2 * pi() * (a.i * s.iy + b.i * s.ix) / 8)), 1e-7) * 0.5 + CASE WHEN a.i = 0 AND b.i = 0 THEN 1000 ELSE 0 END AS f FROM soft_ s, range(8) AS a(i), range(8) AS b(i) GROUP BY 1, 2),
      top_ AS (SELECT f * 0.1 AS cut FROM spec_ ORDER BY f DESC LIMIT 1 OFFSET 1)
      SELECT s.iy::INT AS iy, s.ix::INT AS ix, {r('CASE WHEN s.f > (SELECT cut FROM top_) OR t.f > (SELECT cut FROM top_) THEN s.f ELSE 0 END')} AS value FROM spec_ s JOIN spec_ t ON t.iy = s.ix AND t.ix = s.iy""",
    "expected_maps": f"""WITH h AS (SELECT a.i::INT AS iy, b.i::INT AS ix, exp(0.5 * ({HEX})) AS v, a.i BETWEEN 2 AND 21 AND b.i BETWEEN 2 AND 21 AS inside, a.i - 12 AS y, b.i - 12 AS x FROM range(24) AS a(i), range(24) AS b(i)),
      r AS (SELECT *, CASE WHEN inside THEN v / (SELECT avg(v) FROM h) * 0.09 ELSE 0 END AS rate FROM h)
      SELECT iy, ix, {r('rate')} AS rate, {r('rate * (1 - sqrt(x * x + y * y) / 20.0::DOUBLE)')} AS background, {r('CASE WHEN inside THEN 2 * (1 - sqrt(pow(x / 24.0::DOUBLE, 2) + pow(y / 24.0::DOUBLE - 0.2, 2))) ELSE 0 END')} AS visits FROM r""",
    "kernel_covariance": f"""WITH g AS (SELECT a.i AS y, b.i AS x, exp(-0.5 * (pow(least(a.i, 4 - a.i), 2) + pow(least(b.i, 4 - b.i), 2)) / 1.44::DOUBLE) AS k FROM range(4) AS a(i), range(4) AS b(i)),
      f AS (SELECT a.i AS u, b.i AS v, greatest(sum(k * cos(pi() * (a.i * y + b.i * x) / 2)), 0.5) AS f FROM g, range(4) AS a(i), range(4) AS b(i) GROUP BY 1, 2),
      c AS (SELECT a.i AS y, b.i AS x, sum(f * cos(pi() * (u * a.i + v * b.i) / 2)) / 16 AS k FROM f, range(4) AS a(i), range(4) AS b(i) GROUP BY 1, 2)
      SELECT p.i::INT AS a, q.i::INT AS b, {r('k')} AS value FROM range(16) AS p(i), range(16) AS q(i) JOIN c ON c.y = (p.i // 4 - q.i // 4 + 4) % 4 AND c.x = (p.i % 4 - q.i % 4 + 4) % 4""",
    "bootstrap_draws": f"WITH {DRAWN} SELECT cell_id, sample_id, block_id, weight FROM weight_, (SELECT DISTINCT user_id % 3 AS cell_id FROM events)",
    "bootstrap_spread": f"""WITH {DRAWN}, ends_ AS (SELECT min(event_id) AS a, max(event_id) - min(event_id) + 1 AS span FROM events WHERE value IS NOT NULL),
      ev AS (SELECT (user_id % 3)::BIGINT AS cell_id, floor((event_id - a) * 15 / span)::BIGINT AS block_id, least(value / 100, 1.0) AS x, json_extract_string(props, '$.k')::DOUBLE / 100 AS y,
             CASE WHEN event_type = 'click' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM events, ends_ WHERE value IS NOT NULL), {lin(6, 'ev', by='cell_id, block_id')},
      each_ AS (SELECT cell_id, sample_id, iy, ix, (sum(k * weight) + 0.5) / (sum(n * weight) + 1) AS e FROM grid JOIN weight_ USING (block_id) GROUP BY ALL),
      all_ AS (SELECT cell_id, iy, ix, (sum(k) + 0.5) / (sum(n) + 1) AS t FROM grid GROUP BY ALL),
      b AS (SELECT cell_id, iy, ix, var_pop(e / t) AS v, avg(e / t) AS m FROM each_ JOIN all_ USING (cell_id, iy, ix) GROUP BY 1, 2, 3)
      SELECT cell_id, {r('avg(v)')} AS variance, {r('avg(m - 1) * 100')} AS bias_percent FROM b GROUP BY 1""",
    "field_filters": f"WITH {FIELDS} SELECT cell_id, field, {r('total')} AS total, {r('probability')} AS probability, {r('mx')} AS mx, {r('my')} AS my, {r('xx')} AS xx, {r('xy')} AS xy, {r('yy')} AS yy FROM kept_",
    "field_members": f"WITH {FIELDS} SELECT cell_id, field, sample_id, vec_id FROM own_ JOIN kept_ USING (cell_id, field)",
}
