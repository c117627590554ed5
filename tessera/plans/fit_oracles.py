"""DuckDB SQL of the fits: Newton steps as a recursive query over lists, with the posterior covariance by sweeps.

The Spark side stops where neither mean nor variance moves by the solver's tolerance; the SQL runs a fixed number of
undamped steps, well beyond that point.
"""

from __future__ import annotations

from tessera.plans.oracles import EMB, PTS, div, heuristics, lin, r


def spectra(size: int) -> str:
    """CTE spec_(sid, ky, kx, f, kept) of table set_(sid, p, variance, angle, style): radial or grid kernels."""
    h, last = size // 2, size - 1
    turn = lambda k, i: f"2 * pi() * ({k} * {i} % {size}) / {size}"
    return f"""off_ AS (SELECT i, CASE WHEN i < {h} THEN i ELSE i - {size} END AS d FROM range({size}) AS q(i)),
turned_ AS (SELECT sid, style, a.i AS iy, b.i AS ix, (b.d * cos(angle) - a.d * sin(angle)) * 2 * pi() / p AS x, (b.d * sin(angle) + a.d * cos(angle)) * 2 * pi() / p AS y,
  (0.5 - 0.5 * cos(2 * pi() * (a.d + {h}) / {last})) * (0.5 - 0.5 * cos(2 * pi() * (b.d + {h}) / {last})) AS hann FROM set_, off_ a, off_ b),
bessel_f AS (SELECT sid, iy, ix, avg(cos(sqrt(x * x + y * y) * sin((i + 0.5) * pi() / 256))) AS j FROM turned_, range(256) AS q(i) GROUP BY 1, 2, 3),
raw_f AS (SELECT sid, iy, ix, hann * CASE WHEN sqrt(x * x + y * y) < 8.653727912911013::DOUBLE THEN 1 ELSE 0 END
  * CASE style WHEN 'radial' THEN j ELSE cos(x) + cos(x * cos(pi() / 3) - y * sin(pi() / 3)) + cos(x * cos(pi() / 3) + y * sin(pi() / 3)) END AS k FROM turned_ JOIN bessel_f USING (sid, iy, ix)),
tap_f AS (SELECT sid, i AS o, exp(-d * d * pi() * pi() / (p * p)) AS g FROM set_, off_),
soft_fx AS (SELECT sid, iy, (ix + o) % {size} AS ix, sum(k * g) AS k FROM raw_f JOIN tap_f USING (sid) GROUP BY ALL),
soft_f AS (SELECT sid, (iy + o) % {size} AS iy, ix, sum(k * g) AS k FROM soft_fx JOIN tap_f USING (sid) GROUP BY ALL),
unit_f AS (SELECT sid, iy, ix, k / max(k) OVER (PARTITION BY sid) AS k FROM soft_f),
wave_fx AS (SELECT sid, iy, kx, sum(k * cos({turn('kx', 'ix')})) AS c, sum(k * sin({turn('kx', 'ix')})) AS s FROM unit_f, range({size}) AS q(kx) GROUP BY ALL),
wave_f AS (SELECT sid, ky, kx, greatest(sum(c * cos({turn('ky', 'iy')}) - s * sin({turn('ky', 'iy')})), 1e-9) AS f FROM wave_fx, range({size}) AS q(ky) GROUP BY ALL),
scaled_f AS (SELECT sid, ky, kx, f * variance AS f0, f * variance + CASE WHEN ky = 0 AND kx = 0 THEN 1000 ELSE 0 END AS f FROM wave_f JOIN set_ USING (sid)),
spec_ AS (SELECT sid, ky, kx, f0, f, max(CASE WHEN ky + kx > 0 THEN f END) OVER (PARTITION BY sid) AS top, f >= 0.1 * max(CASE WHEN ky + kx > 0 THEN f END) OVER (PARTITION BY sid) AS kept FROM scaled_f)"""


def waves(size: int) -> str:
    angle = f"2 * pi() * ((ky * iy % {size}) / {size}.0::DOUBLE + (kx * ix % {size}) / {size}.0::DOUBLE)"
    return f"(cos({angle}) - sin({angle})) / {size}.0::DOUBLE"


def fitted(size: int, rounds: int = 16) -> str:
    """CTE done_(fid, cell_id, u, a, n_kept, elbo) of the fits prior_(fid, cell_id, ky, kx, f) of grid(cell_id, iy, ix, n, k)
    with the prior mean mean_(cell_id, iy, ix, m): weights u, and minus the covariance of the weights in the rows of a."""
    at = "e[1][1]::BIGINT"
    rate = lambda z: f"nn[m] * exp(least(greatest({z} + z0[m] + v[m] / 2, -10), 10))"
    return f"""data_f AS (SELECT cell_id, list(n ORDER BY iy, ix) AS nn, list(k ORDER BY iy, ix) AS kk, list(m ORDER BY iy, ix) AS z0 FROM grid JOIN mean_ USING (cell_id, iy, ix) WHERE n > 0 GROUP BY 1),
basis_f AS (SELECT fid, p.cell_id, ky, kx, iy, ix, {waves(size)} AS w FROM prior_ p JOIN grid g ON g.cell_id = p.cell_id AND g.n > 0),
row_f AS (SELECT fid, cell_id, ky, kx, list(w ORDER BY iy, ix) AS w FROM basis_f GROUP BY ALL),
col_f AS (SELECT fid, iy, ix, list(w ORDER BY ky, kx) AS w FROM basis_f GROUP BY ALL),
rows_f AS (SELECT fid, cell_id, list(w ORDER BY ky, kx) AS fr FROM row_f GROUP BY ALL),
cols_f AS (SELECT fid, list(w ORDER BY iy, ix) AS ft FROM col_f GROUP BY 1),
prior_f AS (SELECT fid, list(f ORDER BY ky, kx) AS pr FROM prior_ GROUP BY 1),
stat_f AS (SELECT rows_f.fid, rows_f.cell_id, fr, ft, pr, len(pr) AS nr, nn, kk, z0, list_transform(range(1, len(pr) + 1), lambda p: [[p::DOUBLE]]) AS pivots
  FROM rows_f JOIN cols_f USING (fid) JOIN prior_f USING (fid) JOIN data_f ON data_f.cell_id = rows_f.cell_id),
step_f AS (
  SELECT fid, 0 AS i, list_transform(pr, lambda x: 0.0::DOUBLE) AS u, list_transform(nn, lambda x: 0.0::DOUBLE) AS v, [[0.0::DOUBLE]] AS a FROM stat_f
  UNION ALL
  SELECT fid, i + 1, list_transform(range(1, nr + 1), lambda q: u[q] + list_dot_product(a[q], g)) AS u,
         list_transform(ft, lambda f: -list_dot_product(f, list_transform(range(1, nr + 1), lambda q: list_dot_product(a[q], f)))) AS v, a
  FROM (
    SELECT fid, i, u, g, nr, ft, list_reduce(pivots, lambda m, e: list_transform(range(1, nr + 2), lambda x: CASE
        WHEN x > nr THEN [m[x][1] + ln(m[{at}][{at}])]
        WHEN x = {at} THEN list_transform([m[x][x]], lambda d: list_transform(m[x], lambda t, y: CASE WHEN y = x THEN -1 ELSE t END / d))[1]
        ELSE list_transform([{{'p': m[{at}], 'c': m[x][{at}] / m[{at}][{at}], 'k': {at}}}], lambda s: list_transform(m[x], lambda t, y: CASE WHEN y = s.k THEN s.c ELSE t - s.c * s.p[y] END))[1] END), h) AS a
    FROM (
      SELECT fid, i, u, nr, ft, pivots, list_transform(range(1, nr + 1), lambda q: u[q] / pr[q] + list_sum(fl[q]) - list_dot_product(fr[q], kk)) AS g,
             list_transform(range(1, nr + 2), lambda x: CASE WHEN x > nr THEN [0.0::DOUBLE] ELSE list_transform(range(1, nr + 1), lambda y: list_dot_product(fl[x], fr[y]) + CASE WHEN x = y THEN 1 / pr[x] ELSE 0 END) END) AS h
      FROM (
        SELECT fid, i, u, nr, ft, fr, pivots, pr, kk, list_transform(fr, lambda f: list_transform(range(1, len(f) + 1), lambda m: f[m] * lam[m])) AS fl
        FROM (SELECT step_f.fid, i, u, nr, ft, fr, pivots, pr, kk, list_transform(range(1, len(nn) + 1), lambda m: {rate('list_dot_product(ft[m], u)')}) AS lam FROM step_f JOIN stat_f USING (fid) WHERE i < {rounds}))))),
last_f AS (SELECT s.fid, s.cell_id, nr, u, v, a, pr, nn, kk, z0, list_transform(ft, lambda f: list_dot_product(f, u)) AS z FROM step_f JOIN stat_f s USING (fid) WHERE i = {rounds}),
done_ AS (SELECT fid, cell_id, u, a, nr AS n_kept, -(list_sum(list_transform(range(1, len(nn) + 1), lambda m: {rate('z[m]')} - kk[m] * (z[m] + z0[m])))
  + 0.5 * (list_sum(list_transform(range(1, nr + 1), lambda q: ln(pr[q]) + (u[q] * u[q] - a[q][q]) / pr[q])) - nr + a[nr + 1][1])) AS elbo FROM last_f)"""


def everywhere(size: int) -> str:
    """CTE bins_(fid, cell_id, iy, ix, w, log_rate, log_var) of all bins; w: values of the retained functions there."""
    return f"""spread_w AS (SELECT fid, cell_id, ky, kx, a.i AS iy, b.i AS ix FROM prior_, range({size}) AS a(i), range({size}) AS b(i)),
all_w AS (SELECT fid, cell_id, iy, ix, list({waves(size)} ORDER BY ky, kx) AS w FROM spread_w GROUP BY ALL),
bins_ AS (SELECT w.fid, w.cell_id, w.iy::INT AS iy, w.ix::INT AS ix, w, m + list_dot_product(w, u) AS log_rate, -list_dot_product(w, list_transform(range(1, n_kept + 1), lambda q: list_dot_product(a[q], w))) AS log_var
  FROM all_w w JOIN done_ USING (fid) JOIN mean_ x ON x.cell_id = w.cell_id AND x.iy = w.iy AND x.ix = w.ix)"""


MEAN = "mean_ AS (SELECT cell_id, iy, ix, ln(greatest(rate, 1e-10)) AS m FROM wide_)"
OWN = "prior_ AS (SELECT sid AS fid, sid AS cell_id, ky, kx, f FROM spec_ WHERE kept)"
ANGLE = "w - floor(w / (pi() / 3)) * (pi() / 3)"


BANDED = "prior_ AS (SELECT sid AS fid, sid AS cell_id, ky, kx, greatest(f0, 1e-12) AS f FROM spec_ WHERE f >= 0.01 * top)"


def own_fits(size: int, grid: str = "", prior: str = OWN) -> str:
    """Fits with each key's heuristic period and variance."""
    return f"""{grid or PTS + ', ' + lin(size)}, {heuristics(size)}, set_ AS (SELECT cell_id AS sid, p, variance, 0.0::DOUBLE AS angle, 'radial' AS style FROM per_ JOIN spread_ USING (cell_id)),
{spectra(size)}, {prior}, {MEAN}, {fitted(size)}"""


def swept(size: int, settings: str, grid: str = "", masks: str = "TRUE") -> str:
    """Fits of every key with every row of settings (sid, p, variance, angle, style) on the union of what those with `masks` keep."""
    return f"""{grid or PTS + ', ' + lin(size)}, {heuristics(size)}, set_ AS (SELECT sid, p::DOUBLE AS p, variance::DOUBLE AS variance, angle::DOUBLE AS angle, style FROM {settings}), {spectra(size)},
union_f AS (SELECT ky, kx FROM spec_ JOIN set_ USING (sid) WHERE kept AND {masks} GROUP BY 1, 2),
prior_ AS (SELECT cell_id * 1000 + sid AS fid, cell_id, ky, kx, greatest(f, 1e-9) AS f FROM spec_ JOIN union_f USING (ky, kx), (SELECT DISTINCT cell_id FROM grid)), {MEAN}, {fitted(size, 9)},
score_ AS (SELECT d.cell_id, sid, p, variance, angle, style, elbo FROM done_ d JOIN set_ ON d.fid % 1000 = set_.sid)"""


SWEEP = swept(16, "(SELECT i AS sid, i // 3 * 2 + 4 AS p, pow(10, i % 3 - 2) AS variance, 0.0 AS angle, 'radial' AS style FROM range(9) AS q(i))")
BEST = swept(
    12,
    """(SELECT (a.i * 2 + b.i) * 3 + c.i AS sid, [4.0, 6.0][a.i + 1] AS p, [0.01, 0.1][b.i + 1] AS variance, [0.0, 0.0, 0.5][c.i + 1] AS angle, CASE WHEN c.i = 0 THEN 'radial' ELSE 'grid' END AS style
     FROM range(2) AS a(i), range(2) AS b(i), range(3) AS c(i))""",
    masks="style = 'radial'",
)

MOVES = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
#: local maxima of the log rate inside the border, the field's values around them and the retained functions' differences
PEAKS = f"""{own_fits(16)}, {everywhere(16)},
rate_w AS (SELECT *, exp(least(greatest(log_rate + log_var / 2, -10), 10)) AS rate FROM bins_),
top_ AS (SELECT p.fid, p.iy, p.ix FROM bins_ p JOIN bins_ o ON o.fid = p.fid AND abs(o.iy - p.iy) <= 1 AND abs(o.ix - p.ix) <= 1 AND (o.iy <> p.iy OR o.ix <> p.ix)
  WHERE p.iy BETWEEN 1 AND 14 AND p.ix BETWEEN 1 AND 14 GROUP BY ALL HAVING any_value(p.log_rate) > max(o.log_rate)),
near_w AS (SELECT t.fid, t.iy, t.ix, {', '.join(f"max(CASE WHEN o.iy - t.iy = {i} AND o.ix - t.ix = {j} THEN o.{f} END) AS {f[0]}{k}" for k, (i, j) in enumerate(MOVES) for f in ('log_rate', 'rate'))},
  {', '.join(f"any_value(CASE WHEN o.iy - t.iy = {i} AND o.ix - t.ix = {j} THEN o.w END) AS w{k}" for k, (i, j) in enumerate(MOVES) if k in (1, 3, 5, 7))}, any_value(CASE WHEN o.iy = t.iy AND o.ix = t.ix THEN o.log_var END) AS log_var
  FROM top_ t JOIN rate_w o ON o.fid = t.fid AND abs(o.iy - t.iy) <= 1 AND abs(o.ix - t.ix) <= 1 GROUP BY ALL),
slope_ AS (SELECT n.*, cell_id, a, n_kept, list_transform(range(1, n_kept + 1), lambda q: (w5[q] - w3[q]) / 2) AS gx, list_transform(range(1, n_kept + 1), lambda q: (w7[q] - w1[q]) / 2) AS gy FROM near_w n JOIN done_ USING (fid)),
bend_ AS (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY iy, ix) - 1 AS spot, list_transform(range(1, n_kept + 1), lambda q: -list_dot_product(a[q], gx)) AS cx, list_transform(range(1, n_kept + 1), lambda q: -list_dot_product(a[q], gy)) AS cy,
  {', '.join(f"{f}5 - 2 * {f}4 + {f}3 AS {f}xx, {f}7 - 2 * {f}4 + {f}1 AS {f}yy, ({f}8 + {f}0 - {f}2 - {f}6) / 4 AS {f}xy" for f in 'lr')} FROM slope_)"""


def pair(f: str, scale: str) -> str:
    """Covariance blocks of every two peaks of a map: surfaces l (log rate) or r (rate)."""
    det = lambda t: f"({t}.{f}xx * {t}.{f}yy - {t}.{f}xy * {t}.{f}xy)"
    s = lambda t: scale.format(t=t)
    # minus the inverse of each Hessian on both sides of the gradients' covariance
    left = {"x": f"(-p.{f}yy / {det('p')})", "m": f"(p.{f}xy / {det('p')})", "y": f"(-p.{f}xx / {det('p')})"}
    right = {"x": f"(-q.{f}yy / {det('q')})", "m": f"(q.{f}xy / {det('q')})", "y": f"(-q.{f}xx / {det('q')})"}
    cov = {(i, j): f"list_dot_product(p.g{i}, q.c{j}) * {s('p')} * {s('q')}" for i in "xy" for j in "xy"}
    side = lambda w, e, i: w[e if i == e else "m"]
    block = lambda e, g: " + ".join(f"{side(left, e, i)} * {cov[i, j]} * {side(right, g, j)}" for i in "xy" for j in "xy")
    return f"SELECT p.cell_id, p.spot AS a, q.spot AS b, p.iy, p.ix, p.l4 AS log_rate, {block('x', 'x')} AS xx, {block('x', 'y')} AS xy, {block('y', 'x')} AS yx, {block('y', 'y')} AS yy FROM bend_ p JOIN bend_ q USING (fid)"


def joint(f: str, scale: str) -> str:
    ridge = "CASE WHEN a = b THEN 1e-5 ELSE 0 END"
    return f"""WITH RECURSIVE {PEAKS}, both_w AS ({pair(f, scale)}) SELECT cell_id, a::INT AS a, b::INT AS b, iy, ix, {r(f'xx + {ridge}', 4)} AS xx, {r('xy', 4)} AS xy, {r('yx', 4)} AS yx, {r(f'yy + {ridge}', 4)} AS yy FROM both_w"""


#: a key for each user of the composite grids: cell and layer
LAYERED = lambda layers, power: f"""{PTS}, fan_ AS (SELECT pts.* EXCLUDE (w) REPLACE (cell_id * {layers} + l AS cell_id), pow(greatest(cos(h * 2 * pi() - l * 2 * pi() / {layers}), 0), {power}) AS w FROM pts, range({layers}) AS q(l)),
lit_ AS (SELECT * FROM fan_ WHERE w > 0), {lin(12, 'lit_', 'w')}"""  # noqa: E731

PREPARED = f"""{PTS}, moved_ AS (SELECT * REPLACE (x * 1.5 - 0.2 AS x) FROM pts),
box_ AS (SELECT cell_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM moved_ GROUP BY 1),
pad_ AS (SELECT *, b - a + greatest(b - a, d - c) * 0.3::DOUBLE AS sx, d - c + greatest(b - a, d - c) * 0.3::DOUBLE AS sy FROM box_),
dim_ AS (SELECT *, CASE WHEN sx >= sy THEN 16 ELSE round(sx / sy * 16) END AS w_, CASE WHEN sx >= sy THEN round(sy / sx * 16) ELSE 16 END AS h_ FROM pad_),
edge_ AS (SELECT *, greatest(sx / w_, sy / h_) * 16 AS edge FROM dim_),
unit_p AS (SELECT cell_id, s, (x - (a + b) / 2) / edge + 0.5 AS x, (y - (c + d) / 2) / edge + 0.5 AS y FROM moved_ JOIN edge_ USING (cell_id)), {lin(16, 'unit_p')}"""

#: conjugate gradients for (S + 1/T) a = y - m on visited bins, S the periodic Gaussian of deviation 2 with the rates' variance
LINEAR = f"""{PTS}, {lin(16)}, stat_g AS (SELECT cell_id, sum(k) / sum(n) AS mu, sum(n) / 256 AS visits, greatest(var_pop(k / n), 1e-9) AS scale FROM grid WHERE n > 0 GROUP BY 1),
cell_g AS (SELECT cell_id, iy, ix, k / n - mu AS y, mu / n AS noise, scale FROM grid JOIN stat_g USING (cell_id) WHERE n > 0),
tap_g AS (SELECT a.i AS o, exp(-0.5 * pow(least(a.i, 16 - a.i), 2) / 4) AS g FROM range(16) AS a(i)),
cov_g AS (SELECT p.cell_id, p.iy, p.ix, list(scale * u.g * v.g ORDER BY q.iy, q.ix) AS s FROM cell_g p JOIN (SELECT cell_id, iy, ix FROM cell_g) q ON q.cell_id = p.cell_id
  JOIN tap_g u ON u.o = (p.iy - q.iy + 16) % 16 JOIN tap_g v ON v.o = (p.ix - q.ix + 16) % 16 GROUP BY ALL),
sys_g AS (SELECT c.cell_id, list(s ORDER BY c.iy, c.ix) AS s, list(noise ORDER BY c.iy, c.ix) AS noise, list(y ORDER BY c.iy, c.ix) AS y FROM cov_g c JOIN cell_g USING (cell_id, iy, ix) GROUP BY 1),
cg_ AS (
  SELECT cell_id, 0 AS i, list_transform(y, lambda x: 0.0::DOUBLE) AS a, y AS r, y AS p, list_dot_product(y, y) AS rr FROM sys_g
  UNION ALL
  SELECT cell_id, i + 1, a, r, list_transform(range(1, len(r) + 1), lambda m: r[m] + p[m] * list_dot_product(r, r) / rr), list_dot_product(r, r)
  FROM (SELECT cell_id, i, rr, p, list_transform(range(1, len(r) + 1), lambda m: a[m] + p[m] * rr / list_dot_product(p, q)) AS a, list_transform(range(1, len(r) + 1), lambda m: r[m] - q[m] * rr / list_dot_product(p, q)) AS r
        FROM (SELECT c.cell_id, i, a, r, p, rr, list_transform(range(1, len(p) + 1), lambda m: list_dot_product(s[m], p) + noise[m] * p[m]) AS q FROM cg_ c JOIN sys_g USING (cell_id) WHERE i < 200 AND rr > 1e-16))),
a_g AS (SELECT cell_id, arg_max(a, i) AS a FROM cg_ GROUP BY 1),
bin_g AS (SELECT cell_id, iy, ix, a[row_number() OVER (PARTITION BY cell_id ORDER BY iy, ix)] AS a, y FROM cell_g JOIN a_g USING (cell_id)),
spot_g AS (SELECT cell_id, mu, visits, scale, a.i::INT AS iy, b.i::INT AS ix FROM stat_g, range(16) AS a(i), range(16) AS b(i)),
rate_g AS (SELECT p.cell_id, p.iy, p.ix, any_value(mu) + sum(scale * u.g * v.g * a) AS rate FROM spot_g p JOIN bin_g q USING (cell_id) JOIN tap_g u ON u.o = (p.iy - q.iy + 16) % 16 JOIN tap_g v ON v.o = (p.ix - q.ix + 16) % 16 GROUP BY 1, 2, 3),
line_g AS (SELECT f, sum(g * cos(2 * pi() * f * o / 16)) AS g FROM tap_g, range(16) AS q(f) GROUP BY 1),
gain_g AS (SELECT cell_id, a.f AS fy, b.f AS fx, scale * a.g * b.g * visits / mu AS z FROM stat_g, line_g a, line_g b),
echo_x AS (SELECT cell_id, fy, i AS dx, sum(z / (z + 1) * cos(2 * pi() * fx * i / 16)) / 16 AS e FROM gain_g, range(16) AS q(i) GROUP BY ALL),
echo_g AS (SELECT cell_id, i AS dy, dx, sum(e * cos(2 * pi() * fy * i / 16)) / 16 AS e FROM echo_x, range(16) AS q(i) GROUP BY ALL),
soft_g AS (SELECT p.cell_id, p.iy, p.ix, any_value(mu) + sum(e * y) AS filtered FROM spot_g p JOIN bin_g q USING (cell_id) JOIN echo_g o ON o.cell_id = p.cell_id AND o.dy = (p.iy - q.iy + 16) % 16 AND o.dx = (p.ix - q.ix + 16) % 16 GROUP BY 1, 2, 3)"""

SIGNED = "(cos(2 * pi() * ({k}y * y_ + {k}x * x_)) - sin(2 * pi() * ({k}y * y_ + {k}x * x_))) / 16.0::DOUBLE"

ORACLES = {
    "fitted_bins": f"WITH RECURSIVE {own_fits(16)}, {everywhere(16)} SELECT cell_id, iy, ix, {r('exp(least(greatest(log_rate + log_var / 2, -10), 10))', 5)} AS rate, {r('log_rate', 5)} AS log_rate, {r('log_var', 5)} AS log_var FROM bins_",
    "lgcp_elbo_sweep": f"WITH RECURSIVE {SWEEP} SELECT cell_id, sid AS param_id, {r('p', 5)} AS period, {r('variance', 5)} AS variance, {r('angle', 5)} AS angle, {r('elbo', 5)} AS elbo FROM score_",
    "elbo_profiles": f"WITH RECURSIVE {SWEEP}, top_s AS (SELECT cell_id, variance, max(elbo) AS elbo FROM score_ GROUP BY 1, 2) SELECT cell_id, {r('variance', 5)} AS variance, {r('elbo', 5)} AS elbo, {r('max(elbo) OVER (PARTITION BY cell_id) - elbo', 5)} AS below_best FROM top_s",
    "best_parameters": f"""WITH RECURSIVE {BEST}, one_ AS (SELECT cell_id, arg_max(p, elbo) AS p, arg_max(variance, elbo) AS variance FROM score_ WHERE style = 'radial' GROUP BY 1),
      two_ AS (SELECT s.cell_id, arg_max(angle, elbo) AS angle FROM score_ s JOIN one_ USING (cell_id, p, variance) WHERE style = 'grid' GROUP BY 1),
      three_ AS (SELECT s.cell_id, p, variance, angle, elbo, row_number() OVER (PARTITION BY s.cell_id ORDER BY elbo DESC) AS o FROM score_ s JOIN two_ USING (cell_id, angle) WHERE style = 'grid')
      SELECT cell_id, (CASE WHEN p = 4 THEN 0 ELSE 2 END + CASE WHEN variance < 0.05 THEN 0 ELSE 1 END)::BIGINT AS param_id, p AS period, variance, angle, {r('elbo', 5)} AS elbo FROM three_ WHERE o = 1""",
    "laplace_confidence": f"WITH RECURSIVE {PEAKS}, both_w AS ({pair('l', '1')}) SELECT cell_id, iy, ix, {r('log_rate', 4)} AS log_rate, {r('xx', 4)} AS xx, {r('xy', 4)} AS xy, {r('yy', 4)} AS yy FROM both_w WHERE a = b",
    "laplace_joint": joint("l", "1"),
    "laplace_joint_rate": joint("r", "({t}.r4 * exp({t}.log_var / 2))"),
    "posterior_at_points": f"""WITH RECURSIVE {own_fits(16)}, {EMB}, place_ AS (SELECT cell_id % 4 AS cell_id, vec_id AS point_id, y * 15 AS y_, x * 15 AS x_ FROM emb),
      wave_s AS (SELECT fid, cell_id, ky, kx, (CASE WHEN ky < 8 THEN ky ELSE ky - 16 END) / 16.0::DOUBLE AS ty, (CASE WHEN kx < 8 THEN kx ELSE kx - 16 END) / 16.0::DOUBLE AS tx FROM prior_),
      at_p AS (SELECT p.cell_id, point_id, list({SIGNED.format(k='t')} ORDER BY ky, kx) AS w FROM place_ p JOIN wave_s USING (cell_id) GROUP BY ALL),
      mid_p AS (SELECT cell_id, list({SIGNED.format(k='t')} ORDER BY ky, kx) AS t FROM wave_s, (SELECT 7.5::DOUBLE AS y_, 7.5::DOUBLE AS x_) GROUP BY 1)
      SELECT p.cell_id, point_id, {r('list_dot_product(w, u)')} AS mean, {r('-list_dot_product(w, list_transform(range(1, n_kept + 1), lambda q: list_dot_product(a[q], w)))')} AS variance,
        {r('-list_dot_product(t, list_transform(range(1, n_kept + 1), lambda q: list_dot_product(a[q], w)))')} AS covariance FROM at_p p JOIN mid_p USING (cell_id) JOIN done_ d ON d.cell_id = p.cell_id""",
    "regressed_maps": f"""WITH RECURSIVE {own_fits(12)}, {everywhere(12)},
      raw_m AS (SELECT b.cell_id, iy, ix, log_rate, log_var, elbo, p, variance AS prior_variance, exp(log_rate + log_var / 2) AS mean_rate, exp(2 * log_rate + log_var) * expm1_ AS variance, sqrt(expm1_) AS cv
        FROM (SELECT *, exp(log_var) - 1 AS expm1_ FROM bins_) b JOIN done_ d USING (fid) JOIN per_ ON per_.cell_id = b.cell_id JOIN spread_ ON spread_.cell_id = b.cell_id)
      SELECT cell_id, iy, ix, {', '.join(f'{r(c, 5)} AS {n}' for c, n in (('log_rate', 'log_rate'), ('log_var', 'log_var'), ('mean_rate', 'mean_rate'), ('variance', 'variance'), ('cv', 'cv'), ('mean_rate * 50', 'mean_hz'), ('variance * 2500', 'variance_hz'), ('elbo', 'elbo'), ('p', 'period'), ('prior_variance', 'prior_variance')))} FROM raw_m""",
    "prepared_maps": f"""WITH {PREPARED}, {heuristics(16)}, all_b AS (SELECT w.cell_id, w.iy, w.ix, coalesce(n, 0.0) AS n, coalesce(k, 0.0) AS k, t.rate AS kde, ln(greatest(w.rate, 1e-10)) AS m FROM wide_ w JOIN tight_ t USING (cell_id, iy, ix) LEFT JOIN grid g USING (cell_id, iy, ix))
      SELECT cell_id, iy, ix, {r('n')} AS n, {r('k')} AS k, {r(div('k', 'n'))} AS y, {r('kde')} AS kde, {r('m')} AS prior_mean, {r('ln(greatest(kde, 1e-10)) - m')} AS kde_log FROM all_b""",
    "banded_fits": f"""WITH RECURSIVE {own_fits(12, prior=BANDED)}, {everywhere(12)}, ends_w AS (SELECT fid, max(log_rate) AS peak, min(log_var) AS surest FROM bins_ GROUP BY 1)
      SELECT d.cell_id, {r('elbo', 5)} AS elbo, {r('p', 5)} AS period, {r('variance', 5)} AS variance, {r('peak', 5)} AS peak, {r('surest', 5)} AS surest
      FROM done_ d JOIN ends_w USING (fid) JOIN per_ ON per_.cell_id = d.cell_id JOIN spread_ ON spread_.cell_id = d.cell_id""",
    "linear_gp_bins": f"WITH RECURSIVE {LINEAR} SELECT cell_id, iy, ix, {r('rate', 5)} AS rate, {r('filtered', 5)} AS filtered FROM rate_g JOIN soft_g USING (cell_id, iy, ix)",
    "heading_variance": f"""WITH RECURSIVE {swept(12, "(VALUES (0, 5.0, 0.05 * 0.3, 0.0, 'grid'), (1, 5.0, 0.05, 0.0, 'grid'), (2, 5.0, 0.05 * 3, 0.0, 'grid')) AS t(sid, p, variance, angle, style)", LAYERED(4, 1))},
      first_s AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY elbo DESC, sid) AS o FROM score_)
      SELECT cell_id // 4 AS cell_id, cell_id % 4 AS layer, sid::BIGINT AS param_id, {r('p', 5)} AS period, {r('variance', 5)} AS variance, {r('angle', 5)} AS angle, {r('elbo', 5)} AS elbo, {r('variance / 0.05', 5)} AS factor FROM first_s WHERE o = 1""",
    "fit_series": f"""WITH RECURSIVE {own_fits(12, LAYERED(6, 1))}, {everywhere(12)}, ends_w AS (SELECT fid, max(log_rate) AS peak, min(log_var) AS surest FROM bins_ GROUP BY 1)
      SELECT d.cell_id // 6 AS cell_id, d.cell_id % 6 AS layer, {r('elbo', 5)} AS elbo, {r('p', 5)} AS period, {r('variance', 5)} AS variance, {r('peak', 5)} AS peak, {r('surest', 5)} AS surest
      FROM done_ d JOIN ends_w USING (fid) JOIN per_ ON per_.cell_id = d.cell_id JOIN spread_ ON spread_.cell_id = d.cell_id""",
    "shared_frequencies": f"""WITH {PTS}, {lin(16)}, {heuristics(16)}, set_ AS (SELECT row_number() OVER () AS sid, greatest(p * (i * 0.05 + 1), 2) AS p, 1.0::DOUBLE AS variance, 0.0::DOUBLE AS angle, 'radial' AS style FROM (SELECT DISTINCT p FROM per_), range(-3, 4) AS q(i)),
      {spectra(16)}, bit_f AS (SELECT DISTINCT ky * 16 + kx AS i FROM spec_ WHERE kept), all_f AS (SELECT j.pos, i FROM range(4) AS j(pos) LEFT JOIN bit_f ON i // 64 = j.pos),
      word_f AS (SELECT pos, coalesce(sum(1::HUGEINT << (i % 64 // 8 * 8 + 7 - i % 8)), 0) AS x FROM all_f GROUP BY 1)
      SELECT 0::INT AS shape, pos::INT AS pos, CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END::BIGINT AS word FROM word_f""",
}
