"""SQL of the swept strategy: any number of variants with their parameters as rows, from features to net asset values."""

from __future__ import annotations

import ast
import itertools

from strandmill.operators import strategy as C
from strandmill.operators.ledger import CAPITAL
from strandmill.plans.panel_queries import AT, POINTS, last
from strandmill.plans.signal_queries import CARRY, NORM, ewm_sql, forecast_of, side

YEAR = 52
_TYPES = {"double": "DOUBLE", "int": "INT", "string": "VARCHAR", "array<string>": "VARCHAR[]"}
MULT = "CASE " + " ".join(f"WHEN n < {b} THEN {ya}::DOUBLE + (n - {a}) * (({yb}::DOUBLE - {ya}::DOUBLE) / {b - a})" for (a, ya), (b, yb) in itertools.pairwise(ast.literal_eval(f"[{POINTS}]"))) + " END"


def variants_sql(overrides: dict[str, tuple[str, C.Params]]) -> str:
    """Rows (variant, dim, *parameters) as registry() makes them."""
    def row(name, dim, params):
        return f"SELECT '{name}' AS variant, '{dim}' AS dim, " + ", ".join(f"{params.get(k, x)!r}::{_TYPES[t]} AS {k}" for k, (t, x) in C.PARAMS.items())

    return " UNION ALL ".join([row("master", "master", {}), *(row(v, dim, o) for v, (dim, o) in overrides.items())])


def wanted_of(params: list[C.Params]) -> dict[str, list]:
    """What needs() finds in a registry of these overrides and the defaults."""
    every = [C.DEFAULTS, *({**C.DEFAULTS, **o} for o in params)]
    pick = lambda f: sorted({f(o) for o in every})
    return {
        "speeds": sorted({tuple(map(int, s.split("_"))) for o in every for s in o["speeds"]}), "vov": pick(lambda o: (o["vov_window"], o["vov_direction"])),
        "ramps": sorted({("+".join(o["speeds"]), o["conviction"]) for o in every if o["conviction"]}), "xs_lookback": pick(lambda o: o["xs_lookback"]), "skew_window": pick(lambda o: o["skew_window"]),
    }


def features_sql(wanted: dict[str, list]) -> str:
    """Tables up to ff(name, symbol, dt, v) and frame(symbol, dt, open, close, vol, usual, loss)."""
    spans = sorted({s for p in wanted["speeds"] for s in p})
    ctes = [CARRY, NORM, *(ewm_sql(f"m{s}", "b", "close", s) for s in spans)]
    raws = {f"{f}_{s}": f"SELECT b.symbol, b.dt, (f.v - s.v) / nullif(vol, 0) AS raw FROM b JOIN m{f} f USING (symbol, dt) JOIN m{s} s USING (symbol, dt)" for f, s in wanted["speeds"]}
    ctes += [f"c{name} AS ({q})" for name, q in raws.items()]
    raws = {name: f"SELECT * FROM c{name}" for name in raws}
    raws["carry"] = "SELECT b.symbol, b.dt, carry.raw FROM b LEFT JOIN carry USING (symbol, dt)"
    raws |= {f"xs{k}": f"SELECT symbol, dt, CASE WHEN count(mv) OVER x >= 3 THEN (mv - avg(mv) OVER x) / nullif(stddev_samp(mv) OVER x, 0) END AS raw FROM (SELECT symbol, dt, np - lag(np, {k}) {AT} AS mv FROM np) WINDOW x AS (PARTITION BY dt)" for k in wanted["xs_lookback"]}
    raws |= {f"skew{k}": f"SELECT symbol, dt, -CASE WHEN count(dp) {last(k)} >= 20 THEN skewness(dp) {last(k)} END AS raw FROM b" for k in wanted["skew_window"]}
    for w, k in wanted["vov"]:
        towards = side(k) if k else "1"
        raws[f"vov{w}_{k}"] = f"SELECT symbol, dt, -(vv / nullif(CASE WHEN count(vv) {last(52)} >= {w} THEN avg(vv) {last(52)} END, 0) - 1) * {towards} AS raw FROM (SELECT *, CASE WHEN count(s) {last(w)} >= 8 THEN stddev_samp(s) {last(w)} END AS vv FROM (SELECT *, CASE WHEN count(ret) {last(8)} >= 8 THEN stddev_samp(ret) {last(8)} END AS s FROM b))"
    ctes += [f"ff_{name} AS (SELECT '{name}' AS name, symbol, dt, coalesce(forecast, 0) AS v FROM ({forecast_of(q)}))" for name, q in raws.items()]
    rows = [f"SELECT * FROM ff_{name}" for name in raws]
    for i, (own, k) in enumerate(wanted["ramps"]):
        strength = " UNION ALL ".join(f"SELECT symbol, dt, coalesce(raw, 0) AS x FROM c{s}" for s in own.split("+"))
        sd = f"CASE WHEN count(x) {last(k)} >= {k // 2} THEN stddev_samp(x) {last(k)} END"
        ctes.append(f"ff_r{i} AS (SELECT 'conv{k}:{own}' AS name, symbol, dt, coalesce(greatest(least(abs(x) / nullif({sd}, 0), 1), 0), 1) AS v FROM (SELECT symbol, dt, sum(x) AS x FROM ({strength}) GROUP BY 1, 2))")
        rows.append(f"SELECT * FROM ff_r{i}")
    ctes.append("ff AS (" + " UNION ALL ".join(rows) + ")")
    usual = f"CASE WHEN count(vol) {last(52)} >= 20 THEN avg(vol) {last(52)} END"
    ctes.append(f"frame AS (SELECT symbol, dt, coalesce(lag(close) {AT}, close) AS open, close, vol, {usual} AS usual, 1 - lag(close) {AT} / nullif(lag(close, 9) {AT}, 0) AS loss FROM b)")
    return ", ".join(ctes)


def scores_sql(pv: str, wanted: dict[str, list]) -> str:
    """Tables up to sc(variant, symbol, dt, score, open, close, vol, cost_mult, pointsize, cost_rt)."""
    parts = C.PARTS
    one = lambda name: f"(SELECT name, symbol, dt, v FROM ff) {name}"
    cells = "pf AS (SELECT p.variant, p.dropped, p.fdm_mode, p.fdm_span, p.w_ts, p.w_xs, p.trend_fdm, p.conviction, p.xs_lookback, p.skew_window, p.vov_window, p.vov_direction, array_to_string(p.speeds, '+') AS own, f.symbol, f.dt FROM pv p CROSS JOIN frame f WHERE f.symbol <> p.dropped)"
    trend = "tsum AS (SELECT variant, symbol, dt, sum(v) / any_value(len(speeds)) AS ts FROM (SELECT variant, speeds, unnest(speeds) AS name FROM pv) JOIN ff USING (name) GROUP BY 1, 2, 3)"
    pick = lambda alias, name: f"JOIN {one(alias)} ON {alias}.symbol = pf.symbol AND {alias}.dt = pf.dt AND {alias}.name = {name}"
    tr = (
        "tr AS MATERIALIZED (SELECT pf.variant, pf.symbol, pf.dt, pf.fdm_span, CASE WHEN fdm_mode = 'single' THEN pf.symbol ELSE '' END AS pool, greatest(least(w_ts * ts * trend_fdm * CASE WHEN conviction > 0 THEN coalesce(fr.v, 1) ELSE 1 END + w_xs * fx.v, 20), -20) AS trend, fc.v AS carry, fs.v AS skew, fv.v AS vov FROM pf JOIN tsum USING (variant, symbol, dt) "
        + pick("fx", "'xs' || xs_lookback") + " " + pick("fc", "'carry'") + " " + pick("fs", "'skew' || skew_window") + " " + pick("fv", "'vov' || vov_window || '_' || vov_direction")
        + f" LEFT JOIN {one('fr')} ON fr.symbol = pf.symbol AND fr.dt = pf.dt AND fr.name = 'conv' || conviction || ':' || own)"
    )
    mean = ", ".join(f"avg({p}) AS {p}" for p in parts)
    pool = f"pl AS (SELECT variant, pool, dt, {mean}, any_value(fdm_span) AS span, row_number() OVER (PARTITION BY variant, pool ORDER BY dt) AS n FROM tr GROUP BY 1, 2, 3)"
    q = "power(1 - 2 / (t.span + 1.0::DOUBLE), t.n - i.n)"
    pairs = [(a, b) for k, a in enumerate(parts) for b in parts[k:]]
    sums = ", ".join([*(f"sum({q} * i.{c}) / sum({q}) AS {c}" for c in parts), *(f"sum({q} * i.{a} * i.{b}) / sum({q}) AS {a}_{b}" for a, b in pairs)])
    off = [(a, b) for a, b in pairs if a != b]
    rho = ", ".join(f"({a}_{b} - {a} * {b}) / nullif(sqrt(greatest(({a}_{a} - {a} * {a}) * ({b}_{b} - {b} * {b}), 0)), 0) AS r_{a}_{b}" for a, b in off)
    rhos = f"rh AS (SELECT variant, pool, dt, n, {rho} FROM (SELECT t.variant, t.pool, t.dt, t.n, {sums} FROM pl t JOIN pl i ON i.variant = t.variant AND i.pool = t.pool AND i.n <= t.n GROUP BY 1, 2, 3, 4))"
    all_, cross = " + ".join(f"r_{a}_{b}" for a, b in off), " + ".join(f"w_{a} * w_{b} * r_{a}_{b}" for a, b in off)
    mean_cross = f"({all_}) / {len(off)} * ({' + '.join(f'w_{a} * w_{b}' for a, b in off)})"
    var = f"greatest({' + '.join(f'w_{p} * w_{p}' for p in parts)} + 2 * CASE fdm_mode WHEN 'shrink' THEN 0.5::DOUBLE * ({cross}) WHEN 'mean' THEN {mean_cross} ELSE {cross} END, 0.01)"
    mu = f"mu AS (SELECT variant, pool, dt, CASE WHEN n >= fdm_least AND ({all_}) IS NOT NULL THEN greatest(least(1 / sqrt({var}), fdm_cap), 1) ELSE 1 END AS mult FROM rh JOIN pv USING (variant))"
    mixed = " + ".join(f"{p} * w_{p}" for p in parts)
    gate = lambda floor, x: f"(1 - (1 - {floor}) * coalesce(1 / (1 + exp(-greatest(least(steepness * ({x}), 700), -700))), 0))"
    gates = f"{gate('vol_dampen', 'vol / nullif(usual, 0) - vol_trigger')} * {gate('dd_scale', 'loss + dd_threshold')}"
    keep = "CASE WHEN halflife > 0 THEN power(2, -1 / halflife) WHEN smooth_span > 1 THEN 1 - 2 / (smooth_span + 1.0::DOUBLE) ELSE 0 END"
    mx = f"mx AS MATERIALIZED (SELECT variant, symbol, dt, greatest(least(greatest(least({mixed}, 20), -20) * mult, 20), -20) AS mixed, row_number() OVER (PARTITION BY variant, symbol ORDER BY dt) AS i, {keep} AS keep, {gates} AS gates, lag, open, close, vol, cost_mult FROM tr JOIN mu USING (variant, pool, dt) JOIN pv USING (variant) JOIN frame USING (symbol, dt))"
    w = "power(t.keep, t.i - j.i)"
    sm = f"sm AS (SELECT t.variant, t.symbol, t.dt, sum({w} * j.mixed) / sum({w}) AS smooth FROM mx t JOIN mx j ON j.variant = t.variant AND j.symbol = t.symbol AND j.i <= t.i AND j.i > t.i - CASE WHEN t.keep > 0 THEN 40 / -ln(t.keep) + 1 ELSE 1 END GROUP BY 1, 2, 3)"
    s0 = "s0 AS (SELECT mx.*, smooth * gates AS now FROM mx JOIN sm USING (variant, symbol, dt))"
    sc = "sc AS (SELECT s.variant, s.symbol, s.dt, coalesce(CASE WHEN s.lag > 0 THEN p.now ELSE s.now END, 0) AS score, s.open, s.close, s.vol, s.cost_mult, i.pointsize, i.cost_rt FROM s0 s LEFT JOIN s0 p ON p.variant = s.variant AND p.symbol = s.symbol AND p.i = s.i - s.lag JOIN instruments i ON i.symbol = s.symbol)"
    return ", ".join([f"pv AS MATERIALIZED ({pv})", features_sql(wanted).replace("ff AS (", "ff AS MATERIALIZED (", 1), cells, trend, tr, pool, rhos, mu, mx, sm, s0, sc])


def run_sql(pv: str, wanted: dict[str, list]) -> str:
    """Tables up to rn(variant, dt, pnl, commission, trades, cash, nav, ret, excess)."""
    active = "(vol IS NOT NULL AND score <> 0)"
    size = f"score / 10 * {CAPITAL!r}::DOUBLE * 0.2::DOUBLE * ({MULT}) / n / (vol * pointsize * sqrt({YEAR}::DOUBLE))"
    series = "(PARTITION BY variant, symbol ORDER BY dt)"
    t0 = f"t0 AS (SELECT *, sum({active}::INT) OVER (PARTITION BY variant, dt)::DOUBLE AS n FROM sc)"
    t1 = f"t1 AS MATERIALIZED (SELECT *, last_value(CASE WHEN {active} AND vol * pointsize >= 1e-9 THEN {size} END IGNORE NULLS) OVER {series} AS target, row_number() OVER {series} AS i FROM t0)"
    move = lambda held: f"CASE WHEN target IS NOT NULL AND abs(target - {held}) > greatest(0.1 * abs(target), 0.5) THEN sign(target) * floor(abs(target) + 0.5) ELSE {held} END"
    hold = f"hold AS (SELECT variant, symbol, i, {move('0.0::DOUBLE')} AS position FROM t1 WHERE i = 1 UNION ALL SELECT t1.variant, t1.symbol, t1.i, {move('h.position')} FROM hold h JOIN t1 ON t1.variant = h.variant AND t1.symbol = h.symbol AND t1.i = h.i + 1)"
    b0 = "p0 AS (SELECT t1.*, h.position, coalesce(lag(h.position) OVER (PARTITION BY t1.variant, t1.symbol ORDER BY t1.dt), 0) AS prior, lag(close) OVER (PARTITION BY t1.variant, t1.symbol ORDER BY t1.dt) AS pc FROM t1 JOIN hold h ON h.variant = t1.variant AND h.symbol = t1.symbol AND h.i = t1.i)"
    b1 = "p1 AS (SELECT variant, dt, position - prior AS trade, abs(position - prior) * cost_rt / 2 * cost_mult AS commission, (prior * coalesce(open - pc, 0) + position * (close - open)) * pointsize - abs(position - prior) * cost_rt / 2 * cost_mult AS pnl FROM p0)"
    day = "d0 AS (SELECT variant, dt, sum(pnl) AS pnl, sum(commission) AS commission, count(*) FILTER (trade <> 0) AS trades FROM p1 GROUP BY 1, 2), d1 AS (SELECT d.*, coalesce(c.rate / 100 / 52, 0) AS rate FROM d0 d ASOF LEFT JOIN cash_w c ON d.dt >= c.dt)"
    nav = f"d2 AS (SELECT *, rate * {CAPITAL!r}::DOUBLE AS cash, {CAPITAL!r}::DOUBLE + sum(pnl + rate * {CAPITAL!r}::DOUBLE) OVER (PARTITION BY variant ORDER BY dt) AS nav FROM d1), rn AS (SELECT *, ret - rate AS excess FROM (SELECT *, nav / coalesce(lag(nav) OVER (PARTITION BY variant ORDER BY dt), {CAPITAL!r}::DOUBLE) - 1 AS ret FROM d2))"
    return ", ".join([scores_sql(pv, wanted), t0, t1, hold, b0, b1, day, nav])


def summary_sql(pv: str, wanted: dict[str, list]) -> str:
    """Tables up to su(variant, dim, n, ann_ret, sharpe, max_dd, trades_year, costs, delta), unrounded."""
    tear = f"te AS (SELECT variant, count(*) AS n, avg(ret) * {YEAR} AS ann_ret, avg(excess) * sqrt({YEAR}::DOUBLE) / nullif(stddev_samp(ret), 0) AS sharpe, 1 - exp(min(c - greatest(pk, 0))) AS max_dd, sum(trades) * {YEAR}::DOUBLE / count(*) AS trades_year, sum(commission) AS costs FROM (SELECT *, max(c) OVER (PARTITION BY variant ORDER BY dt) AS pk FROM (SELECT *, sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER (PARTITION BY variant ORDER BY dt) AS c FROM rn)) GROUP BY 1)"
    su = "su AS (SELECT variant, dim, n, ann_ret, sharpe, max_dd, trades_year, costs, sharpe - (SELECT sharpe FROM te WHERE variant = 'master') AS delta FROM te JOIN pv USING (variant))"
    return ", ".join([run_sql(pv, wanted), tear, su])


ROUNDED = "SELECT variant, dim, n, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("ann_ret", "sharpe", "max_dd", "trades_year", "costs", "delta")) + " FROM su"
