"""Queries of blending operators and named signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators import blend as B
from strandmill.operators import joins as J
from strandmill.operators import recursive as R
from strandmill.operators import signals as G
from strandmill.operators import windows as O
from strandmill.plans.panel_queries import AREA, AT, CHAIN, DISP, EVENTS, MONTHS, PAIRS, REGIMES, SEASON, TRAILING, hurst_sql, last, leaders, monthly, regimes, term, trailing_edges
from strandmill.plans.registry import query, rounded
from strandmill.sources import panels as P

K = ("symbol", "dt")
N, LEAST = 52, 26  # of forecast scalars


def bars(spark, d):
    return G.prepare(P.bars_w(spark, d))


def hours(spark, d):
    return G.prepare(P.bars_h(spark, d))


# --- pieces of SQL ---------------------------------------------------------------------------------------------------


def ewm_sql(name: str, source: str, x: str, span: float, alpha: float | None = None, by: str = "symbol") -> str:
    """A table (symbol, dt, v): weighted mean over all rows so far that have x."""
    q = 1 - (alpha if alpha is not None else 2 / (span + 1))
    t = f"(SELECT {by}, dt, {x} AS x, row_number() OVER (PARTITION BY {by} ORDER BY dt) AS n FROM {source})"
    return f"{name} AS (SELECT t.{by}, t.dt, sum(power({q!r}, t.n - i.n) * i.x) / sum(CASE WHEN i.x IS NOT NULL THEN power({q!r}, t.n - i.n) END) AS v FROM {t} t JOIN {t} i ON i.{by} = t.{by} AND i.n <= t.n GROUP BY 1, 2)"


def ewm_std_sql(name: str, source: str, x: str, span: float, least: int) -> str:
    q = 1 - 2 / (span + 1)
    t = f"(SELECT symbol, dt, {x} AS x, row_number() {AT} AS n FROM {source})"
    p = f"power({q!r}, t.n - i.n)"
    on = "CASE WHEN i.x IS NOT NULL THEN "
    return f"{name} AS (SELECT symbol, dt, CASE WHEN c >= {least} THEN sqrt(greatest((q / w - (s / w) * (s / w)) * w * w / CASE WHEN w * w - u > 1e-12 THEN w * w - u END, 0)) END AS v FROM (SELECT t.symbol, t.dt, sum({p} * i.x) AS s, sum({p} * i.x * i.x) AS q, sum({on} {p} END) AS w, sum({on} {p} * {p} END) AS u, count(i.x) AS c FROM {t} t JOIN {t} i ON i.symbol = t.symbol AND i.n <= t.n GROUP BY 1, 2))"


def base_sql(panel: str) -> str:
    """Table b: the panel with dp, ret and vol."""
    return f"b0 AS (SELECT *, close - lag(close) {AT} AS dp, close / nullif(lag(close) {AT}, 0) - 1 AS ret FROM {panel}), " + ewm_std_sql("fastv", "b0", "dp", 8, 8) + f", mixed AS (SELECT b0.*, CASE WHEN count(dp) {last(52)} >= 20 THEN stddev_samp(dp) {last(52)} END AS sl, f.v AS fa FROM b0 JOIN fastv f USING (symbol, dt)), b AS (SELECT * EXCLUDE (sl, fa), last_value(CASE WHEN coalesce(0.7 * fa + 0.3 * sl, fa) > 0 THEN coalesce(0.7 * fa + 0.3 * sl, fa) END IGNORE NULLS) {last(None)} AS vol FROM mixed)"


BASE, BASE_H = base_sql("bars_w"), base_sql("bars_h")


def forecast_of(table: str) -> str:
    return f"SELECT symbol, dt, raw, CASE WHEN raw IS NOT NULL AND m <> 0 THEN greatest(least(raw * 10 / m, 20), -20) END AS forecast FROM (SELECT symbol, dt, raw, CASE WHEN count(raw) {last(N)} >= {LEAST} THEN avg(abs(raw)) {last(N)} END AS m FROM ({table}))"


def side(k: int, zero: float = 1.0) -> str:
    return f"(CASE WHEN close > lag(close, {k}) {AT} THEN 1.0 WHEN close < lag(close, {k}) {AT} THEN -1.0 WHEN close = lag(close, {k}) {AT} THEN {zero} END)"


def signal(name: str, make, panels: tuple, sql: str | None = None, more: str = "") -> None:
    """A query of a signal's raw value and forecast; sql gives (symbol, dt, raw)."""
    full = None if sql is None else f"SELECT symbol, dt, round(raw, 5) + 0.0 AS raw, round(forecast, 5) + 0.0 AS forecast FROM ({forecast_of(sql)})"

    @query(name, panels, full, more)
    def _(spark, d):
        return rounded(make(spark, d).withColumn("forecast", B.to_forecast("raw", N, LEAST)), *K, digits=5)


# --- scaling, blending and gating ------------------------------------------------------------------------------------


@query("bl01_blended_vol", ("bars_w",), "SELECT symbol, dt, round(vol, 6) AS vol FROM b", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, "vol"), *K)


@query("bl02_vol_scale", ("bars_w",), "SELECT symbol, dt, round(coalesce(dp / nullif(vol, 0), 0), 6) + 0.0 AS x FROM b", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, B.vol_scale("dp", "vol").alias("x")), *K)


@query("bl03_forecast_scalar", ("bars_w",), f"SELECT symbol, dt, CASE WHEN count(dp) {last(N)} >= {LEAST} THEN round(10 / nullif(avg(abs(dp)) {last(N)}, 0), 6) END AS x FROM b", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, B.forecast_scalar("dp", N, LEAST).alias("x")), *K)


@query("bl04_to_forecast", ("bars_w",), f"SELECT symbol, dt, round(forecast, 6) + 0.0 AS forecast FROM ({forecast_of('SELECT symbol, dt, dp AS raw FROM b')})", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, B.to_forecast("dp", N, LEAST).alias("forecast")), *K)


@query("bl05_blend", ("bars_w",), "SELECT symbol, dt, CASE WHEN dp IS NOT NULL THEN round(greatest(least(dp * 0.75 + ret * 100 * 0.25, 20), -20), 6) + 0.0 END AS x FROM b", BASE)
def _(spark, d):
    b = bars(spark, d).withColumn("pct", F.col("ret") * 100)
    return rounded(b.select(*K, B.blend({"dp": 0.75, "pct": 0.25}).alias("x")), *K)


@query("bl06_conviction", ("bars_w",), f"SELECT symbol, dt, CASE WHEN dp IS NOT NULL AND count(dp) {last(20)} >= 10 AND stddev_samp(dp) {last(20)} <> 0 THEN round(greatest(least(abs(dp) / stddev_samp(dp) {last(20)}, 1), 0), 6) END AS x FROM b", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, B.conviction("dp", 20, 10).alias("x")), *K)


PRICES = "x AS (SELECT dt, avg(close) AS close, avg(volume) AS volume, avg(high) AS high FROM bars_w GROUP BY 1)"


def three(spark, d):
    return P.bars_w(spark, d).groupBy("dt").agg(*(F.avg(c).alias(c) for c in ("close", "volume", "high")))


def fdm_sql(mode: str) -> str:
    q = 1 - 2 / 21
    t = "(SELECT *, row_number() OVER (ORDER BY dt) AS n FROM x)"
    p = f"power({q!r}, t.n - i.n)"
    cols = ("close", "volume", "high")
    m = ", ".join(f"sum({p} * i.{c}) / sum({p}) AS {c}" for c in cols) + ", " + ", ".join(f"sum({p} * i.{a} * i.{b}) / sum({p}) AS {a}_{b}" for i, a in enumerate(cols) for b in cols[i:])
    rho = lambda a, b: f"({a}_{b} - {a} * {b}) / nullif(sqrt(greatest(({a}_{a} - {a} * {a}) * ({b}_{b} - {b} * {b}), 0)), 0)"
    w = {"close": 0.5, "volume": 0.3, "high": 0.2}
    pairs = (("close", "volume"), ("close", "high"), ("volume", "high"))
    if mode == "mean":
        cross = f"({' + '.join(f'r{i}' for i in range(3))}) / 3 * {sum(w[a] * w[b] for a, b in pairs)!r}"
    else:
        cross = " + ".join(f"{w[a] * w[b]!r} * r{i}{' * 0.5' if mode == 'shrink' else ''}" for i, (a, b) in enumerate(pairs))
    return f"SELECT dt, round(CASE WHEN n >= 5 AND r0 IS NOT NULL AND r1 IS NOT NULL AND r2 IS NOT NULL THEN greatest(least(1 / sqrt(greatest({sum(v * v for v in w.values())!r} + 2 * ({cross}), 0.01)), sqrt(3)), 1) ELSE 1 END, 6) AS mult FROM (SELECT dt, n, " + ", ".join(f"{rho(a, b)} AS r{i}" for i, (a, b) in enumerate(pairs)) + f" FROM (SELECT t.dt, t.n, {m} FROM {t} t JOIN {t} i ON i.n <= t.n GROUP BY 1, 2))"


for _mode, _name in (("plain", "bl07_fdm"), ("shrink", "bl08_fdm_shrink"), ("mean", "bl08_fdm_mean")):

    def _make(mode):
        def _(spark, d):
            corr = R.ewm_corr(three(spark, d), ["close", "volume", "high"], span=20, least=5)
            return rounded(B.fdm(corr, {"close": 0.5, "volume": 0.3, "high": 0.2}, mode), "dt")

        return _

    query(_name, ("bars_w",), fdm_sql(_mode), PRICES)(_make(_mode))


@query("bl09_smooth", ("bars_w",), "SELECT symbol, dt, round(v, 6) AS x FROM sm", ewm_sql("sm", "bars_w", "close", 0, 1 - 2 ** (-1 / 3)))
def _(spark, d):
    return rounded(B.smooth(P.bars_w(spark, d), "close", "x", halflife=3.0).select(*K, "x"), *K)


@query("bl10_sigmoid", ("bars_w",), "SELECT symbol, dt, round(1 / (1 + exp(-dp / 10)), 6) AS x, round(1 / (1 + exp(-0.2 * (dp - 5))), 6) AS y FROM b0", "b0 AS (SELECT symbol, dt, close - lag(close) OVER (PARTITION BY symbol ORDER BY dt) AS dp FROM bars_w)")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("dp", O.diff("close"))
    return rounded(b.select(*K, S.sigmoid(F.col("dp") / 10).alias("x"), S.shifted_sigmoid(F.col("dp"), 5.0, 0.2).alias("y")), *K)


VOL_GATE = f"(1 - 0.5 * coalesce(1 / (1 + exp(-5 * (vol / nullif(CASE WHEN count(vol) {last(52)} >= 20 THEN avg(vol) {last(52)} END, 0) - 1.5))), 0))"
DD_GATE = f"(1 - 0.5 * coalesce(1 / (1 + exp(-20 * ((1 - lag(close) {AT} / nullif(lag(close, 9) {AT}, 0)) - 0.1))), 0))"


@query("bl11_vol_gate", ("bars_w",), f"SELECT symbol, dt, round({VOL_GATE}, 6) AS x FROM b", BASE)
def _(spark, d):
    return rounded(bars(spark, d).select(*K, B.vol_gate("vol", 52, 20).alias("x")), *K)


@query("bl12_drawdown_gate", ("bars_w",), f"SELECT symbol, dt, round({DD_GATE}, 6) AS x FROM bars_w")
def _(spark, d):
    return rounded(P.bars_w(spark, d).select(*K, B.drawdown_gate("close", 8).alias("x")), *K)


@query("bl13_ramp", ("bars_w",), "SELECT symbol, dt, round(greatest(least((volume - 400) / 400, 1), 0), 6) AS x FROM bars_w")
def _(spark, d):
    return rounded(P.bars_w(spark, d).select(*K, S.ramp(F.col("volume"), 400.0, 800.0).alias("x")), *K)


@query("bl14_regime_multiplier", ("bars_w",), "SELECT symbol, dt, round(greatest(least(v, 1), 0.5), 6) AS x FROM sm", f"st AS (SELECT symbol, dt, CASE WHEN volume / m > 1.5 THEN 0.5 WHEN volume / m > 1.2 THEN 0.75 ELSE 1.0 END AS s FROM (SELECT *, CASE WHEN count(volume) {last(None)} >= 10 THEN median(volume) {last(None)} END AS m FROM bars_w)), " + ewm_sql("sm", "st", "s", 5))
def _(spark, d):
    return rounded(B.regime_multiplier(P.bars_w(spark, d), "volume", "x").select(*K, "x"), *K)


@query("bl15_response", ("bars_w",), f"SELECT symbol, dt, round({3 ** 0.75!r} * x * exp(-0.5 * x * x), 6) + 0.0 AS x FROM (SELECT symbol, dt, (close - lag(close) {AT}) / 50 AS x FROM bars_w)")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("x", O.diff("close") / 50)
    return rounded(b.select(*K, (B.response(F.col("x")) + 0.0).alias("x")), *K)


@query("bl16_liquidity_weight", ("bars_w",), "SELECT symbol, dt, round(close * ln(1 + volume) / avg(ln(1 + volume)) OVER (PARTITION BY dt), 6) AS x FROM bars_w")
def _(spark, d):
    return rounded(P.bars_w(spark, d).select(*K, B.liquidity_weight("close", "volume").alias("x")), *K)


HURST = f"hret AS (SELECT * FROM (SELECT symbol, dt, close / nullif(lag(close) {AT}, 0) - 1 AS ret FROM bars_w) WHERE ret IS NOT NULL), " + hurst_sql("hret", "symbol")

# --- signals ---------------------------------------------------------------------------------------------------------


def cross_sql(name: str, fast: int, slow: int, x: str = "close", source: str = "b", by_vol: bool = True) -> str:
    """Tables for a crossover: <name>(symbol, dt, raw)."""
    gap = "(f.v - s.v) / nullif(vol, 0)" if by_vol else "f.v - s.v"
    return ewm_sql(f"{name}f", source, x, fast) + ", " + ewm_sql(f"{name}s", source, x, slow) + f", {name} AS (SELECT b.symbol, b.dt, {gap} AS raw FROM {source} b JOIN {name}f f USING (symbol, dt) JOIN {name}s s USING (symbol, dt))"


for _id, _f, _s in (("sg01_crossover_fast", 4, 16), ("sg02_crossover_medium", 8, 32), ("sg03_crossover_slow", 16, 64)):
    signal(_id, lambda spark, d, f=_f, s=_s: G.crossover(bars(spark, d), f, s), ("bars_w",), "SELECT * FROM c", BASE + ", " + cross_sql("c", _f, _s))

SPEEDS = ((4, 16), (8, 32), (16, 64))


def ensemble_sql(x: str = "close", source: str = "b", by_vol: bool = True, gain: float = 1.1) -> str:
    parts = ", ".join(cross_sql(f"e{i}", f, s, x, source, by_vol) + f", ef{i} AS ({forecast_of(f'SELECT * FROM e{i}')})" for i, (f, s) in enumerate(SPEEDS))
    return parts + f", ens AS (SELECT symbol, dt, (a.forecast + b.forecast + c.forecast) * {gain / 3!r} AS raw FROM ef0 a JOIN ef1 b USING (symbol, dt) JOIN ef2 c USING (symbol, dt))"


signal("sg04_ensemble", lambda s, d: G.ensemble(bars(s, d), SPEEDS, N, LEAST), ("bars_w",), "SELECT * FROM ens", BASE + ", " + ensemble_sql())
NORM = f"np AS (SELECT *, sum(coalesce(dp / nullif(vol, 0), 0)) {last(None)} AS np FROM b)"
signal("sg05_normalized_momentum", lambda s, d: G.normalized_momentum(bars(s, d), SPEEDS, N, LEAST), ("bars_w",), "SELECT * FROM ens", f"{BASE}, {NORM}, " + ensemble_sql("np", "np", False, 1.0))
signal("sg06_anchored_momentum", lambda s, d: G.anchored_momentum(bars(s, d), (4, 8, 13, 26, 52), 52), ("bars_w",), "SELECT symbol, dt, (" + " + ".join(f"(close / nullif(lag(close, {h}) {AT}, 0) - 1) / sqrt({h} / 52.0::DOUBLE)" for h in (4, 8, 13, 26, 52)) + ") / 5 AS raw FROM bars_w")
signal("sg07_acceleration", lambda s, d: G.changed(G.crossover(bars(s, d), 8, 32), 13), ("bars_w",), f"SELECT symbol, dt, raw - lag(raw, 13) {AT} AS raw FROM c", BASE + ", " + cross_sql("c", 8, 32))
signal("sg08_breakout", lambda s, d: G.breakout(bars(s, d), 20), ("bars_w",), f"SELECT symbol, dt, CASE WHEN count(close) {last(20)} >= 20 THEN 20 * 2 * (close - (max(close) {last(20)} + min(close) {last(20)}) / 2) / nullif(max(close) {last(20)} - min(close) {last(20)}, 0) END AS raw FROM bars_w")
signal("sg09_xs_momentum", lambda s, d: G.xs_momentum(bars(s, d), 52), ("bars_w",), "SELECT symbol, dt, CASE WHEN count(mv) OVER x >= 3 THEN (mv - avg(mv) OVER x) / nullif(stddev_samp(mv) OVER x, 0) END AS raw FROM (SELECT symbol, dt, np - lag(np, 52) OVER (PARTITION BY symbol ORDER BY dt) AS mv FROM np) WINDOW x AS (PARTITION BY dt)", f"{BASE}, {NORM}")
CARRY = f"{CHAIN}, {BASE}, carry AS (SELECT b.symbol, b.dt, (c1 - c2) / nullif(years12, 0) / nullif(vol, 0) AS raw FROM b JOIN ts USING (symbol, dt))"
CHAINED = ("bars_w", "front_w", "contracts_w")


def carries(spark, d):
    return G.carry(bars(spark, d), term(spark, d))


signal("sg10_carry", carries, CHAINED, "SELECT * FROM carry", CARRY)
signal("sg11_carry_momentum", lambda s, d: G.changed(carries(s, d), 13), CHAINED, f"SELECT symbol, dt, raw - lag(raw, 13) {AT} AS raw FROM carry", CARRY)
signal("sg12_relative_carry", lambda s, d: G.relative(carries(s, d)), CHAINED, "SELECT symbol, dt, CASE WHEN count(raw) OVER x >= 3 THEN (raw - avg(raw) OVER x) / nullif(stddev_samp(raw) OVER x, 0) END AS raw FROM carry WINDOW x AS (PARTITION BY dt)", CARRY)
signal("sg13_curvature", lambda s, d: G.curvature(bars(s, d), term(s, d), 5), CHAINED, "SELECT symbol, dt, v AS raw FROM cv", CARRY + ", bend AS (SELECT b.symbol, b.dt, (c1 - 2 * c2 + c3) / nullif(years13 * vol, 0) AS x FROM b JOIN ts USING (symbol, dt)), " + ewm_sql("cv", "bend", "x", 5))
signal("sg14_basis_momentum", lambda s, d: G.basis_momentum(term(s, d), 52, 20), CHAINED, f"SELECT symbol, dt, CASE WHEN count(g) {last(52)} >= 20 THEN sum(g) {last(52)} / nullif(stddev_samp(g) {last(52)} * sqrt(52), 0) END AS raw FROM (SELECT symbol, dt, CASE WHEN lag(e1) {AT} = e1 THEN ln(c1) - lag(ln(c1)) {AT} ELSE 0 END - CASE WHEN lag(e1) {AT} = e1 THEN ln(c2) - lag(ln(c2)) {AT} ELSE 0 END AS g FROM ts)", CHAIN)
SKEW = f"CASE WHEN count(dp) {last(52)} >= 20 THEN skewness(dp) {last(52)} END"
signal("sg15_skew", lambda s, d: G.skew(bars(s, d), 52, 20), ("bars_w",), f"SELECT symbol, dt, -{SKEW} AS raw FROM b", BASE)
signal("sg16_skew_xs", lambda s, d: G.skew_xs(bars(s, d), P.instruments(s, d), 52, 20), ("bars_w", "instruments"), f"SELECT symbol, dt, -(k - avg(k) OVER (PARTITION BY dt, asset_class)) AS raw FROM (SELECT symbol, dt, {SKEW} AS k FROM b) JOIN instruments USING (symbol)", BASE)
signal("sg17_kurtosis", lambda s, d: G.kurtosis(bars(s, d), 52, 20), ("bars_w",), f"SELECT symbol, dt, -CASE WHEN count(dp) {last(52)} >= 20 THEN kurtosis(dp) {last(52)} END AS raw FROM b", BASE)
UPS, DOWNS = (f"sum(CASE WHEN ret {o} 0 THEN ret * ret WHEN ret IS NOT NULL THEN 0 END) {last(20)}" for o in (">", "<"))
signal("sg18_semivariance", lambda s, d: G.semivariance(bars(s, d), 20), ("bars_w",), f"SELECT symbol, dt, CASE WHEN count(ret) {last(20)} >= 20 THEN ({UPS} - {DOWNS}) / nullif({UPS} + {DOWNS}, 0) END AS raw FROM b", BASE)
signal("sg19_tail_asymmetry", lambda s, d: G.tail_asymmetry(bars(s, d)), ("bars_w",), "SELECT symbol, dt, high / close + low / close - 2 AS raw FROM bars_w")
signal("sg20_vol_of_vol", lambda s, d: G.vol_of_vol(bars(s, d), 8, 20, 52, 13), ("bars_w",), f"SELECT symbol, dt, -(vv / nullif(CASE WHEN count(vv) {last(52)} >= 20 THEN avg(vv) {last(52)} END, 0) - 1) * {side(13)} AS raw FROM (SELECT *, CASE WHEN count(s) {last(20)} >= 8 THEN stddev_samp(s) {last(20)} END AS vv FROM (SELECT *, CASE WHEN count(ret) {last(8)} >= 8 THEN stddev_samp(ret) {last(8)} END AS s FROM b))", BASE)
signal("sg21_vol_regime", lambda s, d: G.vol_regime(bars(s, d), 8, 52, 20, 13), ("bars_w",), f"SELECT symbol, dt, -(f / nullif(CASE WHEN count(ret) {last(52)} >= 20 THEN stddev_samp(ret) {last(52)} END, 0) - 1) * {side(13)} AS raw FROM (SELECT b.*, fr.v AS f FROM b JOIN fr USING (symbol, dt))", BASE + ", " + ewm_std_sql("fr", "b", "ret", 8, 2))


def activity_sql(x: str) -> tuple[str, str]:
    return f"SELECT symbol, dt, v * {side(13)} AS raw FROM b JOIN ac USING (symbol, dt)", f"{BASE}, ex AS (SELECT symbol, dt, {x} / nullif(CASE WHEN count({x}) {last(20)} >= 20 THEN avg({x}) {last(20)} END, 0) - 1 AS x FROM b), " + ewm_sql("ac", "ex", "x", 8)


signal("sg22_volume_momentum", lambda s, d: G.activity_momentum(bars(s, d), "volume", 20, 8, 13), ("bars_w",), *activity_sql("volume"))
signal("sg23_oi_momentum", lambda s, d: G.activity_momentum(bars(s, d), "open_interest", 20, 8, 13), ("bars_w",), *activity_sql("open_interest"))
signal("sg24_oi_imbalance", lambda s, d: G.oi_imbalance(P.contracts_w(s, d).groupBy(*K).agg(F.sum("open_interest").alias("open_interest")), 5, 26, 52, 20), ("contracts_w",), f"SELECT symbol, dt, CASE WHEN count(g) {last(52)} >= 20 THEN (g - avg(g) {last(52)}) / nullif(stddev_samp(g) {last(52)}, 0) END AS raw FROM (SELECT symbol, dt, ln(l / nullif(lag(l, 26) {AT}, 0)) AS g FROM (SELECT symbol, dt, CASE WHEN count(oi) {last(5)} >= 5 THEN avg(oi) {last(5)} END AS l FROM (SELECT symbol, dt, sum(open_interest) AS oi FROM contracts_w GROUP BY 1, 2)))")
signal("sg25_amihud", lambda s, d: G.amihud(bars(s, d), 20), ("bars_w",), f"SELECT symbol, dt, CASE WHEN count(m) OVER x >= 3 THEN (m - avg(m) OVER x) / nullif(stddev_samp(m) OVER x, 0) END AS raw FROM (SELECT symbol, dt, CASE WHEN count(ret) {last(20)} >= 20 THEN avg(abs(ret) / greatest(volume, 1)) {last(20)} END AS m FROM b) WINDOW x AS (PARTITION BY dt)", BASE)
signal("sg26_divergence", lambda s, d: G.divergence(bars(s, d), 20), ("bars_w",), f"SELECT symbol, dt, CASE WHEN count(dp) {last(20)} >= 20 THEN corr(dp, dv) {last(20)} END AS raw FROM (SELECT *, volume - lag(volume) {AT} AS dv FROM b)", BASE)
signal("sg27_range_compression", lambda s, d: G.range_compression(bars(s, d), 8, 52, 13), ("bars_w",), f"SELECT symbol, dt, (1 - CASE WHEN count(r) {last(8)} >= 8 THEN avg(r) {last(8)} END / nullif(CASE WHEN count(r) {last(52)} >= 52 THEN avg(r) {last(52)} END, 0)) * {side(13)} AS raw FROM (SELECT *, high - low AS r FROM b)", BASE)
signal("sg28_intraday", lambda s, d: G.intraday(hours(s, d), 8), ("bars_h",), "SELECT symbol, dt, v AS raw FROM e", "p AS (SELECT symbol, dt, (close - open) / nullif(high - low, 0) AS x FROM bars_h), " + ewm_sql("e", "p", "x", 8))
signal("sg29_overnight", lambda s, d: G.overnight(hours(s, d), 8), ("bars_h",), "SELECT symbol, dt, v AS raw FROM e", f"p AS (SELECT symbol, dt, (open - lag(close) {AT}) / nullif(abs(lag(close) {AT}), 0) AS x FROM bars_h), " + ewm_sql("e", "p", "x", 8))
signal("sg30_fast_reversion", lambda s, d: G.fast_reversion(bars(s, d), 5), ("bars_w",), "SELECT symbol, dt, -(close - v) / nullif(vol, 0) AS raw FROM b JOIN e USING (symbol, dt)", BASE + ", " + ewm_sql("e", "b", "close", 5))
signal("sg31_long_reversal", lambda s, d: G.long_reversal(bars(s, d), 104, 52, 20), ("bars_w",), f"SELECT symbol, dt, -m / nullif(CASE WHEN count(m) {last(52)} >= 20 THEN stddev_samp(m) {last(52)} END, 0) AS raw FROM (SELECT symbol, dt, ln(close / lag(close, 104) {AT}) AS m FROM bars_w)")
signal("sg32_value", lambda s, d: G.value(bars(s, d), P.instruments(s, d), 104, 52), ("bars_w", "instruments"), f"SELECT symbol, dt, -(r - CASE WHEN count(r) {last(104)} >= 52 THEN avg(r) {last(104)} END) AS raw FROM (SELECT symbol, dt, np - avg(np) OVER (PARTITION BY dt, asset_class) AS r FROM np JOIN instruments USING (symbol))", f"{BASE}, {NORM}")
signal("sg33_dispersion_timing", lambda s, d: G.dispersion_timing(bars(s, d), 13, 52, 20), ("bars_w",), "SELECT symbol, dt, sd * CASE WHEN n >= 20 THEN z END AS raw FROM (SELECT symbol, dt, " + side(13) + " AS sd FROM b) JOIN dispz USING (dt)", BASE + ", " + DISP.replace("stddev_samp(close) AS s FROM bars_w", "stddev_samp(ret) AS s FROM b WHERE ret IS NOT NULL"))
signal("sg34_seasonality", lambda s, d: G.seasonality(bars(s, d), O.seasonal_score(monthly(s, d), "ret")), ("bars_w",), "SELECT b.symbol, b.dt, s.score AS raw FROM bars_w b ASOF LEFT JOIN (SELECT * FROM season WHERE score IS NOT NULL) s ON b.symbol = s.symbol AND b.dt >= s.dt", MONTHS + ", " + SEASON)
signal("sg35_turn_of_month", lambda s, d: G.turn_of_month(bars(s, d)), ("bars_w",), "SELECT symbol, dt, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', dt) ORDER BY dt) <= 1 OR row_number() OVER (PARTITION BY symbol, date_trunc('month', dt) ORDER BY dt DESC) <= 1 THEN 10.0 ELSE 0.0 END AS raw FROM bars_w")
signal("sg36_event_drift", lambda s, d: G.event_drift(bars(s, d), P.events_cal(s, d), P.instruments(s, d), ["AC0", "AC2"]), ("bars_w", "events_cal", "instruments"), "SELECT symbol, dt, CASE WHEN asset_class IN ('AC0', 'AC2') THEN flag * 10.0 ELSE 0.0 END AS raw FROM bars_w JOIN flags USING (dt) JOIN instruments USING (symbol)", EVENTS)
signal("sg37_positioning_fade", lambda s, d: G.positioning_fade(bars(s, d), P.instruments(s, d), P.positioning_w(s, d), 52, 20), ("bars_w", "instruments", "positioning_w"), f"SELECT symbol, dt, lag(z) {AT} AS raw FROM (SELECT b.symbol, b.dt, p.z FROM (SELECT symbol, dt, ccy FROM bars_w JOIN instruments USING (symbol)) b ASOF LEFT JOIN (SELECT * FROM pz WHERE z IS NOT NULL) p ON p.ccy = b.ccy AND b.dt >= p.dt)", f"pz AS (SELECT ccy, dt, -CASE WHEN count(x) {last(52, 'ccy')} >= 20 THEN (x - avg(x) {last(52, 'ccy')}) / nullif(stddev_samp(x) {last(52, 'ccy')}, 0) END AS z FROM (SELECT *, (longs - shorts) / nullif(open_interest, 0) AS x FROM positioning_w))")
signal("sg38_inflation_tilt", lambda s, d: G.inflation_tilt(bars(s, d), P.cash_w(s, d), P.instruments(s, d), 20, ["AC0", "AC1"]), ("bars_w", "instruments", "cash_w"), "SELECT b.symbol, b.dt, CASE WHEN asset_class IN ('AC0', 'AC1') THEN sc ELSE -sc END AS raw FROM (SELECT symbol, dt, asset_class FROM bars_w JOIN instruments USING (symbol)) b ASOF LEFT JOIN (SELECT * FROM cs WHERE sc IS NOT NULL) c ON b.dt >= c.dt", "cm AS (SELECT dt, ln(lag(rate, 1) OVER (ORDER BY dt) / lag(rate, 4) OVER (ORDER BY dt)) AS m FROM cash_w), cs AS (SELECT dt, CASE WHEN count(m) OVER w >= 20 THEN CASE WHEN len(list_filter(list(m) OVER w, lambda v: v <= m)) / (count(m) OVER w)::DOUBLE >= 0.8 THEN 1.0 WHEN len(list_filter(list(m) OVER w, lambda v: v <= m)) / (count(m) OVER w)::DOUBLE <= 0.2 THEN -1.0 ELSE 0.0 END END AS sc FROM cm WINDOW w AS (ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))")


def rec_sql(name: str, span: int) -> str:
    a = 2 / (span + 1)
    t = f"(SELECT symbol, dt, close AS x, row_number() {AT} AS n FROM bars_w)"
    return f"{name} AS (SELECT t.symbol, t.dt, sum(power({1 - a!r}, t.n - i.n) * i.x * CASE WHEN i.n = 1 THEN 1 ELSE {a!r} END) AS v FROM {t} t JOIN {t} i ON i.symbol = t.symbol AND i.n <= t.n GROUP BY 1, 2)"


signal("sg39_lead_lag", lambda s, d: G.lead_lag(bars(s, d), leaders(s, d), 5, 20, 52, 20, 2), ("bars_w", "instruments"), f"SELECT follower AS symbol, dt, avg(x * sign) AS raw FROM (SELECT symbol AS leader, dt, lag(z, 2) {AT} AS x FROM (SELECT symbol, dt, CASE WHEN count(g) {last(52)} >= 20 THEN (g - avg(g) {last(52)}) / nullif(stddev_samp(g) {last(52)}, 0) END AS z FROM (SELECT f.symbol, f.dt, f.v - s.v AS g FROM lf f JOIN ls s USING (symbol, dt)))) JOIN pairs USING (leader) GROUP BY 1, 2", f"{PAIRS}, {rec_sql('lf', 5)}, {rec_sql('ls', 20)}")
signal("sg40_hurst_trend", lambda s, d: G.hurst_trend(bars(s, d), SPEEDS, N, LEAST, 64, 10, (8, 16, 32)), ("bars_w",), "SELECT symbol, dt, CASE WHEN hurst IS NOT NULL THEN raw * greatest(least((hurst - 0.45) / (0.55 - 0.45), 1), 0) END AS raw FROM ens JOIN hursts USING (symbol, dt)", f"{BASE}, {ensemble_sql()}, {HURST}")
signal("sg41_vol_managed", lambda s, d: G.vol_managed(bars(s, d), SPEEDS, N, LEAST, 8, 52), ("bars_w",), f"SELECT symbol, dt, raw * CASE WHEN count(ret) {last(52)} >= 8 THEN greatest(least(stddev_samp(ret) {last(52)} / nullif(CASE WHEN count(ret) {last(8)} >= 8 THEN stddev_samp(ret) {last(8)} END, 0), 2.0), 0.5) END AS raw FROM ens JOIN b USING (symbol, dt)", BASE + ", " + ensemble_sql())


def regime_signal(spark, d):
    """The next return expected, by the mean of each regime, over its usual size."""
    r = regimes(spark, d)
    return G.raw(r, S.ratio((1 - F.col("posterior")) * F.col("m1") + F.col("posterior") * F.col("m2"), O.roll_std("ret", 52, 20)))


signal("sg42_regime", regime_signal, ("bars_w",), f"SELECT symbol, dt, ((1 - posterior) * m1 + posterior * m2) / nullif(CASE WHEN count(ret) {last(52)} >= 20 THEN stddev_samp(ret) {last(52)} END, 0) AS raw FROM posts", REGIMES)


def network_signal(spark, d):
    from strandmill.operators.cross_section import degree_norm

    return G.network(bars(spark, d), degree_norm(trailing_edges(spark, d), ("refit",)), OSCILLATORS)


#: The six speeds of the network's oscillators.
OSCILLATORS = (1, 2, 3, 4, 5, 6)


def oscillator_sql() -> str:
    t = f"nn AS (SELECT symbol, dt, np AS x, row_number() {AT} AS n FROM np)"
    part = lambda a: f"sum(power({1 - a!r}, t.n - i.n) * i.x * CASE WHEN i.n = 1 THEN 1 ELSE {a!r} END)"
    cols = ", ".join(f"{part(1 / (2 * k))} - {part(1 / (2 * k * 4))} AS o{k}" for k in OSCILLATORS)
    rows = " UNION ALL ".join(f"SELECT symbol, dt, {k} AS s, o{k} AS x FROM osc0" for k in OSCILLATORS)
    return f"{t}, osc0 AS (SELECT t.symbol, t.dt, {cols} FROM nn t JOIN nn i ON i.symbol = t.symbol AND i.n <= t.n GROUP BY 1, 2), osc AS ({rows})"


NETWORK = (
    f"{BASE}, {NORM}, {oscillator_sql()}, {AREA}, {TRAILING}, dg AS (SELECT refit, src, sum(w) AS deg FROM ens_edges GROUP BY 1, 2), "
    "nw AS (SELECT e.refit, e.src, e.dst, e.w / sqrt(a.deg * b.deg) AS w FROM ens_edges e JOIN dg a ON a.refit = e.refit AND a.src = e.src JOIN dg b ON b.refit = e.refit AND b.src = e.dst), "
    "asof_refit AS (SELECT d.dt, (SELECT max(refit) FROM nw WHERE refit <= d.dt) AS refit FROM days d), "
    "moved AS (SELECT nw.dst AS symbol, o.dt, o.s, sum(nw.w * o.x) AS x FROM osc o JOIN asof_refit USING (dt) JOIN nw ON nw.refit = asof_refit.refit AND nw.src = o.symbol GROUP BY 1, 2, 3 UNION ALL SELECT symbol, dt, s, x FROM osc JOIN asof_refit USING (dt) WHERE refit IS NULL)"
)
signal("sg43_network", network_signal, ("bars_w",), f"SELECT symbol, dt, avg({3 ** 0.75!r} * x * exp(-0.5 * x * x)) AS raw FROM moved GROUP BY 1, 2", NETWORK)
