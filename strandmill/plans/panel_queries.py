"""Queries of sources, filters, joins, windows, recursive and cross-sectional operators over the derived panels."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators import cross_section as X
from strandmill.operators import joins as J
from strandmill.operators import recursive as R
from strandmill.operators import windows as O
from strandmill.plans.registry import query, rounded
from strandmill.sources import panels as P
from strandmill.sources.sinks import numbered, save, scratch

K = ("symbol", "dt")
AT = "OVER (PARTITION BY symbol ORDER BY dt)"


def last(n: int | None, by: str = "symbol", order: str = "dt") -> str:
    """Frame of the last n rows, as SQL."""
    start = "UNBOUNDED PRECEDING" if n is None else f"{n - 1} PRECEDING"
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {start} AND CURRENT ROW)"


def simple(name: str, make, sql: str, panel: str = "bars_w", digits: int = 6) -> None:
    """A query of one new column x over a panel; sql is its expression."""
    source = getattr(P, panel)

    @query(name, (panel,), f"SELECT symbol, dt, round({sql}, {digits}) + 0.0 AS x FROM {panel}")
    def _(spark, d):
        return source(spark, d).select(*K, (F.round(make(), digits) + 0.0).alias("x"))


# --- sources ---------------------------------------------------------------------------------------------------------


@query("src01_bars", ("bars_w",), "SELECT * FROM bars_w")
def _(spark, d):
    return P.bars_w(spark, d)


@query("src01_read_bars", ("bars_w",), "SELECT symbol, dt, high AS open, high, low, close, volume, open_interest, NULL::VARCHAR AS contract FROM bars_w")
def _(spark, d):
    """Bars written as CSV, a folder a symbol, and read back by the typed reader."""
    path = scratch(spark, "bars-csv")
    P.bars_w(spark, d).select("symbol", *(F.col("high").alias(c) if c == "open" else F.lit(None).cast("string").alias(c) if c == "contract" else F.col(c) for c in P.BARS.fieldNames()[1:])).write.partitionBy("symbol").option("header", True).csv(path)
    return P.read_bars(spark, path)


CODED = "SELECT 'S' || regexp_extract(symbol, '([0-9]+)', 1) AS symbol, (1990 + expiry) || substr('FGHJKMNQUVXZ', 1 + expiry % 12, 1) AS contract, dt, close, volume, open_interest FROM contracts_w"


@query("src02_read_contracts", ("contracts_w",), CODED)
def _(spark, d):
    """Contract files as CSV, a folder SYM-YYYYM a contract, and read back: names give symbol and contract."""
    path = scratch(spark, "contracts-csv")
    code = F.concat(F.lit("S"), F.regexp_extract("symbol", "([0-9]+)", 1), F.lit("-"), (1990 + F.col("expiry")).cast("string"), F.substring(F.lit("FGHJKMNQUVXZ"), (1 + F.col("expiry") % 12).cast("int"), F.lit(1)))
    c = P.contracts_w(spark, d).select(code.alias("code"), F.date_format("dt", "yyyyMMdd").alias("Date"), F.col("close").alias("Close"), F.col("volume").alias("Volume"), F.col("open_interest").alias("Open Interest"))
    c.write.partitionBy("code").option("header", True).csv(path)
    return P.read_contracts(spark, path)


@query("src02_contracts", ("contracts_w",), "SELECT * FROM contracts_w")
def _(spark, d):
    return P.contracts_w(spark, d)


@query("src03_instruments", ("instruments",), "SELECT symbol, asset_class, ccy, pointsize, cost_rt, NULL::VARCHAR AS origin FROM instruments UNION ALL SELECT 'X' || symbol, NULL, ccy, NULL, NULL, 'extra' FROM instruments WHERE asset_class = 'AC1'")
def _(spark, d):
    base = P.instruments(spark, d)
    extra = base.where("asset_class = 'AC1'").select(F.concat(F.lit("X"), "symbol").alias("symbol"), "ccy", F.lit("extra").alias("origin"))
    return P.read_instruments(base, extra)


@query("src04_first_available", ("bars_w",), "SELECT symbol, dt, close FROM bars_w WHERE symbol < 'Brand#3' UNION ALL SELECT symbol, dt, high AS close FROM bars_w WHERE symbol NOT IN (SELECT symbol FROM bars_w WHERE symbol < 'Brand#3')")
def _(spark, d):
    b = P.bars_w(spark, d)
    return P.first_available(b.where("symbol < 'Brand#3'").select(*K, "close"), b.select(*K, F.col("high").alias("close")))


@query("src05_risk_free", ("bars_w", "cash_w"), "SELECT b.dt, round(coalesce(c.rate / 100 / 256, 0), 9) AS rate FROM (SELECT DISTINCT dt FROM bars_w) b ASOF LEFT JOIN cash_w c ON b.dt >= c.dt")
def _(spark, d):
    days = P.bars_w(spark, d).select("dt").distinct()
    return J.asof(days, P.cash_w(spark, d), "rate").select("dt", F.round(F.coalesce(F.col("rate") / 100 / 256, F.lit(0.0)), 9).alias("rate"))


@query("src06_factors", ("strategies",), "SELECT variant AS factor, median(gap)::DOUBLE AS gap, median(gap) >= 20 AS monthly FROM (SELECT variant, dt - lag(dt) OVER (PARTITION BY variant ORDER BY dt) AS gap FROM strategies) GROUP BY 1")
def _(spark, d):
    wide = P.strategies(spark, d).groupBy("dt").pivot("variant").agg(F.first("ret").cast("string"))
    return P.frequency(P.read_factors(wide, "dt").where("value IS NOT NULL"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("pf01_min_history", ("bars_w",), "SELECT symbol, dt, close FROM bars_w WHERE symbol IN (SELECT symbol FROM bars_w GROUP BY 1 HAVING count(*) >= 356)")
def _(spark, d):
    return O.min_history(P.bars_w(spark, d), 356).select(*K, "close")


@query("pf02_warmup", ("bars_w",), f"SELECT symbol, dt, row_number() {AT} > 60 AS active, CASE WHEN row_number() {AT} > 60 THEN close ELSE 0 END AS close FROM bars_w")
def _(spark, d):
    return O.warmup(P.bars_w(spark, d), 60, "close").select(*K, "active", "close")


@query("pf03_is_active", ("bars_w",), f"SELECT * FROM (SELECT symbol, dt, round(close - lag(close) {AT}, 6) AS forecast FROM bars_w) WHERE forecast IS NOT NULL AND forecast <> 0")
def _(spark, d):
    b = P.bars_w(spark, d).select(*K, F.round(O.diff("close"), 6).alias("forecast"), F.col("close").alias("vol"), F.lit(1.0).alias("fx"))
    return b.where(X.is_active()).select(*K, "forecast")


@query("pf04_valid", ("bars_w",), f"SELECT symbol, dt, bool_or(open_interest > 8) {last(None)} AS valid FROM bars_w")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("z", F.when(F.col("open_interest") > 8, 1.0).otherwise(0.0))
    return O.valid_from_first_nonzero(b, "z").select(*K, "valid")


@query("pf05_clean", ("bars_w",), "SELECT symbol, dt, CASE WHEN open_interest % 5 = 0 THEN -1.0 ELSE round(ln(open_interest), 6) END AS x FROM bars_w")
def _(spark, d):
    b = P.bars_w(spark, d)
    bad = F.when(F.col("open_interest") % 10 == 0, F.lit(float("inf"))).when(F.col("open_interest") % 5 == 0, F.lit(float("nan"))).otherwise(F.log("open_interest"))
    return b.select(*K, F.round(S.clean(bad, -1.0), 6).alias("x"))


@query("pf06_cap", ("bars_w",), f"SELECT symbol, dt, CASE WHEN lag(close) {AT} IS NOT NULL THEN greatest(least(round(close - lag(close) {AT}, 6), 20), -20) END AS x FROM bars_w")
def _(spark, d):
    return P.bars_w(spark, d).select(*K, S.cap(F.round(O.diff("close"), 6)).alias("x"))


@query("pf07_between_dates", ("bars_w",), "SELECT symbol, dt, close FROM bars_w WHERE dt >= DATE '1997-01-01' AND dt < DATE '1998-01-01'")
def _(spark, d):
    return J.between_dates(P.bars_w(spark, d), "1997-01-01", "1998-01-01").select(*K, "close")


@query("pf08_common_dates", ("bars_w",), "SELECT symbol, dt, close FROM bars_w WHERE dt IN (SELECT dt FROM bars_w GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars_w))")
def _(spark, d):
    return J.common_dates(P.bars_w(spark, d), "close").select(*K, "close")


@query("pf09_trim_active", ("bars_w",), "SELECT symbol, dt FROM bars_w JOIN (SELECT symbol AS s, min(dt) AS a, max(dt) AS z FROM bars_w WHERE open_interest > 30 GROUP BY 1) ON s = symbol AND dt BETWEEN a AND z")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("z", F.when(F.col("open_interest") > 30, 1.0).otherwise(0.0))
    return O.trim_active(b, "z").select(*K)


@query("pf10_min_active_series", ("bars_w",), "SELECT symbol, dt, close FROM bars_w WHERE dt IN (SELECT dt FROM bars_w WHERE open_interest > 25 GROUP BY 1 HAVING count(*) >= 10)")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("z", F.when(F.col("open_interest") > 25, 1.0).otherwise(0.0))
    return J.min_active_series(b, "z", 10).select(*K, "close")


@query("pf11_select_positive", ("strategies",), "SELECT * FROM strategies WHERE variant IN (SELECT variant FROM strategies GROUP BY 1 HAVING round(avg(ret), 9) > 0)")
def _(spark, d):
    s = P.strategies(spark, d)
    return J.select_positive(s, s.groupBy("variant").agg(F.round(F.avg("ret"), 9).alias("score")), "score", "variant")


@query("pf12_restrict", ("bars_w", "instruments"), "SELECT b.symbol, dt, CASE WHEN asset_class IN ('AC0', 'AC1') THEN close ELSE 0 END AS close FROM bars_w b JOIN instruments i USING (symbol)")
def _(spark, d):
    return J.restrict(P.bars_w(spark, d), P.instruments(spark, d), "asset_class", ["AC0", "AC1"], "close").select(*K, "close")


# --- joins -----------------------------------------------------------------------------------------------------------


@query("jn01_asof", ("bars_w", "cash_w"), "SELECT symbol, dt, lag(rate) OVER (PARTITION BY symbol ORDER BY dt) AS rate FROM (SELECT b.symbol, b.dt, c.rate FROM bars_w b ASOF LEFT JOIN (SELECT s.symbol, m.dt, m.rate FROM cash_w m, (SELECT DISTINCT symbol FROM bars_w) s) c ON b.symbol = c.symbol AND b.dt >= c.dt)")
def _(spark, d):
    b = P.bars_w(spark, d).select(*K)
    rates = b.select("symbol").distinct().crossJoin(P.cash_w(spark, d))
    return J.asof(b, rates, "rate", by="symbol", lag=1)


@query("jn02_align", ("bars_w",), "SELECT s.symbol, c.dt, b.close FROM (SELECT DISTINCT symbol FROM bars_w) s CROSS JOIN (SELECT DISTINCT dt FROM bars_w) c LEFT JOIN bars_w b ON b.symbol = s.symbol AND b.dt = c.dt")
def _(spark, d):
    b = P.bars_w(spark, d).select(*K, "close")
    return J.align(b, b)


@query("jn03_reindex_fill", ("bars_w",), f"SELECT symbol, dt, coalesce(last_value(close IGNORE NULLS) {last(None)}, 0) AS close FROM (SELECT s.symbol, c.dt, b.close FROM (SELECT DISTINCT symbol FROM bars_w) s CROSS JOIN (SELECT DISTINCT dt FROM bars_w) c LEFT JOIN bars_w b ON b.symbol = s.symbol AND b.dt = c.dt)")
def _(spark, d):
    b = P.bars_w(spark, d)
    return J.reindex_fill(b, b, ["close"], 0.0)


@query("jn04_with_dims", ("bars_w", "instruments"), "SELECT symbol, dt, close, asset_class, pointsize, round(cost_rt, 6) AS cost_rt FROM bars_w JOIN instruments USING (symbol)")
def _(spark, d):
    return rounded(J.with_dims(P.bars_w(spark, d).select(*K, "close"), P.instruments(spark, d)).select(*K, "close", "asset_class", "pointsize", "cost_rt"), *K)


@query("jn05_with_fx", ("bars_w", "instruments", "fx_w"), "SELECT b.symbol, b.dt, b.ccy, f.rate FROM (SELECT symbol, dt, ccy FROM bars_w JOIN instruments USING (symbol)) b ASOF JOIN fx_w f ON b.ccy = f.ccy AND b.dt >= f.dt")
def _(spark, d):
    return J.with_fx(P.bars_w(spark, d).select(*K), P.instruments(spark, d), P.fx_w(spark, d)).select(*K, "ccy", "rate")


CHAIN = "chain AS (SELECT symbol, expiry AS e1, lead(expiry) OVER w AS e2, lead(expiry, 2) OVER w AS e3 FROM (SELECT DISTINCT symbol, expiry FROM contracts_w) WINDOW w AS (PARTITION BY symbol ORDER BY expiry)), ts AS (SELECT f.symbol, f.dt, f.front AS e1, a.close AS c1, b.close AS c2, c.close AS c3, (e2 - e1)::DOUBLE AS years12, (e3 - e1)::DOUBLE AS years13 FROM front_w f LEFT JOIN chain h ON h.symbol = f.symbol AND h.e1 = f.front LEFT JOIN contracts_w a ON a.symbol = f.symbol AND a.expiry = f.front AND a.dt = f.dt LEFT JOIN contracts_w b ON b.symbol = f.symbol AND b.expiry = h.e2 AND b.dt = f.dt LEFT JOIN contracts_w c ON c.symbol = f.symbol AND c.expiry = h.e3 AND c.dt = f.dt)"


def term(spark, d, b=None):
    """The chain of contracts; contracts, which are joined for each place in it, are written once."""
    b = P.bars_w(spark, d) if b is None else b
    return J.term_structure(b, P.front_w(b), save(P.contracts_w(spark, d), "contracts"))


@query("jn06_term_structure", ("front_w", "contracts_w"), "SELECT * FROM ts", CHAIN)
def _(spark, d):
    return term(spark, d)


PAIR = "pair AS (SELECT dt, a.ret AS x, b.ret AS y FROM (SELECT * FROM strategies WHERE variant = (SELECT min(variant) FROM strategies)) a JOIN (SELECT * FROM strategies WHERE variant = (SELECT max(variant) FROM strategies)) b USING (dt))"


def two(spark, d):
    """The first and the last strategy by name, side by side."""
    s = P.strategies(spark, d)
    ends = s.agg(F.min("variant").alias("a"), F.max("variant").alias("z"))
    one = s.join(ends, s["variant"] == ends["a"]).select("dt", "ret")
    other = s.join(ends, s["variant"] == ends["z"]).select("dt", "ret")
    return J.paired(one, other)


@query("jn07_paired", ("strategies",), "SELECT * FROM pair", PAIR)
def _(spark, d):
    return two(spark, d)


EVENTS = f"days AS (SELECT DISTINCT dt FROM bars_w), hits AS (SELECT DISTINCT (SELECT min(dt) FROM days WHERE dt >= event_dt) AS dt FROM events_cal), flags AS (SELECT dt, greatest(a, coalesce(lead(a) OVER (ORDER BY dt), 0)) AS flag FROM (SELECT dt, CASE WHEN dt IN (SELECT dt FROM hits WHERE dt IS NOT NULL) THEN 1 ELSE 0 END AS a FROM days))"


@query("jn08_event_window", ("bars_w", "events_cal"), "SELECT dt, flag FROM flags", EVENTS)
def _(spark, d):
    return J.event_window(P.bars_w(spark, d), P.events_cal(spark, d))


PAIRS = "pairs AS (SELECT a.symbol AS leader, b.symbol AS follower, CASE WHEN a.k % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign FROM (SELECT symbol, CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT) AS k FROM instruments) a JOIN (SELECT symbol, CAST(regexp_extract(symbol, '([0-9]+)', 1) AS INT) AS k FROM instruments) b ON a.k % 10 = b.k % 10 AND a.k < b.k)"


def leaders(spark, d):
    i = P.instruments(spark, d).select("symbol", F.regexp_extract("symbol", "([0-9]+)", 1).cast("int").alias("k"))
    a, b = i.select(F.col("symbol").alias("leader"), F.col("k").alias("ka")), i.select(F.col("symbol").alias("follower"), F.col("k").alias("kb"))
    return a.join(b, (F.col("ka") % 10 == F.col("kb") % 10) & (F.col("ka") < F.col("kb"))).select("leader", "follower", F.when(F.col("ka") % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))


@query("jn09_lead_lag", ("bars_w", "instruments"), f"SELECT follower AS symbol, dt, round(avg(x * sign), 6) + 0.0 AS x FROM (SELECT symbol AS leader, dt, lag(close, 2) {AT} AS x FROM bars_w) JOIN pairs USING (leader) GROUP BY 1, 2", PAIRS)
def _(spark, d):
    b = P.bars_w(spark, d).select(*K, F.col("close").alias("x"))
    return rounded(J.lead_lag(b, leaders(spark, d), "x", 2), *K)


@query("jn10_match_names", (), "SELECT p_partkey, r_name AS code FROM part JOIN (SELECT DISTINCT split_part(p_type, ' ', 1) AS r_name FROM part) ON contains(upper(p_type), upper(r_name))")
def _(spark, d):
    p = P.table(spark, d, "part")
    codes = p.select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("pattern")).distinct()
    return J.match_names(p.select("p_partkey", F.col("p_type").alias("name")), codes).select("p_partkey", F.col("pattern").alias("code"))


@query("jn11_cross_params", ("strategies",), "SELECT s.variant, k.k, round(sum(ret * k.k), 6) AS total FROM strategies s CROSS JOIN (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS k) k GROUP BY 1, 2")
def _(spark, d):
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, (0.5, 1.0, 2.0)))).alias("k"))
    return rounded(J.cross_params(P.strategies(spark, d), grid).groupBy("variant", "k").agg(F.sum(F.col("ret") * F.col("k")).alias("total")), "variant", "k")


@query("jn12_leave_one_out", ("bars_w",), "SELECT a.symbol AS dropped, b.symbol FROM (SELECT DISTINCT symbol FROM bars_w) a, (SELECT DISTINCT symbol FROM bars_w) b WHERE a.symbol <> b.symbol")
def _(spark, d):
    return J.leave_one_out(P.bars_w(spark, d))


@query("jn13_coverage", ("bars_w",), "SELECT s.symbol, c.dt FROM (SELECT DISTINCT symbol FROM bars_w) s, (SELECT DISTINCT dt FROM bars_w) c WHERE NOT EXISTS (SELECT 1 FROM bars_w b WHERE b.symbol = s.symbol AND b.dt = c.dt)")
def _(spark, d):
    b = P.bars_w(spark, d)
    return J.coverage(J.align(b.select(*K), b), b, list(K))


# --- rolling windows -------------------------------------------------------------------------------------------------

simple("wn01_diff", lambda: O.diff("close", 4), f"close - lag(close, 4) {AT}")
simple("wn01_pct_change", lambda: O.pct_change("close", 4), f"close / nullif(lag(close, 4) {AT}, 0) - 1")
simple("wn02_roll_mean", lambda: O.roll_mean("close", 20, 10), f"CASE WHEN count(close) {last(20)} >= 10 THEN avg(close) {last(20)} END")
simple("wn02_roll_sum", lambda: O.roll_sum("volume", 20), f"CASE WHEN count(volume) {last(20)} >= 20 THEN sum(volume) {last(20)} END")
simple("wn02_roll_std", lambda: O.roll_std("close", 20, 10), f"CASE WHEN count(close) {last(20)} >= 10 THEN stddev_samp(close) {last(20)} END")
simple("wn03_channel_pos", lambda: O.channel_pos("close", 20), f"CASE WHEN count(close) {last(20)} >= 20 THEN 2 * (close - (max(close) {last(20)} + min(close) {last(20)}) / 2) / nullif(max(close) {last(20)} - min(close) {last(20)}, 0) END")
simple("wn04_roll_skew", lambda: O.roll_skew("close", 20, 10), f"CASE WHEN count(close) {last(20)} >= 10 THEN skewness(close) {last(20)} END")
simple("wn05_roll_kurt", lambda: O.roll_kurt("close", 20, 10), f"CASE WHEN count(close) {last(20)} >= 10 THEN kurtosis(close) {last(20)} END")
simple("wn06_roll_corr", lambda: O.roll_corr("close", "volume", 20), f"CASE WHEN count(close) {last(20)} >= 20 THEN corr(close, volume) {last(20)} END")
simple("wn07_roll_z", lambda: O.roll_z("close", 20), f"CASE WHEN count(close) {last(20)} >= 20 THEN (close - avg(close) {last(20)}) / nullif(stddev_samp(close) {last(20)}, 0) END")
simple("wn08_expanding_median", lambda: O.expanding_median("close", 10), f"CASE WHEN count(close) {last(None)} >= 10 THEN median(close) {last(None)} END")
simple("wn09_roll_quintile", lambda: O.roll_quintile("close", 20), f"CASE WHEN count(close) {last(20)} >= 20 THEN CASE WHEN len(list_filter(list(close) {last(20)}, lambda v: v <= close)) / 20.0::DOUBLE >= 0.8 THEN 1.0 WHEN len(list_filter(list(close) {last(20)}, lambda v: v <= close)) / 20.0::DOUBLE <= 0.2 THEN -1.0 ELSE 0.0 END END")

NAV = f"nav AS (SELECT variant, dt, ret, round(exp(sum(ln(1 + ret)) {last(None, 'variant')}), 9) AS nav FROM strategies)"


@query("wn10_drawdown", ("strategies",), f"SELECT variant, dt, round(dd, 6) AS drawdown, row_number() OVER (PARTITION BY variant, spell ORDER BY dt) - 1 AS dd_days FROM (SELECT *, 1 - nav / peak AS dd, sum(CASE WHEN nav >= peak THEN 1 ELSE 0 END) {last(None, 'variant')} AS spell FROM (SELECT *, max(nav) {last(None, 'variant')} AS peak FROM nav))", NAV)
def _(spark, d):
    s = P.strategies(spark, d).withColumn("nav", F.round(O.compound("ret", by="variant"), 9))
    return rounded(O.drawdown(s, "nav", "variant").select("variant", "dt", "drawdown", "dd_days"), "variant", "dt")


@query("wn11_norm_price", ("bars_w",), f"SELECT symbol, dt, round(sum(coalesce(dp / nullif(vol, 0), 0)) {last(None)}, 6) + 0.0 AS x FROM (SELECT *, CASE WHEN count(dp) {last(20)} >= 10 THEN stddev_samp(dp) {last(20)} END AS vol FROM (SELECT symbol, dt, close - lag(close) {AT} AS dp FROM bars_w))")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("dp", O.diff("close")).withColumn("vol", O.roll_std("dp", 20, 10))
    return b.select(*K, (F.round(O.norm_price("dp", "vol"), 6) + 0.0).alias("x"))


@query("wn12_compound", ("strategies",), "SELECT variant, dt, round(nav, 6) AS nav FROM nav", NAV)
def _(spark, d):
    return rounded(P.strategies(spark, d).select("variant", "dt", O.compound("ret", by="variant").alias("nav")), "variant", "dt")


def over_strategies(name: str, make, sql: str, more: str = "") -> None:
    @query(name, ("strategies",), f"SELECT variant, dt, round({sql}, 6) + 0.0 AS x FROM strategies", more)
    def _(spark, d):
        return P.strategies(spark, d).select("variant", "dt", (F.round(make(), 6) + 0.0).alias("x"))


V = "variant"
over_strategies("wn13_rv_scale", lambda: O.rv_scale("ret", 0.2, 20, 52, 0.5, 2.0, by=V), f"coalesce(CASE WHEN count(ret) {last(20, V)} >= 20 THEN greatest(least(0.2 / nullif(sqrt(sum(ret * ret) {last(20, V)} * 52 / 20), 0), 2.0), 0.5) END, 1.0)")
over_strategies("wn14_variance_ratio", lambda: O.variance_ratio_scale("ret", 8, 52, 0.5, 2.0, by=V), f"CASE WHEN count(ret) {last(52, V)} >= 8 THEN greatest(least(stddev_samp(ret) {last(52, V)} / nullif(CASE WHEN count(ret) {last(8, V)} >= 8 THEN stddev_samp(ret) {last(8, V)} END, 0), 2.0), 0.5) END")


@query("wn15_ar1_forecast", ("strategies",), f"SELECT variant, dt, round(0.5 * (last_value(fa IGNORE NULLS) {last(None, V)} + last_value(fb IGNORE NULLS) {last(None, V)} * rv) + 0.5 * rv, 6) AS forecast FROM (SELECT *, CASE WHEN n % 8 = 0 AND n > 52 THEN regr_slope(rv, p) {last(52, V)} END AS fb, CASE WHEN n % 8 = 0 AND n > 52 THEN regr_intercept(rv, p) {last(52, V)} END AS fa FROM (SELECT variant, dt, ret * ret * 100 AS rv, lag(ret * ret * 100) OVER (PARTITION BY variant ORDER BY dt) AS p, row_number() OVER (PARTITION BY variant ORDER BY dt) AS n FROM strategies))")
def _(spark, d):
    s = P.strategies(spark, d).withColumn("rv", F.col("ret") * F.col("ret") * 100)
    return rounded(O.ar1_forecast(s, "rv", 52, 8, by=V).select(V, "dt", "forecast"), V, "dt")


ROLL_SR = f"sr AS (SELECT variant, dt, CASE WHEN count(ret) {last(52, V)} >= 52 THEN round(avg(ret) {last(52, V)} / nullif(stddev_samp(ret) {last(52, V)}, 0) * sqrt(52), 6) END AS sr, row_number() OVER (PARTITION BY variant ORDER BY dt) AS n FROM strategies)"


@query("wn16_roll_sharpe", ("strategies",), "SELECT variant, round(regr_slope(sr, n), 6) AS slope, min(sr) AS low, max(sr) AS high, arg_min(dt, (sr, dt)) AS low_dt, arg_max(dt, (sr, dt)) AS high_dt FROM sr WHERE sr IS NOT NULL GROUP BY 1", ROLL_SR)
def _(spark, d):
    s = P.strategies(spark, d)
    sr = s.select(V, "dt", F.round(S.ratio(O.roll_mean("ret", 52, by=V), O.roll_std("ret", 52, by=V)) * F.sqrt(F.lit(52.0)), 6).alias("sr"), F.row_number().over(O.series(V)).alias("n")).where("sr IS NOT NULL")
    key = F.struct("sr", "dt")
    return sr.groupBy(V).agg(F.round(F.regr_slope("sr", "n"), 6).alias("slope"), F.min("sr").alias("low"), F.max("sr").alias("high"), F.min_by("dt", key).alias("low_dt"), F.max_by("dt", key).alias("high_dt"))


@query("wn17_sliding_windows", ("strategies",), "SELECT variant, dt, ret AS target, array_to_string(list_transform(w, lambda v: CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR)), ',') AS win FROM (SELECT *, list(ret) OVER (PARTITION BY variant ORDER BY dt ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS w FROM strategies) WHERE len(w) = 8")
def _(spark, d):
    s = O.sliding_windows(P.strategies(spark, d), "ret", 8, by=V)
    return s.select(V, "dt", "target", F.array_join(F.transform("window", lambda v: F.round(v * 1000000).cast("long").cast("string")), ",").alias("win"))


def hurst_sql(table: str, by: str, window: int = 64, step: int = 10, chunks: tuple = (8, 16, 32)) -> str:
    """Tables up to hursts(by, dt, hurst) over (by, dt, ret)."""
    return (
        f"hr AS (SELECT {by}, dt, ret, row_number() OVER (PARTITION BY {by} ORDER BY dt) AS rn FROM {table}), "
        f"an AS (SELECT {by}, rn AS anchor FROM hr WHERE rn >= {window} AND rn % {step} = 0), "
        f"ck AS (SELECT {by}, anchor, chunk, k FROM an CROSS JOIN (SELECT unnest({list(chunks)}) AS chunk) c CROSS JOIN (SELECT unnest(range({window})) AS k) r WHERE (k + 1) * chunk <= {window}), "
        f"cv0 AS (SELECT c.{by}, anchor, chunk, k, h.rn, h.ret, avg(h.ret) OVER (PARTITION BY c.{by}, anchor, chunk, k) AS mean FROM ck c JOIN hr h ON h.{by} = c.{by} AND h.rn > anchor - {window} + k * chunk AND h.rn <= anchor - {window} + (k + 1) * chunk), "
        f"cv1 AS (SELECT *, sum(ret - mean) OVER (PARTITION BY {by}, anchor, chunk, k ORDER BY rn) AS dev FROM cv0), "
        f"rs AS (SELECT {by}, anchor, chunk, k, (max(dev) - min(dev)) / nullif(stddev_pop(ret), 0) AS rs FROM cv1 GROUP BY 1, 2, 3, 4), "
        f"hl AS (SELECT {by}, anchor, chunk, ln(avg(rs)) AS ly, ln(chunk::DOUBLE) AS lx FROM rs WHERE rs > 0 GROUP BY 1, 2, 3), "
        f"hh AS (SELECT {by}, anchor AS rn, regr_slope(ly, lx) AS h FROM hl GROUP BY 1, 2), "
        f"hursts AS (SELECT hr.{by}, hr.dt, last_value(h IGNORE NULLS) OVER (PARTITION BY hr.{by} ORDER BY hr.rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hurst FROM hr LEFT JOIN hh ON hh.{by} = hr.{by} AND hh.rn = hr.rn)"
    )


@query("wn18_roll_hurst", ("strategies",), "SELECT variant, dt, round(hurst, 6) + 0.0 AS hurst FROM hursts", hurst_sql("strategies", "variant"))
def _(spark, d):
    return rounded(O.roll_hurst(P.strategies(spark, d), "ret", 64, 10, (8, 16, 32), by=V).select(V, "dt", "hurst"), V, "dt")


@query("wn19_turn_of_month", ("bars_w",), "SELECT symbol, dt, CASE WHEN row_number() OVER (PARTITION BY symbol, date_trunc('month', dt) ORDER BY dt) <= 1 OR row_number() OVER (PARTITION BY symbol, date_trunc('month', dt) ORDER BY dt DESC) <= 1 THEN 1 ELSE 0 END AS flag FROM bars_w")
def _(spark, d):
    return O.turn_of_month(P.bars_w(spark, d), 1, 1).select(*K, "flag")


MONTHS = f"months AS (SELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS dt, arg_max(close, dt) AS close FROM bars_w GROUP BY 1, 2), mrets AS (SELECT symbol, dt, round(close / lag(close) {AT} - 1, 9) AS ret FROM months)"
SEASON = "season AS (SELECT symbol, dt, CASE WHEN count(ret) OVER w >= 3 THEN avg(ret) OVER w * sqrt(count(ret) OVER w) / nullif(stddev_pop(ret) OVER w, 0) END AS score FROM mrets WINDOW w AS (PARTITION BY symbol, month(dt) ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))"


def monthly(spark, d):
    m = X.resample_month(P.bars_w(spark, d), "close", "last")
    return m.withColumn("ret", F.round(O.pct_change("close"), 9))


@query("wn20_seasonal_score", ("bars_w",), "SELECT symbol, dt, round(score, 6) + 0.0 AS score FROM season", MONTHS + ", " + SEASON)
def _(spark, d):
    return rounded(O.seasonal_score(monthly(spark, d), "ret").select(*K, "score"), *K)


simple("wn21_shift", lambda: O.shift("close", 3, 0.0), f"lag(close, 3, 0) {AT}")


@query("wn22_same_contract_diff", ("front_w",), f"SELECT symbol, dt, round(CASE WHEN lag(front) {AT} = front THEN close - lag(close) {AT} ELSE 0 END, 6) + 0.0 AS x FROM bars_w JOIN front_w USING (symbol, dt)")
def _(spark, d):
    b = P.bars_w(spark, d)
    b = b.join(P.front_w(b), list(K))
    return b.select(*K, (F.round(O.same_contract_diff("close", "front"), 6) + 0.0).alias("x"))


# --- recursive -------------------------------------------------------------------------------------------------------

ROWS = f"rows_w AS (SELECT symbol, dt, close, row_number() {AT} AS n FROM bars_w)"


def decay_sql(a: float, columns: str, tables: str = "rows_w") -> str:
    """Sums over all pairs of a row and those up to it, weighted by (1 - a) to the rows between."""
    return f"SELECT t.symbol, t.dt, t.n, {columns} FROM {tables} t JOIN {tables} i ON i.symbol = t.symbol AND i.n <= t.n GROUP BY 1, 2, 3".replace("WT", f"power({1 - a!r}, t.n - i.n)")


@query("rc01_ewm_mean", ("bars_w",), "SELECT symbol, dt, round(s / w, 6) AS x FROM (" + decay_sql(2 / 9, "sum(WT * i.close) AS s, sum(WT) AS w") + ")", ROWS)
def _(spark, d):
    return rounded(R.ewm_mean(P.bars_w(spark, d), "close", "x", span=8).select(*K, "x"), *K)


@query("rc01_ewm_mean_blocks", ("bars_w",), "SELECT symbol, dt, round(s / w, 6) AS x FROM (" + decay_sql(0.5, "sum(WT * i.close) AS s, sum(WT) AS w") + ")", ROWS)
def _(spark, d):
    return rounded(R.ewm_mean(P.bars_w(spark, d), "close", "x", alpha=0.5, block=64).select(*K, "x"), *K)


#: Sales of each nation's suppliers in order: series of thousands of rows.
SALES = "sales AS (SELECT symbol, qty, price, n, n AS dt FROM (SELECT s_nationkey AS symbol, l_quantity::DOUBLE AS qty, (l_extendedprice / 1000)::DOUBLE AS price, row_number() OVER (PARTITION BY s_nationkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey))"
RATES = (2, 26, 104, 416)


def sales(spark, d):
    rows = P.table(spark, d, "lineitem").join(P.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.select(F.col("s_nationkey").alias("symbol"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = numbered(rows, ["symbol"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], ["l_quantity", "l_extendedprice"])
    return rows.select("symbol", "place", (F.col("place") + 1).alias("dt"), F.col("l_quantity").cast("double").alias("qty"), (F.col("l_extendedprice") / 1000).cast("double").alias("price"))


def slow_sums(columns: str, decay: str) -> str:
    """Sums over all rows up to a row, weighted by a decay to the rows between; what weighs less than 1e-16 of it is left out."""
    return f"SELECT t.symbol, t.dt, {columns.replace('WT', f'power({decay}, t.n - i.n)')} FROM sales t JOIN sales i ON i.symbol = t.symbol AND i.n <= t.n AND i.n > t.n + 37 / ln({decay}) GROUP BY 1, 2"


@query("rc01_ewm_rates", (), "SELECT symbol, dt, span, round(s / w, 6) AS x FROM (" + " UNION ALL ".join(f"SELECT symbol, dt, {r} AS span, s, w FROM ({slow_sums('sum(WT * i.qty) AS s, sum(WT) AS w', repr(1 - 2 / (r + 1)))})" for r in RATES) + ")", SALES)
def _(spark, d):
    """Means of very different rates at once, on series of thousands of rows."""
    s = R.ewm_means(sales(spark, d), {f"m{r}": ("qty", 2 / (r + 1)) for r in RATES}, place="place")
    return rounded(s.select("symbol", "dt", F.inline(F.array(*(F.struct(F.lit(r).alias("span"), F.col(f"m{r}").alias("x")) for r in RATES)))), "symbol", "dt", "span")


OWN = "(1 - 2 / (20.0::DOUBLE * t.symbol + 7))"


@query("rc04_ewm_corr_rates", (), "SELECT symbol, dt, CASE WHEN n >= 8 THEN round((p / w - s * u / w / w) / nullif(sqrt(greatest((q / w - s * s / w / w) * (r / w - u * u / w / w), 0)), 0), 6) + 0.0 END AS rho FROM (" + slow_sums("any_value(t.n) AS n, sum(WT) AS w, sum(WT * i.qty) AS s, sum(WT * i.price) AS u, sum(WT * i.qty * i.price) AS p, sum(WT * i.qty * i.qty) AS q, sum(WT * i.price * i.price) AS r", OWN) + ")", SALES)
def _(spark, d):
    """Correlations with a rate of each series' own, in a column."""
    s, names = R.ewm_rhos(sales(spark, d), ["qty", "price"], 2 / (20.0 * F.col("symbol") + 7), by=("symbol",), place="place")
    return rounded(s.select("symbol", "dt", F.when(F.col("_n") >= 8, F.col(names["qty", "price"])).alias("rho")), "symbol", "dt")


@query("rc02_ewm_recursive", ("bars_w",), "SELECT symbol, dt, round(s, 6) AS x FROM (" + decay_sql(0.2, "sum(WT * i.close * CASE WHEN i.n = 1 THEN 1 ELSE 0.2 END) AS s") + ")", ROWS)
def _(spark, d):
    return rounded(R.ewm_mean(P.bars_w(spark, d), "close", "x", alpha=0.2, adjust=False).select(*K, "x"), *K)


@query("rc03_ewm_std", ("bars_w",), "SELECT symbol, dt, CASE WHEN n >= 8 THEN round(sqrt(greatest((q / w - (s / w) * (s / w)) * w * w / (w * w - v), 0)), 6) END AS x FROM (" + decay_sql(2 / 17, "sum(WT * i.close) AS s, sum(WT * i.close * i.close) AS q, sum(WT) AS w, sum(WT * WT) AS v") + ")", ROWS)
def _(spark, d):
    return rounded(R.ewm_std(P.bars_w(spark, d), "close", "x", span=16, least=8).select(*K, "x"), *K)


@query("rc04_ewm_corr", ("bars_w",), "SELECT symbol, dt, 'close' AS i, 'volume' AS j, CASE WHEN n >= 8 THEN round((p / w - s * u / w / w) / nullif(sqrt(greatest((q / w - s * s / w / w) * (r / w - u * u / w / w), 0)), 0), 6) END AS rho FROM (" + decay_sql(2 / 17, "sum(WT * i.close) AS s, sum(WT * i.volume) AS u, sum(WT * i.close * i.volume) AS p, sum(WT * i.close * i.close) AS q, sum(WT * i.volume * i.volume) AS r, sum(WT) AS w", "rows_v") + ")", f"rows_v AS (SELECT symbol, dt, close, volume, row_number() {AT} AS n FROM bars_w)")
def _(spark, d):
    return rounded(R.ewm_corr(P.bars_w(spark, d), ["close", "volume"], by=("symbol",), span=16, least=8).select(*K, "i", "j", "rho"), *K)


@query("rc05_ewm_var0", ("bars_w",), f"SELECT symbol, dt, round(last_value(x IGNORE NULLS) {last(None)}, 6) AS x FROM (SELECT b.symbol, b.dt, g.x FROM bars_w b LEFT JOIN (SELECT symbol, dt, s / w AS x FROM (" + decay_sql(2 / 9, "sum(WT * i.dp * i.dp) AS s, sum(WT) AS w", "seen") + ")) g USING (symbol, dt))", f"seen AS (SELECT *, row_number() {AT} AS n FROM (SELECT symbol, dt, close - lag(close) {AT} AS dp FROM bars_w) WHERE dp IS NOT NULL AND abs(dp) > 50)")
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("dp", O.diff("close")).withColumn("dp", F.when(F.abs("dp") > 50, F.col("dp")))
    return rounded(R.ewm_var0(b, "dp", "x", span=8).select(*K, "x"), *K)


DEADBAND = f"dn AS (SELECT symbol, dt, close / 100 AS target, row_number() {AT} AS i FROM bars_w), db AS (SELECT symbol, i, CASE WHEN abs(target) > greatest(0.1 * abs(target), 0.5) THEN round(target) ELSE 0.0 END AS held FROM dn WHERE i = 1 UNION ALL SELECT t.symbol, t.i, CASE WHEN abs(t.target - h.held) > greatest(0.1 * abs(t.target), 0.5) THEN round(t.target) ELSE h.held END FROM db h JOIN dn t ON t.symbol = h.symbol AND t.i = h.i + 1)"


@query("rc06_deadband", ("bars_w",), "SELECT symbol, dt, held FROM dn JOIN db USING (symbol, i)", DEADBAND)
def _(spark, d):
    b = P.bars_w(spark, d).select(*K, (F.col("close") / 100).alias("target"))
    return R.deadband(b, "target", "held").select(*K, "held")


def regimes(spark, d):
    """Posterior of the second regime over 20 rows; each regime has moments of its own, of a trailing year, held between refits."""
    b = P.bars_w(spark, d).withColumn("ret", O.pct_change("close")).where("ret IS NOT NULL")
    b = R.split_moments(b, "ret", 52, 20, every=8)
    sd = lambda c: F.greatest(F.col(c), F.lit(1e-6))
    post = R.regime_posterior(F.col("ret"), {"mean1": F.col("m1"), "sd1": sd("s1"), "mean2": F.col("m2"), "sd2": sd("s2"), "stay": F.lit(0.95)}, 20)
    return b.withColumn("posterior", F.when(F.col("s1").isNotNull(), post))


def _density(k: int) -> str:
    return f"(-ln(v.sd{k}) - 0.5 * power((r.ret - v.m{k}) / v.sd{k}, 2))"


def _either(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))))"


_A, _B = (_either(f"f.{x} + ln(0.95::DOUBLE)", f"f.{y} + ln(0.05::DOUBLE)") for x, y in ("ab", "ba"))
REGIMES = (
    f"g0 AS (SELECT *, row_number() {AT} AS n FROM (SELECT symbol, dt, close / nullif(lag(close) {AT}, 0) - 1 AS ret FROM bars_w) WHERE ret IS NOT NULL), "
    f"g1 AS (SELECT *, list_sort(list(ret) {last(52)}) AS a FROM g0), "
    "g2 AS (SELECT *, CASE WHEN len(a) >= 20 AND n % 8 = 0 THEN {'m1': list_aggregate(a, 'quantile_cont', 0.25), 's1': list_aggregate(a[1:len(a) // 2], 'stddev_pop'), 'm2': list_aggregate(a, 'quantile_cont', 0.75), 's2': list_aggregate(a[len(a) - len(a) // 2 + 1:len(a)], 'stddev_pop')} END AS q FROM g1), "
    f"g3 AS (SELECT symbol, dt, n, ret, last_value(q IGNORE NULLS) {last(None)} AS q FROM g2), "
    "g4 AS (SELECT symbol, dt, n, q.m1 AS m1, q.m2 AS m2, greatest(q.s1, 0.000001) AS sd1, greatest(q.s2, 0.000001) AS sd2 FROM g3 WHERE q IS NOT NULL), "
    "fw AS (SELECT symbol, n, greatest(n - 20, 0) AS i, ln(0.5::DOUBLE) AS a, ln(0.5::DOUBLE) AS b FROM g4 "
    f"UNION ALL SELECT symbol, n, i, a - {_either('a', 'b')}, b - {_either('a', 'b')} FROM (SELECT f.symbol, f.n, f.i + 1 AS i, {_A} + {_density(1)} AS a, {_B} + {_density(2)} AS b FROM fw f JOIN g4 v ON v.symbol = f.symbol AND v.n = f.n JOIN g3 r ON r.symbol = f.symbol AND r.n = f.i + 1 WHERE f.i < f.n)), "
    "posts AS (SELECT g3.symbol, g3.dt, g3.n, exp(fw.b) AS posterior, q.m1 AS m1, q.m2 AS m2, ret FROM g3 LEFT JOIN fw ON fw.symbol = g3.symbol AND fw.n = g3.n AND fw.i = g3.n)"
)


@query("rc07_regime_posterior", ("bars_w",), "SELECT symbol, dt, round(posterior, 6) + 0.0 AS posterior FROM posts", REGIMES)
def _(spark, d):
    return rounded(regimes(spark, d).select(*K, "posterior"), *K)


@query("rc08_hold_refit", ("bars_w",), f"SELECT symbol, dt, last_value(p IGNORE NULLS) {last(None)} AS p FROM (SELECT symbol, dt, CASE WHEN row_number() {AT} % 8 = 0 THEN close END AS p FROM bars_w)")
def _(spark, d):
    return R.hold_refit(P.bars_w(spark, d).select(*K, F.col("close").alias("p")), ["p"], 8)


# --- cross sections --------------------------------------------------------------------------------------------------

XS = "OVER (PARTITION BY dt)"
simple("xs01_z", lambda: X.xs_z("close"), f"CASE WHEN count(close) {XS} >= 3 THEN (close - avg(close) {XS}) / nullif(stddev_samp(close) {XS}, 0) END")


@query("xs02_group_demean", ("bars_w", "instruments"), "SELECT symbol, dt, round(close - avg(close) OVER (PARTITION BY dt, asset_class), 6) + 0.0 AS x FROM bars_w JOIN instruments USING (symbol)")
def _(spark, d):
    b = J.with_dims(P.bars_w(spark, d), P.instruments(spark, d))
    return b.select(*K, (F.round(X.group_demean("close", "asset_class"), 6) + 0.0).alias("x"))


DISP = "disp AS (SELECT dt, stddev_samp(close) AS s FROM bars_w GROUP BY 1), dispz AS (SELECT dt, (s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0) AS z, count(s) OVER w AS n FROM disp WINDOW w AS (ORDER BY dt ROWS BETWEEN 51 PRECEDING AND CURRENT ROW))"


@query("xs03_dispersion_z", ("bars_w",), "SELECT dt, CASE WHEN n >= 20 THEN round(z, 6) END AS z FROM dispz", DISP)
def _(spark, d):
    return rounded(X.dispersion_z(P.bars_w(spark, d), "close", 52, 20), "dt")


@query("xs04_pool_mean", ("bars_w",), "SELECT dt, round(avg(close), 6) AS close, round(avg(volume), 6) AS volume FROM bars_w GROUP BY 1")
def _(spark, d):
    return rounded(X.pool_mean(P.bars_w(spark, d), ["close", "volume"]), "dt")


#: Fixed values, as published: (series, multiplier), for SQL of its own; the last point stands for any larger number.
POINTS = "(1, 1.0), (2, 1.20), (3, 1.48), (4, 1.56), (5, 1.70), (6, 1.90), (7, 1.98), (8, 2.11), (9, 2.18), (10, 2.24), (15, 2.53), (20, 2.87), (25, 3.01), (30, 3.12), (40, 3.27), (50, 3.39), (60, 3.47), (70, 3.54), (100, 3.75), (200, 4.0), (1000000000, 4.0)"
PTS = f"pts0 AS (SELECT n0::DOUBLE AS n0, m::DOUBLE AS m FROM (VALUES {POINTS}) t(n0, m)), pts AS (SELECT n0, m, lead(n0) OVER (ORDER BY n0) AS n1, lead(m) OVER (ORDER BY n0) AS m1 FROM pts0)"


@query("xs05_div_mult", ("bars_w",), "SELECT dt, n, round(1.0 / n, 6) AS weight, round(m + (m1 - m) * (n - n0) / (n1 - n0), 6) AS mult FROM (SELECT dt, count(*) AS n FROM bars_w GROUP BY 1) JOIN pts ON n >= n0 AND n < n1", PTS)
def _(spark, d):
    return rounded(X.div_mult(P.bars_w(spark, d)), "dt", "n")


def factor_table(spark, d):
    """Loadings of each symbol on two factors: one, and its volume's deviation."""
    b = P.bars_w(spark, d).groupBy("symbol").agg(F.round(F.avg("volume") / 100, 4).alias("v"))
    return b.select("symbol", F.explode(F.array(F.struct(F.lit("f0").alias("factor"), F.lit(1.0).alias("loading")), F.struct(F.lit("f1").alias("factor"), F.col("v").alias("loading")))).alias("x")).select("symbol", "x.factor", "x.loading")


FACTORS = (
    f"rt AS (SELECT * FROM (SELECT symbol, dt, close / nullif(lag(close) {AT}, 0) - 1 AS ret FROM bars_w) WHERE ret IS NOT NULL), "
    "ld AS (SELECT symbol, round(avg(volume) / 100, 4) AS v FROM bars_w GROUP BY 1), "
    "gm AS (SELECT count(*) + 0.000001 AS a, sum(v) AS b, sum(v * v) + 0.000001 AS c FROM ld), "
    "pj AS (SELECT dt, sum(ret) AS s0, sum(ret * v) AS s1 FROM rt JOIN ld USING (symbol) GROUP BY 1)"
)


@query("xs06_residualise", ("bars_w",), "SELECT symbol, dt, round(ret - ((c * s0 - b * s1) + (a * s1 - b * s0) * v) / (a * c - b * b), 6) + 0.0 AS residual FROM rt JOIN ld USING (symbol) JOIN pj USING (dt) CROSS JOIN gm", FACTORS)
def _(spark, d):
    b = P.bars_w(spark, d).withColumn("ret", O.pct_change("close")).where("ret IS NOT NULL")
    return rounded(X.residualise(b.select(*K, "ret"), factor_table(spark, d)), *K)


AREA = f"w4 AS (SELECT symbol, dt, ret AS x, lag(ret) {AT} AS p FROM (SELECT symbol, dt, round((close / lag(close) {AT} - 1) * 10, 6) AS ret FROM bars_w)), area AS (SELECT a.symbol AS i, b.symbol AS j, sum(a.x * b.p - b.x * a.p) / 2 AS area, count(*) AS n FROM w4 a JOIN w4 b ON a.dt = b.dt AND a.symbol < b.symbol WHERE a.p IS NOT NULL AND b.p IS NOT NULL GROUP BY 1, 2)"


def returns10(spark, d):
    return P.bars_w(spark, d).select(*K, F.round(O.pct_change("close") * 10, 6).alias("x"))


@query("xs07_levy_area", ("bars_w",), "SELECT i, j, round(area, 6) + 0.0 AS area FROM area", AREA)
def _(spark, d):
    return rounded(X.levy_area(returns10(spark, d), "x").select("i", "j", "area"), "i", "j")


EDGES = "dist AS (SELECT a.i, b.i AS j, sum((a.v - b.v) * (a.v - b.v)) AS d FROM full_area a JOIN full_area b ON a.j = b.j AND a.i < b.i GROUP BY 1, 2), full_area AS (SELECT i, j, area AS v FROM area UNION ALL SELECT j, i, -area FROM area), edges0 AS (SELECT i, j, 1 / (1 + d / (SELECT max(d) FROM dist)) AS w FROM dist), edges AS (SELECT i AS src, j AS dst, w FROM edges0 UNION ALL SELECT j, i, w FROM edges0), degree AS (SELECT src, sum(w) AS deg FROM edges GROUP BY 1), norm AS (SELECT e.src, e.dst, e.w / sqrt(a.deg * b.deg) AS w FROM edges e JOIN degree a ON a.src = e.src JOIN degree b ON b.src = e.dst)"
FULL = EDGES.split(", full_area AS")
ORDERED = "full_area AS" + FULL[1].split(", edges0")[0] + ", " + FULL[0] + ", edges0" + FULL[1].split(", edges0", 1)[1]


def edge_table(spark, d):
    return X.pair_similarity(X.levy_area(returns10(spark, d), "x"))


@query("xs10_pair_similarity", ("bars_w",), "SELECT src, dst, round(w, 6) AS w FROM edges", AREA + ", " + ORDERED)
def _(spark, d):
    return rounded(edge_table(spark, d), "src", "dst")


@query("xs08_degree_norm", ("bars_w",), "SELECT src, dst, round(w, 6) AS w FROM norm", AREA + ", " + ORDERED)
def _(spark, d):
    return rounded(X.degree_norm(edge_table(spark, d)), "src", "dst")


@query("xs09_propagate", ("bars_w",), "SELECT dst AS symbol, dt, round(sum(w * x), 6) + 0.0 AS x FROM norm JOIN w4 ON src = symbol WHERE x IS NOT NULL GROUP BY 1, 2", AREA + ", " + ORDERED)
def _(spark, d):
    return rounded(X.propagate(returns10(spark, d).where("x IS NOT NULL"), X.degree_norm(edge_table(spark, d)), "x"), *K)


SPANS, EVERY = (26, 52, 104), 26
TRAILING = (
    "days AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS t FROM (SELECT DISTINCT dt FROM bars_w)), "
    f"refits AS (SELECT t, dt AS refit FROM days WHERE t >= {max(SPANS)} AND (t - {max(SPANS)}) % {EVERY} = 0), "
    "moves AS (SELECT a.dt, a.symbol AS i, b.symbol AS j, a.x * b.p - b.x * a.p AS a FROM w4 a JOIN w4 b ON a.dt = b.dt AND a.symbol < b.symbol WHERE a.p IS NOT NULL AND b.p IS NOT NULL AND a.x IS NOT NULL AND b.x IS NOT NULL), "
    f"held AS (SELECT refit, span, i, j, sum(a) / 2 AS area FROM refits r CROSS JOIN (SELECT unnest({list(SPANS)}) AS span) s JOIN days d ON d.t >= r.t - s.span AND d.t < r.t JOIN moves m ON m.dt = d.dt GROUP BY 1, 2, 3, 4 HAVING count(*) / span >= 0.7), "
    "both_ways AS (SELECT refit, span, i, j, area AS v FROM held UNION ALL SELECT refit, span, j, i, -area FROM held), "
    "far AS (SELECT a.refit, a.span, a.i, b.i AS j, sum((a.v - b.v) * (a.v - b.v)) AS d FROM both_ways a JOIN both_ways b ON a.refit = b.refit AND a.span = b.span AND a.j = b.j AND a.i < b.i GROUP BY 1, 2, 3, 4), "
    "near AS (SELECT refit, i, j, avg(1 / (1 + d / most)) AS w FROM (SELECT *, max(d) OVER (PARTITION BY refit, span) AS most FROM far) GROUP BY 1, 2, 3), "
    "ens_edges AS (SELECT refit, i AS src, j AS dst, w FROM near UNION ALL SELECT refit, j, i, w FROM near)"
)


def trailing_edges(spark, d):
    """Areas are read three times and edges twice, so both are written."""
    return save(X.ensemble_edges(save(X.trailing_areas(returns10(spark, d), "x", list(SPANS), EVERY), "areas")), "edges")


@query("xs11_ensemble_edges", ("bars_w",), "SELECT refit, src, dst, round(w, 6) AS w FROM ens_edges", AREA + ", " + TRAILING)
def _(spark, d):
    return rounded(trailing_edges(spark, d), "refit", "src", "dst")
