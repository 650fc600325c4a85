"""Named signals: each takes bars with dp (change), ret and vol, and returns (symbol, dt, raw)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions.scalars import cap, ramp, ratio
from strandmill.operators import blend as B
from strandmill.operators import cross_section as X
from strandmill.operators import joins as J
from strandmill.operators import recursive as R
from strandmill.operators import windows as O

KEYS = ("symbol", "dt")


def prepare(bars: DataFrame, span: int = 8, window: int = 52, least: tuple[int, int] = (8, 20)) -> DataFrame:
    """Adds dp, ret and vol."""
    d = bars.withColumn("dp", O.diff("close")).withColumn("ret", O.pct_change("close"))
    return B.blended_vol(d, "dp", span=span, window=window, least=least)


def raw(df: DataFrame, x: Column) -> DataFrame:
    return df.select(*KEYS, x.alias("raw"))


def direction(k: int, x: str = "close", zero: float = 1.0) -> Column:
    """Sign of the change over k rows; ``zero`` where there is none."""
    move = O.diff(x, k)
    return F.when(move > 0, 1.0).when(move < 0, -1.0).when(move == 0, zero)


def crossover(bars: DataFrame, fast: int, slow: int, x: str = "close", by_vol: bool = True) -> DataFrame:
    return raw(crossovers(bars, ((fast, slow),), x, by_vol), F.col(f"cross{fast}_{slow}"))


def crossovers(bars: DataFrame, speeds: tuple, x: str = "close", by_vol: bool = True) -> DataFrame:
    """Adds cross<fast>_<slow> for each pair of spans; every span is made once, all in the same windows."""
    spans = sorted({s for pair in speeds for s in pair})
    d = R.ewm_means(bars, {f"_m{s}": (x, R.alpha_of(span=s)) for s in spans})
    gap = lambda f, s: F.col(f"_m{f}") - F.col(f"_m{s}")
    return d.withColumns({f"cross{f}_{s}": ratio(gap(f, s), F.col("vol")) if by_vol else gap(f, s) for f, s in speeds}).drop(*(f"_m{s}" for s in spans))


def add_ensemble(bars: DataFrame, out: str, speeds: tuple, n: int, least: int, gain: float = 1.1, x: str = "close", by_vol: bool = True) -> DataFrame:
    """Adds the mean of the capped forecasts of crossovers at several speeds, times gain."""
    names = [f"cross{f}_{s}" for f, s in speeds]
    d = crossovers(bars, speeds, x, by_vol)
    d = d.withColumns({c: B.to_forecast(c, n, least) for c in names})
    return d.withColumn(out, reduce(lambda a, b: a + b, map(F.col, names)) * (gain / len(names))).drop(*names)


def ensemble(bars: DataFrame, speeds: tuple, n: int, least: int, gain: float = 1.1) -> DataFrame:
    return raw(add_ensemble(bars, "ens", speeds, n, least, gain), F.col("ens"))


def normalized_momentum(bars: DataFrame, speeds: tuple, n: int, least: int) -> DataFrame:
    d = bars.withColumn("np", O.norm_price("dp", "vol"))
    return raw(add_ensemble(d, "ens", speeds, n, least, 1.0, "np", by_vol=False), F.col("ens"))


def anchored_momentum(bars: DataFrame, spans: tuple, year: int) -> DataFrame:
    return raw(bars, reduce(lambda a, b: a + b, (O.pct_change("close", h) / (h / year) ** 0.5 for h in spans)) / len(spans))


def changed(df: DataFrame, k: int) -> DataFrame:
    """Change of a signal over k rows: acceleration, carry momentum."""
    return raw(df, O.diff("raw", k))


def breakout(bars: DataFrame, n: int) -> DataFrame:
    return raw(bars, O.channel_pos("close", n) * 20)


def xs_momentum(bars: DataFrame, k: int) -> DataFrame:
    d = bars.withColumn("np", O.norm_price("dp", "vol")).withColumn("move", O.diff("np", k))
    return raw(d, X.xs_z("move"))


def carry(bars: DataFrame, chain: DataFrame) -> DataFrame:
    return raw(bars.join(chain, list(KEYS)), ratio(ratio(F.col("c1") - F.col("c2"), F.col("years12")), F.col("vol")))


def relative(df: DataFrame) -> DataFrame:
    """z-score of a signal across symbols."""
    return raw(df, X.xs_z("raw"))


def curvature(bars: DataFrame, chain: DataFrame, span: int) -> DataFrame:
    d = bars.join(chain, list(KEYS)).withColumn("bend", ratio(F.col("c1") - 2 * F.col("c2") + F.col("c3"), F.col("years13") * F.col("vol")))
    return raw(R.ewm_mean(d, "bend", "smooth", span=span), F.col("smooth"))


def basis_momentum(chain: DataFrame, n: int, least: int) -> DataFrame:
    d = chain.withColumn("l1", F.log("c1")).withColumn("l2", F.log("c2"))
    d = d.withColumn("gap", O.same_contract_diff("l1", "e1") - O.same_contract_diff("l2", "e1"))
    return raw(d, ratio(O.roll_sum("gap", n, least), O.roll_std("gap", n, least) * float(n) ** 0.5))


def skew(bars: DataFrame, n: int, least: int) -> DataFrame:
    return raw(bars, -O.roll_skew("dp", n, least))


def skew_xs(bars: DataFrame, dims: DataFrame, n: int, least: int) -> DataFrame:
    d = bars.withColumn("skew", O.roll_skew("dp", n, least)).join(dims.select("symbol", "asset_class"), "symbol")
    return raw(d, -X.group_demean("skew", "asset_class"))


def kurtosis(bars: DataFrame, n: int, least: int) -> DataFrame:
    return raw(bars, -O.roll_kurt("dp", n, least))


def semivariance(bars: DataFrame, n: int) -> DataFrame:
    d = bars.withColumn("up", F.when(F.col("ret") > 0, F.col("ret") * F.col("ret")).when(F.col("ret").isNotNull(), 0.0)).withColumn("dn", F.when(F.col("ret") < 0, F.col("ret") * F.col("ret")).when(F.col("ret").isNotNull(), 0.0))
    a, b = O.roll_sum("up", n), O.roll_sum("dn", n)
    return raw(d, ratio(a - b, a + b))


def tail_asymmetry(bars: DataFrame) -> DataFrame:
    return raw(bars, ratio(F.col("high"), F.col("close")) + ratio(F.col("low"), F.col("close")) - 2)


def add_vol_of_vol(bars: DataFrame, outs: dict[str, tuple[int, int, int, int]]) -> DataFrame:
    """Adds, by name, minus the excess of volatility's own volatility in the direction of the price: (short, long, base, k); k of 0 for no direction."""
    d = bars.withColumns({f"_s{x}": O.roll_std("ret", x) for x in {v[0] for v in outs.values()}})
    d = d.withColumns({f"_v{n}": O.roll_std(f"_s{s}", long, s) for n, (s, long, _, _) in outs.items()})
    d = d.withColumns({f"_u{n}": O.roll_mean(f"_v{n}", base, long) for n, (_, long, base, _) in outs.items()})
    d = d.withColumns({n: -(ratio(F.col(f"_v{n}"), F.col(f"_u{n}")) - 1) * (direction(k) if k else F.lit(1.0)) for n, (*_, k) in outs.items()})
    return d.drop(*(f"_s{v[0]}" for v in outs.values()), *(f"_v{n}" for n in outs), *(f"_u{n}" for n in outs))


def vol_of_vol(bars: DataFrame, short: int, long: int, base: int, k: int) -> DataFrame:
    return raw(add_vol_of_vol(bars, {"vov": (short, long, base, k)}), F.col("vov"))


def vol_regime(bars: DataFrame, span: int, n: int, least: int, k: int) -> DataFrame:
    d = R.ewm_std(bars, "ret", "fast", span=span, least=2).withColumn("slow", O.roll_std("ret", n, least))
    return raw(d, -(ratio(F.col("fast"), F.col("slow")) - 1) * direction(k))


def activity_momentum(bars: DataFrame, x: str, n: int, span: int, k: int) -> DataFrame:
    """Of volume or open interest: smoothed excess over the mean, in the direction of the price."""
    d = bars.withColumn("excess", ratio(F.col(x), O.roll_mean(x, n)) - 1)
    return raw(R.ewm_mean(d, "excess", "smooth", span=span), F.col("smooth") * direction(k))


def oi_imbalance(totals: DataFrame, smooth: int, k: int, n: int, least: int) -> DataFrame:
    d = totals.withColumn("level", O.roll_mean("open_interest", smooth))
    d = d.withColumn("growth", F.log(ratio(F.col("level"), O.shift("level", k))))
    return raw(d, O.roll_z("growth", n, least))


def amihud(bars: DataFrame, n: int) -> DataFrame:
    d = bars.withColumn("price_impact", F.abs("ret") / F.greatest(F.col("volume"), F.lit(1.0)))
    return raw(d.withColumn("mean", O.roll_mean("price_impact", n)), X.xs_z("mean"))


def divergence(bars: DataFrame, n: int) -> DataFrame:
    return raw(bars.withColumn("dv", O.diff("volume")), O.roll_corr("dp", "dv", n))


def range_compression(bars: DataFrame, short: int, long: int, k: int) -> DataFrame:
    d = bars.withColumn("range", F.col("high") - F.col("low"))
    return raw(d, (1 - ratio(O.roll_mean("range", short), O.roll_mean("range", long))) * direction(k))


def intraday(bars: DataFrame, span: int) -> DataFrame:
    d = bars.withColumn("place", ratio(F.col("close") - F.col("open"), F.col("high") - F.col("low")))
    return raw(R.ewm_mean(d, "place", "smooth", span=span), F.col("smooth"))


def overnight(bars: DataFrame, span: int) -> DataFrame:
    before = F.lag("close").over(O.series())
    d = bars.withColumn("gap", ratio(F.col("open") - before, F.abs(before)))
    return raw(R.ewm_mean(d, "gap", "smooth", span=span), F.col("smooth"))


def fast_reversion(bars: DataFrame, span: int) -> DataFrame:
    d = R.ewm_mean(bars, "close", "mean", span=span)
    return raw(d, -ratio(F.col("close") - F.col("mean"), F.col("vol")))


def long_reversal(bars: DataFrame, k: int, n: int, least: int) -> DataFrame:
    d = bars.withColumn("move", F.log(ratio(F.col("close"), F.lag("close", k).over(O.series()))))
    return raw(d, -ratio(F.col("move"), O.roll_std("move", n, least)))


def value(bars: DataFrame, dims: DataFrame, n: int, least: int) -> DataFrame:
    d = bars.withColumn("np", O.norm_price("dp", "vol")).join(dims.select("symbol", "asset_class"), "symbol")
    d = d.withColumn("rel", X.group_demean("np", "asset_class"))
    return raw(d, -(F.col("rel") - O.roll_mean("rel", n, least)))


def dispersion_timing(bars: DataFrame, k: int, n: int, least: int) -> DataFrame:
    d = bars.withColumn("side", direction(k))
    return raw(d.join(X.dispersion_z(bars.where("ret IS NOT NULL"), "ret", n, least), "dt"), F.col("side") * F.col("z"))


def seasonality(bars: DataFrame, scores: DataFrame) -> DataFrame:
    """Monthly seasonal scores on each bar of the months that follow their first day."""
    return raw(J.asof(bars.select(*KEYS), scores, "score", by="symbol"), F.col("score"))


def turn_of_month(bars: DataFrame) -> DataFrame:
    return raw(O.turn_of_month(bars, 1, 1), F.col("flag").cast("double") * 10)


def event_drift(bars: DataFrame, events: DataFrame, dims: DataFrame, classes: list) -> DataFrame:
    d = bars.select(*KEYS).join(J.event_window(bars, events), "dt").withColumn("x", F.col("flag").cast("double") * 10)
    return raw(J.restrict(d, dims, "asset_class", classes, "x"), F.col("x"))


def positioning_fade(bars: DataFrame, dims: DataFrame, positions: DataFrame, n: int, least: int) -> DataFrame:
    """Against extreme net positions, known one row later."""
    p = positions.withColumnRenamed("ccy", "symbol").withColumn("net", ratio(F.col("longs") - F.col("shorts"), F.col("open_interest")))
    z = p.select("symbol", "dt", (-O.roll_z("net", n, least)).alias("z")).withColumnRenamed("symbol", "ccy")
    d = bars.select(*KEYS).join(dims.select("symbol", "ccy"), "symbol")
    days = J.asof(d.select("ccy", "dt").distinct(), z, "z", by="ccy")
    return raw(d.join(days, ["ccy", "dt"]).withColumn("z", F.lag("z").over(O.series())), F.col("z"))


def inflation_tilt(bars: DataFrame, index: DataFrame, dims: DataFrame, n: int, longs: list) -> DataFrame:
    """Quintile of an index's lagged three-month change, for or against by class. The index is one series."""
    m = index.withColumn("symbol", F.lit("index")).withColumn("move", F.log(ratio(F.lag("rate", 1).over(O.series()), F.lag("rate", 4).over(O.series()))))
    m = m.select("dt", O.roll_quintile("move", n).alias("score"))
    days = J.asof(bars.select("dt").distinct(), m, "score")
    d = bars.select(*KEYS).join(days, "dt").join(dims.select("symbol", "asset_class"), "symbol")
    return raw(d, F.when(F.col("asset_class").isin(*longs), F.col("score")).otherwise(-F.col("score")))


def lead_lag(bars: DataFrame, pairs: DataFrame, fast: int, slow: int, n: int, least: int, lag: int) -> DataFrame:
    d = R.ewm_mean(R.ewm_mean(bars, "close", "quick", alpha=2 / (fast + 1), adjust=False), "close", "slow", alpha=2 / (slow + 1), adjust=False)
    d = d.withColumn("gap", F.col("quick") - F.col("slow")).withColumn("z", O.roll_z("gap", n, least))
    return raw(J.lead_lag(d.select(*KEYS, "z"), pairs, "z", lag), F.col("z"))


def hurst_trend(bars: DataFrame, speeds: tuple, n: int, least: int, window: int, step: int, chunks: tuple) -> DataFrame:
    d = add_ensemble(bars, "ens", speeds, n, least)
    h = O.roll_hurst(d.where("ret IS NOT NULL"), "ret", window, step, chunks)
    return raw(h, F.col("ens") * ramp(F.col("hurst"), 0.45, 0.55))


def vol_managed(bars: DataFrame, speeds: tuple, n: int, least: int, short: int, long: int) -> DataFrame:
    return raw(add_ensemble(bars, "ens", speeds, n, least), F.col("ens") * O.variance_ratio_scale("ret", short, long, 0.5, 2.0))


#: How much slower a network oscillator's second mean is, and its decay is 1 / (2 k).
SLOWER = 4


def network(bars: DataFrame, edges: DataFrame, ks: tuple) -> DataFrame:
    """Mean response to neighbours' oscillators at several speeds, by edges (refit, src, dst, w) as of each date.

    An oscillator is the difference of two recursive means of the price by volatility. Before the first refit, a series has
    itself for its only neighbour.
    """
    outs = {f"_{side}{k}": ("np", 1 / (2 * k * more)) for k in ks for side, more in (("q", 1), ("s", SLOWER))}
    d = R.ewm_means(bars.withColumn("np", O.norm_price("dp", "vol")), outs, adjust=False)
    speeds = F.array(*(F.struct(F.lit(k).alias("s"), (F.col(f"_q{k}") - F.col(f"_s{k}")).alias("x")) for k in ks))
    refits = edges.select(F.col("refit").alias("dt"), "refit").distinct()
    days = J.asof(bars.select("dt").distinct(), refits, "refit")
    rows = d.select(*KEYS, F.inline(speeds)).join(days, "dt")
    near = rows.where("refit IS NOT NULL").join(edges, (F.col("symbol") == F.col("src")) & (rows["refit"] == edges["refit"]))
    moved = near.groupBy(F.col("dst").alias("symbol"), "dt", "s").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    moved = moved.unionByName(rows.where("refit IS NULL").select("symbol", "dt", "s", "x"))
    return raw(moved.groupBy(*KEYS).agg(F.avg(B.response(F.col("x"))).alias("m")), F.col("m"))
