"""From scores to positions, profit and loss, net asset value and performance, by variant; on a fixed capital base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import clip, ratio
from strandmill.operators import joins as J
from strandmill.operators import recursive as R
from strandmill.operators.cross_section import MULTIPLIERS, interpolate

KEYS = ("variant", "symbol", "dt")
CAPITAL, VOL_TARGET = 1e8, 0.20


def series() -> W:
    return W.partitionBy("variant", "symbol").orderBy("dt")


def is_active(forecast: Column) -> Column:
    return forecast.isNotNull() & F.col("vol").isNotNull() & F.col("fx").isNotNull() & (forecast != 0)


def target_size(forecast: Column, n: Column, *, capital: float = CAPITAL, root_year: float = 16.0, least_vol: float = 1.0) -> Column:
    """The target of a row of n active ones at its date; null where it isn't active, or its volatility in money is below least_vol. Needs vol, fx, pointsize."""
    money = F.col("vol") * F.col("pointsize") * F.col("fx")
    size = forecast / 10 * capital * VOL_TARGET * interpolate(n, MULTIPLIERS) / n / (money * root_year)
    return F.when(is_active(forecast) & (money >= least_vol), size)


def target_position(df: DataFrame, *, capital: float = CAPITAL, root_year: float = 16.0, least_vol: float = 1.0) -> DataFrame:
    """Adds target: forecast / 10 of the capital's risk, by weight and multiplier of the date's active symbols, over a
    contract's risk. Where volatility in money is below least_vol, the last target holds.

    Needs variant, symbol, dt, forecast, vol, fx, pointsize.
    """
    active = is_active(F.col("forecast"))
    n = F.sum(active.cast("int")).over(W.partitionBy("variant", "dt"))
    d = df.withColumn("target", target_size(F.col("forecast"), n, capital=capital, root_year=root_year, least_vol=least_vol))
    return d.withColumn("target", F.last("target", ignorenulls=True).over(series().rowsBetween(W.unboundedPreceding, 0)))


def held_position(df: DataFrame, share: float = 0.1, least: float = 0.5) -> DataFrame:
    return R.deadband(df, "target", "position", share=share, least=least, by=("variant", "symbol"))


def daily_pnl(df: DataFrame, cost_mult: float | Column = 1.0) -> DataFrame:
    """Adds trade, commission and pnl: the old position from close to open, the new one from open to close, less half a
    round trip a contract traded. A row without prices makes nothing.
    """
    at = series()
    d = df.withColumn("prior", F.coalesce(F.lag("position").over(at), F.lit(0.0))).withColumn("prior_close", F.lag("close").over(at))
    return booked(d, cost_mult)


def booked(df: DataFrame, cost_mult: float | Column = 1.0) -> DataFrame:
    """daily_pnl() of rows that have the position and close before, as prior and prior_close."""
    point = F.col("pointsize") * F.col("fx")
    trade = F.col("position") - F.col("prior")
    cost = F.abs(trade) * F.col("cost_rt") / 2 * cost_mult * F.col("fx")
    move = F.col("prior") * F.coalesce(F.col("open") - F.col("prior_close"), F.lit(0.0)) + F.col("position") * (F.col("close") - F.col("open"))
    whole = F.col("open").isNotNull() & F.col("close").isNotNull()
    return df.withColumn("trade", trade).withColumn("commission", F.when(whole, cost).otherwise(0.0)).withColumn("pnl", F.when(whole, move * point - cost).otherwise(0.0)).drop("prior", "prior_close")


def portfolio_daily(df: DataFrame, rates: DataFrame | None = None, capital: float = CAPITAL) -> DataFrame:
    """(variant, dt): pnl, commission, trades, and the cash yield at rates (dt, rate) as of the date."""
    d = df.groupBy("variant", "dt").agg(F.sum("pnl").alias("pnl"), F.sum("commission").alias("commission"), F.sum((F.col("trade") != 0).cast("long")).alias("trades"))
    if rates is None:
        return d.withColumn("rate", F.lit(0.0)).withColumn("cash", F.lit(0.0))
    days = J.asof(d.select("dt").distinct(), rates, "rate")
    return d.join(days.select("dt", F.coalesce("rate", F.lit(0.0)).alias("rate")), "dt").withColumn("cash", F.col("rate") * capital)


def nav(daily: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """Adds nav, ret on the nav before, and excess over the cash rate."""
    at = W.partitionBy("variant").orderBy("dt")
    d = daily.withColumn("nav", capital + F.sum(F.col("pnl") + F.col("cash")).over(at.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("ret", F.col("nav") / F.coalesce(F.lag("nav").over(at), F.lit(capital)) - 1)
    return d.withColumn("excess", F.col("ret") - F.col("rate"))


def tearsheet(returns: DataFrame, year: float, by: str = "variant", ddof: int = 0) -> DataFrame:
    """Arithmetic return, volatility, Sharpe ratio of the excess, growth rate, largest drawdown and Calmar ratio, by variant.

    Where the rows have them, also trades a year, and all costs and cash. Needs dt, ret and optionally excess; ddof 0 or 1
    chooses the deviation.
    """
    more = {"trades": (F.sum("trades") * year / F.count("*")).alias("trades_year"), "commission": F.sum("commission").alias("costs"), "cash": F.sum("cash").alias("cash")}
    extra = [x for c, x in more.items() if c in returns.columns]
    d = returns if "excess" in returns.columns else returns.withColumn("excess", F.col("ret"))
    at = W.partitionBy(by).orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_log", F.sum(F.log1p("ret")).over(at)).withColumn("_peak", F.greatest(F.max("_log").over(at), F.lit(0.0)))
    dev = F.stddev_pop if ddof == 0 else F.stddev_samp
    t = d.groupBy(by).agg(F.count("*").alias("n"), (F.avg("ret") * year).alias("ann_ret"), (dev("ret") * year**0.5).alias("ann_vol"), ratio(F.avg("excess") * year**0.5, dev("ret")).alias("sharpe"), (F.exp(F.sum(F.log1p("ret")) * year / F.count("*")) - 1).alias("cagr"), (1 - F.exp(F.min(F.col("_log") - F.col("_peak")))).alias("max_dd"), *extra)
    first = [by, "n", "ann_ret", "ann_vol", "sharpe", "cagr", "max_dd"]
    return t.select(*first, ratio(F.col("cagr"), F.col("max_dd")).alias("calmar"), *(c for c in t.columns if c not in first))


def implied_exposure(df: DataFrame) -> DataFrame:
    """Adds exposure: pnl by the price's move; null for moves below 1e-6, within 1e10."""
    return df.withColumn("exposure", F.when(F.abs("dp") >= 1e-6, clip(F.col("pnl") / F.col("dp"), -1e10, 1e10)))


def replay(exposure: DataFrame, paths: DataFrame, capital: float, year: float) -> DataFrame:
    """Metrics by path of exposures (symbol, step, exposure) on other price moves (path, symbol, step, dp)."""
    d = paths.join(exposure, ["symbol", "step"]).groupBy(F.col("path").alias("variant"), F.col("step").alias("dt")).agg(F.sum(F.coalesce(F.col("exposure") * F.col("dp"), F.lit(0.0))).alias("pnl"))
    return tearsheet(nav(d.withColumn("cash", F.lit(0.0)).withColumn("rate", F.lit(0.0)), capital).drop("cash"), year)


def adv(contracts: DataFrame, since: Column | None = None) -> DataFrame:
    """Average volume by symbol of each date's most traded contract."""
    d = contracts if since is None else contracts.where(F.col("dt") >= since)
    return d.groupBy("symbol", "dt").agg(F.max("volume").alias("volume")).where("volume > 0").groupBy("symbol").agg(F.avg("volume").alias("adv"))


def capacity(trades: DataFrame, volumes: DataFrame, returns: DataFrame, grid: DataFrame, year: float, rate: float = 0.1) -> DataFrame:
    """By assets under management: yearly drag of impact in proportion to the root of participation, and net Sharpe.

    trades: (symbol, traded: mean contracts a day at scale 1, cost: money a contract); returns: (ret); grid: (aum, scale).
    """
    d = J.cross_params(trades.join(volumes, "symbol"), grid)
    part = ratio(F.col("traded") * F.col("scale"), F.col("adv"))
    drag = d.groupBy("aum", "scale").agg((F.sum(F.col("traded") * F.col("scale") * F.col("cost") * rate * F.sqrt(part)) * year).alias("money")).withColumn("drag", F.col("money") / F.col("aum"))
    m = returns.agg((F.avg("ret") * year).alias("mean"), (F.stddev_samp("ret") * year**0.5).alias("vol"))
    return drag.crossJoin(m).select("aum", "drag", ratio(F.col("mean") - F.col("drag"), F.col("vol")).alias("net_sharpe"))


def crossing(df: DataFrame, x: str, y: str, level: float, by: str) -> DataFrame:
    """(by, at): the first x at which y falls to the level, by linear interpolation."""
    over = W.partitionBy(by).orderBy(x)
    d = df.withColumn("_x", F.lead(x).over(over)).withColumn("_y", F.lead(y).over(over)).where((F.col(y) >= level) & (F.col("_y") < level))
    d = d.withColumn("at", F.col(x) + (F.col("_x") - F.col(x)) * ratio(F.col(y) - level, F.col(y) - F.col("_y")))
    return d.groupBy(by).agg(F.min("at").alias("at"))


def capacity_by_symbol(trades: DataFrame, volumes: DataFrame, aum: float, share: float = 0.01) -> DataFrame:
    """Assets at which a symbol's trading reaches the share of its volume."""
    return trades.join(volumes, "symbol").select("symbol", (aum * ratio(share * F.col("adv"), F.col("traded"))).alias("most"))


def top_k(df: DataFrame, x: str, k: int, ties: str) -> DataFrame:
    """The k rows of the smallest x."""
    return df.orderBy(F.col(x).asc_nulls_last(), ties).limit(k)


def cost_stress(returns: DataFrame, cost: float, target: float, n: int, year: float) -> DataFrame:
    """Returns less a cost that grows with volatility over target, between 1 and 10 times."""
    over = W.partitionBy("variant").orderBy("dt").rowsBetween(-(n - 1), 0)
    vol = F.stddev_samp("ret").over(over) * year**0.5
    extra = F.coalesce(clip(ratio(vol, F.lit(target)), 1.0, 10.0), F.lit(1.0))
    return returns.withColumn("ret", F.col("ret") - cost * (extra - 1))
