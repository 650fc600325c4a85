"""Scaling, blending and gating of scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import cap, clip, ratio, sigmoid
from strandmill.operators import recursive as R
from strandmill.operators import windows as O


def blended_vol(df: DataFrame, dp: str, out: str = "vol", *, span: int = 32, window: int = 2560, share: float = 0.7, least: tuple[int, int] = (16, 256)) -> DataFrame:
    """share * exponentially weighted and the rest rolling deviation of changes; 0 counts as missing, gaps keep the last."""
    d = R.ewm_std(df, dp, "_fast", span=span, least=least[0]).withColumn("_slow", O.roll_std(dp, window, least[1]))
    mixed = F.coalesce(share * F.col("_fast") + (1 - share) * F.col("_slow"), F.col("_fast"))
    d = d.withColumn(out, F.when(mixed > 0, mixed))
    return d.withColumn(out, F.last(out, ignorenulls=True).over(O.w(None))).drop("_fast", "_slow")


def vol_scale(x: str | Column, vol: str) -> Column:
    return F.coalesce(ratio(F.col(x) if isinstance(x, str) else x, F.col(vol)), F.lit(0.0))


def forecast_scalar(x: str, n: int, least: int, target: float = 10.0) -> Column:
    """target by the mean absolute value of the last n rows."""
    return ratio(F.lit(target), O.roll_mean(F.abs(F.col(x)), n, least))


def to_forecast(x: str, n: int, least: int, most: float = 20.0) -> Column:
    return cap(F.col(x) * forecast_scalar(x, n, least), most)


def blend(weights: dict[str, float], most: float = 20.0) -> Column:
    return cap(reduce(lambda a, b: a + b, (F.col(c) * v for c, v in weights.items())), most)


def conviction(x: str, n: int, least: int) -> Column:
    """|x| by its rolling deviation, at most 1."""
    return clip(ratio(F.abs(F.col(x)), O.roll_std(x, n, least)), 0.0, 1.0)


def fdm(corr: DataFrame, weights: dict[str, float], mode: str = "plain", keys: tuple[str, ...] = ("dt",)) -> DataFrame:
    """(*keys, mult): 1 / sqrt(w' R w) of correlations (i, j, rho), i < j, between 1 and the root of their number.

    mode: shrink halves all off the diagonal; mean sets them to their mean. An unknown correlation gives 1.
    """
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    own = sum(v * v for v in weights.values())
    rho = F.col("rho") * (0.5 if mode == "shrink" else 1.0)
    pair = w[F.col("i")] * w[F.col("j")]
    cross = F.avg(rho) * F.sum(pair) if mode == "mean" else F.sum(pair * rho)
    var = F.greatest(own + 2 * cross, F.lit(0.01))
    whole = F.count("rho") == len(weights) * (len(weights) - 1) // 2
    return corr.groupBy(*keys).agg(F.when(whole, clip(1 / F.sqrt(var), 1.0, math.sqrt(len(weights)))).otherwise(1.0).alias("mult"))


def multiplier(weights: dict[str, float | Column], rho: dict[tuple[str, str], str], whole: Column, mode: str | Column = "plain", most: float | Column | None = None) -> Column:
    """1 / sqrt(w' R w) from columns of correlations by pair, between 1 and ``most``; 1 where one is unknown or ``whole`` is false.

    The same as fdm(), in one row. mode: shrink halves all off the diagonal; mean sets them to their mean.
    """
    w = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in weights.items()}
    mode = mode if isinstance(mode, Column) else F.lit(mode)
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    all_ = add(F.col(c) for c in rho.values())
    cross = add(w[i] * w[j] * F.col(c) for (i, j), c in rho.items())
    mean = all_ / len(rho) * add(w[i] * w[j] for i, j in rho)
    cross = F.when(mode == "shrink", 0.5 * cross).when(mode == "mean", mean).otherwise(cross)
    var = F.greatest(add(v * v for v in w.values()) + 2 * cross, F.lit(0.01))
    top = most if isinstance(most, Column) else F.lit(float(most or math.sqrt(len(weights))))
    return F.when(whole & all_.isNotNull(), F.greatest(F.least(1 / F.sqrt(var), top), F.lit(1.0))).otherwise(1.0)


def smooth(df: DataFrame, x: str, out: str, halflife: float | None = None, span: float | None = None) -> DataFrame:
    if halflife is None and span is None:
        return df.withColumn(out, F.col(x))
    return R.ewm_mean(df, x, out, **({"halflife": halflife} if halflife is not None else {"span": span}))


def vol_gate(vol: str, n: int, least: int, floor: float = 0.5, steepness: float = 5.0, trigger: float = 1.5) -> Column:
    """1 - (1 - floor) * logistic of how far volatility is above its rolling mean."""
    return 1 - (1 - floor) * F.coalesce(sigmoid(steepness * (ratio(F.col(vol), O.roll_mean(vol, n, least)) - trigger)), F.lit(0.0))


def drawdown_gate(price: str, k: int, floor: float = 0.5, steepness: float = 20.0, trigger: float = 0.1) -> Column:
    """Falls with yesterday's loss over k rows."""
    over = W.partitionBy("symbol").orderBy("dt")
    loss = 1 - ratio(F.lag(price, 1).over(over), F.lag(price, k + 1).over(over))
    return 1 - (1 - floor) * F.coalesce(sigmoid(steepness * (loss - trigger)), F.lit(0.0))


def regime_multiplier(df: DataFrame, x: str, out: str, span: int = 5, least: int = 10) -> DataFrame:
    """1, 0.75 or 0.5 by how far x is above its median so far, smoothed and clipped."""
    base = O.expanding_median(x, least)
    far = ratio(F.col(x), base)
    step = F.when(far > 1.5, 0.5).when(far > 1.2, 0.75).otherwise(1.0)
    d = R.ewm_mean(df.withColumn("_step", step), "_step", out, span=span).drop("_step")
    return d.withColumn(out, clip(F.col(out), 0.5, 1.0))


def response(x: Column, rate: float = 1.0) -> Column:
    """c x exp(-rate^2 x^2 / 2), odd and damped, with c such that it has unit variance on a standard normal x."""
    c = (1 + 2 * rate * rate) ** 0.75
    return c * x * F.exp(-0.5 * rate * rate * x * x)


def liquidity_weight(x: str, adv: str) -> Column:
    """x by the log of volume, against the mean over symbols of the date."""
    level = F.log1p(F.col(adv))
    return F.col(x) * ratio(level, F.avg(level).over(W.partitionBy("dt")))
