"""Rolling, expanding and calendar features per series, on row frames over (by, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import clip, ratio

BY, ORDER = "symbol", "dt"


def w(n: int | None = None, by: str | tuple = BY, order: str = ORDER) -> WindowSpec:
    """The last n rows of a series up to the current one; all so far without n."""
    base = series(by, order)
    return base.rowsBetween(W.unboundedPreceding if n is None else -(n - 1), 0)


def series(by: str | tuple = BY, order: str = ORDER) -> WindowSpec:
    return W.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(order)


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def enough(x: Column, over: WindowSpec, least: int, value: Column) -> Column:
    """value where the frame has ``least`` rows that aren't null."""
    return F.when(F.count(x).over(over) >= least, value)


def diff(x: str | Column, k: int = 1, **s) -> Column:
    x = _col(x)
    return x - F.lag(x, k).over(series(**s))


def pct_change(x: str | Column, k: int = 1, **s) -> Column:
    x = _col(x)
    return ratio(x, F.lag(x, k).over(series(**s))) - 1


def shift(x: str | Column, k: int, default=None, **s) -> Column:
    return F.lag(_col(x), k, default).over(series(**s))


def roll(fn, x: str | Column, n: int, least: int | None = None, **s) -> Column:
    """fn (F.avg, F.sum, F.stddev_samp, F.min, F.max) over the last n rows."""
    x, over = _col(x), w(n, **s)
    return enough(x, over, n if least is None else least, fn(x).over(over))


def roll_mean(x, n, least=None, **s):
    return roll(F.avg, x, n, least, **s)


def roll_sum(x, n, least=None, **s):
    return roll(F.sum, x, n, least, **s)


def roll_std(x, n, least=None, **s):
    return roll(F.stddev_samp, x, n, least, **s)


def channel_pos(x: str | Column, n: int, **s) -> Column:
    """Place within the last n rows' range: -1 at the least, 1 at the largest."""
    low, high = roll(F.min, x, n, **s), roll(F.max, x, n, **s)
    return ratio(2 * (_col(x) - (low + high) / 2), high - low)


def roll_skew(x: str | Column, n: int, least: int | None = None, **s) -> Column:
    """Bias-adjusted skewness."""
    x, over = _col(x), w(n, **s)
    m = F.count(x).over(over).cast("double")
    return F.when(m >= max(3, n if least is None else least), F.skewness(x).over(over) * F.sqrt(m * (m - 1)) / (m - 2))


def roll_kurt(x: str | Column, n: int, least: int | None = None, **s) -> Column:
    """Bias-adjusted excess kurtosis."""
    x, over = _col(x), w(n, **s)
    m = F.count(x).over(over).cast("double")
    return F.when(m >= max(4, n if least is None else least), ((m + 1) * F.kurtosis(x).over(over) + 6) * (m - 1) / ((m - 2) * (m - 3)))


def roll_corr(x: str | Column, y: str | Column, n: int, least: int | None = None, **s) -> Column:
    """Correlation from moments, so that a constant frame gives null."""
    x, y, over = _col(x), _col(y), w(n, **s)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    m = lambda c: F.avg(c).over(over)
    cov, vx, vy = m(x * y) - m(x) * m(y), m(x * x) - m(x) * m(x), m(y * y) - m(y) * m(y)
    return enough(x, over, n if least is None else least, ratio(cov, F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0)))))


def roll_z(x: str | Column, n: int, least: int | None = None, **s) -> Column:
    return ratio(_col(x) - roll_mean(x, n, least, **s), roll_std(x, n, least, **s))


def expanding_median(x: str | Column, least: int = 1, **s) -> Column:
    x, over = _col(x), w(None, **s)
    return enough(x, over, least, F.percentile(x, F.lit(0.5)).over(over))


def roll_quintile(x: str | Column, n: int, least: int | None = None, **s) -> Column:
    """1 in the top fifth of the last n rows, -1 in the bottom fifth, else 0, by the share of rows not above the current."""
    x, over = _col(x), w(n, **s)
    rank = F.aggregate(F.collect_list(x).over(over), F.lit(0.0), lambda a, v: a + F.when(v <= x, 1.0).otherwise(0.0)) / F.count(x).over(over)
    return enough(x, over, n if least is None else least, F.when(rank >= 0.8, 1.0).when(rank <= 0.2, -1.0).otherwise(0.0))


def drawdown(df: DataFrame, nav: str, by: str | tuple, order: str = ORDER) -> DataFrame:
    """Adds peak, drawdown (a positive share) and dd_days: rows since the last peak."""
    over = w(None, by=by, order=order)
    d = df.withColumn("peak", F.max(nav).over(over)).withColumn("drawdown", 1 - F.col(nav) / F.col("peak"))
    keys = [by] if isinstance(by, str) else list(by)
    d = d.withColumn("spell", F.sum(F.when(F.col(nav) >= F.col("peak"), 1).otherwise(0)).over(over))
    inside = W.partitionBy(*keys, "spell").orderBy(order)
    return d.withColumn("dd_days", (F.row_number().over(inside) - 1).cast("long")).drop("spell")


def norm_price(x: str | Column, vol: str | Column, **s) -> Column:
    """Running sum of changes by volatility."""
    return F.sum(F.coalesce(ratio(_col(x), _col(vol)), F.lit(0.0))).over(w(None, **s))


def compound(ret: str | Column, **s) -> Column:
    """Running product of 1 + ret; a return of -1 or less ends at 0."""
    r = _col(ret)
    dead = F.max(F.when(r <= -1, 1).otherwise(0)).over(w(None, **s))
    return F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.log1p(F.when(r > -1, r))).over(w(None, **s))))


def rv_scale(ret: str | Column, target: float, n: int, year: int, low: float, high: float, **s) -> Column:
    """target by realised volatility of the last n rows, clipped; 1 until there are n."""
    total = roll_sum(_col(ret) * _col(ret), n, **s)
    return F.coalesce(clip(ratio(F.lit(target), F.sqrt(total * (year / n))), low, high), F.lit(1.0))


def variance_ratio_scale(ret: str | Column, short: int, long: int, low: float, high: float, **s) -> Column:
    """Long-run by short-run volatility, clipped."""
    return clip(ratio(roll_std(ret, long, short, **s), roll_std(ret, short, **s)), low, high)


def ar1_forecast(df: DataFrame, x: str, lookback: int, refit: int, blend: float = 0.5, **s) -> DataFrame:
    """Adds forecast: an AR(1) fitted over the last rows at every refit-th row, held between, blended with x itself."""
    over, at = w(lookback, **s), series(**s)
    d = df.withColumn("prior_x", F.lag(x).over(at)).withColumn("row", F.row_number().over(at))
    m = lambda c: F.avg(c).over(over)
    both = F.col("prior_x").isNotNull() & F.col(x).isNotNull()
    a, b = F.when(both, F.col("prior_x")), F.when(both, F.col(x))
    slope = ratio(m(a * b) - m(a) * m(b), m(a * a) - m(a) * m(a))
    fit = F.when((F.col("row") % refit == 0) & (F.col("row") > lookback), F.struct(slope.alias("b"), (m(b) - slope * m(a)).alias("a")))
    d = d.withColumn("fit", fit).withColumn("fit", F.last("fit", ignorenulls=True).over(w(None, **s)))
    return d.withColumn("forecast", blend * (F.col("fit.a") + F.col("fit.b") * F.col(x)) + (1 - blend) * F.col(x)).drop("prior_x", "row", "fit")


def sliding_windows(df: DataFrame, x: str, size: int, **s) -> DataFrame:
    """The size rows before each as an array, with the row itself as target; full windows only."""
    before = series(**s).rowsBetween(-size, -1)
    return df.withColumn("window", F.collect_list(x).over(before)).where(F.size("window") == size).withColumnRenamed(x, "target")


def turn_of_month(df: DataFrame, first: int, last: int, by: str = BY, order: str = ORDER) -> DataFrame:
    """Adds flag: 1 on the first ``first`` and last ``last`` rows of each month."""
    month = [by, F.trunc(order, "month")]
    up, down = W.partitionBy(*month).orderBy(order), W.partitionBy(*month).orderBy(F.col(order).desc())
    return df.withColumn("flag", ((F.row_number().over(up) <= first) | (F.row_number().over(down) <= last)).cast("int"))


def seasonal_score(monthly: DataFrame, ret: str, least: int = 3, most: int = 10, by: str = BY, order: str = ORDER) -> DataFrame:
    """Adds score: t-statistic of the same month's returns over up to ``most`` years before."""
    over = W.partitionBy(by, F.month(order)).orderBy(order).rowsBetween(-most, -1)
    n = F.count(ret).over(over)
    score = ratio(F.avg(ret).over(over) * F.sqrt(n.cast("double")), F.stddev_pop(ret).over(over))
    return monthly.withColumn("score", F.when(n >= least, score))


def roll_hurst(df: DataFrame, x: str, window: int, step: int, chunks: tuple, by: str = BY, order: str = ORDER) -> DataFrame:
    """Adds hurst: slope of the log rescaled range on the log chunk length, at every step-th row, held between.

    Anchors and chunk lengths are exploded and joined to the rows they cover, so a chunk is a group.
    """
    at = series(by, order)
    d = df.withColumn("row", F.row_number().over(at))
    anchors = d.where((F.col("row") >= window) & (F.col("row") % step == 0)).select(by, F.col("row").alias("anchor"))
    cover = anchors.withColumn("chunk", F.explode(F.array(*map(F.lit, chunks)))).withColumn("k", F.explode(F.sequence(F.lit(0), (F.lit(window) / F.col("chunk")).cast("int") - 1)))
    cover = cover.withColumn("row", F.explode(F.sequence(F.col("anchor") - window + 1 + F.col("k") * F.col("chunk"), F.col("anchor") - window + (F.col("k") + 1) * F.col("chunk"))))
    part = W.partitionBy(by, "anchor", "chunk", "k")
    v = cover.join(d.select(by, "row", x), [by, "row"])
    v = v.withColumn("dev", F.sum(F.col(x) - F.avg(x).over(part)).over(part.orderBy("row").rowsBetween(W.unboundedPreceding, 0)))
    rs = v.groupBy(by, "anchor", "chunk", "k").agg(ratio(F.max("dev") - F.min("dev"), F.stddev_pop(x)).alias("rs"))
    rs = rs.where("rs > 0").groupBy(by, "anchor", "chunk").agg(F.log(F.avg("rs")).alias("ly"), F.log(F.max(F.col("chunk").cast("double"))).alias("lx"))
    h = rs.groupBy(by, "anchor").agg(F.regr_slope("ly", "lx").alias("h")).withColumnRenamed("anchor", "row")
    return d.join(h, [by, "row"], "left").withColumn("hurst", F.last("h", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, 0))).drop("h", "row")


def same_contract_diff(x: str | Column, contract: str | Column, **s) -> Column:
    """Change of x where the contract is that of the row before, else 0."""
    c, at = _col(contract), series(**s)
    return F.when(F.lag(c).over(at) == c, _col(x) - F.lag(_col(x)).over(at)).otherwise(0.0)


def min_history(df: DataFrame, n: int, by: str = BY) -> DataFrame:
    """Series of n rows at least."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(by))).where(F.col("_n") >= n).drop("_n")


def warmup(df: DataFrame, n: int, x: str, by: str = BY, order: str = ORDER) -> DataFrame:
    """Adds active; x is 0 in the first n rows of a series."""
    d = df.withColumn("active", F.row_number().over(series(by, order)) > n)
    return d.withColumn(x, F.when(F.col("active"), F.col(x)).otherwise(0.0))


def valid_from_first_nonzero(df: DataFrame, x: str, by: str = BY, order: str = ORDER) -> DataFrame:
    return df.withColumn("valid", F.max(F.coalesce(F.col(x) != 0, F.lit(False))).over(w(None, by=by, order=order)))


def trim_active(df: DataFrame, x: str, by: str = BY, order: str = ORDER) -> DataFrame:
    """Rows from a series' first to its last value that isn't 0."""
    on = F.when(F.col(x) != 0, F.col(order))
    ends = W.partitionBy(by)
    return df.withColumn("_a", F.min(on).over(ends)).withColumn("_z", F.max(on).over(ends)).where(F.col(order).between(F.col("_a"), F.col("_z"))).drop("_a", "_z")
