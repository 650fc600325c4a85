"""Joins over time: as-of, alignment, chains, events, and parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, value: str, by: str | None = None, order: str = "dt", lag: int = 0) -> DataFrame:
    """left with the last value of right at or before each row; then later by ``lag`` rows.

    One shuffle and sort over both: right's rows go before left's of the same date, and the last value is carried on.
    """
    keys = [by] if by else []
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value]))
    b = right.select(*keys, order, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    at = W.partitionBy(*keys).orderBy(order, "_side")
    d = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, 0)))
    d = d.where("_side = 1")
    return d.withColumn(value, F.lag("_v", lag).over(W.partitionBy(*keys).orderBy(order)) if lag else F.col("_v")).drop("_side", "_v")


def align(df: DataFrame, calendar: DataFrame, by: str = "symbol", order: str = "dt") -> DataFrame:
    """Every key on every date of the calendar; null where df has no row."""
    grid = df.select(by).distinct().crossJoin(calendar.select(order).distinct())
    return grid.join(df, [by, order], "left")


def reindex_fill(df: DataFrame, calendar: DataFrame, columns: list[str], default: float, by: str = "symbol", order: str = "dt") -> DataFrame:
    """As align, with gaps filled by the last value, then by the default."""
    over = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = align(df.select(by, order, *columns), calendar, by, order)
    return d.select(by, order, *(F.coalesce(F.last(c, ignorenulls=True).over(over), F.lit(default)).alias(c) for c in columns))


def with_dims(df: DataFrame, dims: DataFrame, by: str = "symbol") -> DataFrame:
    """Attributes of a key. Spark broadcasts the dimension by its size."""
    return df.join(dims, by)


def with_fx(df: DataFrame, dims: DataFrame, fx: DataFrame) -> DataFrame:
    """Rates of each key's currency as of the date; keys without any rate go."""
    d = df.join(dims.select("symbol", "ccy"), "symbol")
    dates = asof(d.select("ccy", "dt").distinct(), fx, "rate", by="ccy")
    return d.join(dates.where("rate IS NOT NULL"), ["ccy", "dt"])


def term_structure(bars: DataFrame, front: DataFrame, contracts: DataFrame) -> DataFrame:
    """Closes of the front contract and the next two by expiry, c1, c2 and c3, with the gaps in years between them."""
    chain = contracts.select("symbol", "expiry").distinct()
    at = W.partitionBy("symbol").orderBy("expiry")
    chain = chain.withColumn("e2", F.lead("expiry", 1).over(at)).withColumn("e3", F.lead("expiry", 2).over(at)).withColumnRenamed("expiry", "e1")
    d = bars.select("symbol", "dt").join(front, ["symbol", "dt"]).withColumnRenamed("front", "e1").join(chain, ["symbol", "e1"], "left")
    for k in (1, 2, 3):
        d = d.join(contracts.select("symbol", F.col("expiry").alias(f"e{k}"), "dt", F.col("close").alias(f"c{k}")), ["symbol", f"e{k}", "dt"], "left")
    return d.select("symbol", "dt", "e1", "c1", "c2", "c3", (F.col("e2") - F.col("e1")).cast("double").alias("years12"), (F.col("e3") - F.col("e1")).cast("double").alias("years13"))


def paired(a: DataFrame, b: DataFrame, order: str = "dt") -> DataFrame:
    """Two series (order, ret) side by side where both have a row: x and y."""
    return a.select(order, F.col("ret").alias("x")).join(b.select(order, F.col("ret").alias("y")), order)


def event_window(calendar: DataFrame, events: DataFrame, before: int = 1, order: str = "dt") -> DataFrame:
    """calendar with flag: 1 on the first date at or after each event, and on ``before`` dates before it."""
    c = calendar.select(order).distinct()
    ahead = W.orderBy(F.col("_t").desc(), "_side")
    d = c.select(F.col(order).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_d")).unionByName(events.select(F.col("event_dt").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("date").alias("_d")))
    days = d.withColumn("hit", F.last("_d", ignorenulls=True).over(ahead.rowsBetween(W.unboundedPreceding, 0))).where("_side = 1 AND hit IS NOT NULL").select(F.col("hit").alias(order), F.lit(1).alias("hit")).distinct()
    d = c.join(days, order, "left")
    return d.withColumn("flag", F.max(F.coalesce("hit", F.lit(0))).over(W.orderBy(order).rowsBetween(0, before))).select(order, "flag")


def lead_lag(signals: DataFrame, pairs: DataFrame, x: str, lag: int) -> DataFrame:
    """Mean over leaders of their signal some rows before, by sign, for each follower: (symbol, dt, x)."""
    d = signals.withColumn(x, F.lag(x, lag).over(W.partitionBy("symbol").orderBy("dt"))).withColumnRenamed("symbol", "leader")
    return d.join(pairs, "leader").groupBy(F.col("follower").alias("symbol"), "dt").agg(F.avg(F.col(x) * F.col("sign")).alias(x))


def match_names(names: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes whose pattern occurs in a name, whatever the case."""
    return names.join(codes, F.contains(F.upper("name"), F.upper("pattern")))


def cross_params(panel: DataFrame, variants: DataFrame) -> DataFrame:
    """Every row under every variant of a grid of parameters."""
    return panel.crossJoin(variants)


def leave_one_out(keys: DataFrame, by: str = "symbol") -> DataFrame:
    """(dropped, key): for each key, all others."""
    k = keys.select(by).distinct()
    return k.select(F.col(by).alias("dropped")).crossJoin(k).where(F.col("dropped") != F.col(by))


def coverage(requests: DataFrame, available: DataFrame, on: list[str]) -> DataFrame:
    """Requests that aren't available."""
    return requests.join(available.select(*on).distinct(), on, "left_anti")


def between_dates(df: DataFrame, low: str | None = None, high: str | None = None, order: str = "dt") -> DataFrame:
    """From low up to but without high; either may be open."""
    d = df.where(F.col(order) >= F.lit(low).cast("date")) if low else df
    return d.where(F.col(order) < F.lit(high).cast("date")) if high else d


def common_dates(df: DataFrame, x: str, how: str = "all", order: str = "dt", by: str = "symbol") -> DataFrame:
    """Rows of dates on which all (or any) keys have x."""
    n = df.select(by).distinct().count() if how == "all" else 1
    ok = df.where(F.col(x).isNotNull()).groupBy(order).agg(F.countDistinct(by).alias("_k")).where(F.col("_k") >= n)
    return df.join(ok, order, "left_semi")


def min_active_series(df: DataFrame, x: str, k: int, order: str = "dt") -> DataFrame:
    ok = df.where(F.col(x) != 0).groupBy(order).agg(F.count("*").alias("_k")).where(F.col("_k") >= k)
    return df.join(ok, order, "left_semi")


def select_positive(df: DataFrame, scores: DataFrame, score: str, by: str) -> DataFrame:
    return df.join(scores.where(F.col(score) > 0), by, "left_semi")


def restrict(df: DataFrame, dims: DataFrame, dim: str, values: list, x: str) -> DataFrame:
    """x as it is for keys of the values, 0 for others."""
    keep: Column = F.col(dim).isin(*values)
    return df.join(dims.select("symbol", dim), "symbol").withColumn(x, F.when(keep, F.col(x)).otherwise(0.0))
