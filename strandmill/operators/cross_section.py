"""Features across series at one date, and networks of series."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import ratio

#: Fixed values, as published: diversification multiplier by number of series; the last holds for more.
MULTIPLIERS = (
    (1, 1.0), (2, 1.20), (3, 1.48), (4, 1.56), (5, 1.70), (6, 1.90), (7, 1.98), (8, 2.11), (9, 2.18), (10, 2.24),
    (15, 2.53), (20, 2.87), (25, 3.01), (30, 3.12), (40, 3.27), (50, 3.39), (60, 3.47), (70, 3.54), (100, 3.75), (200, 4.0),
)


def is_active(forecast: str = "forecast", vol: str = "vol", fx: str = "fx") -> Column:
    """Forecast, volatility and rate known, forecast not 0, volatility not vanishing."""
    f, v = F.col(forecast), F.col(vol)
    return f.isNotNull() & v.isNotNull() & F.col(fx).isNotNull() & (f != 0) & (v >= 1e-10)


def xs_z(x: str, least: int = 3, order: str = "dt") -> Column:
    over = W.partitionBy(order)
    return F.when(F.count(x).over(over) >= least, ratio(F.col(x) - F.avg(x).over(over), F.stddev_samp(x).over(over)))


def group_demean(x: str, group: str, order: str = "dt") -> Column:
    return F.col(x) - F.avg(x).over(W.partitionBy(order, group))


def dispersion_z(df: DataFrame, x: str, n: int, least: int, order: str = "dt") -> DataFrame:
    """(dt, z): z-score of the spread across series against its last n dates. One row a date after the aggregation."""
    over = W.orderBy(order).rowsBetween(-(n - 1), 0)
    s = df.groupBy(order).agg(F.stddev_samp(x).alias("s"))
    return s.select(order, F.when(F.count("s").over(over) >= least, ratio(F.col("s") - F.avg("s").over(over), F.stddev_samp("s").over(over))).alias("z"))


def pool_mean(df: DataFrame, columns: list[str], order: str = "dt") -> DataFrame:
    return df.groupBy(order).agg(*(F.avg(c).alias(c) for c in columns))


def interpolate(x: Column, points: tuple) -> Column:
    """Linear between points (x, y) in order; the ends hold beyond them."""
    out = F.lit(float(points[-1][1]))
    for (a, ya), (b, yb) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x < b, ya + (x - a) * ((yb - ya) / (b - a))).otherwise(out)
    return F.when(x < points[0][0], F.lit(float(points[0][1]))).otherwise(out)


def div_mult(df: DataFrame, order: str = "dt") -> DataFrame:
    """(dt, n, weight, mult): number of series, equal weight and diversification multiplier."""
    n = df.groupBy(order).agg(F.count("*").alias("n"))
    return n.select(order, "n", (1.0 / F.col("n")).alias("weight"), interpolate(F.col("n"), MULTIPLIERS).alias("mult"))


def residualise(returns: DataFrame, loadings: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """(symbol, dt, residual) after projecting each date's returns on factors given by loadings (symbol, factor, loading).

    The factors' Gram matrix is as small as their number squared and is inverted once; the rest are joins and sums.
    """
    other = loadings.withColumnRenamed("factor", "g").withColumnRenamed("loading", "l")
    gram = loadings.join(other, "symbol").groupBy("factor", "g").agg(F.sum(F.col("loading") * F.col("l")).alias("v")).collect()
    names = sorted({r["factor"] for r in gram})
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names)) * ridge
    for r in gram:
        m[at[r["factor"]], at[r["g"]]] += r["v"]
    inverse = np.linalg.inv(m)
    cells = F.array(*(F.struct(F.lit(a).alias("factor"), F.lit(b).alias("to"), F.lit(float(inverse[at[a], at[b]])).alias("v")) for a in names for b in names))
    projected = returns.join(loadings, "symbol").groupBy("dt", "factor").agg(F.sum(F.col("loading") * F.col("ret")).alias("s"))
    scores = projected.withColumn("c", F.explode(cells)).where(F.col("c.factor") == F.col("factor")).groupBy("dt", F.col("c.to").alias("factor")).agg(F.sum(F.col("c.v") * F.col("s")).alias("f"))
    fitted = loadings.join(scores, "factor").groupBy("symbol", "dt").agg(F.sum(F.col("loading") * F.col("f")).alias("fitted"))
    return returns.join(fitted, ["symbol", "dt"]).select("symbol", "dt", (F.col("ret") - F.col("fitted")).alias("residual"))


def _area_rows(df: DataFrame, x: str) -> DataFrame:
    """(dt, i, j, a) for i < j: what a date adds to twice the signed area between the paths of two series."""
    d = df.withColumn("p", F.lag(x).over(W.partitionBy("symbol").orderBy("dt"))).where(F.col("p").isNotNull() & F.col(x).isNotNull())
    a, b = (d.select(F.col("symbol").alias(i), "dt", F.col(x).alias(f"x{i}"), F.col("p").alias(f"p{i}")) for i in ("i", "j"))
    return a.join(b, "dt").where("i < j").select("dt", "i", "j", (F.col("xi") * F.col("pj") - F.col("xj") * F.col("pi")).alias("a"))


def levy_area(df: DataFrame, x: str) -> DataFrame:
    """(i, j, area, n) for i < j: signed area between the paths of two series over their common rows."""
    return _area_rows(df, x).groupBy("i", "j").agg((F.sum("a") / 2).alias("area"), F.count("*").alias("n"))


def trailing_areas(df: DataFrame, x: str, windows: list[int], every: int) -> DataFrame:
    """(refit, span, i, j, area, coverage): areas over the last ``span`` dates before each refit date, none of it later.

    Refits are at every ``every``-th date once the longest window is full. coverage is the share of a window's dates on
    which both series have a value. One window sum a pair and span: windows share their rows.
    """
    days = df.select("dt").distinct().withColumn("t", F.row_number().over(W.orderBy("dt")) - 1)
    refits = days.where((F.col("t") >= max(windows)) & ((F.col("t") - max(windows)) % every == 0))
    rows = _area_rows(df, x).join(days, "dt").select("t", "i", "j", "a", F.lit(None).cast("date").alias("refit"))
    marks = rows.select("i", "j").distinct().crossJoin(F.broadcast(refits.select("t", F.col("dt").alias("refit"))))  # a row for each of the calendar's refits
    d = rows.unionByName(marks.select("t", "i", "j", F.lit(None).cast("double").alias("a"), "refit"))
    at = W.partitionBy("i", "j").orderBy("t")
    d = d.withColumns({f"area{n}": F.sum("a").over(at.rangeBetween(-n, -1)) / 2 for n in windows} | {f"held{n}": F.count("a").over(at.rangeBetween(-n, -1)) / n for n in windows})
    spans = F.array(*(F.struct(F.lit(n).alias("span"), F.col(f"area{n}").alias("area"), F.col(f"held{n}").alias("coverage")) for n in windows))
    return d.where("refit IS NOT NULL").select("refit", "i", "j", F.inline(spans)).where("refit IS NOT NULL AND area IS NOT NULL").select("refit", "span", "i", "j", "area", "coverage")


def pair_similarity(area: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, src, dst, w), both ways: 1 / (1 + squared distance between the series' rows of areas, by the largest)."""
    full = area.select(*by, "i", "j", F.col("area").alias("v")).union(area.select(*by, "j", "i", -F.col("area")))
    other = full.select(*by, F.col("i").alias("k"), "j", F.col("v").alias("u"))
    dist = full.join(other, [*by, "j"]).where("i < k").groupBy(*by, "i", "k").agg(F.sum((F.col("v") - F.col("u")) * (F.col("v") - F.col("u"))).alias("d"))
    most = dist.groupBy(*by).agg(F.max("d").alias("most"))
    w = (dist.join(most, list(by)) if by else dist.crossJoin(most)).select(*by, "i", "k", (1 / (1 + ratio(F.col("d"), F.col("most")))).alias("w"))
    return w.select(*by, F.col("i").alias("src"), F.col("k").alias("dst"), "w").union(w.select(*by, "k", "i", "w"))


def degree_norm(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights by the square root of both ends' degrees."""
    degree = edges.groupBy(*by, "src").agg(F.sum("w").alias("deg"))
    a, b = degree.withColumnRenamed("deg", "da"), degree.select(*by, F.col("src").alias("dst"), F.col("deg").alias("db"))
    return edges.join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, "src", "dst", ratio(F.col("w"), F.sqrt(F.col("da") * F.col("db"))).alias("w"))


def propagate(df: DataFrame, edges: DataFrame, x: str) -> DataFrame:
    """(symbol, dt, x): sum over neighbours of weight times x."""
    return df.join(edges, df["symbol"] == edges["src"]).groupBy(F.col("dst").alias("symbol"), "dt").agg(F.sum(F.col("w") * F.col(x)).alias(x))


def ensemble_edges(areas: DataFrame, least: float = 0.7) -> DataFrame:
    """(refit, src, dst, w): mean weight over the windows in which a pair's coverage is enough."""
    by = ("refit", "span")
    held = areas.where(F.col("coverage") >= least)
    return pair_similarity(held, by).groupBy("refit", "src", "dst").agg(F.avg("w").alias("w"))


def resample_month(df: DataFrame, x: str, how: str = "last", by: str = "symbol", order: str = "dt") -> DataFrame:
    """One row a month: the last value or the sum."""
    value = F.max_by(x, order) if how == "last" else F.sum(x)
    return df.groupBy(by, F.trunc(order, "month").alias("_m")).agg(value.alias(x)).withColumnRenamed("_m", order)
