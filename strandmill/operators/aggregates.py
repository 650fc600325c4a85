"""Summaries, periods, baskets and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import ratio
from strandmill.operators.bootstrap import boot_sharpe_by
from strandmill.operators.statistics import nw_se

#: Levels of describe_dist.
LEVELS = (0.05, 0.25, 0.5, 0.75, 0.95)


def by_class(pnl: DataFrame, dims: DataFrame, year: float, *, block: int, draws: int, seed: int) -> DataFrame:
    """(asset_class, n, sharpe, share, se, t, low, high) of money made, from (symbol, dt, pnl): the Sharpe ratio with its
    Newey-West error and its interval from a block bootstrap, whose draws the classes share.
    """
    d = pnl.join(dims.select("symbol", "asset_class"), "symbol").groupBy("asset_class", "dt").agg(F.sum("pnl").alias("ret"))
    s = d.groupBy("asset_class").agg(F.sum("ret").alias("total"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    s = s.join(nw_se(d, by="asset_class"), "asset_class").join(boot_sharpe_by(d, "asset_class", block, draws, seed, year).select("asset_class", "low", "high"), "asset_class")
    share = ratio(F.col("total"), F.sum("total").over(W.partitionBy()))
    return s.select("asset_class", "n", (ratio(F.col("mean"), F.col("sd")) * year**0.5).alias("sharpe"), share.alias("share"), (ratio(F.col("se"), F.col("sd")) * year**0.5).alias("se"), ratio(F.col("mean"), F.col("se")).alias("t"), "low", "high")


def total_oi(contracts: DataFrame) -> DataFrame:
    """Open interest over contracts that have any; null where none has."""
    return contracts.groupBy("symbol", "dt").agg(F.sum("open_interest").alias("open_interest"), F.count_if(F.col("open_interest") > 0).alias("live"))


def net_ratio(positions: DataFrame) -> DataFrame:
    d = positions.groupBy("ccy", "dt").agg(F.sum("longs").alias("l"), F.sum("shorts").alias("s"), F.sum("open_interest").alias("o"))
    return d.select("ccy", "dt", ratio(F.col("l") - F.col("s"), F.col("o")).alias("net"))


def subperiods(returns: DataFrame, periods: DataFrame, year: float) -> DataFrame:
    """Metrics by variant and named period (name, low, high); either end may be open."""
    p = returns.join(periods, (F.col("low").isNull() | (F.col("dt") >= F.col("low"))) & (F.col("high").isNull() | (F.col("dt") <= F.col("high"))))
    return p.groupBy("variant", "name").agg(F.count("*").alias("n"), (ratio(F.avg("ret"), F.stddev_samp("ret")) * year**0.5).alias("sharpe"), (F.avg("ret") * 10000).alias("mean_bp"), F.max("ret").alias("best"), F.min("ret").alias("worst"))


def windows(returns: DataFrame, periods: DataFrame, year: float, least: int = 5) -> DataFrame:
    """Metrics by variant and named window (name, low, high), every window of every variant; null with fewer than ``least`` rows."""
    keys = returns.select("variant").distinct().crossJoin(F.broadcast(periods)).withColumnRenamed("variant", "v")
    p = keys.join(returns, (F.col("v") == F.col("variant")) & (F.col("dt") >= F.col("low")) & (F.col("dt") <= F.col("high")), "left")
    at = W.partitionBy("v", "name").orderBy("dt").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("_log", F.sum(F.log1p("ret")).over(at)).withColumn("_fall", F.col("_log") - F.greatest(F.max("_log").over(at), F.lit(0.0)))
    n = F.count("ret")
    made = {"sharpe": ratio(F.avg("ret"), F.stddev_samp("ret")) * year**0.5, "cagr": F.exp(F.sum(F.log1p("ret")) * year / n) - 1, "max_dd": 1 - F.exp(F.min("_fall")), "mean_bp": F.avg("ret") * 10000, "best": F.max("ret"), "worst": F.min("ret")}
    return p.groupBy(F.col("v").alias("variant"), "name").agg(n.alias("n"), *(F.when(n >= least, x).alias(c) for c, x in made.items()))


def deepest_quarters(returns: DataFrame, k: int) -> DataFrame:
    """(name, low, high) of the k calendar quarters in which all variants together lost most."""
    low = F.to_date(F.date_trunc("quarter", "dt"))
    q = returns.groupBy(low.alias("low")).agg(F.sum(F.log1p("ret")).alias("fall")).orderBy("fall", "low").limit(k)
    return q.select(F.concat(F.year("low"), F.lit("Q"), F.quarter("low")).alias("name"), "low", F.date_sub(F.add_months("low", 3), 1).alias("high"))


def spans(returns: DataFrame, years: int, year: float) -> DataFrame:
    """Metrics by variant and span of so many years: decades at 10."""
    start = (F.floor(F.year("dt") / years) * years).cast("int")
    return returns.groupBy("variant", start.alias("start")).agg(F.count("*").alias("n"), (ratio(F.avg("ret"), F.stddev_samp("ret")) * year**0.5).alias("sharpe"))


def describe_dist(df: DataFrame, x: str, by: str) -> DataFrame:
    q = F.percentile(x, F.array(*map(F.lit, LEVELS)))
    d = df.groupBy(by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"), q.alias("q"))
    return d.select(by, "mean", "sd", "low", *(F.col("q")[i].alias(f"p{round(v * 100)}") for i, v in enumerate(LEVELS)), "high")


def rank_vs_null(draws: DataFrame, x: str, seen: Column) -> DataFrame:
    """Share of draws at or above what was seen, and how many deviations it is above their mean."""
    return draws.agg(F.avg((F.col(x) >= seen).cast("double")).alias("p"), ratio(F.first(seen) - F.avg(x), F.stddev_samp(x)).alias("sigmas"))


def accept(df: DataFrame, rules: dict[str, tuple[str, float]]) -> DataFrame:
    """A flag for each rule name: (column, least), and whether all hold."""
    d = df
    for name, (c, least) in rules.items():
        d = d.withColumn(name, F.coalesce(F.col(c) >= least, F.lit(False)))
    ok = F.lit(True)
    for name in rules:
        ok = ok & F.col(name)
    return d.withColumn("accepted", ok)


def inv_vol_basket(returns: DataFrame, target: float, year: float) -> DataFrame:
    """(dt, ret): returns weighed by the inverse of their deviation, scaled to a target volatility."""
    v = returns.groupBy("variant").agg(F.stddev_samp("ret").alias("sd")).where("sd > 0")
    v = v.withColumn("w", (1 / F.col("sd")) / F.sum(1 / F.col("sd")).over(W.partitionBy()))
    d = returns.join(v, "variant").groupBy("dt").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    s = d.agg((F.lit(target) / (F.stddev_samp("ret") * year**0.5)).alias("k"))
    return d.crossJoin(s).select("dt", (F.col("ret") * F.col("k")).alias("ret"))


def bucket_basket(returns: DataFrame, buckets: DataFrame, shares: dict[str, float], target: float, year: float) -> DataFrame:
    """(dt, ret): within a bucket (variant, bucket) by inverse deviation, buckets at one volatility by shares, all scaled to a target."""
    d = returns.join(buckets, "variant")
    v = d.groupBy("bucket", "variant").agg(F.stddev_samp("ret").alias("sd")).where("sd > 0")
    v = v.withColumn("w", (1 / F.col("sd")) / F.sum(1 / F.col("sd")).over(W.partitionBy("bucket")))
    b = d.join(v.select("variant", "w"), "variant").groupBy("bucket", "dt").agg(F.sum(F.col("w") * F.col("ret")).alias("ret"))
    unit = ratio(F.col("ret"), F.stddev_samp("ret").over(W.partitionBy("bucket")))
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("bucket")]
    mixed = b.select("dt", (unit * share).alias("ret")).groupBy("dt").agg(F.sum("ret").alias("ret"))
    k = mixed.agg((F.lit(target) / (F.stddev_samp("ret") * year**0.5)).alias("k"))
    return mixed.crossJoin(F.broadcast(k)).select("dt", (F.col("ret") * F.col("k")).alias("ret"))


def concat_last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all parts; of equal keys the one of the last part."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_part", F.lit(i))
        every = p if every is None else every.unionByName(p)
    w = W.partitionBy(*keys).orderBy(F.col("_part").desc())
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_part")


def dates_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dt").intersect(b.select("dt"))


def dates_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("dt").union(b.select("dt")).distinct()


#: Digests are sums of 48 bits a row, modulo this prime.
DIGEST_MOD = 2**61 - 1


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table, whatever the order of its rows: the sum of hashes of their text forms.

    A row's text has its columns in order of name, parted by ``|``, null as ``~``, and fractions as whole
    millionths (their own text where they have no such), so any engine with md5 gives the same.
    """
    kinds = dict(df.dtypes)
    small = lambda c: F.when(F.abs(c) < 9e12, F.floor(F.col(c) * 1e6 + 0.5).cast("long").cast("string")).otherwise(F.col(c).cast("string"))
    text = lambda c: F.coalesce(small(c) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit("~"))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", *(text(c) for c in sorted(df.columns)))), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("rows"), (F.coalesce(F.sum(part), F.lit(0)) % F.lit(DIGEST_MOD)).cast("long").alias("digest"))
