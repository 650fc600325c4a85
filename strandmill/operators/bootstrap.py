"""Block bootstraps: a draw's blocks are rows, joined to the series by row number and added up by draw.

Draws come from a hash by plain modular arithmetic, so they are the same in any engine and on every run.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import ratio
from strandmill.operators.statistics import lagged_products
from strandmill.sources.sinks import save

#: Fixed values of the generator: a prime modulus and three multipliers.
PRIME, M1, M2, M3 = 2147483647, 48271, 69621, 16807


def hash_sql(seed: int, a: str, b: str) -> str:
    """An integer from 0 to PRIME - 1, as SQL of two integer columns."""
    a, b = f"CAST({a} AS BIGINT)", f"CAST({b} AS BIGINT)"
    one = f"(({a} + {seed}) % {PRIME} * {M1} + {b} + 1) % {PRIME}"
    two = f"(({one}) * {M2} + {a}) % {PRIME}"
    return f"((({two}) * {M3} + {seed}) % {PRIME})"


def uniform_sql(seed: int, a: str, b: str) -> str:
    return f"(({hash_sql(seed, a, b)} + 0.5) / {PRIME}.0)"


def block_index(spark: SparkSession, n: int, block: int, draws: int, seed: int) -> DataFrame:
    """(draw, place, row): circular blocks, row from 0."""
    per = math.ceil(n / block)
    d = spark.range(draws * per).select((F.col("id") / per).cast("long").alias("draw"), (F.col("id") % per).alias("b"))
    d = d.withColumn("start", F.expr(f"{hash_sql(seed, 'draw', 'b')} % {n}")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return d.select("draw", (F.col("b") * block + F.col("j")).alias("place"), ((F.col("start") + F.col("j")) % n).alias("row")).where(F.col("place") < n)


def numbered(df: DataFrame, order: str = "dt") -> DataFrame:
    """One series with its rows numbered from 0."""
    return df.withColumn("row", (F.row_number().over(W.orderBy(order)) - 1).cast("long"))


def resample(df: DataFrame, block: int, draws: int, seed: int, n: int | None = None) -> DataFrame:
    """Rows of a series by draw and place."""
    rows = numbered(df)
    n = n or rows.count()
    return block_index(df.sparkSession, n, block, draws, seed).join(rows, "row")


def sharpe(x: Column) -> Column:
    """Of the rows of a group; null without spread."""
    mean = F.avg(x)
    return ratio(mean, F.sqrt(F.greatest(F.avg(x * x) - mean * mean, F.lit(0.0))))


def interval(df: DataFrame, x: str, by: tuple = (), level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return df.groupBy(*by).agg(F.count(x).alias("draws"), F.percentile(x, F.lit(a)).alias("low"), F.percentile(x, F.lit(1 - a)).alias("high"), F.avg((F.col(x) <= 0).cast("double")).alias("below"))


def boot_sharpe_diff(pair: DataFrame, draws: int, block: int, seed: int, year: float) -> DataFrame:
    """Interval of the difference of Sharpe ratios of x and y, with the share of draws of 0 or less."""
    d = resample(pair, block, draws, seed).groupBy("draw").agg(((sharpe(F.col("x")) - sharpe(F.col("y"))) * year**0.5).alias("diff"))
    return interval(d, "diff")


def boot_sharpe_ci(df: DataFrame, draws: int, block: int, seed: int, year: float) -> DataFrame:
    return interval(resample(df, block, draws, seed).groupBy("draw").agg((sharpe(F.col("ret")) * year**0.5).alias("sharpe")), "sharpe")


def boot_mdd_ci(df: DataFrame, draws: int, block: int, seed: int) -> DataFrame:
    """Interval of the largest drawdown: running sums of logs by draw."""
    at = W.partitionBy("draw").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    d = resample(df, block, draws, seed).withColumn("nav", F.sum(F.log1p("ret")).over(at)).withColumn("peak", F.greatest(F.max("nav").over(at), F.lit(0.0)))
    return interval(d.groupBy("draw").agg((1 - F.exp(F.min(F.col("nav") - F.col("peak")))).alias("mdd")), "mdd")


def opt_block(df: DataFrame, by: str = "variant") -> DataFrame:
    """(by, block): Politis and White's length for the stationary bootstrap, in whole rows, from 1 to a quarter of them.

    The cut is the first lag after which max(5, 2 sqrt(log10 n)) lags in a row have autocorrelations within
    2 sqrt(log10(n) / n) of 0, or the last lag that has so many after it. Flat-top weights reach to twice that lag. Autocorrelations divide by
    n less the lag. Series under 20 rows, or without spread, get 1. All lags looked at grow with the root of n.
    """
    size = F.greatest(F.lit(5), F.ceil(2 * F.sqrt(F.log10(F.greatest("n", F.lit(10)))))).cast("int")
    g = lagged_products(df, "ret", 2 * F.least(F.col("n") - 1, F.ceil(F.sqrt(F.col("n").cast("double"))) + 2 * size), by)
    zero = g.where("lag = 0").select(by, F.col("s").alias("s0"))
    r = g.join(zero, by).withColumn("rho", ratio(F.col("s") / (F.col("n") - F.col("lag")), F.col("s0") / F.col("n")))
    r = r.withColumn("quiet", size).withColumn("most", F.least(F.col("n") - 1, F.ceil(F.sqrt(F.col("n").cast("double"))) + 2 * size).cast("int"))
    small = (F.abs("rho") < 2 * F.sqrt(F.log10(F.greatest("n", F.lit(10))) / F.col("n"))).cast("int")
    # how far the run of small lags that begins right after a lag reaches, by the next lag that isn't small
    later = W.partitionBy(by).orderBy("lag").rowsBetween(1, W.unboundedFollowing)
    r = r.withColumn("loud", F.min(F.when(small == 0, F.col("lag"))).over(later))
    ends = (F.col("lag") >= 1) & (F.col("lag") < F.col("most") - F.col("quiet")) & (F.col("loud").isNull() | (F.col("loud") > F.col("lag") + F.col("quiet")))
    m = r.groupBy(by).agg(F.coalesce(F.min(F.when(ends, F.col("lag"))), F.max(F.col("most") - F.col("quiet"))).alias("m"))
    d = r.join(m, by).withColumn("t", F.col("lag") / F.greatest(2 * F.col("m"), F.lit(1)))
    w = F.when(F.col("t") <= 0.5, 1.0).when(F.col("t") <= 1, 2 * (1 - F.col("t"))).otherwise(0.0)
    both = F.when(F.col("lag") == 0, 1.0).otherwise(2.0) * w
    s = d.groupBy(by).agg(F.max("n").alias("n"), F.max("s0").alias("s0"), F.sum(both * F.col("lag") * F.col("rho")).alias("g"), F.sum(both * F.col("rho")).alias("v"))
    length = F.rint(F.pow(2 * F.col("g") * F.col("g") / (2 * F.col("v") * F.col("v")) * F.col("n"), F.lit(1 / 3)))
    whole = F.greatest(F.least(length, F.floor(F.col("n") / 4)), F.lit(1)).cast("int")
    return s.select(by, F.when((F.col("n") >= 20) & (F.col("s0") / F.col("n") >= 1e-18) & (2 * F.col("v") * F.col("v") >= 1e-18), whole).otherwise(1).alias("block"))


def boot_means(diffs: DataFrame, block: int, draws: int, seed: int) -> DataFrame:
    """(variant, draw, mean) of each variant's differences (variant, dt, d) over shared draws; dates are shared too."""
    dates = numbered(diffs.select("dt").distinct())
    n = dates.count()
    rows = diffs.join(dates, "dt")
    times = block_index(diffs.sparkSession, n, block, draws, seed).groupBy("draw", "row").agg(F.count("*").alias("k"))
    return times.join(rows, "row").groupBy("variant", "draw").agg((F.sum(F.col("d") * F.col("k")) / F.sum("k")).alias("mean"))


def boot_t(diffs: DataFrame, block: int, draws: int, seed: int) -> DataFrame:
    """(variant, draw, t, t0, mean0): studentised centred draws and the observed t."""
    m = boot_means(diffs, block, draws, seed)
    seen = diffs.groupBy("variant").agg(F.avg("d").alias("mean0")).join(m.groupBy("variant").agg(F.stddev_samp("mean").alias("se")), "variant")
    d = m.join(seen, "variant")
    return d.select("variant", "draw", "mean", "mean0", "se", ratio(F.col("mean") - F.col("mean0"), F.col("se")).alias("t"), ratio(F.col("mean0"), F.col("se")).alias("t0"))


def romano_wolf(diffs: DataFrame, block: int, draws: int, seed: int) -> DataFrame:
    """(variant, t, p): step-down adjusted p; the maximum runs over variants from the smallest t up, within a draw."""
    t = boot_t(diffs, block, draws, seed)
    up = W.partitionBy("draw").orderBy("t0", "variant").rowsBetween(W.unboundedPreceding, 0)
    p = t.withColumn("most", F.max("t").over(up)).groupBy("variant").agg(F.max("t0").alias("t"), F.avg((F.col("most") >= F.col("t0")).cast("double")).alias("p0"))
    return p.select("variant", "t", F.max("p0").over(W.orderBy(F.col("t").desc(), "variant").rowsBetween(W.unboundedPreceding, 0)).alias("p"))


def spa(diffs: DataFrame, block: int, draws: int, seed: int) -> DataFrame:
    """Hansen's test of superior predictive ability: lower, consistent and upper p."""
    t = boot_t(diffs, block, draws, seed)
    n = diffs.select("dt").distinct().count()
    cut = -math.sqrt(2 * math.log(math.log(max(n, 3))))
    lower = ratio(F.col("mean") - F.greatest(F.col("mean0"), F.lit(0.0)), F.col("se"))
    middle = ratio(F.col("mean") - F.when(F.col("t0") >= cut, F.col("mean0")).otherwise(0.0), F.col("se"))
    top = t.agg(F.greatest(F.max("t0"), F.lit(0.0)).alias("top"))
    most = t.groupBy("draw").agg(*(F.greatest(F.max(c), F.lit(0.0)).alias(k) for k, c in (("lower", lower), ("consistent", middle), ("upper", F.col("t")))))
    return most.crossJoin(top).agg(*(F.avg((F.col(k) >= F.col("top")).cast("double")).alias(k) for k in ("lower", "consistent", "upper")), F.max("top").alias("t"))


def _eliminated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rounds of elimination from one row of means and covariances: each variant of each round with its error, and the round's worst."""
    for b in batches:
        for r in b.to_pylist():
            names = sorted(r["means"], key=lambda m: m["variant"])
            m0, at = np.array([m["m0"] for m in names]), {m["variant"]: k for k, m in enumerate(names)}
            cov = np.zeros((len(at), len(at)))
            for c in r["pairs"]:
                cov[at[c["i"]], at[c["j"]]] = c["c"]
            left, rows = list(range(len(names))), []
            while left:
                c = cov[np.ix_(left, left)]
                se = np.sqrt(np.maximum(np.diag(c) - 2 * c.mean(1) + c.mean(), 0))
                with np.errstate(divide="ignore", invalid="ignore"):
                    t0 = np.where(se > 0, (m0[left] - m0[left].mean()) / se, -np.inf)
                worst = max(range(len(left)), key=lambda k: (t0[k], k))  # names are in order
                rows += [{"round": len(names) - len(left), "variant": names[k]["variant"], "se": float(e), "worst": names[left[worst]]["variant"], "t0": float(t0[worst])} for k, e in zip(left, se)]
                left.pop(worst)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("round", pa.int32()), ("variant", pa.string()), ("se", pa.float64()), ("worst", pa.string()), ("t0", pa.float64())]))


def mcs(losses: DataFrame, block: int, draws: int, seed: int, alpha: float = 0.1) -> DataFrame:
    """(variant, p, kept): model confidence set by elimination of the worst, in one plan.

    Errors within any set follow from the covariances of the boot means, a table of pairs of variants; the order of
    elimination is a fold over that one row. The draws then meet all rounds at once, as keys of one aggregation.
    """
    d = losses.withColumnRenamed("loss", "d")
    seen = d.groupBy("variant").agg(F.avg("d").alias("m0"))
    x = save(boot_means(d, block, draws, seed).join(seen, "variant").select("variant", "draw", (F.col("mean") - F.col("m0")).alias("x")), "boot-means")
    other = x.select(F.col("variant").alias("j"), "draw", F.col("x").alias("y"))
    pairs = x.join(other, "draw").groupBy(F.col("variant").alias("i"), "j").agg(F.covar_samp("x", "y").alias("c"))
    row = pairs.agg(F.collect_list(F.struct("i", "j", "c")).alias("pairs")).crossJoin(seen.agg(F.collect_list(F.struct("variant", "m0")).alias("means")))
    rounds = save(row.mapInArrow(_eliminated, "round int, variant string, se double, worst string, t0 double"), "rounds")
    z = x.join(rounds, "variant").withColumn("t", ratio(F.col("x") - F.avg("x").over(W.partitionBy("draw", "round")), F.col("se")))
    most = z.groupBy("draw", "round").agg(F.max("t").alias("most"), F.first("t0").alias("t0"), F.first("worst").alias("variant"), F.count("*").alias("size"))
    p = most.groupBy("round", "variant").agg(F.max(F.when(F.col("size") == 1, 1.0)).alias("last"), F.avg((F.col("most") >= F.col("t0")).cast("double")).alias("share"))
    p = p.select("variant", F.coalesce("last", F.max("share").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, 0))).alias("p"))
    return p.withColumn("kept", F.col("p") >= alpha)


def block_grid(pairs: DataFrame, blocks: list[int], draws: int, seed: int, year: float) -> DataFrame:
    """Intervals of boot_sharpe_diff by variant and block length, which are keys of one job; dates and draws are shared.

    pairs has variant, dt, x and y. A draw's row counts are joined to the series and added up, not its copies of rows.
    """
    dates = numbered(pairs.select("dt").distinct())
    n = dates.count()
    parts = [block_index(pairs.sparkSession, n, b, draws, seed).withColumn("block", F.lit(b)) for b in blocks]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    times = every.groupBy("block", "draw", "row").agg(F.count("*").alias("k"))
    rows = pairs.join(dates, "dt").groupBy("row").agg(F.collect_list(F.struct("variant", "x", "y")).alias("of"))
    rows = times.join(rows, "row").select("block", "draw", "k", F.inline("of"))
    mean = lambda c: F.sum(F.col("k") * c) / F.sum("k")
    x, y = F.col("x"), F.col("y")
    d = rows.groupBy("variant", "block", "draw").agg(mean(x).alias("mx"), mean(x * x).alias("qx"), mean(y).alias("my"), mean(y * y).alias("qy"))
    one = lambda m, q: ratio(F.col(m), F.sqrt(F.greatest(F.col(q) - F.col(m) * F.col(m), F.lit(0.0))))
    return interval(d.withColumn("diff", (one("mx", "qx") - one("my", "qy")) * year**0.5), "diff", ("variant", "block"))


def boot_sharpe_by(df: DataFrame, by: str, block: int, draws: int, seed: int, year: float) -> DataFrame:
    """Intervals of the Sharpe ratio of each key (by, dt, ret); dates and draws are shared, and a draw's row counts are joined, not copies of rows."""
    dates = numbered(df.select("dt").distinct())
    times = block_index(df.sparkSession, dates.count(), block, draws, seed).groupBy("draw", "row").agg(F.count("*").alias("k"))
    d = times.join(df.join(dates, "dt"), "row").groupBy(by, "draw").agg((F.sum(F.col("k") * F.col("ret")) / F.sum("k")).alias("m"), (F.sum(F.col("k") * F.col("ret") * F.col("ret")) / F.sum("k")).alias("q"))
    return interval(d.withColumn("sharpe", ratio(F.col("m"), F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)))) * year**0.5), "sharpe", (by,))


def window_rank(df: DataFrame, k: int, draws: int, seed: int) -> DataFrame:
    """Sum of the last k rows, and its rank among sums of k rows from random starts."""
    rows = numbered(df)
    n = rows.count()
    starts = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.expr(f"{hash_sql(seed, 'id', '0')} % {n - k + 1}").alias("start"))
    sums = starts.withColumn("row", F.explode(F.sequence(F.col("start"), F.col("start") + k - 1))).join(rows, "row").groupBy("draw").agg(F.sum("ret").alias("s"))
    seen = rows.where(F.col("row") >= n - k).agg(F.sum("ret").alias("seen"))
    return sums.crossJoin(seen).agg(F.max("seen").alias("seen"), F.avg((F.col("s") <= F.col("seen")).cast("double")).alias("rank"))


def boot_mdd_by(df: DataFrame, by: str, block: int, draws: int, seed: int) -> DataFrame:
    """Intervals of the largest drawdown of each key (by, dt, ret); dates and draws are shared. A draw's path is one window of a key."""
    dates = numbered(df.select("dt").distinct())
    d = block_index(df.sparkSession, dates.count(), block, draws, seed).join(df.join(dates, "dt"), "row")
    path = W.partitionBy(by, "draw").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("c", F.sum(F.log1p("ret")).over(path)).withColumn("fall", F.col("c") - F.greatest(F.max("c").over(path), F.lit(0.0)))
    return interval(d.groupBy(by, "draw").agg((1 - F.exp(F.min("fall"))).alias("mdd")), "mdd", (by,))


def window_rank_by(df: DataFrame, by: str, k: int, draws: int, seed: int) -> DataFrame:
    """(by, seen, rank): the sum of each key's last k rows, and its rank among sums of k rows from random starts; null rank for keys under k rows.

    Sums of k rows are differences of running sums, so a draw is one row of a key.
    """
    rows = df.select(by, "ret", (F.row_number().over(W.partitionBy(by).orderBy("dt")) - 1).alias("row"), F.count("*").over(W.partitionBy(by)).alias("n"))
    rows = rows.withColumn("s", F.sum("ret").over(W.partitionBy(by).orderBy("row").rowsBetween(-(k - 1), 0))).where(F.col("row") >= k - 1)
    seen = rows.where(F.col("row") == F.col("n") - 1).select(by, "n", F.col("s").alias("seen"))
    starts = seen.crossJoin(df.sparkSession.range(draws)).withColumn("row", F.expr(f"{hash_sql(seed, 'id', '0')} % (n - {k - 1})") + k - 1)
    return starts.join(rows.select(by, "row", "s"), [by, "row"]).groupBy(by).agg(F.max("seen").alias("seen"), F.avg((F.col("s") <= F.col("seen")).cast("double")).alias("rank"))
