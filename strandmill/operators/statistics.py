"""Statistics of return series by variant: errors, tests, regressions and corrections for multiple testing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import chi2_tail_sql, normal_cdf, normal_ppf, ratio
from strandmill.sources.sinks import save

BY = "variant"


def lagged_products(df: DataFrame, x: str, lags: int | Column, by: str = BY) -> DataFrame:
    """(by, lag, n, s): sums of products of deviations from the mean, lag rows apart, from lag 0 on.

    Rows are joined by number, so a lag is a key: no window holds more than its row.
    """
    d = df.select(by, F.row_number().over(W.partitionBy(by).orderBy("dt")).alias("row"), (F.col(x) - F.avg(x).over(W.partitionBy(by))).alias("u"), F.count("*").over(W.partitionBy(by)).alias("n"))
    most = F.lit(lags) if isinstance(lags, int) else lags
    a = d.withColumn("lag", F.explode(F.sequence(F.lit(0), most.cast("int")))).withColumn("other", F.col("row") - F.col("lag"))
    b = d.select(by, F.col("row").alias("other"), F.col("u").alias("v"))
    return a.join(b, [by, "other"]).groupBy(by, "lag").agg(F.max("n").alias("n"), F.sum(F.col("u") * F.col("v")).alias("s"))


def nw_se(df: DataFrame, x: str = "ret", by: str = BY) -> DataFrame:
    """(by, n, se): Newey-West error of the mean with floor(0.75 n^(1/3)) lags."""
    lags = F.floor(0.75 * F.pow(F.col("n"), F.lit(1 / 3)) + 1e-9)
    g = lagged_products(df, x, lags, by)
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (lags + 1)))
    return g.groupBy(by).agg(F.max("n").alias("n"), F.sqrt(F.greatest(F.sum(weight * F.col("s")), F.lit(0.0)) / F.max("n") / F.max("n")).alias("se"))


def two_sided(z: str) -> Column:
    return 2 * (1 - normal_cdf(f"abs({z})"))


def sharpe_hac(df: DataFrame, year: float) -> DataFrame:
    """Sharpe ratio with the error of its mean, t and p."""
    m = df.groupBy(BY).agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"))
    d = m.join(nw_se(df), BY).withColumn("t", ratio(F.col("mean"), F.col("se")))
    return d.select(BY, "n", (ratio(F.col("mean"), F.col("sd")) * year**0.5).alias("sharpe"), (ratio(F.col("se"), F.col("sd")) * year**0.5).alias("sharpe_se"), "t", two_sided("t").alias("p"))


def jkm(pair: DataFrame, year: float, by: tuple = ()) -> DataFrame:
    """Test of equal Sharpe ratios of x and y with Memmel's variance."""
    m = pair.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"), F.covar_pop("x", "y").alias("c"))
    m = m.withColumn("a", ratio(F.col("mx"), F.col("sx"))).withColumn("b", ratio(F.col("my"), F.col("sy"))).withColumn("rho", ratio(F.col("c"), F.col("sx") * F.col("sy")))
    v = (2 - 2 * F.col("rho") + 0.5 * (F.col("a") * F.col("a") + F.col("b") * F.col("b") - 2 * F.col("a") * F.col("b") * F.col("rho") * F.col("rho"))) / F.col("n")
    m = m.withColumn("z", ratio(F.col("a") - F.col("b"), F.sqrt(v)))
    return m.select(*by, "n", ((F.col("a") - F.col("b")) * year**0.5).alias("diff"), "z", two_sided("z").alias("p"))


def moments(df: DataFrame, x: str = "ret", by: str = BY) -> DataFrame:
    """Count, mean, sample deviation, population skewness and kurtosis (3 for a normal)."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def deflated_sharpe(df: DataFrame, trials: int, spread: float) -> DataFrame:
    """Chance that the Sharpe ratio (per row) is above the largest expected of so many trials with that spread."""
    g = 0.5772156649015329
    d = moments(df).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    d = d.withColumn("sr0", spread * ((1 - g) * normal_ppf(repr(1 - 1 / trials)) + g * normal_ppf(repr(1 - 1 / (trials * math.e)))))
    d = d.withColumn("z", ratio((F.col("sr") - F.col("sr0")) * F.sqrt(F.col("n") - 1.0), F.sqrt(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"))))
    return d.select(BY, "sr", "sr0", normal_cdf("z").alias("dsr"))


def lo_sharpe(df: DataFrame, q: int) -> DataFrame:
    """Sharpe ratio over q rows, adjusted for autocorrelation."""
    g = lagged_products(df, "ret", q - 1)
    zero = g.where("lag = 0").select(BY, F.col("s").alias("s0"))
    r = g.where("lag > 0").join(zero, BY).groupBy(BY).agg(F.sum((q - F.col("lag")) * ratio(F.col("s"), F.col("s0"))).alias("w"))
    m = moments(df).withColumn("sr", ratio(F.col("mean"), F.col("sd"))).join(r, BY)
    eta = q / F.sqrt(F.greatest(q + 2 * F.col("w"), F.lit(1e-9)))
    return m.select(BY, (F.col("sr") * q**0.5).alias("plain"), (F.col("sr") * eta).alias("adjusted"))


def mertens(df: DataFrame, year: float) -> DataFrame:
    """Sharpe ratio with an error that allows for skewness and fat tails."""
    d = moments(df).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    d = d.withColumn("se", F.sqrt((1 + 0.5 * F.col("sr") ** 2 - F.col("skew") * F.col("sr") + (F.col("kurt") - 3) / 4 * F.col("sr") ** 2) / F.col("n")))
    return d.select(BY, (F.col("sr") * year**0.5).alias("sharpe"), (F.col("se") * year**0.5).alias("se"), ratio(F.col("sr"), F.col("se")).alias("t"))


def min_trl(df: DataFrame, benchmarks: list[float], level: float = 0.95) -> DataFrame:
    """Rows needed for the Sharpe ratio (per row) to be above each benchmark at the level; null if it isn't."""
    d = moments(df).withColumn("sr", ratio(F.col("mean"), F.col("sd"))).withColumn("bench", F.explode(F.array(*map(F.lit, benchmarks))))
    v = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") ** 2
    return d.select(BY, "bench", F.when(F.col("sr") > F.col("bench"), 1 + v * (normal_ppf(repr(level)) / (F.col("sr") - F.col("bench"))) ** 2).alias("rows"))


def haircut(df: DataFrame, year: float) -> DataFrame:
    """p of each variant's Sharpe ratio, and adjusted by Bonferroni, Holm, and Benjamini-Hochberg-Yekutieli."""
    d = moments(df).withColumn("t", ratio(F.col("mean"), F.col("sd")) * F.sqrt(F.col("n").cast("double"))).withColumn("p", two_sided("t"))
    d = _ranked(d)
    run = W.orderBy("k")
    holm = F.least(F.max((F.col("m") - F.col("k") + 1) * F.col("p")).over(run.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))
    bhy = F.least(F.min(F.col("m") * F.col("c") / F.col("k") * F.col("p")).over(run.rowsBetween(0, W.unboundedFollowing)), F.lit(1.0))
    return d.select(BY, "t", "p", F.least(F.col("m") * F.col("p"), F.lit(1.0)).alias("bonferroni"), holm.alias("holm"), bhy.alias("bhy"))


def _ranked(d: DataFrame) -> DataFrame:
    """Adds rank k of p, number m of variants and their harmonic sum c. One row a variant."""
    d = d.withColumn("k", F.row_number().over(W.orderBy("p", BY)))
    return d.withColumn("m", F.count("*").over(W.partitionBy())).withColumn("c", F.sum(1.0 / F.col("k")).over(W.partitionBy()))


def jarque_bera(df: DataFrame) -> DataFrame:
    d = moments(df).withColumn("jb", F.col("n") / 6 * (F.col("skew") ** 2 + (F.col("kurt") - 3) ** 2 / 4))
    return d.select(BY, "jb", F.expr(chi2_tail_sql("jb", 2)).alias("p"))


def ljung_box(df: DataFrame, lags: int, x: str = "ret") -> DataFrame:
    g = lagged_products(df, x, lags)
    zero = g.where("lag = 0").select(BY, F.col("s").alias("s0"))
    d = g.where("lag > 0").join(zero, BY).groupBy(BY).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.pow(ratio(F.col("s"), F.col("s0")), F.lit(2.0)) / (F.col("n") - F.col("lag")))).alias("q"))
    return d.select(BY, "q", F.expr(chi2_tail_sql("q", lags)).alias("p"))


def ols(df: DataFrame, y: str, xs: list[str], lags: int | None = None) -> dict:
    """Least squares with a constant and Newey-West errors. Spark sums products; the k by k system is solved here.

    Needs dt for the order; lags: floor(4 (n / 100)^(2/9)) unless given.
    """
    names = ["const", *xs]
    d = df.select("dt", F.col(y).alias("_y"), F.lit(1.0).alias("const"), *xs).dropna()
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in names for b in [*names, "_y"]]
    r = d.agg(F.count("*").alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), *cells).first()
    n, k = r["n"], len(names)
    xx = np.array([[r[f"{a}|{b}"] for b in names] for a in names], float)
    xy = np.array([r[f"{a}|_y"] for a in names], float)
    beta = np.linalg.solve(xx, xy)
    lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    fit = sum((F.col(c) * float(v) for c, v in zip(names, beta, strict=True)), F.lit(0.0))
    e = d.withColumn("_e", F.col("_y") - fit).withColumn("_row", F.row_number().over(W.orderBy("dt")))
    scores = e.select("_row", *((F.col(c) * F.col("_e")).alias(c) for c in names))
    a = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("other", F.col("_row") - F.col("lag"))
    b = scores.select(F.col("_row").alias("other"), *(F.col(c).alias(f"{c}_o") for c in names))
    got = a.join(b, "other").groupBy("lag").agg(*(F.sum(F.col(p) * F.col(f"{q}_o")).alias(f"{p}|{q}") for p in names for q in names)).collect()
    s = np.zeros((k, k))
    for row in got:
        g = np.array([[row[f"{p}|{q}"] for q in names] for p in names], float)
        s += g if row["lag"] == 0 else (1 - row["lag"] / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(xx)
    se = np.sqrt(np.maximum(np.diag(inv @ s @ inv), 0))
    rss = r["yy"] - beta @ xy
    tss = r["yy"] - r["const|_y"] ** 2 / n
    return {"names": names, "beta": beta, "se": se, "r2": 1 - rss / tss if tss > 0 else float("nan"), "n": n, "rss": rss}


def ols_table(df: DataFrame, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """ols() as rows (term, beta, se, t, r2, n)."""
    f = ols(df, y, xs, lags)
    rows = [(n, float(b), float(s), float(b / s) if s else None, float(f["r2"]), int(f["n"])) for n, b, s in zip(f["names"], f["beta"], f["se"], strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, beta double, se double, t double, r2 double, n long")


def _solved(k: int):
    """Arrow batches of a key's sums (n, yy, lags, xx, xy) to its coefficients, inverse and R2; null where the system is singular."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {"beta": [], "inv": [], "r2": []}
            for r in b.to_pylist():
                xx, xy = np.array(r["xx"], float).reshape(k, k), np.array(r["xy"], float)
                if r["n"] <= k or np.linalg.matrix_rank(xx, hermitian=True) < k:
                    for c in out.values():
                        c.append(None)
                    continue
                beta, tss = np.linalg.solve(xx, xy), r["yy"] - xy[0] ** 2 / r["n"]
                out["beta"].append(beta.tolist())
                out["inv"].append(np.linalg.inv(xx).ravel().tolist())
                out["r2"].append(float(1 - (r["yy"] - beta @ xy) / tss) if tss > 0 else float("nan"))
            kinds = {"beta": pa.list_(pa.float64()), "inv": pa.list_(pa.float64()), "r2": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("n"), b.column("lags"), *(pa.array(v, kinds[c]) for c, v in out.items())], names=[b.schema.names[0], "n", "lags", *out])

    return run


def _terms(names: list[str]):
    """Arrow batches of (key, n, beta, inv, r2, middle) to a row for each term, with its error from inverse * middle * inverse."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {c: [] for c in ("key", "term", "beta", "se", "t", "r2", "n")}
            for key, r in zip(b.column(0).to_pylist(), b.to_pylist(), strict=True):
                beta, se = r["beta"] or [None] * k, [None] * k
                if r["beta"] and r["middle"]:
                    inv = np.array(r["inv"], float).reshape(k, k)
                    se = np.sqrt(np.maximum(np.diag(inv @ np.array(r["middle"], float).reshape(k, k) @ inv), 0)).tolist()
                for name, x, e in zip(names, beta, se, strict=True):
                    for c, v in zip(out, (key, name, x, e, x / e if e else None, r["r2"], r["n"])):
                        out[c].append(v)
            kinds = (b.schema.field(0).type, pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=[b.schema.names[0], *list(out)[1:]])

    return run


def ols_by(df: DataFrame, by: str, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """ols() of each key as rows (by, term, beta, se, t, r2, n), for any number of keys: their sums are tables, and the
    k by k systems are solved in Arrow batches of them.

    Keys with a singular system, as those of too few rows, have null figures.
    """
    names = ["const", *xs]
    k = len(names)
    d = df.select(by, "dt", F.col(y).alias("_y"), F.lit(1.0).alias("const"), *xs).dropna()
    kind = dict(d.dtypes)[by]
    total = lambda pairs: F.array(*(F.sum(F.col(a) * F.col(b)) for a, b in pairs))
    square = [(a, b) for a in names for b in names]
    n = F.count("*")
    sums = d.groupBy(by).agg(n.alias("n"), F.sum(F.col("_y") * F.col("_y")).alias("yy"), (F.floor(4 * F.pow(n / 100, F.lit(2 / 9))) if lags is None else F.lit(lags)).cast("int").alias("lags"), total(square).alias("xx"), total([(a, "_y") for a in names]).alias("xy"))
    fits = save(sums.mapInArrow(_solved(k), f"{by} {kind}, n long, lags int, beta array<double>, inv array<double>, r2 double"), "fits")
    e = d.join(fits.where("beta IS NOT NULL").select(by, "beta", "lags"), by)
    e = e.withColumn("_e", F.col("_y") - sum((F.col(c) * F.col("beta")[i] for i, c in enumerate(names)), F.lit(0.0)))
    scores = e.select(by, "lags", F.row_number().over(W.partitionBy(by).orderBy("dt")).alias("_row"), *((F.col(c) * F.col("_e")).alias(c) for c in names))
    a = scores.withColumn("lag", F.explode(F.sequence(F.lit(0), "lags"))).withColumn("other", F.col("_row") - F.col("lag"))
    b = scores.select(by, F.col("_row").alias("other"), *(F.col(c).alias(f"{c}_o") for c in names))
    weight = F.when(F.col("lag") == 0, 0.5).otherwise(1 - F.col("lag") / (F.col("lags") + 1))
    middle = a.join(b, [by, "other"]).groupBy(by).agg(F.array(*(F.sum(weight * (F.col(p) * F.col(f"{q}_o") + F.col(q) * F.col(f"{p}_o"))) for p, q in square)).alias("middle"))
    rows = fits.join(middle, by, "left").select(by, "n", "beta", "inv", "r2", "middle")
    return rows.mapInArrow(_terms(names), f"{by} {kind}, term string, beta double, se double, t double, r2 double, n long")


def arch_lm(df: DataFrame, lags: int) -> DataFrame:
    """Engle's test on one series: n R2 of squares on their lags."""
    at = W.orderBy("dt")
    d = df.withColumn("e2", F.pow(F.col("ret") - F.avg("ret").over(W.partitionBy()), F.lit(2.0)))
    for k in range(1, lags + 1):
        d = d.withColumn(f"l{k}", F.lag("e2", k).over(at))
    f = ols(d, "e2", [f"l{k}" for k in range(1, lags + 1)])
    out = df.sparkSession.createDataFrame([(float(f["n"] * f["r2"]),)], "lm double")
    return out.select("lm", F.expr(chi2_tail_sql("lm", lags)).alias("p"))


def arch_lm_by(df: DataFrame, lags: int, by: str = BY) -> DataFrame:
    """(by, lm, p): Engle's test of every key."""
    at, names = W.partitionBy(by).orderBy("dt"), [f"l{k}" for k in range(1, lags + 1)]
    d = df.withColumn("e2", F.pow(F.col("ret") - F.avg("ret").over(W.partitionBy(by)), F.lit(2.0)))
    d = d.withColumns({n: F.lag("e2", k).over(at) for k, n in enumerate(names, 1)})
    f = ols_by(d, by, "e2", names).where("term = 'const'").select(by, (F.col("n") * F.col("r2")).alias("lm"))
    return f.select(by, "lm", F.expr(chi2_tail_sql("lm", lags)).alias("p"))


def timing(pair: DataFrame, kind: str) -> DataFrame:
    """Timing regression of x on y: kind hm adds max(0, y), tm adds y squared."""
    extra = F.greatest(F.col("y"), F.lit(0.0)) if kind == "hm" else F.col("y") * F.col("y")
    return ols_table(pair.withColumn("timing", extra), "x", ["y", "timing"])


def benchmark_reg(pair: DataFrame, year: float) -> DataFrame:
    return pair.agg((F.regr_intercept("x", "y") * year).alias("alpha"), F.regr_slope("x", "y").alias("beta"), F.regr_r2("x", "y").alias("r2"))


def corr(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; null where a side is constant."""
    cov = F.avg(x * y) - F.avg(x) * F.avg(y)
    return ratio(cov, F.sqrt(F.greatest((F.avg(x * x) - F.avg(x) ** 2) * (F.avg(y * y) - F.avg(y) ** 2), F.lit(0.0))))


def lag1_audit(df: DataFrame) -> DataFrame:
    d = df.withColumn("p", F.lag("ret").over(W.partitionBy(BY).orderBy("dt"))).where("p IS NOT NULL")
    return d.groupBy(BY).agg(corr(F.col("ret"), F.col("p")).alias("rho"))


def pbo(returns: DataFrame, blocks: int) -> DataFrame:
    """(split, best, oos_rank, logit) of combinatorially symmetric cross-validation.

    A split is a half of the blocks; block sums (n, s, q) by variant are joined to splits and added up on either side,
    so no split reads rows again. pbo is the share of logits of 0 or less.
    """
    w = W.partitionBy(BY).orderBy("dt")
    d = returns.withColumn("block", F.ntile(blocks).over(w) - 1)
    sums = d.groupBy(BY, "block").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    spark = returns.sparkSession
    splits = spark.range(1 << blocks).withColumnRenamed("id", "split").where(F.bit_count("split") == blocks // 2)
    long = splits.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("inside", F.expr("shiftright(split, block) & 1"))
    m = long.join(sums, "block").groupBy("split", "inside", BY).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    m = m.select("split", "inside", BY, F.round(ratio(mean, F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(1e-18)))), 9).alias("sr"))
    best = m.where("inside = 1").groupBy("split").agg(F.min_by(BY, F.struct(-F.col("sr"), BY)).alias("best"))
    out = m.where("inside = 0").join(best, "split")
    ranks = out.groupBy("split", "best").agg(F.max(F.when(F.col(BY) == F.col("best"), F.col("sr"))).alias("mine"), F.collect_list("sr").alias("all"))
    below = F.aggregate("all", F.lit(0.0), lambda a, v: a + F.when(v < F.col("mine"), 1.0).when(v == F.col("mine"), 0.5).otherwise(0.0)) + 0.5
    r = ranks.select("split", "best", (below / (F.size("all") + 1)).alias("oos_rank"))
    return r.withColumn("logit", F.log(F.col("oos_rank") / (1 - F.col("oos_rank"))))


def corr_matrix(df: DataFrame, by: str = BY, x: str = "ret") -> DataFrame:
    """(i, j, n, rho) over common dates, i < j."""
    a = df.select(F.col(by).alias("i"), "dt", F.col(x).alias("x"))
    b = df.select(F.col(by).alias("j"), "dt", F.col(x).alias("y"))
    return a.join(b, "dt").where("i < j").groupBy("i", "j").agg(F.count("*").alias("n"), corr(F.col("x"), F.col("y")).alias("rho"))


def avg_corr(matrix: DataFrame) -> DataFrame:
    both = matrix.select("i", "rho").union(matrix.select(F.col("j"), "rho"))
    return both.groupBy(F.col("i").alias(BY)).agg(F.avg("rho").alias("avg_corr"))


def blend_sharpe(weights: DataFrame, returns: DataFrame, year: float) -> DataFrame:
    """Sharpe ratio of each blend (blend, variant, w) of the returns: w'm / sqrt(w'Sw)."""
    m = returns.groupBy(BY).agg(F.avg("ret").alias("m"), F.var_samp("ret").alias("v"))
    a = returns.select(F.col(BY).alias("i"), "dt", F.col("ret").alias("x"))
    b = returns.select(F.col(BY).alias("j"), "dt", F.col("ret").alias("y"))
    cov = a.join(b, "dt").groupBy("i", "j").agg(F.covar_samp("x", "y").alias("c"))
    wi, wj = weights.select("blend", F.col(BY).alias("i"), F.col("w").alias("wi")), weights.select("blend", F.col(BY).alias("j"), F.col("w").alias("wj"))
    var = wi.join(wj, "blend").join(cov, ["i", "j"]).groupBy("blend").agg(F.sum(F.col("wi") * F.col("wj") * F.col("c")).alias("var"))
    mean = weights.join(m, BY).groupBy("blend").agg(F.sum(F.col("w") * F.col("m")).alias("mean"))
    return mean.join(var, "blend").select("blend", (ratio(F.col("mean"), F.sqrt("var")) * year**0.5).alias("sharpe"))


def satellites(returns: DataFrame, year: float, share: float = 0.1) -> DataFrame:
    """(variant, sharpe, delta, corr): the even blend of all with ``share`` of one more of each in turn, delta over the even blend in percent."""
    keys = returns.select(BY).distinct()
    n = keys.agg(F.count("*").alias("n"))
    even = keys.crossJoin(F.broadcast(n)).select(BY, (1.0 / F.col("n")).alias("w"))
    mixed = keys.select(F.col(BY).alias("blend")).crossJoin(even).withColumn("w", F.col("w") * (1 - share) + F.when(F.col("blend") == F.col(BY), share).otherwise(0.0))
    got = blend_sharpe(mixed.unionByName(even.withColumn("blend", F.lit(""))), returns, year)
    base = got.where("blend = ''").select(F.col("sharpe").alias("base"))
    return got.where("blend <> ''").crossJoin(F.broadcast(base)).select(F.col("blend").alias(BY), "sharpe", ((ratio(F.col("sharpe"), F.col("base")) - 1) * 100).alias("delta"))


def subsets(keys: DataFrame, k: int) -> DataFrame:
    """(blend, variant, w) of all subsets of k keys in equal parts."""
    d = keys.select(F.array(BY).alias("set"), F.col(BY).alias("top"))
    for _ in range(k - 1):
        d = d.join(keys.select(F.col(BY).alias("new")), F.col("new") > F.col("top")).select(F.concat("set", F.array("new")).alias("set"), F.col("new").alias("top"))
    return d.select(F.array_join("set", "+").alias("blend"), F.explode("set").alias(BY), F.lit(1.0 / k).alias("w"))
