"""Comparison of two panels (variant, dt, ret), real and generated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import clip, normal_ppf, ratio
from strandmill.operators.statistics import corr_matrix, lagged_products

BY = "variant"


def qq_mse(a: DataFrame, b: DataFrame, levels: int = 99) -> DataFrame:
    """(variant, mse) of quantiles at equal levels."""
    at = F.array(*(F.lit((k + 1) / (levels + 1)) for k in range(levels)))
    q = lambda d, n: d.groupBy(BY).agg(F.percentile("ret", at).alias(n))
    d = q(a, "p").join(q(b, "q"), BY)
    return d.select(BY, (F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / levels).alias("mse"))


def corr_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Frobenius, mean and largest difference of correlation matrices."""
    d = corr_matrix(a).select("i", "j", F.col("rho").alias("p")).join(corr_matrix(b).select("i", "j", F.col("rho").alias("q")), ["i", "j"])
    gap = F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    return d.agg(F.sqrt(2 * F.sum(gap * gap)).alias("frobenius"), F.avg(F.abs(gap)).alias("mean"), F.max(F.abs(gap)).alias("most"))


def acf(df: DataFrame, lags: int, x: str = "ret") -> DataFrame:
    g = lagged_products(df, x, lags)
    zero = g.where("lag = 0").select(BY, F.col("s").alias("s0"))
    return g.where("lag > 0").join(zero, BY).select(BY, "lag", ratio(F.col("s"), F.col("s0")).alias("rho"))


def acf_distance(a: DataFrame, b: DataFrame, lags: int = 20) -> DataFrame:
    """(variant, plain, squares): mean absolute difference of autocorrelations of x and of x squared."""
    out = None
    for name, expr in (("plain", F.col("ret")), ("squares", F.col("ret") * F.col("ret"))):
        p, q = (acf(d.withColumn("ret", expr), lags).withColumnRenamed("rho", n) for d, n in ((a, "p"), (b, "q")))
        one = p.join(q, [BY, "lag"]).groupBy(BY).agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias(name))
        out = one if out is None else out.join(one, BY)
    return out


def eigen_compare(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """(rank, real, made): largest eigenvalues of the correlation matrices, by Spark's PCA on scaled columns."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler

    def values(df: DataFrame) -> list[float]:
        names = sorted(r[BY] for r in df.select(BY).distinct().collect())
        wide = df.groupBy("dt").pivot(BY, names).agg(F.first("ret")).dropna()
        v = VectorAssembler(inputCols=names, outputCol="v").transform(wide)
        s = StandardScaler(inputCol="v", outputCol="s", withMean=True).fit(v).transform(v)
        model = PCA(k=min(k, len(names)), inputCol="s", outputCol="o").fit(s)
        return [float(x) * len(names) for x in model.explainedVariance.toArray()]

    rows = [(i + 1, x, y) for i, (x, y) in enumerate(zip(values(a), values(b), strict=True))]
    return a.sparkSession.createDataFrame(rows, "rank int, real double, made double")


def moments(df: DataFrame) -> DataFrame:
    return df.groupBy(BY).agg(F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.skewness("ret").alias("skew"), F.kurtosis("ret").alias("kurt"))


def kurtosis_check(a: DataFrame, b: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(variant, ratio, ok) of kurtoses, the normal's 3 included."""
    d = moments(a).select(BY, (F.col("kurt") + 3).alias("p")).join(moments(b).select(BY, (F.col("kurt") + 3).alias("q")), BY)
    r = ratio(F.col("q"), F.col("p"))
    return d.select(BY, r.alias("ratio"), F.coalesce(r.between(low, high), F.lit(False)).alias("ok"))


def robust_fit(df: DataFrame) -> DataFrame:
    """(variant, median, scale): interquartile range, or the deviation where that vanishes."""
    q = lambda p: F.percentile("ret", F.lit(p))
    return df.groupBy(BY).agg(q(0.5).alias("median"), F.when(q(0.75) - q(0.25) > 1e-12, q(0.75) - q(0.25)).otherwise(F.stddev_pop("ret")).alias("scale"))


def robust_scale(df: DataFrame, most: float = 10.0) -> DataFrame:
    """x: (ret - median) / scale, clipped at ``most`` and divided by it."""
    return df.join(robust_fit(df), BY).withColumn("x", clip(ratio(F.col("ret") - F.col("median"), F.col("scale")), -most, most) / most).drop("median", "scale")


def robust_unscale(df: DataFrame, fit: DataFrame, most: float = 10.0) -> DataFrame:
    return df.join(fit, BY).withColumn("ret", F.col("x") * most * F.col("scale") + F.col("median")).drop("median", "scale")


def quantile_inverse(scores: DataFrame, originals: DataFrame) -> DataFrame:
    """scores (variant, dt, p) with ret, the p-quantile of the variant's originals by linear interpolation between sorted values.

    The two neighbours of a quantile are joined by their rank.
    """
    w = W.partitionBy(BY)
    s = originals.select(BY, "ret", F.row_number().over(w.orderBy("ret")).alias("rank"), F.count("*").over(w).alias("n"), F.lead("ret").over(w.orderBy("ret")).alias("next"))
    sizes = originals.groupBy(BY).agg(F.count("*").alias("n"))
    at = scores.join(sizes, BY).withColumn("spot", F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)) * (F.col("n") - 1)).withColumn("rank", F.floor("spot").cast("int") + 1).drop("n")
    d = at.join(s.select(BY, "rank", "ret", "next"), [BY, "rank"])
    return d.select(BY, "dt", "p", (F.col("ret") + F.coalesce(F.col("next") - F.col("ret"), F.lit(0.0)) * (F.col("spot") - F.floor("spot"))).alias("ret"))


def normal_score(df: DataFrame) -> DataFrame:
    """score: normal quantile of the mean rank over n + 1."""
    w = W.partitionBy(BY)
    low, ties = F.rank().over(w.orderBy("ret")), F.count("*").over(W.partitionBy(BY, "ret"))
    d = df.withColumn("u", (low + (ties - 1) / 2) / (F.count("*").over(w) + 1))
    return d.withColumn("score", normal_ppf("u")).drop("u")
