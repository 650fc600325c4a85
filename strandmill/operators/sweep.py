"""Stresses of scores and of variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandmill.functions.scalars import cap, normal_ppf, ratio
from strandmill.operators.bootstrap import hash_sql, uniform_sql
from strandmill.operators.recursive import alpha_of, ewm_means

def feature_library(bars: DataFrame, spans: list[int]) -> DataFrame:
    """(symbol, dt, span, v): exponentially weighted means at all spans that any variant needs, made once, in the same windows."""
    spans = sorted(set(spans))
    d = ewm_means(bars, {f"_m{s}": ("close", alpha_of(span=s)) for s in spans})
    rows = F.array(*(F.struct(F.lit(s).alias("span"), F.col(f"_m{s}").alias("v")) for s in spans))
    return d.select("symbol", "dt", F.inline(rows))


def lag_scores(signals: DataFrame, x: str, k: int) -> DataFrame:
    return signals.withColumn(x, F.coalesce(F.lag(x, k).over(W.partitionBy("symbol").orderBy("dt")), F.lit(0.0)))


def jackknife(returns: DataFrame) -> DataFrame:
    """(variant, dt, ret): mean over symbols without one, by the symbol dropped: sums less its own part, so no set is made."""
    d = returns.groupBy("dt").agg(F.sum("ret").alias("s"), F.count("ret").alias("n"))
    keys = returns.select(F.col("symbol").alias("variant")).distinct()
    own = returns.select(F.col("symbol").alias("variant"), "dt", F.col("ret").alias("own"))
    g = keys.crossJoin(d).join(own, ["variant", "dt"], "left")
    return g.select("variant", "dt", ratio(F.col("s") - F.coalesce("own", F.lit(0.0)), F.col("n") - F.col("own").isNotNull().cast("int")).alias("ret"))


def add_noise(signals: DataFrame, x: str, levels: list[float], seed: int, most: float = 20.0) -> DataFrame:
    """Scores with normal noise of each level times the symbol's deviation, capped; needs an integer row number ``rn``."""
    sd = F.stddev_samp(x).over(W.partitionBy("symbol"))
    d = signals.withColumn("sd", sd).withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    d = d.withColumn("u", F.expr(uniform_sql(seed, "rn", "cast(level * 1000 as bigint)")))
    return d.withColumn(x, cap(F.col(x) + F.col("level") * F.col("sd") * normal_ppf("u"), most)).drop("sd", "u")


def scale_scores(signals: DataFrame, x: str, ks: list[float], most: float = 20.0) -> DataFrame:
    return signals.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn(x, cap(F.col(x) * F.col("k"), most))


def shuffle_scores(signals: DataFrame, x: str, draws: int, seed: int) -> DataFrame:
    """(draw, symbol, dt, x): scores permuted in time within a symbol, by hash; needs an integer ``rn`` within the symbol."""
    d = signals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = W.partitionBy("draw", "symbol")
    new = d.withColumn("h", F.expr(hash_sql(seed, "rn", "draw"))).withColumn("place", F.row_number().over(at.orderBy("h", "rn")))
    old = d.select("draw", "symbol", "dt", F.row_number().over(at.orderBy("rn")).alias("place"))
    return old.join(new.select("draw", "symbol", "place", x), ["draw", "symbol", "place"]).select("draw", "symbol", "dt", x)


def noise_scores(signals: DataFrame, x: str, draws: int, seed: int, most: float = 20.0) -> DataFrame:
    """(draw, symbol, dt, x): normal noise of the symbol's mean and deviation in place of its scores, capped; needs an integer ``rn``."""
    w = W.partitionBy("symbol")
    d = signals.withColumns({"_mean": F.avg(x).over(w), "_sd": F.stddev_samp(x).over(w)}).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return d.withColumn(x, cap(F.col("_mean") + F.col("_sd") * normal_ppf(uniform_sql(seed, "rn", "draw")), most)).select("draw", "symbol", "dt", x)


def fragility(summary: DataFrame, k: int = 3) -> DataFrame:
    """(dim, gap) of the k axes with the largest gap between neighbouring variants' Sharpe ratios."""
    g = F.lead("sharpe").over(W.partitionBy("dim").orderBy("sharpe", "variant")) - F.col("sharpe")
    return summary.select("dim", g.alias("gap")).where("gap IS NOT NULL").groupBy("dim").agg(F.max("gap").alias("gap")).orderBy(F.col("gap").desc(), "dim").limit(k)


def hidden_damage(full: DataFrame, parts: DataFrame, least: float = -0.02) -> DataFrame:
    """Variants that hold over all but fall in a part: (variant, name, delta, part_delta)."""
    return full.join(parts, "variant").where((F.col("delta") > least) & (F.col("part_delta") < least))


def interaction(combos: DataFrame, singles: DataFrame) -> DataFrame:
    """Effect of a combination (combo, delta, parts) beyond the sum of its parts' own."""
    s = combos.select("combo", F.explode("parts").alias("variant")).join(singles, "variant").groupBy("combo").agg(F.sum("delta").alias("sum"))
    return combos.join(s, "combo").select("combo", (F.col("delta") - F.col("sum")).alias("interaction"))
