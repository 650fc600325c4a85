"""Queries of statistics, bootstraps, panel comparison and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scalars as S
from strandmill.operators import bootstrap as B
from strandmill.operators import compare as C
from strandmill.operators import cross_section as X
from strandmill.operators import ledger as L
from strandmill.operators import statistics as T
from strandmill.operators import windows as O
from strandmill.plans.panel_queries import PAIR, last, two
from strandmill.plans.registry import query, rounded
from strandmill.sources import panels as P

V, YEAR = "variant", 52.0
ST = ("strategies",)
MOM = "mo AS (SELECT variant, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, avg(ret) / stddev_samp(ret) AS sr, (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * power(avg(ret), 3)) / power(var_pop(ret), 1.5) AS skew, kurtosis_pop(ret) + 3 AS kurt FROM strategies GROUP BY 1)"
LAGS = "dv AS (SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY dt) AS rn, ret - avg(ret) OVER (PARTITION BY variant) AS u, count(*) OVER (PARTITION BY variant) AS n FROM strategies), lp AS (SELECT a.variant, a.rn - b.rn AS lag, max(a.n) AS n, sum(a.u * b.u) AS s FROM dv a JOIN dv b ON a.variant = b.variant AND a.rn - b.rn BETWEEN 0 AND 51 GROUP BY 1, 2)"
NW = ", nwl AS (SELECT *, floor(0.75 * power(n, 1 / 3.0::DOUBLE) + 0.000000001) AS most FROM lp), nw AS (SELECT variant, max(n) AS n, sqrt(greatest(sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (most + 1)) END * s), 0) / max(n) / max(n)) AS se FROM nwl WHERE lag <= most GROUP BY 1)"


def strategies(spark, d):
    return P.strategies(spark, d)


def ols_sql(table: str, y: str, xs: list[str], key: str | None = None, lags: int | None = None) -> str:
    """SQL of (key, term, beta, se, t, r2, n) of least squares of y on a constant and xs with Newey-West errors.

    Each term in turn is made orthogonal to all others, one by one; what is left of it gives its coefficient, and its
    products with the residual the error.
    """
    k = f"{key}, " if key else ""
    w = f"(PARTITION BY {key})" if key else "()"
    terms, parts = ["const", *xs], []
    least = f"WHERE {y} IS NOT NULL" + "".join(f" AND {x} IS NOT NULL" for x in xs)
    for term in terms:
        q = f"(SELECT {k}dt, {y}::DOUBLE AS y0, 1.0::DOUBLE AS const, {', '.join(f'{x}::DOUBLE AS {x}' for x in xs)} FROM {table} {least})"
        made: list[str] = []
        for c in [*(x for x in terms if x != term), term, "y0"]:
            left = c + "".join(f" - sum({c} * q_{m}) OVER {w} / nullif(sum(q_{m} * q_{m}) OVER {w}, 0) * q_{m}" for m in made)
            q = f"(SELECT *, {left} AS q_{c} FROM {q})"
            made.append(c)
        rows = f"SELECT {k}row_number() OVER ({f'PARTITION BY {key} ' if key else ''}ORDER BY dt) AS rn, count(*) OVER {w} AS n, q_{term} AS r, y0, q_y0 AS e, q_{term} * q_y0 AS u FROM {q}"
        on = f"a.{key} = b.{key} AND " if key else ""
        most = "4 * power(n / 100.0::DOUBLE, 2 / 9.0::DOUBLE)" if lags is None else str(lags)
        gamma = f"SELECT {f'a.{key}, ' if key else ''}a.rn - b.rn AS lag, max(a.m) AS m, sum(a.u * b.u) AS s FROM (SELECT *, floor({most}) AS m FROM x) a JOIN x b ON {on}a.rn - b.rn BETWEEN 0 AND a.m GROUP BY {'1, 2' if key else '1'}"
        hac = f"SELECT {k}sum(CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (m + 1)) END * s) AS s FROM g GROUP BY ALL"
        using = f"USING ({key})" if key else "ON true"
        parts.append(f"SELECT {f'f.{key}, ' if key else ''}'{term}' AS term, sry / srr AS beta, sqrt(greatest(h.s, 0)) / srr AS se, 1 - rss / nullif(tss, 0) AS r2, n FROM (WITH x AS ({rows}), g AS ({gamma}) {hac}) h JOIN (SELECT {k}sum(r * y0) AS sry, sum(r * r) AS srr, sum(e * e) AS rss, count(*) * var_pop(y0) AS tss, count(*) AS n FROM ({rows}) GROUP BY ALL) f {using}")
    return " UNION ALL ".join(parts)


def ols_rows(sql: str, key: str | None = None) -> str:
    return f"SELECT {f'{key}, ' if key else ''}term, round(beta, 6) + 0.0 AS beta, round(se, 6) AS se, round(beta / nullif(se, 0), 6) + 0.0 AS t, round(r2, 6) AS r2, n FROM ({sql})"


def over(name: str, make, sql: str | None, more: str = "", keys: tuple = (V,), digits: int = 6) -> None:
    @query(name, ST, sql, more)
    def _(spark, d):
        return rounded(make(strategies(spark, d)), *keys, digits=digits)


def on_pair(name: str, make, sql: str | None = None, keys: tuple = ()) -> None:
    @query(name, ST, sql, PAIR)
    def _(spark, d):
        return rounded(make(two(spark, d)), *keys)


def p2(z: str) -> str:
    return f"2 * (1 - {S.normal_cdf_sql(f'abs({z})')})"


over("st01_nw_se", T.nw_se, "SELECT variant, n, round(se, 6) AS se FROM nw", LAGS + NW)
over("st02_sharpe_hac", lambda s: T.sharpe_hac(s, YEAR), f"SELECT variant, n, round(sharpe, 6) + 0.0 AS sharpe, round(sharpe_se, 6) AS sharpe_se, round(t, 6) + 0.0 AS t, round({p2('t')}, 6) AS p FROM (SELECT variant, nw.n, sr * sqrt(52) AS sharpe, se / sd * sqrt(52) AS sharpe_se, mean / se AS t FROM mo JOIN nw USING (variant))", MOM + ", " + LAGS + NW)
JKM = "SELECT {k} n, round((a - b) * sqrt(52), 6) + 0.0 AS diff, round(z, 6) + 0.0 AS z, round(" + p2("z") + ", 6) AS p FROM (SELECT *, (a - b) / sqrt((2 - 2 * rho + 0.5 * (a * a + b * b - 2 * a * b * rho * rho)) / n) AS z FROM (SELECT {k} count(*) AS n, avg(x) / stddev_pop(x) AS a, avg(y) / stddev_pop(y) AS b, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS rho FROM {t} {g}))"
on_pair("st03_jkm", lambda p: T.jkm(p, YEAR), JKM.format(k="", t="pair", g=""))
on_pair("st03_jkm_years", lambda p: T.jkm(p.withColumn("yr", F.year("dt")), YEAR, ("yr",)), JKM.format(k="yr,", t="(SELECT year(dt)::INT AS yr, x, y FROM pair)", g="GROUP BY 1"), ("yr",))
SR0 = f"(0.05e0 * ((1 - 0.5772156649015329e0) * {S.normal_ppf_sql(repr(1 - 1 / 100) + 'e0')} + 0.5772156649015329e0 * {S.normal_ppf_sql(repr(1 - 1 / (100 * 2.718281828459045)) + 'e0')}))"
over("st04_deflated_sharpe", lambda s: T.deflated_sharpe(s, 100, 0.05), f"SELECT variant, round(sr, 6) + 0.0 AS sr, round(sr0, 6) AS sr0, round({S.normal_cdf_sql('z')}, 6) AS dsr FROM (SELECT *, (sr - sr0) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z FROM (SELECT *, {SR0} AS sr0 FROM mo))", MOM)
over("st05_lo_sharpe", lambda s: T.lo_sharpe(s, 12), "SELECT variant, round(sr * sqrt(12), 6) + 0.0 AS plain, round(sr * 12 / sqrt(greatest(12 + 2 * w, 0.000000001)), 6) + 0.0 AS adjusted FROM mo JOIN (SELECT variant, sum((12 - lag) * s / s0) AS w FROM lp JOIN (SELECT variant, s AS s0 FROM lp WHERE lag = 0) USING (variant) WHERE lag BETWEEN 1 AND 11 GROUP BY 1) USING (variant)", MOM + ", " + LAGS)
over("st06_mertens", lambda s: T.mertens(s, YEAR), "SELECT variant, round(sr * sqrt(52), 6) + 0.0 AS sharpe, round(e * sqrt(52), 6) AS se, round(sr / e, 6) + 0.0 AS t FROM (SELECT *, sqrt((1 + 0.5 * sr * sr - skew * sr + (kurt - 3) / 4 * sr * sr) / n) AS e FROM mo)", MOM)
over("st07_min_trl", lambda s: T.min_trl(s, [0.0, 0.01]), f"SELECT variant, bench, CASE WHEN sr > bench THEN round(1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * power({S.normal_ppf_sql('0.95e0')} / (sr - bench), 2), 6) END AS rows FROM mo CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.01]) AS bench)", MOM, (V, "bench"))
over("st08_haircut", lambda s: T.haircut(s, YEAR), f"SELECT variant, round(t, 6) + 0.0 AS t, round(p, 6) AS p, round(least(m * p, 1), 6) AS bonferroni, round(least(max((m - k + 1) * p) OVER (ORDER BY k), 1), 6) AS holm, round(least(min(m * c / k * p) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS bhy FROM (SELECT *, count(*) OVER () AS m, sum(1.0::DOUBLE / k) OVER () AS c FROM (SELECT *, row_number() OVER (ORDER BY p, variant) AS k FROM (SELECT variant, t, {p2('t')} AS p FROM (SELECT variant, sr * sqrt(n) AS t FROM mo))))", MOM)
over("st09_jarque_bera", T.jarque_bera, "SELECT variant, round(jb, 6) AS jb, round(exp(-jb / 2), 6) AS p FROM (SELECT variant, n / 6.0::DOUBLE * (skew * skew + power(kurt - 3, 2) / 4) AS jb FROM mo)", MOM)
over("st10_ljung_box_squares", lambda s: T.ljung_box(s.withColumn("ret", F.col("ret") * F.col("ret")), 20), f"SELECT variant, round(q, 6) AS q, round({S.chi2_tail_sql('q', 20)}, 6) AS p FROM (SELECT variant, max(n) * (max(n) + 2) * sum(power(s / s0, 2) / (n - lag)) AS q FROM lp JOIN (SELECT variant, s AS s0 FROM lp WHERE lag = 0) USING (variant) WHERE lag BETWEEN 1 AND 20 GROUP BY 1)", LAGS.replace("ret - avg(ret)", "ret * ret - avg(ret * ret)"))
over("st10_ljung_box", lambda s: T.ljung_box(s, 20), f"SELECT variant, round(q, 6) AS q, round({S.chi2_tail_sql('q', 20)}, 6) AS p FROM (SELECT variant, max(n) * (max(n) + 2) * sum(power(s / s0, 2) / (n - lag)) AS q FROM lp JOIN (SELECT variant, s AS s0 FROM lp WHERE lag = 0) USING (variant) WHERE lag BETWEEN 1 AND 20 GROUP BY 1)", LAGS)


LAGGED = PAIR + ", e2 AS (SELECT dt, power(x - avg(x) OVER (), 2) AS e2 FROM pair), al AS (SELECT dt, e2, " + ", ".join(f"lag(e2, {k}) OVER (ORDER BY dt) AS l{k}" for k in range(1, 6)) + " FROM e2)"


@query("st11_arch_lm", ST, f"SELECT round(lm, 6) AS lm, round({S.chi2_tail_sql('lm', 5)}, 6) AS p FROM (SELECT max(n) * max(r2) AS lm FROM ({ols_sql('al', 'e2', [f'l{k}' for k in range(1, 6)])}))", LAGGED)
def _(spark, d):
    return rounded(T.arch_lm(two(spark, d).select("dt", F.col("x").alias("ret")), 5))


#: Engle's test of each strategy in turn.
EACH = "en AS (SELECT variant, row_number() OVER (ORDER BY variant) AS k FROM (SELECT DISTINCT variant FROM strategies)), ee AS (SELECT k, dt, power(ret - avg(ret) OVER (PARTITION BY variant), 2) AS e2 FROM strategies JOIN en USING (variant)), el AS (SELECT *, " + ", ".join(f"lag(e2, {j}) OVER (PARTITION BY k ORDER BY dt) AS l{j}" for j in range(1, 6)) + " FROM ee), " + ", ".join(f"el{k} AS (SELECT * FROM el WHERE k = {k})" for k in range(1, 7))
EACH_LM = " UNION ALL ".join(f"SELECT {k} AS k, max(n) * max(r2) AS lm FROM ({ols_sql(f'el{k}', 'e2', [f'l{j}' for j in range(1, 6)])})" for k in range(1, 7))
over("st11_arch_lm_all", lambda s: T.arch_lm_by(s, 5), f"SELECT variant, round(lm, 6) AS lm, round({S.chi2_tail_sql('lm', 5)}, 6) AS p FROM ({EACH_LM}) JOIN en USING (k)", EACH)
on_pair("st12_ols_hac", lambda p: T.ols_table(p, "x", ["y"]), ols_rows(ols_sql("pair", "x", ["y"])), ("term",))

FACTORS = "fnames AS (SELECT variant, row_number() OVER (ORDER BY variant) AS k FROM (SELECT DISTINCT variant FROM strategies)), months AS (SELECT variant, CAST(date_trunc('month', dt) AS DATE) AS dt, sum(ret) AS ret FROM strategies GROUP BY 1, 2), fac AS (SELECT dt, " + ", ".join(f"max(CASE WHEN k = {j + 2} THEN ret END) AS f{j}" for j in range(3)) + " FROM months JOIN fnames USING (variant) WHERE k BETWEEN 2 AND 4 GROUP BY 1), fm AS (SELECT variant, m.dt, ret, f0, f1, f2 FROM months m JOIN fnames USING (variant) JOIN fac USING (dt) WHERE k NOT BETWEEN 2 AND 4)"


@query("st13_factor_regression", ST, ols_rows(ols_sql("fm", "ret", ["f0", "f1", "f2"], "variant"), "variant"), FACTORS)
def _(spark, d):
    wide = strategies(spark, d).groupBy(F.trunc("dt", "month").alias("dt")).pivot(V).agg(F.sum("ret"))
    names = [c for c in wide.columns if c != "dt"]
    factors = wide.select("dt", *(F.col(f"`{c}`").alias(f"f{k}") for k, c in enumerate(names[1:4])))
    months = strategies(spark, d).groupBy(V, F.trunc("dt", "month").alias("dt")).agg(F.sum("ret").alias("ret")).where(~F.col(V).isin(names[1:4]))
    return rounded(T.ols_by(months.join(factors, "dt"), V, "ret", [c for c in factors.columns if c != "dt"]), V, "term")


on_pair("st14_henriksson_merton", lambda p: T.timing(p, "hm"), ols_rows(ols_sql("(SELECT *, greatest(y, 0) AS timing FROM pair)", "x", ["y", "timing"])), ("term",))
on_pair("st14_treynor_mazuy", lambda p: T.timing(p, "tm"), ols_rows(ols_sql("(SELECT *, y * y AS timing FROM pair)", "x", ["y", "timing"])), ("term",))
on_pair("st15_benchmark_reg", lambda p: T.benchmark_reg(p, YEAR), "SELECT round(regr_intercept(x, y) * 52, 6) + 0.0 AS alpha, round(regr_slope(x, y), 6) + 0.0 AS beta, round(regr_r2(x, y), 6) AS r2 FROM pair")
over("st16_lag1_audit", T.lag1_audit, "SELECT variant, round(corr(ret, p), 6) AS rho FROM (SELECT variant, ret, lag(ret) OVER (PARTITION BY variant ORDER BY dt) AS p FROM strategies) WHERE p IS NOT NULL GROUP BY 1")
SPLITS = (
    "blk AS (SELECT variant, ntile(16) OVER (PARTITION BY variant ORDER BY dt) - 1 AS block, ret FROM strategies), bsum AS (SELECT variant, block, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM blk GROUP BY 1, 2), "
    "sp AS (SELECT split FROM (SELECT unnest(range(65536)) AS split) WHERE bit_count(split) = 8), "
    "side AS (SELECT split, (split >> block) & 1 AS inside, variant, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM sp CROSS JOIN bsum GROUP BY 1, 2, 3), "
    "srs AS (SELECT split, inside, variant, round(s / n / sqrt(greatest(q / n - (s / n) * (s / n), 1e-18)), 9) AS sr FROM side), "
    "bst AS (SELECT split, arg_min(variant, (-sr, variant)) AS best FROM srs WHERE inside = 1 GROUP BY 1), "
    "mine AS (SELECT b.split, b.best, s.sr FROM bst b JOIN srs s ON s.split = b.split AND s.inside = 0 AND s.variant = b.best), "
    "oos AS (SELECT m.split, m.best, (sum(CASE WHEN s.sr < m.sr THEN 1.0 WHEN s.sr = m.sr THEN 0.5 ELSE 0 END) + 0.5)::DOUBLE / (count(*) + 1) AS oos_rank FROM mine m JOIN srs s ON s.split = m.split AND s.inside = 0 GROUP BY 1, 2)"
)
over("st17_pbo", lambda s: T.pbo(s, 16), "SELECT split, best, round(oos_rank, 6) AS oos_rank, round(ln(oos_rank / (1 - oos_rank)), 6) + 0.0 AS logit FROM oos", SPLITS, keys=("split", "best"))
over("st18_cash_attr", lambda s: s.groupBy(V).agg((F.avg("ret") / F.stddev_samp("ret") * YEAR**0.5).alias("gross"), ((F.avg("ret") - 0.0005) / F.stddev_samp("ret") * YEAR**0.5).alias("excess")), "SELECT variant, round(avg(ret) / stddev_samp(ret) * sqrt(52), 6) + 0.0 AS gross, round((avg(ret) - 0.0005) / stddev_samp(ret) * sqrt(52), 6) + 0.0 AS excess FROM strategies GROUP BY 1")
over("st19_holdout", lambda s: L.tearsheet(s.where("dt >= DATE'2000-01-01'"), YEAR).select(V, "n", "ann_ret", "sharpe"), "SELECT variant, count(*) AS n, round(avg(ret) * 52, 6) + 0.0 AS ann_ret, round(avg(ret) / stddev_pop(ret) * sqrt(52), 6) + 0.0 AS sharpe FROM strategies WHERE dt >= DATE '2000-01-01' GROUP BY 1")
COV = "cv AS (SELECT a.variant AS i, b.variant AS j, covar_samp(a.ret, b.ret) AS c FROM strategies a JOIN strategies b USING (dt) GROUP BY 1, 2), mu AS (SELECT variant, avg(ret) AS m FROM strategies GROUP BY 1)"


def pairs_of(s):
    return T.blend_sharpe(T.subsets(s.select(V).distinct(), 2), s, YEAR)


over("st20_blend_sharpe", pairs_of, "SELECT a.variant || '+' || b.variant AS blend, round((a.m + b.m) / 2 / sqrt((x.c + y.c + 2 * z.c) / 4) * sqrt(52), 6) + 0.0 AS sharpe FROM mu a JOIN mu b ON a.variant < b.variant JOIN cv x ON x.i = a.variant AND x.j = a.variant JOIN cv y ON y.i = b.variant AND y.j = b.variant JOIN cv z ON z.i = a.variant AND z.j = b.variant", COV, ("blend",))


over("st20_satellites", lambda s: T.satellites(s, YEAR), "SELECT variant, round((0.9 * m0 + 0.1 * m) / sqrt(0.81 * v0 + 2 * 0.09 * c0 + 0.01 * v) * sqrt(52), 6) + 0.0 AS sharpe, round(((0.9 * m0 + 0.1 * m) / sqrt(0.81 * v0 + 2 * 0.09 * c0 + 0.01 * v) / nullif(m0 / sqrt(v0), 0) - 1) * 100, 6) + 0.0 AS delta FROM mu JOIN (SELECT i AS variant, avg(c) AS c0, max(CASE WHEN i = j THEN c END) AS v FROM cv GROUP BY 1) USING (variant) CROSS JOIN (SELECT avg(m) AS m0 FROM mu) CROSS JOIN (SELECT avg(c) AS v0 FROM cv)", COV)


def best_by_size(s):
    keys = s.select(V).distinct()
    every = None
    for k in (1, 2, 3):
        one = T.blend_sharpe(T.subsets(keys, k), s, YEAR).withColumn("k", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("k").agg(F.max_by("blend", F.struct(F.round("sharpe", 9), "blend")).alias("blend"), F.max("sharpe").alias("sharpe"))


TRIPLES = (
    COV + ", k1 AS (SELECT variant AS blend, m / sqrt(c) * sqrt(52) AS sharpe FROM mu JOIN cv ON i = variant AND j = variant), "
    "k2 AS (SELECT a.variant || '+' || b.variant AS blend, (a.m + b.m) / 2 / sqrt((x.c + y.c + 2 * z.c) / 4) * sqrt(52) AS sharpe FROM mu a JOIN mu b ON a.variant < b.variant JOIN cv x ON x.i = a.variant AND x.j = a.variant JOIN cv y ON y.i = b.variant AND y.j = b.variant JOIN cv z ON z.i = a.variant AND z.j = b.variant), "
    "k3 AS (SELECT a.variant || '+' || b.variant || '+' || e.variant AS blend, (a.m + b.m + e.m) / 3 / sqrt((va.c + vb.c + ve.c + 2 * (ab.c + ae.c + be.c)) / 9) * sqrt(52) AS sharpe FROM mu a JOIN mu b ON a.variant < b.variant JOIN mu e ON b.variant < e.variant JOIN cv va ON va.i = a.variant AND va.j = a.variant JOIN cv vb ON vb.i = b.variant AND vb.j = b.variant JOIN cv ve ON ve.i = e.variant AND ve.j = e.variant JOIN cv ab ON ab.i = a.variant AND ab.j = b.variant JOIN cv ae ON ae.i = a.variant AND ae.j = e.variant JOIN cv be ON be.i = b.variant AND be.j = e.variant)"
)
over("st21_best_subset", best_by_size, " UNION ALL ".join(f"SELECT {k} AS k, arg_max(blend, (round(sharpe, 9), blend)) AS blend, round(max(sharpe), 6) + 0.0 AS sharpe FROM k{k}" for k in (1, 2, 3)), TRIPLES, keys=("k", "blend"))


SIMPLEX = 1000


def simplex(s):
    """Where the even blend stands among blends of random weights: minus logs of uniforms, normalised."""
    keys = s.select(V).distinct()
    names = keys.select(V, F.dense_rank().over(O.W.orderBy(V)).alias("i"))
    w = names.crossJoin(s.sparkSession.range(SIMPLEX).withColumnRenamed("id", "draw")).withColumn("e", -F.log(F.expr(B.uniform_sql(3, "draw", "i"))))
    w = w.select(F.col("draw").cast("string").alias("blend"), V, (F.col("e") / F.sum("e").over(O.W.partitionBy("draw"))).alias("w"))
    even = names.select(F.lit("even").alias("blend"), V, (1.0 / F.count("*").over(O.W.partitionBy())).alias("w"))
    got = T.blend_sharpe(w.unionByName(even), s, YEAR)
    base = got.where("blend = 'even'").select(F.col("sharpe").alias("base"))
    return got.where("blend <> 'even'").crossJoin(base).agg(F.count("*").alias("draws"), F.max("base").alias("base"), (F.avg((F.col("sharpe") < F.col("base")).cast("double")) * 100).alias("percentile"), F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("sd"))


DRAWN = (
    f"vk AS (SELECT variant, row_number() OVER (ORDER BY variant) AS i FROM (SELECT DISTINCT variant FROM strategies)), ex AS (SELECT draw, variant, -ln({B.uniform_sql(3, 'draw', 'i')}) AS e FROM vk CROSS JOIN (SELECT unnest(range({SIMPLEX})) AS draw)), "
    "wt AS (SELECT draw, variant, e / sum(e) OVER (PARTITION BY draw) AS w FROM ex UNION ALL SELECT -1, variant, 1.0::DOUBLE / count(*) OVER () FROM vk), "
    "wv AS (SELECT a.draw, sum(a.w * b.w * c) AS v FROM wt a JOIN wt b ON a.draw = b.draw JOIN cv ON i = a.variant AND j = b.variant GROUP BY 1), "
    "wm AS (SELECT draw, sum(w * m) AS m FROM wt JOIN mu USING (variant) GROUP BY 1), wsr AS (SELECT draw, m / sqrt(v) * sqrt(52) AS sr FROM wm JOIN wv USING (draw))"
)
over("st22_random_simplex", simplex, "SELECT count(*) AS draws, round(max(base), 6) + 0.0 AS base, round(avg(CASE WHEN sr < base THEN 1.0 ELSE 0 END) * 100, 6) AS percentile, round(avg(sr), 6) + 0.0 AS mean, round(stddev_samp(sr), 6) AS sd FROM wsr CROSS JOIN (SELECT sr AS base FROM wsr WHERE draw = -1) WHERE draw >= 0", COV + ", " + DRAWN, keys=("draws",))
on_pair("st27_alpha_drift", lambda p: p.withColumn("variant", F.lit("v")).withColumn("a", F.regr_intercept("x", "y").over(O.w(52, by="variant"))).withColumn("q", F.ntile(5).over(O.series("variant"))).groupBy("q").agg(F.avg("a").alias("alpha")), f"SELECT q, round(avg(a), 6) + 0.0 AS alpha FROM (SELECT regr_intercept(x, y) OVER (ORDER BY dt ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS a, ntile(5) OVER (ORDER BY dt) AS q FROM pair) GROUP BY 1", ("q",))

# --- bootstraps ------------------------------------------------------------------------------------------------------

DRAWS, BLOCK, SEED = 200, 8, 17  # of queries with SQL; the whole job has FULL draws
FULL = 5000
N_SQL = "(SELECT count(*) FROM pair)"
def index_sql(draws: int) -> str:
    return INDEX.replace(f"range({DRAWS})", f"range({draws})")


INDEX = PAIR + f", prn AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS r FROM pair), starts AS (SELECT d AS draw, b, {B.hash_sql(SEED, 'd', 'b')} % {N_SQL} AS st FROM (SELECT unnest(range({DRAWS})) AS d) CROSS JOIN (SELECT unnest(range(CAST(ceil({N_SQL} / {BLOCK}.0) AS BIGINT))) AS b)), ix AS (SELECT draw, b * {BLOCK} + j AS place, (st + j) % {N_SQL} AS r FROM starts CROSS JOIN (SELECT unnest(range({BLOCK})) AS j) WHERE b * {BLOCK} + j < {N_SQL}), bs AS (SELECT draw, place, x, y FROM ix JOIN prn USING (r))"


def interval_sql(x: str, table: str) -> str:
    return f"SELECT count({x}) AS draws, round(quantile_cont({x}, 0.025), 6) + 0.0 AS low, round(quantile_cont({x}, 0.975), 6) + 0.0 AS high, round(avg(CASE WHEN {x} <= 0 THEN 1.0 ELSE 0.0 END), 6) AS below FROM {table}"


@query("bs01_block_index", ST, "SELECT draw, place, r AS row FROM ix", INDEX)
def _(spark, d):
    return B.block_index(spark, two(spark, d).count(), BLOCK, DRAWS, SEED)


@query("bs02_sharpe_diff", ST, interval_sql("diff", "(SELECT draw, (avg(x) / stddev_pop(x) - avg(y) / stddev_pop(y)) * sqrt(52) AS diff FROM bs GROUP BY 1)"), INDEX)
def _(spark, d):
    return rounded(B.boot_sharpe_diff(two(spark, d), DRAWS, BLOCK, SEED, YEAR), "draws")


@query("bs03_sharpe_ci", ST, interval_sql("sharpe", "(SELECT draw, avg(x) / stddev_pop(x) * sqrt(52) AS sharpe FROM bs GROUP BY 1)"), INDEX)
def _(spark, d):
    return rounded(B.boot_sharpe_ci(two(spark, d).select("dt", F.col("x").alias("ret")), DRAWS, BLOCK, SEED, YEAR), "draws")


@query("bs04_mdd_ci", ST, interval_sql("mdd", "(SELECT draw, 1 - exp(min(c - greatest(p, 0))) AS mdd FROM (SELECT *, max(c) OVER (PARTITION BY draw ORDER BY place) AS p FROM (SELECT draw, place, sum(ln(1 + x)) OVER (PARTITION BY draw ORDER BY place) AS c FROM bs)) GROUP BY 1)"), INDEX)
def _(spark, d):
    return rounded(B.boot_mdd_ci(two(spark, d).select("dt", F.col("x").alias("ret")), DRAWS, BLOCK, SEED), "draws")


@query("bs02_sharpe_diff_full", ST, interval_sql("diff", "(SELECT draw, (avg(x) / stddev_pop(x) - avg(y) / stddev_pop(y)) * sqrt(52) AS diff FROM bs GROUP BY 1)"), index_sql(FULL))
def _(spark, d):
    return rounded(B.boot_sharpe_diff(two(spark, d), FULL, BLOCK, SEED, YEAR), "draws")


@query("bs03_sharpe_ci_full", ST, interval_sql("sharpe", "(SELECT draw, avg(x) / stddev_pop(x) * sqrt(52) AS sharpe FROM bs GROUP BY 1)"), index_sql(FULL))
def _(spark, d):
    return rounded(B.boot_sharpe_ci(two(spark, d).select("dt", F.col("x").alias("ret")), FULL, BLOCK, SEED, YEAR), "draws")


@query("bs04_mdd_ci_full", ST, interval_sql("mdd", "(SELECT draw, 1 - exp(min(c - greatest(p, 0))) AS mdd FROM (SELECT *, max(c) OVER (PARTITION BY draw ORDER BY place) AS p FROM (SELECT draw, place, sum(ln(1 + x)) OVER (PARTITION BY draw ORDER BY place) AS c FROM bs)) GROUP BY 1)"), index_sql(FULL))
def _(spark, d):
    return rounded(B.boot_mdd_ci(two(spark, d).select("dt", F.col("x").alias("ret")), FULL, BLOCK, SEED), "draws")


BLOCKS = (
    "od AS (SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY dt) AS rn, ret - avg(ret) OVER (PARTITION BY variant) AS u, count(*) OVER (PARTITION BY variant) AS n FROM strategies), "
    "oq AS (SELECT *, CAST(greatest(5, ceil(2 * sqrt(log10(greatest(n, 10))))) AS BIGINT) AS quiet FROM od), om AS (SELECT *, CAST(least(n - 1, ceil(sqrt(n::DOUBLE)) + 2 * quiet) AS BIGINT) AS most FROM oq), "
    "og AS (SELECT a.variant, a.rn - b.rn AS lag, max(a.n) AS n, max(a.quiet) AS quiet, max(a.most) AS most, sum(a.u * b.u) AS s FROM om a JOIN om b ON a.variant = b.variant AND a.rn - b.rn BETWEEN 0 AND 2 * a.most GROUP BY 1, 2), "
    "orh AS (SELECT og.*, z.s AS s0, og.s / (n - lag) / nullif(z.s / n, 0) AS rho FROM og JOIN (SELECT variant, s FROM og WHERE lag = 0) z USING (variant)), "
    "ocut AS (SELECT a.variant, min(a.lag) AS m FROM orh a WHERE a.lag >= 1 AND a.lag < a.most - a.quiet AND NOT EXISTS (SELECT 1 FROM orh b WHERE b.variant = a.variant AND b.lag > a.lag AND b.lag <= a.lag + a.quiet AND NOT abs(b.rho) < 2 * sqrt(log10(greatest(a.n, 10)) / a.n)) GROUP BY 1), "
    "ow AS (SELECT r.*, coalesce(m, most - quiet) AS m, CASE WHEN lag / greatest(2 * coalesce(m, most - quiet), 1) <= 0.5 THEN 1.0 WHEN lag / greatest(2 * coalesce(m, most - quiet), 1) <= 1 THEN 2 * (1 - lag / greatest(2 * coalesce(m, most - quiet), 1)) ELSE 0 END * CASE WHEN lag = 0 THEN 1 ELSE 2 END AS w FROM orh r LEFT JOIN ocut USING (variant)), "
    "os AS (SELECT variant, max(n) AS n, max(s0) AS s0, sum(w * lag * rho) AS g, sum(w * rho) AS v FROM ow GROUP BY 1)"
)
over("bs05_opt_block", B.opt_block, "SELECT variant, CASE WHEN n >= 20 AND s0 / n >= 1e-18 AND 2 * v * v >= 1e-18 THEN CAST(greatest(least(round_even(power(2 * g * g / (2 * v * v) * n, 1 / 3.0::DOUBLE), 0), floor(n / 4.0)), 1) AS INT) ELSE 1 END AS block FROM os", BLOCKS)


def diffs(s):
    """Each strategy's returns over the mean of all."""
    mean = s.groupBy("dt").agg(F.avg("ret").alias("m"))
    return s.join(mean, "dt").select(V, "dt", (F.col("ret") - F.col("m")).alias("d"))


DRAWN_T = (
    f"df AS (SELECT variant, dt, ret - avg(ret) OVER (PARTITION BY dt) AS d FROM strategies), dd AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS r, count(*) OVER () AS nd FROM (SELECT DISTINCT dt FROM df)), "
    f"ds AS (SELECT draw, b, nd, {B.hash_sql(SEED, 'draw', 'b')} % nd AS st FROM (SELECT unnest(range({FULL})) AS draw) CROSS JOIN (SELECT max(nd) AS nd FROM dd) CROSS JOIN (SELECT unnest(range(10000)) AS b) WHERE b * {BLOCK} < nd), "
    f"dk AS (SELECT draw, (st + j) % nd AS r, count(*) AS k FROM ds CROSS JOIN (SELECT unnest(range({BLOCK})) AS j) WHERE b * {BLOCK} + j < nd GROUP BY 1, 2), "
    "dm AS (SELECT variant, draw, sum(d * k) / sum(k) AS mean FROM dk JOIN dd USING (r) JOIN df USING (dt) GROUP BY 1, 2), "
    "dt0 AS (SELECT variant, draw, mean, mean0, se, (mean - mean0) / nullif(se, 0) AS t, mean0 / nullif(se, 0) AS t0 FROM dm JOIN (SELECT variant, avg(d) AS mean0 FROM df GROUP BY 1) USING (variant) JOIN (SELECT variant, stddev_samp(mean) AS se FROM dm GROUP BY 1) USING (variant))"
)
over("bs06_romano_wolf", lambda s: B.romano_wolf(diffs(s), BLOCK, FULL, SEED), "SELECT variant, round(t, 6) + 0.0 AS t, round(max(p0) OVER (ORDER BY t DESC, variant), 6) AS p FROM (SELECT variant, max(t0) AS t, avg(CASE WHEN most >= t0 THEN 1.0 ELSE 0 END) AS p0 FROM (SELECT *, max(t) OVER (PARTITION BY draw ORDER BY t0, variant) AS most FROM dt0) GROUP BY 1)", DRAWN_T)
SPA_TOP = "(SELECT greatest(max(t0), 0) AS top FROM dt0)"
over("bs07_spa", lambda s: B.spa(diffs(s), BLOCK, FULL, SEED), f"SELECT round(avg(CASE WHEN lo >= top THEN 1.0 ELSE 0 END), 6) AS lower, round(avg(CASE WHEN mi >= top THEN 1.0 ELSE 0 END), 6) AS consistent, round(avg(CASE WHEN up >= top THEN 1.0 ELSE 0 END), 6) AS upper, round(max(top), 6) AS t FROM (SELECT draw, greatest(max((mean - greatest(mean0, 0)) / nullif(se, 0)), 0) AS lo, greatest(max((mean - CASE WHEN t0 >= -sqrt(2 * ln(ln(nd))) THEN mean0 ELSE 0 END) / nullif(se, 0)), 0) AS mi, greatest(max(t), 0) AS up FROM dt0 CROSS JOIN (SELECT greatest(max(nd), 3) AS nd FROM dd) GROUP BY 1) CROSS JOIN {SPA_TOP}", DRAWN_T, keys=())


def mcs_sql(variants: int) -> str:
    """Tables up to w1 to w<variants - 1>, a round each: its worst variant and the share of draws beyond it."""
    out = [DRAWN_T, "xm AS (SELECT variant, draw, -mean AS mean, -mean0 AS m0 FROM dt0)", "lf1 AS (SELECT DISTINCT variant FROM xm)"]
    for r in range(1, variants):
        out += [
            f"z{r} AS (SELECT variant, draw, mean - m0 - avg(mean - m0) OVER (PARTITION BY draw) AS z, m0 - avg(m0) OVER (PARTITION BY draw) AS gap FROM xm JOIN lf{r} USING (variant))",
            f"e{r} AS (SELECT variant, stddev_samp(z) AS se, max(gap) / nullif(stddev_samp(z), 0) AS t0 FROM z{r} GROUP BY 1)",
            f"b{r} AS (SELECT variant, t0 FROM e{r} ORDER BY t0 DESC, variant DESC LIMIT 1)",
            f"w{r} AS (SELECT (SELECT variant FROM b{r}) AS variant, avg(CASE WHEN most >= (SELECT t0 FROM b{r}) THEN 1.0::DOUBLE ELSE 0 END) AS share FROM (SELECT draw, max(z / nullif(se, 0)) AS most FROM z{r} JOIN e{r} USING (variant) GROUP BY 1))",
            f"lf{r + 1} AS (SELECT variant FROM lf{r} WHERE variant <> (SELECT variant FROM b{r}))",
        ]
    return ", ".join(out)


VARIANTS = 6  # of the strategies panel
MCS_ROWS = " UNION ALL ".join([f"SELECT {r} AS round, * FROM w{r}" for r in range(1, VARIANTS)] + [f"SELECT {VARIANTS}, variant, NULL FROM lf{VARIANTS}"])
over("bs08_mcs", lambda s: B.mcs(diffs(s).select(V, "dt", (-F.col("d")).alias("loss")), BLOCK, FULL, SEED), f"SELECT variant, round(p, 6) AS p, p >= 0.1 AS kept FROM (SELECT variant, CASE WHEN share IS NULL THEN 1.0::DOUBLE ELSE max(share) OVER (ORDER BY round) END AS p FROM ({MCS_ROWS}))", mcs_sql(VARIANTS))


EACH_DRAW = DRAWN_T.split(", dm AS (")[0]
over("bs03_sharpe_ci_all", lambda s: B.boot_sharpe_by(s, V, BLOCK, FULL, SEED, YEAR), interval_sql("sharpe", f"(SELECT variant, m / nullif(sqrt(greatest(q - m * m, 0)), 0) * sqrt({YEAR}::DOUBLE) AS sharpe FROM (SELECT variant, draw, sum(k * ret) / sum(k) AS m, sum(k * ret * ret) / sum(k) AS q FROM dk JOIN dd USING (r) JOIN strategies USING (dt) GROUP BY 1, 2))").replace("SELECT ", "SELECT variant, ", 1) + " GROUP BY 1", EACH_DRAW, keys=(V, "draws"))
PATHS = f"dx AS (SELECT draw, b * {BLOCK} + j AS place, (st + j) % nd AS r FROM ds CROSS JOIN (SELECT unnest(range({BLOCK})) AS j) WHERE b * {BLOCK} + j < nd), dc AS (SELECT variant, draw, place, sum(ln(1 + ret)) OVER (PARTITION BY variant, draw ORDER BY place) AS c FROM dx JOIN dd USING (r) JOIN strategies USING (dt)), dp AS (SELECT variant, draw, c - greatest(max(c) OVER (PARTITION BY variant, draw ORDER BY place), 0) AS fall FROM dc)"
over("bs04_mdd_ci_all", lambda s: B.boot_mdd_by(s, V, BLOCK, FULL, SEED), interval_sql("mdd", "(SELECT variant, draw, 1 - exp(min(fall)) AS mdd FROM dp GROUP BY 1, 2)").replace("SELECT ", "SELECT variant, ", 1) + " GROUP BY 1", f"{EACH_DRAW}, {PATHS}", keys=(V, "draws"))
EACH_WINDOW = f"wr AS (SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY dt) - 1 AS r, count(*) OVER (PARTITION BY variant) AS n, sum(ret) OVER (PARTITION BY variant ORDER BY dt ROWS 25 PRECEDING) AS s FROM strategies), wl AS (SELECT variant, n, s AS seen FROM wr WHERE r = n - 1), ws AS (SELECT variant, seen, {B.hash_sql(SEED, 'id', '0')} % (n - 25) + 25 AS r FROM wl CROSS JOIN (SELECT unnest(range(10000)) AS id))"
over("bs10_window_rank_all", lambda s: B.window_rank_by(s, V, 26, 10_000, SEED), "SELECT variant, round(max(seen), 6) + 0.0 AS seen, round(avg(CASE WHEN s <= seen THEN 1.0 ELSE 0 END), 6) AS rank FROM ws JOIN wr USING (variant, r) GROUP BY 1", EACH_WINDOW)


def against_mean(s):
    """Each strategy as x, with the mean of all as y."""
    mean = s.groupBy("dt").agg(F.avg("ret").alias("y"))
    return s.join(mean, "dt").select(V, "dt", F.col("ret").alias("x"), "y")


LENGTHS = [5, 10, 21, 42, 63, 126, 252]
GRID = (
    "am AS (SELECT variant, dt, ret AS x, avg(ret) OVER (PARTITION BY dt) AS y FROM strategies), ad AS (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS r, count(*) OVER () AS nd FROM (SELECT DISTINCT dt FROM am)), "
    f"gs AS (SELECT block, draw, b, nd, {B.hash_sql(SEED, 'draw', 'b')} % nd AS st FROM (SELECT unnest({LENGTHS}) AS block) CROSS JOIN (SELECT unnest(range({FULL})) AS draw) CROSS JOIN (SELECT max(nd) AS nd FROM ad) CROSS JOIN (SELECT unnest(range(1000)) AS b) WHERE b * block < nd), "
    f"gk AS (SELECT block, draw, (st + j) % nd AS r, count(*) AS k FROM gs CROSS JOIN (SELECT unnest(range({max(LENGTHS)})) AS j) WHERE j < block AND b * block + j < nd GROUP BY 1, 2, 3), "
    "gm AS (SELECT variant, block, draw, sum(k * x) / sum(k) AS mx, sum(k * x * x) / sum(k) AS qx, sum(k * y) / sum(k) AS my, sum(k * y * y) / sum(k) AS qy FROM gk JOIN ad USING (r) JOIN am USING (dt) GROUP BY 1, 2, 3), "
    f"gd AS (SELECT variant, block, (mx / nullif(sqrt(greatest(qx - mx * mx, 0)), 0) - my / nullif(sqrt(greatest(qy - my * my, 0)), 0)) * sqrt({YEAR}::DOUBLE) AS diff FROM gm)"
)
over("bs09_block_grid", lambda s: B.block_grid(against_mean(s), LENGTHS, FULL, SEED, YEAR), interval_sql("diff", "gd").replace("SELECT ", "SELECT variant, block, ", 1) + " GROUP BY 1, 2", GRID, keys=(V, "block", "draws"))


RANKS = PAIR + f", prn AS (SELECT x, row_number() OVER (ORDER BY dt) - 1 AS r, count(*) OVER () AS n FROM pair), cum AS (SELECT r, n, sum(x) OVER (ORDER BY r) AS c FROM prn), wst AS (SELECT {B.hash_sql(SEED, 'id', '0')} % ((SELECT max(n) FROM prn) - 26 + 1) AS st FROM (SELECT unnest(range(10000)) AS id)), wsum AS (SELECT w.st, sum(p.x) AS s FROM (SELECT DISTINCT st FROM wst) w JOIN prn p ON p.r >= w.st AND p.r < w.st + 26 GROUP BY 1)"


@query("bs10_window_rank", ST, "SELECT round(max(seen), 6) + 0.0 AS seen, round(avg(CASE WHEN s <= seen THEN 1.0 ELSE 0 END), 6) AS rank FROM wst JOIN wsum USING (st) CROSS JOIN (SELECT sum(x) AS seen FROM prn WHERE r >= n - 26)", RANKS)
def _(spark, d):
    return rounded(B.window_rank(two(spark, d).select("dt", F.col("x").alias("ret")), 26, 10_000, SEED))


# --- two panels ------------------------------------------------------------------------------------------------------


def halves(s):
    odd = F.floor(F.datediff("dt", F.lit("1995-01-02")) / 7) % 2
    return s.where(odd == 0), s.where(odd == 1)


HALVES = "hv AS (SELECT *, CAST(floor((dt - DATE '1995-01-02') / 7) AS BIGINT) % 2 AS h FROM strategies), pa AS (SELECT variant, dt, ret FROM hv WHERE h = 0), pb AS (SELECT variant, dt, ret FROM hv WHERE h = 1)"
HMOM = "SELECT variant, avg(ret) AS mean, stddev_pop(ret) AS sd, (avg(ret * ret * ret) - 3 * avg(ret) * avg(ret * ret) + 2 * power(avg(ret), 3)) / power(var_pop(ret), 1.5) AS skew, kurtosis_pop(ret) AS kurt FROM {t} GROUP BY 1"


def compared(name: str, make, sql: str | None = None, keys: tuple = (V,)) -> None:
    over(name, lambda s: make(*halves(s)), sql, HALVES, keys)


compared("dq01_qq_mse", C.qq_mse, "SELECT variant, round(avg(power(quantile_a - quantile_b, 2)), 6) AS mse FROM (SELECT a.variant, unnest(a.q) AS quantile_a, unnest(b.q) AS quantile_b FROM (SELECT variant, quantile_cont(ret, " + str([(k + 1) / 100 for k in range(99)]) + ") AS q FROM pa GROUP BY 1) a JOIN (SELECT variant, quantile_cont(ret, " + str([(k + 1) / 100 for k in range(99)]) + ") AS q FROM pb GROUP BY 1) b USING (variant)) GROUP BY 1")
CORR = "(SELECT a.variant AS i, b.variant AS j, corr(a.ret, b.ret) AS r FROM {t} a JOIN {t} b ON a.dt = b.dt AND a.variant < b.variant GROUP BY 1, 2)"
compared("dq02_corr_distance", C.corr_distance, f"SELECT round(sqrt(2 * sum(power(a.r - b.r, 2))), 6) AS frobenius, round(avg(abs(a.r - b.r)), 6) AS mean, round(max(abs(a.r - b.r)), 6) AS most FROM {CORR.format(t='pa')} a JOIN {CORR.format(t='pb')} b USING (i, j)", ())
def acf_sql(x: str, half: str) -> str:
    v = f"(SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY dt) AS rn, {x} - avg({x}) OVER (PARTITION BY variant) AS u FROM {half})"
    return f"(SELECT a.variant, a.rn - b.rn AS lag, sum(a.u * b.u) / nullif(max(z.s0), 0) AS rho FROM {v} a JOIN {v} b ON a.variant = b.variant AND a.rn - b.rn BETWEEN 1 AND 20 JOIN (SELECT variant, sum(u * u) AS s0 FROM {v} GROUP BY 1) z ON z.variant = a.variant GROUP BY 1, 2)"


def acf_gap(x: str) -> str:
    return f"(SELECT variant, avg(abs(a.rho - b.rho)) AS gap FROM {acf_sql(x, 'pa')} a JOIN {acf_sql(x, 'pb')} b USING (variant, lag) GROUP BY 1)"


compared("dq03_acf_distance", C.acf_distance, f"SELECT variant, round(p.gap, 6) AS plain, round(q.gap, 6) AS squares FROM {acf_gap('ret')} p JOIN {acf_gap('ret * ret')} q USING (variant)")


def eigen_sql(t: str, k: int = 3, steps: int = 3000) -> str:
    """Tables <t>e1 to <t>e<k> with lam, the largest eigenvalues of the correlations of t: power iteration, each found one taken out."""
    out = [
        f"{t}w AS (SELECT * FROM {t} WHERE dt IN (SELECT dt FROM {t} GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT variant) FROM {t})))",
        f"{t}m1 AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(c ORDER BY j) AS r FROM (SELECT x.variant AS i, y.variant AS j, corr(x.ret, y.ret) AS c FROM {t}w x JOIN {t}w y USING (dt) GROUP BY 1, 2) GROUP BY i))",
    ]
    for r in range(1, k + 1):
        step = "list_transform(a, lambda r: list_dot_product(r, v))"
        out += [
            f"{t}p{r} AS (SELECT 0 AS k, list_transform(range(len(a)), lambda i: 1 + 0.37::DOUBLE * i) AS v FROM {t}m{r} UNION ALL SELECT k + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM (SELECT k, {step} AS w FROM {t}p{r}, {t}m{r} WHERE k < {steps}))",
            f"{t}e{r} AS (SELECT v, list_dot_product(v, {step}) AS lam FROM {t}p{r}, {t}m{r} WHERE k = {steps})",
            f"{t}m{r + 1} AS (SELECT list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) + 1), lambda j: a[i][j] - lam * v[i] * v[j])) AS a FROM {t}m{r}, {t}e{r})",
        ]
    return ", ".join(out)


over("dq04_eigen_compare", lambda s: C.eigen_compare(*halves(s)), " UNION ALL ".join(f"SELECT {r} AS rank, round(x.lam, 6) AS real, round(y.lam, 6) AS made FROM pae{r} x, pbe{r} y" for r in (1, 2, 3)), f"{HALVES}, {eigen_sql('pa')}, {eigen_sql('pb')}", ("rank",))
compared("dq05_moments", lambda a, b: C.moments(a), "SELECT variant, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, round(skew, 6) + 0.0 AS skew, round(kurt, 6) + 0.0 AS kurt FROM (" + HMOM.format(t="pa") + ")")
compared("dq06_kurtosis_check", C.kurtosis_check, f"SELECT a.variant, round((b.kurt + 3) / (a.kurt + 3), 6) AS ratio, (b.kurt + 3) / (a.kurt + 3) BETWEEN 0.5 AND 2 AS ok FROM ({HMOM.format(t='pa')}) a JOIN ({HMOM.format(t='pb')}) b USING (variant)")
over("dq07_robust_scale", lambda s: C.robust_scale(s).select(V, "dt", "x"), "SELECT variant, dt, round(greatest(least((ret - m) / sc, 10), -10) / 10, 6) + 0.0 AS x FROM strategies JOIN (SELECT variant, median(ret) AS m, CASE WHEN quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) > 0.000000000001 THEN quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) ELSE stddev_pop(ret) END AS sc FROM strategies GROUP BY 1) USING (variant)", keys=(V, "dt"))
over("dq07_robust_unscale", lambda s: C.robust_unscale(C.robust_scale(s).drop("ret"), C.robust_fit(s)).select(V, "dt", "ret"), "SELECT variant, dt, round(greatest(least((ret - m) / sc, 10), -10) * sc + m, 6) + 0.0 AS ret FROM strategies JOIN (SELECT variant, median(ret) AS m, CASE WHEN quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) > 0.000000000001 THEN quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) ELSE stddev_pop(ret) END AS sc FROM strategies GROUP BY 1) USING (variant)", keys=(V, "dt"))
over("dq08_quantile_inverse", lambda s: C.quantile_inverse(C.normal_score(s).select(V, "dt", S.normal_cdf("score").alias("p")), s), f"SELECT variant, dt, round(p, 6) AS p, round(a[lo + 1] + coalesce(a[lo + 2] - a[lo + 1], 0) * (sp - lo), 6) + 0.0 AS ret FROM (SELECT *, CAST(floor(sp) AS BIGINT) AS lo FROM (SELECT variant, dt, p, a, greatest(least(p, 1), 0) * (len(a) - 1) AS sp FROM (SELECT variant, dt, {S.normal_cdf_sql('score')} AS p FROM (SELECT variant, dt, {S.normal_ppf_sql('u')} AS score FROM (SELECT variant, dt, (rank() OVER (PARTITION BY variant ORDER BY ret) + (count(*) OVER (PARTITION BY variant, ret) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY variant) + 1) AS u FROM strategies))) JOIN (SELECT variant, list(ret ORDER BY ret) AS a FROM strategies GROUP BY 1) USING (variant)))", keys=(V, "dt"))
over("dq08_normal_score", lambda s: C.normal_score(s).select(V, "dt", "score"), f"SELECT variant, dt, round({S.normal_ppf_sql('u')}, 6) + 0.0 AS score FROM (SELECT variant, dt, (rank() OVER (PARTITION BY variant ORDER BY ret) + (count(*) OVER (PARTITION BY variant, ret) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY variant) + 1) AS u FROM strategies)", keys=(V, "dt"))

# --- scalar functions ------------------------------------------------------------------------------------------------

over("fn01_arithmetic", lambda s: s.select(V, "dt", F.exp("ret").alias("e"), F.sqrt(F.abs("ret")).alias("r"), F.signum("ret").alias("s"), F.log(1 + F.abs(F.col("ret"))).alias("l"), F.pow(F.lit(2.0), F.col("ret")).alias("p")), "SELECT variant, dt, round(exp(ret), 6) AS e, round(sqrt(abs(ret)), 6) AS r, CAST(sign(ret) AS DOUBLE) AS s, round(ln(1 + abs(ret)), 6) AS l, round(power(2, ret), 6) AS p FROM strategies", keys=(V, "dt"))
over("fn02_ratio", lambda s: s.select(V, "dt", S.ratio(F.lit(1.0), F.round("ret", 2)).alias("x")), "SELECT variant, dt, round(1.0::DOUBLE / nullif(round(ret, 2), 0), 6) AS x FROM strategies", keys=(V, "dt"))
over("fn04_normal", lambda s: s.select(V, "dt", S.normal_cdf("ret * 20").alias("cdf"), S.normal_ppf("0.5 + ret * 2").alias("ppf")), f"SELECT variant, dt, round({S.normal_cdf_sql('ret * 20')}, 6) AS cdf, round({S.normal_ppf_sql('0.5 + ret * 2')}, 6) + 0.0 AS ppf FROM strategies", keys=(V, "dt"))
over("fn05_chi2_tail", lambda s: s.select(V, "dt", F.expr(S.chi2_tail_sql("abs(ret) * 100", 5)).alias("odd"), F.expr(S.chi2_tail_sql("abs(ret) * 100", 4)).alias("even")), f"SELECT variant, dt, round({S.chi2_tail_sql('abs(ret) * 100', 5)}, 6) AS odd, round({S.chi2_tail_sql('abs(ret) * 100', 4)}, 6) AS even FROM strategies", keys=(V, "dt"))
over("fn08_dates", lambda s: s.select(V, "dt", F.trunc("dt", "month").alias("month"), F.month("dt").alias("m"), F.date_add("dt", 3).alias("later")), "SELECT variant, dt, CAST(date_trunc('month', dt) AS DATE) AS month, CAST(month(dt) AS INT) AS m, dt + 3 AS later FROM strategies", keys=(V, "dt"))


@query("fn09_contract_code", (), "SELECT p_partkey, CAST(1990 + p_size % 20 AS INT) AS year, CAST(1 + p_size % 12 AS INT) AS month FROM part")
def _(spark, d):
    codes = "FGHJKMNQUVXZ"  # months of contract codes, in order
    p = P.table(spark, d, "part").select("p_partkey", F.concat((1990 + F.col("p_size") % 20).cast("string"), F.substring(F.lit(codes), (1 + F.col("p_size") % 12).cast("int"), F.lit(1))).alias("code"))
    return p.select("p_partkey", F.regexp_extract("code", "^([0-9]{4})", 1).cast("int").alias("year"), F.instr(F.lit(codes), F.regexp_extract("code", "([A-Z])$", 1)).cast("int").alias("month"))


over("fn03_log_add", lambda s: s.select(V, "dt", S.log_add(F.col("ret") * 1000, F.lit(-3.0)).alias("x")), "SELECT variant, dt, round(greatest(ret * 1000, -3) + ln(1 + exp(-abs(ret * 1000 + 3))), 6) + 0.0 AS x FROM strategies", keys=(V, "dt"))
over("fn06_probit_rank", lambda s: s.withColumn("u", F.rank().over(O.W.partitionBy("dt").orderBy("ret")) / (F.count("*").over(O.W.partitionBy("dt")) + 1)).select(V, "dt", S.normal_ppf("u").alias("x")), f"SELECT variant, dt, round({S.normal_ppf_sql('u')}, 6) + 0.0 AS x FROM (SELECT variant, dt, rank() OVER (PARTITION BY dt ORDER BY ret) / (count(*) OVER (PARTITION BY dt) + 1)::DOUBLE AS u FROM strategies)", keys=(V, "dt"))
over("fn07_interpolate", lambda s: s.select(V, "dt", X.interpolate(F.col("ret"), ((-0.1, 5.0), (0.0, 1.0), (0.05, -2.0))).alias("x")), "SELECT variant, dt, round(CASE WHEN ret < -0.1 THEN 5 WHEN ret < 0 THEN 5 + (ret + 0.1) * (1 - 5) / 0.1::DOUBLE WHEN ret < 0.05 THEN 1 - 3 * ret / 0.05::DOUBLE ELSE -2 END, 6) + 0.0 AS x FROM strategies", keys=(V, "dt"))
over("fn10_strings", lambda s: s.select(V).distinct().select(V, F.upper(V).alias("up"), F.contains(F.lower(V), F.lit("steel")).alias("has"), F.col(V).like("%BRUSHED%").alias("like_it")), "SELECT DISTINCT variant, upper(variant) AS up, contains(lower(variant), 'steel') AS has, variant LIKE '%BRUSHED%' AS like_it FROM strategies")


@query("fn11_json_note", ST, "SELECT variant, to_json({'n': count(*), 'best': round(max(ret), 6)})::VARCHAR AS note FROM strategies GROUP BY 1")
def _(spark, d):
    return strategies(spark, d).groupBy(V).agg(F.to_json(F.struct(F.count("*").alias("n"), F.round(F.max("ret"), 6).alias("best"))).alias("note"))


POWERS = "pw AS (SELECT power(2::DOUBLE, k) AS p FROM (SELECT unnest(range(0, 12)) AS k)), fr AS (SELECT variant, dt, ret, 1 + abs(ret) * 1000 AS x FROM strategies)"
NEAREST = "SELECT variant, dt, arg_min(p, (abs(x - p), p)) AS p, any_value(round(ret / 0.25) * 0.25 + 0.0) AS g FROM fr CROSS JOIN pw GROUP BY 1, 2"
over("fn12_rounding", lambda s: s.select(V, "dt", S.nearest_power_of_two(1 + F.abs(F.col("ret")) * 1000).alias("p"), S.to_grid(F.col("ret"), 0.25).alias("g")), NEAREST, keys=(V, "dt"), more=POWERS)
over("ud01_rolling_apply", lambda s: s.select(V, "dt", F.when(F.count("ret").over(O.w(8, by=V)) >= 8, F.aggregate(F.collect_list("ret").over(O.w(8, by=V)), F.lit(0.0), lambda a, v: a + v * v)).alias("x")), f"SELECT variant, dt, CASE WHEN count(ret) {last(8, V)} >= 8 THEN round(sum(ret * ret) {last(8, V)}, 6) END AS x FROM strategies", keys=(V, "dt"))


@query("ud02_grouped_map", ST, "SELECT variant, count(*) AS n, round(max(ret), 6) AS best FROM strategies GROUP BY 1")
def _(spark, d):
    def best(rows):
        return rows.groupby("variant", as_index=False).agg(n=("ret", "size"), best=("ret", "max"))

    return rounded(strategies(spark, d).groupBy(V).applyInPandas(best, "variant string, n long, best double"), V)


over("ud03_hook", lambda s: s.transform(lambda x: x.withColumn("ret", -F.col("ret"))).select(V, "dt", "ret"), "SELECT variant, dt, round(-ret, 6) + 0.0 AS ret FROM strategies", keys=(V, "dt"))


# --- sinks -----------------------------------------------------------------------------------------------------------


def sink(name: str, make, sql: str) -> None:
    @query(name, ST, sql)
    def _(spark, d):
        from strandmill.sources.sinks import scratch

        return make(strategies(spark, d), scratch(spark, name))


def _resume(s, path):
    from strandmill.sources import sinks

    sinks.write_variants(s.where("variant < 'M'"), path)
    sinks.write_variants(s, path)
    return sinks.read_variants(s.sparkSession, path).select(V, "dt", "ret")


def _exported(s, path):
    from strandmill.sources import sinks

    sinks.write_table(s.groupBy(V).agg(F.count("*").alias("n")), path, "csv")
    return s.sparkSession.read.schema("variant string, n long").option("header", True).csv(path)


def _paths(s, path):
    from strandmill.sources import sinks

    sinks.write_paths(s.withColumn("path_id", F.year("dt")), path)
    return s.sparkSession.read.parquet(path).groupBy("path_id").agg(F.count("*").alias("n"))


sink("snk01_variants", _resume, "SELECT * FROM strategies")
sink("snk02_table", _exported, "SELECT variant, count(*) AS n FROM strategies GROUP BY 1")
sink("snk03_paths", _paths, "SELECT CAST(year(dt) AS INT) AS path_id, count(*) AS n FROM strategies GROUP BY 1")
