"""The strategy's sweep, regimes, networks and block lengths against NumPy and pandas; plans of the composite."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.functions.scalars import nearest_power_of_two
from strandmill.operators import bootstrap as B
from strandmill.operators import compare as C
from strandmill.operators import cross_section as X
from strandmill.operators import ledger as L
from strandmill.operators import recursive as R
from strandmill.operators import statistics as T
from strandmill.operators import strategy as S
from strandmill.operators import sweep as V
from strandmill.plans import signal_queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def returns(spark):
    rng = np.random.default_rng(31)
    rows = []
    for k, v in enumerate("abcdef"):
        x = np.zeros(260)
        for t in range(1, 260):
            x[t] = 0.15 * k * x[t - 1] + rng.normal(0.001 * k, 0.02)
        rows += [(v, t.to_pydatetime(), float(y)) for t, y in zip(pd.date_range("2000-01-03", periods=260, freq="W"), x, strict=True)]
    return pd.DataFrame(rows, columns=["variant", "dt", "ret"]), spark.createDataFrame(rows, "variant string, dt timestamp, ret double").cache()


def flat_top_length(x):
    """The circular block length of Politis and White (2004), as corrected in 2009: the flat-top lag window around the last
    lag before a run of small autocorrelations, and the plug-in length from its two sums."""
    n = x.size
    run = max(5, math.ceil(2 * math.log10(n) ** 0.5))
    reach = min(n - 1, math.ceil(n**0.5) + 2 * run)
    centred = x - x.mean()
    lags = np.arange(1, min(n - 1, 2 * reach) + 1)
    rho = np.array([centred[k:].dot(centred[:-k]) * n / (n - k) for k in lags]) / centred.dot(centred)
    small = np.abs(rho) < 2 * math.sqrt(math.log10(n) / n)
    whole = np.lib.stride_tricks.sliding_window_view(small[1:reach], run).all(axis=1)[: reach - run - 1]
    m = int(np.argmax(whole)) + 1 if whole.any() else reach - run
    k, r = lags[: 2 * m], rho[: 2 * m]
    taper = np.minimum(1.0, 2 - k / m)
    slope, level = 2 * np.sum(taper * k * r), 1 + 2 * np.sum(taper * r)
    return int(np.clip(round((slope**2 * n / level**2) ** (1 / 3)), 1, n // 4))


def test_block_length(returns):
    pdf, df = returns
    want = {v: flat_top_length(x["ret"].to_numpy()) for v, x in pdf.groupby("variant")}
    got = {r["variant"]: r["block"] for r in B.opt_block(df).collect()}
    assert got == want and len(set(want.values())) > 2


def test_block_length_by_hand(spark):
    """Alternating signs: autocorrelations of -1 and 1 never fall below the bound, so all lags count; noise has the shortest block."""
    rows = [("flip", k, (-1.0) ** k) for k in range(100)] + [("once", k, float(k == 50)) for k in range(100)]
    d = spark.createDataFrame(rows, "variant string, dt int, ret double")
    got = {r["variant"]: r["block"] for r in B.opt_block(d).collect()}
    assert got["once"] == 1 and got["flip"] == flat_top_length(np.array([x for v, _, x in rows if v == "flip"]))


def test_split_moments_differ_by_regime(returns):
    pdf, df = returns
    got = R.split_moments(df, "ret", 52, 20, by="variant").where("variant = 'c'").orderBy("dt").toPandas()
    x = pdf[pdf["variant"] == "c"]["ret"].to_numpy()
    for t in (19, 60, 259):
        a = np.sort(x[max(0, t - 51) : t + 1])
        h = len(a) // 2
        assert np.allclose(got.iloc[t][["m1", "s1", "m2", "s2"]].astype(float), [np.quantile(a, 0.25), a[:h].std(), np.quantile(a, 0.75), a[-h:].std()])
    assert got.iloc[18]["m1"] is None or math.isnan(got.iloc[18]["m1"])


def test_trailing_areas_do_not_look_ahead(spark, returns):
    _, df = returns
    d = df.select(F.col("variant").alias("symbol"), F.col("dt").cast("date").alias("dt"), F.col("ret").alias("x"))
    late = d.withColumn("x", F.when(F.col("dt") >= "2003-06-01", F.col("x") * 7 - 1).otherwise(F.col("x")))
    pick = lambda t: sorted(map(tuple, X.ensemble_edges(X.trailing_areas(t, "x", [26, 52], 26)).where("refit < '2003-06-01'").select("refit", "src", "dst", F.round("w", 9)).collect()))
    one = pick(d)
    assert one and one == pick(late)
    gaps = d.where((F.col("symbol") != "f") | (F.dayofyear("dt") % 3 == 0))  # a series with too few of the dates has no edges
    assert not {r["src"] for r in X.ensemble_edges(X.trailing_areas(gaps, "x", [26, 52], 26)).collect()} & {"f"}


def test_model_confidence_set_equals_loops(returns):
    pdf, df = returns
    wide = -pdf.pivot(index="dt", columns="variant", values="ret")
    block, draws, seed = 8, 60, 5
    rows = B.block_index(df.sparkSession, len(wide), block, draws, seed).toPandas()
    means = np.stack([wide.to_numpy()[g["row"].to_numpy()].mean(0) for _, g in rows.sort_values("draw").groupby("draw")])
    names, m0, left, floor, want = list(wide.columns), wide.to_numpy().mean(0), list(range(6)), 0.0, {}
    while len(left) > 1:
        z = means[:, left] - m0[left]
        z = z - z.mean(1, keepdims=True)
        se = z.std(0, ddof=1)
        t0 = (m0[left] - m0[left].mean()) / se
        worst = max(range(len(left)), key=lambda k: (t0[k], names[left[k]]))
        floor = max(floor, float(((z / se).max(1) >= t0[worst]).mean()))
        want[names[left.pop(worst)]] = floor
    want[names[left[0]]] = 1.0
    got = {r["variant"]: r["p"] for r in B.mcs(df.select("variant", "dt", (-F.col("ret")).alias("loss")), block, draws, seed).collect()}
    assert got == pytest.approx(want)


def test_block_grid_equals_loops(returns):
    pdf, df = returns
    wide = pdf.pivot(index="dt", columns="variant", values="ret")
    y = wide.mean(1)
    pairs = df.join(df.groupBy("dt").agg(F.avg("ret").alias("y")), "dt").select("variant", "dt", F.col("ret").alias("x"), "y")
    got = {(r["variant"], r["block"]): (r["low"], r["high"]) for r in B.block_grid(pairs, [5, 21], 40, 3, 52.0).collect()}
    for block in (5, 21):
        rows = B.block_index(df.sparkSession, len(wide), block, 40, 3).toPandas()
        for v in "af":
            sr = lambda a: a.mean() / a.std()
            d = [(sr(wide[v].to_numpy()[i]) - sr(y.to_numpy()[i])) * 52**0.5 for i in (g["row"].to_numpy() for _, g in rows.groupby("draw"))]
            assert got[v, block] == pytest.approx((np.quantile(d, 0.025), np.quantile(d, 0.975)))


def test_eigenvalues(returns):
    pdf, df = returns
    half = F.dayofyear("dt") % 2
    got = C.eigen_compare(df.where(half == 0), df.where(half == 1)).orderBy("rank").collect()
    for k, name in ((0, "real"), (1, "made")):
        part = pdf[pdf["dt"].dt.dayofyear % 2 == k].pivot(index="dt", columns="variant", values="ret")
        assert [r[name] for r in got] == pytest.approx(sorted(np.linalg.eigvalsh(part.corr()), reverse=True)[:3], rel=1e-6)


# --- the strategy ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def built(spark):
    from strandmill.plans.panel_queries import term
    from strandmill.sources import panels as P
    from strandmill.sources.sinks import save

    b = save(Q.bars(spark, SF), "bars")
    chosen = {k: v for k, v in S.one_at_a_time().items() if k in ("A07", "B03", "K02", "P00", "P03", "H00", "J04", "N01", "E08")} | {"late": ("lag", {"lag": 7}), "half": ("half-life", {"halflife": 3.0}), "dear": ("costs", {"cost_mult": 3.0})}
    v = S.registry(spark, chosen)
    wanted = S.needs(v)
    lib = save(S.library(b, term(spark, SF, b), wanted), "library")
    return b, chosen, v, wanted, lib, save(S.scores(lib, v, wanted["lag"]), "scores"), P.instruments(spark, SF)


def test_registries():
    assert len(S.one_at_a_time()) > 100 and len(S.ablations()) >= 60 and len({g for g, _ in S.ablations().values()}) == 10
    assert list(S.cumulative({"a": {"lag": 1}, "b": {"lag": 2, "fdm_cap": 1.0}}).values())[1][1] == {"lag": 2, "fdm_cap": 1.0}
    assert S.rounded(S.DEFAULTS)["fdm_span"] == 128 and S.rounded(S.DEFAULTS)["smooth_span"] == 2 and S.rounded(S.DEFAULTS | {"skew_window": 46})["skew_window"] == 32 and S.rounded(S.DEFAULTS)["dd_threshold"] == -0.1


def test_scores_equal_pandas(built):
    _, chosen, _, _, lib, scores, _ = built
    rows = lib.toPandas().sort_values(["symbol", "dt"])
    got = scores.toPandas().set_index(["variant", "symbol", "dt"])["score"]
    cap = lambda x: x.clip(-20, 20)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
    for name in ("master", *chosen):
        o = {**S.DEFAULTS, **(chosen[name][1] if name in chosen else {})}
        f = rows.drop(columns=list(S.BASE)).astype(float)
        ts = sum(f[s] for s in o["speeds"]) / len(o["speeds"]) * o["trend_fdm"] * (f[f"conv{o['conviction']}:{'+'.join(o['speeds'])}"] if o["conviction"] else 1)
        parts = pd.DataFrame({"trend": cap(o["w_ts"] * ts + o["w_xs"] * f[f"xs{o['xs_lookback']}"]), "carry": f["carry"], "skew": f[f"skew{o['skew_window']}"], "vov": f[f"vov{o['vov_window']}_{o['vov_direction']}"]})
        w = np.array([o[f"w_{p}"] for p in S.PARTS])
        pool = rows["symbol"] if o["fdm_mode"] == "single" else pd.Series("", rows.index)
        mult = pd.Series(1.0, rows.index)
        for g in pool.unique():
            at = pool == g
            m = parts[at].groupby(rows["dt"][at]).mean().sort_index()
            e = {(i, j): (m[i] * m[j]).ewm(span=o["fdm_span"]).mean() for i in m for j in m}
            a = m.ewm(span=o["fdm_span"]).mean()
            rho = np.full((len(m), 4, 4), np.nan)
            for i, x in enumerate(S.PARTS):
                for j, y in enumerate(S.PARTS):
                    v = (e[x, x] - a[x] ** 2) * (e[y, y] - a[y] ** 2)
                    rho[:, i, j] = np.where(v > 0, (e[x, y] - a[x] * a[y]) / np.sqrt(np.where(v > 0, v, 1)), np.nan)
            off = ~np.eye(4, dtype=bool)
            for t, day in enumerate(m.index):
                r = rho[t].copy()
                r[~off] = 1
                if t + 1 >= o["fdm_least"] and not np.isnan(r).any():
                    r[off] = r[off].mean() if o["fdm_mode"] == "mean" else r[off]
                    k = min(1 / math.sqrt(max(w @ r @ w, 0.01)), o["fdm_cap"])
                    mult[at & (rows["dt"] == day)] = max(k, 1.0)
        mixed = cap(cap(parts @ w) * mult)
        rate = {"halflife": o["halflife"]} if o["halflife"] else {"span": o["smooth_span"]}
        smooth = mixed.groupby(rows["symbol"]).transform(lambda x, r=rate: x.ewm(**r).mean()) if o["halflife"] or o["smooth_span"] > 1 else mixed
        gate = lambda least, x, k=o["steepness"]: 1 - (1 - least) * sig(k * x).fillna(0)
        score = smooth * gate(o["vol_dampen"], rows["vol"] / rows["usual"] - o["vol_trigger"]) * gate(o["dd_scale"], rows["loss"] + o["dd_threshold"])
        if o["lag"]:
            score = score.groupby(rows["symbol"]).shift(o["lag"])
        assert np.allclose(got[name].reindex(pd.MultiIndex.from_frame(rows[["symbol", "dt"]])).to_numpy(), score.fillna(0).to_numpy(), atol=1e-5), name


def test_sweep_through_the_ledger(spark, built):
    _, chosen, v, wanted, lib, scores, dims = built
    ran = S.run(lib, v, dims, 52.0, wanted["lag"])
    t = {r["variant"]: r for r in S.summary(ran, v, 52.0).collect()}
    assert set(t) == {"master", *chosen} and t["master"]["delta"] == 0
    assert t["dear"]["costs"] == pytest.approx(3 * t["master"]["costs"]) and t["dear"]["trades_year"] == t["master"]["trades_year"]
    assert t["late"]["sharpe"] != 0 and t["late"]["sharpe"] != t["master"]["sharpe"]  # a lag beyond any small frame holds positions
    # the master alone, step by step
    d = scores.where("variant = 'master'").withColumn("forecast", F.col("score")).withColumn("fx", F.lit(1.0)).join(dims, "symbol")
    book = L.daily_pnl(L.held_position(L.target_position(d, root_year=52**0.5, least_vol=1e-9)))  # one series at a time
    assert book.agg(F.sum("pnl")).first()[0] == pytest.approx(ran.where("variant = 'master'").agg(F.sum("pnl")).first()[0])


def test_random_variants_keep_to_their_ranges(spark):
    v = S.random_variants(spark, 200, lambda row, k: B.uniform_sql(7, row, str(k))).toPandas()
    assert all(v[n].between(*x[:2]).all() and v[n].nunique() > 150 for n, x in S.RANGES.items()) and all(set(v[n]) == set(x) for n, x in S.CHOICES.items())
    assert v.columns[2:].tolist() == list(S.PARAMS)


def test_fragility_damage_and_interaction(spark):
    t = spark.createDataFrame([("a", "A", 1.0), ("b", "A", 1.4), ("c", "A", 1.5), ("d", "B", 1.0), ("e", "B", 1.1)], "variant string, dim string, sharpe double")
    assert [(r["dim"], round(r["gap"], 9)) for r in V.fragility(t).collect()] == [("A", 0.4), ("B", 0.1)]
    full, parts = spark.createDataFrame([("a", 0.01), ("b", -0.5)], "variant string, delta double"), spark.createDataFrame([("a", "x", -0.1), ("a", "y", 0.1), ("b", "x", -1.0)], "variant string, name string, part_delta double")
    assert [(r["variant"], r["name"]) for r in V.hidden_damage(full, parts).collect()] == [("a", "x")]
    combos = spark.createDataFrame([("a+b", 0.9, ["a", "b"])], "combo string, delta double, parts array<string>")
    assert V.interaction(combos, spark.createDataFrame([("a", 0.5), ("b", 0.1)], "variant string, delta double")).first()["interaction"] == pytest.approx(0.3)


def test_noise_null_keeps_moments(spark):
    d = spark.range(400).select(F.lit("s").alias("symbol"), F.col("id").alias("dt"), F.col("id").alias("rn"), (F.col("id") % 7 - 2).cast("double").alias("score"))
    got = V.noise_scores(d, "score", 20, 6).toPandas()
    assert len(got) == 8000 and abs(got["score"].mean() - d.agg(F.avg("score")).first()[0]) < 0.1 and got["score"].abs().max() <= 20


def test_sweep_shares_scans_and_exchanges(built):
    """The library is read twice, for the pool and for the scores; one exchange by variant serves smoothing and lags."""
    b, _, v, wanted, lib, _, _ = built
    plan = S.scores(lib, v, wanted["lag"])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 2 and "CartesianProduct" not in plan
    plan = S.library(b, b.select("symbol", "dt", F.lit(1.0).alias("c1"), F.lit(1.0).alias("c2"), F.lit(1.0).alias("years12")), wanted)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan", plan)) <= 2 and len(re.findall(r"\bExchange ", plan)) <= 5


def test_a_dropped_symbol_equals_a_run_without_it(spark, built):
    _, _, _, wanted, lib, _, dims = built
    gone = sorted(r[0] for r in lib.select("symbol").distinct().collect())[3]
    both = S.registry(spark, {"less": ("jackknife", {"dropped": gone})})
    a = S.run(lib, both, dims, 52.0).where("variant = 'less'").orderBy("dt").toPandas()
    b = S.run(lib.where(F.col("symbol") != gone), S.registry(spark, {}), dims, 52.0).orderBy("dt").toPandas()
    whole = S.run(lib, S.registry(spark, {}), dims, 52.0).orderBy("dt").toPandas()
    assert np.allclose(a["ret"], b["ret"], atol=1e-12) and (a["trades"] == b["trades"]).all() and not np.allclose(a["ret"].to_numpy(), whole["ret"].to_numpy()[-len(a) :], atol=1e-9)


def test_cash_is_earned_and_taken_off(spark, built):
    _, _, _, wanted, lib, _, dims = built
    rates = spark.createDataFrame([("1990-01-01", 0.001)], "dt string, rate double").select(F.col("dt").cast("date").alias("dt"), "rate")
    v = S.registry(spark, {})
    plain, paid = (S.run(lib, v, dims, 52.0, rates=r).orderBy("dt").toPandas() for r in (None, rates))
    assert (plain["cash"] == 0).all() and np.allclose(paid["cash"], 0.001 * L.CAPITAL) and np.allclose(paid["excess"], paid["ret"] - 0.001) and np.allclose(paid["pnl"], plain["pnl"])


def test_rounding_to_the_nearest_power_by_distance(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 5, 6, 46, 48, 49, 104)], "x double")
    got = [r[0] for r in d.select(nearest_power_of_two(F.col("x"))).collect()]
    assert got == [1, 2, 2, 4, 4, 32, 32, 64, 128]


def test_newey_west_regression_by_key_equals_one_key(spark, returns):
    _, df = returns
    pair = df.where("variant = 'b'").select("dt", F.col("ret").alias("x")).join(df.where("variant = 'c'").select("dt", F.col("ret").alias("y")), "dt")
    one = T.ols_table(pair, "x", ["y"]).orderBy("term").collect()
    by = T.ols_by(pair.withColumn("k", F.lit("v")), "k", "x", ["y"]).orderBy("term").collect()
    plain = lambda rows: [(r["term"], round(r["beta"], 9), round(r["se"], 9), r["n"]) for r in rows]
    assert plain(by) == plain(one)


def test_regressions_of_many_keys(spark):
    """Each of 10,000 keys against NumPy for some; keys of too few rows or a constant column have nulls."""
    rows = spark.range(10_000).select(F.format_string("k%05d", "id").alias("k"), F.col("id"), F.explode(F.sequence(F.lit(1), F.when(F.col("id") == 0, 2).otherwise(12))).alias("dt"))
    u = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "id", "dt"), F.lit(1000)) / 1000.0
    d = rows.withColumns({"x": u(1), "y": F.when(F.col("id") == 1, 5.0).otherwise(u(2)), "z": u(3)}).drop("id")
    got = T.ols_by(d, "k", "x", ["y", "z"], lags=2).toPandas().set_index(["k", "term"]).sort_index()
    assert len(got) == 30_000 and got.loc["k00000"]["beta"].isna().all() and got.loc["k00001"]["se"].isna().all() and got["beta"].notna().sum() == 29_994
    part = d.where("k IN ('k00002', 'k07777')").toPandas().sort_values("dt")
    for k, g in part.groupby("k"):
        a, x = np.column_stack([np.ones(12), g["y"], g["z"]]), g["x"].to_numpy()
        beta = np.linalg.solve(a.T @ a, a.T @ x)
        s = a * (x - a @ beta)[:, None]
        m = s.T @ s + sum((1 - h / 3) * (s[h:].T @ s[:-h] + s[:-h].T @ s[h:]) for h in (1, 2))
        inv = np.linalg.inv(a.T @ a)
        assert np.allclose(got.loc[k].loc[["const", "y", "z"]]["beta"], beta) and np.allclose(got.loc[k].loc[["const", "y", "z"]]["se"], np.sqrt(np.diag(inv @ m @ inv)))


def test_moments_at_refits_equal_those_of_every_row_held(returns):
    _, df = returns
    names = ["m1", "s1", "m2", "s2"]
    held = R.hold_refit(R.split_moments(df, "ret", 52, 20, by="variant"), names, 8, by="variant")
    got = R.split_moments(df, "ret", 52, 20, every=8, by="variant")
    key = lambda d: sorted((r["variant"], r["dt"], *(None if r[n] is None else round(r[n], 12) for n in names)) for r in d.collect())
    assert key(got) == key(held)


def test_variants_left_half_written_are_written_again(spark, tmp_path, returns):
    from strandmill.sources import sinks

    _, df = returns
    path = str(tmp_path / "variants")
    sinks.write_variants(df.where("variant < 'c'"), path)
    df.where("variant = 'd'").limit(7).write.partitionBy("variant").mode("append").parquet(path)  # a run that failed half way
    df.where("variant = 'x'").unionByName(df.where("variant = 'a'").limit(3).withColumn("variant", F.lit("x"))).write.partitionBy("variant").mode("append").parquet(path)
    assert {r[0] for r in sinks.read_variants(spark, path).select("variant").distinct().collect()} == {"a", "b"}
    for _ in range(2):
        sinks.write_variants(df, path)
        got = sinks.read_variants(spark, path).select("variant", "dt", "ret")
        assert got.count() == df.count() and got.exceptAll(df).isEmpty()
    assert {r["variant"]: r["rows"] for r in sinks.committed(spark, path).collect()} == dict.fromkeys("abcdef", 260)


def test_features_are_made_once_and_read_without_exchange(spark):
    from strandmill.sources import features

    made = []

    def make(names):
        made.append(names)
        d = spark.range(200).select(F.format_string("s%d", F.col("id") % 5).alias("symbol"), F.col("id").alias("dt"))
        return d.select("symbol", "dt", *(F.col("dt").cast("double").alias(n) for n in names))

    read = lambda names: features.read_features(spark, "test-content", names, make, ("symbol", "dt"))
    first = read(["a", "b:1"])
    again, more = read(["b:1"]), read(["a", "c"])
    assert made == [["a", "b:1"], ["c"]] and again.columns == ["symbol", "dt", "b:1"] and more.count() == first.count() == 200
    assert more.where("a <> dt OR c <> dt").isEmpty() and read(["c", "b:1"]).count() == 200 and len(made) == 2
    plan = more.groupBy("symbol").agg(F.max("c"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_digest_is_plain_md5_whatever_the_order(spark):
    import hashlib

    from strandmill.operators import aggregates as A

    d = spark.createDataFrame([("b", 1.5, 2), (None, None, 3), ("a", -0.25, None)], "name string, x double, k long")
    texts = ["2|b|1500000", "3|~|~", "~|a|-250000"]
    want = sum(int(hashlib.md5(t.encode()).hexdigest()[:12], 16) for t in texts) % A.DIGEST_MOD
    assert [tuple(A.digest(x).first()) for x in (d, d.repartition(3))] == [(3, want)] * 2 and tuple(A.digest(d.limit(0)).first()) == (0, 0)


def test_long_panel_is_dealt_by_series(spark):
    """Long series: no exchange of rows puts a whole variant into one task."""
    from strandmill.plans import registry

    sf = "/root/testdata/sf0.001"
    got = registry.queries()["sw04_long"](spark, sf)
    dealt = re.findall(r"RepartitionByExpression \[([^\]]*)\]", got._jdf.queryExecution().optimizedPlan().toString())
    assert [re.sub(r"#\d+", "", x) for x in dealt] == ["variant, symbol"]


def test_long_panel_moves_rows_once(spark):
    """What is returned has one exchange of its variants' rows, one of their sums by date, and one of dates; counts and sizes by date come before."""
    from strandmill.plans import registry

    plan = registry.queries()["sw04_long"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 3 and "SortMergeJoin" not in plan


def test_long_series_equal_the_sweep(spark, monkeypatch):
    """Series cut into stretches, and variants of every kind in arrays, give what whole series give, a row for each variant."""
    from strandmill.operators import long_series
    from strandmill.operators import signals as G
    from strandmill.operators import windows as O
    from strandmill.sources import panels as P
    from strandmill.sources.sinks import save

    fast = {"speeds": ["2_8"]}
    of = {"xs": {"w_ts": 0.5, "w_xs": 0.5}, "single": {"fdm_mode": "single", "lag": 2}, "conv": {"conviction": 26, "fdm_least": 13}, "late": {"lag": 1}, "half": {"halflife": 3.0}, "dear": {"cost_mult": 3.0, "smooth_span": 0}, "less": {"dropped": "L03"}, "plain": S.OFF}
    v = S.registry(spark, {k: ("test", fast | o) for k, o in of.items()}).where("variant <> 'master'")
    b = save(P.bars_long(spark, SF).where("symbol < 'L06'"), "bars")
    dims = b.select("symbol").distinct().select("symbol", F.lit(2.0).alias("pointsize"), F.lit(0.5).alias("cost_rt"))
    chain = {"c1": F.col("close"), "c2": O.shift("close", 1), "years12": F.lit(1.0)}
    rates = spark.createDataFrame([("1960-01-01", 0.001)], "dt string, rate double").select(F.col("dt").cast("date").alias("dt"), "rate")
    wanted = S.needs(v)
    want = S.run(S.library(G.prepare(b).withColumns(chain), None, wanted), v, dims, 52.0, wanted["lag"], rates=rates)
    monkeypatch.setattr(long_series, "STRETCH", 100)
    monkeypatch.setattr(long_series, "TIMES", 1)
    monkeypatch.setattr(long_series, "TASK_ROWS", 1000)
    got = long_series.run(b, chain, v, dims, 52.0, rates=rates)
    want, got = (d.select("variant", "dt", "pnl", "commission", "trades", "nav", "ret", "excess").toPandas().sort_values(["variant", "dt"]).reset_index(drop=True) for d in (want, got))
    assert got["variant"].nunique() == len(of) and got[["variant", "dt", "trades"]].equals(want[["variant", "dt", "trades"]])
    assert np.allclose(got[["ret", "excess"]], want[["ret", "excess"]], atol=1e-9) and np.allclose(got[["pnl", "commission", "nav"]], want[["pnl", "commission", "nav"]], rtol=1e-9, atol=1e-3)


@pytest.mark.parametrize("unknown", [False, True])
def test_stretches_reach_over_closes_that_stand_still(spark, monkeypatch, unknown):
    from strandmill.operators import long_series
    from strandmill.operators import signals as G
    from strandmill.operators import windows as O

    rng = np.random.default_rng(5)
    close = 100 + rng.normal(size=(3, 4000)).cumsum(1).round(2)
    close[1, 600:3100] = close[1, 600]
    rows = [(f"S#{k}", i, None if unknown and k == 2 and 500 <= i < 3500 else float(close[k, i])) for k in range(3) for i in range(4000)]
    b = spark.createDataFrame(rows, "symbol string, i int, close double").select("symbol", F.date_add(F.lit("1960-01-01"), "i").alias("dt"), "close")
    chain = {"c1": F.col("close"), "c2": O.shift("close", 1), "years12": F.lit(1.0)}
    wanted = S.needs(S.registry(spark, {"fast": ("test", {"speeds": ["2_8"]})}).where("variant = 'fast'"))
    monkeypatch.setattr(long_series, "STRETCH", 100)
    monkeypatch.setattr(long_series, "TIMES", 1)
    got, n = long_series.library(b, chain, wanted, ["xs52"])
    want = S.library(G.prepare(b).withColumns(chain), None, wanted).toPandas().sort_values(["symbol", "dt"])
    got = got.toPandas().sort_values(["symbol", "dt"])
    assert n == len(got) == len(want) == 12000 and (got["place"].to_numpy() == np.tile(np.arange(4000), 3)).all()
    same = ["close", "vol", *S.features(wanted)]
    assert np.allclose(got[same].astype(float), want[same].astype(float), atol=1e-7, equal_nan=True)


def test_replace_leaves_no_shuffle_files_and_no_old_table(spark):
    from strandmill.sources.sinks import replace, save

    old = save(spark.range(1000), "old")
    new = replace(old.repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "new", old)
    assert new.agg(F.sum("n")).first()[0] == 1000 and spark.read.parquet(old.inputFiles()[0].rpartition("/")[0]).count() == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
