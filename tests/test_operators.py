"""Recursive operators against pandas and plain loops; plans; empty tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandmill.operators import bootstrap as B
from strandmill.operators import joins as J
from strandmill.operators import recursive as R
from strandmill.operators import windows as O
from strandmill.plans.registry import queries
from strandmill.sources.sinks import numbered


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(s, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(x)) for s in "ab" for i, x in enumerate(rng.normal(size=400).cumsum())]
    return pd.DataFrame(rows, columns=["symbol", "dt", "x"]), spark.createDataFrame([(s, t.to_pydatetime(), x) for s, t, x in rows], "symbol string, dt timestamp, x double")


@pytest.mark.parametrize("block", [None, 64])
def test_ewm(panel, block):
    pdf, df = panel
    got = R.ewm_std(R.ewm_mean(df, "x", "m", span=5, block=block), "x", "s", span=5, block=block).toPandas().sort_values(["symbol", "dt"])
    g = pdf.groupby("symbol")["x"]
    assert np.allclose(got["m"], g.transform(lambda v: v.ewm(span=5).mean()), atol=1e-9)
    assert np.allclose(got["s"].fillna(-1), g.transform(lambda v: v.ewm(span=5).std()).fillna(-1), atol=1e-6)


def test_deadband(panel):
    pdf, df = panel
    got = R.deadband(df, "x", "held").toPandas().sort_values(["symbol", "dt"])
    for s, rows in pdf.groupby("symbol"):
        now, want = 0.0, []
        for x in rows["x"]:
            if abs(x - now) > max(0.1 * abs(x), 0.5):
                now = math.copysign(math.floor(abs(x) + 0.5), x)
            want.append(now)
        assert got[got["symbol"] == s]["held"].tolist() == want


def test_rolling_skew_and_quintile(panel):
    pdf, df = panel
    got = df.select("symbol", "dt", O.roll_skew("x", 20).alias("k")).toPandas().sort_values(["symbol", "dt"])
    assert np.allclose(got["k"].fillna(0), pdf.groupby("symbol")["x"].transform(lambda v: v.rolling(20).skew()).fillna(0), atol=1e-7)


def test_constant_series_gives_null(spark):
    df = spark.range(30).select(F.lit("a").alias("symbol"), F.col("id").alias("dt"), F.lit(1.0).alias("x"), F.col("id").cast("double").alias("y"))
    assert {r[0] for r in df.select(O.roll_corr("x", "y", 10)).collect()} == {None}


def test_asof_needs_one_shuffle(spark, panel):
    _, df = panel
    plan = J.asof(df, df.select("symbol", "dt", F.col("x").alias("v")), "v", by="symbol")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "SortMergeJoin" not in plan


def test_block_index_is_circular(spark):
    rows = B.block_index(spark, 10, 4, 3, 1).collect()
    assert len(rows) == 30 and {r["row"] for r in rows} <= set(range(10))
    first = sorted((r["place"], r["row"]) for r in rows if r["draw"] == 0)[:4]
    assert [x for _, x in first] == [(first[0][1] + k) % 10 for k in range(4)]


def test_empty_panel(spark):
    df = spark.createDataFrame([], "symbol string, dt timestamp, x double")
    assert R.ewm_mean(df, "x", "m", span=5).count() == 0
    assert R.deadband(df, "x", "held").count() == 0


@pytest.fixture(scope="module")
def long_panel(spark):
    """Two series of 10,000 rows about a level of 29, with nulls in one."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b"], 10_000), "dt": np.tile(np.arange(10_000), 2), "x": 29 + rng.normal(0, 5, 20_000), "y": rng.normal(0, 1, 20_000)})
    pdf["y"] += 0.3 * pdf["x"]
    pdf["span"] = np.where(pdf["symbol"] == "a", 416.0, 7.0)
    pdf["z"] = pdf["x"].where((pdf["symbol"] == "a") | (pdf["dt"] % 3 != 0))
    rows = pdf.astype(object).where(pdf.notna(), None)
    return pdf, spark.createDataFrame(rows.values.tolist(), "symbol string, dt long, x double, y double, span double, z double").cache()


def test_many_rates_at_once_on_long_series(long_panel):
    pdf, df = long_panel
    spans = (2, 5, 16, 128, 512, 3000)
    for column, adjust in (("x", True), ("z", True), ("x", False)):
        got = R.ewm_means(df, {f"m{s}": (column, 2 / (s + 1)) for s in spans}, adjust=adjust).orderBy("symbol", "dt").toPandas()
        for s in spans:
            want = pdf.groupby("symbol")[column].transform(lambda v: v.ewm(span=s, adjust=adjust).mean())  # noqa: B023
            assert np.allclose(got[f"m{s}"].astype(float), want, rtol=0, atol=1e-9, equal_nan=True), (column, adjust, s)


def test_a_rate_for_each_series_on_long_series(long_panel):
    pdf, df = long_panel
    rate = 2 / (F.col("span") + 1)
    got = R.ewm_means(df, {"m": ("x", rate), "n": ("x", 2 / 4)}).orderBy("symbol", "dt").toPandas()
    by = dict(pdf.groupby("symbol")["span"].first())
    parts = [g for _, g in pdf.groupby("symbol")]
    assert np.allclose(got["m"], pd.concat(g["x"].ewm(span=by[g["symbol"].iloc[0]]).mean() for g in parts), rtol=0, atol=1e-9)
    assert np.allclose(got["n"], pdf.groupby("symbol")["x"].transform(lambda v: v.ewm(span=3).mean()), rtol=0, atol=1e-9)
    d, names = R.ewm_rhos(df, ["x", "y"], rate, by=("symbol",))
    rho = d.orderBy("symbol", "dt").toPandas()[names["x", "y"]].astype(float).to_numpy()

    def exact(g):
        q, out, s = 1 - 2 / (by[g["symbol"].iloc[0]] + 1), [], np.zeros(6)
        for x, y in zip(g["x"], g["y"]):
            s = s * q + np.array([1, x, y, x * x, y * y, x * y])
            w, mx, my = s[0], s[1] / s[0], s[2] / s[0]
            out.append((s[5] / w - mx * my) / math.sqrt(max((s[3] / w - mx * mx) * (s[4] / w - my * my), 1e-300)))
        return out

    want = np.concatenate([exact(g) for g in parts])
    late = np.tile(np.arange(10_000) > 20, 2)
    assert np.allclose(rho[late], want[late], rtol=0, atol=1e-7)


def test_a_rate_of_one_and_of_nothing(long_panel):
    pdf, df = long_panel
    got = R.decayed_sums(df.where("dt < 900"), {"last": (F.col("x"), 0.0), "all": (F.col("x"), 1.0)}).orderBy("symbol", "dt").toPandas()
    short = pdf[pdf["dt"] < 900]
    assert np.allclose(got["last"], short["x"], atol=1e-9) and np.allclose(got["all"], short.groupby("symbol")["x"].cumsum(), atol=1e-6)


def test_deadband_across_variants_equals_one_at_a_time(spark, panel):
    _, df = panel
    many = df.crossJoin(spark.range(70).select(F.col("id").alias("variant"))).withColumn("t", F.when((F.col("variant") + F.unix_timestamp("dt")) % 7 != 0, F.col("x") * (1 + F.col("variant") / 10)))
    keys = ("variant", "symbol")
    one = R.deadband(many, "t", "held", by=keys)
    for lots in (1, 4):
        got = R.deadband(many, "t", "held", by=keys, across="variant", lots=lots)
        assert got.count() == many.count() and got.exceptAll(one).isEmpty() and one.exceptAll(got).isEmpty()


@pytest.mark.parametrize("stretch", [7, 64, 1 << 16])
def test_decayed_sums_over_stretches(spark, stretch):
    """A numbered series is cut into stretches, each a window of its own; sums are those of the recursion, for fast, slow, constant and undecayed ones."""
    n, rates = 300, {"a": 0.9999, "b": 0.5, "c": 1.0, "d": 0.0, "e": 0.93}
    rows = [(s, i, None if i % 11 == 3 else float((i * 7919 + s) % 101), 0.8 + 0.19 * s) for s in range(2) for i in range(n - 50 * s)]
    df = spark.createDataFrame(rows, "symbol int, dt int, x double, q double").withColumn("place", F.col("dt").cast("long"))
    sums = {k: (F.col("x"), q) for k, q in rates.items()} | {"own": (F.col("x"), F.col("q"))}
    out = R.decayed_sums(df, sums, place="place", stretch=stretch)
    assert sorted(out.columns) == sorted([*df.columns, *sums])
    got = {(r.symbol, r.dt): r for r in out.collect()}
    assert len(got) == len(rows)
    held: dict = {}
    for s, i, x, q in rows:
        for k, rate in (rates | {"own": q}).items():
            held[s, k] = held.get((s, k), 0.0) * rate + (x or 0.0)
            assert got[s, i][k] == pytest.approx(held[s, k], rel=1e-9, abs=1e-9)


def test_numbered_spreads_a_series(spark):
    """Places of a series over several ranges, against a plain numbering."""
    rows = [(i % 2, (i * 37) % 501, i) for i in range(1000)]
    d = numbered(spark.createDataFrame(rows, "symbol int, dt int, x int"), ["symbol"], ["dt", "x"], ["dt", "x"])
    want = {x: k for s in range(2) for k, (_, _, x) in enumerate(sorted((r for r in rows if r[0] == s), key=lambda r: r[1:]))}
    assert {r.x: r.place for r in d.collect()} == want
    for name in ("rc01_ewm_rates", "rc04_ewm_corr_rates"):  # no window numbers a nation's rows in one task
        assert "windowspecdefinition(s_nationkey" not in queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
