"""Queries over their whole job: sizes of the reference, and results against NumPy on small panels."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from strandmill.operators import bootstrap as B
from strandmill.operators import statistics as T
from strandmill.plans import registry

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def pairs(spark):
    rng, day = np.random.default_rng(4), datetime.date(2020, 1, 6)
    pdf = pd.DataFrame([(v, day + datetime.timedelta(days=7 * k), *map(float, rng.normal(0.01, 0.1, 2))) for v in "abc" for k in range(60) if (v, k) != ("c", 7)], columns=["variant", "dt", "x", "y"])
    return pdf, spark.createDataFrame(pdf, "variant string, dt date, x double, y double")


@pytest.mark.parametrize("name", ["bs02_sharpe_diff_full", "bs03_sharpe_ci_full", "bs04_mdd_ci_full"])
def test_intervals_rest_on_all_draws(spark, name):
    assert [r["draws"] for r in rows(spark, name)] == [5000]


def test_pbo_has_all_splits(spark):
    assert len(rows(spark, "st17_pbo")) == math.comb(16, 8)


def test_block_grid_has_all_variants_and_lengths(spark):
    got = rows(spark, "bs09_block_grid")
    variants = {r["variant"] for r in got}
    assert len(variants) > 1 and {(r["variant"], r["block"]) for r in got} == {(v, b) for v in variants for b in (5, 10, 21, 42, 63, 126, 252)}
    assert {r["draws"] for r in got} == {5000}


def test_shuffles_are_a_hundred(spark):
    assert {r["draw"] for r in rows(spark, "sw12_shuffle_scores_full")} == set(range(100))


def test_regressions_have_all_other_strategies_as_targets(spark):
    from strandmill.sources import panels

    names = sorted(r[0] for r in panels.strategies(spark, SF).select("variant").distinct().collect())
    assert {r["variant"] for r in rows(spark, "st13_factor_regression")} == {*names} - {*names[1:4]}


def test_block_grid_equals_numpy(spark, pairs):
    pdf, df = pairs
    got = {(r["variant"], r["block"]): r for r in B.block_grid(df, [4, 9], 40, 3, 52.0).collect()}
    dates = sorted(pdf["dt"].unique())
    for block in (4, 9):
        index = B.block_index(spark, len(dates), block, 40, 3).toPandas()
        for v, one in pdf.groupby("variant"):
            one = one.set_index("dt")
            diff = []
            for _, g in index.groupby("draw"):
                s = one.reindex([dates[r] for r in g["row"]]).dropna()
                diff.append((s["x"].mean() / s["x"].std(ddof=0) - s["y"].mean() / s["y"].std(ddof=0)) * 52**0.5)
            r = got[v, block]
            assert r["draws"] == 40 and np.allclose([r["low"], r["high"]], np.quantile(diff, [0.025, 0.975]), atol=1e-9)


def test_regressions_by_key_equal_single_ones(spark, pairs):
    _, df = pairs
    got = {(r["variant"], r["term"]): r for r in T.ols_by(df, "variant", "x", ["y"]).collect()}
    for v in "abc":
        for r in T.ols_table(df.where(f"variant = '{v}'"), "x", ["y"]).collect():
            assert np.allclose([got[v, r["term"]][c] for c in ("beta", "se", "t", "r2", "n")], [r[c] for c in ("beta", "se", "t", "r2", "n")], atol=1e-9)
