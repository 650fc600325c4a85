"""Queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from strandmill.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["src01_bars", "src05_risk_free", "pf08_common_dates", "jn01_asof", "jn06_term_structure", "wn04_roll_skew", "wn10_drawdown", "rc01_ewm_mean_blocks", "rc03_ewm_std", "xs01_z", "bl07_fdm", "sg01_crossover_fast", "sg14_basis_momentum", "sg44_composite", "rc04_ewm_corr_rates", "lg03_daily_pnl", "lg06_tearsheet", "ag06_windows", "ag15_digest", "sw08_lag_ledger", "sw09_jackknife_ledger", "bs08_mcs", "ag07_describe_dist", "sw12_shuffle_scores", "st02_sharpe_hac", "st08_haircut", "bs02_sharpe_diff", "dq01_qq_mse", "dq04_eigen_compare", "fn04_normal", "fn12_rounding"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "hour"):
        return v.replace(tzinfo=None)
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a))


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(map(plain, r)) for r in df.collect()]
    c = con.execute(registry.oracle_sql()[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(df.columns)
    want = [tuple(plain(r[names.index(k)]) for k in df.columns) for r in c.fetchall()]
    key = lambda t: tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in t)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(map(same, a, b)), (a, b)
