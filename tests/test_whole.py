"""Queries take every entity, event and month, against brute force on small tables."""

import datetime as dt

import numpy as np
import pytest

from tidemark.operators import numeric as N
from tidemark.operators import statistics
from tidemark.operators import validation as V
from tidemark.plans import catalog, model_queries


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """60 suppliers with 30 months of a line each."""
    rng = np.random.default_rng(5)
    months = [dt.date(1995 + m // 12, m % 12 + 1, 3) for m in range(30)]
    rows = [(e, t, float(np.round(rng.uniform(100, 200), 2)), float(rng.integers(1, 9)), 0.05, 0.02) for e in range(1, 61) for t in months]
    top = str(tmp_path_factory.mktemp("wide"))
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double").write.parquet(f"{top}/lineitem.parquet")
    return top


def returns(spark, d):
    out = {}
    for r in model_queries.per_entity(spark, d).collect():
        out.setdefault(r.entity, {})[r.month] = (r.px, r.ret)
    return out


def test_sup_adf_and_covariance_take_all_entities(spark, wide):
    have = returns(spark, wide)
    got = {}
    for r in catalog.queries()["sta_sup_adf"](spark, wide).collect():
        got.setdefault(r.entity, {})[r.month] = r.sadf
    assert set(got) == set(have) == set(range(1, 61))
    for e in (1, 33, 60):
        ms = sorted(have[e])
        want = N.sup_adf(np.log([have[e][m][0] for m in ms]), 20)
        assert np.isfinite(want[19:]).all()
        np.testing.assert_allclose([got[e][m] if got[e][m] is not None else np.nan for m in ms], want)
    pairs = {(r.entity, r.other): r.cov for r in catalog.queries()["sta_covariance"](spark, wide).collect()}
    assert len(pairs) == 60 * 61 // 2
    for a, b in ((1, 2), (30, 55), (60, 60)):
        ms = sorted(have[a])
        np.testing.assert_allclose(pairs[a, b], np.cov([have[a][m][1] for m in ms], [have[b][m][1] for m in ms])[0, 1])


def test_reachable_over_all_entities(spark, wide):
    have = returns(spark, wide)
    x = np.array([[have[e][m][1] for m in sorted(have[e])] for e in sorted(have)])
    near = np.corrcoef(x) > 0.15
    seen, front = {1}, {1}
    while front:
        front = {b + 1 for a in front for b in np.flatnonzero(near[a - 1])} - seen
        seen |= front
    got = sorted(r.node for r in catalog.queries()["graph_reachable_all"](spark, wide).collect())
    assert got == sorted(seen) and max(got) >= 30


def test_every_month_is_a_rebalance(spark, wide):
    """30 months have 29 returns, so the last 5 months have 24 returns before them."""
    have = returns(spark, wide)
    months = sorted(have[1])
    for name in ("pf_hrp", "pf_hrp_sharpe", "pf_black_litterman_hrp", "pf_min_variance_capped", "pf_ewm_covariance_hrp"):
        sums = {}
        for r in catalog.queries()[name](spark, wide).collect():
            sums[r.month] = sums.get(r.month, 0) + r.weight
        assert sorted(sums) == months[-5:], name
        np.testing.assert_allclose(list(sums.values()), 1, rtol=1e-5)
    held = {}
    for r in catalog.queries()["pf_hrp"](spark, wide).collect():
        held[r.month] = held.get(r.month, 0) + r.weight * have[r.entity][r.month][1]
    got = {r.month: r.portfolio for r in catalog.queries()["pf_backtest"](spark, wide).collect()}
    assert got.keys() == held.keys()
    for m in held:
        np.testing.assert_allclose(got[m], held[m])


def test_a_ratio_to_no_drawdown_is_infinite(spark):
    """Rising returns have no drawdown, equal ones no deviation: SQL divides to infinities there (F2)."""
    rows = [(dt.date(2020, m, 1), 0.01 * m, 0.02 * m * m) for m in range(1, 7)]
    got = statistics.return_statistics(spark.createDataFrame(rows, "month date, r double, b double"), "month", "r", "b").first()
    assert got.calmar == np.inf and got.max_drawdown == 0 and 0.99 < got.psr < 1
    same = [(dt.date(2020, m, 1), 0.25, 0.25) for m in range(1, 7)]
    got = statistics.return_statistics(spark.createDataFrame(same, "month date, r double, b double"), "month", "r", "b").first()
    assert got.sharpe == np.inf and got.psr == 1 and np.isnan(got.information_ratio)


def test_linear_models_pass_over_written_rows(spark, sf, monkeypatch):
    """Three models are fitted and judged over rows that are written once (F12)."""
    real, written = model_queries.durable, []
    monkeypatch.setattr(model_queries, "durable", lambda df: written.append(df.columns) or real(df))
    got = {r.model: r.oos_r2 for r in catalog.queries()["ml_linear_models"](spark, sf).collect()}
    assert set(got) == {"ridge", "lasso", "elastic_net"} and all(np.isfinite(v) for v in got.values())
    assert len(written) == 1


def test_each_fold_is_fitted_once(spark, wide, monkeypatch):
    """Two scores of five folds come from five models (F13)."""
    real, fits = V._fit, []
    monkeypatch.setattr(V, "_fit", lambda *a: fits.append(1) or real(*a))
    rows = catalog.queries()["cv_scores"](spark, wide).collect()
    assert sorted((r.fold, r.scoring) for r in rows) == [(k, s) for k in range(5) for s in ("accuracy", "neg_log_loss")]
    assert len(fits) == 5
