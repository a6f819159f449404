"""Portfolio forms: budgets, caps and risk bounds, and optima against a fine search."""

import numpy as np
import pytest

from tidemark.operators import allocation as P
from tidemark.operators import numeric as N


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(7)
    return rng.normal(0.01, 0.05, (60, 1)) + rng.normal(0, 0.04, (60, 15)) + np.linspace(0, 0.02, 15)


def test_budget_projection_is_nearest():
    rng = np.random.default_rng(1)
    for low, high in ((1, 1), (0.9, 1), (0, 1)):
        v = rng.normal(0.1, 0.3, 12)
        w = P.into_budget(v, low, high, 0, 0.3)
        assert (w >= 0).all() and (w <= 0.3).all() and low - 1e-9 <= w.sum() <= high + 1e-9
        for _ in range(300):
            other = P.into_budget(rng.normal(0.1, 0.3, 12), low, high, 0, 0.3)
            assert ((v - w) ** 2).sum() <= ((v - other) ** 2).sum() + 1e-9


def test_mean_variance_beats_other_weights(x):
    mean, cov, rng = x.mean(0), N.ledoit_wolf(x), np.random.default_rng(2)
    value = lambda w, risk: mean @ w - risk / 2 * w @ cov @ w
    for risk in (0.0, 1.0, 30.0):
        w = P.mean_variance(mean, cov, risk)
        np.testing.assert_allclose(w.sum(), 1, atol=1e-8)
        assert w.max() <= 0.1 + 1e-9 and w.min() >= 0
        for _ in range(500):
            assert value(w, risk) >= value(P.into_budget(rng.normal(0.07, 0.2, 15), 1, 1, 0, 0.1), risk) - 1e-9
    free = P.mean_variance(mean, cov, 0.0, cap=1.0)
    least = N.capped_min_variance(cov, 1.0)
    limit = 0.5 * (free @ cov @ free + least @ cov @ least)
    bound = P.mean_variance(mean, cov, 0.0, cap=1.0, limit=limit)
    np.testing.assert_allclose(bound @ cov @ bound, limit, rtol=1e-2)
    assert P.mean_variance(-np.abs(mean), cov, low=0.0).sum() < 1e-6


def test_shares_and_estimators(x):
    mean, cov = x.mean(0), N.ledoit_wolf(x)
    a, b = P.closed_form_share(0.04, 0.09, 0.02, 0.05)
    np.testing.assert_allclose(a + b, 1)
    # the optimum of mean - variance over two assets without correlation
    grid = np.linspace(-2, 3, 500_001)
    np.testing.assert_allclose(a, grid[np.argmax(grid * 0.02 + (1 - grid) * 0.05 - grid**2 * 0.04 - (1 - grid) ** 2 * 0.09)], atol=1e-4)
    np.testing.assert_allclose(P.bisected(cov, mean, P.equal_risk_share), N.hrp_weights(cov))
    np.testing.assert_allclose(P.bisected(cov, mean, P.closed_form_share).sum(), 1)
    market = np.full(15, 1 / 15)
    np.testing.assert_allclose(np.linalg.solve(2.5 * cov, P.implied_returns(cov, market)), market)
    np.testing.assert_allclose(P.capm_mean(np.repeat(x[:, :1], 3, 1)), np.full(3, np.prod(1 + x[:, 0]) ** (12 / 60) - 1))
    np.testing.assert_allclose(P.causal_covariance(cov, np.eye(15)), cov)
    w = P.component_weights(cov)
    np.testing.assert_allclose(w @ cov @ w, 1)


def test_robust_takes_the_best_scenario(x):
    mean, cov = x.mean(0), N.ledoit_wolf(x)
    made = P.scenarios(mean, cov)
    assert len(made) == 10 and all(np.linalg.eigvalsh(c)[0] > 0 for _, c in made)
    w = P.robust(mean, cov, state=1)
    np.testing.assert_allclose(w.sum(), 0.9, atol=1e-8)
    assert w.max() <= 0.1 + 1e-9
    worst = lambda u: min(-m @ u + 0.5 * u @ c @ u for m, c in made)
    rng = np.random.default_rng(3)
    assert all(worst(w) <= worst(P.into_budget(rng.normal(0.06, 0.2, 15), 0.9, 0.9, 0, 0.1)) + 1e-9 for _ in range(500))


def test_any_function_is_a_strategy(spark):
    rows = [(d, a, [0.01 * a, 0.02, -0.01], 1.0 + a) for d in (1, 2) for a in (3, 1, 2)]
    df = spark.createDataFrame(rows, "d int, a int, past array<double>, size double")
    got = P.weigh(df, lambda x, c: c["size"] / c["size"].sum(), "d", "a", "past", ["size"]).collect()
    assert {(r.d, r.a): round(r.weight, 6) for r in got} == {(d, a): round((1 + a) / 9, 6) for d in (1, 2) for a in (1, 2, 3)}
    assert P.weigh(df.limit(0), "components", "d", "a", "past").count() == 0
