"""Portfolio forms for one rebalance date: estimators of mean and covariance, and weights from them.

A strategy is a function ``(returns, context) -> weights`` over the selected assets, where ``returns``
holds a row a period and a column an asset, and ``context`` has caps, signals and the like by name.
``strategy(name)`` registers one; ``weigh`` runs any of them, registered or not, for every date."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame

from . import numeric as N

Strategy = Callable[[np.ndarray, dict], np.ndarray]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str):
    def add(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return add


def weigh(picks: DataFrame, how: Strategy | str, date: str, asset: str, past: str, context: Sequence[str] = ()) -> DataFrame:
    """Weights of each date's selected assets (``past``: an array of returns); the selection bounds a group's size."""
    import pandas as pd

    fn = STRATEGIES[how] if isinstance(how, str) else how
    kinds = {f.name: f.dataType.simpleString() for f in picks.schema.fields}

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(asset)
        x = np.stack(g[past].to_numpy()).T
        return pd.DataFrame({date: g[date], asset: g[asset], "weight": fn(x, {c: g[c].to_numpy(float) for c in context})})

    return picks.select(date, asset, past, *context).groupBy(date).applyInPandas(run, f"`{date}` {kinds[date]}, `{asset}` {kinds[asset]}, weight double")


def implied_returns(cov: np.ndarray, market: np.ndarray, risk: float = 2.5) -> np.ndarray:
    """Mean returns under which the market portfolio is optimal."""
    return risk * cov @ market


def capm_mean(x: np.ndarray, free: float = 0.0, periods: int = 12) -> np.ndarray:
    """Annual mean by beta against the equal-weighted market of the assets, with compounded market return."""
    m = x.mean(1)
    beta = ((x - x.mean(0)) * (m - m.mean())[:, None]).sum(0) / max(1e-18, ((m - m.mean()) ** 2).sum())
    grown = np.prod(1 + m)
    annual = grown ** (periods / len(m)) - 1 if grown > 0 else -1.0
    return free + beta * (annual - free)


def causal_covariance(cov: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Covariance whose correlations are multiplied (as matrices) with the symmetric edge scores, scaled to a largest of 1."""
    e = edges / edges.max()
    sd = np.sqrt(np.diag(cov))
    out = N.correlation(cov) @ np.maximum(e, e.T) * np.outer(sd, sd)
    low = np.linalg.eigvals(out).real.min()
    return out + (1e-6 - low) * np.eye(len(out)) if low < 0 else out


def bisected(cov: np.ndarray, mean: np.ndarray, share: Callable[[float, float, float, float], tuple[float, float]]) -> np.ndarray:
    """Weights down the bisected leaf order; ``share`` splits between two halves of given variances and means."""
    order = N.single_linkage_order(np.nan_to_num(np.sqrt((1 - N.correlation(cov)) / 2), nan=1e6))
    w, todo = np.ones(len(cov)), [order]
    inverse = 1 / np.diag(cov)

    def half(items):
        u = inverse[items] / inverse[items].sum()
        return float(u @ cov[np.ix_(items, items)] @ u), float(u @ mean[items])

    while todo:
        items = todo.pop()
        if len(items) > 1:
            mid = len(items) // 2
            (v0, m0), (v1, m1) = half(items[:mid]), half(items[mid:])
            a, b = share(v0, v1, m0, m1)
            w[items[:mid]] *= a
            w[items[mid:]] *= b
            todo += [items[:mid], items[mid:]]
    return w


def closed_form_share(v0: float, v1: float, m0: float, m1: float) -> tuple[float, float]:
    """Two-asset mean-variance optimum with weights that sum to 1 (either may be negative)."""
    p0, p1 = 1 / v0, 1 / v1
    level = (2 - p0 * m0 - p1 * m1) / (2 * (p0 + p1))
    return p0 * (m0 / 2 + level), p1 * (m1 / 2 + level)


def equal_risk_share(v0: float, v1: float, m0: float, m1: float) -> tuple[float, float]:
    return v1 / (v0 + v1), v0 / (v0 + v1)


def into_budget(v: np.ndarray, low: float, high: float, floor: float, cap: float) -> np.ndarray:
    """Nearest weights between ``floor`` and ``cap`` whose sum lies between ``low`` and ``high``."""
    w = np.clip(v, floor, cap)
    total = w.sum()
    if low - 1e-12 <= total <= high + 1e-12:
        return w
    goal = low if total < low else high
    at = np.sort(np.concatenate([v - floor, v - cap]))  # the sum is linear in the shift between these
    sums = np.clip(v - at[:, None], floor, cap).sum(1)
    return np.clip(v - np.interp(-goal, -sums, at), floor, cap)


def mean_variance(mean: np.ndarray, cov: np.ndarray, risk: float = 1.0, cap: float = 0.1, low: float = 1.0, high: float = 1.0, floor: float = 0.0, limit: float | None = None, steps: int = 400) -> np.ndarray:
    """Weights with the largest mean - risk / 2 * variance, by accelerated projected gradient.

    ``limit`` bounds the variance: the aversion to risk is raised as little as meets it (if nothing
    does, the least variance is taken). Caps too tight for the budget are widened to an equal share."""
    n = len(mean)
    cap = max(cap, low / n)
    cov = (cov + cov.T) / 2
    top = max(1e-12, float(np.linalg.eigvalsh(cov)[-1]))

    def best(aversion: float) -> np.ndarray:
        rate = 1 / max(aversion * top, 1e-6 * (np.abs(mean).max() + 1e-12))
        w = y = into_budget(np.full(n, low / n), low, high, floor, cap)
        t = 1.0
        for _ in range(steps):
            new = into_budget(y + rate * (mean - aversion * (cov @ y)), low, high, floor, cap)
            if np.abs(new - w).max() < 1e-11 and np.abs(new - y).max() < 1e-11:
                return new
            t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
            y, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return w

    w = best(risk)
    if limit is None or w @ cov @ w <= limit:
        return w
    a, b = risk, max(risk, 1.0)
    for _ in range(30):
        b *= 4
        w = best(b)
        if w @ cov @ w <= limit:
            break
    for _ in range(25):
        mid = (a + b) / 2
        w = best(mid)
        a, b = (a, mid) if w @ cov @ w <= limit else (mid, b)
    return best(b)


def scenarios(mean: np.ndarray, cov: np.ndarray, count: int = 10, level: float = 0.05, seed: int = 42) -> list[tuple[np.ndarray, np.ndarray]]:
    """Perturbed means and covariances; each covariance gains a random positive part."""
    rng, out = np.random.RandomState(seed), []
    for _ in range(count):
        shifted = mean + level * rng.randn(len(mean))
        noise = level * rng.randn(*cov.shape)
        out.append((shifted, N.psd_repair((cov + cov.T) / 2 + noise @ noise.T)))
    return out


def robust(mean: np.ndarray, cov: np.ndarray, state: int = 1, aversion: float = 1.0, total: float = 1.0, cap: float = 0.1, count: int = 10, level: float = 0.05) -> np.ndarray:
    """Weights of the scenario with the least penalised value, optimal in it; the budget falls by a tenth a volatility state.

    The least over weights of the least over scenarios is the least of the scenarios' own optima, so each is solved alone."""
    budget, weight = total - 0.1 * state, aversion**state
    tried = []
    for m, c in scenarios(mean, cov, count, level):
        w = mean_variance(m, c, weight, cap, budget, budget)
        tried.append((float(-m @ w + 0.5 * weight * w @ c @ w), len(tried), w))
    return min(tried)[2]


def component_weights(cov: np.ndarray, shares: np.ndarray | None = None, target: float = 1.0) -> np.ndarray:
    """Weights that spread the risk ``target`` over principal components by ``shares`` (all on the least one by default)."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 1e-18), vectors[:, ::-1]
    if shares is None:
        shares = np.eye(len(cov))[-1]
    return vectors @ (target * np.sqrt(shares / values))


def _market(x, context):
    cap = context.get("cap")
    return cap / cap.sum() if cap is not None else np.full(x.shape[1], 1 / x.shape[1])


@strategy("equilibrium")
def _equilibrium(x, context):
    cov = N.ledoit_wolf(x)
    return N.hrp_weights(cov, implied_returns(cov, _market(x, context)))


@strategy("capm")
def _capm(x, context):
    return N.hrp_weights(N.ledoit_wolf(x), capm_mean(x))


@strategy("causal")
def _causal(x, context):
    """Edge scores are the absolute correlations of each asset with every other one a period later."""
    z = (x - x.mean(0)) / (x.std(0) + 1e-12)
    return mean_variance(N.ewm_moments(x, 12)[0], causal_covariance(N.ledoit_wolf(x), np.abs(z[:-1].T @ z[1:]) / (len(z) - 1) + 1e-9), floor=1e-6)


@strategy("closed_form")
def _closed_form(x, context):
    return bisected(N.ledoit_wolf(x), x.mean(0), closed_form_share)


@strategy("equal_risk")
def _equal_risk(x, context):
    return bisected(N.ledoit_wolf(x), x.mean(0), equal_risk_share)


@strategy("mean_variance")
def _mean_variance(x, context):
    """Fully invested, variance no more than the equal-weighted market's and a margin."""
    return mean_variance(x.mean(0), N.ledoit_wolf(x), limit=float(x.mean(1).var(ddof=1)) + 0.01)


@strategy("mean_variance_partly")
def _partly(x, context):
    return mean_variance(x.mean(0), N.ledoit_wolf(x), low=0.9)


@strategy("mean_variance_free")
def _free(x, context):
    return mean_variance(x.mean(0), N.ledoit_wolf(x), low=0.0)


@strategy("max_return")
def _max_return(x, context):
    return mean_variance(x.mean(0), N.ledoit_wolf(x), risk=0.0, limit=float(x.mean(1).var(ddof=1)) + 0.01)


@strategy("robust")
def _robust(x, context):
    """State 1 where the last year's volatility is above that of all periods, else 0."""
    m = x.mean(1)
    return robust(x.mean(0), N.ledoit_wolf(x), state=int(m[-12:].std() > m.std()))


@strategy("components")
def _components(x, context):
    return component_weights(N.ledoit_wolf(x))


@strategy("long_short")
def _long_short(x, context):
    """Equal weights, long where the signal is positive and short where it is negative."""
    s = np.sign(context["ret"])
    return s / max(1, np.abs(s).sum())
