"""Dense kernels for one group at a time: unit-root tests, covariances, hierarchical portfolios, views, state models."""

from __future__ import annotations

import math

import numpy as np


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and their covariance."""
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    rest = y - x @ beta
    return beta, inverse * (rest @ rest) / max(1, len(y) - x.shape[1])


def adf_statistic(series: np.ndarray, lags: int = 1, trend: bool = False) -> float:
    """t statistic of the level in the regression of differences on level, lagged differences and constant."""
    d = np.diff(series)
    n = len(d) - lags
    if n < lags + 4:
        return math.nan
    cols = [series[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1)), np.ones(n)]
    if trend:
        cols.append(np.arange(n, dtype=float))
    beta, cov = ols(d[lags:], np.stack(cols, 1))
    return float(beta[0] / math.sqrt(cov[0, 0])) if cov[0, 0] > 0 else math.nan


def sup_adf(series: np.ndarray, least: int = 20, lags: int = 1, chunk: int = 1 << 15) -> np.ndarray:
    """For every end the largest ADF statistic (constant and trend) over all starts; missing before ``least`` rows.

    The regressions of one end differ in their first row alone, so their cross products are differences
    of running sums; about ``chunk`` regressions are solved at once, those near singular by pseudo-inverses."""
    out = np.full(len(series), math.nan)
    if len(series) < least:
        return out
    x = (series - series.mean()) / (series.std() or 1.0)
    d = np.diff(x)
    n = len(d) - lags
    cols = np.stack([x[lags:-1], *(d[lags - k : len(d) - k] for k in range(1, lags + 1)), np.ones(n), np.arange(n) / n, d[lags:]], 1)
    run = np.concatenate([np.zeros((1, cols.shape[1], cols.shape[1])), np.cumsum(cols[:, :, None] * cols[:, None, :], 0)])
    p = cols.shape[1] - 1
    order = [p - 2, p - 1, *range(1, lags + 1), 0, p]  # the level last: its coefficient is what is left when the others are swept out
    firsts = np.arange(least, len(series) + 1)
    counts = firsts - least + 1
    for part in np.split(firsts, np.flatnonzero(np.diff(np.cumsum(counts) // chunk)) + 1):
        size = part - least + 1
        cuts = np.cumsum(size) - size
        end = np.repeat(part - lags - 1, size)
        start = np.arange(len(end)) - np.repeat(cuts, size)
        c = {(i, j): run[end, order[i], order[j]] - run[start, order[i], order[j]] for i in range(p + 1) for j in range(i, p + 1)}
        rows, weak = end - start, np.zeros(len(end), bool)
        whole = [c[i, i] for i in range(p)]
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(p - 1):
                weak |= ~(c[k, k] > 1e-8 * whole[k])
                for i in range(k + 1, p + 1):
                    f = c[k, i] / c[k, k]
                    for j in range(i, p + 1):
                        c[i, j] = c[i, j] - f * c[k, j]
            level, both = c[p - 1, p - 1], c[p - 1, p]
            weak |= ~(level > 1e-8 * whole[p - 1])
            var = np.maximum(c[p, p] - both * both / level, 0) / level / np.maximum(1, rows - p)
            t = np.where((rows >= lags + 4) & (var > 0), both / level / np.sqrt(np.where(var > 0, var, 1)), math.nan)
        weak = np.flatnonzero(weak)
        for at in range(0, len(weak), 4096):
            w = weak[at : at + 4096]
            t[w] = _level_statistic(run[end[w]] - run[start[w]], rows[w], lags)
        out[part - 1] = np.fmax.reduceat(t, cuts)
    return out


def _level_statistic(cross: np.ndarray, rows: np.ndarray, lags: int) -> np.ndarray:
    """t statistics of the first coefficient from cross products that may be singular."""
    p = cross.shape[1] - 1
    inverse = np.linalg.pinv(cross[:, :p, :p], hermitian=True)
    beta = np.einsum("sij,sj->si", inverse, cross[:, :p, p])
    rest = np.maximum(cross[:, p, p] - np.einsum("si,si->s", beta, cross[:, :p, p]), 0)
    var = inverse[:, 0, 0] * rest / np.maximum(1, rows - p)
    return np.where((rows >= lags + 4) & (var > 0), beta[:, 0] / np.sqrt(np.where(var > 0, var, 1)), math.nan)


def least_difference(series: np.ndarray, critical: float = -2.86, threshold: float = 0.01) -> float:
    """Smallest d of 0, 0.05, ... 1 whose fractional difference passes the ADF test; 1 if none does."""
    for d in np.arange(0, 1.0001, 0.05):
        w = [1.0]
        while abs(w[-1]) >= threshold and len(w) < len(series):
            w.append(-w[-1] * (d - len(w) + 1) / len(w))
        x = np.convolve(series, w, "valid")
        if len(x) > 12 and adf_statistic(x) < critical:
            return round(float(d), 2)
    return 1.0


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Covariance shrunk to a scaled identity with the closed-form optimal intensity (rows are samples)."""
    n, p = x.shape
    x = x - x.mean(0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / (n * n * p))
    k = b2 / d2 if d2 > 0 else 0.0
    return k * mu * np.eye(p) + (1 - k) * s


def psd_repair(cov: np.ndarray) -> np.ndarray:
    low = np.linalg.eigvalsh(cov)[0]
    return cov + (-low + 1e-6) * np.eye(len(cov)) if low < 0 else cov


def correlation(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.clip(cov / np.outer(sd, sd), -1, 1)
    np.fill_diagonal(c, 1.0)
    return c


def single_linkage_order(rows: np.ndarray) -> list[int]:
    """Leaf order of the single-linkage tree over rows as points (minimum spanning tree, merged by length)."""
    n = len(rows)
    gap = np.sqrt(((rows[:, None, :] - rows[None, :, :]) ** 2).sum(2))
    best, parent, inside, edges = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool), []
    best[0] = 0
    for _ in range(n):
        i = int(np.argmin(np.where(inside, np.inf, best)))
        inside[i] = True
        if i:
            edges.append((best[i], int(parent[i]), i))
        closer = ~inside & (gap[i] < best)
        best[closer], parent[closer] = gap[i][closer], i
    groups = {i: [i] for i in range(n)}
    at = list(range(n))
    for _, a, b in sorted(edges):
        a, b = at[a], at[b]
        a, b = min(a, b), max(a, b)
        groups[a] = groups[a] + groups.pop(b)
        for i in groups[a]:
            at[i] = a
    return groups[at[0]]


def hrp_weights(cov: np.ndarray, mean: np.ndarray | None = None) -> np.ndarray:
    """Hierarchical risk parity: bisection of the leaf order by inverse cluster variance, or by cluster Sharpe ratio if ``mean`` is given."""
    distance = np.nan_to_num(np.sqrt((1 - correlation(cov)) / 2), nan=1e6)
    order = single_linkage_order(distance)
    w = np.ones(len(cov))

    def cluster(items: list[int]) -> tuple[float, float]:
        inverse = 1 / np.diag(cov)[items]
        inverse /= inverse.sum()
        return float(inverse @ cov[np.ix_(items, items)] @ inverse), float(inverse @ mean[items]) if mean is not None else 0.0

    todo = [order]
    while todo:
        items = todo.pop()
        if len(items) < 2:
            continue
        left, right = items[: len(items) // 2], items[len(items) // 2 :]
        (v0, m0), (v1, m1) = cluster(left), cluster(right)
        if mean is None:
            share = (1 - v0 / (v0 + v1), v0 / (v0 + v1))
        else:
            s0, s1 = max(m0 / math.sqrt(v0), 0), max(m1 / math.sqrt(v1), 0)
            share = (s0 / (s0 + s1 + 1e-6), s1 / (s0 + s1 + 1e-6))
        w[left] *= share[0]
        w[right] *= share[1]
        todo += [left, right]
    return w


def black_litterman(cov: np.ndarray, market: np.ndarray, signal: np.ndarray, mean: np.ndarray, tau: float = 0.05, risk: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Posterior mean and covariance with one view per asset, sized and trusted by the signal."""
    s = np.clip(np.abs(signal), 1e-3, 1 - 1e-3)
    prior = risk * cov @ market
    trust = np.diag(1 / (s * (1 - s) * np.diag(cov)))
    inverse = np.linalg.inv(tau * cov)
    post = np.linalg.inv(inverse + trust)
    return post @ (inverse @ prior + trust @ (s * mean)), post


def capped_min_variance(cov: np.ndarray, cap: float, steps: int = 500) -> np.ndarray:
    """Long-only minimum variance with a cap per asset, by projected gradient on the capped simplex."""
    n = len(cov)
    cap = max(cap, 1.0 / n)
    rate = 1 / max(1e-12, np.linalg.eigvalsh(cov)[-1])
    w = np.full(n, 1.0 / n)
    for _ in range(steps):
        v = w - rate * cov @ w
        low, high = v.min() - cap - 1, v.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(v - mid, 0, cap).sum() > 1 else (low, mid)
        w = np.clip(v - (low + high) / 2, 0, cap)
    return w / w.sum()


def ewm_moments(x: np.ndarray, span: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentially weighted mean and debiased covariance of the rows, as of the last one."""
    a = 2 / (span + 1)
    w = (1 - a) ** np.arange(len(x) - 1, -1, -1)
    w /= w.sum()
    m = w @ x
    c = (x - m).T @ ((x - m) * w[:, None])
    return m, c / (1 - (w**2).sum())


def gaussian_states(x: np.ndarray, states: int = 3, rounds: int = 50) -> np.ndarray:
    """Most likely states of a one-dimensional Gaussian hidden Markov model; states are numbered by rising mean."""
    mean = np.quantile(x, (np.arange(states) + 0.5) / states)
    var, start, move = np.full(states, x.var() + 1e-12), np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9)
    for _ in range(rounds):
        dens = np.exp(-((x[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * math.pi * var) + 1e-300
        fwd, scale, back = np.zeros_like(dens), np.zeros(len(x)), np.ones_like(dens)
        for t in range(len(x)):
            fwd[t] = dens[t] * (start if t == 0 else fwd[t - 1] @ move)
            scale[t] = fwd[t].sum()
            fwd[t] /= scale[t]
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (dens[t + 1] * back[t + 1]) / scale[t + 1]
        gamma = fwd * back
        gamma /= gamma.sum(1, keepdims=True)
        xi = sum(np.outer(fwd[t], dens[t + 1] * back[t + 1]) * move / scale[t + 1] for t in range(len(x) - 1))
        start, move = gamma[0], xi / xi.sum(1, keepdims=True)
        total = gamma.sum(0) + 1e-12
        mean = (gamma * x[:, None]).sum(0) / total
        var = (gamma * (x[:, None] - mean) ** 2).sum(0) / total + 1e-9
    score = np.log(start + 1e-300) + np.log(dens[0])
    trace = []
    for t in range(1, len(x)):
        step = score[:, None] + np.log(move + 1e-300)
        trace.append(step.argmax(0))
        score = step.max(0) + np.log(dens[t])
    path = [int(score.argmax())]
    for b in reversed(trace):
        path.append(int(b[path[-1]]))
    return np.argsort(np.argsort(mean))[path[::-1]]


def expanding_frac_diff(x: np.ndarray, d: float, loss: float = 0.01) -> np.ndarray:
    """Fractional difference with all earlier rows; rows whose missing weight is above ``loss`` stay empty."""
    w = [1.0]
    for k in range(1, len(x)):
        w.append(-w[-1] * (d - k + 1) / k)
    w = np.array(w)
    lost = np.cumsum(np.abs(w)) / np.abs(w).sum()
    skip = int((lost[::-1] > loss).sum() and (1 - lost > loss).sum())
    return np.array([math.nan if t < skip else float(w[: t + 1][::-1] @ x[: t + 1]) for t in range(len(x))])


def sequential_bootstrap(spans: list[tuple[int, int]], draws: int, seed: int = 0) -> list[int]:
    """Draws of intervals, each with probability in proportion to its uniqueness given those drawn before.

    A draw changes only the intervals that meet it; sums of blocks of intervals find the next one."""
    rng, out = np.random.default_rng(seed), []
    a, b = np.asarray(spans, int).reshape(-1, 2).T
    n, held = len(a), np.zeros(b.max() + 1)
    size = max(64, int(n**0.5))
    unique = np.zeros(-(-n // size) * size)
    unique[:n] = 1.0
    blocks = unique.reshape(-1, size)
    sums = blocks.sum(1)
    ordered = bool((np.diff(a) >= 0).all() and (np.diff(b) >= 0).all())
    for _ in range(draws):
        run = sums.cumsum()
        u = rng.random() * run[-1]
        j = min(int(run.searchsorted(u, side="right")), len(run) - 1)
        within = blocks[j].cumsum()
        k = min(j * size + int(within.searchsorted(u - (run[j - 1] if j else 0.0), side="right")), n - 1)
        out.append(k)
        held[a[k] : b[k] + 1] += 1
        met = slice(int(b.searchsorted(a[k])), int(a.searchsorted(b[k], side="right"))) if ordered else np.flatnonzero((a <= b[k]) & (b >= a[k]))
        x, y = a[met], b[met]
        low = x[0] if ordered else x.min()
        share = np.concatenate([[0.0], (1 / (held[low : (y[-1] if ordered else y.max()) + 1] + 1)).cumsum()])
        unique[met] = (share[y - low + 1] - share[x - low]) / (y - x + 1)
        touched = slice(met.start // size, (met.stop - 1) // size + 1) if ordered else slice(None)
        sums[touched] = blocks[touched].sum(1)
    return out
