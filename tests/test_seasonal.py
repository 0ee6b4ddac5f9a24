"""Seasons against plain loops."""

import numpy as np
import pytest

from tests.test_series import months
from tidemark.operators import seasonal, smoothing, splits
from tidemark.plans.substrate import numbered


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(12)
    t = np.arange(84)
    out = {"mult": (100 + t) * (1 + 0.3 * np.sin(t * np.pi / 6)) + rng.normal(0, 3, 84), "add": t * 0.5 - 20 + 8 * np.cos(t * np.pi / 6) + rng.normal(0, 1, 84), "none": rng.normal(50, 5, 84), "short": rng.normal(50, 5, 30)}
    out["mult"][40] += 400
    return out


@pytest.fixture(scope="module")
def obs(spark, series):
    rows = [(s, d, float(v)) for s, y in series.items() for d, v in zip(months(len(y)), y)]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def by_hand(y, k, m=12):
    """Whether seasonal, and the index of each phase, of the first k values."""
    v = y[:k]
    d = v - v.mean()
    c = np.array([(d[: k - j] * d[j:]).sum() for j in range(m + 1)])
    if k < 2 * m or k * c[m] ** 2 / (c[:m] ** 2).sum() <= seasonal.POINT:
        return None, None
    mult = v.min() > 0
    ma = np.array([(v[i - 6 : i + 6].mean() + v[i - 5 : i + 7].mean()) / 2 for i in range(6, k - 6)])
    left = v[6 : k - 6] / ma if mult else v[6 : k - 6] - ma
    raw = np.array([left[[j for j in range(len(left)) if (j + 6) % m == p]].mean() for p in range(m)])
    return mult, raw / raw.mean() if mult else raw - raw.mean()


def test_theta_with_seasons(obs, series):
    o = splits.tail(obs, 12)
    got = seasonal.theta(o).toPandas()
    found = {r.series_id: r.seasonal for r in seasonal.tested(o).collect()}
    assert found["mult"] and found["add"] and not found["short"]
    for s, y in series.items():
        k = len(y) - 12
        mult, index = by_hand(y, k)
        assert found[s] == (index is not None)
        phase = np.arange(len(y)) % 12
        z = y if index is None else y / index[phase] if mult else y - index[phase]

        def levels(a):
            level, out = z[0], []
            for v in z:
                out.append(level)
                level = a * v + (1 - a) * level
            return np.array(out)

        a = min(smoothing.WEIGHTS, key=lambda a: (round(float(((z - levels(a))[:k] ** 2).sum()), 6), a))
        want = []
        for i, level in enumerate(levels(a)):
            slope = np.polyfit(np.arange(i), z[:i], 1)[0] if i >= 3 else 0.0
            want.append(level + slope / 2 * (1 - (1 - a) ** i) / a)
        want = np.array(want)
        want = want if index is None else want * index[phase] if mult else want + index[phase]
        own = got[got.series_id == s].sort_values("ds")
        assert np.allclose(own.pred, want), s
        assert set(own.weight) == {a} and set(own.seasonal) == {index is not None}


def line(v, w, place, width):
    n = len(v)
    q = min(width, n)
    lo = int(max(min(np.floor(place - (q - 1) / 2), n - q), 0))
    h = max(place - lo, lo + q - 1 - place) + max(width - n, 0) / 2
    i = np.arange(lo, lo + q)
    u = np.minimum(np.abs(i - place) / h, 1)
    t = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - u**3) ** 3)) * w[i]
    if t.sum() <= 0:
        return v[int(min(max(place, 0), n - 1))]
    x = i - place
    mean, mx = (t * v[i]).sum() / t.sum(), (t * x).sum() / t.sum()
    spread = (t * x * x).sum() / t.sum() - mx**2
    if np.sqrt(max(spread, 0)) <= 0.001 * (n - 1):
        return mean
    return mean - mx * ((t * x * v[i]).sum() / t.sum() - mx * mean) / spread


def stl_by_hand(y, m, inner, outer):
    n, w, trend = len(y), np.ones(len(y)), np.zeros(len(y))
    for k in range(outer + 1):
        for _ in range(inner):
            d, c = y - trend, np.zeros(n + 2 * m)
            for j in range(n + 2 * m):
                c[j] = line(d[j % m :: m], w[j % m :: m], j // m - 1, 7)
            low = c
            for size in (m, m, 3):
                low = np.convolve(low, np.ones(size) / size, "valid")
            s = c[m : m + n] - np.array([line(low, np.ones(n), i, 13) for i in range(n)])
            trend = np.array([line(y - s, w, i, 23) for i in range(n)])
        if k < outer:
            r = np.abs(y - s - trend)
            u = r / (6 * np.median(r))
            w = np.where(u <= 0.001, 1.0, np.where(u >= 0.999, 0.0, (1 - u**2) ** 2))
    return trend, s, w


def test_decomposition(obs, series):
    got = seasonal.stl(obs.where("series_id in ('mult', 'short')"), outer=2).toPandas()
    assert set(got.series_id) == {"mult", "short"}
    for s in ("mult", "short"):
        trend, season, w = stl_by_hand(series[s], 12, 2, 2)
        own = got[got.series_id == s].sort_values("t")
        assert np.allclose(own.trend, trend) and np.allclose(own.seasonal, season) and np.allclose(own.weight, w)
        assert np.allclose(own.trend + own.seasonal + own.rest, series[s])
    outlier = got[(got.series_id == "mult") & (got.t == 40)].iloc[0]
    assert outlier.weight == 0 and outlier.rest > 300  # the odd month is left to the rest
    few = obs.where("series_id = 'short' and t < 23")
    assert seasonal.stl(numbered(few.select("series_id", "ds", "y"))).count() == 0


def test_strengths(obs):
    got = {r.series_id: r for r in seasonal.robust_strengths(obs.where("series_id in ('add', 'none')"), outer=1).collect()}
    assert got["add"].seasonal_strength > 0.9 and got["add"].trend_strength > 0.9 and got["none"].trend_strength < 0.8
