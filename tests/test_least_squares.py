"""Regressions inside the plan against numpy's."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import months
from tidemark.operators import least_squares as L
from tidemark.plans.substrate import numbered


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(8)
    out = {}
    for s, k in (("a", 90), ("b", 60), ("c", 26), ("tiny", 15)):
        e = np.zeros(k)
        for i in range(2, k):
            e[i] = 0.5 * e[i - 1] + 0.2 * e[i - 2] + rng.normal(0, 3)
        out[s] = 100 + 0.3 * np.arange(k) + 8 * np.sin(np.arange(k) * np.pi / 6) + e
    out["walk"] = rng.normal(0, 1, 120).cumsum()
    out["flat"] = np.full(40, 7.0)
    return out


@pytest.fixture(scope="module")
def obs(spark, series):
    rows = [(s, d, float(v)) for s, y in series.items() for d, v in zip(months(len(y)), y)]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def design(y, t, n, size, lags, trend, period):
    """One row of the regression, by hand."""
    k = min(lags, max(1, size // 3))
    x = ([1.0] if "c" in trend else []) + ([(t + 1) / n] if "t" in trend else [])
    if period and size > lags + period + 2:
        x += [float(t % period == s) for s in range(1 if "c" in trend else 0, period)]
    return x + [y[t - i] for i in range(1, k + 1)], k


@pytest.mark.parametrize("lags, trend, period", [(2, "c", None), (3, "n", None), (3, "t", None), (12, "ct", None), (3, "ct", 12), (2, "n", 4)])
def test_autoregression(obs, series, lags, trend, period):
    got = {refit: {(r.series_id, r.ds): r for r in L.autoregression(obs, lags, trend, period, 12, refit).collect()} for refit in (False, True)}
    ahead = {(r.series_id, r.step): r.pred for r in L.autoregression_ahead(obs, 5, lags, trend, period).collect()}
    for s, y in series.items():
        n = len(y)
        for refit in (False, True):
            for t in range(n - 12, n):
                rows = [design(y, i, n, n - 12, lags, trend, period)[0] for i in range(design(y, t, n, n - 12, lags, trend, period)[1], t if refit else n - 12)]
                _, k = design(y, t, n, n - 12, lags, trend, period)
                r = got[refit][(s, months(n)[t])]
                assert r.n_fit == len(rows)
                if len(rows) < k + ("c" in trend) + ("t" in trend) + 2:
                    assert r.pred == y[t - 1]
                    continue
                target = y[k : k + len(rows)]
                w = np.linalg.lstsq(np.array(rows), target, rcond=None)[0]
                want = design(y, t, n, n - 12, lags, trend, period)[0] @ w
                if s != "tiny":  # as many columns as rows: the weights are not one
                    assert math.isclose(r.pred, want, rel_tol=1e-6, abs_tol=1e-5), (s, t, refit)
                    assert math.isclose(r.rss, ((target - np.array(rows) @ w) ** 2).sum(), rel_tol=1e-5, abs_tol=1e-5)
        _, k = design(y, n - 1, n, n, lags, trend, period)
        rows = [design(y, i, n, n, lags, trend, period)[0] for i in range(k, n)]
        if s in ("a", "b", "walk"):
            w = np.linalg.lstsq(np.array(rows), y[k:], rcond=None)[0]
            h = list(y)
            for step in range(1, 6):
                h.append(design(h, n + step - 1, n, n, lags, trend, period)[0] @ w)
                assert math.isclose(ahead[(s, step)], h[-1], rel_tol=1e-6, abs_tol=1e-5)
    with pytest.raises(ValueError):
        L.autoregression(obs, trend="x")


def unit_root_by_hand(y, p):
    d = np.diff(y)
    x = np.array([[1.0, y[i], *[d[i - j] for j in range(1, p + 1)]] for i in range(p, len(d))])
    t = d[p:]
    w, *_ = np.linalg.lstsq(x, t, rcond=None)
    rss = ((t - x @ w) ** 2).sum()
    return w[1], w[1] / math.sqrt(rss / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]), len(t)


def test_unit_root(obs, series):
    for lag in (0, 1, 3):
        got = {r.series_id: r for r in L.unit_root(obs, lag).collect()}
        for s in ("a", "b", "c", "tiny", "walk"):
            slope, t, n = unit_root_by_hand(series[s], lag)
            assert got[s].n == n and math.isclose(got[s].slope, slope, rel_tol=1e-6) and math.isclose(got[s].t, t, rel_tol=1e-6)
        assert got["flat"].t is None and got["flat"].p is None
    got = {r.series_id: r for r in L.unit_root(obs).collect()}
    for s in ("a", "b", "c", "tiny", "walk"):
        y = series[s]
        n, d = len(y), np.diff(y)
        most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2, 15)
        full = np.array([[1.0, y[i], *[d[i - j] for j in range(1, most + 1)]] for i in range(most, len(d))])
        best = []
        for p in range(most + 1):
            w = np.linalg.lstsq(full[:, : p + 2], d[most:], rcond=None)[0]
            rss = ((d[most:] - full[:, : p + 2] @ w) ** 2).sum()
            best.append((len(full) * math.log(rss / len(full)) + 2 * (p + 2), p))
        p = min(best)[1]
        _, t, k = unit_root_by_hand(y, p)
        assert (got[s].lag, got[s].n) == (p, k) and math.isclose(got[s].t, t, rel_tol=1e-6), s


def test_unit_root_p(spark):
    """Published critical values with a constant for long series."""
    for t, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-20.0, 0.0), (3.0, 1.0)):
        assert abs(spark.range(1).select(L.unit_root_p(F.lit(t)).alias("p")).first().p - p) < 1.5e-3
    assert spark.range(1).select(L.unit_root_p(F.lit(None).cast("double")).alias("p")).first().p is None


def test_collinear_columns_are_left_out(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(10)], "a double, b double, y double")
    r = L.regressions(rows, [], [F.lit(1.0), F.col("a"), F.col("b")], F.col("y"), inverse=True).first()
    assert np.allclose(r.fit.weights, [1, 3, 0]) and r.fit.rss < 1e-9 and r.fit.inverse[2] == 0
    assert np.allclose(r.fit.inverse[:2], np.diag(np.linalg.inv(np.array([[10, 45], [45, 285.0]]))))
