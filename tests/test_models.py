"""The fitted models against a plain loop over one series."""

import numpy as np
import pandas as pd

from tests.conftest import SMALL
from tests.test_series import loop_aci, months
from tidemark.operators import experiments, models, smoothing
from tidemark.plans.substrate import numbered
from tidemark.queries import QUERIES


def one_series(n=96, seed=3):
    t = np.arange(n)
    return 20 + 0.05 * t + 2 * np.sin(2 * np.pi * t / 12) + np.random.default_rng(seed).normal(0, 0.4, n)


def prior_and_blocks(y, horizon=12, ratio=0.7):
    n = len(y)
    p = np.array([y[max(0, i - 6) : i].mean() if i else y[0] for i in range(n)])
    k = n - horizon
    r = min(max(round(k * ratio), 11), k - 6)
    a = min(max(r + round(k * 0.2), r + 3), k - 3)
    block = np.array(["readout"] * r + ["adapter"] * (a - r) + ["conformal"] * (k - a) + ["test"] * horizon)
    return p, y - p, block


def ridge(x, y, alpha=1.0):
    mx, my = x.mean(0), y.mean()
    w = np.linalg.inv((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1])) @ (x - mx).T @ (y - my)
    return w, my - mx @ w


def robust(x, fit):
    q1, c, q3 = np.percentile(x[fit], [25, 50, 75], axis=0)
    s = (q3 - q1) / 1.35
    return (x - c) / np.where(s > 1e-8, s, 1.0)


def test_sketch_by_hand(spark):
    y = one_series()
    p, e, block = prior_and_blocks(y)
    n, rows = len(y), []
    for i in range(n - 1):
        lag = lambda k, i=i: e[i - k] if i >= k else 0.0
        f = [lag(1), lag(2), lag(3)] + [e[i] - e[i - k] if i >= k else 0.0 for k in (2, 4)]
        for k in (2, 3, 6):
            w = e[max(0, i - k + 1) : i + 1]
            h = len(w) // 2
            f += [w.mean(), w[-1] - w[0], w[h:].mean() - w[:h].mean() if h else 0.0, np.abs(w).mean()]
        f += [lag(12), e[i] - e[i - 12] if i >= 12 else 0.0, np.sin(2 * np.pi * i / 12), np.cos(2 * np.pi * i / 12)]
        rows.append(f)
    x, target, of = np.array(rows), e[1:], block[1:]  # a row's block is that of the month it forecasts
    fit = (of == "readout") & (np.arange(n - 1) >= 3)
    z = robust(x, fit)
    w, b = ridge(z[fit], target[fit])
    raw = z @ w + b
    a = of == "adapter"
    gamma = np.clip((raw[a] @ target[a]) / (raw[a] @ raw[a] + 1e-12), 0, 1.5)
    active = np.abs(target[a] - gamma * raw[a]).mean() < np.abs(target[a]).mean()
    obs = numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(n), y)], "series_id string, ds date, y double"))
    got = models.sketch(obs).orderBy("ds").toPandas()
    assert got.block.tolist() == of.tolist() and bool(got.active[0]) == bool(active)
    assert np.allclose(got.raw, raw) and np.allclose(got.gate, gamma) and np.allclose(got.pred, p[1:] + active * gamma * raw)
    assert np.allclose(got.y, y[1:])


def test_reservoir_by_hand(spark):
    y = one_series(seed=5)
    p, e, block = prior_and_blocks(y)
    n, of, target = len(y), block[1:], e[1:]
    fit = (of == "readout") & (np.arange(n - 1) >= 3)
    rng = np.random.default_rng(7)
    w_in, w_res = rng.uniform(-1, 1, (20, 2)), rng.normal(size=(20, 20))
    w_res *= 0.8 / np.abs(np.linalg.eigvals(w_res)).max()
    assert np.abs(np.linalg.eigvals(w_res)).max() < 1
    z, h, states = robust(e[:-1, None], fit)[:, 0], np.zeros(20), []
    for v in z:
        h = 0.5 * h + 0.5 * np.tanh(w_in[:, 0] + w_in[:, 1] * v + w_res @ h)
        states.append(h)
    lags = np.array([[e[i - k] if i >= k else 0.0 for k in (1, 2, 3)] for i in range(n - 1)])
    x = np.column_stack([states, lags])
    w, b = ridge(x[fit], target[fit])
    raw = x @ w + b
    vol = robust(pd.Series(e).ewm(span=4, adjust=False).std().fillna(0).to_numpy()[:-1, None], fit)[:, 0]
    a = of == "adapter"
    losses = {(s, c): np.abs(target - raw / (1 + np.exp(s * (vol - c))))[a].mean() for s in (0.25, 1.0, 4.0) for c in (-2.0, -1.0, 0.0, 1.0, 2.0)}
    s, c = min(losses, key=losses.get)
    obs = numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(n), y)], "series_id string, ds date, y double"))
    got = models.reservoir(obs).orderBy("ds").toPandas()
    assert np.allclose(got.raw, raw)
    gate = 1 / (1 + np.exp(s * (vol - c))) if got.active[0] else got.gate
    assert np.allclose(got.gate, gate, atol=1e-6) and bool(got.active[0]) == bool(losses[(s, c)] < np.abs(target)[a].mean())
    order = np.argsort(vol)
    assert (np.diff(got.gate.to_numpy()[order]) <= 1e-12).all()  # falls as volatility rises


def test_ablation_agrees_with_the_model(spark):
    obs = numbered(spark.createDataFrame([(s, d, float(v)) for s in "ab" for d, v in zip(months(96), one_series(seed=ord(s)))], "series_id string, ds date, y double"))
    s = models.sketch(obs).where("block = 'test'").toPandas()
    got = {(r.variant, r.series_id): r.mae for r in experiments.ablation(obs).collect()}
    for k, g in s.groupby("series_id"):
        for variant, pred in (("full", g.pred), ("prior_only", g.p), ("no_shrinkage", g.p + g.raw), ("no_selector", g.p + g.gate * g.raw)):
            assert np.isclose(got[(variant, k)], np.abs(g.y - pred).mean())


def test_ablation_refits(spark):
    """Each variant is a fit without its columns: without them in the table the full fit is the same."""
    obs = numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(96), one_series())], "series_id string, ds date, y double"))
    got = {r.variant: r.mae for r in experiments.ablation(obs).collect()}
    assert set(got) == {*experiments.SKETCHES, *experiments.RESERVOIRS, "no_shrinkage", "no_selector", "no_foundation", "prior_only", "reservoir_no_selector", "reservoir_prior_only"}
    rows = models.sketch(obs, variants=experiments.SKETCHES).orderBy("ds").toPandas()
    o, cols = models.featured(obs)
    f = o.orderBy("t").toPandas().iloc[:-1]
    assert {c: models.group(c) for c in cols if models.group(c) != "causal"} == {"lag1": "ar", "lag2": "ar", "lag3": "ar", "momentum2": "momentum", "momentum4": "momentum", "seasonal": "seasonal", "seasonal_gap": "seasonal", "season_sin": "calendar", "season_cos": "calendar"}
    for name, without in experiments.SKETCHES.items():
        g = rows[rows.variant == name]
        fit = (g.block == "readout").to_numpy() & (np.arange(len(g)) >= 3)
        z = robust(f[[c for c in cols if models.group(c) not in without]].to_numpy(float), fit)
        w, b = ridge(z[fit], f.target.to_numpy(float)[fit])
        assert np.allclose(g.raw, z @ w + b), name
    r = models.reservoir(obs, variants=experiments.RESERVOIRS).orderBy("ds").toPandas()
    lags = r[r.variant == "reservoir_no_reservoir"]
    fit = (lags.block == "readout").to_numpy() & (np.arange(len(lags)) >= 3)
    x = f[["lag1", "lag2", "lag3"]].to_numpy(float)
    w, b = ridge(x[fit], f.target.to_numpy(float)[fit])
    assert np.allclose(lags.raw, x @ w + b) and (r[r.variant == "reservoir_no_gate"].gate == 1).all()
    assert not np.allclose(r[r.variant == "reservoir_no_ar_lags"].raw, r[r.variant == "reservoir_full"].raw)


def test_long_series_are_fitted_whole(spark):
    """Of 700 rows all are fitted; cut to the last 199, they are fitted as a series of that length."""
    y = one_series(700)
    obs = numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(700), y)], "series_id string, ds date, y double"))
    tail = numbered(spark.createDataFrame([("s", d, float(v)) for d, v in list(zip(months(700), y))[-199:]], "series_id string, ds date, y double"))
    for model in (models.sketch, models.reservoir):
        whole = model(obs).toPandas()
        assert len(whole) == 699 and (whole.raw != 0).any() and whole.gate.max() > 0
        cut, own = (r.orderBy("ds").toPandas() for r in (model(obs, most=199), model(tail)))
        assert np.allclose(cut.pred, own.pred) and cut.block.tolist() == own.block.tolist()
    x = np.array([y[i - 12 : i] for i in range(12, 700)])
    w, b = ridge(x[:-12], y[12:-12])
    assert np.allclose([r.pred for r in models.window_regression(obs, "linear").orderBy("ds").collect()], x[-12:] @ w + b)


def test_evaluation_of_both(spark):
    m = QUERIES["evaluate_proposed"](spark, SMALL).toPandas()
    assert set(m.model) == {"reservoir", "sketch", "prior"} and (m.n_points == 12).all()
    assert m.ecp.between(0, 1).all() and (m.mase > 0).all() and loop_aci([1.0], [1.0])[0][2] == 0.1


def frame(spark, y):
    return numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(len(y)), y)], "series_id string, ds date, y double"))


def test_holt_winters_by_hand(spark):
    y = one_series(60)
    got = smoothing.holt_winters(frame(spark, y))
    for i in (0, 7, len(smoothing.SETTINGS) - 1):
        a, b, g, p = smoothing.SETTINGS[i]
        level, trend, season, want = y[0], 0.0, [0.0] * 12, []
        for t, v in enumerate(y):
            s = season[t % 12]
            want.append(level + p * trend + s)
            new = a * (v - s) + (1 - a) * (level + p * trend)
            trend = b * (new - level) + (1 - b) * p * trend
            season[t % 12] = g * (v - new) + (1 - g) * s
            level = new
        assert np.allclose([r.pred for r in got.where(f"weight = {i}").orderBy("t").collect()], want)


def test_window_regressions_by_hand(spark):
    y = one_series(80)
    x, z = np.array([y[i - 12 : i] for i in range(12, 80)]), y[12:]
    fit = np.arange(12, 80) < 68
    w, b = ridge(x[fit], z[fit])
    assert np.allclose([r.pred for r in models.window_regression(frame(spark, y), "linear").orderBy("ds").collect()], (x @ w + b)[~fit])
    d = x - x[:, -1:]
    w, b = ridge(d[fit], (z - x[:, -1])[fit])
    assert np.allclose([r.pred for r in models.window_regression(frame(spark, y), "nlinear").orderBy("ds").collect()], (d @ w + b + x[:, -1])[~fit])
    for kind in ("dlinear", "kernel"):
        rows = models.window_regression(frame(spark, y), kind).orderBy("ds").collect()
        assert len(rows) == 12 and np.abs(np.array([r.pred for r in rows]) - y[68:]).mean() < 1.5
    ar = models.autoregression(frame(spark, y), 2).orderBy("ds").collect()
    for k, r in enumerate(ar):
        h = y[: 68 + k]
        m = np.column_stack([np.ones(len(h) - 2), h[1:-1], h[:-2]])
        w = np.linalg.lstsq(m, h[2:], rcond=None)[0]
        assert np.isclose(r.pred, w @ [1, h[-1], h[-2]])
