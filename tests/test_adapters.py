"""Fitted models at rest, ahead and in a stream against the batch models and plain loops."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_series import months
from tests.test_streaming import rocks  # noqa: F401
from tidemark.operators import adapters, conformal, models, readouts
from tidemark.operators.adapters import NAMES, Adapter
from tidemark.plans.substrate import numbered
from tidemark.streaming import adapted

SETTINGS = {
    "sketch": [{}, {"spans": (2, 4, 8, 12), "scales": (2, 3, 4, 6), "means": (2, 4, 8, 12)}, {"readout": "lasso", "alpha": 0.05}],
    "reservoir": [{}, {"size": 50, "search": "closing"}, {"readout": "bayes"}],
}


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s, k in (("a", 96), ("b", 72), ("short", 20)):
        e = np.zeros(k)
        for i in range(1, k):
            e[i] = 0.7 * e[i - 1] + rng.normal(0, 3)
        rows += [(s, d, float(v)) for d, v in zip(months(k), 50 + 10 * np.sin(np.arange(k) * np.pi / 6) + e)]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def train(obs):
    return numbered(obs.where(F.col("t") < F.col("n") - 12).select("series_id", "ds", "y"))


def batch(obs, kind, **settings):
    rows = getattr(models, kind)(obs, **settings).where("block in ('conformal', 'test')").join(obs.select("series_id", "ds", "t"), ["series_id", "ds"])
    return conformal.adaptive(rows.select("series_id", "ds", "t", "y", "p", "raw", "gate", "pred", "block", "active"), ["series_id"]).where("block = 'test'").orderBy("series_id", "ds").toPandas()


@pytest.mark.parametrize("kind, k", [(kind, k) for kind in SETTINGS for k in range(3)])
def test_states_go_on_as_the_batch_model(obs, kind, k):
    settings = SETTINGS[kind][k]
    want = batch(obs, kind, **settings)
    got = []
    held = {s: g for s, g in obs.where(F.col("t") >= F.col("n") - 12).orderBy("ds").toPandas().groupby("series_id")}
    for r in adapters.states(train(obs), kind, **settings).collect():
        a = Adapter({k: r[k] for k in NAMES})
        a = Adapter(dict(zip(NAMES, a.row())))  # as it comes back from a store
        for ds, y in zip(held[r.series_id].ds, held[r.series_id].y):
            f = a.predict()
            got.append((r.series_id, ds, f["p"], f["raw"], f["gate"], f["pred"], f["pred"] - f["half"], f["pred"] + f["half"], a.alpha))
            a.see(y)
    got = pd.DataFrame(got, columns=["series_id", "ds", "p", "raw", "gate", "pred", "lower", "upper", "alpha"]).sort_values(["series_id", "ds"]).reset_index(drop=True)
    own = got[got.series_id != "short"].reset_index(drop=True)
    want = want[want.series_id != "short"].reset_index(drop=True)
    assert len(own) == len(want) == 24 and own.ds.tolist() == want.ds.tolist() and (want.raw != 0).any()
    for c in ("p", "raw", "gate", "pred", "lower", "upper", "alpha"):
        assert np.allclose(own[c], want[c], atol=1e-9), c


@pytest.mark.parametrize("kind", ["sketch", "reservoir"])
def test_ahead_by_hand(obs, kind):
    """Each step is the first forecast of the model that has seen the steps before as values, without moving the interval."""
    rows = {r.series_id: r for r in adapters.states(obs, kind).collect()}
    got = adapters.ahead(obs.sparkSession.createDataFrame(list(rows.values()), adapters.STATES), 12).orderBy("series_id", "step").toPandas()
    y = {s: g.sort_values("t").y.tolist() for s, g in obs.toPandas().groupby("series_id")}
    for s, r in rows.items():
        own, history, widths = got[got.series_id == s], list(y[s]), set()
        a = Adapter({k: r[k] for k in NAMES})
        scores, alpha = list(a.scores), a.alpha
        for step, f in enumerate(own.itertuples(), 1):
            assert f.step == step and np.isclose(f.p, np.mean(history[-6:]))
            mine = a.predict()
            assert np.isclose(f.pred, mine["pred"]) and np.isclose(f.pred, f.p + (mine["gate"] * mine["raw"] if a.active else 0))
            history.append(f.pred)
            a.move(f.pred, f.pred - f.p)
            a.last = None
            widths.add(round(f.upper - f.lower, 9))
        assert len(widths) == 1 and scores == a.scores and alpha == a.alpha
        assert own.ds.iloc[0] > obs.where(F.col("series_id") == s).agg(F.max("ds")).first()[0] and len(set(own.ds)) == 12 and all((d + dt.timedelta(1)).day == 1 for d in own.ds)


def test_priors_ahead_by_loops(obs):
    got = {(r.series_id, r.model, r.step): r.pred for r in adapters.priors_ahead(obs, 15).collect()}
    for s, g in obs.toPandas().groupby("series_id"):
        y = g.sort_values("t").y.tolist()
        for name in ("naive", "rolling_mean", "seasonal_naive"):
            h = list(y)
            for step in range(1, 16):
                v = {"naive": h[-1], "rolling_mean": np.mean(h[-6:]), "seasonal_naive": h[-12]}[name]
                assert np.isclose(got[(s, name, step)], v)
                h.append(v)
    one = numbered(obs.sparkSession.createDataFrame([("x", dt.date(2020, 1, 31), 4.0), ("x", dt.date(2020, 2, 29), 6.0)], "series_id string, ds date, y double"))
    assert {(r.model, round(r.pred, 9)) for r in adapters.priors_ahead(one, 3).collect()} == {("naive", 6.0), ("seasonal_naive", 6.0), ("rolling_mean", 5.0)}
    with pytest.raises(ValueError):
        adapters.priors_ahead(one, names=("none",))


def test_direct_by_hand(obs):
    got = adapters.direct(obs, ("linear", "nlinear", "dlinear", "kernel"), 6).toPandas()
    y = obs.where("series_id = 'a'").orderBy("t").toPandas().y.to_numpy()
    x = np.array([y[i - 12 : i] for i in range(12, len(y) - 5)])
    t = np.array([y[i : i + 6] for i in range(12, len(y) - 5)])
    for variant, base in (("linear", 0), ("nlinear", 1)):
        b, last = (x[:, -1:], y[-1]) if base else (0, 0)
        z, u = x - b, t - b
        c = z - z.mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(12), c.T @ (u - u.mean(0)))
        want = (y[-12:] - last - z.mean(0)) @ w + u.mean(0) + last
        own = got[(got.series_id == "a") & (got.variant == variant)].sort_values("step")
        assert np.allclose(own.pred, want) and (own.status == "ok").all()
    short = got[got.series_id == "short"]
    assert len(got) == 3 * 4 * 6 and np.isfinite(short.pred).all()
    with pytest.raises(ValueError):
        adapters.direct(obs, "lstm")


def test_failed_fits_keep_their_prior(obs):
    rows = adapters.states(obs, "sketch", readout="none").collect()
    assert {r.status for r in rows if r.series_id != "short"} == {"failed"} and all("unknown readout" in r.error for r in rows if r.status == "failed")
    ahead = adapters.ahead(obs.sparkSession.createDataFrame(rows, adapters.STATES), 2).toPandas()
    assert (ahead.p == ahead.pred).all() and np.isfinite(ahead.pred).all()
    with pytest.raises(ValueError):
        adapters.states(obs, "lstm")


@pytest.mark.parametrize("kind", ["sketch", "reservoir"])
def test_stream_is_the_batch_model(rocks, obs, tmp_path, kind):  # noqa: F811
    """From fitted states, over several micro-batches and a restart; late rows and unknown series change nothing else."""
    spark, settings = rocks, SETTINGS[kind][1]
    adapters.states(train(obs), kind, **settings).write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    held = obs.where(F.col("t") >= F.col("n") - 12).orderBy("ds").toPandas()
    schema = "series_id string, ds date, y double"

    def put(part):
        rows = [(r.series_id, r.ds, r.y) for k, r in enumerate(held.itertuples()) if k % len(held) // (len(held) // 3) == part]
        rows += [("a", held.ds.min(), 99.0), ("new", months(40)[part], float(part))] if part else []
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = adapted.forecasts(stream, states).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()

    put(0)
    run()
    put(1)
    put(2)
    run()  # begun again from its checkpoint
    got = spark.read.parquet(str(tmp_path / "out")).toPandas()
    assert (got.status == "late").sum() == 2 and (got[got.series_id == "new"].status == "prior").all()
    want = batch(obs, kind, **settings)
    for s in ("a", "b"):
        own, w = got[(got.series_id == s) & (got.status == "ok")].sort_values("ds"), want[want.series_id == s]
        assert len(own) == 12
        for c in ("p", "raw", "gate", "pred", "lower", "upper", "alpha"):
            assert np.allclose(own[c].astype(float), w[c], atol=1e-9), c


def test_readouts():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 7))
    x[:, 3] = x[:, 2] + 0.01 * rng.normal(size=80)
    y = 3 + x @ np.array([2.0, -1.0, 0.5, 0, 0, 0, 0.02]) + 0.3 * rng.normal(size=80)
    z, t, n = x - x.mean(0), y - y.mean(), len(y)
    for kind, absolute, square in (("lasso", 0.1, 0.0), ("elastic", 0.05, 0.05)):
        w, b = readouts.fitted(kind, x, y, 0.1)
        slope = z.T @ (t - z @ w) / n - square * w
        assert np.allclose(slope[w != 0], absolute * np.sign(w[w != 0]), atol=1e-8) and (np.abs(slope[w == 0]) <= absolute + 1e-8).all()
        assert (w == 0).any() and np.isclose(b, y.mean() - x.mean(0) @ w)
    w, _ = readouts.fitted("bayes", x, y)
    values = np.linalg.eigvalsh(z.T @ z)
    rest = ((t - z @ w) ** 2).sum()
    # a fixed point: the weights are ridge's for the ratio of precisions, which are those that the weights ask for
    def moved(ratio):
        v = np.linalg.solve(z.T @ z + ratio * np.eye(7), z.T @ t)
        known = (values / (values + ratio)).sum()
        return (known + 2e-6) / (v @ v + 2e-6) / ((n - known + 2e-6) / (((t - z @ v) ** 2).sum() + 2e-6)), v

    ratio = 1.0
    for _ in range(500):
        ratio, v = moved(ratio)
    assert np.allclose(v, w, atol=1e-6) and rest > 0
    assert np.allclose(readouts.fitted("ridge", x, y, 2.0)[0], np.linalg.solve(z.T @ z + 2 * np.eye(7), z.T @ t))
    with pytest.raises(ValueError):
        readouts.fitted("none", x, y)


def test_closing_grid():
    """Never above the plain grid, and as low as a dense search."""
    rng = np.random.default_rng(6)
    for _ in range(8):
        z, raw = rng.normal(size=16), rng.normal(size=16)
        target = raw / (1 + np.exp(2.5 * (z - 0.3))) + 0.2 * rng.normal(size=16)
        loss = lambda a, b: np.abs(target - raw / (1 + np.exp(np.clip(a * (z - b), -50, 50)))).mean()  # noqa: E731, B023
        a, b = readouts.steepness(target, raw, z, models.GATES)
        assert loss(a, b) <= min(loss(*g) for g in models.GATES)
        dense = min(loss(p, q) for p in np.geomspace(0.01, 20, 200) for q in np.linspace(-5, 5, 200))
        assert loss(a, b) <= dense + 1e-6


def test_settings_are_plain_text(obs):
    r = adapters.states(obs.where("series_id = 'a'"), "sketch", without=("calendar",)).first()
    assert "season_sin" not in json.loads(r.settings)["used"] and len(r.weights) == len(json.loads(r.settings)["used"])
