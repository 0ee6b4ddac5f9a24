"""Models by name: their defaults, shorter ones for short series, aliases."""

import numpy as np
import pytest

from tests.test_series import months
from tidemark.operators import least_squares, models, params, suite
from tidemark.plans.substrate import numbered


def test_suite(spark):
    rng = np.random.default_rng(2)
    rows = [(s, d, float(v)) for s, k in (("long", 80), ("short", 30)) for d, v in zip(months(k), 40 + rng.normal(0, 3, k).cumsum())]
    obs = numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()
    names = ["Naive", "rolling-mean", "seasonal naive", "autoregression", "easytsf/nlinear", "kernel", "sketch"]
    got = suite.forecast(obs, names, given={"rolling_mean": {"window": 5}}).toPandas()
    assert set(got.model) == {"naive", "rolling_mean", "seasonal_naive", "autoregression", "nlinear", "kernel", "sketch"}
    assert not got.duplicated(["model", "series_id", "ds"]).any()
    assert (got.groupby(["model", "series_id"]).size() == 12).all() and len(got) == 7 * 2 * 12
    pick = lambda m, s: got[(got.model == m) & (got.series_id == s)].sort_values("ds").pred.to_numpy()
    y = {s: obs.where(obs.series_id == s).orderBy("t").toPandas().y.to_numpy() for s in ("long", "short")}
    assert np.allclose(pick("naive", "short"), y["short"][-13:-1])
    assert np.allclose(pick("rolling_mean", "long"), [y["long"][i - 5 : i].mean() for i in range(68, 80)])
    # eighteen rows to learn from ask for a window of 3, but another was given
    assert np.allclose(pick("rolling_mean", "short"), [y["short"][i - 5 : i].mean() for i in range(18, 30)])
    usual = suite.forecast(obs, ["rolling_mean"]).where("series_id = 'short'").orderBy("ds").toPandas().pred
    assert np.allclose(usual, [y["short"][i - params.SHORT[24]["window"] : i].mean() for i in range(18, 30)])
    by = lambda rows: rows.orderBy("series_id", "ds").toPandas()
    for s, lags, width in (("long", 3, 12), ("short", 2, 6)):
        one = obs.where(obs.series_id == s)
        assert np.allclose(pick("autoregression", s), by(least_squares.autoregression(one, lags, refit=True)).pred)
        assert np.allclose(pick("nlinear", s), by(models.window_regression(one, "nlinear", width)).pred)
        assert np.allclose(pick("kernel", s), by(models.window_regression(one, "kernel", width)).pred)
    assert np.allclose(pick("sketch", "long"), by(models.sketch(obs.where("series_id = 'long'")).where("block = 'test'")).pred)
    with pytest.raises(ValueError):
        suite.forecast(obs, ["lstm"])


def test_strict_logs(spark):
    from pyspark.errors import PySparkException

    from tidemark.operators import splits, transforms

    rows = [("s", d, v) for d, v in zip(months(14), [5.0] * 13 + [-9.0])]
    obs = splits.tail(numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")), 1)
    assert transforms.positive_log(obs).where("z is null").count() == 1
    with pytest.raises(PySparkException):
        transforms.positive_log(obs, strict=True).collect()
