"""Runs that go on, searches in rounds, normality by order, provenance."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import months
from tidemark.operators import diagnostics, experiments, models, results, tails
from tidemark.operators.runs import Run
from tidemark.plans.substrate import numbered


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(21)
    rows = [(s, d, float(v)) for s in "ab" for d, v in zip(months(84), 50 + 10 * np.sin(np.arange(84) * np.pi / 6) + rng.normal(0, 3, 84).cumsum() * 0.3)]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def test_a_run_goes_on(spark, tmp_path):
    made, root = [], str(tmp_path / "run")

    def stages(stop=None):
        run = Run(spark, root)

        def make(name, before=None):
            def f():
                if name == stop:
                    raise KeyboardInterrupt
                made.append(name)
                return spark.range(3).withColumn("v", F.lit(name)) if before is None else before.withColumn("v", F.concat("v", F.lit(name)))

            return f

        a = run.table("a", {"x": 1}, make("a"))
        b = run.table("b", {"x": 1}, make("b", a))
        return run.table("c", {"x": 1}, make("c", b))

    for stop in ("a", "b", "c"):
        with pytest.raises(KeyboardInterrupt):
            stages(stop)
    assert {r.v for r in stages().collect()} == {"abc"} and made == ["a", "b", "c"]
    stages()
    assert made == ["a", "b", "c"]
    run = Run(spark, root)
    assert {(r.stage, r.settings) for r in run.manifest().collect()} == {(s, '{"x": 1}') for s in "abc"}
    assert run.made("a", {"x": 1}) and not run.made("a", {"x": 2})
    assert {r.v for r in run.table("a", {"x": 2}, lambda: spark.range(1).withColumn("v", F.lit("other"))).collect()} == {"other"}
    assert Run(spark, str(tmp_path / "none")).manifest().count() == 0


@pytest.mark.parametrize("kind", ["sketch", "autoregression"])
def test_search_in_rounds(obs, tmp_path, monkeypatch, kind):
    spark, calls, trials = obs.sparkSession, [], experiments.family_trials
    monkeypatch.setattr(experiments, "family_trials", lambda o, *a: calls.append(o.agg(F.max("n")).first()[0]) or trials(o, *a))
    search = lambda: experiments.searched(Run(spark, str(tmp_path / "run")), obs, kind, trials=6, histories=(60, None)).collect()
    got = search()
    assert calls == [60, 84]
    rounds = {k: {r.trial: r for r in got if r["round"] == k} for k in (0, 1)}
    assert len(rounds[0]) == 6 and len(rounds[1]) == 4 and all(r.n_series == 2 for r in got)
    best = sorted(rounds[0].values(), key=lambda r: (r.median, r.trial))[:2]
    assert {r.trial for r in best} < set(rounds[1]) and all(rounds[1][r.trial].settings == r.settings for r in best)
    for r in got:  # inside the space, in every dimension
        s = json.loads(r.settings)
        space = experiments.SPACES[kind] | ({"prior": experiments.PRIORS} if kind == "sketch" else {})
        assert set(s) == set(space)
        for name, given in space.items():
            assert s[name] in json.loads(json.dumps(given)) if isinstance(given, list) else given[0] <= s[name] <= given[1]
    assert search() == got and calls == [60, 84]  # no round is made twice
    if kind == "sketch":  # a trial's score is that of the model with its settings alone
        r = rounds[1][best[0].trial]
        s = json.loads(r.settings)
        alone = models.sketch(obs, alpha=s["alpha"], most_gamma=s["most_gamma"], ratio=s["ratio"], lags=s["lags"], spans=tuple(s["spans"]), scales=tuple(s["scales"]), variants={"v": tuple(s["without"])}, prior=experiments.forecasts.MODELS[s["prior"]]())
        errors = [x.m for x in alone.where("block = 'test'").groupBy("series_id").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("m")).collect()]
        assert np.isclose(np.median(errors), r.median)


def test_failed_trials_are_infinite(obs):
    got = experiments.fitted_trials(obs, "sketch", {"ok": {}, "bad": {"readout": "none"}}).collect()
    assert {(r.trial, np.isinf(r.score)) for r in got} == {("ok", False), ("bad", True)}


def test_normal_quantiles(spark):
    for p, z in ((0.5, 0.0), (0.975, 1.959963985), (0.025, -1.959963985), (0.999, 3.090232306), (0.01, -2.326347874), (1e-6, -4.753424309)):
        assert abs(spark.range(1).select(tails.normal_quantile(F.lit(p)).alias("z")).first().z - z) < 1e-7
    assert spark.range(1).select(tails.normal_quantile(F.lit(0.0)).alias("z")).first().z is None


def test_normality(spark):
    """The published example of eleven weights, and how often normal samples are rejected."""
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rng = np.random.default_rng(5)
    rows = [("men", float(x)) for x in weights] + [("flat", 3.0)] * 9 + [("two", 1.0), ("two", 2.0), ("three", 1.0), ("three", 2.0), ("three", 4.0), ("five", 1.0), ("five", 2.0), ("five", 3.5), ("five", 4.0), ("five", 9.0)]
    rows += [(f"z{i}", float(x)) for i in range(200) for x in rng.normal(size=40)] + [(f"e{i}", float(x)) for i in range(40) for x in rng.exponential(size=60)]
    got = {r.g: r for r in diagnostics.normality(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    assert abs(got["men"].w - 0.79) < 0.005 and abs(got["men"].w_p - 0.0067) < 0.0005
    assert got["flat"].w is None and got["two"].w is None and got["flat"].w_p is None
    assert np.isclose(got["three"].w, 4.5 / (np.var([1, 2, 4]) * 3)) and 0 < got["five"].w < 1
    rejected = np.mean([got[f"z{i}"].w_p < 0.05 for i in range(200)])
    assert 0.01 < rejected < 0.1 and np.mean([got[f"e{i}"].w_p < 0.05 for i in range(40)]) > 0.95


def test_provenance(obs):
    got = {r.series_id: r for r in results.provenance(obs).collect()}
    a = obs.where("series_id = 'a'").orderBy("ds").toPandas()
    want = hashlib.sha256(";".join(sorted(f"{d}|{y:.6f}" for d, y in zip(a.ds, a.y))).encode()).hexdigest()
    assert got["a"].data_hash == want and got["a"].n_train == 72 and got["a"].data_hash != got["b"].data_hash
    assert got["a"].n_readout + got["a"].n_adapter_calibration + got["a"].n_conformal_calibration == 72
    again = results.provenance(obs.orderBy(F.desc("ds"))).where("series_id = 'a'").first()
    assert again.data_hash == want
    short = numbered(obs.where("t < 20").select("series_id", "ds", "y"))
    assert results.provenance(short).first().n_readout is None and results.provenance(short).first().n_train == 8


def fits(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas")


def test_models_are_fitted_once(obs):
    """Priors, deltas and defaults are read from the rows of one fit, not fitted again."""
    from tests.conftest import SMALL
    from tidemark.queries import QUERIES

    spark = obs.sparkSession
    assert fits(experiments.efficiency(obs)) == 2 and fits(experiments.adapted_priors(obs)) == 2
    assert fits(experiments.ablation(obs)) == 3 and fits(experiments.ablation_deltas(experiments.ablation(obs))) == 3
    assert fits(QUERIES["evaluate_proposed"](spark, SMALL)) == 2
    # the best setting is known from all scores before it is applied: twice, and no more
    assert fits(experiments.transferred(obs, "sketch", experiments.sampled("sketch", 3))) == 2
