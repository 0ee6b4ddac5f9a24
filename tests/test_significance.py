"""Tails against published values and enumeration; settings, failures and experiments of the fitted models against their plain use."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import months
from tidemark.operators import experiments, models, params, results, sampling, splits, tails
from tidemark.plans.substrate import numbered


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(5)
    rows = [(s, d, float(v)) for s, k in (("a", 70), ("b", 90), ("c", 64), ("d", 80)) for d, v in zip(months(k), 50 + 10 * np.sin(np.arange(k) / 2) + rng.normal(0, 3, k))]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tails(spark):
    """Two-sided t and upper chi-square points of printed tables."""
    for t, df, p in ((12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (3.169, 10, 0.01), (2.064, 24, 0.05), (1.962, 1000, 0.05), (1.96, 10**6, 0.05), (0.0, 7, 1.0)):
        assert abs(one(spark, tails.student(F.lit(t), F.lit(df))) - p) < 1e-4
    for x, df, p in ((3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05), (9.488, 4, 0.05), (11.070, 5, 0.05), (18.307, 10, 0.05), (24.996, 15, 0.05), (0.0, 3, 1.0)):
        assert abs(one(spark, tails.chi_square(F.lit(x), F.lit(df))) - p) < 1e-4


def test_signed_ranks_by_enumeration(spark):
    for n in (1, 4, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in itertools.product((0, 1), repeat=n)]
        for w in {0, n, n * (n + 1) // 4}:
            assert abs(one(spark, tails.signed_rank_exact(F.lit(float(w)), F.lit(n))) - min(1, 2 * sum(s <= w for s in sums) / len(sums))) < 1e-12


def errors(rows, by=()):
    g = rows.where("block = 'test'").groupBy("series_id", *by).agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("m")).collect()
    return {tuple(r[c] for c in ("series_id", *by)): r.m for r in g}


def test_experiments_hold_the_plain_models(obs):
    """The longest history, the usual prior and the default setting give what the models give by themselves."""
    plain = {"sketch": errors(models.sketch(obs)), "reservoir": errors(models.reservoir(obs))}
    for name in plain:
        e = {(r.series_id, r.history): r.mae for r in experiments.efficiency(obs.where("series_id = 'b'"), (90, 60)).where(F.col("model") == name).collect()}
        assert abs(e[("b", "90")] - plain[name][("b",)]) < 1e-9 and ("b", "60") in e
        p = {(r.series_id, r.prior): r.mae for r in experiments.adapted_priors(obs).where(F.col("model") == name).collect()}
        assert len(p) == 12 and all(abs(p[(s, "rolling_mean")] - plain[name][(s,)]) < 1e-9 for s in "abcd")
        t = {(r.trial, r.series_id): r.score for r in experiments.fitted_trials(obs, name, experiments.sampled(name, 3)).collect()}
        assert len(t) == 12 and all(abs(t[("trial0", s)] - plain[name][(s,)]) < 1e-9 for s in "abcd")
    moved = experiments.transferred(obs, "sketch", experiments.sampled("sketch", 3)).collect()
    roles = {r.series_id: r.role for r in sampling.roles(sampling.series_ids(obs)).collect()}
    assert {r.series_id for r in moved} == {s for s, r in roles.items() if r == "evaluation"} and len({r.trial for r in moved}) == 1


def test_ablations(obs):
    """Deltas are against the whole model a variant was taken from; without a foundation the prior is the mean so far."""
    e = experiments.ablation(obs).cache()
    mae = {(r.variant, r.series_id): r.mae for r in e.collect()}
    whole = lambda v: "reservoir_full" if v.startswith("reservoir") else "full"
    assert all(abs(r.delta - (mae[(r.variant, r.series_id)] - mae[(whole(r.variant), r.series_id)])) < 1e-12 for r in experiments.ablation_deltas(e).collect())
    t = {r.variant: r for r in experiments.ablation_tests(e).collect()}
    assert set(t) == {v for v, _ in mae} - {"full", "reservoir_full"} and {"no_foundation", "no_selector", "reservoir_no_gate"} <= set(t)
    for v, r in t.items():
        d = [mae[(v, s)] - mae[(whole(v), s)] for s in "abcd"]
        assert r.n_pairs == 4 and abs(r.mean_delta - np.mean(d)) < 1e-9 and abs(r.median - np.median([mae[(v, s)] for s in "abcd"])) < 1e-9
        assert r.p == 1.0 if not any(d) else 0 < r.p <= r.holm <= 1


def test_failures_are_rows(obs):
    """One setting that cannot be fitted fails, by series and with its error; the others are as they were."""
    rows = models.sketch(obs, variants={"full": (), "broken": {"alpha": "none"}})
    bad = rows.where("variant = 'broken'").collect()
    assert len(bad) == 4 and all(r.status == "failed" and r.pred is None and r.block == "test" and r.error for r in bad)
    assert errors(rows.where("variant = 'full'").drop("variant")) == errors(models.sketch(obs))
    f = experiments.fitted_trials(obs, "sketch", {"a": {}, "b": {"alpha": "none"}}).where("trial = 'b'").collect()
    assert {r.score for r in f} == {float("inf")}
    stored = results.failed_rows(rows, "set", "sketch")
    assert stored.columns == results.COLUMNS and stored.count() == 4


def test_selection_and_importance(obs):
    assert models.sketch(obs, least_gain=1e9).where("active").count() == models.reservoir(obs, least_r2=2.0).where("active").count() == 0
    assert models.sketch(obs, penalty=-1e9).where("block = 'test' and not active").count() == 0
    i = models.importance(obs).where("series_id = 'a'").toPandas()
    cols = models.featured(obs)[1]
    assert sorted(i.feature) == sorted(cols) and (i.parameters == len(cols) + 2).all() and (i["size"] == i.weight.abs()).all()


def test_parameters(spark):
    assert params.model_name("EasyTSF/NLinear") == "nlinear" and params.settings("sketch", alpha=2.0)["alpha"] == 2.0 and params.settings("nlinear", n=18)["width"] == 6
    for bad in (lambda: params.model_name("x"), lambda: params.settings("naive", alpha=1)):
        with pytest.raises(ValueError):
            bad()
    own, prior = params.split_namespaces({"alpha": 1, "prior__window": 3})
    assert (own, prior) == ({"alpha": 1}, {"window": 3})
    assert params.with_prior({"alpha": 1, "prior__window": 3}, "naive", m=4) == {"alpha": 1, "prior": "naive", "prior__m": 4}
    f = params.feasible(F.lit(20), window=F.lit(30), order=F.lit(9), ar_lags=F.lit(9), state_lags=F.lit(0), ratio=F.lit(0.9))
    assert tuple(spark.range(1).select(*[c.alias(k) for k, c in f.items()]).first()) == (18, 5, 6, 1, 0.85, False)


def test_groups_and_export(spark, obs, tmp_path):
    assert sampling.development_one(obs, least=85).first().series_id == "b" and sampling.development_one(obs, least=100).count() == 0
    assert sampling.development_group(obs, 2).count() == 2 and {r.series_id for r in sampling.development_group(obs, series=["a", "c"]).collect()} == {"a", "c"}
    for bad in ({"n": 4}, {"n": 0}, {"series": ["a", "a"]}, {"series": ["x"]}, {"series": ["c"], "least": 65}):
        with pytest.raises(ValueError):
            sampling.development_group(obs, **bad)
    rows = splits.tail(obs, 12).where("split = 'test'").select("series_id", F.col("y").alias("y_true"), (F.col("y") + 1).alias("y_pred"), F.col("y").alias("lower"), (F.col("y") + 2).alias("upper"), F.col("ds").alias("target_timestamp"), F.add_months("ds", -1).alias("information_cutoff"))
    tables = results.run_tables(results.store(rows, dataset="set", model="m", status="ok", mase_scale=1.0, rmsse_scale=1.0))
    results.export(str(tmp_path / "run"), tables, {"seed": 1})
    back = spark.read.parquet(str(tmp_path / "run" / "aggregate")).first()
    assert back.n_series == 4 and abs(back.mase_mean - 1) < 1e-9 and spark.read.text(str(tmp_path / "run" / "notes")).first().value == '{"seed":1}'
    assert spark.read.parquet(str(tmp_path / "run" / "audit")).count() == 0
    with pytest.raises(ValueError):
        results.export(str(tmp_path / "x"), tables, kind="xlsx")
