"""Queries over fitted models, experiments, resampling and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import experiments, metrics, models, smoothing, splits, statistics
from tidemark.plans.model_queries import _FC, _R, scored
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, brand_monthly, line_monthly, table
from tidemark.streaming import online

WITH = f"WITH {BRAND_SQL}"


@query()
def sketch_forecast(spark, d):
    return models.sketch(brand_monthly(spark, d), **models.PUBLISHED["sketch"]).where("block = 'test'").drop("block")


@query()
def reservoir_forecast(spark, d):
    return models.reservoir(brand_monthly(spark, d), **models.PUBLISHED["reservoir"]).where("block = 'test'").drop("block")


@query(f"{_FC}, m AS (SELECT series_id, ds, t, y, split, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM fc) SELECT series_id, ds, y, list_median(h) AS pred FROM m WHERE split = 'test'", "y pred")
def prior_callable(spark, d):
    """A user's function of the history: here its median."""
    import numpy as np

    return models.custom(brand_monthly(spark, d), np.median).select("series_id", "ds", "y", "pred")


_GRID = [{"window": w, "share": s} for w in (3, 6, 12) for s in (0.0, 0.25, 0.5)]


@query(f"""{WITH}, p AS (SELECT *, coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS s, {', '.join(f"coalesce(avg(y) OVER (w ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), y) AS w{w}" for w in (3, 6, 12))} FROM bm WHERE n > 12 WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
tr AS ({' UNION ALL '.join(f"SELECT series_id, {i} AS trial, {g['window']} AS window_, CAST({g['share']} AS DOUBLE) AS share, avg(abs(y - ((1 - CAST({g['share']} AS DOUBLE)) * w{g['window']} + CAST({g['share']} AS DOUBLE) * s))) AS score FROM p WHERE t >= n - 12 GROUP BY 1" for i, g in enumerate(_GRID))})
SELECT trial::INTEGER AS trial, window_::INTEGER AS "window", share, quantile_cont(score, 0.5) AS median FROM tr GROUP BY 1, 2, 3""", "share median")
def hpo_holdout(spark, d):
    return experiments.best_trial(experiments.tried(brand_monthly(spark, d), _GRID))


@query()
def frozen_transfer(spark, d):
    return experiments.frozen(line_monthly(spark, d), spark, _GRID)


@query()
def ablation_variants(spark, d):
    return experiments.ablation(brand_monthly(spark, d), **models.PUBLISHED)


@query(f"""{_FC}, c AS (SELECT *, pred + coalesce(avg(y - pred) OVER (PARTITION BY series_id, model ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS corrected FROM fm)
SELECT model, series_id, avg(abs(y - pred)) AS prior_only, avg(abs(y - corrected)) AS corrected FROM c WHERE split = 'test' GROUP BY 1, 2""", "prior_only corrected")
def prior_robustness(spark, d):
    return experiments.robustness(brand_monthly(spark, d))


@query(f"""{WITH}, l AS (SELECT *, avg(y) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS rolling_mean, coalesce(lag(y, 11) OVER w, y) AS seasonal_naive FROM bm WINDOW w AS (PARTITION BY series_id ORDER BY ds))
SELECT series_id, last_day(ds + INTERVAL 1 MONTH) AS ds, rolling_mean, seasonal_naive, y AS naive FROM l WHERE t = n - 1""", "rolling_mean seasonal_naive naive")
def next_month(spark, d):
    return experiments.next_month(brand_monthly(spark, d))


@query()
def bootstrap_ci(spark, d):
    return statistics.bootstrap_mean(scored(spark, d), ["model"], "mae", "series_id", draws=1000)


@query("SELECT CAST(user_id % 10 AS VARCHAR) AS series_id, ts::DATE AS ds, sum(value) AS y, count(*) AS n_rows FROM events GROUP BY 1, 2", "y")
def stream_daily(spark, d):
    """The streaming aggregation, over the same rows at rest."""
    return online.daily(table(spark, d, "events").withColumn("k", F.col("user_id") % 10), "k", "ts", "value")


@query(f"{_R} SELECT a.series_id, a.model, a.mae FROM ra a WHERE rank <= 2", "mae")
def best_two(spark, d):
    return statistics.ranked(scored(spark, d), "mae").where("rank <= 2").select("series_id", "model", "mae")


@query(f"{WITH}, x AS (SELECT DISTINCT series_id FROM bm WHERE t < n - 12 INTERSECT SELECT DISTINCT series_id FROM bm WHERE t >= n - 12) SELECT series_id FROM x")
def common_ids(spark, d):
    """Series with both training and test rows."""
    s = splits.tail(brand_monthly(spark, d), 12)
    return s.where("split = 'train'").select("series_id").intersect(s.where("split = 'test'").select("series_id"))


@query()
def prior_holt_winters(spark, d):
    """Additive level, damped trend and season; the best of a grid on training rows."""
    o = splits.tail(brand_monthly(spark, d), 12)
    return smoothing.best_weight(smoothing.holt_winters(o)).select("series_id", "ds", "split", "weight", "pred")


@query()
def window_models(spark, d):
    """Linear, last-value, trend-and-rest and kernel regressions on windows: errors of each series."""
    m = models.window_regression(brand_monthly(spark, d), models.KINDS).withColumnRenamed("variant", "model")
    return m.groupBy("series_id", "model").agg(F.count("*").alias("n_points"), metrics.point()["mae"].alias("mae"))


@query()
def autoregression(spark, d):
    return models.autoregression(brand_monthly(spark, d), 3)
