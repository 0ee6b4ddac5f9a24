"""Queries over diagnostics in one frame, residual tests, shock reports, failures, feasibility and experiments over the fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import diagnostics, experiments, metrics, models, params, shocks, splits
from tidemark.plans import diagnostic_queries  # noqa: F401  (its SQL is used below)
from tidemark.plans.model_queries import _FC, _INNO, compared
from tidemark.plans.registry import ORACLE_SQL, query
from tidemark.plans.substrate import BRAND_SQL, brand_monthly, numbered, table
from tidemark.sources import series as S

WITH = f"WITH {BRAND_SQL}"
_BREAKS = f"""(WITH RECURSIVE {BRAND_SQL}, m AS (SELECT *, stddev_samp(y) OVER (PARTITION BY series_id) AS sd, avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS a, avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS b FROM bm),
c AS (SELECT series_id, list_sort(list(t)) AS ts FROM m WHERE t >= 8 AND t <= n - 8 AND abs(b - a) / nullif(sd, 0) * sqrt(8) >= 3 GROUP BY 1),
r AS (SELECT series_id, ts, 1 AS i, -1000000::BIGINT AS last, 0 AS k FROM c UNION ALL SELECT series_id, ts, i + 1, CASE WHEN ts[i] - last >= 8 THEN ts[i] ELSE last END, k + (ts[i] - last >= 8)::INTEGER FROM r WHERE i <= len(ts))
SELECT series_id, max(k)::INTEGER AS breaks FROM r GROUP BY 1)"""


@query(_BREAKS[1:-1])
def break_counts(spark, d):
    """Breaks against the standard error of their means, taken in order; series without any have no row."""
    return diagnostics.break_count(diagnostics.adjacent_breaks(brand_monthly(spark, d)))


def _of(name: str) -> str:
    return f"({ORACLE_SQL[name]})"


@query(f"""SELECT p.series_id, p.n AS observations, cv, missing, zeros, rho1 AS acf1, rho12 AS acf_season, q AS ljung_box, p AS ljung_box_p, trend_strength, seasonal_strength, entropy, coalesce(breaks, 0) AS breaks, t AS unit_root_t, t >= CAST(-2.86 AS DOUBLE) AS unit_root, statistic AS level,
CASE WHEN statistic IS NULL THEN NULL WHEN statistic >= 0.739 THEN 0.01 WHEN statistic >= 0.574 THEN 0.025 - (statistic - 0.574) / (0.739 - 0.574) * 0.015 WHEN statistic >= 0.463 THEN 0.05 - (statistic - 0.463) / (0.574 - 0.463) * 0.025 WHEN statistic >= 0.347 THEN 0.1 - (statistic - 0.347) / (0.463 - 0.347) * 0.05 ELSE 0.1 END::DOUBLE AS level_p
FROM {_of('series_profile')} p LEFT JOIN {_of('acf')} a USING (series_id) LEFT JOIN {_of('ljung_box_p')} l USING (series_id) LEFT JOIN {_of('decomposition_strength')} s USING (series_id) LEFT JOIN {_of('spectral_entropy')} e USING (series_id) LEFT JOIN {_BREAKS} b USING (series_id) LEFT JOIN {_of('dickey_fuller')} f USING (series_id) LEFT JOIN {_of('level_stationarity')} k USING (series_id)""", "level_p")
def diagnostics_frame(spark, d):
    """Rounded part by part, as the SQL joins rounded parts."""
    f = diagnostics.frame(brand_monthly(spark, d))
    return f.withColumn("level_p", diagnostics.stationarity_p(F.round("level", 6)))


_MOMENT = """g AS (SELECT model, n, g1, g2, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta,
(g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS b1 FROM mo),
h AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 6 + 8 / b1 * (2 / b1 + sqrt(1 + 4 / (b1 * b1))) AS c FROM g), i AS (SELECT *, y / sqrt(2 / (w2 - 1)) AS a, 1 + x * sqrt(2 / (c - 4)) AS dd FROM h),
z AS (SELECT *, ln(a + sqrt(a * a + 1)) / sqrt(ln(w2) / 2) AS z1, (1 - 2 / (9 * c) - sign(dd) * pow((1 - 2 / c) / abs(dd), CAST(1 AS DOUBLE) / 3)) / sqrt(2 / (9 * c)) AS z2 FROM i)"""


@query(f"""{_FC}, r AS (SELECT model, ds, avg(y - pred) AS e FROM fm GROUP BY 1, 2), m AS (SELECT *, e - avg(e) OVER (PARTITION BY model) AS x FROM r), l AS (SELECT *, {', '.join(f'lag(x, {k}) OVER w AS l{k}' for k in range(1, 13))} FROM m WINDOW w AS (PARTITION BY model ORDER BY ds)),
ac AS (SELECT model, count(*) AS n, {', '.join(f'sum(x * l{k}) / nullif(sum(x * x), 0) AS rho{k}' for k in range(1, 13))} FROM l GROUP BY 1), lb AS (SELECT *, n * (n + 2) * ({' + '.join(f'rho{k} * rho{k} / (n - {k})' for k in range(1, 13))}) AS q FROM ac),
mo AS (SELECT model, count(*)::DOUBLE AS n, avg(pow(x, 3)) / pow(avg(x * x), CAST(1.5 AS DOUBLE)) AS g1, avg(pow(x, 4)) / pow(avg(x * x), 2) - 3 AS g2 FROM m GROUP BY 1), {_MOMENT}
SELECT model, z.n::BIGINT AS n, CASE WHEN z.n >= 20 THEN z1 * z1 + z2 * z2 END AS k2, CASE WHEN z.n >= 20 THEN exp(-(z1 * z1 + z2 * z2) / 2) END AS k2_p, z.n / 6 * (g1 * g1 + g2 * g2 / 4) AS jarque_bera, exp(-z.n / 6 * (g1 * g1 + g2 * g2 / 4) / 2) AS jarque_bera_p,
rho1 AS acf1, rho12 AS acf_season, q AS ljung_box, exp(-q / 2) * (1 + q / 2 * (1 + q / 4 * (1 + q / 6 * (1 + q / 8 * (1 + q / 10))))) AS ljung_box_p, abs(rho12) > CAST(0.2 AS DOUBLE) AS seasonal_left FROM z JOIN lb USING (model)""", "k2 k2_p jarque_bera jarque_bera_p acf1 acf_season ljung_box ljung_box_p")
def residual_tests(spark, d):
    """Of each model's mean residual by month."""
    r = compared(spark, d).groupBy("model", "ds").agg(F.avg(F.col("y") - F.col("pred")).alias("e"))
    return diagnostics.residual_tests(r, ["model"], "e", "ds")


_HEX = "(('0x' || substr(md5('42:' || series_id || ':' || t), {at}, 8))::BIGINT + 1) / CAST(4294967297 AS DOUBLE)"


@query(f"{WITH}, s AS (SELECT *, greatest(1, n // 2) AS p, 3 * stddev_pop(y) OVER (PARTITION BY series_id) AS u FROM bm) SELECT series_id, ds, t, y, CASE WHEN t >= p THEN y + u * sqrt(-2 * ln({_HEX.format(at=1)})) * cos(CAST(6.283185307179586 AS DOUBLE) * {_HEX.format(at=9)}) ELSE y END AS variance FROM s", "y variance")
def variance_shock(spark, d):
    return shocks.variance_shift(brand_monthly(spark, d))


@query(f"""{_INNO}, lb AS (SELECT series_id, ds, inno > limit_q90 AS shock FROM io JOIN th USING (series_id) WHERE split = 'test'), dd AS (SELECT series_id, y, y - lag(y, 12) OVER w AS s, y - lag(y) OVER w AS d FROM fc WHERE split = 'train' WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
b0 AS (SELECT series_id, CASE WHEN count(y) > 12 THEN avg(abs(s)) WHEN count(y) > 1 THEN avg(abs(d)) ELSE 1 END AS base, stddev_pop(y) AS sd FROM dd GROUP BY 1), sca AS (SELECT series_id, CASE WHEN base > 1e-8 THEN base WHEN sd > 1e-8 THEN sd ELSE 1 END AS scale FROM b0),
j AS (SELECT series_id, model, y, pred, shock, unnest(['overall', 'shock', 'non_shock']) AS subset FROM fm JOIN lb USING (series_id, ds)), k AS (SELECT *, subset = 'overall' OR shock = (subset = 'shock') AS own FROM j)
SELECT series_id, model, subset, count(*) FILTER (own) AS n_points, count(*) FILTER (own) / count(*) AS fraction, CASE WHEN count(*) FILTER (own) = 0 THEN 'empty' ELSE 'ok' END AS status, avg(abs(y - pred)) FILTER (own) AS mae, sqrt(avg((y - pred) * (y - pred)) FILTER (own)) AS rmse, avg(abs(y - pred) / greatest(abs(y), CAST(1e-5 AS DOUBLE))) FILTER (own) AS mape, avg(abs(y - pred)) FILTER (own) / first(scale) AS mase FROM k JOIN sca USING (series_id) GROUP BY 1, 2, 3""", "fraction mae rmse mape mase")
def shock_report(spark, d):
    o = splits.tail(brand_monthly(spark, d), 12)
    labels = shocks.labelled(o).select("series_id", "ds", "shock")
    return shocks.report(compared(spark, d).join(labels, ["series_id", "ds"]).join(metrics.scales(o), "series_id"))


_CUSTOMERS = """WITH c0 AS (SELECT o_custkey::VARCHAR AS series_id, last_day(o_orderdate) AS ds, count(*)::DOUBLE AS y FROM orders GROUP BY 1, 2),
cm AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM c0),
fo AS (SELECT *, avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pred FROM cm WHERE n > 2)"""


def _customers(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("series_id"), F.last_day("o_orderdate").alias("ds"))
    return numbered(o.agg(F.count("*").cast("double").alias("y")))


def _needs_eight(y):
    if len(y) < 8:
        raise ValueError(f"{len(y)} values are too few")
    return y.mean()


@query(f"""{_CUSTOMERS} SELECT series_id, ds, y, pred, 'ok' AS status, NULL::VARCHAR AS error FROM fo WHERE n - 2 >= 8 AND t >= n - 2
UNION ALL SELECT series_id, ds, NULL, NULL, 'failed', 'ValueError: ' || (n - 2) || ' values are too few' FROM fo WHERE n - 2 < 8 AND t = n - 2""", "y pred")
def captured_failures(spark, d):
    """A model that raises on short series: those are rows with an error, and the others are forecast."""
    return models.custom(_customers(spark, d), _needs_eight, 2)


@query(f"""{_CUSTOMERS}, s AS (SELECT series_id, n - 2 >= 8 AS ok FROM fo WHERE t = n - 2) SELECT count(*) AS attempted, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) / count(*) AS success_rate FROM s""", "success_rate")
def model_coverage(spark, d):
    s = models.custom(_customers(spark, d), _needs_eight, 2).groupBy("series_id").agg(F.min((F.col("status") == "ok").cast("int")).alias("ok"))
    return s.agg(F.count("*").alias("attempted"), F.sum("ok").cast("long").alias("successful"), F.sum(1 - F.col("ok")).cast("long").alias("failed"), F.avg("ok").alias("success_rate"))


@query(f"""{_CUSTOMERS.replace('fo AS', 'fo0 AS')}, h AS (SELECT *, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM cm WHERE n > 2)
SELECT series_id, ds, y, CASE WHEN len(h) < 3 OR len(h) < 8 THEN h[-1] ELSE list_avg(h) END AS pred FROM h WHERE t >= n - 2""", "y pred")
def walked_prior(spark, d):
    """The same model with a fall-back instead of failures."""
    return models.custom(_customers(spark, d), models.walked(_needs_eight), 2).select("series_id", "ds", "y", "pred")


@query("""WITH c AS (SELECT p_partkey, p_size::INTEGER AS n, (p_partkey % 24 + 1)::INTEGER AS lags, p_retailprice / 2000 AS ratio FROM part), l AS (SELECT *, greatest(1, least(lags, n - 16))::INTEGER AS own FROM c)
SELECT p_partkey, n >= 17 AS ok, own AS lags, greatest((8 + own) / n, least((n - 7) / n, ratio)) AS ratio FROM l""", "ratio")
def direct_feasibility(spark, d):
    n = F.col("p_size").cast("int")
    f = params.direct_feasible(n, 6, F.col("p_partkey") % 24 + 1, F.col("p_retailprice") / 2000)
    return table(spark, d, "part").select("p_partkey", *[c.alias(k) for k, c in f.items()])


@query("""WITH d0 AS (SELECT user_id::VARCHAR AS series_id, last_day(ts)::DATE AS ds, sum(value) AS y FROM events GROUP BY 1, 2), e AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM d0 GROUP BY 1),
m AS (SELECT series_id, last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))::DATE) AS ds FROM e)
SELECT series_id, count(*) AS n, count(*) - count(y) AS imputed FROM m LEFT JOIN d0 USING (series_id, ds) GROUP BY 1""")
def imputed_counts(spark, d):
    """Months of each user that are filled in by interpolation."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("series_id"), F.last_day("ts").alias("ds"), "value")
    return S.imputed(S.calendar_fill(numbered(e.groupBy("series_id", "ds").agg(F.sum("value").alias("y"))), None, flag=True))


@query()
def ablation_deltas(spark, d):
    """Errors of every variant less those of its whole model."""
    return experiments.ablation_deltas(experiments.ablation(brand_monthly(spark, d), **models.PUBLISHED))


@query()
def ablation_tests(spark, d):
    """Every variant against its whole model, with signed-rank tests."""
    return experiments.ablation_tests(experiments.ablation(brand_monthly(spark, d), **models.PUBLISHED).persist())


@query()
def fitted_efficiency(spark, d):
    """Both fitted models and their prior by length of history."""
    return experiments.efficiency(brand_monthly(spark, d), sketch=models.PUBLISHED["sketch"], reservoir=models.PUBLISHED["reservoir"])


@query()
def fitted_priors(spark, d):
    """Both fitted models on each of three priors."""
    return experiments.adapted_priors(brand_monthly(spark, d), sketch=models.PUBLISHED["sketch"], reservoir=models.PUBLISHED["reservoir"])


@query()
def fitted_trials(spark, d):
    """Ten settings of the sketch model: median score over series."""
    return experiments.best_setting(experiments.fitted_trials(brand_monthly(spark, d), "sketch", experiments.sampled("sketch", 10)))


@query()
def fitted_transfer(spark, d):
    """The setting that is best on development series, on the others."""
    return experiments.transferred(brand_monthly(spark, d), "sketch", experiments.sampled("sketch", 10))


@query()
def feature_importance(spark, d):
    return models.importance(brand_monthly(spark, d), **models.PUBLISHED["sketch"])


@query()
def group_importance(spark, d):
    """Mean share of each feature group in the size of the weights."""
    i = models.importance(brand_monthly(spark, d), **models.PUBLISHED["sketch"]).groupBy("series_id", "feature_group").agg(F.sum("size").alias("size"))
    total = i.groupBy("series_id").agg(F.sum("size").alias("total"))
    return i.join(total, "series_id").groupBy("feature_group").agg(F.avg(F.col("size") / F.nullif(F.col("total"), F.lit(0.0))).alias("share"), F.count("*").alias("n_series"))
