"""Queries over windows, forecasts, intervals, metrics and tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conformal, diagnostics, forecasts, metrics, results, shocks, splits, statistics, transforms, windows
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, LINE_SQL, along, brand_monthly, line_monthly

WITH = f"WITH {BRAND_SQL}"
W = "WINDOW w AS (PARTITION BY series_id ORDER BY ds)"
MODELS = ("rolling_mean", "seasonal_naive", "naive")

# --- windows -----------------------------------------------------------------


@query(f"""{WITH}, c AS (SELECT series_id, ds, t, n, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS x, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS target FROM bm)
SELECT series_id, ds, t, x, target FROM c WHERE len(x) = 6 AND len(target) = 3""")
def direct_windows(spark, d):
    return windows.direct_windows(brand_monthly(spark, d), 6, 3)


@query(f"""{WITH}, c AS (SELECT series_id, ds, t, list(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS x, lead(y) OVER (PARTITION BY series_id ORDER BY ds) AS target FROM bm)
SELECT series_id, ds, t, x, [target] AS target FROM c WHERE len(x) = 12 AND target IS NOT NULL""")
def one_step_windows(spark, d):
    return windows.direct_windows(brand_monthly(spark, d), 12, 1)


@query(f"{WITH} SELECT series_id, ds, {', '.join(f'lag(y, {k}, 0.0) OVER w AS lag{k}' for k in range(1, 5))}, lead(y) OVER w AS target FROM bm {W}", "lag1 lag2 lag3 lag4 target")
def ar_lags(spark, d):
    return brand_monthly(spark, d).select("series_id", "ds", *windows.lags("y", 4), windows.next_value("y").alias("target"))


_RES = f"{WITH}, e AS (SELECT series_id, ds, t, n, y - coalesce(avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), y) AS e FROM bm)"


def residuals(spark, d):
    obs = brand_monthly(spark, d)
    return obs.withColumn("e", F.col("y") - forecasts.rolling_mean("y", 6))


def _fold_sql(value: str) -> str:
    return f"""{_RES.replace('WITH', 'WITH RECURSIVE', 1)}, r AS (SELECT series_id, ds, t, {value} AS v FROM e),
f AS (SELECT series_id, ds, t, v AS ema FROM r WHERE t = 0 UNION ALL SELECT r.series_id, r.ds, r.t, CAST(0.4 AS DOUBLE) * r.v + (1 - CAST(0.4 AS DOUBLE)) * f.ema FROM f JOIN r ON r.series_id = f.series_id AND r.t = f.t + 1)
SELECT series_id, ds, ema FROM f"""


@query(_fold_sql("e"), "ema")
def ema(spark, d):
    return windows.ema(residuals(spark, d), "e", 4).select("series_id", "ds", "ema")


@query(_fold_sql("abs(e)"), "ema")
def ema_volatility(spark, d):
    return windows.ema(residuals(spark, d).withColumn("e", F.abs("e")), "e", 4).select("series_id", "ds", "ema")


@query(f"""{_RES.replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT series_id, ds, t, e AS m, e * e AS v, 1::DOUBLE AS w FROM e WHERE t = 0
UNION ALL SELECT e.series_id, e.ds, e.t, CAST(0.4 AS DOUBLE) * e.e + CAST(0.6 AS DOUBLE) * m, CAST(0.4 AS DOUBLE) * e.e * e.e + CAST(0.6 AS DOUBLE) * v, CAST(0.36 AS DOUBLE) * w + CAST(0.16 AS DOUBLE) FROM f JOIN e ON e.series_id = f.series_id AND e.t = f.t + 1)
SELECT series_id, ds, CASE WHEN t = 0 THEN 0 ELSE sqrt(greatest((v - m * m) / (1 - w), 0)) END AS ewm_std FROM f""", "ewm_std")
def ewm_std(spark, d):
    return windows.ewm_std(residuals(spark, d), "e", 4).select("series_id", "ds", "ewm_std")


@query(f"{_RES} SELECT series_id, ds, coalesce(e - lag(e, 3) OVER w, 0) AS momentum FROM e {W}", "momentum")
def momentum(spark, d):
    return residuals(spark, d).select("series_id", "ds", windows.momentum("e", 3).alias("momentum"))


@query(f"""{_RES}, c AS (SELECT series_id, ds, e, list(e) OVER f AS l, avg(e) OVER f AS mean, e - first(e) OVER f AS slope, avg(abs(e)) OVER f AS energy FROM e WINDOW f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT series_id, ds, mean, slope, CASE WHEN len(l) > 1 THEN list_avg(l[len(l) // 2 + 1:]) - list_avg(l[1:len(l) // 2]) ELSE 0 END AS contrast, energy FROM c""", "mean slope contrast energy")
def causal_conv(spark, d):
    return residuals(spark, d).select("series_id", "ds", *[c.alias(k) for k, c in windows.causal("e", 5).items()])


@query(f"{_RES} SELECT series_id, ds, lag(e, 12, 0.0) OVER w AS seasonal_lag, coalesce(e - lag(e, 12) OVER w, 0) AS seasonal_gap FROM e {W}", "seasonal_lag seasonal_gap")
def seasonal_lag(spark, d):
    a, b = windows.seasonal("e", 12)
    return residuals(spark, d).select("series_id", "ds", a.alias("seasonal_lag"), b.alias("seasonal_gap"))


@query(f"{WITH} SELECT series_id, ds, sin(2 * pi() * t / 12) AS s, cos(2 * pi() * t / 12) AS c FROM bm", "s c")
def calendar_features(spark, d):
    s, c = windows.calendar(12)
    return brand_monthly(spark, d).select("series_id", "ds", s.alias("s"), c.alias("c"))


# --- forecasts -----------------------------------------------------------------

_FC = f"""{WITH}, fc AS (SELECT series_id, ds, t, n, y, CASE WHEN t >= n - 12 THEN 'test' ELSE 'train' END AS split,
  coalesce(avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), y) AS rolling_mean,
  coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS seasonal_naive, coalesce(lag(y) OVER w, y) AS naive, lag(ds) OVER w AS cutoff FROM bm WHERE n > 12 {W}),
fm AS ({' UNION ALL '.join(f"SELECT series_id, ds, t, n, y, split, cutoff, '{m}' AS model, {m} AS pred FROM fc" for m in MODELS)})"""


def compared(spark, d):
    return forecasts.compared(splits.tail(brand_monthly(spark, d), 12), MODELS)


for _m in MODELS[:2]:

    def _one(spark, d, m=_m):
        return splits.tail(brand_monthly(spark, d), 12).select("series_id", "ds", "split", forecasts.MODELS[m]().alias("pred"))

    _one.__name__ = f"prior_{_m}"
    query(f"{_FC} SELECT series_id, ds, split, {_m} AS pred FROM fc", "pred")(_one)

for _m in MODELS[1:]:

    def _test(spark, d, m=_m):
        f = splits.tail(brand_monthly(spark, d), 12).withColumn("pred", forecasts.MODELS[m]())
        return forecasts.origins(f).select("series_id", "forecast_origin", "information_cutoff", "target_timestamp", "y", "pred")

    _test.__name__ = f"baseline_{_m}"
    query(f"{_FC} SELECT series_id, cutoff AS forecast_origin, cutoff AS information_cutoff, ds AS target_timestamp, y, {_m} AS pred FROM fc WHERE split = 'test'", "y pred")(_test)


@query(f"{_FC} SELECT series_id, ds, split, model, pred, y - pred AS residual FROM fm", "pred residual")
def prior_path(spark, d):
    """Fitted values on training rows and rolling forecasts on test rows, of every prior, in one pass."""
    return compared(spark, d).select("series_id", "ds", "split", "model", "pred", (F.col("y") - F.col("pred")).alias("residual"))


@query(f"""{WITH}, l AS (SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS x FROM bm), r AS (SELECT *, regr_count(y, x) OVER p AS k, regr_slope(y, x) OVER p AS b, regr_intercept(y, x) OVER p AS a FROM l WINDOW p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, ds, CASE WHEN k >= 8 THEN a END AS intercept, CASE WHEN k >= 8 THEN b END AS slope, coalesce(CASE WHEN k >= 8 THEN a + b * x END, x, y) AS pred FROM r""", "intercept slope pred")
def baseline_ar1(spark, d):
    return forecasts.ar1(brand_monthly(spark, d)).select("series_id", "ds", "intercept", "slope", "pred")


@query(f"""{_FC}, p AS (SELECT series_id, ds, split, y, min(y) OVER (PARTITION BY series_id) > 0 AS ok FROM fc), z AS (SELECT *, CASE WHEN ok THEN ln(CASE WHEN ok THEN y ELSE 1 END) ELSE y END AS z FROM p),
f AS (SELECT *, coalesce(lag(z, 12) OVER (PARTITION BY series_id ORDER BY ds), lag(z) OVER (PARTITION BY series_id ORDER BY ds), z) AS pz FROM z),
a AS (SELECT series_id, split, 'modelling' AS scale, z AS y, pz AS pred FROM f UNION ALL SELECT series_id, split, 'original', y, CASE WHEN ok THEN exp(pz) ELSE pz END FROM f)
SELECT series_id, scale, avg(abs(y - pred)) AS mae, avg(abs(y - pred) / greatest(abs(y), 1e-5)) AS mape FROM a WHERE split = 'test' GROUP BY 1, 2""", "mae mape")
def dual_scale_metrics(spark, d):
    """A model fitted on logarithms, scored there and after the way back."""
    o = transforms.log_if_positive(splits.tail(brand_monthly(spark, d), 12)).withColumn("pz", forecasts.seasonal_naive("z"))
    a = o.select("series_id", "split", F.lit("modelling").alias("scale"), F.col("z").alias("y"), F.col("pz").alias("pred"))
    b = o.select("series_id", "split", F.lit("original").alias("scale"), "y", transforms.inverse(F.col("pz"), F.col("scale")).alias("pred"))
    m = metrics.point()
    return a.unionByName(b).where("split = 'test'").groupBy("series_id", "scale").agg(m["mae"].alias("mae"), m["mape"].alias("mape"))


_RAW = f"{_FC}, g AS (SELECT series_id, ds, t, n, y - rolling_mean AS r, seasonal_naive - rolling_mean AS raw, y, rolling_mean, seasonal_naive FROM fc WHERE split = 'train' AND t >= 12)"


def _raw(spark, d):
    o = splits.tail(brand_monthly(spark, d), 12).withColumn("p", forecasts.rolling_mean()).withColumn("s", forecasts.seasonal_naive())
    return o.where("split = 'train' and t >= 12").select("series_id", "ds", "y", "p", (F.col("y") - F.col("p")).alias("r"), (F.col("s") - F.col("p")).alias("raw"))


@query(f"{_RAW} SELECT series_id, least(greatest(sum(raw * r) / (sum(raw * raw) + 1e-12), 0), CAST(1.5 AS DOUBLE)) AS gamma FROM g GROUP BY 1", "gamma")
def shrinkage_gamma(spark, d):
    """How far the seasonal correction of the rolling mean is to be trusted."""
    return forecasts.shrinkage(_raw(spark, d), ["series_id"], "raw", "r")


@query(f"{_RAW}, m AS (SELECT *, avg(r) OVER (PARTITION BY series_id) AS mr FROM g) SELECT series_id, 1 - sum((r - raw) * (r - raw)) / (sum((r - mr) * (r - mr)) + 1e-12) AS r2 FROM m GROUP BY 1", "r2")
def residual_r2(spark, d):
    return forecasts.predictability(_raw(spark, d), ["series_id"], "raw", "r")


@query(f"""{_RAW}, k AS (SELECT series_id, least(greatest(sum(raw * r) / (sum(raw * raw) + 1e-12), 0), CAST(1.5 AS DOUBLE)) AS gamma FROM g GROUP BY 1), m AS (SELECT g.*, gamma, avg(r) OVER (PARTITION BY g.series_id) AS mr FROM g JOIN k ON g.series_id = k.series_id),
s AS (SELECT series_id, 1 - sum((r - raw) * (r - raw)) / (sum((r - mr) * (r - mr)) + 1e-12) AS r2, avg(abs(r)) AS prior_loss, avg(abs(r - gamma * raw)) AS adapted_loss FROM m GROUP BY 1)
SELECT series_id, r2, prior_loss, adapted_loss, r2 > 0 AND adapted_loss + CAST(0.05 AS DOUBLE) < prior_loss AS active,
CASE WHEN r2 > 0 AND adapted_loss + CAST(0.05 AS DOUBLE) < prior_loss THEN 'active' ELSE concat_ws('+', CASE WHEN NOT r2 > 0 THEN 'r2' END, CASE WHEN NOT adapted_loss + CAST(0.05 AS DOUBLE) < prior_loss THEN 'penalty' END) END AS reason FROM s""", "r2 prior_loss adapted_loss")
def adapter_select(spark, d):
    raw = _raw(spark, d)
    g = forecasts.shrinkage(raw, ["series_id"], "raw", "r")
    losses = raw.join(g, "series_id").groupBy("series_id").agg(F.avg(F.abs("r")).alias("prior_loss"), F.avg(F.abs(F.col("r") - F.col("gamma") * F.col("raw"))).alias("adapted_loss"))
    s = forecasts.selected(forecasts.predictability(raw, ["series_id"], "raw", "r").join(losses, "series_id"), least_r2=0.0, penalty=0.05)
    return s.select("series_id", "r2", "prior_loss", "adapted_loss", "active", "reason")


# --- intervals -----------------------------------------------------------------


@query(f"""WITH {LINE_SQL}, s AS (SELECT series_id, list_sort(list(abs(y - m))) AS s, max(n) AS n FROM (SELECT *, avg(y) OVER (PARTITION BY series_id) AS m FROM lm) GROUP BY 1), a AS (SELECT *, unnest([CAST(0.01 AS DOUBLE), 0.1, 0.25, 0.5]) AS alpha FROM s)
SELECT series_id, alpha, s[greatest(least(greatest(ceil((len(s) + 1) * (1 - alpha)), 1), len(s)), 1)::INTEGER] AS quantile FROM a""", "alpha quantile")
def conformal_quantile(spark, d):
    from tidemark.plans.substrate import whole

    s = line_monthly(spark, d).withColumn("m", F.avg("y").over(whole())).groupBy("series_id").agg(F.array_sort(F.collect_list(F.abs(F.col("y") - F.col("m")))).alias("s"))
    a = s.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.01, 0.1, 0.25, 0.5)])))
    return a.select("series_id", "alpha", conformal.order_statistic(F.col("s"), F.col("alpha")).alias("quantile"))


def _aci_sql(rate: float, scale: float = 1.0, least: str = "0::DOUBLE", models: str = "") -> str:
    return f"""{_FC.replace('WITH', 'WITH RECURSIVE', 1)}, w AS (SELECT *, stddev_pop(CASE WHEN split = 'train' THEN y END) OVER (PARTITION BY series_id, model) / 10 AS floor FROM fm {models}), x AS (SELECT *, t - (n - 24) + 1 AS i FROM w WHERE t >= n - 24),
rec AS (SELECT DISTINCT series_id, model, 0::BIGINT AS i, CAST(0.1 AS DOUBLE) AS alpha, []::DOUBLE[] AS scores, 0::DOUBLE AS half, CAST(0.1 AS DOUBLE) AS used, 0::INTEGER AS k, 0::INTEGER AS miss FROM x
UNION ALL SELECT series_id, model, i, least(greatest(used + CAST({rate} AS DOUBLE) * (CAST(0.1 AS DOUBLE) - m), CAST(0.01 AS DOUBLE)), CAST(0.5 AS DOUBLE)), list_sort(list_append(scores, err)), half, used, len(scores)::INTEGER, m FROM
 (SELECT *, (err > half)::INTEGER AS m FROM (SELECT r.series_id, r.model, x.i, r.alpha AS used, r.scores, abs(x.y - x.pred) AS err,
   greatest(CAST({scale} AS DOUBLE) * CASE WHEN len(r.scores) = 0 THEN 0 ELSE r.scores[least(greatest(ceil((len(r.scores) + 1) * (1 - r.alpha)), 1), len(r.scores))::INTEGER] END, {least}) AS half
   FROM rec r JOIN x ON x.series_id = r.series_id AND x.model = r.model AND x.i = r.i + 1))),
iv AS (SELECT x.series_id, x.model, x.ds, x.t, x.n, x.y, x.pred, x.split, x.cutoff, x.pred - half AS lower, x.pred + half AS upper, used AS alpha, k AS n_scores, miss FROM rec JOIN x USING (series_id, model, i))"""


def intervals(spark, d, rate=0.05, scale=1.0, least=None, models=MODELS):
    f = compared(spark, d).where(F.col("model").isin(*models)).where("t >= n - 24") if least is None else _floored(spark, d, models)
    return conformal.adaptive(f, ["series_id", "model"], 0.1, rate, scale, least)


def _floored(spark, d, models):
    from tidemark.plans.substrate import whole

    o = splits.tail(brand_monthly(spark, d), 12).withColumn("floor", F.stddev_pop(F.when(F.col("split") == "train", F.col("y"))).over(whole()) / 10)
    return forecasts.compared(o, models).where("t >= n - 24")


_IV_COLS = "series_id, model, ds, split, lower, upper, alpha, n_scores, miss"


@query(f"{_aci_sql(0.05)} SELECT {_IV_COLS} FROM iv", "lower upper alpha")
def aci_path(spark, d):
    """Calibration rows, then test rows, of every model: one fold along each."""
    return intervals(spark, d).select(*_IV_COLS.split(", "))


@query(f"{_aci_sql(0.0)} SELECT {_IV_COLS} FROM iv", "lower upper alpha")
def static_conformal(spark, d):
    return intervals(spark, d, rate=0.0).select(*_IV_COLS.split(", "))


@query(f"{_aci_sql(0.05, 1.5, 'x.floor')} SELECT {_IV_COLS} FROM iv", "lower upper alpha")
def interval_finalize(spark, d):
    """Widened intervals with a least width, which are also what the next step learns from."""
    return intervals(spark, d, scale=1.5, least="floor").select(*_IV_COLS.split(", "))


_NAIVE = "WHERE model = 'naive'"


@query(f"{_aci_sql(0.05, models=_NAIVE)} SELECT series_id, ds, y, pred, lower, upper FROM iv WHERE split = 'test'", "y pred lower upper")
def conformal_naive(spark, d):
    return intervals(spark, d, models=("naive",)).where("split = 'test'").select("series_id", "ds", "y", "pred", "lower", "upper")


@query(f"{_aci_sql(0.05)} SELECT series_id, model, ds, least(exp(lower / 1000), exp(upper / 1000)) AS lower, exp(pred / 1000) AS pred, greatest(exp(lower / 1000), exp(upper / 1000)) AS upper FROM iv WHERE split = 'test'", "lower pred upper")
def inverse_interval(spark, d):
    back = lambda c: F.exp(F.col(c) / 1000)
    i = intervals(spark, d).where("split = 'test'")
    return i.select("series_id", "model", "ds", F.least(back("lower"), back("upper")).alias("lower"), back("pred").alias("pred"), F.greatest(back("lower"), back("upper")).alias("upper"))


# --- metrics -----------------------------------------------------------------

_POINT = """avg(abs(y - pred) / greatest(abs(y), 1e-5)) AS mape, avg(2 * abs(y - pred) / greatest(abs(y) + abs(pred), 1e-5)) AS smape, avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse, sqrt(avg((y - pred) * (y - pred))) AS rmse,
CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) > 0 THEN 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) WHEN sum((y - pred) * (y - pred)) = 0 THEN 1 ELSE 0 END AS r2, sum(abs(y - pred)) / greatest(sum(abs(y)), 1e-5) AS wape"""
_POINT_COLS = "mape smape mae mse rmse r2 wape"


@query(f"{_FC} SELECT series_id, model, {_POINT} FROM fm WHERE split = 'test' GROUP BY 1, 2", _POINT_COLS)
def metrics_point(spark, d):
    return compared(spark, d).where("split = 'test'").groupBy("series_id", "model").agg(*[c.alias(k) for k, c in metrics.point().items()])


_SCALES = """, df AS (SELECT series_id, y, y - lag(y, 12) OVER w AS s, y - lag(y) OVER w AS d FROM fc WHERE split = 'train' WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
sb AS (SELECT series_id, CASE WHEN count(y) > 12 THEN avg(abs(s)) WHEN count(y) > 1 THEN avg(abs(d)) ELSE 1 END AS a, CASE WHEN count(y) > 12 THEN avg(s * s) WHEN count(y) > 1 THEN avg(d * d) ELSE 1 END AS b, stddev_pop(y) AS sd, var_pop(y) AS v FROM df GROUP BY 1),
sc AS (SELECT series_id, CASE WHEN a > 1e-8 THEN a WHEN sd > 1e-8 THEN sd ELSE 1 END AS scale, CASE WHEN b > 1e-12 THEN b WHEN v > 1e-12 THEN v ELSE 1 END AS square_scale FROM sb)"""


@query(f"{_FC}{_SCALES} SELECT * FROM sc", "scale square_scale")
def seasonal_naive_scale(spark, d):
    return metrics.scales(splits.tail(brand_monthly(spark, d), 12))


@query(f"{_FC}{_SCALES} SELECT series_id, model, avg(abs(y - pred)) / first(scale) AS mase, sqrt(avg((y - pred) * (y - pred)) / first(square_scale)) AS rmsse FROM fm JOIN sc USING (series_id) WHERE split = 'test' GROUP BY 1, 2", "mase rmsse")
def metrics_scaled(spark, d):
    s = metrics.scales(splits.tail(brand_monthly(spark, d), 12))
    return compared(spark, d).where("split = 'test'").join(s, "series_id").groupBy("series_id", "model").agg(*[c.alias(k) for k, c in metrics.scaled().items()])


_SCORE = "(upper - lower) + 20 * greatest(lower - y, 0) + 20 * greatest(y - upper, 0)"


@query(f"{_aci_sql(0.05)} SELECT series_id, model, ds, {_SCORE} AS score FROM iv WHERE split = 'test'", "score")
def interval_score(spark, d):
    return intervals(spark, d).where("split = 'test'").select("series_id", "model", "ds", metrics.interval_score(0.1).alias("score"))


_INTERVAL = f"avg((y BETWEEN lower AND upper)::DOUBLE) AS ecp, abs(avg((y BETWEEN lower AND upper)::DOUBLE) - CAST(0.9 AS DOUBLE)) AS coverage_error, avg(upper - lower) AS width, avg({_SCORE}) AS mis"


@query(f"{_aci_sql(0.05)}{_SCALES} SELECT series_id, model, {_INTERVAL}, avg({_SCORE}) / first(scale) AS msis FROM iv JOIN sc USING (series_id) WHERE split = 'test' GROUP BY 1, 2", "ecp coverage_error width mis msis")
def metrics_interval(spark, d):
    rows = intervals(spark, d).where("split = 'test'").join(metrics.scales(splits.tail(brand_monthly(spark, d), 12)), "series_id")
    return rows.groupBy("series_id", "model").agg(*[c.alias(k) for k, c in metrics.interval(0.1).items()])


_EVAL = f"{_aci_sql(0.05)}{_SCALES}, ev AS (SELECT series_id, model, count(*) AS n_points, {_POINT}, avg(abs(y - pred)) / first(scale) AS mase, sqrt(avg((y - pred) * (y - pred)) / first(square_scale)) AS rmsse, {_INTERVAL}, avg({_SCORE}) / first(scale) AS msis FROM iv JOIN sc USING (series_id) WHERE split = 'test' GROUP BY 1, 2)"
_EVAL_COLS = f"{_POINT_COLS} mase rmsse ecp coverage_error width mis msis"


def evaluated(spark, d):
    rows = intervals(spark, d).where("split = 'test'").join(metrics.scales(splits.tail(brand_monthly(spark, d), 12)), "series_id")
    return metrics.evaluate(rows, ["series_id", "model"])


@query(f"{_EVAL} SELECT * FROM ev", _EVAL_COLS)
def evaluate_forecast(spark, d):
    return evaluated(spark, d)


# --- table of results ----------------------------------------------------------

_META = f", mt AS (SELECT series_id, count(*)::INTEGER AS n_train, min(ds) AS train_start, max(ds) AS train_end FROM fc WHERE split = 'train' GROUP BY 1)"
_STORE = f"""{_aci_sql(0.05)}{_SCALES}{_META}, st AS (SELECT 'brands' AS dataset, series_id, model, 12::INTEGER AS seasonal_period, CAST(0.9 AS DOUBLE) AS requested_coverage, scale AS mase_scale, sqrt(square_scale) AS rmsse_scale, n_train, train_start, train_end,
12::INTEGER AS n_conformal_calibration, cutoff AS forecast_origin, cutoff AS information_cutoff, ds AS target_timestamp, y AS y_true, pred AS y_pred, lower, upper, 'ok' AS status FROM iv JOIN sc USING (series_id) JOIN mt USING (series_id) WHERE split = 'test')"""
_STORE_COLS = "dataset series_id model seasonal_period requested_coverage mase_scale rmsse_scale n_train train_start train_end n_conformal_calibration forecast_origin information_cutoff target_timestamp y_true y_pred lower upper status".split()


def stored(spark, d):
    obs = splits.tail(brand_monthly(spark, d), 12)
    meta = obs.where("split = 'train'").groupBy("series_id").agg(F.count("*").alias("n_train"), F.min("ds").alias("train_start"), F.max("ds").alias("train_end"))
    known = obs.select("series_id", "ds", F.lag("ds").over(along()).alias("forecast_origin"))
    scale = metrics.scales(obs).select("series_id", F.col("scale").alias("mase_scale"), F.sqrt("square_scale").alias("rmsse_scale"))
    rows = intervals(spark, d).where("split = 'test'").join(known, ["series_id", "ds"]).join(scale, "series_id").join(meta, "series_id")
    rows = rows.withColumn("information_cutoff", F.col("forecast_origin")).withColumn("target_timestamp", F.col("ds")).withColumnsRenamed({"y": "y_true", "pred": "y_pred"})
    return results.store(rows, dataset="brands", seasonal_period=12, requested_coverage=0.9, n_conformal_calibration=12, status="ok", model_params_json=results.stable_json({"m": 12, "window": 6}))


@query(f"{_STORE} SELECT {', '.join(_STORE_COLS)} FROM st", "requested_coverage mase_scale rmsse_scale y_true y_pred lower upper")
def result_store(spark, d):
    return stored(spark, d).select(*_STORE_COLS)


@query("SELECT sha256(model || '|{\"m\":12,\"window\":6}|') AS config_hash, model FROM (VALUES ('naive'), ('rolling_mean'), ('seasonal_naive')) AS v(model)")
def config_hash(spark, d):
    return stored(spark, d).select("config_hash", "model").distinct()


@query(f"{_STORE} SELECT series_id, model, target_timestamp FROM (SELECT *, CASE WHEN month(target_timestamp) = 6 THEN target_timestamp ELSE information_cutoff END AS cut FROM st) WHERE NOT target_timestamp > cut OR lower > y_pred OR y_pred > upper")
def causality_violations(spark, d):
    """A table in which June's rows claim to know their target."""
    s = stored(spark, d).withColumn("information_cutoff", F.when(F.month("target_timestamp") == 6, F.col("target_timestamp")).otherwise(F.col("information_cutoff")))
    return results.violations(s).select("series_id", "model", "target_timestamp")


@query(f"{_EVAL} SELECT 'brands' AS dataset, * FROM ev", _EVAL_COLS)
def per_series_metrics(spark, d):
    """From the stored scales, without the training rows."""
    return results.per_series(stored(spark, d))


@query(f"{_EVAL} SELECT model, min(round(mae, 6)) AS least, max(round(mae, 6)) AS greatest FROM ev GROUP BY 1 HAVING max(mae) - min(mae) > 1e-10", "least greatest")
def metric_conflicts(spark, d):
    return results.conflicts(evaluated(spark, d).select("model", F.round("mae", 6).alias("mae")), ["model"], "mae")


@query(f"{_STORE} SELECT DISTINCT dataset, model, seasonal_period, n_conformal_calibration, status FROM st")
def paper_tables(spark, d):
    return stored(spark, d).select("dataset", "model", "seasonal_period", "n_conformal_calibration", "status").distinct()


# --- statistics ------------------------------------------------------------------

_R = f"{_EVAL}, rk AS (SELECT series_id, model, round(mae, 6) AS mae, round(mase, 6) AS mase, round(msis, 6) AS msis FROM ev), ra AS (SELECT *, rank() OVER (PARTITION BY series_id ORDER BY mae) + (count(*) OVER (PARTITION BY series_id, mae) - 1) / 2 AS rank FROM rk)"


def scored(spark, d):
    return evaluated(spark, d).select("series_id", "model", *[F.round(c, 6).alias(c) for c in ("mae", "mase", "msis")])


@query(f"{_EVAL} SELECT model, count(DISTINCT series_id) AS n_series, avg(mase) AS mase_mean, quantile_cont(mase, 0.5) AS mase_median, stddev_samp(mase) AS mase_std, quantile_cont(smape, 0.5) AS smape_median, avg(rmse) AS rmse_mean, avg(msis) AS msis_mean, avg(ecp) AS ecp_mean FROM ev GROUP BY 1", "mase_mean mase_median mase_std smape_median rmse_mean msis_mean ecp_mean")
def aggregate_metrics(spark, d):
    """The whole way: months, forecasts, intervals, metrics of each series, and each model's summary."""
    half = lambda c: F.percentile(c, F.lit(0.5))
    return evaluated(spark, d).groupBy("model").agg(F.count_distinct("series_id").alias("n_series"), F.avg("mase").alias("mase_mean"), half("mase").alias("mase_median"), F.stddev_samp("mase").alias("mase_std"), half("smape").alias("smape_median"), F.avg("rmse").alias("rmse_mean"), F.avg("msis").alias("msis_mean"), F.avg("ecp").alias("ecp_mean"))


@query(f"{_R}, u AS (UNPIVOT rk ON mae, mase, msis INTO NAME metric VALUE value) SELECT model, metric, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, coalesce(stddev_samp(value), 0) AS std FROM u GROUP BY 1, 2", "mean median q1 q3 iqr std")
def metric_summary(spark, d):
    return statistics.summary(scored(spark, d).drop("series_id"), ["model"], ["mae", "mase", "msis"])


@query(f"{_R} SELECT model, count(*) AS n, avg(rank) AS average_rank, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median FROM ra GROUP BY 1", "average_rank mean median")
def average_rank(spark, d):
    return statistics.average_rank(scored(spark, d), "mae")


@query(f"{_R} SELECT series_id, max(CASE WHEN model = 'rolling_mean' THEN mae END) AS rolling_mean, max(CASE WHEN model = 'seasonal_naive' THEN mae END) AS seasonal_naive, max(CASE WHEN model = 'naive' THEN mae END) AS naive FROM rk GROUP BY 1", "rolling_mean seasonal_naive naive")
def pivot_models(spark, d):
    return statistics.complete(scored(spark, d), MODELS, "mae")


@query(f"{_R}, m AS (SELECT model, sum(rank) AS r, count(*) AS n FROM ra GROUP BY 1), ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY series_id, mae)), fr AS (SELECT max(n) AS n, count(*) AS k, sum(r * r) AS ss FROM m) SELECT n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS chi_square FROM fr, ti", "chi_square")
def friedman(spark, d):
    return statistics.friedman(scored(spark, d), "mae")


_PAIRS = f"{_R}, pr AS (SELECT a.series_id, a.model AS a, b.model AS b, a.mae - b.mae AS d FROM rk a JOIN rk b ON a.series_id = b.series_id AND a.model < b.model)"


@query(f"{_PAIRS} SELECT a, b, count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM pr GROUP BY 1, 2", "mean se t")
def pairwise_t(spark, d):
    return statistics.paired_t(scored(spark, d), "mae")


_ERFC = "least((u * (CAST(0.254829592 AS DOUBLE) + u * (CAST(-0.284496736 AS DOUBLE) + u * (CAST(1.421413741 AS DOUBLE) + u * (CAST(-1.453152027 AS DOUBLE) + u * CAST(1.061405429 AS DOUBLE)))))) * exp(-x * x), 1)"


@query(f"""{_PAIRS}, tt AS (SELECT a, b, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) AS t FROM pr GROUP BY 1, 2), xx AS (SELECT *, abs(t) / sqrt(2) AS x FROM tt), uu AS (SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * x) AS u FROM xx), p AS (SELECT a, b, round({_ERFC}, 9) AS p FROM uu),
s AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p, 1) AS step FROM p) SELECT a, b, p, max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS holm FROM s""", "p holm")
def holm(spark, d):
    t = statistics.paired_t(scored(spark, d), "mae").select("a", "b", F.round(statistics.normal_tail(F.col("t")), 9).alias("p"))
    return statistics.holm(t, "p", "a", "b")


@query(f"{_R}, g AS (SELECT model, avg(rank) AS r, count(*) AS n FROM ra GROUP BY 1), k AS (SELECT count(*) AS k FROM g) SELECT a.model AS a, b.model AS b, abs(a.r - b.r) AS difference, CASE WHEN k <= 5 THEN 2.343::DOUBLE ELSE 2.569::DOUBLE END * sqrt(k * (k + 1) / (6.0 * a.n)) AS critical, abs(a.r - b.r) > CASE WHEN k <= 5 THEN 2.343::DOUBLE ELSE 2.569::DOUBLE END * sqrt(k * (k + 1) / (6.0 * a.n)) AS significant FROM g a JOIN g b ON a.model < b.model, k", "difference critical")
def nemenyi(spark, d):
    return statistics.nemenyi(scored(spark, d), "mae")


@query(f"""{_FC}, q AS (SELECT series_id, ds, max(CASE WHEN model = 'naive' THEN (y - pred) * (y - pred) END) - max(CASE WHEN model = 'rolling_mean' THEN (y - pred) * (y - pred) END) AS d FROM fm WHERE split = 'test' GROUP BY 1, 2), g AS (SELECT series_id, count(d) AS n, avg(d) AS m, var_samp(d) AS v FROM q GROUP BY 1)
SELECT series_id, n, CASE WHEN n >= 8 THEN CASE WHEN v <= 1e-12 THEN 0 ELSE m / sqrt(v / n) * sqrt((n - 1) / n) END END AS statistic, CASE WHEN n < 8 THEN 'low_power' ELSE 'ok' END AS status FROM g""", "statistic")
def diebold_mariano(spark, d):
    return statistics.diebold_mariano(compared(spark, d).where("split = 'test'"), "naive", "rolling_mean")


@query(f"""{_PAIRS}, s AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS r FROM pr WHERE d <> 0)
SELECT a, b, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS positive, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS negative, least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w FROM s GROUP BY 1, 2""", "positive negative w")
def wilcoxon(spark, d):
    return statistics.wilcoxon(scored(spark, d), "mae")


@query(f"""{_aci_sql(0.05)}, o AS (SELECT *, row_number() OVER (PARTITION BY series_id, model ORDER BY round(abs(y - pred), 6), ds) AS r, count(*) OVER (PARTITION BY series_id, model) AS m FROM iv WHERE split = 'test')
SELECT model, CASE WHEN m = 1 THEN 0 ELSE greatest(ceil((r - 1) * least(4, m) / (m - 1)) - 1, 0) END::INTEGER AS quartile, count(*) AS n, avg((y BETWEEN lower AND upper)::DOUBLE) AS coverage FROM o GROUP BY 1, 2""", "coverage")
def coverage_breakdown(spark, d):
    i = intervals(spark, d).where("split = 'test'").withColumn("pred", F.col("y") - F.round(F.col("y") - F.col("pred"), 6))
    return statistics.coverage(i)


@query(f"""{_R}, l AS (SELECT model, list_sort(list(mae)) AS v, quantile_cont(mae, 0.5) AS median FROM rk GROUP BY 1) SELECT model, list_avg(v[floor(len(v) * CAST(0.1 AS DOUBLE))::INTEGER + 1:len(v) - floor(len(v) * CAST(0.1 AS DOUBLE))::INTEGER]) AS trimmed, median FROM l""", "trimmed median")
def trimmed_mean(spark, d):
    return statistics.trimmed_mean(scored(spark, d), ["model"], "mae")


_FOLDS = f"""{WITH}, f0 AS (SELECT *, coalesce(lag(y) OVER w, y) AS pred, unnest(range(0, 3))::INTEGER AS fold FROM bm {W}), f1 AS (SELECT *, greatest(12, n - 18) AS first FROM f0),
fo AS (SELECT series_id, fold, avg(abs(y - pred)) AS mae FROM f1 WHERE first + fold * 6 + 6 <= n AND t < first + fold * 6 + 6 AND t >= first + fold * 6 GROUP BY 1, 2)"""


@query(f"{_FOLDS}, s AS (SELECT series_id, quantile_cont(mae, 0.5) AS m FROM fo GROUP BY 1) SELECT quantile_cont(m, 0.5) AS median, avg(m) AS mean, count(*) AS n FROM s", "median mean")
def two_stage_median(spark, d):
    """Median over folds of each series, then over series."""
    obs = brand_monthly(spark, d).withColumn("pred", forecasts.naive())
    f = splits.expanding_folds(obs).where("part = 'val'").groupBy("series_id", "fold").agg(metrics.point()["mae"].alias("mae"))
    s = f.groupBy("series_id").agg(F.percentile("mae", F.lit(0.5)).alias("m"))
    return s.agg(F.percentile("m", F.lit(0.5)).alias("median"), F.avg("m").alias("mean"), F.count("*").alias("n"))


@query(f"{_R} SELECT r.series_id, r.model, r.mae - f.mae AS delta FROM rk r JOIN rk f ON r.series_id = f.series_id AND f.model = 'rolling_mean'", "delta")
def delta_vs_full(spark, d):
    s = scored(spark, d)
    full = s.where("model = 'rolling_mean'").select("series_id", F.col("mae").alias("full"))
    return s.join(full, "series_id").select("series_id", "model", (F.col("mae") - F.col("full")).alias("delta"))


@query(f"{WITH}, p AS (SELECT *, coalesce(lag(y) OVER w, y) AS naive, coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS seasonal_naive FROM bm {W}), f AS (SELECT *, unnest([36, 60, 84, 120, 160]) AS history FROM p), h AS (SELECT * FROM f WHERE history <= n AND t >= n - history) SELECT history, avg(abs(y - naive)) AS naive, avg(abs(y - seasonal_naive)) AS seasonal_naive FROM h GROUP BY 1", "naive seasonal_naive")
def efficiency_pivot(spark, d):
    """Mean error by history size, a column for each model."""
    f = forecasts.compared(brand_monthly(spark, d), ("naive", "seasonal_naive"))
    h = splits.histories(f)
    return h.groupBy("history").pivot("model", ["naive", "seasonal_naive"]).agg(F.avg(F.abs(F.col("y") - F.col("pred"))))


_HOLES = f"{_R}, ho AS (SELECT series_id, model, CASE WHEN NOT (model = 'naive' AND series_id LIKE '%2') THEN mae END AS mae FROM rk)"


def _holes(spark, d):
    return scored(spark, d).withColumn("mae", F.when(~((F.col("model") == "naive") & F.col("series_id").endswith("2")), F.col("mae"))).select("series_id", "model", "mae")


@query(f"{_HOLES} SELECT model, count(*) AS n_expected, count(mae) AS n_success, count(*) - count(mae) AS n_failed, count(*) = count(mae) AS complete, avg(mae) AS mean FROM ho GROUP BY 1", "mean")
def cohort_summary(spark, d):
    n, ok = F.count("*"), F.count("mae")
    return _holes(spark, d).groupBy("model").agg(n.alias("n_expected"), ok.alias("n_success"), (n - ok).alias("n_failed"), (n == ok).alias("complete"), F.avg("mae").alias("mean"))


@query(f"{_HOLES} SELECT series_id FROM ho WHERE mae IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM ho)")
def common_cohort(spark, d):
    return statistics.common_series(_holes(spark, d), "mae")


@query(f"{_HOLES}, h AS (SELECT series_id, model FROM ho WHERE mae IS NOT NULL) SELECT s.series_id, m.model FROM (SELECT DISTINCT series_id FROM h) s, (SELECT DISTINCT model FROM h) m WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.series_id = s.series_id AND h.model = m.model)")
def missing_cells(spark, d):
    """Series and models of the full grid that have no value."""
    have = _holes(spark, d).where("mae is not null").select("series_id", "model")
    models = F.array(*[F.lit(m) for m in MODELS])
    grid = have.select("series_id").distinct().withColumn("model", F.explode(models))
    return grid.join(have, ["series_id", "model"], "left_anti")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table_keys(spark, d).groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).where("n > 1")


def table_keys(spark, d):
    from tidemark.plans.substrate import table

    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey")


@query(f"{_R} SELECT model, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median, quantile_cont(mae, 0.75) - quantile_cont(mae, 0.25) AS iqr, row_number() OVER (ORDER BY quantile_cont(mae, 0.5), model)::INTEGER AS place FROM rk GROUP BY 1", "mean median iqr")
def ranked_models(spark, d):
    from pyspark.sql import Window

    s = statistics.summary(scored(spark, d).select("model", "mae"), ["model"], ["mae"])
    return s.withColumn("place", F.row_number().over(Window.orderBy("median", "model"))).select("model", "mean", "median", "iqr", "place")


@query(f"{_R}, b AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, model) AS r FROM rk) SELECT series_id, model, mae FROM b WHERE r = 1", "mae")
def top1_per_series(spark, d):
    from tidemark.operators.sampling import best

    return best(scored(spark, d), ["series_id"], "mae", "model").select("series_id", "model", "mae")


@query("SELECT count(*) AS n_rows, count(DISTINCT (event_id, ts, user_id, event_type, value)) AS n_distinct, count(*) - count(value) AS value_nulls, sum((value < 0)::INTEGER)::BIGINT AS value_negative, min(value) AS value_min, max(value) AS value_max FROM events", "value_min value_max")
def profile_table(spark, d):
    from tidemark.plans.substrate import table

    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.groupBy(*e.columns).agg(F.count("*").alias("k")).agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.when(F.col("value").isNull(), F.col("k")).otherwise(0)).alias("value_nulls"), F.sum(F.when(F.col("value") < 0, F.col("k")).otherwise(0)).alias("value_negative"), F.min("value").alias("value_min"), F.max("value").alias("value_max"))


# --- diagnostics -----------------------------------------------------------------


@query(f"{WITH} SELECT series_id, count(*) AS n, CASE WHEN abs(avg(y)) > 1e-12 THEN stddev_samp(y) / abs(avg(y)) END AS cv, avg((y IS NULL)::DOUBLE) AS missing, avg((y = 0)::DOUBLE) AS zeros FROM bm GROUP BY 1", "cv missing zeros")
def series_profile(spark, d):
    return diagnostics.profile(brand_monthly(spark, d))


def _acf_sql(lags) -> str:
    return f"{WITH}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS x FROM bm), l AS (SELECT *, {', '.join(f'lag(x, {k}) OVER w AS l{k}' for k in lags)} FROM m {W}), ac AS (SELECT series_id, count(*) AS n, {', '.join(f'sum(x * l{k}) / nullif(sum(x * x), 0) AS rho{k}' for k in lags)} FROM l GROUP BY 1)"


@query(f"{_acf_sql((1, 12))} SELECT * FROM ac", "rho1 rho12")
def acf(spark, d):
    return diagnostics.autocorrelation(brand_monthly(spark, d), [1, 12])


@query(f"{_acf_sql(range(1, 13))} SELECT series_id, n, n * (n + 2) * ({' + '.join(f'rho{k} * rho{k} / (n - {k})' for k in range(1, 13))}) AS q FROM ac", "q")
def ljung_box(spark, d):
    return diagnostics.ljung_box(brand_monthly(spark, d), 12)


@query(f"""{WITH}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS x, unnest(range(1, n // 2 + 1)) AS k FROM bm), p AS (SELECT series_id, k, pow(sum(x * cos(2 * pi() * ((k * t) % n) / n)), 2) + pow(sum(x * sin(2 * pi() * ((k * t) % n) / n)), 2) AS p FROM m GROUP BY 1, 2),
s AS (SELECT series_id, p / nullif(sum(p) OVER (PARTITION BY series_id), 0) AS s FROM p) SELECT series_id, sum(CASE WHEN s > 1e-15 THEN -s * ln(CASE WHEN s > 1e-15 THEN s ELSE 1 END) ELSE 0 END) / ln(count(*)) AS entropy FROM s GROUP BY 1""", "entropy")
def spectral_entropy(spark, d):
    return diagnostics.spectral_entropy(brand_monthly(spark, d))


@query(f"""{WITH}, m AS (SELECT *, stddev_pop(y) OVER (PARTITION BY series_id) AS sd, avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS a, avg(y) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS b FROM bm)
SELECT series_id, t, ds, abs(b - a) / nullif(sd, 0) AS z FROM m WHERE t >= 8 AND t <= n - 8 AND abs(b - a) / nullif(sd, 0) >= CAST(0.8 AS DOUBLE)""", "z")
def structural_breaks(spark, d):
    return diagnostics.breaks(brand_monthly(spark, d), 8, 0.8)


@query()
def break_count(spark, d):
    """Breaks kept in order, a least distance apart; checked against a loop in the tests."""
    return diagnostics.break_count(diagnostics.breaks(brand_monthly(spark, d), 8, 0.8))


@query(f"""{_FC}, r AS (SELECT model, y - pred AS e FROM fm), m AS (SELECT *, quantile_cont(e, 0.5) OVER (PARTITION BY model) AS med, avg(e) OVER (PARTITION BY model) AS mu FROM r),
g AS (SELECT model, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS sd, first(med) AS median, CAST(1.4826 AS DOUBLE) * quantile_cont(abs(e - med), 0.5) AS mad, avg(pow(e - mu, 3)) / pow(avg(pow(e - mu, 2)), 1.5) AS g1, avg(pow(e - mu, 4)) / pow(avg(pow(e - mu, 2)), 2) - 3 AS g2 FROM m GROUP BY 1)
SELECT model, n, mean, sd, median, mad, sqrt(n * (n - 1)) / (n - 2) * g1 AS skew, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) AS kurtosis, n / 6 * (g1 * g1 + g2 * g2 / 4) AS jarque_bera FROM g""", "mean sd median mad skew kurtosis jarque_bera")
def residual_diagnostics(spark, d):
    r = compared(spark, d).select("model", (F.col("y") - F.col("pred")).alias("e"))
    return diagnostics.residual_moments(r, ["model"], "e")


# --- shocks ------------------------------------------------------------------------


@query(f"""{WITH}, s AS (SELECT *, greatest(1, n // 2) AS p, 3 * stddev_pop(y) OVER (PARTITION BY series_id) AS u, avg(y) OVER (PARTITION BY series_id) AS c FROM bm)
SELECT series_id, ds, t, y, CASE WHEN t = p THEN y + u ELSE y END AS spike, CASE WHEN t >= p AND t < p + 6 THEN y + u ELSE y END AS pulse, CASE WHEN t >= p THEN y + u ELSE y END AS level, CASE WHEN t >= p THEN y + u * (t - p + 1) / 12 ELSE y END AS ramp, CASE WHEN t >= p THEN c + 2 * (y - c) ELSE y END AS amplitude FROM s""", "y spike pulse level ramp amplitude")
def inject_shocks(spark, d):
    return shocks.injected(brand_monthly(spark, d))


_INNO = f"{_FC}, io AS (SELECT *, abs(y - coalesce(lag(y, 12) OVER (PARTITION BY series_id ORDER BY ds), first(y) OVER (PARTITION BY series_id ORDER BY ds))) AS inno FROM fc), th AS (SELECT series_id, quantile_cont(inno, 0.75) + CAST(1.5 AS DOUBLE) * (quantile_cont(inno, 0.75) - quantile_cont(inno, 0.25)) AS limit_iqr, quantile_cont(inno, 0.9) AS limit_q90 FROM io WHERE split = 'train' AND t >= 12 GROUP BY 1)"


@query(f"{_INNO} SELECT * FROM th", "limit_iqr limit_q90")
def shock_threshold(spark, d):
    return shocks.thresholds(shocks.innovations(splits.tail(brand_monthly(spark, d), 12)))


@query(f"{_INNO} SELECT series_id, ds, inno AS innovation, inno > limit_q90 AS shock FROM io JOIN th USING (series_id) WHERE split = 'test'", "innovation")
def label_shocks(spark, d):
    return shocks.labelled(splits.tail(brand_monthly(spark, d), 12)).select("series_id", "ds", "innovation", "shock")


@query(f"""{_INNO}, lb AS (SELECT series_id, ds, inno > limit_q90 AS shock FROM io JOIN th USING (series_id) WHERE split = 'test'), j AS (SELECT model, y, pred, unnest(['overall', CASE WHEN shock THEN 'shock' ELSE 'non_shock' END]) AS regime FROM fm JOIN lb USING (series_id, ds))
SELECT model, regime, count(*) AS n_points, avg(abs(y - pred)) AS mae, avg(abs(y - pred) / greatest(abs(y), 1e-5)) AS mape FROM j GROUP BY 1, 2""", "mae mape")
def shock_metrics(spark, d):
    labels = shocks.labelled(splits.tail(brand_monthly(spark, d), 12)).select("series_id", "ds", "shock")
    rows = shocks.regimes(compared(spark, d).join(labels, ["series_id", "ds"]))
    m = metrics.point()
    return rows.groupBy("model", "regime").agg(F.count("*").alias("n_points"), m["mae"].alias("mae"), m["mape"].alias("mape"))


@query(f"""{_INNO}, lb AS (SELECT series_id, ds, inno > limit_q90 AS shock FROM io JOIN th USING (series_id) WHERE split = 'test'), j AS (SELECT series_id, model, y, pred, shock FROM fm JOIN lb USING (series_id, ds)),
g AS (SELECT series_id, model, avg(CASE WHEN shock THEN abs(y - pred) END) AS shock, avg(CASE WHEN NOT shock THEN abs(y - pred) END) AS calm FROM j GROUP BY 1, 2) SELECT series_id, model, shock, calm, shock / nullif(calm, 0) AS ratio, shock - calm AS difference FROM g WHERE shock IS NOT NULL AND calm IS NOT NULL""", "shock calm ratio difference")
def shock_ratio(spark, d):
    labels = shocks.labelled(splits.tail(brand_monthly(spark, d), 12)).select("series_id", "ds", F.when(F.col("shock"), "shock").otherwise("calm").alias("regime"))
    p = compared(spark, d).join(labels, ["series_id", "ds"]).groupBy("series_id", "model").pivot("regime", ["shock", "calm"]).agg(F.avg(F.abs(F.col("y") - F.col("pred")))).dropna()
    return p.withColumn("ratio", F.col("shock") / F.nullif("calm", F.lit(0.0))).withColumn("difference", F.col("shock") - F.col("calm"))


@query(f"""{_FC}, df AS (SELECT series_id, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS d FROM fc WHERE split = 'train'), m AS (SELECT series_id, d, quantile_cont(d, 0.5) OVER (PARTITION BY series_id) AS md FROM df WHERE d IS NOT NULL), a AS (SELECT series_id, abs(d - md) AS a, quantile_cont(abs(d - md), 0.5) OVER (PARTITION BY series_id) AS mad FROM m)
SELECT series_id, sum((a / greatest(CAST(1.4826 AS DOUBLE) * mad, 1e-9) > 2)::INTEGER)::BIGINT AS n_shocks, sum((a / greatest(CAST(1.4826 AS DOUBLE) * mad, 1e-9) > 2)::INTEGER) > 0 AS shock FROM a GROUP BY 1""")
def mad_shock_regime(spark, d):
    return shocks.outlying_series(splits.tail(brand_monthly(spark, d), 12), 2.0)


@query(f"""{WITH}, s AS (SELECT *, greatest(1, n // 2) AS p, 3 * stddev_pop(y) OVER (PARTITION BY series_id) AS u FROM bm), z AS (SELECT series_id, ds, t, p, CASE WHEN t >= p AND t < p + 6 THEN y + u ELSE y END AS v FROM s), f AS (SELECT *, round(v - coalesce(avg(v) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), v), 6) AS e, CASE WHEN t < p THEN 'pre' WHEN t < p + 6 THEN 'during' ELSE 'post' END AS ph FROM z),
q AS (SELECT *, abs(e) AS a, quantile_cont(CASE WHEN ph = 'pre' THEN abs(e) END, 0.5) OVER (PARTITION BY series_id) AS usual FROM f)
SELECT series_id, avg(CASE WHEN ph = 'pre' THEN a END) AS mae_pre, avg(CASE WHEN ph = 'during' THEN a END) AS mae_during, avg(CASE WHEN ph = 'post' THEN a END) AS mae_post, max(CASE WHEN ph <> 'pre' THEN a END) AS peak, min(CASE WHEN ph = 'post' AND a <= usual THEN t - p - 6 END)::BIGINT AS recovery FROM q GROUP BY 1""", "mae_pre mae_during mae_post peak")
def controlled_shock(spark, d):
    """Rolling means through a pulse: errors before, during and after it, and how soon they are back."""
    i = shocks.injected(brand_monthly(spark, d).withColumn("n0", F.col("n"))).select("series_id", "ds", "t", F.col("pulse").alias("y"))
    from tidemark.plans.substrate import numbered

    o = numbered(i.select("series_id", "ds", "y"))
    e = F.round(F.col("y") - forecasts.rolling_mean(), 6)
    r = shocks.recovery(o.select("series_id", F.col("t").cast("long").alias("t"), e.alias("e"), shocks.position().cast("long").alias("p"), F.lit(6).cast("long").alias("length")))
    return r.withColumn("recovery", F.col("recovery").cast("long"))
