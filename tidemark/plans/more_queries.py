"""Queries over smoothing, shock benchmarks, interval trials and evaluation of the fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import conformal, forecasts, metrics, models, sampling, shocks, smoothing, splits
from tidemark.plans.model_queries import _FC, MODELS, _aci_sql, _SCALES, intervals, scored, _R
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, brand_monthly, numbered, table

_SES = f"""{_FC.replace('WITH', 'WITH RECURSIVE', 1)}, ls AS (SELECT f.series_id, a.weight, f.t, f.y AS level, f.y AS pred FROM fc f, (SELECT unnest([{', '.join(f'CAST({w} AS DOUBLE)' for w in smoothing.WEIGHTS)}]) AS weight) a WHERE f.t = 0
UNION ALL SELECT l.series_id, l.weight, f.t, l.weight * f.y + (1 - l.weight) * l.level, l.level FROM ls l JOIN fc f ON f.series_id = l.series_id AND f.t = l.t + 1),
lv AS (SELECT f.series_id, f.ds, f.t, f.n, f.y, f.split, l.weight, l.pred, round(sum(CASE WHEN split = 'train' THEN (y - pred) * (y - pred) END) OVER (PARTITION BY f.series_id, l.weight), 6) AS loss FROM ls l JOIN fc f USING (series_id, t)),
sm AS (SELECT * FROM lv QUALIFY dense_rank() OVER (PARTITION BY series_id ORDER BY loss, weight) = 1)"""


def _smoothed(spark, d):
    return smoothing.best_weight(smoothing.levels(splits.tail(brand_monthly(spark, d), 12)))


@query(f"{_SES} SELECT series_id, ds, split, weight, pred FROM sm", "weight pred")
def prior_ses(spark, d):
    return _smoothed(spark, d).select("series_id", "ds", "split", "weight", "pred")


@query(f"""{_SES}, sl AS (SELECT *, CASE WHEN count(y) OVER p >= 3 THEN regr_slope(y, t::DOUBLE) OVER p ELSE 0 END AS slope FROM sm WINDOW p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT series_id, ds, split, pred + slope / 2 * ((1 - pow(1 - weight, t)) / weight) AS pred FROM sl""", "pred")
def prior_theta(spark, d):
    return smoothing.theta(_smoothed(spark, d)).select("series_id", "ds", "split", "pred")


_KINDS = ("spike", "pulse", "level", "ramp", "amplitude")


@query(f"""WITH {BRAND_SQL}, s AS (SELECT *, greatest(1, n // 2) AS p, 3 * stddev_pop(y) OVER (PARTITION BY series_id) AS u, avg(y) OVER (PARTITION BY series_id) AS c FROM bm),
k AS (SELECT series_id, ds, t, p, unnest(['spike', 'pulse', 'level', 'ramp', 'amplitude']) AS kind, unnest([CASE WHEN t = p THEN y + u ELSE y END, CASE WHEN t >= p AND t < p + 6 THEN y + u ELSE y END, CASE WHEN t >= p THEN y + u ELSE y END, CASE WHEN t >= p THEN y + u * (t - p + 1) / 12 ELSE y END, CASE WHEN t >= p THEN c + 2 * (y - c) ELSE y END]) AS v FROM s),
f AS (SELECT *, coalesce(lag(v) OVER w, v) AS naive, coalesce(lag(v, 12) OVER w, lag(v) OVER w, v) AS seasonal_naive, coalesce(avg(v) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), v) AS rolling_mean FROM k WINDOW w AS (PARTITION BY series_id, kind ORDER BY ds)),
m AS (UNPIVOT f ON naive, seasonal_naive, rolling_mean INTO NAME model VALUE pred)
SELECT kind, model, CASE WHEN t < p THEN 'pre' WHEN t < p + 6 THEN 'during' ELSE 'post' END AS phase, count(*) AS n_points, avg(abs(v - pred)) AS mae FROM m GROUP BY 1, 2, 3""", "mae")
def shock_benchmark(spark, d):
    """Every kind of shock, every model: errors before, during and after."""
    i = shocks.injected(brand_monthly(spark, d)).select("series_id", "ds", *_KINDS)
    long = i.unpivot(["series_id", "ds"], list(_KINDS), "kind", "y").select(F.concat_ws("|", "series_id", "kind").alias("series_id"), "ds", "y", "kind")
    o = numbered(long.select("series_id", "ds", "y"))
    f = forecasts.compared(o, MODELS).withColumn("kind", F.substring_index("series_id", "|", -1)).withColumn("p", shocks.position())
    phase = F.when(F.col("t") < F.col("p"), "pre").when(F.col("t") < F.col("p") + 6, "during").otherwise("post")
    return f.withColumn("phase", phase).groupBy("kind", "model", "phase").agg(F.count("*").alias("n_points"), metrics.point()["mae"].alias("mae"))


@query(f"WITH {BRAND_SQL} SELECT series_id, ds, CASE WHEN t < least(greatest(floor(n * CAST(0.75 AS DOUBLE)), 6), n - 3) THEN 'fit' ELSE 'conformal' END AS part FROM bm WHERE n >= 12")
def conformal_split(spark, d):
    o = brand_monthly(spark, d).where("n >= 12")
    return o.select("series_id", "ds", F.when(F.col("t") < splits.conformal_start(F.col("n")), "fit").otherwise("conformal").alias("part"))


@query("""WITH c AS (SELECT p_partkey, (p_size + 20)::INTEGER AS n, (p_partkey % 30 + 1)::INTEGER AS lookback, (p_partkey % 12 + 1)::INTEGER AS lags FROM part), s AS (SELECT *, least(greatest(floor(n * CAST(0.8 AS DOUBLE)), 17), n - 2)::INTEGER AS split FROM c)
SELECT p_partkey, split, greatest(1, least(lookback, split - 7))::INTEGER AS one_step, greatest(1, least(lookback, n - 12 - 7))::INTEGER AS direct, greatest(1, least(lags, split // 3))::INTEGER AS ar_lags, split >= 26 AS seasonal FROM s""")
def feasible_params_aci(spark, d):
    """What a series allows when its last fifth calibrates intervals."""
    n, k = F.col("p_size") + 20, F.col("p_partkey")
    c = table(spark, d, "part").withColumn("split", F.least(F.greatest(F.floor(n * 0.8), F.lit(17)), n - 2).cast("int"))
    clip = lambda v, hi: F.greatest(F.lit(1), F.least(v, hi)).cast("int")
    return c.select("p_partkey", "split", clip(k % 30 + 1, F.col("split") - 7).alias("one_step"), clip(k % 30 + 1, n - 19).alias("direct"), clip(k % 12 + 1, F.floor(F.col("split") / 3)).alias("ar_lags"), (F.col("split") >= 26).alias("seasonal"))


_UQ = [(rate, scale) for rate in (0.01, 0.05) for scale in (1.0, 1.5)]
_SC = "(upper - lower) + 20 * greatest(lower - y, 0) + 20 * greatest(y - upper, 0)"
_UQ_ONE = "SELECT {i}::INTEGER AS trial, CAST({r} AS DOUBLE) AS rate, CAST({s} AS DOUBLE) AS scale, series_id, avg({sc}) / first(sc.scale) + 100 * pow(greatest(0, CAST(0.9 AS DOUBLE) - avg((y BETWEEN lower AND upper)::DOUBLE)), 2) AS score FROM iv JOIN sc USING (series_id) WHERE split = 'test' GROUP BY series_id"


@query("SELECT trial, rate, scale, quantile_cont(score, 0.5) AS median FROM (" + " UNION ALL ".join(f"SELECT * FROM ({_aci_sql(r, s, models=chr(87) + 'HERE model = ' + chr(39) + 'rolling_mean' + chr(39))}{_SCALES} {_UQ_ONE.format(i=i, r=r, s=s, sc=_SC)})" for i, (r, s) in enumerate(_UQ)) + ") GROUP BY 1, 2, 3", "rate scale median")
def hpo_uq(spark, d):
    """Settings of the intervals, with the forecasts as they are: score by width, misses and lacking coverage; median over series."""
    f = forecasts.compared(splits.tail(brand_monthly(spark, d), 12), ("rolling_mean",)).where("t >= n - 24")
    scale = metrics.scales(splits.tail(brand_monthly(spark, d), 12)).withColumnRenamed("scale", "unit")
    trials = F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(rate).alias("rate"), F.lit(width).alias("scale")) for i, (rate, width) in enumerate(_UQ)])
    f = f.withColumn("x", F.explode(trials)).select(*f.columns, "x.*")
    rows = conformal.adaptive(f, ["series_id", "model", "trial"], 0.1, "rate", "scale").where("split = 'test'").join(scale, "series_id")
    ecp = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    out = rows.groupBy("series_id", "trial", "rate", "scale").agg((F.avg(metrics.interval_score(0.1)) / F.first("unit") + 100 * F.greatest(F.lit(0.0), 0.9 - ecp) ** 2).alias("score"))
    return out.groupBy("trial", "rate", "scale").agg(F.percentile("score", F.lit(0.5)).alias("median"))


@query()
def evaluate_proposed(spark, d):
    """Both fitted models and their prior, with adaptive intervals calibrated on the conformal block: metrics of each series."""
    obs = splits.tail(brand_monthly(spark, d), 12)
    rows = None
    for name, f in (("reservoir", models.reservoir), ("sketch", models.sketch)):
        m = f(brand_monthly(spark, d), **models.PUBLISHED[name]).where("block in ('conformal', 'test')")
        both = [F.struct(F.lit(name).alias("model"), F.col("pred"))] + ([F.struct(F.lit("prior").alias("model"), F.col("p").alias("pred"))] if name == "reservoir" else [])
        one = m.select("series_id", "ds", "y", "block", F.explode(F.array(*both)).alias("x")).select("series_id", "x.model", "ds", "y", "x.pred", "block")
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.join(obs.select("series_id", "ds", "t"), ["series_id", "ds"])
    iv = conformal.adaptive(rows, ["series_id", "model"]).where("block = 'test'")
    return metrics.evaluate(iv.join(metrics.scales(obs), "series_id"), ["series_id", "model"])


@query(f"{_aci_sql(0.05)} SELECT model, count(*) AS n, avg((y BETWEEN lower AND upper)::DOUBLE) AS pooled, (SELECT avg(c) FROM (SELECT avg((y BETWEEN lower AND upper)::DOUBLE) AS c FROM iv i WHERE split = 'test' AND i.model = iv.model GROUP BY series_id)) AS by_series FROM iv WHERE split = 'test' GROUP BY model", "pooled by_series")
def coverage_pooled(spark, d):
    """Coverage over all rows, and the mean of the series' coverages."""
    i = intervals(spark, d).where("split = 'test'").withColumn("inside", F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    s = i.groupBy("model", "series_id").agg(F.count("*").alias("k"), F.sum("inside").alias("c"))
    return s.groupBy("model").agg(F.sum("k").alias("n"), (F.sum("c") / F.sum("k")).alias("pooled"), F.avg(F.col("c") / F.col("k")).alias("by_series"))


@query(f"{_R}, h AS (SELECT series_id, row_number() OVER (ORDER BY substr(sha256('42:' || series_id), 1, 16)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT series_id FROM rk)), ro AS (SELECT series_id, CASE WHEN k <= greatest(1, least(round_even(n * CAST(0.3 AS DOUBLE), 0), n - 1)) THEN 'development' ELSE 'evaluation' END AS role FROM h) SELECT role, model, count(*) AS n, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median FROM rk JOIN ro USING (series_id) GROUP BY 1, 2", "mean median")
def evaluation_roles(spark, d):
    """Metrics of the series a model was tuned on apart from those it never saw."""
    s = scored(spark, d)
    roles = sampling.roles(sampling.series_ids(s)).select("series_id", "role")
    return s.join(roles, "series_id").groupBy("role", "model").agg(F.count("*").alias("n"), F.avg("mae").alias("mean"), F.percentile("mae", F.lit(0.5)).alias("median"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE left(replace(lower(p_type), 'standard', 'std'), 12) END AS label FROM part")
def short_labels(spark, d):
    cut = F.substring(F.replace(F.lower("p_type"), F.lit("standard"), F.lit("std")), 1, 12)
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_type").startswith("PROMO"), "promo").otherwise(cut).alias("label"))
