"""Queries over stationarity, decomposition, validation, efficiency and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import diagnostics, forecasts, sampling, splits, statistics, tails
from tidemark.plans.experiment_queries import _GRID
from tidemark.plans.model_queries import _R, _acf_sql, scored
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, LINE_SQL, along, brand_monthly, line_monthly, table

WITH = f"WITH {BRAND_SQL}"
_Q = f"{_acf_sql(range(1, 13))}, lb AS (SELECT series_id, n, n * (n + 2) * ({' + '.join(f'rho{k} * rho{k} / (n - {k})' for k in range(1, 13))}) AS q FROM ac)"


@query(f"{_Q} SELECT series_id, q, exp(-q / 2) * (1 + q / 2 * (1 + q / 4 * (1 + q / 6 * (1 + q / 8 * (1 + q / 10))))) AS p FROM lb", "q p")
def ljung_box_p(spark, d):
    return diagnostics.ljung_box(brand_monthly(spark, d), 12).select("series_id", "q", tails.chi_square(F.col("q"), F.lit(12)).alias("p"))


@query(f"""{WITH}, l AS (SELECT series_id, lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS x, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS d FROM bm), g AS (SELECT series_id, count(*) AS n, regr_slope(d, x) AS slope, regr_sxx(d, x) AS sxx, regr_syy(d, x) AS syy FROM l WHERE x IS NOT NULL GROUP BY 1)
SELECT series_id, n, slope, slope / sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS t FROM g""", "slope t")
def dickey_fuller(spark, d):
    return diagnostics.dickey_fuller(brand_monthly(spark, d))


@query(f"""{WITH}, m AS (SELECT *, y - avg(y) OVER (PARTITION BY series_id) AS d FROM bm), s AS (SELECT *, sum(d) OVER (w ROWS UNBOUNDED PRECEDING) AS s, {', '.join(f'lag(d, {k}) OVER w AS l{k}' for k in range(1, 5))} FROM m WINDOW w AS (PARTITION BY series_id ORDER BY ds))
SELECT series_id, count(*) AS n, sum(s * s) / count(*) / (sum(d * d) + {' + '.join(f'2 * (1 - CAST({k} AS DOUBLE) / 5) * sum(d * l{k})' for k in range(1, 5))}) AS statistic FROM s GROUP BY 1""", "statistic")
def level_stationarity(spark, d):
    return diagnostics.level_stationarity(brand_monthly(spark, d))


@query(f"""{WITH}, c AS (SELECT *, (avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 AS trend FROM bm WHERE n >= 24 WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
x AS (SELECT *, y - trend AS x FROM c WHERE t >= 6 AND t < n - 6), r AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id, month(ds)) AS r FROM x)
SELECT series_id, greatest(0, 1 - var_pop(r) / var_pop(trend + r)) AS trend_strength, greatest(0, 1 - var_pop(r) / var_pop(x)) AS seasonal_strength FROM r GROUP BY 1""", "trend_strength seasonal_strength")
def decomposition_strength(spark, d):
    return diagnostics.strengths(brand_monthly(spark, d))


@query(f"""{WITH}, g AS (SELECT series_id, ds, y, date_diff('month', lag(ds) OVER (PARTITION BY series_id ORDER BY ds), ds) AS step FROM bm)
SELECT series_id, count(*) AS n, count(*) - count(DISTINCT ds) AS duplicate_dates, sum((step > 1)::INTEGER)::BIGINT AS breaks_in_calendar, sum((y IS NULL OR isnan(y))::INTEGER)::BIGINT AS not_finite,
count(*) >= 18 AND count(*) = count(DISTINCT ds) AND sum((step > 1)::INTEGER) = 0 AS valid FROM g GROUP BY 1""")
def strict_validation(spark, d):
    """What is wrong with a series, and whether nothing is."""
    g = brand_monthly(spark, d).withColumn("step", F.months_between("ds", F.lag("ds").over(along())))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    v = g.groupBy("series_id").agg(F.count("*").alias("n"), (F.count("*") - F.count_distinct("ds")).alias("duplicate_dates"), one(F.col("step") > 1).alias("breaks_in_calendar"), one(F.col("y").isNull() | F.isnan("y")).alias("not_finite"))
    return v.withColumn("valid", (F.col("n") >= 18) & (F.col("duplicate_dates") == 0) & (F.col("breaks_in_calendar") == 0) & (F.col("not_finite") == 0))


@query(f"WITH {LINE_SQL}, i AS (SELECT series_id, max(n) AS n, sha256('42:' || series_id) AS key FROM lm GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS k FROM i WHERE n >= 18) SELECT series_id, key FROM r WHERE place <= least(5, k - 1)")
def development_group(spark, d):
    """Five long enough series in hash order, at least one left out: a top-k."""
    i = line_monthly(spark, d).where("n >= 18").select("series_id").distinct().withColumn("key", sampling.hash_key(F.col("series_id"), digits=64))
    k = i.agg((F.count("*") - 1).alias("k"))
    top = i.orderBy("key").limit(5).withColumn("place", F.row_number().over(Window.orderBy("key")))  # five rows
    return top.crossJoin(F.broadcast(k)).where("place <= k").select("series_id", "key")


@query(f"""{WITH}, f AS (SELECT *, unnest([36, 60, 84, 120, 160]) AS history FROM bm), h AS (SELECT * FROM f WHERE history <= n AND t >= n - history),
p AS (SELECT *, coalesce(lag(y) OVER w, y) AS naive, coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS seasonal_naive, coalesce(avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), y) AS rolling_mean FROM h WINDOW w AS (PARTITION BY series_id, history ORDER BY ds)),
m AS (UNPIVOT p ON naive, seasonal_naive, rolling_mean INTO NAME model VALUE pred)
SELECT series_id, history, model, avg(abs(y - pred)) AS mae FROM m WHERE t >= n - 12 GROUP BY 1, 2, 3""", "mae")
def data_efficiency(spark, d):
    """Errors on the last year by how much history a model was given."""
    w = Window.partitionBy("series_id", "history").orderBy("ds")
    h = splits.histories(brand_monthly(spark, d))
    h = h.withColumn("naive", F.coalesce(F.lag("y").over(w), F.col("y"))).withColumn("seasonal_naive", F.coalesce(F.lag("y", 12).over(w), F.lag("y").over(w), F.col("y"))).withColumn("rolling_mean", F.coalesce(F.avg("y").over(w.rowsBetween(-6, -1)), F.col("y")))
    m = h.where("t >= n - 12").unpivot(["series_id", "history", "y"], ["naive", "seasonal_naive", "rolling_mean"], "model", "pred")
    return m.groupBy("series_id", "history", "model").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))


_WS = sorted({g["window"] for g in _GRID})


@query(f"""{WITH}, p AS (SELECT *, coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS s, {', '.join(f"coalesce(avg(y) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), y) AS w{k}" for k in _WS)}, unnest(range(0, 3))::INTEGER AS fold FROM bm WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
v AS (SELECT *, greatest(12, n - 18) + fold * 6 AS b FROM p), x AS (SELECT * FROM v WHERE b + 6 <= n AND t >= b AND t < b + 6),
e AS ({' UNION ALL '.join(f"SELECT series_id, fold, {i}::INTEGER AS trial, avg(abs(y - ((1 - CAST({g['share']} AS DOUBLE)) * w{g['window']} + CAST({g['share']} AS DOUBLE) * s))) AS score FROM x GROUP BY 1, 2" for i, g in enumerate(_GRID))}),
m AS (SELECT trial, series_id, quantile_cont(score, 0.5) AS score FROM e GROUP BY 1, 2) SELECT trial, quantile_cont(score, 0.5) AS median, avg(score) AS mean FROM m GROUP BY 1""", "median mean")
def hpo_folds(spark, d):
    """Settings scored on expanding folds: median over folds, then over series."""
    o = brand_monthly(spark, d).withColumn("s", forecasts.seasonal_naive())
    for k in _WS:
        o = o.withColumn(f"w{k}", forecasts.rolling_mean("y", k))
    v = splits.expanding_folds(o).where("part = 'val'")
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.abs(F.col("y") - (F.lit(1 - g["share"]) * F.col(f"w{g['window']}") + F.lit(g["share"]) * F.col("s"))).alias("e")) for i, g in enumerate(_GRID)]))
    e = v.select("series_id", "fold", trial.alias("x")).groupBy("series_id", "fold", "x.trial").agg(F.avg("x.e").alias("score"))
    m = e.groupBy("trial", "series_id").agg(F.percentile("score", F.lit(0.5)).alias("score"))
    return m.groupBy("trial").agg(F.percentile("score", F.lit(0.5)).alias("median"), F.avg("score").alias("mean"))


@query(f"{_R} SELECT series_id, arg_min(model, (mae, model)) AS best, arg_max(model, (mae, model)) AS worst, max(mae) - min(mae) AS range FROM rk GROUP BY 1", "range")
def extremes(spark, d):
    """Best and worst model of each series."""
    s = scored(spark, d)
    key = F.struct("mae", "model")
    return s.groupBy("series_id").agg(F.min_by("model", key).alias("best"), F.max_by("model", key).alias("worst"), (F.max("mae") - F.min("mae")).alias("range"))


@query(f"{_R}, q AS (SELECT series_id, model, rank, row_number() OVER (PARTITION BY series_id ORDER BY msis, model) AS other FROM ra) SELECT series_id, model, rank, other::INTEGER AS other FROM q WHERE rank <> other", "rank")
def rank_mismatches(spark, d):
    """Series and models whose ranks by point errors and by intervals disagree."""
    r = statistics.ranked(scored(spark, d), "mae")
    r = r.withColumn("other", F.row_number().over(Window.partitionBy("series_id").orderBy("msis", "model")))
    return r.where(F.col("rank") != F.col("other")).select("series_id", "model", "rank", "other")


@query("SELECT o_orderpriority AS grp, count(*) AS n, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median, stddev_samp(o_totalprice) AS std FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1", "mean median std")
def variant_summary(spark, d):
    """Mean, median and spread by group of a table of any size."""
    s = statistics.summary(table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_totalprice"), ["grp"], ["o_totalprice"])
    return s.select("grp", "n", "mean", "median", "std")
