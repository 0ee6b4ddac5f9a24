"""Queries over forecasts of several months, regressions inside the plan, and statistics over collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import adapters, forecasts, least_squares, models, splits, statistics
from tidemark.plans.registry import query
from tidemark.plans.significance_queries import _T_TAIL
from tidemark.plans.substrate import BRAND_SQL, brand_monthly, numbered, table

WITH = f"WITH {BRAND_SQL}"


@query(f"""WITH RECURSIVE {BRAND_SQL}, l AS (SELECT series_id, list(y::DOUBLE ORDER BY t) AS v, max(ds) AS e FROM bm WHERE t >= n - 12 GROUP BY 1),
r AS (SELECT series_id, e, v, model, 0 AS step, 0::DOUBLE AS pred FROM l, (VALUES ('naive'), ('rolling_mean'), ('seasonal_naive')) AS m(model)
 UNION ALL SELECT series_id, e, list_append(v, p), model, step + 1, p FROM (SELECT *, CASE model WHEN 'naive' THEN v[len(v)] WHEN 'rolling_mean' THEN list_avg(v[greatest(len(v) - 5, 1):len(v)]) ELSE CASE WHEN len(v) >= 12 THEN v[len(v) - 11] ELSE v[len(v)] END END AS p FROM r WHERE step < 12))
SELECT series_id, model, step::INTEGER AS step, last_day(e + to_months(step::INTEGER)) AS ds, pred FROM r WHERE step > 0""", "pred")
def priors_ahead(spark, d):
    """Twelve months by each prior, from its own forecasts."""
    return adapters.priors_ahead(brand_monthly(spark, d), 12)


@query()
def fitted_ahead(spark, d):
    """Twelve months by both fitted models, with intervals; each forecast stands for its month in those after it."""
    obs, out = brand_monthly(spark, d), None
    for kind in ("sketch", "reservoir"):
        rows = adapters.ahead(adapters.states(obs, kind, **models.PUBLISHED[kind]), 12).withColumn("model", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def direct_ahead(spark, d):
    """Six months at once by four regressions on the last twelve values."""
    return adapters.direct(brand_monthly(spark, d), models.KINDS, 6)


@query()
def sparse_readouts(spark, d):
    """Errors of both fitted models with each readout: ridge, lasso, elastic net, evidence."""
    obs, out = brand_monthly(spark, d), None
    settings = {"ridge": {}, "lasso": {"readout": "lasso", "alpha": 0.1}, "elastic": {"readout": "elastic", "alpha": 0.1}, "bayes": {"readout": "bayes"}}
    for kind in ("sketch", "reservoir"):
        rows = getattr(models, kind)(obs, variants=settings, **models.PUBLISHED[kind]).where("block = 'test'")
        one = rows.groupBy(F.lit(kind).alias("model"), F.col("variant").alias("readout"), "series_id").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
        out = one if out is None else out.unionByName(one)
    return out


#: Regression of the target on two columns (x1, x2) and a constant, from moments.
_TWO = """count(*) AS k, avg(x1) AS m1, avg(x2) AS m2, avg(z) AS mz, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, covar_pop(x1, z) AS s1, covar_pop(x2, z) AS s2, var_pop(z) AS sz"""
_SOLVED = "(s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS w1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS w2"


@query(f"""{WITH}, o AS (SELECT series_id, ds, t, n, y::DOUBLE AS z, lag(y::DOUBLE) OVER w AS x1, lag(y::DOUBLE, 2) OVER w AS x2 FROM bm WHERE n > 12 WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
g AS (SELECT series_id, {_TWO} FROM o WHERE t >= 2 AND t < n - 12 GROUP BY 1), s AS (SELECT *, {_SOLVED} FROM g)
SELECT series_id, ds, z AS y, round(mz - w1 * m1 - w2 * m2 + w1 * x1 + w2 * x2, 3) AS pred, k AS n_fit FROM o JOIN s USING (series_id) WHERE t >= n - 12""", "y")
def autoregression_fit(spark, d):
    """Two lags and a constant, learned from the training rows."""
    return least_squares.autoregression(brand_monthly(spark, d), 2, "c").select("series_id", "ds", "y", F.round("pred", 3).alias("pred"), "n_fit")


@query(f"""{WITH}, o AS (SELECT series_id, ds, t, n, y::DOUBLE AS z, lag(y::DOUBLE) OVER w AS x1, lag(y::DOUBLE, 2) OVER w AS x2 FROM bm WHERE n > 12 WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
g AS (SELECT a.series_id, a.ds, {_TWO.replace('count(*)', 'count(b.t)').replace('(x', '(b.x').replace(', x', ', b.x').replace('z)', 'b.z)')} FROM o a JOIN o b ON a.series_id = b.series_id AND b.t < a.t AND b.t >= 2 WHERE a.t >= a.n - 12 GROUP BY 1, 2), s AS (SELECT *, {_SOLVED} FROM g)
SELECT series_id, ds, z AS y, round(mz - w1 * m1 - w2 * m2 + w1 * x1 + w2 * x2, 3) AS pred, k AS n_fit FROM o JOIN s USING (series_id, ds)""", "y")
def autoregression_refit(spark, d):
    """The same learned again before each row, from running sums."""
    return least_squares.autoregression(brand_monthly(spark, d), 2, "c", refit=True).select("series_id", "ds", "y", F.round("pred", 3).alias("pred"), "n_fit")


@query()
def autoregression_seasonal(spark, d):
    """Twelve lags, constant, time and months; the test rows one by one (step 0), and twelve months ahead."""
    obs = brand_monthly(spark, d)
    one = least_squares.autoregression(obs, 12, "ct", 12).select("series_id", F.lit(0).alias("step"), "ds", "pred")
    return one.unionByName(least_squares.autoregression_ahead(obs, 12, 12, "ct", 12))


_NORMAL = "(1 / (1 + CAST(0.3275911 AS DOUBLE) * x))"
_BELOW = f"least({_NORMAL} * (CAST(0.254829592 AS DOUBLE) + {_NORMAL} * (CAST(-0.284496736 AS DOUBLE) + {_NORMAL} * (CAST(1.421413741 AS DOUBLE) + {_NORMAL} * (CAST(-1.453152027 AS DOUBLE) + {_NORMAL} * CAST(1.061405429 AS DOUBLE))))) * exp(-x * x), 1) / 2"


@query(f"""{WITH}, a AS (SELECT series_id, ds, t, n, y::DOUBLE AS y, lag(y::DOUBLE) OVER w AS x1 FROM bm WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
o AS (SELECT *, y - x1 AS z, lag(y - x1) OVER (PARTITION BY series_id ORDER BY ds) AS x2 FROM a WHERE n > 3),
g AS (SELECT series_id, {_TWO} FROM o WHERE t >= 2 GROUP BY 1), s AS (SELECT *, {_SOLVED} FROM g),
u AS (SELECT series_id, k, w1, w1 / sqrt((sz - w1 * s1 - w2 * s2) / (k - 3) * s22 / (s11 * s22 - s12 * s12)) AS t FROM s),
v AS (SELECT *, CASE WHEN t <= CAST(-1.61 AS DOUBLE) THEN CAST(2.1659 AS DOUBLE) + CAST(1.4412 AS DOUBLE) * t + CAST(0.038269 AS DOUBLE) * t * t ELSE CAST(1.7339 AS DOUBLE) + CAST(0.93202 AS DOUBLE) * t - CAST(0.12745 AS DOUBLE) * t * t - CAST(0.010368 AS DOUBLE) * t * t * t END AS zz FROM u),
x AS (SELECT *, abs(zz) / sqrt(2) AS x FROM v)
SELECT series_id, 1 AS lag, k AS n, round(w1, 5) AS slope, round(t, 4) AS t, round(CASE WHEN t < CAST(-18.83 AS DOUBLE) THEN 0 WHEN t > CAST(2.74 AS DOUBLE) THEN 1 WHEN zz < 0 THEN {_BELOW} ELSE 1 - {_BELOW} END, 4) AS p FROM x""")
def unit_root_lag(spark, d):
    u = least_squares.unit_root(brand_monthly(spark, d), 1)
    return u.select("series_id", "lag", "n", F.round("slope", 5).alias("slope"), F.round("t", 4).alias("t"), F.round("p", 4).alias("p"))


@query()
def unit_root_selected(spark, d):
    """The number of lags by the least criterion."""
    return least_squares.unit_root(brand_monthly(spark, d))


# --- several collections -----------------------------------------------------------

_COLLECTIONS = """WITH c0 AS (SELECT l_returnflag AS dataset, p_brand AS series_id, last_day(l_shipdate) AS ds, sum(l_quantity)::DOUBLE AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
c1 AS (SELECT *, row_number() OVER w - 1 AS t, count(*) OVER (PARTITION BY dataset, series_id) AS n, coalesce(lag(y) OVER w, y) AS naive, coalesce(lag(y, 12) OVER w, lag(y) OVER w, y) AS seasonal_naive,
  coalesce(avg(y) OVER (PARTITION BY dataset, series_id ORDER BY ds ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), y) AS rolling_mean FROM c0 WINDOW w AS (PARTITION BY dataset, series_id ORDER BY ds)),
c2 AS (UNPIVOT c1 ON naive, seasonal_naive, rolling_mean INTO NAME model VALUE pred),
rk AS (SELECT dataset, series_id, model, round(avg(abs(y - pred)), 6) AS mae FROM c2 WHERE n > 12 AND t >= n - 12 GROUP BY 1, 2, 3),
ra AS (SELECT *, rank() OVER (PARTITION BY dataset, series_id ORDER BY mae) + (count(*) OVER (PARTITION BY dataset, series_id, mae) - 1) / 2 AS rank FROM rk)"""


def collections_scored(spark, d):
    """Errors of three models on the brands' shipments, one collection for each return flag: the same ids in all."""
    items = table(spark, d, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_returnflag")
    j = items.join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    obs = numbered(j.groupBy(F.concat_ws("|", "l_returnflag", "p_brand").alias("series_id"), F.last_day("l_shipdate").alias("ds")).agg(F.sum("l_quantity").cast("double").alias("y")))
    f = forecasts.compared(splits.tail(obs, 12)).where("split = 'test'")
    e = f.groupBy("series_id", "model").agg(F.round(F.avg(F.abs(F.col("y") - F.col("pred"))), 6).alias("mae"))
    return e.select(F.substring_index("series_id", "|", 1).alias("dataset"), F.substring_index("series_id", "|", -1).alias("series_id"), "model", "mae")


@query(f"""{_COLLECTIONS}, m AS (SELECT dataset, model, sum(rank) AS r, count(*) AS n FROM ra GROUP BY 1, 2), ti AS (SELECT dataset, sum(t * t * t - t) AS ties FROM (SELECT dataset, count(*) AS t FROM rk GROUP BY dataset, series_id, mae) GROUP BY 1),
fr AS (SELECT dataset, max(n) AS n, count(*) AS k, sum(r * r) AS ss FROM m GROUP BY 1), st AS (SELECT dataset, n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS chi_square FROM fr JOIN ti USING (dataset))
SELECT dataset, n, k, chi_square, exp(-chi_square / 2) AS p, 'ok' AS status FROM st""", "chi_square p")
def friedman_by_dataset(spark, d):
    return statistics.friedman_result(collections_scored(spark, d), "mae", by=["dataset"])


@query(f"""{_COLLECTIONS}, pr AS (SELECT a.model AS a, b.model AS b, a.mae - b.mae AS d FROM rk a JOIN rk b ON a.dataset = b.dataset AND a.series_id = b.series_id AND a.model = 'naive' AND b.model <> 'naive'),
g AS (SELECT a, b, count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se FROM pr GROUP BY 1, 2), s AS (SELECT *, mean / nullif(se, 0) AS t, n - 1 AS df FROM g),
p AS (SELECT a, b, n, mean, round(CASE WHEN se > 0 THEN {_T_TAIL} WHEN abs(mean) <= 1e-8 THEN 1 ELSE 0 END, 9) AS p FROM s), st AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p, 1) AS step FROM p)
SELECT a, b, n, mean, p, max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS holm FROM st""", "mean p holm")
def baseline_pairs(spark, d):
    """Every model against the naive one over all collections, told apart by both keys."""
    return statistics.paired_t_test(collections_scored(spark, d), "mae", unit=("dataset", "series_id"), baseline="naive")


@query(f"""{_COLLECTIONS} SELECT dataset, model, avg(rank) AS average_rank, count(*) AS n_complete, 0::BIGINT AS failures, true AS included FROM ra GROUP BY 1, 2""", "average_rank")
def critical_by_dataset(spark, d):
    return statistics.critical_differences(collections_scored(spark, d), "mae", by=["dataset"])
