"""Queries over tests with their tail probabilities and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statistics
from tidemark.plans.model_queries import _FC, _PAIRS, _R, compared, scored
from tidemark.plans.registry import query

#: Student's two-sided tail by Simpson's rule over the angle, 2000 intervals: independent of the finite series.
_T_TAIL = """greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * (atan(abs(t) / sqrt(df)) / 2000) / 3
 * list_sum([(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(atan(abs(t) / sqrt(df)) * i / 2000), df - 1) FOR i IN range(0, 2001)]))"""


@query(f"{_R}, m AS (SELECT model, sum(rank) AS r, count(*) AS n FROM ra GROUP BY 1), ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT count(*) AS t FROM rk GROUP BY series_id, mae)), fr AS (SELECT max(n) AS n, count(*) AS k, sum(r * r) AS ss FROM m), st AS (SELECT n, k, (12 / (n * k * (k + 1)) * ss - 3 * n * (k + 1)) / (1 - ties / (n * (k * k * k - k))) AS chi_square FROM fr, ti) SELECT n, k, chi_square, exp(-chi_square / 2) AS p FROM st", "chi_square p")
def friedman_p(spark, d):
    """Three models, so two degrees of freedom."""
    return statistics.friedman_test(scored(spark, d), "mae")


@query(f"""{_PAIRS}, g AS (SELECT a, b, count(*) AS n, avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS se FROM pr GROUP BY 1, 2), s AS (SELECT *, mean / nullif(se, 0) AS t, n - 1 AS df FROM g),
p AS (SELECT a, b, n, mean, round(CASE WHEN se > 0 THEN {_T_TAIL} WHEN abs(mean) <= 1e-8 THEN 1 ELSE 0 END, 9) AS p FROM s), st AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, a, b) + 1) * p, 1) AS step FROM p)
SELECT a, b, n, mean, p, max(step) OVER (ORDER BY p, a, b ROWS UNBOUNDED PRECEDING) AS holm FROM st""", "mean p holm")
def paired_t_holm(spark, d):
    return statistics.paired_t_test(scored(spark, d), "mae")


@query(f"""{_FC}, q AS (SELECT series_id, ds, max(CASE WHEN model = 'naive' THEN (y - pred) * (y - pred) END) - max(CASE WHEN model = 'rolling_mean' THEN (y - pred) * (y - pred) END) AS d FROM fm WHERE split = 'test' GROUP BY 1, 2), g AS (SELECT series_id, count(d) AS n, avg(d) AS m, var_samp(d) AS v FROM q GROUP BY 1),
s AS (SELECT series_id, n, n - 1 AS df, CASE WHEN n >= 8 THEN CASE WHEN v <= 1e-12 THEN 0 ELSE m / sqrt(v / n) * sqrt((n - 1) / n) END END AS t FROM g)
SELECT series_id, n, t AS statistic, CASE WHEN n >= 8 THEN CASE WHEN t = 0 THEN 1 ELSE {_T_TAIL} END END AS p, CASE WHEN n < 24 THEN 'low_power' ELSE 'ok' END AS status FROM s""", "statistic p")
def diebold_mariano_p(spark, d):
    return statistics.diebold_mariano_test(compared(spark, d).where("split = 'test'"), "naive", "rolling_mean")


@query(f"""{_R}, pr AS (SELECT r.model, r.mae AS v, f.mae AS base, r.mae - f.mae AS d FROM rk r JOIN rk f ON r.series_id = f.series_id AND f.model = 'rolling_mean' AND r.model <> 'rolling_mean'),
sg AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY model, abs(d)) AS k FROM pr WHERE d <> 0),
sm AS (SELECT model, count(*) AS m, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS w, sum(k * k - 1) AS ties FROM sg GROUP BY 1),
al AS (SELECT p.model, count(*) AS n_pairs, avg(base) AS full_mean, avg(v) AS mean, avg(d) AS mean_delta, any_value(coalesce(m, 0)) AS m, any_value(coalesce(w, 0)) AS w, any_value(coalesce(ties, 0)) AS ties FROM pr p LEFT JOIN sm USING (model) GROUP BY 1),
dp AS (SELECT model, 0 AS i, list_prepend(1::DOUBLE, [0::DOUBLE FOR _ IN range(0, floor(w)::BIGINT)]) AS a FROM al WHERE m > 0
 UNION ALL SELECT dp.model, i + 1, [a[s + 1] + CASE WHEN s >= i + 1 THEN a[s - i] ELSE 0 END FOR s IN range(0, len(a))] FROM dp JOIN al USING (model) WHERE i < m),
ex AS (SELECT dp.model, least(1, 2 * list_sum(a) / pow(2, m)) AS p FROM dp JOIN al USING (model) WHERE i = m),
zz AS (SELECT *, abs((w - m * (m + 1) / 4) / nullif(sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 0)) / sqrt(2) AS x FROM al),
nn AS (SELECT model, 1 / (1 + CAST(0.3275911 AS DOUBLE) * x) AS u, x FROM zz),
no AS (SELECT model, least((u * (CAST(0.254829592 AS DOUBLE) + u * (CAST(-0.284496736 AS DOUBLE) + u * (CAST(1.421413741 AS DOUBLE) + u * (CAST(-1.453152027 AS DOUBLE) + u * CAST(1.061405429 AS DOUBLE)))))) * exp(-x * x), 1) AS p FROM nn),
pp AS (SELECT al.model, n_pairs, full_mean, mean, mean_delta, w::DOUBLE AS w, round(CASE WHEN m = 0 THEN 1 WHEN m = n_pairs AND ties = 0 AND m <= 50 THEN ex.p ELSE no.p END, 9) AS p FROM al LEFT JOIN ex USING (model) LEFT JOIN no USING (model)),
st AS (SELECT *, least((count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p, 1) AS step FROM pp)
SELECT model, n_pairs, full_mean, mean, mean_delta, w, p, max(step) OVER (ORDER BY p, model ROWS UNBOUNDED PRECEDING) AS holm FROM st""", "full_mean mean mean_delta w p holm")
def signed_rank_holm(spark, d):
    """Every model against the rolling mean."""
    return statistics.signed_rank_test(scored(spark, d), "mae", "rolling_mean")


_POISSON, _below, _p = "0", 0.0, 2.718281828459045**-1
for _k in range(1, 9):
    _below += _p
    _POISSON = f"CASE WHEN u >= CAST({_below!r} AS DOUBLE) THEN {_k} ELSE {_POISSON} END"
    _p /= _k


def _draws(rows: str, by: str, unit: str, value: str, statistic: str) -> str:
    """CTEs ending in ci (by, low, high): 1000 draws of the statistic of v weighted by w."""
    uniform = f"('0x' || substr(md5('42:' || {unit} || ':' || (draw // 4)::VARCHAR), (draw % 4 * 8 + 1)::INTEGER, 8))::BIGINT / CAST(4294967296 AS DOUBLE)"
    return f"""dr AS (SELECT {by}, {value} AS v, {uniform} AS u, draw FROM (SELECT *, unnest(range(0, 1000)) AS draw FROM {rows} WHERE {value} IS NOT NULL)),
dw AS (SELECT {by}, draw, v, {_POISSON} AS w FROM dr), dm AS (SELECT {by}, draw, {statistic} AS m FROM dw GROUP BY ALL),
ci AS (SELECT {by}, quantile_cont(m, CAST(0.025 AS DOUBLE)) AS low, quantile_cont(m, CAST(0.975 AS DOUBLE)) AS high FROM dm GROUP BY ALL)"""


_MEAN = "sum(w * v) / nullif(sum(w), 0)"


@query(f"{_R}, {_draws('rk', 'model', 'series_id', 'mae', _MEAN)} SELECT model, low, high FROM ci", "low high")
def bootstrap_interval(spark, d):
    return statistics.bootstrap(scored(spark, d), ["model"], "mae", "series_id")


@query(f"{_R}, {_draws('rk', 'model', 'series_id', 'mae', 'max(CASE WHEN w > 0 THEN v END)')} SELECT model, low, high FROM ci", "low high")
def bootstrap_callable(spark, d):
    """A user's statistic: here the largest error among the series drawn."""
    return statistics.bootstrap(scored(spark, d), ["model"], "mae", "series_id", lambda v, w: F.max(F.when(w > 0, v)))


@query(f"{_PAIRS}, {_draws('pr', 'a, b', 'series_id', 'd', _MEAN)}, g AS (SELECT a, b, count(*) AS n, avg(d) AS mean FROM pr GROUP BY 1, 2) SELECT a, b, n, mean, low, high FROM g JOIN ci USING (a, b)", "mean low high")
def paired_bootstrap(spark, d):
    return statistics.paired_bootstrap(scored(spark, d), "mae")


@query(f"{_R}, k AS (SELECT series_id FROM rk WHERE mae IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM rk)), g AS (SELECT model, avg(rank) AS average_rank, count(*) AS n_complete FROM ra JOIN k USING (series_id) GROUP BY 1), f AS (SELECT model, count(*) - count(mae) AS failures FROM rk GROUP BY 1) SELECT model, average_rank, n_complete, failures, n_complete > 0 AS included FROM f JOIN g USING (model)", "average_rank")
def critical_differences(spark, d):
    return statistics.critical_differences(scored(spark, d), "mae")


@query(f"""{_R}, {_draws('rk', 'model', 'series_id', 'mae', _MEAN)}, g AS (SELECT model, count(mae) AS successful, count(*) - count(mae) AS failures, avg(mae) AS mean, quantile_cont(mae, 0.5) AS median, coalesce(stddev_samp(mae), 0) AS std, quantile_cont(mae, 0.75) - quantile_cont(mae, 0.25) AS iqr FROM rk GROUP BY 1), k AS (SELECT model, avg(rank) AS average_rank FROM ra GROUP BY 1)
SELECT model, successful, failures, mean, median, std, iqr, low AS ci95_low, high AS ci95_high, average_rank FROM g JOIN ci USING (model) JOIN k USING (model)""", "mean median std iqr ci95_low ci95_high average_rank")
def ranked_summary(spark, d):
    return statistics.ranked_summary(scored(spark, d), "mae")
