"""Queries over seasons, and over gaps and failures that the tables have by themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import diagnostics, experiments, models, results, seasonal, splits, statistics, suite, tails
from tidemark.plans.ahead_queries import _BELOW
from tidemark.plans.frame_queries import _CUSTOMERS, _customers
from tidemark.plans.model_queries import _FC, compared
from tidemark.plans.more_queries import _SES
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, brand_monthly, table
from tidemark.sources import series as S

_ADJUSTED = f"""WITH RECURSIVE {BRAND_SQL}, ob AS (SELECT series_id, ds, t, n, y::DOUBLE AS y, CASE WHEN t >= n - 12 THEN 'test' ELSE 'train' END AS split FROM bm WHERE n > 12),
tr AS (SELECT series_id, list(y ORDER BY t) AS v FROM ob WHERE split = 'train' GROUP BY 1), dv AS (SELECT *, [x - list_avg(v) FOR x IN v] AS d FROM tr),
ac AS (SELECT *, [list_sum([d[i] * d[i + k] FOR i IN range(1, len(d) - k + 1)]) FOR k IN range(0, 13)] AS c FROM dv),
te AS (SELECT series_id, len(v) AS k, len(v) >= 24 AND len(v) * c[13] * c[13] / list_sum([x * x FOR x IN c[1:12]]) > CAST({seasonal.POINT} AS DOUBLE) AS seasonal, list_min(v) > 0 AS mult FROM ac),
ma AS (SELECT ob.*, mult, k, (avg(y) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) + avg(y) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 AS c FROM ob JOIN te USING (series_id) WHERE seasonal AND split = 'train' WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
ra AS (SELECT series_id, t % 12 AS phase, mult, avg(CASE WHEN mult THEN y / c ELSE y - c END) AS raw FROM ma WHERE t >= 6 AND t < k - 6 GROUP BY 1, 2, 3),
ix AS (SELECT series_id, phase, mult, CASE WHEN mult THEN raw / avg(raw) OVER (PARTITION BY series_id) ELSE raw - avg(raw) OVER (PARTITION BY series_id) END AS ind FROM ra)"""


@query(f"{_ADJUSTED} SELECT series_id, phase, mult AS multiplicative, ind AS index FROM ix", "index")
def season_indices(spark, d):
    """Indices of the series in which a season is found."""
    return seasonal.indices(splits.tail(brand_monthly(spark, d), 12))


@query(f"""{_ADJUSTED}, fc AS (SELECT series_id, ds, t, n, split, mult, ind, CASE WHEN ind IS NULL THEN y WHEN mult THEN y / ind ELSE y - ind END AS y FROM ob LEFT JOIN (SELECT * FROM ix) x ON ob.series_id = x.series_id AND ob.t % 12 = x.phase),
ls{_SES.split(', ls', 1)[1].replace('f.split, l.weight', 'f.split, f.mult, f.ind, l.weight')}, sl AS (SELECT *, CASE WHEN count(y) OVER p >= 3 THEN regr_slope(y, t::DOUBLE) OVER p ELSE 0 END AS slope FROM sm WINDOW p AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT *, pred + slope / 2 * ((1 - pow(1 - weight, t)) / weight) AS p FROM sl)
SELECT series_id, ds, split, ind IS NOT NULL AS seasonal, weight, CASE WHEN ind IS NULL THEN p WHEN mult THEN p * ind ELSE p + ind END AS pred FROM th""".replace("SELECT series_id, ds, t, n, split, mult", "SELECT ob.series_id, ds, t, n, split, mult"), "weight pred")
def theta_seasonal(spark, d):
    """Theta lines of the values without their season, where one is found."""
    return seasonal.theta(splits.tail(brand_monthly(spark, d), 12))


@query()
def robust_strengths(spark, d):
    """Strengths of trend and season by robust local lines."""
    return seasonal.robust_strengths(brand_monthly(spark, d))


@query("""WITH x AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), g AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS nxt FROM x)
SELECT user_id, day AS after, nxt AS before, (nxt - day - 1)::INTEGER AS missing FROM g WHERE nxt - day > 1""")
def user_day_gaps(spark, d):
    """Days without events of each user, over all events."""
    days = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("after")).distinct()
    g = days.withColumn("before", F.lead("after").over(Window.partitionBy("user_id").orderBy("after")))
    return g.where(F.datediff("before", "after") > 1).select("user_id", "after", "before", (F.datediff("before", "after") - 1).alias("missing"))


@query(f"""{_CUSTOMERS}, g AS (SELECT series_id, ds, lead(ds) OVER (PARTITION BY series_id ORDER BY ds) AS nxt FROM cm)
SELECT series_id, ds AS after, nxt AS before, (date_diff('month', ds, nxt) - 1)::INTEGER AS missing FROM g WHERE date_diff('month', ds, nxt) > 1""")
def customer_month_gaps(spark, d):
    """Months in which a customer that ordered before and after has no order, over all orders."""
    return S.gaps(_customers(spark, d))


def _mean_of(least):
    def predict(y):
        if len(y) < least:
            raise ValueError(f"{len(y)} values are too few")
        return y.mean()

    return predict


_COHORT = {"mean_of_1": 1, "mean_of_8": 8, "mean_of_12": 12}
_FAILURES = f"{_CUSTOMERS}, " + "ho AS (" + " UNION ALL ".join(f"SELECT series_id, '{m}' AS model, CASE WHEN any_value(n) - 2 >= {k} THEN round(avg(abs(y - pred)), 6) END AS mae FROM fo WHERE t >= n - 2 GROUP BY 1" for m, k in _COHORT.items()) + ")"


def failures(spark, d):
    """Errors of three models on the customers' months, in one pass: each needs more values than the one before, and fails on shorter series."""
    rows = models.custom(_customers(spark, d), {name: _mean_of(least) for name, least in _COHORT.items()}, 2)
    return rows.groupBy("series_id", "model").agg(F.round(F.avg(F.abs(F.col("y") - F.col("pred"))), 6).alias("mae"))


@query(f"{_FAILURES} SELECT model, count(*) AS n_expected, count(mae) AS n_success, count(*) - count(mae) AS n_failed, count(*) = count(mae) AS complete, avg(mae) AS mean FROM ho GROUP BY 1", "mean")
def failure_summary(spark, d):
    n, ok = F.count("*"), F.count("mae")
    return failures(spark, d).groupBy("model").agg(n.alias("n_expected"), ok.alias("n_success"), (n - ok).alias("n_failed"), (n == ok).alias("complete"), F.avg("mae").alias("mean"))


@query(f"{_FAILURES} SELECT series_id FROM ho WHERE mae IS NOT NULL GROUP BY 1 HAVING count(DISTINCT model) = (SELECT count(DISTINCT model) FROM ho)")
def failure_common(spark, d):
    """Series on which no model fails."""
    return statistics.common_series(failures(spark, d), "mae")


@query(f"{_FAILURES} SELECT series_id, model FROM ho WHERE mae IS NULL")
def failure_cells(spark, d):
    """Series and models of the full grid that have no value."""
    have = failures(spark, d).groupBy("series_id").agg(F.collect_set(F.when(F.col("mae").isNotNull(), F.col("model"))).alias("have"))
    return have.select("series_id", F.explode(F.array_except(F.array(*[F.lit(m) for m in _COHORT]), "have")).alias("model"))


def _poly(coefficients, x):
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def _quantile(p):
    """The normal quantile of an expression, in SQL."""
    r = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    side = f"(CASE WHEN {p} < 0.5 THEN 1 ELSE -1 END) * {_poly(tails.QUANTILE['tail'][0], r)} / {_poly(tails.QUANTILE['tail'][1], r)}"
    q = f"({p} - 0.5)"
    middle = f"{_poly(tails.QUANTILE['middle'][0], f'({q} * {q})')} * {q} / {_poly(tails.QUANTILE['middle'][1], f'({q} * {q})')}"
    return f"(CASE WHEN least({p}, 1 - {p}) < CAST({tails.QUANTILE['end']} AS DOUBLE) THEN {side} ELSE {middle} END)"


@query(f"""{_FC}, e AS (SELECT series_id, model, y::DOUBLE - pred AS x FROM fm), o AS (SELECT *, row_number() OVER (w ORDER BY x) AS i, (count(*) OVER w)::DOUBLE AS n, x - avg(x) OVER w AS c FROM e WINDOW w AS (PARTITION BY series_id, model)),
p AS (SELECT *, (i - CAST(0.375 AS DOUBLE)) / (n + CAST(0.25 AS DOUBLE)) AS u FROM o), q AS (SELECT *, {_quantile('u')} AS m FROM p),
g AS (SELECT series_id, model, n, 1 / sqrt(n) AS u, sum(m * m) AS mm, sum(m * c) AS mx, sum(c * c) AS ss, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2, max(c) - min(c) AS d1, max(CASE WHEN i = n - 1 THEN c END) - max(CASE WHEN i = 2 THEN c END) AS d2 FROM q GROUP BY 1, 2, 3),
a AS (SELECT *, {_poly(diagnostics.ORDERED['last'], 'u')} + m1 / sqrt(mm) AS a1, {_poly(diagnostics.ORDERED['next'], 'u')} + m2 / sqrt(mm) AS a2 FROM g),
s AS (SELECT series_id, model, n, pow(a1 * d1 + a2 * d2 + (mx - m1 * d1 - m2 * d2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / ss AS w FROM a),
z AS (SELECT *, (ln(1 - w) - {_poly(diagnostics.ORDERED['mean'], 'ln(n)')}) / exp({_poly(diagnostics.ORDERED['spread'], 'ln(n)')}) AS zz FROM s), x AS (SELECT *, abs(zz) / sqrt(2) AS x FROM z)
SELECT series_id, model, n::BIGINT AS n, w, round(CASE WHEN zz > 0 THEN {_BELOW} ELSE 1 - {_BELOW} END, 4) AS w_p FROM x""", "w")
def residual_normality(spark, d):
    """Each model's residuals on each series, by their order."""
    rows = compared(spark, d).withColumn("e", F.col("y") - F.col("pred"))
    g = diagnostics.normality(rows, ["series_id", "model"], "e")
    return g.select("series_id", "model", "n", "w", F.round("w_p", 4).alias("w_p"))


@query(f"""WITH {BRAND_SQL}, h AS (SELECT series_id, n, sha256(string_agg(ds::VARCHAR || '|' || y::DECIMAL(38, 6)::VARCHAR, ';' ORDER BY ds::VARCHAR || '|' || y::DECIMAL(38, 6)::VARCHAR)) AS data_hash FROM bm GROUP BY 1, 2),
e AS (SELECT series_id, count(*)::INTEGER AS n_train, min(ds) AS train_start, max(ds) AS train_end FROM bm WHERE t < n - 12 GROUP BY 1),
b AS (SELECT series_id, n_train AS k, least(greatest(round_even(n_train * CAST(0.7 AS DOUBLE), 0), 11), n_train - 6) AS r FROM e WHERE n_train >= 17), c AS (SELECT *, least(greatest(r + round_even(k * CAST(0.2 AS DOUBLE), 0), r + 3), k - 3) AS a FROM b)
SELECT h.series_id, data_hash, n_train, train_start, train_end, r::INTEGER AS n_readout, (a - r)::INTEGER AS n_adapter_calibration, (k - a)::INTEGER AS n_conformal_calibration FROM h LEFT JOIN e USING (series_id) LEFT JOIN c USING (series_id)""")
def provenance(spark, d):
    return results.provenance(brand_monthly(spark, d))


@query()
def baseline_trials(spark, d):
    """Errors of drawn settings of the plain regressions: each trial, each series."""
    obs, out = brand_monthly(spark, d), None
    for kind in ("window", "autoregression"):
        settings = {f"{kind}{i}": experiments.drawn(kind, i) for i in range(4)}
        rows = experiments.family_trials(obs, kind, settings)
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def model_suite(spark, d):
    """Errors of every model by its name and usual settings."""
    rows = suite.forecast(brand_monthly(spark, d), list(suite.RUNNERS))
    return rows.groupBy("model", "series_id").agg(F.count("*").alias("n_points"), F.avg(F.abs(F.col("y") - F.col("pred"))).alias("mae"))
