"""Least squares inside the plan: Gram matrices by aggregation or running windows, solved by a fold over the pivots.

The matrix of products (columns, then the target) is swept column by column:
each pivot's row is divided by it and taken from the others.  What is left of the
target's own product after each pivot is the residual sum of squares of the
regression on the columns so far, so one sweep gives all nested regressions.  A
column that the ones before it explain (its pivot falls below ``TINY`` of its own
product) is left out: weight 0.  No Python worker takes part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import splits, tails
from tidemark.operators.windows import RUNNING
from tidemark.plans.substrate import along

TINY = 1e-11


def products(columns: Sequence[Column], total) -> Column:
    """The symmetric matrix of ``total`` (a sum, or a running one) over products of each two columns, as an array of rows."""
    k = len(columns)
    cell = {(i, j): total(columns[i] * columns[j]) for i in range(k) for j in range(i, k)}
    return F.array(*[F.array(*[cell[min(i, j), max(i, j)] for j in range(k)]) for i in range(k)])


def swept(matrix: Column, k: int, inverse: bool = False) -> Column:
    """struct(weights, rss, nested, inverse): of the first k columns' matrix with the target's products as column k + 1.

    nested: residual sum of squares after each column.  inverse (if asked for): the
    diagonal of the inverse of the columns' matrix, 0 for columns left out.
    """
    rows = F.transform(matrix, lambda r, i: F.concat(r, F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.when(i == j, 1.0).otherwise(0.0)))) if inverse else matrix
    start = F.struct(rows.alias("m"), F.array().cast("array<double>").alias("nested"))

    def step(s: Column, p: Column) -> Column:
        row = F.get(s["m"], p)
        own, first = F.get(row, p), F.get(F.get(matrix, p), p)
        fine = own > TINY * first
        unit = F.transform(row, lambda x: F.when(fine, x / F.when(fine, own)).otherwise(0.0))
        m = F.transform(s["m"], lambda r, i: F.when(i == p, unit).otherwise(F.zip_with(r, unit, lambda x, u: x - F.get(r, p) * u)))
        return F.struct(m.alias("m"), F.concat(s["nested"], F.array(F.greatest(F.get(F.get(m, F.lit(k)), F.lit(k)), F.lit(0.0)))).alias("nested"))

    def read(s: Column) -> Column:
        weights = F.transform(F.slice(s["m"], 1, k), lambda r: F.get(r, F.lit(k)))
        diagonal = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(F.get(s["m"], i), i + k + 1)) if inverse else F.array().cast("array<double>")
        return F.struct(weights.alias("weights"), F.element_at(s["nested"], -1).alias("rss"), s["nested"].alias("nested"), diagonal.alias("inverse"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step, read)


def regressions(rows: DataFrame, by: Sequence[str], columns: Sequence[Column], target: Column, keep: Column | None = None, inverse: bool = False) -> DataFrame:
    """(by, n, fit) of the regression of the target on the columns, of rows that ``keep`` allows; by one aggregation."""
    ok = F.lit(True) if keep is None else keep
    named = rows.where(ok).select(*by, *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], target.cast("double").alias(f"_x{len(columns)}"))
    cols = [F.col(f"_x{i}") for i in range(len(columns) + 1)]
    g = named.groupBy(*by).agg(F.count("*").alias("n"), products(cols, F.sum).alias("m"))
    return g.select(*by, "n", swept(F.col("m"), len(columns), inverse).alias("fit"))


def dot(weights: Column, columns: Sequence[Column]) -> Column:
    return F.aggregate(F.zip_with(weights, F.array(*[c.cast("double") for c in columns]), lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)


TRENDS = ("n", "c", "t", "ct")


def _designed(obs: DataFrame, lags: int, trend: str, period: int | None, size: Column) -> tuple[DataFrame, list[Column], Column]:
    """Rows with lag columns, the regression's columns, and which rows have all their lags.

    ``size``: rows that are learned from; a series takes at most a third of them as
    lags, and seasons only if it has more than lags + period + 2.
    """
    if trend not in TRENDS:
        raise ValueError(f"unknown trend: {trend}")
    o = obs.withColumn("_k", F.least(F.lit(lags), F.greatest(F.floor(size / 3), F.lit(1))).cast("int")).withColumn("_season", size > F.lit(lags + (period or 0) + 2))
    for i in range(1, lags + 1):
        o = o.withColumn(f"_lag{i}", F.when(F.col("_k") >= i, F.lag("y", i).over(along())).otherwise(0.0))
    columns = [F.lit(1.0)] if "c" in trend else []
    columns += [(F.col("t") + 1) / F.col("n")] if "t" in trend else []
    if period:
        columns += [F.when(F.col("_season") & (F.pmod(F.col("t"), F.lit(period)) == s), 1.0).otherwise(0.0) for s in range(1 if "c" in trend else 0, period)]
    columns += [F.col(f"_lag{i}") for i in range(1, lags + 1)]
    return o, columns, F.col("t") >= F.col("_k")


def autoregression(obs: DataFrame, lags: int = 3, trend: str = "c", period: int | None = None, horizon: int = 12, refit: bool = False) -> DataFrame:
    """One-step forecasts of the last ``horizon`` rows from a regression on the values before: series_id, ds, y, pred, n_fit, rss.

    trend: n (none), c (constant), t (time) or ct (both); ``period`` adds seasonal
    terms.  The weights are those of the training rows; with ``refit``, of all rows
    before each, by running sums.  The last value is the forecast of a series
    with fewer rows to learn from than columns, and two.
    """
    o, columns, full = _designed(splits.tail(obs, horizon), lags, trend, period, F.col("n") - horizon)
    last = F.lag("y").over(along())
    k = len(columns)
    need = F.col("n_fit") >= F.col("_k") + (1 if "c" in trend else 0) + (1 if "t" in trend else 0) + 2
    if refit:
        past = along().rowsBetween(RUNNING, -1)
        for i, c in enumerate([*columns, F.col("y")]):
            o = o.withColumn(f"_x{i}", F.when(full, c.cast("double")).otherwise(0.0))
        cols = [F.col(f"_x{i}") for i in range(k + 1)]
        o = o.withColumn("_last", last).withColumn("n_fit", F.sum(full.cast("long")).over(past)).withColumn("_m", products(cols, lambda c: F.sum(c).over(past))).where("split = 'test'")
        o = o.withColumn("fit", F.when(need, swept(F.col("_m"), k)))
    else:
        fits = regressions(o.where("split = 'train'"), ["series_id"], columns, F.col("y"), full).withColumnRenamed("n", "n_fit")
        o = o.withColumn("_last", last).where("split = 'test'").join(fits, "series_id", "left").withColumn("fit", F.when(need, F.col("fit")))
    pred = F.coalesce(dot(F.col("fit.weights"), columns), F.col("_last"))
    return o.select("series_id", "ds", "y", pred.alias("pred"), F.coalesce("n_fit", F.lit(0)).alias("n_fit"), F.col("fit.rss").alias("rss"))


def autoregression_ahead(obs: DataFrame, steps: int = 12, lags: int = 3, trend: str = "c", period: int | None = None) -> DataFrame:
    """Forecasts of the ``steps`` months after each series' last row, each taken in by those after it: series_id, step, ds, pred."""
    o, columns, full = _designed(obs, lags, trend, period, F.col("n"))
    fits = regressions(o, ["series_id"], columns, F.col("y"), full).withColumnRenamed("n", "n_fit")
    ends = obs.where(F.col("t") >= F.col("n") - lags).groupBy("series_id").agg(F.max("ds").alias("end"), F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"].cast("double")).alias("v"))
    g = ends.join(fits, "series_id").withColumn("_k", F.least(F.lit(lags), F.greatest(F.floor(F.col("n") / 3), F.lit(1))).cast("int")).withColumn("_season", F.col("n") > lags + (period or 0) + 2)
    w = F.col("fit.weights")

    def next_value(v: Column, step: Column) -> Column:
        t = F.col("n") + step - 1
        own = ([F.lit(1.0)] if "c" in trend else []) + ([(t + 1) / F.col("n")] if "t" in trend else [])
        own += [F.when(F.col("_season") & (F.pmod(t, F.lit(period)) == s), 1.0).otherwise(0.0) for s in range(1 if "c" in trend else 0, period)] if period else []
        own += [F.when(F.col("_k") >= i, F.coalesce(F.get(v, F.size(v) - i), F.lit(0.0))).otherwise(0.0) for i in range(1, lags + 1)]
        need = F.col("n_fit") >= F.col("_k") + (1 if "c" in trend else 0) + (1 if "t" in trend else 0) + 2
        return F.when(need, dot(w, own)).otherwise(F.element_at(v, -1))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("v"), lambda v, s: F.concat(v, F.array(next_value(v, s))))
    e = g.select("series_id", "end", F.posexplode(F.slice(path, F.size("v") + 1, F.lit(steps))).alias("at", "pred"))
    return e.select("series_id", (F.col("at") + 1).alias("step"), F.last_day(F.add_months("end", F.col("at") + 1)).alias("ds"), "pred")


def _changes(obs: DataFrame, most: int) -> tuple[DataFrame, list[Column]]:
    """Rows with the change, the value before, and up to ``most`` earlier changes; the regression's columns: constant, value, changes."""
    o = obs.select("series_id", "ds", "t", "n", "y").withColumn("_before", F.lag("y").over(along())).withColumn("_d", F.col("y") - F.col("_before"))
    for i in range(1, most + 1):
        o = o.withColumn(f"_d{i}", F.lag("_d", i).over(along()))
    return o, [F.lit(1.0), F.col("_before"), *[F.col(f"_d{i}") for i in range(1, most + 1)]]


def _unit_root_fit(o: DataFrame, columns: list[Column], lag: Column) -> DataFrame:
    """series_id, n, slope, t of the regression with ``lag`` changes, on all rows that have them."""
    own = [*columns[:2], *[F.when(lag >= i, c).otherwise(0.0) for i, c in enumerate(columns[2:], 1)]]
    g = regressions(o.withColumn("_lag", lag), ["series_id", "_lag"], own, F.col("_d"), F.col("t") > lag, inverse=True)
    se = F.sqrt(F.col("fit.rss") / F.nullif(F.col("n") - 2 - F.col("_lag"), F.lit(0)) * F.get("fit.inverse", F.lit(1)))
    slope = F.get("fit.weights", F.lit(1))
    return g.select("series_id", F.col("_lag").cast("int").alias("lag"), "n", slope.alias("slope"), F.when(F.col("n") > 2 + F.col("_lag"), slope / F.nullif(se, F.lit(0.0))).alias("t"))


#: Response surface of the unit-root t with a constant: where it changes form, its ends, and both polynomials of the normal score.
SURFACE = {"turn": -1.61, "low": -18.83, "high": 2.74, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)}


def unit_root_p(t: Column) -> Column:
    """p of the unit-root t with a constant, from the published response surface."""
    poly = lambda c: sum((F.lit(a) * F.pow(t, F.lit(i)) for i, a in enumerate(c)), F.lit(0.0))
    z = F.when(t <= SURFACE["turn"], poly(SURFACE["small"])).otherwise(poly(SURFACE["large"]))
    below = F.when(z < 0, tails.normal(z) / 2).otherwise(1 - tails.normal(z) / 2)
    return F.when(t.isNotNull(), F.when(t < SURFACE["low"], 0.0).when(t > SURFACE["high"], 1.0).otherwise(below))


def unit_root(obs: DataFrame, lag: int | None = None, most: int = 15) -> DataFrame:
    """The unit-root regression of each series with a constant: series_id, lag, n, slope, t, p.

    Changes are regressed on the value before and ``lag`` earlier changes.  Without
    ``lag``, the number between 0 and 12 (n / 100) ** (1 / 4), rounded up (held to
    ``most`` and n / 2 - 2), of the least Akaike criterion, all judged on the same
    rows by one sweep; the regression is then made again on all rows that have that
    many.  Series with too few rows, or without any change, have a null t.
    """
    if lag is not None:
        o, columns = _changes(obs, lag)
        found = _unit_root_fit(o.where(F.col("n") > lag + 2), columns, F.lit(lag))
        return found.withColumn("p", unit_root_p(F.col("t")))
    o, columns = _changes(obs, most)
    limit = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2, F.lit(most)).cast("int")
    o = o.withColumn("_most", limit).where("_most >= 0")
    own = [*columns[:2], *[F.when(F.col("_most") >= i, c).otherwise(0.0) for i, c in enumerate(columns[2:], 1)]]
    g = regressions(o, ["series_id", "_most"], own, F.col("_d"), F.col("t") > F.col("_most"))
    score = lambda i: F.col("n") * F.log(F.greatest(F.get("fit.nested", i + 1), F.lit(1e-300)) / F.col("n")) + 2 * (i + 2)
    scores = F.transform(F.sequence(F.lit(0), F.col("_most")), lambda i: F.struct(F.round(score(i), 9).alias("aic"), i.alias("lag")))
    chosen = g.select("series_id", F.array_min(scores)["lag"].alias("_own"))
    return _unit_root_fit(o.join(chosen, "series_id"), columns, F.col("_own")).withColumn("p", unit_root_p(F.col("t")))
