"""Seasons of series: a test, classical indices, and seasonal-trend decomposition by robust local lines.

Indices and the test are windows and aggregates.  The decomposition is one row a
series: its columns are arrays, a local line at each place is a fold over the
nearest values, and the rounds of trend, season and weights are a fold over
their numbers, so all series are decomposed side by side without a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import smoothing
from tidemark.plans.substrate import along

#: Fixed value: the 90 per cent point of the chi-square distribution with one degree of freedom.
POINT = 2.705543454095404


def tested(obs: DataFrame, m: int = 12) -> DataFrame:
    """series_id, k (training rows), seasonal, multiplicative: of the training rows of (series_id, t, y, split).

    A series is seasonal if it has two seasons, and its correlation at lag m is
    large against those below it; multiplicative if all its values are above 0.
    """
    g = obs.where("split = 'train'").groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"].cast("double")).alias("v"))
    g = g.withColumn("k", F.size("v")).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("k")).withColumn("d", F.transform("v", lambda x: x - F.col("mean")))
    product = lambda k: F.aggregate(F.zip_with(F.slice("d", 1, F.greatest(F.col("k") - k, F.lit(0))), F.slice("d", k + 1, F.greatest(F.col("k") - k, F.lit(0))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    g = g.withColumn("c", F.transform(F.sequence(F.lit(0), F.lit(m)), lambda k: F.when(k < F.col("k"), product(k)).otherwise(0.0)))
    below = F.aggregate(F.slice("c", 1, m), F.lit(0.0), lambda s, x: s + x * x)
    statistic = F.col("k") * F.pow(F.element_at("c", m + 1), F.lit(2)) / F.nullif(below, F.lit(0.0))
    return g.select("series_id", "k", F.coalesce((F.col("k") >= 2 * m) & (statistic > POINT), F.lit(False)).alias("seasonal"), (F.array_min("v") > 0).alias("multiplicative"))


def indices(obs: DataFrame, m: int = 12) -> DataFrame:
    """series_id, phase (t mod m), multiplicative, index of the series that ``tested`` finds seasonal: what a centred mean over m leaves of the training rows, averaged by phase, with mean 1 (or 0)."""
    h = m // 2
    train = obs.where("split = 'train'").join(tested(obs, m).where("seasonal"), "series_id")
    if m % 2:
        centred = F.avg("y").over(along().rowsBetween(-h, h))
    else:
        centred = (F.avg("y").over(along().rowsBetween(-h, h - 1)) + F.avg("y").over(along().rowsBetween(1 - h, h))) / 2
    o = train.withColumn("_c", centred).where((F.col("t") >= h) & (F.col("t") < F.col("k") - h))
    left = F.when(F.col("multiplicative"), F.col("y") / F.col("_c")).otherwise(F.col("y") - F.col("_c"))
    g = o.groupBy("series_id", "multiplicative", F.pmod(F.col("t"), F.lit(m)).alias("phase")).agg(F.avg(left).alias("raw"))
    means = g.groupBy("series_id").agg(F.avg("raw").alias("level"))
    return g.join(means, "series_id").select("series_id", "phase", "multiplicative", F.when(F.col("multiplicative"), F.col("raw") / F.col("level")).otherwise(F.col("raw") - F.col("level")).alias("index"))


def adjusted(obs: DataFrame, m: int = 12) -> DataFrame:
    """``obs`` with seasonal, multiplicative, index and y without its season (index null and y as it is where there is none)."""
    o = obs.withColumn("phase", F.pmod(F.col("t"), F.lit(m))).join(indices(obs, m), ["series_id", "phase"], "left").drop("phase")
    y = F.when(F.col("index").isNull(), F.col("y")).when(F.col("multiplicative"), F.col("y") / F.col("index")).otherwise(F.col("y") - F.col("index"))
    return o.withColumn("seasonal", F.col("index").isNotNull()).withColumn("y", y)


def restored(value: Column) -> Column:
    """A value of ``adjusted`` rows with its season."""
    return F.when(F.col("index").isNull(), value).when(F.col("multiplicative"), value * F.col("index")).otherwise(value + F.col("index"))


def theta(obs: DataFrame, m: int = 12) -> DataFrame:
    """One-step forecasts of (series_id, ds, t, n, y, split): two theta lines of the values without their season, whose season is put back.

    series_id, ds, split, seasonal, weight, pred.  Test, indices and the weight of
    smoothing come from the training rows.
    """
    rows = smoothing.best_weight(smoothing.levels(adjusted(obs, m)))
    return smoothing.theta(rows).select("series_id", "ds", "split", "seasonal", "weight", restored(F.col("pred")).alias("pred"))


# --- decomposition by local lines ---------------------------------------------------


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line_at(rows: Column, place: Column, width: int) -> Column:
    """Local line at a place (from 0; it may lie outside) of rows of (v, w): tricube weights of the ``width`` nearest rows, times w.

    With fewer rows the reach grows by half of what lacks; without weight the
    nearest row's value stands.
    """
    n = F.size(rows)
    q = F.least(F.lit(width), n)
    left = F.greatest(F.least(F.floor(place - (q - 1) / 2).cast("int"), n - q), F.lit(0))
    reach = F.greatest(place - left, left + q - 1 - place) + F.greatest(F.lit(width) - n, F.lit(0)) / 2

    def at(left_reach: Column) -> Column:
        lo, h = left_reach["left"], left_reach["reach"]
        start = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "x", "xx", "y", "xy")])
        # by steps, so that nothing is worked out twice for a row
        near = F.transform(F.slice(rows, lo + 1, q), lambda r, i: F.struct((i + lo - place).alias("x"), r["v"].alias("v"), r["w"].alias("w")))
        near = F.transform(near, lambda r: F.struct(r["x"], r["v"], r["w"], F.least(F.abs(r["x"]) / F.greatest(h, F.lit(1e-12)), F.lit(1.0)).alias("u")))
        near = F.transform(near, lambda r: F.struct(r["x"], r["v"], (r["w"] * F.when(r["u"] <= 0.001, 1.0).when(r["u"] >= 0.999, 0.0).otherwise(F.pow(1 - r["u"] * r["u"] * r["u"], F.lit(3.0)))).alias("w")))
        near = F.transform(near, lambda r: F.struct(r["w"], (r["w"] * r["x"]).alias("wx"), r["x"], r["v"]))

        def add(s: Column, r: Column) -> Column:
            return F.struct((s["w"] + r["w"]).alias("w"), (s["x"] + r["wx"]).alias("x"), (s["xx"] + r["wx"] * r["x"]).alias("xx"), (s["y"] + r["w"] * r["v"]).alias("y"), (s["xy"] + r["wx"] * r["v"]).alias("xy"))

        def read(s: Column) -> Column:
            spread = s["xx"] / s["w"] - (s["x"] / s["w"]) * (s["x"] / s["w"])
            mean = s["y"] / F.nullif(s["w"], F.lit(0.0))
            slope = (s["xy"] / s["w"] - s["x"] / s["w"] * mean) / F.nullif(spread, F.lit(0.0))
            wide = F.sqrt(F.greatest(spread, F.lit(0.0))) > 0.001 * (n - 1)
            nearest = F.get(rows, F.least(F.greatest(place.cast("int"), F.lit(0)), n - 1))["v"]
            return F.when(s["w"] <= 0, nearest).when(wide, mean - s["x"] / s["w"] * slope).otherwise(mean)

        return F.aggregate(near, start, add, read)

    return _let(F.struct(left.alias("left"), reach.cast("double").alias("reach")), at)


def _smooth(values: Column, weights: Column, width: int) -> Column:
    rows = F.zip_with(values, weights, lambda v, w: F.struct(v.alias("v"), w.alias("w")))
    return _let(rows, lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda i: _line_at(r, i.cast("double"), width)))


def _moving(values: Column, k: int) -> Column:
    """Means of each k values in a row."""
    return _let(values, lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.aggregate(F.slice(v, i, k), F.lit(0.0), lambda s, x: s + x) / k))


def _odd(x: float) -> int:
    """The least odd number of at least x."""
    n = -int(-x // 1)
    return n if n % 2 else n + 1


def stl(obs: DataFrame, m: int = 12, season: int = 7, inner: int = 2, outer: int = 15) -> DataFrame:
    """series_id, ds, t, y, trend, seasonal, rest, weight of each row of (series_id, ds, t, y) by local lines; series of fewer than 2 m rows are left out.

    Each of ``inner`` rounds smooths the rows of each phase (``season`` of them, one
    more at either end), takes the slow part of that away, and smooths the rest
    for the trend; each of ``outer`` rounds weighs rows by the bisquare of what is
    left over six times its median, and begins again from the trend.
    """
    slow, trend_width = _odd(m + 1), _odd(1.5 * m / (1 - 1.5 / season))
    rows = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "ds", F.col("y").cast("double").alias("y")))).alias("rows")).where(F.size("rows") >= 2 * m)
    # few bytes, much work: as many parts as there are cores, which small partitions are not joined below
    rows = rows.repartition(max(1, obs.sparkSession.sparkContext.defaultParallelism), "series_id").withColumn("y", F.transform("rows", lambda x: x["y"]))
    n = F.size("y")
    ones = lambda a: F.transform(a, lambda x: F.lit(1.0))
    minus = lambda a, b: F.zip_with(a, b, lambda x, z: x - z)

    def cycles(d: Column, w: Column) -> Column:
        """Smoothed rows of each phase, from a season before the first to one after the last."""
        both = F.zip_with(d, w, lambda v, u: F.struct(v.alias("v"), u.alias("w")))
        phases = _let(both, lambda b: F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.transform(F.sequence(p, n - 1, F.lit(m)), lambda i: F.get(b, i))))
        return _let(phases, lambda ph: F.transform(F.sequence(F.lit(0), n + 2 * m - 1), lambda k: _line_at(F.get(ph, F.pmod(k, F.lit(m))), F.floor(k / m).cast("double") - 1, season)))

    def one(s: Column) -> Column:
        """The next trend and season."""
        def slower(c: Column) -> Column:
            low = _moving(_moving(_moving(c, m), m), 3)
            return _let(low, lambda x: minus(F.slice(c, F.lit(m + 1), n), _smooth(x, ones(x), slow)))

        own = _let(cycles(minus(F.col("y"), s["trend"]), s["w"]), slower)
        return _let(own, lambda c: F.struct(_smooth(minus(F.col("y"), c), s["w"], trend_width).alias("trend"), c.alias("season"), s["w"].alias("w")))

    def weighed(s: Column) -> Column:
        rest = minus(minus(F.col("y"), s["season"]), s["trend"])
        size = F.transform(rest, lambda x: F.abs(x))

        def by(sorted_: Column) -> Column:
            k = F.size(sorted_)
            h = 3 * (F.get(sorted_, F.floor((k - 1) / 2).cast("int")) + F.get(sorted_, F.floor(k / 2).cast("int")))
            u = lambda x: F.when(h > 0, x / F.when(h > 0, h)).otherwise(0.0)
            return F.transform(size, lambda x: F.when(u(x) <= 0.001, 1.0).when(u(x) >= 0.999, 0.0).otherwise((1 - u(x) * u(x)) * (1 - u(x) * u(x))))

        return F.struct(s["trend"].alias("trend"), s["season"].alias("season"), _let(F.array_sort(size), by).alias("w"))

    zeros = F.transform("y", lambda x: F.lit(0.0))
    start = F.struct(zeros.alias("trend"), zeros.alias("season"), F.transform("y", lambda x: F.lit(1.0)).alias("w"))

    # one fold: every inner-th step is followed by new weights, but for the last
    total = inner * (outer + 1)

    def step(s: Column, i: Column) -> Column:
        return _let(one(s), lambda x: F.when((i % inner == 0) & (i < total), weighed(x)).otherwise(x))

    done = rows.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(total)), start, step))
    z = done.select("series_id", F.explode(F.arrays_zip("rows", F.col("s.trend").alias("trend"), F.col("s.season").alias("season"), F.col("s.w").alias("w"))).alias("z"))
    z = z.select("series_id", F.col("z.rows.ds").alias("ds"), F.col("z.rows.t").alias("t"), F.col("z.rows.y").alias("y"), F.col("z.trend").alias("trend"), F.col("z.season").alias("seasonal"), F.col("z.w").alias("weight"))
    return z.select("series_id", "ds", "t", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("rest"), "weight")


def robust_strengths(obs: DataFrame, m: int = 12, **rounds: int) -> DataFrame:
    """series_id, trend_strength and seasonal_strength by ``stl``."""
    part = lambda c: F.greatest(F.lit(0.0), 1 - F.var_pop("rest") / F.greatest(F.var_pop(F.col(c) + F.col("rest")), F.lit(1e-12)))
    return stl(obs, m, **rounds).groupBy("series_id").agg(part("trend").alias("trend_strength"), part("seasonal").alias("seasonal_strength"))
