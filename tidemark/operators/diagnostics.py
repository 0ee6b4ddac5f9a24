"""Properties of series and of residuals, as windows and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import tails
from tidemark.plans.substrate import along, whole


def profile(obs: DataFrame) -> DataFrame:
    cv = F.when(F.abs(F.avg("y")) > 1e-12, F.stddev_samp("y") / F.abs(F.avg("y")))
    return obs.groupBy("series_id").agg(F.count("*").alias("n"), cv.alias("cv"), F.avg(F.col("y").isNull().cast("double")).alias("missing"), F.avg((F.col("y") == 0).cast("double")).alias("zeros"))


def autocorrelation(obs: DataFrame, lags: list[int]) -> DataFrame:
    """series_id, n, and rho<k> for each lag (biased)."""
    o = obs.withColumn("d", F.col("y") - F.avg("y").over(whole()))
    for k in lags:
        o = o.withColumn(f"l{k}", F.lag("d", k).over(along()))
    ss = F.nullif(F.sum(F.col("d") * F.col("d")), F.lit(0.0))
    return o.groupBy("series_id").agg(F.count("*").alias("n"), *[(F.sum(F.col("d") * F.col(f"l{k}")) / ss).alias(f"rho{k}") for k in lags])


def ljung_box(obs: DataFrame, lags: int = 12) -> DataFrame:
    a = autocorrelation(obs, list(range(1, lags + 1)))
    total = sum((F.col(f"rho{k}") * F.col(f"rho{k}") / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return a.select("series_id", "n", (F.col("n") * (F.col("n") + 2) * total).alias("q"))


def spectral_entropy(obs: DataFrame) -> DataFrame:
    """Entropy of the periodogram without the mean, over the log of the number of frequencies; made inside one row a series."""
    g = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("rows"), F.avg("y").alias("mean"), F.count("*").alias("n"))
    step = 2 * math.pi / F.col("n")

    def part(f, k):
        return F.aggregate("rows", F.lit(0.0), lambda a, x: a + (x["y"] - F.col("mean")) * f(step * F.pmod(k * x["t"], F.col("n"))))

    power = F.transform(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int")), lambda k: F.pow(part(F.cos, k), F.lit(2)) + F.pow(part(F.sin, k), F.lit(2)))
    p = g.where("n >= 2").select("series_id", power.alias("p")).withColumn("total", F.aggregate("p", F.lit(0.0), lambda a, x: a + x))
    share = lambda x: x / F.nullif(F.col("total"), F.lit(0.0))
    h = F.aggregate("p", F.lit(0.0), lambda a, x: a + F.when(share(x) > 1e-15, -share(x) * F.log(share(x))).otherwise(0.0))
    return p.select("series_id", (h / F.log(F.size("p"))).alias("entropy"))


def breaks(obs: DataFrame, width: int = 8, least: float = 3.0) -> DataFrame:
    """Rows before which the mean of ``width`` rows differs from that after by ``least`` spreads of the series."""
    before, after = along().rowsBetween(-width, -1), along().rowsBetween(0, width - 1)
    o = obs.withColumn("sd", F.stddev_pop("y").over(whole())).withColumn("a", F.avg("y").over(before)).withColumn("b", F.avg("y").over(after))
    full = (F.col("t") >= width) & (F.col("t") <= F.col("n") - width)
    z = F.abs(F.col("b") - F.col("a")) / F.nullif(F.col("sd"), F.lit(0.0))
    return o.where(full).withColumn("z", z).where(F.col("z") >= least).select("series_id", "t", "ds", "z")


def break_count(candidates: DataFrame, gap: int = 8) -> DataFrame:
    """Breaks at least ``gap`` rows apart, taken in order: a fold over the candidates of a series."""
    g = candidates.groupBy("series_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(-(10**6)).alias("last"), F.lit(0).alias("n"))
    step = lambda s, t: F.when(t - s["last"] >= gap, F.struct(t.cast("int").alias("last"), (s["n"] + 1).alias("n"))).otherwise(s)
    return g.select("series_id", F.aggregate("ts", start, step, lambda s: s["n"]).alias("breaks"))


def residual_moments(rows: DataFrame, by: list[str], residual: str) -> DataFrame:
    """n, mean, sd, median, mad (scaled), bias-corrected skewness and excess kurtosis, and the Jarque-Bera statistic."""
    from pyspark.sql import Window

    med = F.percentile(residual, F.lit(0.5)).over(Window.partitionBy(*by))
    r = rows.withColumn("_med", med)
    x, n = F.col(residual), F.count(residual)
    g = r.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.first("_med").alias("median"), (1.4826 * F.percentile(F.abs(x - F.col("_med")), F.lit(0.5))).alias("mad"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return g.select(*by, "n", "mean", "sd", "median", "mad", skew.alias("skew"), kurt.alias("kurtosis"), (n / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)).alias("jarque_bera"))


def dickey_fuller(obs: DataFrame) -> DataFrame:
    """n, slope and t of the regression of each change on the value before it, with a constant."""
    o = obs.withColumn("x", F.lag("y").over(along())).where("x is not null").withColumn("d", F.col("y") - F.col("x"))
    g = o.groupBy("series_id").agg(F.count("*").alias("n"), F.regr_slope(F.col("d"), F.col("x")).alias("slope"), F.regr_sxx(F.col("d"), F.col("x")).alias("sxx"), F.regr_syy(F.col("d"), F.col("x")).alias("syy"))
    rss = F.col("syy") - F.col("slope") * F.col("slope") * F.col("sxx")
    se = F.sqrt(rss / (F.col("n") - 2) / F.nullif(F.col("sxx"), F.lit(0.0)))
    return g.select("series_id", "n", "slope", (F.col("slope") / F.nullif(se, F.lit(0.0))).alias("t"))


def level_stationarity(obs: DataFrame, lags: int = 4) -> DataFrame:
    """Mean square of the cumulative sums about the mean, over the long-run variance with Bartlett weights."""
    from pyspark.sql import Window

    o = obs.withColumn("d", F.col("y") - F.avg("y").over(whole()))
    o = o.withColumn("s", F.sum("d").over(along().rowsBetween(Window.unboundedPreceding, 0)))
    for k in range(1, lags + 1):
        o = o.withColumn(f"l{k}", F.lag("d", k).over(along()))
    n = F.count("*")
    long_run = F.sum(F.col("d") * F.col("d"))
    for k in range(1, lags + 1):
        long_run = long_run + 2 * (1 - k / (lags + 1)) * F.sum(F.col("d") * F.col(f"l{k}"))
    return o.groupBy("series_id").agg(n.alias("n"), (F.sum(F.col("s") * F.col("s")) / n / F.nullif(long_run, F.lit(0.0))).alias("statistic"))


def strengths(obs: DataFrame, m: int = 12) -> DataFrame:
    """trend and seasonal strength by classical decomposition: a centred mean over m, and month means of what it leaves; null for fewer than 2m rows."""
    from pyspark.sql import Window

    h = m // 2
    a, b = (F.avg("y").over(along().rowsBetween(lo, hi)) for lo, hi in ((-h, h - 1), (1 - h, h)))
    o = obs.where(F.col("n") >= 2 * m).withColumn("trend", F.when((F.col("t") >= h) & (F.col("t") < F.col("n") - h), (a + b) / 2)).where("trend is not null")
    o = o.withColumn("x", F.col("y") - F.col("trend")).withColumn("season", F.avg("x").over(Window.partitionBy("series_id", F.month("ds")))).withColumn("r", F.col("x") - F.col("season"))
    part = lambda c: F.greatest(F.lit(0.0), 1 - F.var_pop("r") / F.nullif(F.var_pop(c), F.lit(0.0)))
    return o.withColumn("ts", F.col("trend") + F.col("r")).groupBy("series_id").agg(part("ts").alias("trend_strength"), part("x").alias("seasonal_strength"))


def adjacent_breaks(obs: DataFrame, width: int = 8, least: float = 3.0) -> DataFrame:
    """As ``breaks``, with the difference of means against the standard error of a mean of ``width`` rows (spread of the series / root of width)."""
    o = breaks(obs, width, 0.0).join(obs.groupBy("series_id").agg((F.stddev_pop("y") / F.stddev_samp("y")).alias("ratio"), F.stddev_samp("y").alias("sd")), "series_id")
    z = F.col("z") * F.col("ratio") * math.sqrt(width)
    return o.where(F.col("sd") > 1e-12).withColumn("z", z).where(F.col("z") >= least).select("series_id", "t", "ds", "z")


def stationarity_p(statistic: Column) -> Column:
    """p of ``level_stationarity``, interpolated between the published critical values, held to 0.01 to 0.1."""
    # fixed values: critical values of the level test at 10, 5, 2.5 and 1 per cent
    points = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
    out = F.when(statistic >= points[-1][0], points[-1][1])
    for (a, p), (b, q) in zip(points, points[1:]):
        out = out.when((statistic >= a) & (statistic < b), p + (statistic - a) / (b - a) * (q - p))
    return F.when(statistic.isNotNull(), out.otherwise(points[0][1]))


def frame(obs: DataFrame, m: int = 12) -> DataFrame:
    """One row a series with everything that is known of it; what a series is too short for is null.

    observations, missing, zeros, cv, acf1, acf_season, ljung_box and its p (m
    lags), trend_strength, seasonal_strength, entropy, breaks, unit_root_t
    and unit_root (not rejected at 5 per cent), level and level_p.
    """
    parts = [
        autocorrelation(obs, sorted({1, m})).select("series_id", F.col("rho1").alias("acf1"), F.col(f"rho{m}").alias("acf_season")),
        ljung_box(obs, m).select("series_id", F.col("q").alias("ljung_box"), tails.chi_square(F.col("q"), F.lit(m)).alias("ljung_box_p")),
        strengths(obs, m),
        spectral_entropy(obs),
        break_count(adjacent_breaks(obs)),
        # fixed value: the 5 per cent point of the unit-root t with a constant, for long series
        dickey_fuller(obs).select("series_id", F.col("t").alias("unit_root_t"), (F.col("t") >= -2.86).alias("unit_root")),
        level_stationarity(obs).select("series_id", F.col("statistic").alias("level"), stationarity_p(F.col("statistic")).alias("level_p")),
    ]
    out = profile(obs).withColumnRenamed("n", "observations")
    for p in parts:
        out = out.join(p, "series_id", "left")
    return out.withColumn("breaks", F.coalesce("breaks", F.lit(0)))


def residual_tests(rows: DataFrame, by: list[str], residual: str, order: str, m: int = 12, limit: float = 0.2) -> DataFrame:
    """Residuals by group in order: acf at 1 and m, Ljung-Box with its p, the skewness and kurtosis test (k2) and Jarque-Bera with their p, and whether the seasonal correlation is over ``limit``."""
    key = F.to_json(F.struct(*by))  # one string for a group, different for different ones
    r = rows.where(F.col(residual).isNotNull()).select(*by, key.alias("series_id"), F.col(order).alias("ds"), F.col(residual).alias("y"))
    lb = autocorrelation(r, list(range(1, m + 1)))
    total = sum((F.col(f"rho{k}") * F.col(f"rho{k}") / (F.col("n") - k) for k in range(1, m + 1)), F.lit(0.0))
    q = F.col("n") * (F.col("n") + 2) * total
    lb = lb.select("series_id", F.col("rho1").alias("acf1"), F.col(f"rho{m}").alias("acf_season"), q.alias("ljung_box"), tails.chi_square(q, F.lit(m)).alias("ljung_box_p"))
    g = r.groupBy(*by, "series_id").agg(F.count("*").alias("n"), F.skewness("y").alias("g1"), F.kurtosis("y").alias("g2"))
    n, g1, g2 = F.col("n").cast("double"), F.col("g1"), F.col("g2")
    # D'Agostino's transforms of both moments to normal scores
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    a = y / F.sqrt(2 / (w2 - 1))
    z1 = F.log(a + F.sqrt(a * a + 1)) / F.sqrt(0.5 * F.log(w2))
    x = (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    c = 6 + 8 / b1 * (2 / b1 + F.sqrt(1 + 4 / (b1 * b1)))
    d = 1 + x * F.sqrt(2 / (c - 4))
    z2 = (1 - 2 / (9 * c) - F.signum(d) * F.pow((1 - 2 / c) / F.abs(d), F.lit(1 / 3))) / F.sqrt(2 / (9 * c))
    k2, jb = z1 * z1 + z2 * z2, n / 6 * (g1 * g1 + g2 * g2 / 4)
    g = g.select(*by, "series_id", "n", F.when(n >= 20, k2).alias("k2"), F.when(n >= 20, F.exp(-k2 / 2)).alias("k2_p"), jb.alias("jarque_bera"), F.exp(-jb / 2).alias("jarque_bera_p"))
    return g.join(lb, "series_id").withColumn("seasonal_left", F.abs("acf_season") > limit).drop("series_id")


#: Polynomials (highest power first) of the weights of the two greatest values in the root of 1 / n, and of the mean and log spread of the statistic's transform.
ORDERED = {
    "last": (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0),
    "next": (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0),
    "mean": (0.0038915, -0.083751, -0.31082, -1.5861), "spread": (0.0030302, -0.082676, -0.4803),
    "few_mean": (-0.0006714, 0.025054, -0.39978, 0.5440), "few_spread": (-0.0020322, 0.062767, -0.77857, 1.3822), "few_end": (0.459, -2.273),
}


def normality(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Whether the values of each group look normal, by their order: by, n, w, w_p.

    w is the squared correlation of the ordered values with weights from normal
    quantiles; p by the published transforms (for 3 values exactly).  Null for
    fewer than 3 values, more than 5000, or without spread.
    """
    from pyspark.sql import Window

    r = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"))
    w = Window.partitionBy(*by)
    r = r.withColumn("i", F.row_number().over(w.orderBy("x"))).withColumn("n", F.count("*").over(w)).withColumn("c", F.col("x") - F.avg("x").over(w))
    score = lambda i, n: tails.normal_quantile((i - 0.375) / (n + 0.25))
    r = r.withColumn("m", score(F.col("i"), F.col("n")))
    at = lambda k: F.max(F.when(F.col("i") == k, F.col("c")))
    g = r.groupBy(*by, "n").agg(F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("c")).alias("mx"), F.sum(F.col("c") * F.col("c")).alias("ss"), at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(F.col("n") - 1).alias("y2"), at(F.col("n")).alias("y1"))

    def poly(name: str, x: Column) -> Column:
        out = F.lit(0.0)
        for c in ORDERED[name]:
            out = out * x + c
        return out

    n, u = F.col("n").cast("double"), 1 / F.sqrt(F.col("n"))
    m1, m2 = score(n, n), score(n - 1, n)
    a1, a2 = poly("last", u) + m1 / F.sqrt("mm"), poly("next", u) + m2 / F.sqrt("mm")
    ends, inner = F.col("y1") - F.col("x1"), F.col("y2") - F.col("x2")
    many = (F.col("mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)
    few = (F.col("mm") - 2 * m1 * m1) / (1 - 2 * a1 * a1)
    top = F.when(F.col("n") == 3, ends * 0.5**0.5).when(F.col("n") <= 5, a1 * ends + (F.col("mx") - m1 * ends) / F.sqrt(few)).otherwise(a1 * ends + a2 * inner + (F.col("mx") - m1 * ends - m2 * inner) / F.sqrt(many))
    stat = F.when(F.col("n").between(3, 5000) & (F.col("ss") > 0), F.least(top * top / F.when(F.col("ss") > 0, F.col("ss")), F.lit(1.0)))
    g = g.select(*by, "n", stat.alias("w"))
    log, left = F.log(n), F.log(F.greatest(1 - F.col("w"), F.lit(1e-300)))
    z = F.when(F.col("n") > 11, (left - poly("mean", log)) / F.exp(poly("spread", log))).otherwise((-F.log(F.greatest(poly("few_end", n) - left, F.lit(1e-300))) - poly("few_mean", n)) / F.exp(poly("few_spread", n)))
    above = F.when(z > 0, tails.normal(z) / 2).otherwise(1 - tails.normal(z) / 2)
    three = F.greatest(6 / math.pi * (F.asin(F.sqrt("w")) - math.asin(0.75**0.5)), F.lit(0.0))
    return g.select(*by, "n", "w", F.when(F.col("w").isNotNull(), F.when(F.col("n") == 3, three).otherwise(above)).alias("w_p"))
