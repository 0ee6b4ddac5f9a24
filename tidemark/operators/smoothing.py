"""Exponential smoothing and the theta line, as folds and expanding regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import RUNNING
from tidemark.plans.substrate import along

WEIGHTS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def levels(obs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row for each weight: pred, the level before the row (the first value at the start)."""
    kept = [c for c in obs.columns if c not in ("series_id", "t")]
    rows = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", *kept))).alias("rows")).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    a = F.col("weight")
    start = F.struct(F.col("rows")[0]["y"].alias("level"), F.array().cast("array<double>").alias("out"))
    out = F.aggregate("rows", start, lambda s, x: F.struct((a * x["y"] + (1 - a) * s["level"]).alias("level"), F.concat(s["out"], F.array(s["level"])).alias("out")), lambda s: s["out"])
    e = rows.select("series_id", "weight", F.explode(F.arrays_zip("rows", out.alias("o"))).alias("z"))
    return e.select("series_id", "weight", F.col("z.rows.t").alias("t"), *[F.col(f"z.rows.{c}").alias(c) for c in kept], F.col("z.o").alias("pred"))


def best_weight(forecasts: DataFrame) -> DataFrame:
    """Of each series, the rows of the weight with the least squared error on training rows (the smallest among equals)."""
    w = Window.partitionBy("series_id", "weight")
    loss = F.round(F.sum(F.when(F.col("split") == "train", (F.col("y") - F.col("pred")) ** 2)).over(w), 6)
    f = forecasts.withColumn("_loss", loss)
    return f.withColumn("_best", F.min(F.struct("_loss", "weight")).over(Window.partitionBy("series_id"))).where(F.col("weight") == F.col("_best.weight")).drop("_loss", "_best")


def theta(smoothed: DataFrame) -> DataFrame:
    """Adds half the slope of the values known before each row, carried to it: pred becomes the mean of the trend line and the smoothed line of theta 2."""
    past = along().rowsBetween(RUNNING, -1)
    slope = F.when(F.count("y").over(past) >= 3, F.regr_slope(F.col("y"), F.col("t").cast("double")).over(past)).otherwise(0.0)
    a, n = F.col("weight"), F.col("t")
    return smoothed.withColumn("pred", F.col("pred") + slope / 2 * ((1 - F.pow(1 - a, n)) / a))

#: (level, trend, season, damping)
SETTINGS = tuple((a, b, g, p) for a in (0.1, 0.3, 0.6) for b in (0.0, 0.1) for g in (0.1, 0.3) for p in (0.9, 1.0) if b or p == 1.0)


def holt_winters(obs: DataFrame, m: int = 12, settings: tuple = SETTINGS) -> DataFrame:
    """A row for each setting (weight: its number): pred by additive level, damped trend and season, each row's made before it is seen.

    Starts from the first value, no trend and no season; series shorter than
    2m + 2 rows keep no season.  One fold for each series and setting.
    """
    kept = [c for c in obs.columns if c not in ("series_id", "t")]
    grid = F.array(*[F.struct(F.lit(i).alias("weight"), *[F.lit(float(v)).alias(k) for k, v in zip("abgp", s)]) for i, s in enumerate(settings)])
    rows = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", *kept))).alias("rows")).withColumn("s", F.explode(grid))
    a, b, p = (F.col(f"s.{k}") for k in "abp")
    g = F.when(F.size("rows") >= 2 * m + 2, F.col("s.g")).otherwise(0.0)
    start = F.struct(F.col("rows")[0]["y"].alias("level"), F.lit(0.0).alias("trend"), F.array_repeat(F.lit(0.0), m).alias("season"), F.array().cast("array<double>").alias("out"))

    def step(s, x):
        pred = s["level"] + p * s["trend"] + s["season"][0]
        level = a * (x["y"] - s["season"][0]) + (1 - a) * (s["level"] + p * s["trend"])
        trend = b * (level - s["level"]) + (1 - b) * p * s["trend"]
        season = g * (x["y"] - level) + (1 - g) * s["season"][0]
        return F.struct(level.alias("level"), trend.alias("trend"), F.concat(F.slice(s["season"], 2, m - 1), F.array(season)).alias("season"), F.concat(s["out"], F.array(pred)).alias("out"))

    e = rows.select("series_id", F.col("s.weight").alias("weight"), F.explode(F.arrays_zip("rows", F.aggregate("rows", start, step, lambda s: s["out"]).alias("o"))).alias("z"))
    return e.select("series_id", "weight", F.col("z.rows.t").alias("t"), *[F.col(f"z.rows.{c}").alias(c) for c in kept], F.col("z.o").alias("pred"))
