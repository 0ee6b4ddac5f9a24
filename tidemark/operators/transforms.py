"""Scalings and fillings of series; whatever is fitted is fitted on rows of split train alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.substrate import along, whole


def train(value: Column) -> Column:
    return F.when(F.col("split") == "train", value)


def finite(obs: DataFrame) -> DataFrame:
    return obs.where(F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")))


def log_if_positive(obs: DataFrame) -> DataFrame:
    """z, scale: log of the values if all values of the series are above 0, else the values."""
    positive = F.min("y").over(whole()) > 0
    return obs.withColumn("scale", F.when(positive, "log").otherwise("identity")).withColumn("z", F.when(F.col("scale") == "log", F.log("y")).otherwise(F.col("y")))


def inverse(value: Column, scale: Column) -> Column:
    return F.when(scale == "log", F.exp(value)).otherwise(value)


def positive_log(obs: DataFrame, eps: float = 1e-3, strict: bool = False) -> DataFrame:
    """offset and z = log(y + offset), the offset lifting the least training value to eps; null, or with ``strict`` an error, where the sum is not above 0."""
    offset = F.greatest(F.lit(0.0), F.lit(eps) - F.min(train(F.col("y"))).over(whole()))
    wrong = F.when(F.col("y").isNotNull(), F.raise_error(F.concat(F.lit("value not above 0 in "), "series_id")).cast("double")) if strict else F.lit(None).cast("double")
    return obs.withColumn("offset", offset).withColumn("z", F.when(F.col("y") + F.col("offset") > 0, F.log(F.col("y") + F.col("offset"))).otherwise(wrong))


def robust_scale(obs: DataFrame) -> DataFrame:
    """center (median), spread (interquartile range over 1.35, 1 if too small) of the training values, and z."""
    q = obs.groupBy("series_id").agg(F.percentile(train(F.col("y")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    spread = (F.col("q")[2] - F.col("q")[0]) / 1.35
    q = q.select("series_id", F.col("q")[1].alias("center"), F.when(spread > 1e-8, spread).otherwise(1.0).alias("spread"))
    return obs.join(q, "series_id").withColumn("z", F.coalesce((F.col("y") - F.col("center")) / F.col("spread"), F.lit(0.0)))


def standard_scale(obs: DataFrame) -> DataFrame:
    """mean and sd (population) of the training values, and z."""
    o = obs.withColumn("mean", F.avg(train(F.col("y"))).over(whole())).withColumn("sd", F.stddev_pop(train(F.col("y"))).over(whole()))
    return o.withColumn("z", (F.col("y") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def fill(obs: DataFrame) -> DataFrame:
    """forward and backward: y with nulls filled from before, or from after."""
    back, ahead = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    return obs.withColumn("forward", F.last("y", True).over(back)).withColumn("backward", F.first("y", True).over(ahead))


def future_index(obs: DataFrame, horizon: int) -> DataFrame:
    """series_id, h, ds: the months after each series' last."""
    last = obs.groupBy("series_id").agg(F.max("ds").alias("last"))
    return last.select("series_id", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h")).select("series_id", "h", F.last_day(F.add_months("last", F.col("h"))).alias("ds"))


def point_or_midpoint(pred: Column, lower: Column, upper: Column) -> Column:
    return F.coalesce(pred, (lower + upper) / 2)


def table_number(value: Column, digits: int = 3) -> Column:
    return F.coalesce(F.format_number(value, digits), F.lit("--"))


def escaped(text: Column) -> Column:
    """Text with the characters that are special in typesetting escaped."""
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
