"""Lags, frames and folds over the rows of a series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.substrate import along


def direct_windows(obs: DataFrame, width: int, horizon: int) -> DataFrame:
    """x: ``width`` values up to t; target: the next ``horizon``. Full windows only."""
    x = F.collect_list("y").over(along().rowsBetween(1 - width, 0))
    y = F.collect_list("y").over(along().rowsBetween(1, horizon))
    o = obs.select("series_id", "ds", "t", x.alias("x"), y.alias("target"))
    return o.where((F.size("x") == width) & (F.size("target") == horizon))


def lags(value: str, k: int) -> list[Column]:
    """lag1 .. lagk, zero before the first row."""
    return [F.lag(value, i, 0.0).over(along()).alias(f"lag{i}") for i in range(1, k + 1)]


def momentum(value: str, span: int) -> Column:
    return F.coalesce(F.col(value) - F.lag(value, span).over(along()), F.lit(0.0))


def seasonal(value: str, m: int) -> tuple[Column, Column]:
    """Value and change since ``m`` rows before; zero before there is one."""
    return F.lag(value, m, 0.0).over(along()), F.coalesce(F.col(value) - F.lag(value, m).over(along()), F.lit(0.0))


def calendar(m: int) -> tuple[Column, Column]:
    angle = 2 * math.pi * F.col("t") / m
    return F.sin(angle), F.cos(angle)


def causal(value: str, k: int) -> dict[str, Column]:
    """Over the last ``k`` rows (fewer at the start): mean, slope (last less first), contrast (mean of the second half less that of the first), energy (mean size)."""
    w = along().rowsBetween(1 - k, 0)
    rows = F.collect_list(value).over(w)
    size = F.size(rows)
    half = F.floor(size / 2).cast("int")
    mean = lambda a, n: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    contrast = F.when(size > 1, mean(F.slice(rows, half + 1, size - half), size - half) - mean(F.slice(rows, 1, F.greatest(half, F.lit(1))), half)).otherwise(0.0)
    return {"mean": F.avg(value).over(w), "slope": F.col(value) - F.first(value).over(w), "contrast": contrast, "energy": F.avg(F.abs(value)).over(w)}


def folded(obs: DataFrame, value: str, out: str, init: Column, step, read) -> DataFrame:
    """A fold along each series, as an array of states; one row a series while it runs.

    ``step(state, x)`` gives the next state (from ``init``), ``read`` what is kept of it.
    """
    rows = obs.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("t", "ds", F.col(value).alias("v")))).alias("rows"))
    states = F.aggregate(
        "rows",
        F.struct(init.alias("s"), F.array().cast("array<double>").alias("out")),
        lambda a, x: F.struct(step(a["s"], x["v"], F.size(a["out"])).alias("s"), F.concat(a["out"], F.array(read(step(a["s"], x["v"], F.size(a["out"]))))).alias("out")),
        lambda a: a["out"],
    )
    e = rows.select("series_id", F.explode(F.arrays_zip("rows", states.alias("out"))).alias("z"))
    return e.select("series_id", F.col("z.rows.ds").alias("ds"), F.col("z.rows.t").alias("t"), F.col("z.rows.v").alias(value), F.col("z.out").alias(out))


def ema(obs: DataFrame, value: str, span: int, out: str = "ema") -> DataFrame:
    """Exponential mean with weight 2 / (span + 1), starting at the first value."""
    a = 2.0 / (span + 1)
    return folded(obs, value, out, F.lit(0.0), lambda s, x, i: F.when(i == 0, x).otherwise(a * x + (1 - a) * s), lambda s: s)


def ewm_std(obs: DataFrame, value: str, span: int, out: str = "ewm_std") -> DataFrame:
    """Exponentially weighted standard deviation, bias-corrected; 0 for one row."""
    a = 2.0 / (span + 1)
    init = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(1.0).alias("w"))

    def step(s, x, i):
        return F.when(i == 0, F.struct(x.alias("m"), (x * x).alias("v"), F.lit(1.0).alias("w"))).otherwise(
            F.struct((a * x + (1 - a) * s["m"]).alias("m"), (a * x * x + (1 - a) * s["v"]).alias("v"), ((1 - a) ** 2 * s["w"] + a * a).alias("w"))
        )

    read = lambda s: F.when(s["w"] < 1, F.sqrt(F.greatest((s["v"] - s["m"] * s["m"]) / F.nullif(1 - s["w"], F.lit(0.0)), F.lit(0.0)))).otherwise(0.0)
    return folded(obs, value, out, init, step, read)


def next_value(value: str) -> Column:
    return F.lead(value, 1).over(along())


RUNNING = Window.unboundedPreceding
