"""Splits of series in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail(obs: DataFrame, horizon: int) -> DataFrame:
    """split: test for the last ``horizon`` rows, train before; series without rows to train on are left out."""
    return obs.where(F.col("n") > horizon).withColumn("split", F.when(F.col("t") >= F.col("n") - horizon, "test").otherwise("train"))


def three_way(obs: DataFrame, train: float = 0.64, calibration: float = 0.16, least: tuple[int, int, int] = (12, 3, 3)) -> DataFrame:
    """block: train, calibration or test by shares of the length; series too short for ``least`` are left out."""
    a, b = F.floor(F.col("n") * train), F.floor(F.col("n") * calibration)
    ok = (F.col("n") >= 18) & (a >= least[0]) & (b >= least[1]) & (F.col("n") - a - b >= least[2])
    return obs.where(ok).withColumn("block", F.when(F.col("t") < a, "train").when(F.col("t") < a + b, "calibration").otherwise("test"))


def internal(obs: DataFrame, ratio: float = 0.7, least: tuple[int, int, int] = (11, 3, 3)) -> DataFrame:
    """block: readout, adapter or conformal, each with its least length; series too short for all are left out."""
    n, (r, a, c) = F.col("n"), least
    r_end = F.least(F.greatest(F.rint(n * ratio), F.lit(r)), n - a - c)
    a_end = F.least(F.greatest(r_end + F.rint(n * 0.2), r_end + a), n - c)
    return obs.where(n >= r + a + c).withColumn("block", F.when(F.col("t") < r_end, "readout").when(F.col("t") < a_end, "adapter").otherwise("conformal"))


def expanding_folds(obs: DataFrame, folds: int = 3, val: int = 6, step: int = 6) -> DataFrame:
    """Adds fold and part (train or val): training rows grow by ``step`` from fold to fold; folds that do not fit are left out."""
    n = F.col("n")
    first = F.greatest(F.lit(2 * val), n - val - step * (folds - 1))
    f = obs.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    end = first + F.col("fold") * step
    return f.where((end + val <= n) & (F.col("t") < end + val)).withColumn("part", F.when(F.col("t") < end, "train").otherwise("val"))


def histories(obs: DataFrame, sizes: tuple[int, ...] = (36, 60, 84, 120, 160), least: int = 18) -> DataFrame:
    """Adds history: for each size that the series has, its last rows."""
    f = obs.withColumn("history", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return f.where((F.col("history") <= F.col("n")) & (F.col("history") >= least) & (F.col("t") >= F.col("n") - F.col("history")))


def conformal_start(n):
    """First row of the conformal part of a baseline's training rows."""
    return F.least(F.greatest(F.floor(n * 0.75), F.lit(6)), n - 3)


def history_grid(n, sizes: tuple[int, ...] = (36, 48, 60, 84, 120, 160), shares: tuple[float, ...] = (0.6, 0.75, 0.9, 1.0), least: int = 24):
    """Distinct history sizes of a series, fixed and as shares of its length, in order."""
    grid = F.array(*[F.lit(s) for s in sizes], *[F.rint(n * s).cast("int") for s in shares])
    return F.array_sort(F.array_distinct(F.filter(grid, lambda s: (s >= least) & (s <= n))))
