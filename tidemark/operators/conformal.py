"""Adaptive conformal intervals, as one fold along each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_statistic(sorted_scores: Column, alpha: Column) -> Column:
    """The finite-sample quantile: of n scores in order, number ceil((n + 1)(1 - alpha)) held to 1..n; 0 if there are none."""
    n = F.size(sorted_scores)
    a = F.least(F.greatest(alpha, F.lit(1e-6)), F.lit(1.0))
    rank = F.least(F.greatest(F.ceil((n + 1) * (1 - a)).cast("int"), F.lit(1)), n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.element_at(sorted_scores, F.greatest(rank, F.lit(1))))


def half_width(scores: Column, alpha: Column, scale: Column, least: Column) -> Column:
    return F.greatest(scale * order_statistic(scores, alpha), least)


def adaptive(rows: DataFrame, by: list[str], target: float = 0.1, rate: float | str = 0.05, scale: float | str = 1.0, least: str | None = None, low: float = 0.01, high: float = 0.5) -> DataFrame:
    """Intervals for rows (by, t, y, pred) in order of t, each made before its y is seen.

    Adds lower, upper, alpha (before the row), n_scores (before the row) and
    miss.  After each row alpha moves by ``rate`` times target less miss, held to
    [low, high], and the row's size of error joins the scores.  ``rate`` 0 gives
    static intervals.  ``least``: a column with the least half-width; ``rate`` and
    ``scale`` may be columns too, so settings can be part of the key.  A step sorts
    the scores so far: work grows with the square of a series' length, which suits
    monthly and daily series; longer ones go through ``streaming.online``, whose
    state keeps them in order.
    """
    kept = [c for c in rows.columns if c not in by]
    wide = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("t", *[c for c in kept if c != "t"]))).alias("rows"))
    of = lambda x, v: x[v] if isinstance(v, str) else F.lit(float(v))
    floor = (lambda x: x[least]) if least else (lambda x: F.lit(0.0))
    empty = F.array().cast("array<double>")
    state = F.struct(F.lit(float(target)).alias("alpha"), empty.alias("scores"), F.array().cast("array<struct<half:double,alpha:double,n:int,miss:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        half = half_width(s["scores"], s["alpha"], of(x, scale), floor(x))
        miss = (F.abs(x["y"] - x["pred"]) > half).cast("int")
        alpha = F.least(F.greatest(s["alpha"] + of(x, rate) * (target - miss), F.lit(low)), F.lit(high))
        scores = F.array_sort(F.concat(s["scores"], F.array(F.abs(x["y"] - x["pred"]))))
        out = F.concat(s["out"], F.array(F.struct(half.alias("half"), s["alpha"].alias("alpha"), F.size(s["scores"]).alias("n"), miss.alias("miss"))))
        return F.struct(alpha.alias("alpha"), scores.alias("scores"), out.alias("out"))

    e = wide.select(*by, F.explode(F.arrays_zip("rows", F.aggregate("rows", state, step, lambda s: s["out"]).alias("o"))).alias("z"))
    cols = [F.col(f"z.rows.{c}").alias(c) for c in kept]
    return e.select(*by, *cols, (F.col("z.rows.pred") - F.col("z.o.half")).alias("lower"), (F.col("z.rows.pred") + F.col("z.o.half")).alias("upper"), F.col("z.o.alpha").alias("alpha"), F.col("z.o.n").alias("n_scores"), F.col("z.o.miss").alias("miss"))
