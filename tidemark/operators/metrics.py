"""Point and interval metrics as grouped aggregates over (y, pred, lower, upper)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.transforms import train
from tidemark.plans.substrate import along

EPS = 1e-5


def error() -> Column:
    return F.col("y") - F.col("pred")


def point() -> dict[str, Column]:
    e, n = error(), F.count("*")
    sse, sst = F.sum(e * e), F.var_pop("y") * n
    r2 = F.when(n < 2, F.lit(None).cast("double")).when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0))).when(sse == 0, 1.0).otherwise(0.0)
    return {
        "mape": F.avg(F.abs(e) / F.greatest(F.abs("y"), F.lit(EPS))),
        "smape": F.avg(2 * F.abs(e) / F.greatest(F.abs("y") + F.abs("pred"), F.lit(EPS))),
        "mae": F.avg(F.abs(e)),
        "mse": F.avg(e * e),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": r2,
        "wape": F.sum(F.abs(e)) / F.greatest(F.sum(F.abs("y")), F.lit(EPS)),
    }


def scales(obs: DataFrame, m: int = 12) -> DataFrame:
    """scale and square_scale of each series' training rows: mean size (square) of the seasonal change, of the last change, or 1; the spread instead if that is too small."""
    o = obs.select("series_id", "ds", train(F.col("y")).alias("y"), (F.col("split") == "train").alias("is_train"))
    o = o.where("is_train").withColumn("s", F.col("y") - F.lag("y", m).over(along())).withColumn("d", F.col("y") - F.lag("y", 1).over(along()))
    out = []
    for name, size, spread, tiny in (("scale", F.abs, F.stddev_pop("y"), 1e-8), ("square_scale", lambda c: F.col(c) * F.col(c), F.var_pop("y"), 1e-12)):
        base = F.when(F.count("y") > m, F.avg(size("s"))).when(F.count("y") > 1, F.avg(size("d"))).otherwise(1.0)
        out.append(F.when(base > tiny, base).when(spread > tiny, spread).otherwise(1.0).alias(name))
    return o.groupBy("series_id").agg(*out)


def safe(scale: Column) -> Column:
    return F.when(scale > 1e-12, scale).otherwise(1.0)


def scaled(scale: str = "scale", square: str = "square_scale") -> dict[str, Column]:
    e = error()
    return {"mase": F.avg(F.abs(e)) / safe(F.first(scale)), "rmsse": F.sqrt(F.avg(e * e) / safe(F.first(square)))}


def interval_score(alpha: float) -> Column:
    lo, hi = F.least("lower", "upper"), F.greatest("lower", "upper")
    return (hi - lo) + F.lit(2 / alpha) * F.greatest(lo - F.col("y"), F.lit(0.0)) + F.lit(2 / alpha) * F.greatest(F.col("y") - hi, F.lit(0.0))


def interval(alpha: float, scale: str | None = "scale") -> dict[str, Column]:
    inside = F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double"))
    out = {"ecp": inside, "coverage_error": F.abs(inside - (1 - alpha)), "width": F.avg(F.col("upper") - F.col("lower")), "mis": F.avg(interval_score(alpha))}
    return out | ({"msis": F.avg(interval_score(alpha)) / safe(F.first(scale))} if scale else {})


def evaluate(rows: DataFrame, by: list[str], alpha: float | None = 0.1) -> DataFrame:
    """All metrics in one aggregation of rows with y, pred, scale, square_scale (and lower, upper)."""
    cols = point() | scaled() | (interval(alpha) if alpha else {})
    return rows.groupBy(*by).agg(F.count("*").alias("n_points"), *[c.alias(k) for k, c in cols.items()])
