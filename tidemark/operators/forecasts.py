"""One-step forecasts that use only what was known before: priors, baselines and residual adapters.

The forecast of a row depends on the rows before it alone, so one window pass
gives fitted values on training rows and rolling forecasts on test rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.windows import RUNNING
from tidemark.plans.substrate import along


def rolling_mean(value: str = "y", window: int = 6) -> Column:
    return F.coalesce(F.avg(value).over(along().rowsBetween(-window, -1)), F.col(value))


def seasonal_naive(value: str = "y", m: int = 12) -> Column:
    return F.coalesce(F.lag(value, m).over(along()), F.lag(value, 1).over(along()), F.col(value))


def naive(value: str = "y") -> Column:
    return F.coalesce(F.lag(value, 1).over(along()), F.col(value))


def expanding_ar1(value: str = "y", least: int = 8) -> tuple[Column, Column]:
    """Intercept and slope of each row's regression on the row before, over all rows before it; null until there are ``least`` pairs."""
    past = along().rowsBetween(RUNNING, -1)
    ok = F.regr_count(F.col(value), F.col("_lag")).over(past) >= least
    return F.when(ok, F.regr_intercept(F.col(value), F.col("_lag")).over(past)), F.when(ok, F.regr_slope(F.col(value), F.col("_lag")).over(past))


def ar1(obs: DataFrame, least: int = 8) -> DataFrame:
    """intercept, slope and pred (the last value while there are too few rows), refitted before every row."""
    o = obs.withColumn("_lag", F.lag("y", 1).over(along()))
    a, b = expanding_ar1("y", least)
    o = o.withColumn("intercept", a).withColumn("slope", b)
    return o.withColumn("pred", F.coalesce(F.col("intercept") + F.col("slope") * F.col("_lag"), F.col("_lag"), F.col("y"))).drop("_lag")


#: name -> forecast of column y
MODELS = {"naive": naive, "seasonal_naive": seasonal_naive, "rolling_mean": rolling_mean}


def compared(obs: DataFrame, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """Forecasts by all models, one row for each series, month and model: model, pred."""
    o = obs
    for m in models:
        o = o.withColumn(m, MODELS[m]())
    return o.unpivot(list(obs.columns), list(models), "model", "pred")


def origins(forecasts: DataFrame) -> DataFrame:
    """Test rows with forecast_origin and information_cutoff: the month before, which is the last one known."""
    f = forecasts.withColumn("information_cutoff", F.lag("ds").over(along())).withColumn("forecast_origin", F.col("information_cutoff"))
    return f.where("split = 'test'").withColumn("target_timestamp", F.col("ds"))


def shrinkage(rows: DataFrame, by: list[str], raw: str, residual: str, most: float = 1.5, signed: bool = False) -> DataFrame:
    """gamma: least-squares factor for raw corrections, held to [0 or -most, most]."""
    ratio = F.sum(F.col(raw) * F.col(residual)) / (F.sum(F.col(raw) * F.col(raw)) + 1e-12)
    return rows.groupBy(*by).agg(F.least(F.greatest(ratio, F.lit(-most if signed else 0.0)), F.lit(most)).alias("gamma"))


def predictability(rows: DataFrame, by: list[str], raw: str, residual: str) -> DataFrame:
    """r2: share of the residuals' variation that the raw corrections explain."""
    from pyspark.sql import Window

    mean = F.avg(residual).over(Window.partitionBy(*by))
    r = rows.withColumn("_m", mean)
    return r.groupBy(*by).agg((1 - F.sum((F.col(residual) - F.col(raw)) ** 2) / (F.sum((F.col(residual) - F.col("_m")) ** 2) + 1e-12)).alias("r2"))


def selected(scores: DataFrame, least_r2: float = float("-inf"), least_gain: float = float("-inf"), penalty: float = 0.0) -> DataFrame:
    """active and reason from r2, prior_loss and adapted_loss: whether the correction is worth using."""
    s = scores.withColumn("gain", F.col("prior_loss") - F.col("adapted_loss"))
    checks = [("r2", F.col("r2") > least_r2), ("gain", F.col("gain") > least_gain), ("penalty", F.col("adapted_loss") + penalty < F.col("prior_loss"))]
    ok = F.lit(True)
    for _, c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    why = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks]))
    return s.withColumn("active", ok).withColumn("reason", F.when(F.size(why) == 0, "active").otherwise(F.concat_ws("+", why)))
