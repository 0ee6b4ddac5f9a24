"""Models by name with their usual settings, one table of test forecasts for all."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forecasts, least_squares, models, params, splits


def _plain(column: Callable) -> Callable:
    def run(obs: DataFrame, horizon: int, s: dict) -> DataFrame:
        rows = splits.tail(obs, horizon).withColumn("pred", column(s)).where("split = 'test'")
        return rows.select("series_id", "ds", "y", "pred", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))

    return run


def _windows(kind: str) -> Callable:
    return lambda obs, horizon, s: models.window_regression(obs, kind, s["width"], horizon, s["alpha"])


def _fitted(model: Callable) -> Callable:
    return lambda obs, horizon, s: model(obs, horizon=horizon, **s).where("block = 'test'")


def _regression(obs: DataFrame, horizon: int, s: dict) -> DataFrame:
    rows = least_squares.autoregression(obs, s["lags"], "c", None, horizon, refit=True)
    return rows.select("series_id", "ds", "y", "pred", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"))


#: Name -> test forecasts of (obs, horizon, settings).
RUNNERS = {
    "naive": _plain(lambda s: forecasts.naive()),
    "seasonal_naive": _plain(lambda s: forecasts.seasonal_naive("y", s["m"])),
    "rolling_mean": _plain(lambda s: forecasts.rolling_mean("y", s["window"])),
    "autoregression": _regression,
    **{kind: _windows(kind) for kind in models.KINDS},
    "sketch": _fitted(models.sketch),
    "reservoir": _fitted(models.reservoir),
}


def forecast(obs: DataFrame, names: Sequence[str], horizon: int = 12, given: dict[str, dict] | None = None) -> DataFrame:
    """model, series_id, ds, y, pred, status, error of the last ``horizon`` rows, by models of any known name.

    Settings are those of ``params.settings``: a model's defaults, what ``given`` changes
    by name, and the shorter ones for series with few rows to learn from.  The
    model column has a model's own name, whatever it was asked for by.
    """
    out = None
    limits = sorted(params.SHORT)
    for name in dict.fromkeys(params.model_name(n) for n in names):
        changed = next((v for k, v in (given or {}).items() if params.model_name(k) == name), {})
        known, parts = F.col("n") - horizon, []
        for lo, hi in zip([0, *limits], [*limits, None]):  # series by the settings that their length asks for
            s = params.settings(name, lo, **changed)
            if parts and parts[-1][2] == s:
                parts[-1] = (parts[-1][0], hi, s)
            else:
                parts.append((lo, hi, s))
        for lo, hi, s in parts:
            part = obs.where(known >= lo) if lo else obs
            part = part if hi is None else part.where(known < hi)
            rows = RUNNERS[name](part, horizon, s).select(F.lit(name).alias("model"), "series_id", "ds", "y", "pred", "status", "error")
            out = rows if out is None else out.unionByName(rows)
    return out
