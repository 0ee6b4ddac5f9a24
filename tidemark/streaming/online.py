"""Online use of the same operators by Structured Streaming.

``monthly``: transactions to monthly sums with a watermark for late rows.
``forecasts``: one-step forecasts with adaptive conformal intervals, series by
series: the forecast for the next row is emitted, and kept as state, before that
row is seen; when it arrives its error updates the interval.  ``states``: the same
state made from rows at rest, from which a stream can go on.
"""

from __future__ import annotations

import math
from bisect import insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "history array<double>, scores array<double>, alpha double, pred double, half double, last_ds date, n int"
OUT = "series_id string, ds date, y double, pred double, lower double, upper double, alpha double, n_scores int, status string"


def daily(events: DataFrame, key: str, time: str, value: str, late: str = "1 day") -> DataFrame:
    """Sums by key and day; a day is final when rows ``late`` past its end have come."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    g = e.groupBy(F.window("_t", "1 day").alias("w"), F.col(key).cast("string").alias("series_id")).agg(F.sum(value).alias("y"), F.count("*").alias("n_rows"))
    return g.select("series_id", F.to_date("w.start").alias("ds"), "y", "n_rows")


def monthly(events: DataFrame, key: str, time: str, value: str, late: str = "10 days") -> DataFrame:
    """Running sums by key and month, for update or complete output; ``late`` bounds the state kept for each day."""
    return daily(events, key, time, value, late).groupBy("series_id", F.last_day("ds").alias("ds")).agg(F.sum("y").alias("y"))


class Forecaster(StatefulProcessor):
    """Rolling mean of ``window`` values with adaptive intervals; a row that does not come after the last one is late and changes nothing."""

    def __init__(self, window: int = 6, target: float = 0.1, rate: float = 0.05, low: float = 0.01, high: float = 0.5):
        self.window, self.target, self.rate, self.low, self.high = window, target, rate, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((list(map(float, r["history"])), list(map(float, r["scores"])), float(r["alpha"]), float(r["pred"]), float(r["half"]), r["last_ds"], int(r["n"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ds")
        state, out = self.after(key[0], new, self.state.get() if self.state.exists() else None)
        self.state.update(state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def after(self, key: str, new: pd.DataFrame, state: tuple | None) -> tuple[tuple, list[tuple]]:
        """The state after rows in order of ds, and a row of OUT for each."""
        if state is not None:
            history, scores, alpha, _, _, last, n = state
            history, scores = list(history), list(scores)
        else:
            history, scores, alpha, last, n = [], [], self.target, None, 0
        out = []
        for ds, y in zip(new["ds"], new["y"]):
            if last is not None and ds <= last:
                out.append((key, ds, y, None, None, None, alpha, len(scores), "late"))
                continue
            pred = sum(history) / len(history) if history else y
            half = self._half(scores, alpha)
            out.append((key, ds, y, pred, pred - half, pred + half, alpha, len(scores), "ok"))
            miss = abs(y - pred) > half
            alpha = min(max(alpha + self.rate * (self.target - miss), self.low), self.high)
            insort(scores, abs(y - pred))
            history, last, n = [*history, y][-self.window :], ds, n + 1
        pred = sum(history) / len(history) if history else 0.0
        return (history, scores, alpha, pred, self._half(scores, alpha), last, n), out

    @staticmethod
    def _half(scores: list[float], alpha: float) -> float:
        n = len(scores)
        return scores[min(max(math.ceil((n + 1) * (1 - alpha)), 1), n) - 1] if n else 0.0

    def close(self) -> None:
        pass


def states(observations: DataFrame, window: int = 6, target: float = 0.1, rate: float = 0.05) -> DataFrame:
    """The state of each series after (series_id, ds, y) at rest: to be kept as a table, and given to ``forecasts`` as where a stream begins."""
    f = Forecaster(window, target, rate)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        state, _ = f.after(g.series_id.iloc[0], g.sort_values("ds"), None)
        return pd.DataFrame([(g.series_id.iloc[0], *state)], columns=["series_id", *(c.split()[0] for c in STATE.split(", "))])

    return observations.groupBy("series_id").applyInPandas(run, f"series_id string, {STATE}")


def forecasts(observations: DataFrame, window: int = 6, target: float = 0.1, rate: float = 0.05, initial: DataFrame | None = None) -> DataFrame:
    """Forecasts of a stream of (series_id, ds, y), from ``initial`` states if given. Needs the RocksDB state store."""
    begin = initial.groupBy("series_id") if initial is not None else None
    return observations.groupBy("series_id").transformWithStateInPandas(Forecaster(window, target, rate), OUT, "append", "none", initialState=begin)
