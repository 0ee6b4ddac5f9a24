"""Fitted models at rest: a row of state for each series, from which forecasts go on.

``states`` fits the sketch or reservoir model on all rows of a table and keeps
what the next forecast needs: the readout, the tails of history and residuals,
the recursions' last values, and the interval's scores.  ``ahead`` runs from
there for several months, feeding its own forecasts back;
``streaming.adapted`` goes on with what arrives.  One step of one series is plain
numpy (``Adapter``); all series are rows of a table, and nothing is gathered.
"""

from __future__ import annotations

import datetime as dt
import json
import math
from bisect import insort
from calendar import monthrange
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import forecasts, models
from tidemark.operators.models import SCALES, SELECTION

#: Of a row of states: what is fitted stays, the rest moves on.
STATE = (
    "kind string, settings string, weights array<double>, constant double, centre array<double>, scale array<double>, gate array<double>, active boolean, "
    "t int, last_ds date, history array<double>, residuals array<double>, recursion array<double>, spread array<double>, scores array<double>, alpha double"
)
NAMES = [c.split()[0] for c in STATE.split(", ")]
STATES = f"series_id string, {STATE}, status string, error string"

#: Priors by name, of the values so far.
PRIORS = {
    "rolling_mean": lambda y, s: float(np.mean(y[-s["window"] :])),
    "seasonal_naive": lambda y, s: float(y[-s["m"]] if len(y) >= s["m"] else y[-1]),
    "naive": lambda y, s: float(y[-1]),
}


class Adapter:
    """One series' fitted model; ``state`` is a row of STATE."""

    def __init__(self, state: dict):
        self.__dict__.update({k: list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for k, v in state.items()})
        self.s = json.loads(self.settings)
        self.t, self.active = int(self.t), bool(self.active)
        self.last: dict | None = None

    @staticmethod
    def bare(prior: str = "rolling_mean", **settings) -> "Adapter":
        """Of a series that was never fitted: its prior, and intervals from no scores."""
        s = {"prior": prior, "window": 6, "m": 12, "target": 0.1, "rate": 0.05, "low": 0.01, "high": 0.5} | settings
        return Adapter({"kind": "none", "settings": json.dumps(s), "weights": [], "constant": 0.0, "centre": [], "scale": [], "gate": [], "active": False, "t": 0, "last_ds": None, "history": [], "residuals": [], "recursion": [], "spread": [], "scores": [], "alpha": s["target"]})

    def row(self) -> tuple:
        return tuple(getattr(self, k) for k in NAMES)

    def _features(self) -> np.ndarray:
        """What ``models.featured`` and its means have in the last row."""
        e, t, s, out = self.residuals, self.t - 1, self.s, {}
        back = lambda k: e[-1 - k] if t >= k else None
        for k in range(1, s["lags"] + 1):
            out[f"lag{k}"] = back(k) or 0.0
        if self.kind == "sketch":
            for k in s["spans"]:
                out[f"momentum{k}"] = e[-1] - back(k) if t >= k else 0.0
            for k in s["scales"]:
                w = np.array(e[-min(k, t + 1) :])
                h = len(w) // 2
                out |= {f"mean{k}": w.mean(), f"slope{k}": w[-1] - w[0], f"contrast{k}": w[h:].mean() - w[:h].mean() if h else 0.0, f"energy{k}": np.abs(w).mean()}
            m = s["m"]
            out |= {"seasonal": back(m) or 0.0, "seasonal_gap": e[-1] - back(m) if t >= m else 0.0, "season_sin": math.sin(2 * math.pi * t / m), "season_cos": math.cos(2 * math.pi * t / m)}
            out |= dict(zip(models._mean_columns(tuple(s["means"])), self.recursion))
            x = (np.array([out[c] for c in s["used"]]) - self.centre) / self.scale
            return np.nan_to_num(x)
        parts = {"reservoir": self.recursion, "ar": [out[f"lag{k}"] for k in range(1, s["lags"] + 1)]}
        return np.array([v for part, values in parts.items() if part not in s["without"] for v in values])

    def _gate(self) -> float:
        if self.kind == "sketch" or len(self.gate) == 1:
            return self.gate[0]
        a, c = self.gate
        z = np.nan_to_num((self._volatility() - self.centre[1]) / self.scale[1])
        return float(1 / (1 + np.exp(np.clip(a * (z - c), -50, 50))))

    def _volatility(self) -> float:
        m, v, w = self.spread
        return math.sqrt(max((v - m * m) / (1 - w), 0.0)) if w < 1 else 0.0

    def half(self) -> float:
        n = len(self.scores)
        return self.scores[min(max(math.ceil((n + 1) * (1 - min(max(self.alpha, 1e-6), 1.0))), 1), n) - 1] if n else 0.0

    def predict(self) -> dict:
        """p (prior), raw, gate, pred, half of the next row."""
        p = PRIORS[self.s["prior"]](self.history, self.s) if self.history else float("nan")
        raw, gate = 0.0, 0.0
        if self.kind != "none" and len(self.weights) and self.residuals:
            raw, gate = float(self._features() @ np.array(self.weights) + self.constant), self._gate()
        self.last = {"p": p, "raw": raw, "gate": gate, "pred": p + gate * raw if self.active else p, "half": self.half()}
        return self.last

    def see(self, y: float, observed: bool = True) -> None:
        """The next row's value: the recursions move on; the interval only with what is ``observed``."""
        f = self.last or self.predict()
        if math.isnan(f["p"]):
            f = f | {"p": y, "pred": y}
        if observed:
            miss = abs(y - f["pred"]) > f["half"]
            self.alpha = min(max(self.alpha + self.s["rate"] * (self.s["target"] - miss), self.s["low"]), self.s["high"])
            insort(self.scores, abs(y - f["pred"]))
        self.move(y, y - f["p"])
        self.last = None

    def move(self, y: float, e: float) -> None:
        """History, residuals and recursions after a value and its residual; intervals stay."""
        s = self.s
        self.history = [*self.history, y][-max(s["window"], s["m"]) :]
        self.residuals = [*self.residuals, e][-s.get("tail", 1) :]
        if self.kind == "sketch":
            sides = [(span, v) for v in (e, abs(e)) for span in s["means"]]
            self.recursion = [v if self.t == 0 else 2 / (span + 1) * v + (1 - 2 / (span + 1)) * old for (span, v), old in zip(sides, self.recursion or [0.0] * len(sides))]
        elif self.kind == "reservoir":
            a = 2 / 5  # the weight of a span of 4
            if self.t == 0:
                self.spread = [e, e * e, 1.0]
            else:
                m, v, w = self.spread
                self.spread = [a * e + (1 - a) * m, a * e * e + (1 - a) * v, (1 - a) ** 2 * w + a * a]
            if len(self.weights):
                w_in, w_res = _weights(s["size"], s["radius"], s["seed"])
                z = float(np.nan_to_num((e - self.centre[0]) / self.scale[0]))
                h = np.array(self.recursion or [0.0] * s["size"])
                self.recursion = ((1 - s["leak"]) * h + s["leak"] * np.tanh(w_in @ np.array([1.0, z]) + w_res @ h)).tolist()
        self.t += 1


_made: dict[tuple, tuple] = {}


def _weights(size: int, radius: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    if (size, radius, seed) not in _made:
        _made.clear()
        _made[size, radius, seed] = models.reservoir_weights(size, radius, seed)
    return _made[size, radius, seed]


def states(obs: DataFrame, kind: str = "sketch", *, prior: str = "rolling_mean", window: int = 6, m: int = 12, ratio: float = 0.7, lags: int = 3, spans: tuple[int, ...] = (2, 4), scales: tuple[int, ...] = SCALES, means: tuple[int, ...] = (), size: int = 20, radius: float = 0.8, leak: float = 0.5, seed: int = 7, alpha: float = 1.0, most_gamma: float = 1.5, readout: str = "ridge", search: str = "grid", without: tuple[str, ...] = (), target: float = 0.1, rate: float = 0.05, **selection: float) -> DataFrame:
    """The fitted model of each series of (series_id, ds, t, n, y), after its last row: STATES.

    The same fit as ``models.sketch`` or ``models.reservoir`` makes of these rows
    as its training part; the interval's scores are those of the conformal block,
    in order.  A series on which the fit fails has status failed and the state of
    its bare prior.
    """
    if kind not in ("sketch", "reservoir"):
        raise ValueError(f"unknown kind: {kind}")
    column = {"rolling_mean": lambda: forecasts.rolling_mean("y", window), "seasonal_naive": lambda: forecasts.seasonal_naive("y", m), "naive": forecasts.naive}[prior]()
    fitting = {"without": list(without), "alpha": alpha, "most_gamma": most_gamma, "readout": readout, "search": search, "size": size, "radius": radius, "leak": leak, **SELECTION, **selection}
    own = {"prior": prior, "window": window, "m": m, "lags": lags, "spans": list(spans), "scales": list(scales), "means": list(means), "seed": seed, "target": target, "rate": rate, "low": 0.01, "high": 0.5, "tail": max([lags, m, *spans, *scales]) + 1, **fitting}
    if kind == "sketch":
        o, cols = models._sketched(obs, 0, ratio, [""], spans, scales, None, column, ends=True, lags=lags)
    else:
        o, cols = models._reservoired(obs, 0, ratio, lags, [""], column)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        status, error = "ok", None
        try:
            if kind == "sketch":
                g = models._with_means(g, means)
                f = models._sketch_fit(g, cols + models._mean_columns(means), fitting)
                gate, s, c = [f["gamma"]], own | {"used": f["used"]}, f
            else:
                f = models._reservoir_fit(g, cols, fitting, lags, seed)
                gate, s, c = list(f["shape"] or [1.0 if len(f["w"]) else 0.0]), own, f
            a = Adapter({"kind": kind, "settings": json.dumps(s, default=str), "weights": c["w"].tolist(), "constant": float(c["b"]), "centre": c["centre"].tolist(), "scale": c["scale"].tolist(), "gate": [float(x) for x in gate], "active": c["active"], "t": 0, "last_ds": None, "history": [], "residuals": [], "recursion": [], "spread": [], "scores": [], "alpha": target})
        except Exception as e:  # any error of one series' model is that series' result
            status, error, a = "failed", f"{type(e).__name__}: {e}", Adapter.bare(**{k: v for k, v in own.items() if k in ("prior", "window", "m", "target", "rate", "low", "high")})
        # the block of a row is that of the month after it
        blocks = ["", *g.block.tolist()[:-1]]
        for y, e, block in zip(g.y.tolist(), g.e.tolist(), blocks):
            if block == "conformal":
                a.predict()
                a.see(y)
            else:
                a.move(y, e)
        a.last_ds = g.ds.iloc[-1]
        return pd.DataFrame([(g.series_id.iloc[0], *a.row(), status, error)], columns=["series_id", *NAMES, "status", "error"])

    return o.groupBy("series_id").applyInPandas(fit, STATES)


AHEAD = "series_id string, step int, ds date, p double, pred double, lower double, upper double"


def next_month_end(day: dt.date) -> dt.date:
    year, month = (day.year + 1, 1) if day.month == 12 else (day.year, day.month + 1)
    return dt.date(year, month, monthrange(year, month)[1])


def ahead(fitted: DataFrame, steps: int = 12) -> DataFrame:
    """Forecasts of the ``steps`` months after each state's last row: series_id, step (from 1), ds, p (prior), pred, lower, upper.

    Each forecast is taken for the value of its month by those after it; the
    intervals' scores and level stay as they are, as nothing is observed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                a, day = Adapter({k: r[k] for k in NAMES}), r["last_ds"]
                for step in range(1, steps + 1):
                    f, day = a.predict(), next_month_end(day)
                    out.append((r["series_id"], step, day, f["p"], f["pred"], f["pred"] - f["half"], f["pred"] + f["half"]))
                    a.see(f["pred"], observed=False)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in AHEAD.split(", ")])

    return fitted.mapInPandas(run, AHEAD)


def priors_ahead(obs: DataFrame, steps: int = 12, window: int = 6, m: int = 12, names: tuple[str, ...] = ("naive", "rolling_mean", "seasonal_naive")) -> DataFrame:
    """The same for priors alone, as folds over the last rows of each series: series_id, model, step, ds, pred.

    The rolling mean takes its own forecasts in; seasonal values repeat, or the
    last one where there is less than a season.
    """
    if unknown := [x for x in names if x not in PRIORS]:
        raise ValueError(f"unknown prior: {', '.join(unknown)}")
    last = obs.where(F.col("t") >= F.col("n") - max(window, m))
    g = last.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"].cast("double")).alias("v"), F.max("ds").alias("end"))
    tail = lambda v, k: F.slice(v, F.greatest(F.size(v) - k + 1, F.lit(1)), F.least(F.size(v), F.lit(k)))
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    each = {
        "naive": lambda v: F.element_at(v, -1),
        "rolling_mean": lambda v: mean(tail(v, window)),
        "seasonal_naive": lambda v: F.when(F.size(v) >= m, F.get(v, F.size(v) - m)).otherwise(F.element_at(v, -1)),
    }
    # the fold's array grows by the forecasts; it holds max(window, m) + steps values at most
    grown = lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("v"), lambda v, _: F.concat(v, F.array(each[x](v))))
    paths = [F.struct(F.lit(x).alias("model"), grown(x).alias("path")) for x in names]
    e = g.select("series_id", "end", F.size("v").alias("k"), F.explode(F.array(*paths)).alias("x"))
    e = e.select("series_id", "end", "x.model", F.posexplode(F.slice("x.path", F.col("k") + 1, F.lit(steps))).alias("at", "pred"))
    return e.select("series_id", "model", (F.col("at") + 1).alias("step"), F.last_day(F.add_months("end", F.col("at") + 1)).alias("ds"), "pred")


def direct(obs: DataFrame, kind: str | tuple[str, ...], steps: int = 12, width: int = 12, alpha: float = 1.0) -> DataFrame:
    """Forecasts of the ``steps`` months after each series' last, all from its last ``width`` values: one ridge with as many outputs.

    Kinds as ``models.window_regression``; series_id, variant, step, ds, pred,
    status, error.  A series of fewer than width + steps + 2 rows repeats its last value.
    """
    from tidemark.operators import windows

    kinds = (kind,) if isinstance(kind, str) else tuple(kind)
    if unknown := [k for k in kinds if k not in models.KINDS]:
        raise ValueError(f"unknown kind: {', '.join(unknown)}")
    full = windows.direct_windows(obs, width, steps).select("series_id", "t", "x", "target", F.lit(None).cast("date").alias("end"))
    w = Window.partitionBy("series_id").orderBy("ds").rowsBetween(1 - width, 0)
    ends = obs.withColumn("x", F.collect_list("y").over(w)).where(F.col("t") == F.col("n") - 1).select("series_id", "t", "x", F.lit(None).cast(full.schema["target"].dataType).alias("target"), F.col("ds").alias("end"))
    o = full.unionByName(ends).withColumn("variant", F.explode(F.array(*[F.lit(k) for k in kinds])))
    names = ["series_id", "variant", "step", "ds", "pred", "status", "error"]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        end, train = g[g.end.notna()].iloc[0], g[g.end.isna()]
        days = [end.end]
        for _ in range(steps):
            days.append(next_month_end(days[-1]))
        status, error, pred = "ok", None, np.full(steps, float(end.x[-1]))
        try:
            if len(train) >= 3 and len(end.x) == width:
                pred = models.windowed(end.variant, np.array(train.x.tolist(), float), np.array(train.target.tolist(), float), np.array([end.x], float), alpha)[0]
        except Exception as e:  # any error of one series' model is that series' result
            status, error, pred = "failed", f"{type(e).__name__}: {e}", np.full(steps, np.nan)
        return pd.DataFrame({"series_id": end.series_id, "variant": end.variant, "step": range(1, steps + 1), "ds": days[1:], "pred": pred, "status": status, "error": error})[names]

    return o.groupBy("series_id", "variant").applyInPandas(fit, "series_id string, variant string, step int, ds date, pred double, status string, error string")
