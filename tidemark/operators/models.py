"""Residual-correcting forecasters, fitted series by series.

The prior, its residuals, features and blocks are columns, made by windows.
What a grouped map is left to do is to solve the ridge system of one series and
to run the reservoir, whose state is a recursion.  All rows are fitted; ``most``
cuts series to their last rows before anything else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forecasts, readouts, splits, windows
from tidemark.plans.substrate import along

SCALES = (2, 3, 6)
#: Rows after which a block of forecasts is given on.
AT_ONCE = 20_000
#: The published defaults of both models, where they differ from those here.
PUBLISHED = {"sketch": {"spans": (2, 4, 8, 12), "scales": (2, 3, 4, 6), "means": (2, 4, 8, 12)}, "reservoir": {"size": 50, "search": "closing"}}


def latest(obs: DataFrame, most: int | None) -> DataFrame:
    """The last ``most`` rows of each series, numbered anew; all without it."""
    if most is None:
        return obs
    before = F.greatest(F.col("n") - most, F.lit(0))
    return obs.where(F.col("t") >= before).withColumn("t", F.col("t") - before).withColumn("n", F.col("n") - before)


def featured(obs: DataFrame, window: int = 6, lags: int = 3, m: int = 12, spans: tuple[int, ...] = (2, 4), scales: tuple[int, ...] = SCALES, prior: Column | None = None) -> tuple[DataFrame, list[str]]:
    """p (``prior``, else the rolling mean), e (residual), target (the next residual) and feature columns that end with the row's own residual."""
    prior = forecasts.rolling_mean("y", window) if prior is None else prior
    o = obs.withColumn("p", prior).withColumn("e", F.col("y") - F.col("p"))
    cols = {f"lag{i}": c for i, c in enumerate(windows.lags("e", lags), 1)}
    cols |= {f"momentum{s}": windows.momentum("e", s) for s in spans}
    for k in scales:
        cols |= {f"{name}{k}": c for name, c in windows.causal("e", k).items()}
    cols["seasonal"], cols["seasonal_gap"] = windows.seasonal("e", m)
    cols["season_sin"], cols["season_cos"] = windows.calendar(m)
    o = o.select("*", *[c.alias(k) for k, c in cols.items()], F.lead("e").over(along()).alias("target"), F.lead("p").over(along()).alias("next_p"), F.lead("ds").over(along()).alias("next_ds"))
    return o, list(cols)


def _ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    return readouts.fitted("ridge", x, y, alpha)


def _scaler(x: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and interquartile range / 1.35 (1 where that vanishes) of the rows ``fit``."""
    q1, c, q3 = np.percentile(x[fit], [25, 50, 75], axis=0)
    s = (q3 - q1) / 1.35
    return c, np.where(s > 1e-8, s, 1.0)


def _scaled(x: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """Columns less their median over interquartile range / 1.35, both of the rows ``fit``."""
    c, s = _scaler(x, fit)
    return np.nan_to_num((x - c) / s)


def _with_means(g: pd.DataFrame, means: tuple[int, ...]) -> pd.DataFrame:
    """Adds exponential means of the residual (ema<span>) and of its size (volatility<span>) to one series' rows in order."""
    e = g.e.astype(float)
    return g.assign(**{f"ema{s}": e.ewm(span=s, adjust=False).mean() for s in means}, **{f"volatility{s}": e.abs().ewm(span=s, adjust=False).mean() for s in means})


def _mean_columns(means: tuple[int, ...]) -> list[str]:
    return [f"{name}{s}" for name in ("ema", "volatility") for s in means]


def group(column: str) -> str:
    """Feature group of a column: ar, ema, volatility, momentum, seasonal, calendar or causal."""
    for start, name in (("lag", "ar"), ("ema", "ema"), ("volatility", "volatility"), ("momentum", "momentum"), ("season_", "calendar"), ("seasonal", "seasonal")):
        if column.startswith(start):
            return name
    return "causal"


OUT = "series_id string, ds date, y double, p double, raw double, gate double, pred double, block string, active boolean, status string, error string"


def captured(fit, schema: str, block: str = "block"):
    """``fit`` for a grouped map, with status ok; a series on which it raises gets one row at its first test month: failed, with the error, without a forecast."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        try:
            out = fit(g)
            out["status"], out["error"] = "ok", None
        except Exception as e:  # any error of one series' model is that series' result
            g = g.sort_values("t")
            first = g[g[block] == "test"].head(1) if (g[block] == "test").any() else g.tail(1)
            out = pd.DataFrame({c: first[c].to_numpy() if c in ("series_id", "variant") else [None] for c in names})
            out["ds"], out["status"], out["error"] = first.next_ds.to_numpy() if "next_ds" in first else first.ds.to_numpy(), "failed", f"{type(e).__name__}: {e}"
            if "block" in names:
                out["block"] = "test"
        return out[names]

    return run


def _settings(variants: dict[str, tuple[str, ...] | dict] | None, defaults: dict) -> dict[str, dict]:
    """Every variant's settings: a tuple names what is left out, a dict may change any default."""
    return {k: {"without": (), **defaults, **(v if isinstance(v, dict) else {"without": v})} for k, v in (variants or {"": ()}).items()}


def _worth(target: np.ndarray, corrected: np.ndarray, raw: np.ndarray, least_r2: float, least_gain: float, penalty: float) -> bool:
    """Whether a correction is used, by the rows of the adapter block: as ``forecasts.selected``."""
    prior, adapted = np.abs(target).mean(), np.abs(target - corrected).mean()
    r2 = 1 - ((target - raw) ** 2).sum() / (((target - target.mean()) ** 2).sum() + 1e-12)
    return bool(r2 > least_r2 and prior - adapted > least_gain and adapted + penalty < prior)


def _asked(column: str, s: dict) -> bool:
    """Whether a variant that names its own lags, spans or scales has a column; all others have all."""
    size = int("".join(c for c in column if c.isdigit()) or 0)
    of = {"ar": "lags", "momentum": "spans", "causal": "scales"}.get(group(column))
    if of not in s:
        return True
    return size <= s[of] if of == "lags" else size in s[of]


def _blocks_of(g: pd.DataFrame, s: dict) -> pd.Series:
    """A series' blocks: as they are, or by the variant's own ratio (the rule of ``splits.internal``)."""
    if "ratio" not in s:
        return g.block
    j, n = g.t.to_numpy() + 1, int((g.block != "test").sum()) + 1
    r_end = min(max(np.rint(n * s["ratio"]), 11), n - 6)
    a_end = min(max(r_end + np.rint(n * 0.2), r_end + 3), n - 3)
    own = np.where(j < r_end, "readout", np.where(j < a_end, "adapter", "conformal"))
    return g.block.where(g.block == "test", own)


def _sketch_fit(g: pd.DataFrame, cols: list[str], s: dict) -> dict:
    used = [c for c in cols if group(c) not in s["without"] and _asked(c, s)]
    block = _blocks_of(g, s)
    fit_, adapt = ((block == b).to_numpy() for b in ("readout", "adapter"))
    early = fit_ & (g.t.to_numpy() >= 3)
    k = len(used)
    out = {"used": used, "w": np.zeros(k), "b": 0.0, "centre": np.zeros(k), "scale": np.ones(k), "raw": np.zeros(len(g)), "gamma": 0.0, "active": False}
    if early.sum() > 3 and adapt.any():
        target = g.target.to_numpy(float)
        if used:
            x = g[used].to_numpy(float)
            out["centre"], out["scale"] = _scaler(x, early)
            x = np.nan_to_num((x - out["centre"]) / out["scale"])
            out["w"], out["b"] = readouts.fitted(s["readout"], x[early], target[early], s["alpha"])
            out["raw"] = x @ out["w"] + out["b"]
        r, c = target[adapt], out["raw"][adapt]
        out["gamma"] = float(np.clip((c @ r) / (c @ c + 1e-12), 0.0, s["most_gamma"]))
        out["active"] = _worth(r, out["gamma"] * c, c, s["least_r2"], s["least_gain"], s["penalty"])
    return out


def _blocks(obs: DataFrame, horizon: int, ratio: float) -> DataFrame:
    return splits.internal(splits.tail(obs, horizon).where("split = 'train'").withColumn("n", F.col("n") - horizon), ratio).select("series_id", F.col("ds").alias("next_ds"), "block")


def _sketched(obs: DataFrame, horizon: int, ratio: float, names: list[str], spans: tuple[int, ...], scales: tuple[int, ...], most: int | None, prior: Column | None, ends: bool = False, lags: int = 3) -> tuple[DataFrame, list[str]]:
    obs = latest(obs, most)
    o, cols = featured(obs, lags=lags, spans=spans, scales=scales, prior=prior)
    o = o if ends else o.where(F.col("target").isNotNull())
    o = o.join(_blocks(obs, horizon, ratio), ["series_id", "next_ds"], "left").withColumn("block", F.coalesce("block", F.lit("test")))
    return o.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in names]))), cols


#: When a correction is used: least share explained, least gain, and what the corrected loss is charged.
SELECTION = {"least_r2": float("-inf"), "least_gain": float("-inf"), "penalty": 0.0}


def sketch(obs: DataFrame, horizon: int = 12, alpha: float = 1.0, most_gamma: float = 1.5, ratio: float = 0.7, variants: dict[str, tuple[str, ...] | dict] | None = None, spans: tuple[int, ...] = (2, 4), scales: tuple[int, ...] = SCALES, means: tuple[int, ...] = (), readout: str = "ridge", lags: int = 3, most: int | None = None, prior: Column | None = None, **selection: float) -> DataFrame:
    """A linear readout (see ``readouts``) of window features of the residuals, and of their exponential ``means`` if given, shrunk by a least-squares factor of the adapter block; active as SELECTION (or ``selection``) says.

    One row a target month: p (prior), raw (correction), gate (factor), pred,
    status and error.  ``variants``: feature groups to leave out, or settings
    (without, alpha, most_gamma, readout, ratio, lags, spans and scales among those
    asked for, those of SELECTION), by name; each is fitted, and adds its rows,
    with column variant.
    """
    given = _settings(variants, {"alpha": alpha, "most_gamma": most_gamma, "readout": readout, **SELECTION, **selection})
    o, cols = _sketched(obs, horizon, ratio, list(given), spans, scales, most, prior, lags=lags)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = _with_means(g.sort_values("t"), means)
        f = _sketch_fit(g, cols + _mean_columns(means), given[g.variant.iloc[0]])
        p = g.next_p.to_numpy(float)
        return pd.DataFrame({"series_id": g.series_id, "ds": g.next_ds, "y": p + g.target.to_numpy(float), "p": p, "raw": f["raw"], "gate": f["gamma"], "pred": p + (f["gamma"] if f["active"] else 0.0) * f["raw"], "block": g.block, "active": f["active"], "variant": g.variant})

    schema = f"{OUT}, variant string"
    out = o.groupBy("series_id", "variant").applyInPandas(captured(fit, schema), schema)
    return out if variants else out.drop("variant")


def importance(obs: DataFrame, horizon: int = 12, alpha: float = 1.0, ratio: float = 0.7, spans: tuple[int, ...] = (2, 4), scales: tuple[int, ...] = SCALES, means: tuple[int, ...] = (), most: int | None = None) -> DataFrame:
    """Each feature's weight in the sketch model: series_id, feature, feature_group, weight (on robustly scaled columns), size; parameters (weights, constant and factor) of the series' model."""
    given = _settings(None, {"alpha": alpha, "most_gamma": 1.5, "readout": "ridge", **SELECTION})[""]
    o, cols = _sketched(obs, horizon, ratio, [""], spans, scales, most, None)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = _with_means(g.sort_values("t"), means)
        f = _sketch_fit(g, cols + _mean_columns(means), given)
        return pd.DataFrame({"series_id": g.series_id.iloc[0], "feature": f["used"], "feature_group": [group(c) for c in f["used"]], "weight": f["w"], "size": np.abs(f["w"]), "parameters": len(f["w"]) + 2})

    return o.groupBy("series_id").applyInPandas(fit, "series_id string, feature string, feature_group string, weight double, size double, parameters int")


def reservoir_weights(size: int, radius: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Input and inner weights of a reservoir: the same for a seed wherever they are made."""
    rng = np.random.default_rng(seed)
    w_in, w_res = rng.uniform(-1, 1, (size, 2)), rng.normal(size=(size, size))
    return w_in, w_res * (min(max(radius, 1e-6), 0.999) / max(np.abs(np.linalg.eigvals(w_res)).max(), 1e-12))


#: Points of the gate's grid: steepness and middle.
GATES = [(a, c) for a in (0.25, 1.0, 4.0) for c in (-2.0, -1.0, 0.0, 1.0, 2.0)]


def _reservoir_fit(g: pd.DataFrame, keep: list[str], s: dict, lags: int, seed: int) -> dict:
    without, size, leak = s["without"], int(s["size"]), s["leak"]
    keep, lags = [c for c in keep if _asked(c, s)], s.get("lags", lags)
    block = _blocks_of(g, s)
    fit_, adapt = ((block == b).to_numpy() for b in ("readout", "adapter"))
    e, target = g.e.to_numpy(float), g.target.to_numpy(float)
    early = fit_ & (g.t.to_numpy() >= lags)
    out = {"raw": np.zeros(len(g)), "gate": np.zeros(len(g)), "active": False, "w": np.zeros(0), "b": 0.0, "centre": np.zeros(2), "scale": np.ones(2), "shape": None, "state": np.zeros(size)}
    if early.sum() > 3 and adapt.any():
        w_in, w_res = reservoir_weights(size, s["radius"], seed)
        both = np.column_stack([e, g.ewm_std.to_numpy(float)])
        out["centre"], out["scale"] = _scaler(both, early)
        z, vol = np.nan_to_num((both - out["centre"]) / out["scale"]).T
        h, states = np.zeros(size), []
        for v in z:
            h = (1 - leak) * h + leak * np.tanh(w_in @ np.array([1.0, v]) + w_res @ h)
            states.append(h)
        parts = {"reservoir": np.array(states), "ar": g[keep].to_numpy(float)}
        x = np.column_stack([v for part, v in parts.items() if part not in without])
        out["w"], out["b"] = readouts.fitted(s["readout"], x[early], target[early], s["alpha"])
        out["raw"] = raw = x @ out["w"] + out["b"]
        gate = lambda a, c: 1 / (1 + np.exp(np.clip(a * (vol - c), -50, 50)))
        if "gate" in without:
            out["gate"] = np.ones(len(g))
        else:
            losses = [(np.abs(target - gate(*shape) * raw)[adapt].mean(), i) for i, shape in enumerate(GATES)]
            out["shape"] = GATES[min(losses)[1]] if s["search"] == "grid" else readouts.steepness(target[adapt], raw[adapt], vol[adapt], GATES)
            out["gate"] = gate(*out["shape"])
        out["active"] = _worth(target[adapt], (out["gate"] * raw)[adapt], raw[adapt], s["least_r2"], s["least_gain"], s["penalty"])
        out["state"] = h
    return out


def _reservoired(obs: DataFrame, horizon: int, ratio: float, lags: int, names: list[str], prior: Column | None) -> tuple[DataFrame, list[str]]:
    o, cols = featured(obs, lags=lags, prior=prior)
    spread = windows.ewm_std(o.select("series_id", "ds", "t", "e"), "e", 4).select("series_id", "ds", "ewm_std")
    keep = [c for c in cols if c.startswith("lag")]
    o = o.select("series_id", "ds", "t", "n", "y", "p", "e", "target", "next_p", "next_ds", *keep).join(spread, ["series_id", "ds"])
    o = o.join(_blocks(obs, horizon, ratio), ["series_id", "next_ds"], "left").withColumn("block", F.coalesce("block", F.lit("test")))
    return o.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in names]))), keep


def reservoir(obs: DataFrame, horizon: int = 12, size: int = 20, radius: float = 0.8, leak: float = 0.5, lags: int = 3, alpha: float = 1.0, ratio: float = 0.7, seed: int = 7, variants: dict[str, tuple[str, ...] | dict] | None = None, readout: str = "ridge", search: str = "grid", most: int | None = None, prior: Column | None = None, **selection: float) -> DataFrame:
    """A linear readout (see ``readouts``) of the states of a leaky reservoir driven by the residuals, and of their lags; gated by the residuals' recent spread.

    gate = 1 / (1 + exp(a (z - b))) falls with volatility z; a and b are the best
    of a grid on the adapter block, or with ``search`` closing of one that closes in
    around its best points.  ``variants``: parts to leave out (reservoir,
    ar or gate), or settings (without, size, radius, leak, alpha, readout, search,
    ratio, lags up to those asked for, those of SELECTION), by name; each is fitted,
    and adds its rows, with column variant.
    """
    given = _settings(variants, {"size": size, "radius": radius, "leak": leak, "alpha": alpha, "readout": readout, "search": search, **SELECTION, **selection})
    o, keep = _reservoired(latest(obs, most), horizon, ratio, lags, list(given), prior)

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        f = _reservoir_fit(g, keep, given[g.variant.iloc[0]], lags, seed)
        p = g.next_p.to_numpy(float)
        return pd.DataFrame({"series_id": g.series_id, "ds": g.next_ds, "y": p + g.target.to_numpy(float), "p": p, "raw": f["raw"], "gate": f["gate"], "pred": p + np.where(f["active"], f["gate"], 0.0) * f["raw"], "block": g.block, "active": f["active"], "variant": g.variant})

    schema = f"{OUT}, variant string"
    out = o.where(F.col("target").isNotNull()).groupBy("series_id", "variant").applyInPandas(captured(fit, schema), schema)
    return out if variants else out.drop("variant")


def custom(obs: DataFrame, predict, horizon: int = 12) -> DataFrame:
    """One-step forecasts of test rows by ``predict(history) -> float``, called with what came before each; status and error as ``captured``.

    ``predict`` may be a dict of such functions: all see a series in one pass, and
    ``model`` tells their rows apart.  A series is one row with its values, so a
    task goes through its series in a loop, without a data frame for each.
    """
    several = isinstance(predict, dict)
    each = list(predict.items()) if several else [("", predict)]
    o = splits.tail(obs, horizon).select(F.col("series_id").cast("string").alias("series_id"), "t", F.col("ds").cast("date").alias("ds"), F.col("y").cast("double").alias("y"), (F.col("split") == "test").cast("int").alias("test"))
    o = o.groupBy("series_id").agg(F.sum("test").alias("n_test"), F.sort_array(F.collect_list(F.struct("t", "ds", "y"))).alias("v"))
    o = o.select("series_id", "n_test", F.col("v.ds").alias("ds"), F.col("v.y").alias("y"))
    schema = f"series_id string, {'model string, ' if several else ''}ds date, y double, pred double, status string, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = b.column("y").offsets.to_numpy()
            values = b.column("y").values.to_numpy(zero_copy_only=False).astype(float)
            tests = b.column("n_test").to_pylist()
            rows, places, preds, models, errors = [], [], [], [], []

            def block() -> pa.RecordBatch:
                ok = np.array([e is None for e in errors], bool)
                cols = {
                    "series_id": b.column("series_id").take(pa.array(rows, pa.int64())),
                    "model": pa.array(models, pa.string()),
                    "ds": b.column("ds").values.take(pa.array(places, pa.int64())),
                    "y": pa.array(np.where(ok, values[np.array(places, np.int64)], np.nan), pa.float64(), from_pandas=True),
                    "pred": pa.array(np.array(preds, float), pa.float64(), from_pandas=True),
                    "status": pa.array(np.where(ok, "ok", "failed"), pa.string()),
                    "error": pa.array(errors, pa.string()),
                }
                return pa.RecordBatch.from_arrays([cols[k] for k in names], names)

            for i, n_test in enumerate(tests):
                begin, end = int(ends[i]), int(ends[i + 1])
                for name, f in each:
                    y = values[begin:end].copy()
                    try:
                        own, error = [float(f(y[:k])) for k in range(len(y) - n_test, len(y))], None
                    except Exception as e:  # any error of one series' model is that series' result
                        own, error = [np.nan], f"{type(e).__name__}: {e}"
                    m, first = len(own), end - n_test
                    rows += [i] * m
                    places += range(first, first + m)
                    preds += own
                    models += [name] * m
                    errors += [error] * m
                if len(rows) >= AT_ONCE:
                    yield block()
                    rows, places, preds, models, errors = [], [], [], [], []
            if rows:
                yield block()

    return o.mapInArrow(run, schema)


def walked(predict, least: int = 3, m: int = 12, fall_back: str = "last"):
    """``predict`` for ``custom``, with a fall-back while there are fewer than ``least`` values or where it raises or gives no finite number.

    fall_back: last, seasonal (the value m before, if there are more than m) or mean.
    """

    def run(y: np.ndarray) -> float:
        plain = {"last": y[-1], "seasonal": y[-m] if len(y) > m else y[-1], "mean": y.mean()}[fall_back]
        if len(y) < least:
            return y[-1]
        try:
            out = float(predict(y))
        except Exception:  # the fall-back is what the caller asked for
            return plain
        return out if np.isfinite(out) else plain

    return run


KINDS = ("linear", "nlinear", "dlinear", "kernel")


def windowed(kind: str, x: np.ndarray, y: np.ndarray, new: np.ndarray, alpha: float) -> np.ndarray:
    """Forecasts from the windows ``new`` by the regression of y (one column for each step) on the windows x."""
    if kind == "kernel":
        c, s = x.mean(), x.std() or 1.0
        near = lambda u, v: np.exp(-((u[:, None, :] - v[None, :, :]) ** 2).sum(2) / x.shape[1])
        z, own = (x - c) / s, (new - c) / s
        return near(own, z) @ np.linalg.solve(near(z, z) + alpha * np.eye(len(z)), (y - c) / s) * s + c
    base, own_base = np.zeros((len(x), 1)), np.zeros((len(new), 1))
    if kind == "nlinear":
        base, own_base = x[:, -1:], new[:, -1:]
        x, new = x - base, new - own_base
    elif kind == "dlinear":
        k = np.ones(5) / 5
        split = lambda v: (lambda trend: np.hstack([trend, v - trend]))(np.array([np.convolve(np.pad(r, 2, mode="edge"), k, "valid") for r in v]))
        x, new = split(x), split(new)
    mx, my = x.mean(0), (y - base).mean(0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - base - my))
    return (new - mx) @ w + my + own_base


def window_regression(obs: DataFrame, kind: str | tuple[str, ...], width: int = 12, horizon: int = 12, alpha: float = 1.0, most: int | None = None) -> DataFrame:
    """One-step forecasts of test rows by regression on the ``width`` values before each.

    linear: ridge on the window; nlinear: on its differences from its last
    value; dlinear: on its running mean and what that leaves; kernel: ridge with
    a Gaussian kernel on the standardised window.  Windows are columns; a
    grouped map solves one series' system.  Several kinds are fitted in one pass,
    and told apart by column variant.
    """
    kinds = (kind,) if isinstance(kind, str) else tuple(kind)
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"unknown kind: {', '.join(unknown)}")
    o = splits.tail(latest(obs, most), horizon).withColumn("x", F.collect_list("y").over(along().rowsBetween(-width, -1)))
    o = o.where(F.size("x") == width).select("series_id", "ds", "t", "y", "split", "x", F.explode(F.array(*[F.lit(k) for k in kinds])).alias("variant"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t")
        kind = g.variant.iloc[0]
        x, y, train = np.array(g.x.tolist(), float), g.y.to_numpy(float), (g.split == "train").to_numpy()
        pred = x[:, -1] if train.sum() < 3 else windowed(kind, x[train], y[train, None], x, alpha)[:, 0]
        test = ~train
        return pd.DataFrame({"series_id": g.series_id[test], "ds": g.ds[test], "y": y[test], "pred": pred[test], "variant": kind})

    schema = "series_id string, ds date, y double, pred double, status string, error string, variant string"
    out = o.groupBy("series_id", "variant").applyInPandas(captured(fit, schema, "split"), schema)
    return out.drop("variant") if isinstance(kind, str) else out


def autoregression(obs: DataFrame, lags: int = 3, horizon: int = 12, most: int | None = None) -> DataFrame:
    """Least squares on the last ``lags`` values and a constant, refitted before every test row on all (or the last ``most``) that came before."""

    def predict(y: np.ndarray) -> float:
        y = y if most is None else y[-most:]
        k = min(lags, max(1, len(y) // 3))
        if len(y) < 2 * k + 2:
            return y[-1]
        x = np.column_stack([np.ones(len(y) - k)] + [y[k - i : len(y) - i] for i in range(1, k + 1)])
        w = np.linalg.lstsq(x, y[k:], rcond=None)[0]
        return w[0] + w[1:] @ y[-1 : -k - 1 : -1]

    return custom(obs, predict, horizon)
