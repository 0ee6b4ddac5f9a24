"""Parameters of models: names, namespaces, defaults, and what a series' length allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names under which models and kernels are asked for.
ALIASES = {"easytsf": {"nlinear": "nlinear", "dlinear": "dlinear"}, "kernel": {"pairwise": "rbf", "gaussian": "rbf"}}
#: Settings of a model that is named without any.
DEFAULTS: dict[str, dict] = {
    "naive": {},
    "seasonal_naive": {"m": 12},
    "rolling_mean": {"window": 6},
    "autoregression": {"lags": 3},
    "linear": {"width": 12, "alpha": 1.0},
    "nlinear": {"width": 12, "alpha": 1.0},
    "dlinear": {"width": 12, "alpha": 1.0},
    "kernel": {"width": 12, "alpha": 1.0},
    "sketch": {"alpha": 1.0, "most_gamma": 1.5, "ratio": 0.7},
    "reservoir": {"size": 50, "radius": 0.8, "leak": 0.5, "lags": 3, "alpha": 1.0, "ratio": 0.7},
}
#: What replaces the defaults for series of fewer rows than the key.
SHORT: dict[int, dict] = {24: {"width": 6, "lags": 2, "window": 3, "size": 10}}


def model_name(name: str) -> str:
    """A model's own name for one of its aliases, without regard to case, blanks and dashes; ValueError for unknown ones."""
    plain = name.lower().replace("-", "_").replace(" ", "_")
    family, _, kind = plain.partition("/")
    if kind and kind in ALIASES.get(family, {}):
        return ALIASES[family][kind]
    if plain not in DEFAULTS:
        raise ValueError(f"unknown model: {name}")
    return plain


def settings(name: str, n: int | None = None, **given) -> dict:
    """Defaults of a model, its shorter ones for a series of n rows, and what is given; unknown names raise ValueError."""
    out = dict(DEFAULTS[model_name(name)])
    for limit, short in SHORT.items():
        if n is not None and n < limit:
            out |= {k: v for k, v in short.items() if k in out}
    unknown = [k for k in given if k not in out]
    if unknown:
        raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
    return out | given


def split_namespaces(given: dict) -> tuple[dict, dict]:
    """(model's own, prior's): keys that begin with prior__ belong to the prior."""
    prior = {k.removeprefix("prior__"): v for k, v in given.items() if k.startswith("prior__")}
    return {k: v for k, v in given.items() if not k.startswith("prior__")}, prior


def with_prior(given: dict, prior: str, **prior_settings) -> dict:
    """``given`` with another prior and its settings; all else stays."""
    own, _ = split_namespaces(given)
    return own | {"prior": prior} | {f"prior__{k}": v for k, v in prior_settings.items()}


def feasible(n: Column, m: int = 12, **wanted: Column) -> dict[str, Column]:
    """Settings held to what n rows allow: window (n - 2), order (n / 4), ar_lags (n / 3), state_lags (n / 4), ratio (0.55 to 0.85); seasonal says whether two seasons and two rows are there."""
    clip = lambda v, hi, lo=1: F.greatest(F.lit(lo), F.least(v, hi)).cast("int")
    most = {"window": (n - 2, 1), "order": (F.floor(n / 4), 0), "ar_lags": (F.floor(n / 3), 1), "state_lags": (F.floor(n / 4), 1)}
    out = {k: clip(wanted[k], *most[k]) for k in most if k in wanted}
    if "ratio" in wanted:
        out["ratio"] = F.greatest(F.lit(0.55), F.least(F.lit(0.85), wanted["ratio"]))
    return out | {"seasonal": n >= 2 * m + 2}


def direct_feasible(n: Column, horizon: int, lags: Column, ratio: Column) -> dict[str, Column]:
    """For direct forecasts of ``horizon`` rows: ok (2 h + 5 rows or more), lags (at most n - 2 h - 4) and the share of rows to learn from, within (h + lags + 2) / n to (n - h - 1) / n."""
    h = horizon
    own = F.greatest(F.lit(1), F.least(lags, n - 2 * h - 4)).cast("int")
    return {"ok": n >= 2 * h + 5, "lags": own, "ratio": F.greatest((h + own + 2) / n, F.least((n - h - 1) / n, ratio))}
