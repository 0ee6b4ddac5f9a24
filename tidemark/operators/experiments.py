"""Experiments as joins of a table of settings with the series, and one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import forecasts, metrics, models, splits
from tidemark.plans.substrate import along


def tried(obs: DataFrame, grid: list[dict], horizon: int = 12) -> DataFrame:
    """Mean error on the last ``horizon`` rows for each series and setting (window, share): a mix of rolling mean and seasonal value.

    Settings are columns of one row each, so all trials run in one pass over the series.
    """
    o = splits.tail(obs, horizon).withColumn("s", forecasts.seasonal_naive())
    for w in sorted({g["window"] for g in grid}):
        o = o.withColumn(f"w{w}", forecasts.rolling_mean("y", w))
    trial = F.explode(F.array(*[F.struct(F.lit(i).alias("trial"), F.lit(g["window"]).alias("window"), F.lit(float(g["share"])).alias("share"), (F.lit(1 - float(g["share"])) * F.col(f"w{g['window']}") + F.lit(float(g["share"])) * F.col("s")).alias("pred")) for i, g in enumerate(grid)]))
    t = o.where("split = 'test'").select("series_id", "y", trial.alias("x")).select("series_id", "y", "x.*")
    return t.groupBy("trial", "window", "share", "series_id").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("score"))


def best_trial(scores: DataFrame) -> DataFrame:
    """Trials by the median score over series, infinite if any series has none; the least first."""
    s = scores.groupBy("trial", "window", "share").agg(F.when(F.count("score") == F.count("*"), F.percentile("score", F.lit(0.5))).otherwise(float("inf")).alias("median"))
    return s.orderBy("median", "trial")


#: Feature groups that a refitted sketch model leaves out.
SKETCHES = {"full": (), "no_ar": ("ar",), "no_momentum": ("momentum",), "no_causal_filters": ("causal",), "no_seasonal": ("seasonal",), "no_calendar": ("calendar",), "no_ema": ("ema",), "no_volatility": ("volatility",), "no_multiscale": ("momentum", "causal")}
#: Parts that a refitted reservoir model leaves out.
RESERVOIRS = {"reservoir_full": (), "reservoir_no_reservoir": ("reservoir",), "reservoir_no_ar_lags": ("ar",), "reservoir_no_gate": ("gate",)}


def ablation(obs: DataFrame, sketch: dict | None = None, reservoir: dict | None = None) -> DataFrame:
    """Errors on test rows of the sketch and reservoir models as they are, refitted without a group, without factor or selection, and of their prior alone."""
    mae = metrics.point()["mae"].alias("mae")
    out = None
    for fitted, full, read in (
        (models.sketch(obs, variants=SKETCHES, **(sketch or {})), "full", {"no_shrinkage": F.col("p") + F.col("raw"), "no_selector": F.col("p") + F.col("gate") * F.col("raw"), "prior_only": F.col("p")}),
        (models.reservoir(obs, variants=RESERVOIRS, **(reservoir or {})), "reservoir_full", {"reservoir_no_selector": F.col("p") + F.col("gate") * F.col("raw"), "reservoir_prior_only": F.col("p")}),
    ):
        own = F.struct(F.col("variant"), F.col("pred"))
        more = F.array(own, *[F.struct(F.lit(k).alias("variant"), c.alias("pred")) for k, c in read.items()])
        rows = fitted.where("block = 'test'").select("series_id", "y", F.explode(F.when(F.col("variant") == full, more).otherwise(F.array(own))).alias("x")).select("series_id", "y", "x.*")
        out = rows if out is None else out.unionByName(rows)
    from pyspark.sql import Window

    mean = F.coalesce(F.avg("y").over(along().rowsBetween(Window.unboundedPreceding, -1)), F.col("y"))
    bare = models.sketch(obs, prior=mean, **(sketch or {})).where("block = 'test'").select("series_id", "y", F.lit("no_foundation").alias("variant"), "pred")
    return out.unionByName(bare).groupBy("variant", "series_id").agg(mae)


def ablation_deltas(errors: DataFrame, full: dict[str, str] | None = None) -> DataFrame:
    """variant, series_id, mae and delta: error less that of the whole model it was taken from (those named reservoir_..., and all others)."""
    from pyspark.sql import Window

    own = F.when(F.col("variant").startswith("reservoir"), "reservoir_full").otherwise("full")
    whole = Window.partitionBy("whole", "series_id")  # not a join, which would fit every model again
    rows = errors.withColumn("whole", own).withColumn("base", F.max(F.when(F.col("variant") == F.col("whole"), F.col("mae"))).over(whole))
    there = F.max((F.col("variant") == F.col("whole")).cast("int")).over(whole) == 1
    return rows.withColumn("there", there).where("there").select("variant", "series_id", "mae", (F.col("mae") - F.col("base")).alias("delta"))


def ablation_tests(errors: DataFrame) -> DataFrame:
    """Each variant against its whole model: pairs, mean and median error, mean delta, the signed-rank test and its adjustment."""
    from tidemark.operators import statistics

    half = errors.groupBy(F.col("variant").alias("model")).agg(F.percentile("mae", F.lit(0.5)).alias("median"))
    out = None
    for whole, mine in (("full", ~F.col("variant").startswith("reservoir")), ("reservoir_full", F.col("variant").startswith("reservoir"))):
        t = statistics.signed_rank_test(errors.where(mine).withColumnRenamed("variant", "model"), "mae", whole)
        out = t if out is None else out.unionByName(t)
    return out.join(half, "model").withColumnRenamed("model", "variant")


def robustness(obs: DataFrame, priors: tuple[str, ...] = ("naive", "seasonal_naive", "rolling_mean")) -> DataFrame:
    """Errors on test rows of each prior, alone and with the mean of its last three residuals added."""
    f = forecasts.compared(splits.tail(obs, 12), priors)
    from pyspark.sql import Window

    w = Window.partitionBy("series_id", "model").orderBy("ds").rowsBetween(-3, -1)
    f = f.withColumn("corrected", F.col("pred") + F.coalesce(F.avg(F.col("y") - F.col("pred")).over(w), F.lit(0.0))).where("split = 'test'")
    e = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    return f.groupBy("model", "series_id").agg(e("pred").alias("prior_only"), e("corrected").alias("corrected"))


def frozen(obs: DataFrame, spark: SparkSession, grid: list[dict]) -> DataFrame:
    """The setting that is best on development series, applied to the others as it is: series_id, trial, score."""
    from tidemark.operators import sampling

    roles = sampling.roles(sampling.series_ids(obs)).select("series_id", "role")
    scores = tried(obs, grid).join(roles, "series_id")
    best = best_trial(scores.where("role = 'development'")).limit(1).select("trial")
    return scores.where("role = 'evaluation'").join(F.broadcast(best), "trial").select("series_id", "trial", "score")  # one row


def next_month(obs: DataFrame) -> DataFrame:
    """The forecast of the month after each series' last, by every prior."""
    o = obs.withColumn("last", F.row_number().over(along()) == F.col("n"))
    o = o.withColumn("rolling_mean", F.avg("y").over(along().rowsBetween(-5, 0))).withColumn("seasonal_naive", F.coalesce(F.lag("y", 11).over(along()), F.col("y"))).withColumn("naive", F.col("y"))
    return o.where("last").select("series_id", F.last_day(F.add_months("ds", 1)).alias("ds"), "rolling_mean", "seasonal_naive", "naive")


def _evaluated(rows: DataFrame, by: list[str]) -> DataFrame:
    """Errors on test rows of (series_id, y, pred, status, and ``by``), null where the model failed; n_failed."""
    ok = F.col("status") == "ok"
    mae = F.avg(F.when(ok, F.abs(F.col("y") - F.col("pred"))))
    failed = F.max((~ok).cast("int"))
    return rows.where("block = 'test'").groupBy(*by).agg(F.when(failed == 0, mae).alias("mae"), failed.alias("n_failed"))


def _both(keyed: DataFrame, sketch: dict | None, reservoir: dict | None, prior: Column | None = None) -> DataFrame:
    """Test rows of both fitted models, and of their prior, for series whose id ends in |key: model, key."""
    out = None
    for name, fit, given in (("sketch", models.sketch, sketch), ("reservoir", models.reservoir, reservoir)):
        own = [F.struct(F.lit(name).alias("model"), F.col("pred"))] + ([F.struct(F.lit("prior").alias("model"), F.col("p").alias("pred"))] if name == "sketch" else [])
        rows = fit(keyed, prior=prior, **(given or {})).select("series_id", "ds", "y", "block", "status", F.explode(F.array(*own)).alias("x"))
        rows = rows.select("series_id", "ds", "y", "x.pred", "block", "status", "x.model")
        out = rows if out is None else out.unionByName(rows)
    key = F.substring_index("series_id", "|", -1).alias("key")
    own = F.col("series_id").substr(F.lit(1), F.length("series_id") - F.length(F.substring_index("series_id", "|", -1)) - 1).alias("series_id")
    return out.select(own, key, "model", "ds", "y", "pred", "block", "status")


def efficiency(obs: DataFrame, sizes: tuple[int, ...] = (36, 60, 84, 120, 160), sketch: dict | None = None, reservoir: dict | None = None) -> DataFrame:
    """Errors of both fitted models and their prior by how much history they were given: histories are series of their own, so all are fitted in one pass."""
    h = splits.histories(obs, sizes).withColumn("series_id", F.concat_ws("|", "series_id", F.col("history").cast("string")))
    h = h.withColumn("t", (F.col("t") - F.col("n") + F.col("history")).cast("int")).withColumn("n", F.col("history").cast("long")).drop("history")
    return _evaluated(_both(h, sketch, reservoir).withColumnRenamed("key", "history"), ["series_id", "history", "model"])


def adapted_priors(obs: DataFrame, priors: tuple[str, ...] = ("naive", "seasonal_naive", "rolling_mean"), sketch: dict | None = None, reservoir: dict | None = None) -> DataFrame:
    """Errors of both fitted models on every prior, and of the priors alone; a failed fit is counted, not left out."""
    o = obs.withColumn("series_id", F.explode(F.array(*[F.concat_ws("|", "series_id", F.lit(p)) for p in priors])))
    prior = F.coalesce(*[F.when(F.endswith("series_id", F.lit(f"|{p}")), forecasts.MODELS[p]()) for p in priors])
    return _evaluated(_both(o, sketch, reservoir, prior).withColumnRenamed("key", "prior"), ["series_id", "prior", "model"])


#: Ranges of the settings that a search tries: low, high, and whether by their logarithm; or a list to choose from.
SPACES = {
    "sketch": {"alpha": (1e-3, 100.0, True), "most_gamma": (0.25, 3.0, False), "lags": (1, 6, False), "ratio": (0.55, 0.8, False), "spans": [(2, 4), (2, 4, 8), (2, 4, 8, 12), (3, 6, 12)], "scales": [(2, 3), (2, 3, 6), (2, 3, 4, 6)], "without": [(), ("calendar",)]},
    "reservoir": {"size": (1, 200, False), "radius": (0.05, 0.99, False), "leak": (0.05, 1.0, False), "alpha": (0.1, 50.0, True), "lags": (2, 12, False), "ratio": (0.6, 0.85, False), "readout": ["ridge", "lasso", "elastic", "bayes"]},
    "window": {"kind": ["linear", "nlinear", "dlinear", "kernel"], "width": (3, 24, False), "alpha": (0.01, 100.0, True)},
    "autoregression": {"lags": (1, 12, False), "trend": ["n", "c", "t", "ct"], "period": [None, 12]},
}
#: Priors that a search over a fitted model tries too.
PRIORS = ["rolling_mean", "seasonal_naive", "naive"]


def _drawn(rng, space: dict, around: dict | None = None, share: float = 1.0) -> dict:
    """One setting from a space; ``around`` another one, within ``share`` of each range about it."""
    import numpy as np

    out = {}
    for name, given in space.items():
        if isinstance(given, list):
            out[name] = given[int(rng.integers(len(given)))] if around is None or rng.uniform() < share else around[name]
            continue
        low, high, log = given
        lo, hi = (np.log(low), np.log(high)) if log else (low, high)
        if around is not None:
            mid, reach = (np.log(around[name]) if log else around[name]), share * (hi - lo) / 2
            lo, hi = max(lo, mid - reach), min(hi, mid + reach)
        x = float(np.exp(rng.uniform(lo, hi)) if log else rng.uniform(lo, hi))
        out[name] = round(x) if isinstance(low, int) else x
    return out


def drawn(kind: str, seed: int) -> dict:
    """One setting from the ranges of SPACES."""
    import numpy as np

    return _drawn(np.random.default_rng(seed), SPACES[kind])


def sampled(kind: str, trials: int, seed: int = 42) -> dict[str, dict]:
    """Settings of ``trials`` trials by name, drawn from the ranges of SPACES; the first has the defaults."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return {"trial0": {}} | {f"trial{i}": _drawn(rng, SPACES[kind]) for i in range(1, trials)}


def fitted_trials(obs: DataFrame, kind: str, settings: dict[str, dict], **given) -> DataFrame:
    """trial, series_id, score: mean error on test rows of the model fitted with each setting, all in one pass; infinite where it failed.

    Columns are made for all lags, spans and scales that any trial asks for, and each
    trial takes its own.
    """
    base = {"lags": 3, "spans": (2, 4), "scales": models.SCALES} if kind == "sketch" else {"lags": 3}
    base |= {k: given.pop(k) for k in list(given) if k in base}
    own = {name: {**base, **s} for name, s in settings.items()}
    wide = {"lags": max(s["lags"] for s in own.values())}
    if kind == "sketch":
        wide |= {k: tuple(sorted({x for s in own.values() for x in s[k]})) for k in ("spans", "scales")}
    rows = {"sketch": models.sketch, "reservoir": models.reservoir}[kind](obs, variants=own, **wide, **given)
    return _evaluated(rows.withColumnRenamed("variant", "trial"), ["trial", "series_id"]).select("trial", "series_id", F.coalesce("mae", F.lit(float("inf"))).alias("score"))


def family_trials(obs: DataFrame, kind: str, settings: dict[str, dict], horizon: int = 12) -> DataFrame:
    """``fitted_trials`` for any family of SPACES; of a fitted model's settings, prior names the prior."""
    from tidemark.operators import least_squares

    out = None
    add = lambda rows: rows if out is None else out.unionByName(rows)
    error = F.avg(F.abs(F.col("y") - F.col("pred")))
    if kind in ("sketch", "reservoir"):
        for prior in sorted({s.get("prior", "rolling_mean") for s in settings.values()}):  # a pass for each prior
            own = {n: {k: v for k, v in s.items() if k != "prior"} for n, s in settings.items() if s.get("prior", "rolling_mean") == prior}
            out = add(fitted_trials(obs, kind, own, horizon=horizon, prior=forecasts.MODELS[prior]()))
        return out
    for name, s in settings.items():  # widths and lags are columns of the plan
        rows = models.window_regression(obs, s["kind"], s["width"], horizon, s["alpha"]) if kind == "window" else least_squares.autoregression(obs, s["lags"], s["trend"], s["period"], horizon)
        scores = splits.tail(obs, horizon).select("series_id").distinct().join(rows.groupBy("series_id").agg(error.alias("score")), "series_id", "left")
        out = add(scores.select(F.lit(name).alias("trial"), "series_id", F.coalesce(F.when(F.isnan("score"), float("inf")).otherwise(F.col("score")), F.lit(float("inf"))).alias("score")))
    return out


def searched(run, obs: DataFrame, kind: str, trials: int = 12, histories: tuple[int | None, ...] = (48, 72, None), share: float = 1 / 3, horizon: int = 12, seed: int = 42) -> DataFrame:
    """Search in rounds: each judges its trials on longer histories (None: all); the best ``share`` goes on, joined by as many new ones drawn close around them.

    round, trial, settings (as JSON), n_series, median (over series; a failed one is
    infinite).  Every round's scores are a table of ``run`` (``runs.Run``), so a
    search that was broken off repeats no round.
    """
    import json

    import numpy as np

    rng, space = np.random.default_rng(seed), SPACES[kind] | ({"prior": PRIORS} if kind in ("sketch", "reservoir") else {})
    settings, out = {f"trial{i}": _drawn(rng, space) for i in range(trials)}, None
    for k, most in enumerate(histories):
        given = {"kind": kind, "history": most, "horizon": horizon, "settings": settings}
        scores = run.table(f"{kind}-round{k}", given, lambda: family_trials(models.latest(obs, most), kind, settings, horizon))
        ranked = scores.groupBy("trial").agg(F.count("*").alias("n_series"), F.percentile("score", F.lit(0.5)).alias("median"))
        text = run.spark.createDataFrame([(n, json.dumps(s)) for n, s in settings.items()], "trial string, settings string")
        one = ranked.join(text, "trial").select(F.lit(k).alias("round"), "trial", "settings", "n_series", "median")
        out = one if out is None else out.unionByName(one)
        best = [r.trial for r in ranked.orderBy("median", "trial").limit(max(1, round(len(settings) * share))).collect()]  # a share of the trials
        if k + 1 < len(histories):
            close = {f"trial{k + 1}_{i}": _drawn(rng, space, settings[name], 0.5 ** (k + 1)) for i, name in enumerate(best)}
            settings = {name: settings[name] for name in best} | close
    return out


def best_setting(scores: DataFrame) -> DataFrame:
    """Trials by the median score over series; the least first, in order of name among equals."""
    return scores.groupBy("trial").agg(F.percentile("score", F.lit(0.5)).alias("median"), F.count("*").alias("n")).orderBy("median", "trial")


def transferred(obs: DataFrame, kind: str, settings: dict[str, dict], **given) -> DataFrame:
    """The setting that is best on development series, applied as it is to those it never saw: series_id, trial, score, default_score."""
    from tidemark.operators import sampling

    roles = sampling.roles(sampling.series_ids(obs)).select("series_id", "role")
    scores = fitted_trials(obs, kind, settings, **given).join(roles, "series_id")
    best = best_setting(scores.where("role = 'development'")).limit(1).select("trial")
    first = next(iter(settings))
    held = scores.where("role = 'evaluation'").crossJoin(F.broadcast(best.withColumnRenamed("trial", "best")))  # best: one row
    return held.groupBy("series_id", F.col("best").alias("trial")).agg(F.max(F.when(F.col("trial") == F.col("best"), F.col("score"))).alias("score"), F.max(F.when(F.col("trial") == first, F.col("score"))).alias("default_score"))
