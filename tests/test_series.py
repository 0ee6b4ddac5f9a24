"""Operators on small series, against plain loops and by changing what must not matter."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.functions import parsing
from tidemark.operators import conformal, diagnostics, forecasts, metrics, models, results, sampling, shocks, splits, statistics, transforms, windows
from tidemark.plans.substrate import brand_monthly, numbered
from tidemark.sources import series as S


def months(n, start=(2015, 1)):
    out, (y, m) = [], start
    for _ in range(n):
        y2, m2 = (y + 1, 1) if m == 12 else (y, m + 1)
        out.append(dt.date(y2, m2, 1) - dt.timedelta(days=1))
        y, m = y2, m2
    return out


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s, n in (("a", 108), ("b", 96), ("c", 60)):
        y = 20 + 0.04 * np.arange(n) + 2 * np.sin(2 * np.pi * np.arange(n) / 12) + rng.normal(0, 0.35, n)
        rows += [(s, d, float(v)) for d, v in zip(months(n), y)]
    return numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).cache()


def series(df, s, col):
    return [r[col] for r in df.where(F.col("series_id") == s).orderBy("ds").collect()]


def test_priors_do_not_look_ahead(obs):
    shifted = obs.withColumn("y", F.when(F.col("t") >= 30, F.col("y") + 1000).otherwise(F.col("y")))
    for f in (forecasts.rolling_mean(), forecasts.seasonal_naive(), forecasts.naive()):
        a, b = (series(o.withColumn("p", f), "a", "p") for o in (obs, shifted))
        assert a[:31] == b[:31] and a[31:] != b[31:]
    a, b = (series(forecasts.ar1(o), "a", "pred") for o in (obs, shifted))
    assert np.allclose(a[:31], b[:31])
    for model in (models.sketch, models.reservoir):
        last = obs.withColumn("y", F.when(F.col("t") == F.col("n") - 1, F.col("y") + 50).otherwise(F.col("y")))
        a, b = (series(model(o), "b", "pred") for o in (obs, last))
        assert np.allclose(a, b)


def test_ar1_is_least_squares(obs):
    y = np.array(series(obs, "c", "y"))
    got = series(forecasts.ar1(obs), "c", "pred")
    for t in (10, 30, 59):
        x, z = y[: t - 1], y[1:t]
        b = ((x - x.mean()) @ (z - z.mean())) / ((x - x.mean()) @ (x - x.mean()))
        assert math.isclose(got[t], z.mean() - b * x.mean() + b * y[t - 1], rel_tol=1e-9)


def test_order_statistic(spark):
    row = spark.range(1).select(
        conformal.order_statistic(F.array(*[F.lit(float(x)) for x in (1, 2, 3, 4)]), F.lit(0.25)).alias("a"),
        conformal.order_statistic(F.array().cast("array<double>"), F.lit(0.1)).alias("b"),
    ).first()
    assert row.a == 4.0 and row.b == 0.0


def loop_aci(y, p, target=0.1, rate=0.05, scale=1.0):
    alpha, scores, out = target, [], []
    for a, b in zip(y, p):
        n = len(scores)
        half = scale * (sorted(scores)[min(max(math.ceil((n + 1) * (1 - alpha)), 1), n) - 1] if n else 0.0)
        out.append((b - half, b + half, alpha, n))
        alpha = min(max(alpha + rate * (target - (abs(a - b) > half)), 0.01), 0.5)
        scores.append(abs(a - b))
    return out


def test_adaptive_intervals(obs):
    f = obs.withColumn("pred", forecasts.naive()).select("series_id", "t", "ds", "y", "pred")
    for kw in ({}, {"rate": 0.0}, {"scale": 2.0}):
        got = conformal.adaptive(f, ["series_id"], **kw).where("series_id = 'a'").orderBy("t").collect()
        want = loop_aci([r.y for r in got], [r.pred for r in got], **kw)
        assert np.allclose([(r.lower, r.upper, r.alpha, r.n_scores) for r in got], want)
    longer = conformal.adaptive(f.where("t < 40"), ["series_id"]).where("series_id = 'b'").orderBy("t").collect()
    whole = conformal.adaptive(f, ["series_id"]).where("series_id = 'b'").orderBy("t").collect()
    assert longer == whole[:40]


def test_folds(obs):
    import pandas as pd

    y = pd.Series(series(obs, "a", "y"))
    assert np.allclose(series(windows.ema(obs, "y", 4), "a", "ema"), y.ewm(span=4, adjust=False).mean())
    assert np.allclose(series(windows.ewm_std(obs, "y", 4), "a", "ewm_std")[1:], y.ewm(span=4, adjust=False).std()[1:], atol=1e-6)
    got = obs.select("series_id", "ds", *[c.alias(k) for k, c in windows.causal("y", 5).items()])
    for t in (0, 1, 3, 50):
        w = y[max(0, t - 4) : t + 1].to_numpy()
        h = len(w) // 2
        want = (w.mean(), w[-1] - w[0], w[h:].mean() - w[:h].mean() if h else 0.0, np.abs(w).mean())
        assert np.allclose([series(got, "a", k)[t] for k in ("mean", "slope", "contrast", "energy")], want)


def test_scaler_is_fitted_on_training_rows(obs):
    a = splits.tail(obs, 12)
    b = a.withColumn("y", F.when(F.col("split") == "test", 1e6).otherwise(F.col("y")))
    for f, cols in ((transforms.robust_scale, ("center", "spread")), (transforms.standard_scale, ("mean", "sd"))):
        assert [series(f(a), "a", c)[0] for c in cols] == [series(f(b), "a", c)[0] for c in cols]
    assert metrics.scales(a).orderBy("series_id").collect() == metrics.scales(b).orderBy("series_id").collect()


def test_scales_have_fallbacks(spark):
    rows = [("const", d, 5.0) for d in months(30)] + [("short", d, float(i)) for i, d in enumerate(months(8))] + [("one", months(1)[0], 3.0)]
    o = numbered(spark.createDataFrame(rows, "series_id string, ds date, y double")).withColumn("split", F.lit("train"))
    assert {r.series_id: (r.scale, r.square_scale) for r in metrics.scales(o).collect()} == {"const": (1.0, 1.0), "short": (1.0, 1.0), "one": (1.0, 1.0)}


def test_scaled_metrics_do_not_depend_on_the_unit(obs):
    out = []
    for k in (1, 10):
        o = splits.tail(obs.withColumn("y", F.col("y") * k), 12)
        r = o.withColumn("pred", forecasts.naive()).where("split = 'test'").join(metrics.scales(o), "series_id")
        out.append([(x.mase, x.rmsse) for x in metrics.evaluate(r, ["series_id"], None).orderBy("series_id").collect()])
    assert np.allclose(out[0], out[1])


def test_interval_score(spark):
    rows = [(10.0, 8.0, 12.0), (5.0, 8.0, 12.0), (13.0, 12.0, 8.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "y double, lower double, upper double").select(metrics.interval_score(0.1)).collect()]
    assert np.allclose(got, [4, 4 + 20 * 3, 4 + 20 * 1])


def test_shrinkage(spark):
    rows = [("opposite", float(a), float(-b)) for a, b in ((1, 3), (2, 2), (3, 1))] + [("same", 1.0, 10.0), ("half", 2.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, raw double, e double")
    got = {r.g: r.gamma for r in forecasts.shrinkage(df, ["g"], "raw", "e").collect()}
    assert got["opposite"] == 0 and got["same"] == 1.5 and math.isclose(got["half"], 0.5, rel_tol=1e-9)
    assert forecasts.shrinkage(df, ["g"], "raw", "e", signed=True).where("g = 'opposite'").first().gamma < 0


def test_splits(spark, obs):
    n = {"a": 108, "b": 96, "c": 60}
    t = splits.three_way(obs).groupBy("series_id").pivot("block", ["train", "calibration", "test"]).count().collect()
    for r in t:
        k = n[r.series_id]
        assert (r.train, r.calibration, r.test) == (int(k * 0.64), int(k * 0.16), k - int(k * 0.64) - int(k * 0.16))
    i = splits.internal(obs).groupBy("series_id").pivot("block", ["readout", "adapter", "conformal"]).count().collect()
    for r in i:
        k = n[r.series_id]
        end = min(max(round(k * 0.7), 11), k - 6)
        assert r.readout == end and r.adapter == min(max(end + round(k * 0.2), end + 3), k - 3) - end
    f = splits.expanding_folds(obs, 3, 6, 6).where("series_id = 'c'").groupBy("fold", "part").count().collect()
    assert {(r.fold, r.part): r["count"] for r in f} == {(k, p): v for k in range(3) for p, v in (("train", 42 + 6 * k), ("val", 6))}


def test_sampling(spark):
    import hashlib

    ids = spark.createDataFrame([(f"s{i}",) for i in range(50)], "series_id string")
    want = sorted((f"s{i}" for i in range(50)), key=lambda s: int(hashlib.sha256(f"42:{s}".encode()).hexdigest()[:16], 16))
    assert [r.series_id for r in sampling.limited(ids, "smoke").collect()] == want[:6]
    dev = {r.series_id for r in sampling.roles(ids).where("role = 'development'").collect()}
    assert dev == set(want[:15])


def test_tsf_file(spark, tmp_path):
    text = ["# Dataset Information", "@relation M3", "@attribute series_name string", "@attribute start_timestamp date", "@frequency monthly", "@horizon 18", "@missing false", "@equallength false", "@data"]
    text += ["T1:1990-01-01 00-00-00:" + ",".join(str(i) for i in range(1, 31)), "T2:1990-01-01 00-00-00:" + ",".join("?" if i == 105 else str(i) for i in range(101, 131))]
    (tmp_path / "m3.tsf").write_text("\n".join(text))
    df, header = S.read_tsf(spark, str(tmp_path / "m3.tsf"))
    assert header["horizon"] == "18" and header["attributes"] == [("series_name", "string"), ("start_timestamp", "date")]
    o = splits.tail(S.arrays_to_long(df, "series_name", "start_timestamp", "series_value", "interpolate"), 18)
    assert [r.y for r in o.where("series_id = 'T1' and split = 'test'").orderBy("t").collect()] == list(map(float, range(13, 31)))
    assert series(o, "T2", "y") == list(map(float, range(101, 131)))
    assert series(o, "T1", "ds")[0] == dt.date(1990, 1, 31)
    assert S.arrays_to_long(df, "series_name", "start_timestamp", "series_value", "drop").where("series_id = 'T2'").count() == 29
    with pytest.raises(Exception, match="missing value in T2"):
        S.arrays_to_long(df, "series_name", "start_timestamp", "series_value", "raise").collect()


def test_json_wide_and_long(spark):
    text = json.dumps({"x": {"index": ["2020-02-01", "2020-01-01"], "values": [2.0, 1.0]}, "y": {"index": [], "values": []}})
    assert [tuple(r) for r in S.json_series(spark.createDataFrame([(text,)], "j string"), "j").collect()] == [("x", dt.date(2020, 1, 31), 0, 2, 1.0), ("x", dt.date(2020, 2, 29), 1, 2, 2.0)]
    wide = spark.createDataFrame([("s", 1.0, None, 3.0), ("r", None, None, None)], "id string, V2 double, V3 double, V10 double")
    assert [(r.series_id, r.t, r.y) for r in S.wide_to_long(wide, "id", ["V2", "V3", "V10"]).orderBy("t").collect()] == [("s", 0, 1.0), ("s", 1, 3.0)]
    long = spark.createDataFrame([("a", dt.date(2020, 1, 3), "1"), ("a", dt.date(2020, 1, 9), "2"), ("a", dt.date(2020, 3, 1), "-5"), ("a", dt.date(2020, 4, 1), "4"), (None, dt.date(2020, 1, 1), "9"), ("a", None, "9"), ("a", dt.date(2020, 1, 1), "x")], "k string, d date, v string")
    o = S.long_to_monthly(long, "k", "d", "v", positive=True)
    assert [(r.ds, r.y) for r in S.calendar_fill(o).orderBy("ds").collect()] == [(dt.date(2020, 1, 31), 3.0), (dt.date(2020, 2, 29), 0.0), (dt.date(2020, 3, 31), 0.0), (dt.date(2020, 4, 30), 4.0)]
    filled = [r.y for r in S.calendar_fill(o, None).orderBy("ds").collect()]
    assert np.allclose(filled, [3, 3 + 1 / 3, 3 + 2 / 3, 4])
    assert [(r.after, r.missing) for r in S.gaps(o).collect()] == [(dt.date(2020, 1, 31), 2)]


def test_parsing(spark):
    rows = [("1.234,56", 1234.56), ("$ 7", 7.0), ("3,5", 3.5), ("x", None), (None, None)]
    df = spark.createDataFrame(rows, "t string, want double")
    assert all(r.got == r.want for r in parsing.numbers(df, "t", "got").collect())
    plain = spark.createDataFrame([(f"{i}.5",) for i in range(19)] + [("1,5",)], "t string")
    assert plain.count() - parsing.numbers(plain, "t", "got").where("got is null").count() == 19
    m = spark.createDataFrame([("202402",), ("2024-02-10",), ("1990-01-01 00-00-00",), ("202413",), ("no",)], "t string").select(parsing.month_end(F.col("t")).alias("d"))
    assert [r.d for r in m.collect()] == [dt.date(2024, 2, 29), dt.date(2024, 2, 29), dt.date(1990, 1, 31), None, None]
    assert S.match_column(["Série ID", "Válor"], ["valor"]) == "Válor" and S.match_column(["a"], ["b"]) is None


def test_results(spark, obs, tmp_path):
    o = splits.tail(obs, 12)
    f = forecasts.origins(o.withColumn("pred", forecasts.naive())).select("series_id", "forecast_origin", "information_cutoff", "target_timestamp", F.col("y").alias("y_true"), F.col("pred").alias("y_pred"), (F.col("pred") - 1).alias("lower"), (F.col("pred") + 1).alias("upper"))
    s = results.store(f, dataset="d", model="naive", mase_scale=1.0, rmsse_scale=1.0, status="ok")
    assert s.columns == results.COLUMNS and results.violations(s).isEmpty()
    results.write(s, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 36
    with pytest.raises(ValueError):
        results.write(s.withColumn("information_cutoff", F.col("target_timestamp")), str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        results.write(s.drop("error"), str(tmp_path / "bad"))
    assert results.per_series(s).count() == 3


def test_statistics(spark):
    rows = [(f"s{i}", m, float(v)) for i, vs in enumerate([(1, 2, 3), (1, 1, 2), (3, 2, 1), (1, 5, 9)]) for m, v in zip("abc", vs)]
    df = spark.createDataFrame(rows, "series_id string, model string, mae double")
    ranks = {(r.series_id, r.model): r["rank"] for r in statistics.ranked(df, "mae").collect()}
    assert ranks[("s1", "a")] == ranks[("s1", "b")] == 1.5 and ranks[("s1", "c")] == 3
    assert statistics.common_series(df.withColumn("mae", F.when((F.col("series_id") == "s2") & (F.col("model") == "b"), None).otherwise(F.col("mae"))), "mae").count() == 3
    p = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "a string, p double")
    assert {r.a: round(r.holm, 6) for r in statistics.holm(p, "p").collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}
    q = spark.createDataFrame([(z,) for z in (0.0, 1.0, 1.96, 4.0)], "z double").select(statistics.normal_tail(F.col("z")))
    assert np.allclose([r[0] for r in q.collect()], [math.erfc(z / 2**0.5) for z in (0.0, 1.0, 1.96, 4.0)], atol=3e-7)
    b = statistics.bootstrap_mean(df, ["model"], "mae", "series_id", draws=300).collect()
    for r in b:
        v = [x[2] for x in rows if x[1] == r.model]
        assert min(v) <= r.low <= np.mean(v) <= r.high <= max(v)
    low = spark.createDataFrame([("s", dt.date(2020, 1, i), m, 1.0, float(i)) for i in range(1, 4) for m in "ab"], "series_id string, ds date, model string, y double, pred double")
    assert statistics.diebold_mariano(low, "a", "b").first().status == "low_power"


def test_breaks(spark):
    y = [0.0] * 20 + [10.0] * 20 + [0.0] * 20
    o = numbered(spark.createDataFrame([("s", d, v) for d, v in zip(months(60), y)], "series_id string, ds date, y double"))
    c = diagnostics.breaks(o, 8, 1.5)
    kept, last = 0, -(10**6)
    for t in sorted(r.t for r in c.collect()):
        if t - last >= 8:
            kept, last = kept + 1, t
    assert kept == diagnostics.break_count(c).first().breaks == 2


def test_shocks(obs):
    s = shocks.injected(obs)
    t, y = np.array(series(s, "c", "t")), np.array(series(s, "c", "y"))
    for name, where in (("spike", t == 30), ("pulse", (t >= 30) & (t < 36)), ("level", t >= 30), ("ramp", t >= 30), ("amplitude", t >= 30)):
        moved = np.array(series(s, "c", name)) != y
        assert (moved == where).all(), name
    fit, test = splits.tail(obs, 12), shocks.labelled(splits.tail(obs, 12))
    assert test.count() == 36 and fit.count() == obs.count()


def test_sketch_improves_on_its_prior_or_stays(obs):
    for model in (models.sketch, models.reservoir):
        rows = model(obs).collect()
        assert len({(r.series_id, r.ds) for r in rows}) == len(rows) and sum(r.block == "test" for r in rows) == 36
        assert all(r.active or r.pred == r.p for r in rows)
        assert all(0 <= r.gate <= 1.5 for r in rows)
    a, b = (models.reservoir(obs, seed=s).orderBy("series_id", "ds").collect() for s in (7, 7))
    assert a == b


def test_selection(spark):
    df = spark.createDataFrame([("yes", 0.5, 2.0, 1.0), ("no", -0.1, 1.0, 2.0), ("weak", 0.5, 1.0, 0.99)], "g string, r2 double, prior_loss double, adapted_loss double")
    got = {r.g: (r.active, r.reason) for r in forecasts.selected(df, least_r2=0.0, penalty=0.05).collect()}
    assert got == {"yes": (True, "active"), "no": (False, "r2+penalty"), "weak": (False, "penalty")}


def test_plans_push_down_and_shuffle_once_by_series(spark):
    plan = brand_monthly(spark, SMALL).withColumn("p", forecasts.rolling_mean())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(series_id#") <= 2  # one for the sums, by series and month, and one by series
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan
