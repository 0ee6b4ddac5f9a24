"""Functions of the history as models: one pass over the series for all of them."""

import datetime

from tidemark.operators import models
from tidemark.plans.substrate import numbered
from tidemark.queries import QUERIES


def _mean_needs(least):
    def predict(y):
        if len(y) < least:
            raise ValueError(f"{len(y)} values are too few")
        y[0] += 0.0  # the history is the model's own
        return y.mean()

    return predict


def passes(df):
    """Python steps in a plan: by batches, and by groups."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow"), plan.count("FlatMapGroupsIn")


def test_custom_models_share_one_pass(spark, monkeypatch):
    monkeypatch.setattr(models, "AT_ONCE", 3)  # blocks end inside a batch
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(i)
    rows = [(f"s{k}", day(i), None if (k, i) == (7, 4) else float(k * i % 5)) for k in range(1, 9) for i in range(k)]
    obs = numbered(spark.createDataFrame(rows + [(None, day(i), 1.0) for i in range(5)], "series_id string, ds date, y double"))
    each = {"two": _mean_needs(2), "four": _mean_needs(4), "nine": _mean_needs(9)}
    got = models.custom(obs, each, 2)
    assert passes(got) == (1, 0)
    want = []
    for name, least in (("two", 2), ("four", 4), ("nine", 9)):
        for s in [f"s{k}" for k in range(3, 9)] + [None]:
            y = [r[2] for r in rows if r[0] == s] if s else [1.0] * 5
            n = len(y)
            if n - 2 < least:
                want.append((s, name, day(n - 2), None, None, "failed", f"ValueError: {n - 2} values are too few"))
                continue
            for i in (n - 2, n - 1):
                pred = None if None in y[:i] else sum(y[:i]) / i
                want.append((s, name, day(i), y[i], pred, "ok", None))
    key = lambda r: tuple(map(str, r[:3]))
    for a, b in zip(sorted(map(tuple, got.collect()), key=key), sorted(want, key=key), strict=True):
        assert a[:4] + a[5:] == b[:4] + b[5:] and (a[4] == b[4] or abs(a[4] - b[4]) < 1e-12), (a, b)
    one = models.custom(obs, each["four"], 2)
    assert one.columns == ["series_id", "ds", "y", "pred", "status", "error"]
    assert sorted(map(str, one.collect())) == sorted(map(str, got.where("model = 'four'").drop("model").collect()))
    assert models.custom(obs.where("n < 2"), each, 2).count() == 0


def test_failures_take_one_pass_over_the_series(spark, small):
    assert passes(QUERIES["failure_summary"](spark, small)) == (1, 0)


def test_failed_cells_without_a_join(spark, small):
    cells = QUERIES["failure_cells"](spark, small)
    assert passes(cells) == (1, 0) and "Join" not in cells._jdf.queryExecution().optimizedPlan().toString()


def test_common_series_of_failures(spark, small):
    """The count of the models reads the series again: two passes, whatever their number."""
    assert passes(QUERIES["failure_common"](spark, small)) == (2, 0)


def test_captured_failures_make_no_frame_a_series(spark, small):
    assert passes(QUERIES["captured_failures"](spark, small)) == (1, 0)


def test_coverage_makes_no_frame_a_series(spark, small):
    assert passes(QUERIES["model_coverage"](spark, small)) == (1, 0)


def test_walked_prior_makes_no_frame_a_series(spark, small):
    assert passes(QUERIES["walked_prior"](spark, small)) == (1, 0)


def test_common_series_make_their_rows_once(spark, small):
    """The models' count takes the shuffle of the series' rows from the other branch."""
    common = QUERIES["failure_common"](spark, small)
    assert common.count() == len(common.collect()) > 0
    final = common._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final
