"""Streams give what the batch operators give."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import loop_aci, months
from tidemark.streaming import online


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_online_forecasts(rocks, tmp_path):
    spark, rng = rocks, np.random.default_rng(1)
    y = {s: rng.normal(10, 2, 40).round(3) for s in "ab"}
    days = months(40)
    for part in range(4):
        rows = [(s, days[i], float(y[s][i])) for s in "ab" for i in range(part * 10, part * 10 + 10)]
        rows += [("a", days[3], 99.0)] if part == 2 else []
        spark.createDataFrame(rows, "series_id string, ds date, y double").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("series_id string, ds date, y double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = online.forecasts(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    late = [r for r in got if r.status == "late"]
    for s in "ab":
        rows = sorted((r for r in got if r.series_id == s and r.status == "ok"), key=lambda r: r.ds)
        assert [r.ds for r in rows] == [d for d in days if d in {r.ds for r in rows}]
        pred = [np.mean(y_[max(0, i - 6) : i]) if i else y_[0] for y_ in [[r.y for r in rows]] for i in range(len(rows))]
        assert np.allclose([r.pred for r in rows], pred)
        assert np.allclose([(r.lower, r.upper, r.alpha, r.n_scores) for r in rows], loop_aci([r.y for r in rows], pred))
    assert any(r.y == 99.0 for r in late) and len(got) == 81


def test_daily_sums(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("k", t0 + dt.timedelta(hours=6 * i), 1.0) for i in range(20)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = online.daily(stream, "k", "ts", "v").writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {r.ds: r.y for r in spark.table("daily").collect()}
    batch = {r.ds: r.y for r in online.daily(spark.createDataFrame(rows, "k string, ts timestamp, v double"), "k", "ts", "v").collect()}
    assert closed and all(batch[d] == v for d, v in closed.items()) and set(closed) < set(batch)
    m = online.monthly(spark.createDataFrame(rows, "k string, ts timestamp, v double"), "k", "ts", "v").agg(F.sum("y")).first()[0]
    assert m == 20


def test_stream_goes_on_from_states_at_rest(rocks, tmp_path):
    """States made in batch, written and read back, begin a stream: its rows are those of one stream over all."""
    spark, rng = rocks, np.random.default_rng(3)
    y, days = {s: rng.normal(10, 2, 30).round(3) for s in "ab"}, months(30)
    rows = [(s, days[i], float(y[s][i])) for s in "ab" for i in range(30)]
    kind = "series_id string, ds date, y double"
    df = spark.createDataFrame(rows, kind)
    online.states(df.where(F.col("ds") <= days[19])).write.parquet(str(tmp_path / "states"))
    df.where(F.col("ds") > days[19]).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).json(str(tmp_path / "in"))
    q = online.forecasts(stream, initial=spark.read.parquet(str(tmp_path / "states"))).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.series_id, r.ds): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 20
    for s in "ab":
        pred = [np.mean(y[s][max(0, i - 6) : i]) if i else y[s][0] for i in range(30)]
        want = loop_aci(list(y[s]), pred)
        for i in range(20, 30):
            r = got[(s, days[i])]
            assert r.status == "ok" and np.allclose((r.pred, r.lower, r.upper, r.alpha, r.n_scores), (pred[i], *want[i]))
