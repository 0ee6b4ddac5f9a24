"""Collections read from files, and smoothing against loops."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_series import months
from tidemark.operators import smoothing, splits
from tidemark.plans.substrate import numbered
from tidemark.sources import datasets


def test_delimited_text(spark, tmp_path):
    rows = [f"{'202401' if i % 2 else '2024-02-05'};A{i % 3};1.{i:03d},50" for i in range(1, 13)]
    (tmp_path / "t.csv").write_text("Periodo;Material;Valor Venta\n" + "\n".join(rows), encoding="latin-1")
    df = datasets.read_table(spark, str(tmp_path / "t.csv"), encoding="ISO-8859-1")
    assert df.columns == ["Periodo", "Material", "Valor Venta"]
    o = datasets.long_table(df)
    assert o.agg(F.sum("y")).first()[0] == sum(1000 + i + 0.5 for i in range(1, 13))
    assert {r.ds for r in o.collect()} == {dt.date(2024, 1, 31), dt.date(2024, 2, 29)}
    with pytest.raises(ValueError):
        datasets.long_table(df.drop("Material"))


def test_wide_tables(spark, tmp_path):
    for name, cells in (("train", ["a,1,2,3,", "b,4,5,,", "only,9,9,9,9"]), ("test", ["b,60,70", "a,40,50"])):
        head = "id," + ",".join(f"V{i + 2}" for i in range(len(cells[0].split(",")) - 1))
        (tmp_path / f"{name}.csv").write_text("\n".join([head, *cells]))
    got = datasets.wide_tables(*(datasets.read_table(spark, str(tmp_path / f"{n}.csv")) for n in ("train", "test"))).orderBy("series_id", "ds").collect()
    assert [(r.series_id, r.t, r.y, r.split) for r in got] == [("a", 0, 1, "train"), ("a", 1, 2, "train"), ("a", 2, 3, "train"), ("a", 3, 40, "test"), ("a", 4, 50, "test"), ("b", 0, 4, "train"), ("b", 1, 5, "train"), ("b", 2, 60, "test"), ("b", 3, 70, "test")]
    assert all(r.ds == d for r, d in zip(got, months(5, (2000, 1))))


def test_collections(spark, tmp_path):
    body = "\n".join(["@attribute series_name string", "@attribute start_timestamp date", "@data", "T1:1990-01-01 00-00-00:" + ",".join(map(str, range(60))), "T2:1990-01-01 00-00-00:1,2,3"])
    (tmp_path / "x.tsf").write_text(body)
    o = datasets.load(spark, "m3", str(tmp_path / "x.tsf"))
    assert {r.series_id for r in o.collect()} == {"T1"} and o.where("split = 'test'").count() == 18
    index = [str(d.replace(day=1)) for d in months(24, (2020, 1))]
    (tmp_path / "s.json").write_text(json.dumps({"s": {"index": index, "values": [float(i) for i in range(24)]}}, indent=1))
    o = datasets.load(spark, "JSON", str(tmp_path / "s.json"))
    assert o.count() == 24 and o.where("split = 'test'").count() == 6
    with pytest.raises(ValueError):
        datasets.load(spark, "m5", "x")


def test_smoothing(spark):
    rng = np.random.default_rng(2)
    y = rng.normal(10, 2, 50).cumsum()
    o = splits.tail(numbered(spark.createDataFrame([("s", d, float(v)) for d, v in zip(months(50), y)], "series_id string, ds date, y double")), 10)

    def loop(a):
        level, out = y[0], []
        for v in y:
            out.append(level)
            level = a * v + (1 - a) * level
        return np.array(out)

    best = min(smoothing.WEIGHTS, key=lambda a: (round(float(((y - loop(a))[:40] ** 2).sum()), 6), a))
    s = smoothing.best_weight(smoothing.levels(o))
    rows = s.orderBy("t").collect()
    assert {r.weight for r in rows} == {best} and np.allclose([r.pred for r in rows], loop(best))
    t = [r.pred for r in smoothing.theta(s).orderBy("t").collect()]
    slope = [np.polyfit(np.arange(k), y[:k], 1)[0] if k >= 3 else 0.0 for k in range(50)]
    assert np.allclose(t, loop(best) + np.array(slope) / 2 * (1 - (1 - best) ** np.arange(50)) / best)


def test_wide_collection_with_starts_and_bounds(spark, tmp_path):
    """Training lengths are held to the collection's bounds; values are the columns named by numbers; starts come from a third file."""
    values = lambda n, k: ",".join(str(float(i + k)) for i in range(n))
    pad = lambda text, n: text + "," * (n - text.count(",") - 1)
    head = "id,note," + ",".join(str(i) for i in range(1, 221))
    train = [head, "a,x," + pad(values(220, 0), 220), "b,x," + pad(values(40, 5), 220), "c,x," + pad(values(20, 5), 220)]
    (tmp_path / "train.csv").write_text("\n".join(train))
    (tmp_path / "test.csv").write_text("\n".join(["id,1,2", "a,7,8", "b,9,10", "c,1,1"]))
    (tmp_path / "info.csv").write_bytes("id;Category;Starting_Year;Starting_Month\na;niñ;1990;5\nb;x;1991;\n".encode("latin-1"))
    o = datasets.load(spark, "m4", str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), str(tmp_path / "info.csv"))
    rows = {s: sorted((r for r in o.collect() if r.series_id == s), key=lambda r: r.ds) for s in "abc"}
    assert [len(rows[s]) for s in "abc"] == [201, 42, 0]
    assert rows["a"][0].y == 21.0 and rows["a"][-1].y == 8.0 and rows["a"][-3].split == "train" and rows["a"][-2].split == "test"
    assert rows["b"][0].ds == dt.date(1991, 1, 31) and rows["a"][0].ds == months(22, (1990, 5))[21]


def test_encodings_and_discovery(spark, tmp_path):
    from tidemark.sources import files

    (tmp_path / "sub").mkdir()
    texts = {"a_Monthly.csv": "id;v\nñ;1\n".encode("latin-1"), "sub/B.csv": b"\xef\xbb\xbfid,v\n\xc3\xb1,1\n", "sub/c.tsf": "@data\nñ:1,2\n".encode("cp1252"), "sub/cif_monthly.ts": b"@data\n"}
    for name, body in texts.items():
        (tmp_path / name).write_bytes(body)
    root = str(tmp_path)
    assert files.find(spark, root, ["*.none", "SUB/*.csv"]).endswith("sub/B.csv") and files.find(spark, root, ["*MONTHLY*"]).endswith("a_Monthly.csv")
    assert files.find(spark, root, ["nothing"], required=False) is None
    with pytest.raises(FileNotFoundError):
        files.find(spark, root, ["nothing"])
    assert files.best_match(files.listed(spark, root), ["cif", "2016"]).endswith("cif_monthly.ts")
    for name in ("a_Monthly.csv", "sub/B.csv"):
        df = datasets.read_table(spark, f"{root}/{name}")
        assert df.columns == ["id", "v"] and [tuple(r) for r in df.collect()] == [("ñ", "1")]
    assert [r.value for r in files.text_lines(spark, f"{root}/sub/c.tsf").collect()] == ["@data", "ñ:1,2"]


def test_strict_values(spark):
    from pyspark.errors import PySparkException

    from tidemark.sources import series as S

    o = numbered(spark.createDataFrame([(s, d, float("nan") if s == "b" and i == 7 else 1.0) for s in "ab" for i, d in enumerate(months(60))], "series_id string, ds date, y double"))
    assert {r.series_id for r in S.validated(o).collect()} == {"a"}
    with pytest.raises(PySparkException):
        S.validated(o, strict=True).collect()
    assert S.picked(o, 1).first().series_id == "b" and S.picked(o, series_id="a").count() == 60
    for bad in ({"position": 2}, {"series_id": "c"}):
        with pytest.raises(ValueError):
            S.picked(o, **bad)
