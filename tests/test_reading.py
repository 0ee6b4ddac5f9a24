"""Files are read whole: no row is lost, whatever it looks like."""

import datetime as dt

import pytest

from tidemark.sources import datasets, files
from tidemark.sources import series as S


def test_rows_like_the_header_stay(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"id", v,text\n1,2,x\nid,v,text\n"a,b",,"say ""hi"""\n\n3,4,y\n')
    df = files.delimited(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "v", "text"]
    assert [tuple(r) for r in df.collect()] == [("1", "2", "x"), ("id", "v", "text"), ("a,b", None, 'say "hi"'), ("3", "4", "y")]


def test_delimiter_by_all_first_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text("name, first;value\n1,5;2\n7;3\n")
    df = files.delimited(spark, str(tmp_path / "b.csv"))
    assert df.columns == ["name, first", "value"] and [tuple(r) for r in df.collect()] == [("1,5", "2"), ("7", "3")]
    with pytest.raises(ValueError):
        (tmp_path / "c.csv").write_text(" \n\n")
        files.delimited(spark, str(tmp_path / "c.csv"))


HEAD = ["# about", "@relation R", "@attribute series_name string", "@attribute start_timestamp date", "@attribute horizon numeric", "@frequency monthly", "@missing false", "@data"]


def test_series_lines(spark, tmp_path):
    rows = ["@home:1990-01-01 00-00-00:6:1,2,3", "@data:1990-01-01 00-00-00:6:4", "", "# note", "x:1990-02-01 00-00-00:3:5,?,a:b"]
    (tmp_path / "a.tsf").write_text("\n".join(HEAD + rows))
    df, header = S.read_tsf(spark, str(tmp_path / "a.tsf"))
    assert header["attributes"] == [("series_name", "string"), ("start_timestamp", "date"), ("horizon", "numeric")] and header["frequency"] == "monthly"
    got = {r.series_name: r for r in df.collect()}
    assert got["@home"].series_value == [1, 2, 3] and got["@data"].series_value == [4] and got["x"].series_value == [5, None, None]
    assert got["x"].start_timestamp == dt.date(1990, 2, 1) or got["x"].start_timestamp == dt.date(1990, 2, 28)
    (tmp_path / "bad.tsf").write_text("\n".join([*HEAD, *rows, "too:few"]))
    with pytest.raises(Exception, match="not a series: too:few"):
        S.read_tsf(spark, str(tmp_path / "bad.tsf"))[0].collect()
    (tmp_path / "none.tsf").write_text("\n".join(HEAD[:-1]))
    assert S.read_tsf(spark, str(tmp_path / "none.tsf"))[0].count() == 0
    (tmp_path / "odd.tsf").write_text("@attribute series_name\n@data\n")
    with pytest.raises(ValueError, match="not an attribute"):
        S.read_tsf(spark, str(tmp_path / "odd.tsf"))


def test_own_horizons(spark, tmp_path):
    values = ",".join(map(str, range(60)))
    (tmp_path / "a.tsf").write_text("\n".join(HEAD + [f"a:1990-01-01 00-00-00:6:{values}", f"b:1990-01-01 00-00-00:12:{values}", f"c:1990-01-01 00-00-00:?:{values}", "d:1990-01-01 00-00-00:6:1,2,3"]))
    o = datasets.load(spark, "M3", str(tmp_path / "a.tsf"))
    held = {r.series_id: r["count"] for r in o.where("split = 'test'").groupBy("series_id").count().collect()}
    assert held == {"a": 6, "b": 12, "c": 18}
    assert {r.ds for r in o.where("series_id = 'a' and t = 0").collect()} == {dt.date(1990, 1, 31)}
    # no id, no start, the file's own horizon
    (tmp_path / "b.tsf").write_text("\n".join(["@attribute kind string", "@horizon 7", "@data", f"x:{values}", f"y:{values}"]))
    o = datasets.load(spark, "m3", str(tmp_path / "b.tsf"))
    assert {(r.series_id, r["count"]) for r in o.where("split = 'test'").groupBy("series_id").count().collect()} == {("m3_00000", 7), ("m3_00001", 7)}


def test_names_in_other_languages(spark):
    df = spark.createDataFrame([("a", f"2020-{m:02d}-01", f"{m},5") for m in range(1, 13)], "`Código Material` string, Fecha string, `Valor Neto` string")
    assert datasets.long_table(df).count() == 12
    assert S.match_column(["M3ID", "AñoMes"], datasets.ID_NAMES) == "M3ID" and S.match_column(["M3ID", "AñoMes"], datasets.DATE_NAMES) == "AñoMes"
