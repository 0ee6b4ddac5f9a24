"""Collections of monthly series by name: where their values are and how they are split."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parsing import header_date, month_end, numbers, start_month
from tidemark.operators import splits
from tidemark.plans.substrate import numbered
from tidemark.sources import files
from tidemark.sources import series as S

#: Column names, tried in order, without regard to accents, case and punctuation.
ID_NAMES = ("series_id", "unique_id", "series", "series_name", "id", "m4id", "m3id", "v1", "name", "material", "referencia", "producto", "codigo material", "product", "product_id", "item_id")
DATE_NAMES = ("date", "ds", "timestamp", "month", "period", "periodo", "fecha", "mes", "anomes", "yearmonth")
START_NAMES = ("start_timestamp", "starting_date", "start_date", "start")
YEAR_NAMES, MONTH_NAMES = ("starting_year", "start_year", "year"), ("starting_month", "start_month", "starting_period", "month")
#: Columns of wide tables that are no values, whatever they hold; the names must be these for equal columns to be read.
NOT_VALUES = ("series_id", "series", "series_name", "id", "frequency", "category", "type", "n", "nf", "horizon", "forecast_horizon", "starting_year", "starting_month", "starting_period", "start_timestamp", "starting_date")
VALUE_NAMES = ("value", "y", "target", "sales", "sales value", "valor venta", "valor neto", "venta neta", "valor", "quantity")


def read_table(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Parquet by its ending, else delimited text with a header, in any usual encoding (see ``files.delimited``)."""
    if path.rstrip("/").endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    return files.delimited(spark, path, sep, encoding)


def long_table(df: DataFrame, positive: bool = False) -> DataFrame:
    """Columns found by name; dates and numbers in mixed notations."""
    key, date, value = (S.match_column(df.columns, names) for names in (ID_NAMES, DATE_NAMES, VALUE_NAMES))
    if not (key and date and value):
        raise ValueError(f"no series, date or value among {df.columns}")
    d = df.select(F.col(key).cast("string").alias("k"), month_end(F.trim(F.col(date).cast("string"))).alias("d"), F.col(value).cast("string").alias("t"))
    return S.long_to_monthly(numbers(d, "t", "v"), "k", "d", "v", positive)


def value_columns(df: DataFrame, key: str) -> list[str]:
    """Columns of values: those named by numbers, in their order; else all that hold a number and are not known to be something else."""
    numbered_ = [c for c in df.columns if c.strip().isdigit()]
    if numbered_:
        return sorted(numbered_, key=int)
    known = {S.plain_name(c) for c in (key, *NOT_VALUES)}
    others = [c for c in df.columns if S.plain_name(c) not in known]
    held = df.agg(*[F.count(F.col(f"`{c}`").try_cast("double")).alias(f"c{i}") for i, c in enumerate(others)]).first() if others else []
    return [c for c, n in zip(others, held) if n]


def start_dates(info: DataFrame) -> DataFrame:
    """series_id and start (month end): a date column, else a year and month, else 2000-01."""
    key = S.match_column(info.columns, ID_NAMES) or info.columns[0]
    date, year, month = (S.match_column(info.columns, names) for names in (START_NAMES, YEAR_NAMES, MONTH_NAMES))
    num = lambda c: F.col(c).try_cast("double").cast("int") if c else F.lit(None).cast("int")
    given = header_date(F.col(date).cast("string")) if date else F.lit(None).cast("date")
    return info.groupBy(F.col(key).cast("string").alias("series_id")).agg(F.min(start_month(num(year), F.coalesce(num(month), F.lit(1)), given)).alias("start"))


def wide_tables(train: DataFrame, test: DataFrame, info: DataFrame | None = None) -> DataFrame:
    """Rows of both tables with the same series, test after train: adds split. ``info``: where the series begin."""
    parts = []
    for name, df in (("train", train), ("test", test)):
        key = S.match_column(df.columns, ID_NAMES) or df.columns[0]
        df = df.withColumn(key, F.col(f"`{key}`").cast("string"))
        if info is not None:
            df = df.join(start_dates(info), F.col(f"`{key}`") == F.col("series_id"), "left").drop("series_id" if key != "series_id" else "").withColumnRenamed("start", "_start") if key != "series_id" else df.join(start_dates(info).withColumnRenamed("start", "_start"), "series_id", "left")
            df = df.withColumn("_start", F.coalesce("_start", F.lit("2000-01-31").cast("date")))
        parts.append(S.wide_to_long(df, key, value_columns(df.drop("_start"), key), "_start" if info is not None else None).withColumn("split", F.lit(name)))
    ends = parts[0].groupBy("series_id").agg(F.max("ds").alias("end"), F.count("*").alias("k"))
    after = parts[1].join(ends, "series_id").withColumn("ds", F.last_day(F.add_months("end", F.col("t").cast("int") + 1))).drop("end", "k")
    first = parts[0].join(parts[1].select("series_id").distinct(), "series_id", "left_semi")
    both = first.unionByName(after).select("series_id", "ds", "y", "split")
    return numbered(both.select("series_id", "ds", "y")).join(both.select("series_id", "ds", "split"), ["series_id", "ds"])


@dataclass(frozen=True)
class Collection:
    """How a collection is read: kind of source, rows to hold out, shortest and longest training part."""

    kind: str
    horizon: int
    least: int = 36
    most: int = 199
    missing: str = "drop"
    season: int = 12


COLLECTIONS = {
    "m4": Collection("wide", 18),
    "m3": Collection("tsf", 18),
    "tourism": Collection("tsf", 24),
    "cif": Collection("tsf", 12, least=24, missing="interpolate"),
    "transactions": Collection("long", 10, least=24),
    "json": Collection("json", 6, least=12),
}


def load(spark: SparkSession, name: str, path: str, test: str | None = None, info: str | None = None, strict: bool = False) -> DataFrame:
    """(series_id, ds, t, n, y, split) of a collection by its name, without regard to case and punctuation.

    ``test`` and ``info``: further files of wide collections.  ``strict``: a value
    that is not finite is an error, else its series is left out.
    """
    known = {S.plain_name(k): c for k, c in COLLECTIONS.items()}
    if S.plain_name(name) not in known:
        raise ValueError(f"unknown collection: {name}")
    c = known[S.plain_name(name)]
    if c.kind == "wide" and test:
        both = wide_tables(read_table(spark, path), read_table(spark, test), read_table(spark, info) if info else None)
        return S.bounded(both, c.least, c.most, strict)
    if c.kind == "tsf":
        return S.bounded(_tsf(spark, path, S.plain_name(name), c), c.least, c.most, strict)
    readers: dict[str, Callable[[], DataFrame]] = {
        "long": lambda: S.calendar_fill(long_table(read_table(spark, path), positive=True)),
        "json": lambda: S.json_series(spark.read.text(path, wholetext=True), "value"),
        "wide": lambda: _wide(read_table(spark, path)),
    }
    return S.validated(readers[c.kind](), c.least, c.most, c.horizon, strict)


def _tsf(spark: SparkSession, path: str, name: str, c: Collection) -> DataFrame:
    """Rows with their split: each series' own horizon is held out; a series no longer than it is left out."""
    df, header = S.read_tsf(spark, path)
    d = S.own_horizons(df, header, name, c.horizon)
    rows = S.arrays_to_long(d, "series_id", "start", "series_value", c.missing).join(d.select("series_id", "horizon"), "series_id")
    rows = rows.where((F.col("horizon") > 0) & (F.col("n") > F.col("horizon")))
    return rows.withColumn("split", F.when(F.col("t") >= F.col("n") - F.col("horizon"), "test").otherwise("train")).drop("horizon")


def _wide(df: DataFrame) -> DataFrame:
    key = S.match_column(df.columns, ID_NAMES) or df.columns[0]
    return S.wide_to_long(df, key, value_columns(df, key))


def held_out(obs: DataFrame, horizon: int) -> DataFrame:
    return splits.tail(obs, horizon)
