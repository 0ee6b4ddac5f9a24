"""Deterministic samples and subsets of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Series in each mode; None: all.
LIMITS = {"smoke": 6, "standard": 200, "full": None}


def hash_key(series: Column, seed: int = 42, digits: int = 16) -> Column:
    """Hexadecimal digits that order series at random, the same way on every run."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), series), 256), 1, digits)


def series_ids(obs: DataFrame) -> DataFrame:
    return obs.select("series_id").distinct()


def limited(ids: DataFrame, mode: str, seed: int = 42) -> DataFrame:
    """The first series in hash order, as many as ``mode`` says: a top-k."""
    k = LIMITS[mode]
    ordered = ids.orderBy(hash_key(F.col("series_id"), seed))
    return ids if k is None else ordered.limit(k)


def roles(ids: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds role: development for the first ``share`` in hash order (at least one, not all), else evaluation.

    How many that are is one number; a series' place in hash order needs the
    count of smaller keys, made by first digits, so no task orders all series.
    """
    h = ids.withColumn("key", hash_key(F.col("series_id"), seed)).withColumn("bucket", F.substring("key", 1, 3))
    sizes = h.groupBy("bucket").agg(F.count("*").alias("size"))  # 4096 at most
    total = sizes.agg(F.sum("size").alias("n"))
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("bucket", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("base")).crossJoin(F.broadcast(total))
    placed = h.join(base, "bucket").withColumn("place", F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("key")))
    first = F.greatest(F.lit(1), F.least(F.rint(F.col("n") * share), F.col("n") - 1))
    return placed.select("series_id", "key", F.when(F.col("place") <= first, "development").otherwise("evaluation").alias("role"))


def development_one(obs: DataFrame, seed: int = 42, least: int = 30, excluded: tuple[str, ...] = ()) -> DataFrame:
    """One row: the series, of at least ``least`` rows and not excluded, that is first in hash order."""
    i = obs.where((F.col("n") >= least) & ~F.col("series_id").isin(list(excluded))).select("series_id").distinct()
    return i.agg(F.min_by("series_id", hash_key(F.col("series_id"), seed, 64)).alias("series_id")).where("series_id is not null")


def development_group(obs: DataFrame, n: int = 10, seed: int = 42, least: int = 18, series: list[str] | None = None) -> DataFrame:
    """series_id of ``n`` series for tuning, or of those given, all of at least ``least`` rows; at least one series must be left for evaluation.

    ValueError for repeated or unknown ids, or too few series.
    """
    ids = obs.groupBy("series_id").agg((F.max("n") >= least).alias("ok"))
    if series is not None:
        if len(set(series)) < len(series):
            raise ValueError("repeated series")
        known = ids.where(F.col("series_id").isin(series) & F.col("ok")).count()
        if known < len(series):
            raise ValueError(f"{len(series) - known} of the series are unknown or too short")
        chosen = ids.where(F.col("series_id").isin(series)).select("series_id")
    else:
        fit = ids.where("ok").count()
        if not 0 < n <= fit:
            raise ValueError(f"{n} series are asked for and {fit} are long enough")
        chosen = ids.where("ok").orderBy(hash_key(F.col("series_id"), seed, 64)).limit(n).select("series_id")
    if (n if series is None else len(series)) >= ids.count():
        raise ValueError("no series is left for evaluation")
    return chosen


def only(obs: DataFrame, ids: DataFrame) -> DataFrame:
    return obs.join(ids.select("series_id"), "series_id", "left_semi")


def without(obs: DataFrame, ids: DataFrame) -> DataFrame:
    return obs.join(ids.select("series_id"), "series_id", "left_anti")


def best(rows: DataFrame, by: list[str], score: str, *ties: str) -> DataFrame:
    """The row of least ``score`` in each group (then by ``ties``)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(score, *ties))).where("_r = 1").drop("_r")
