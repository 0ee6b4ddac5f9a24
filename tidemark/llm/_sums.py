"""Running totals over a global order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before(totals: DataFrame, key: str, value: str, fan: int = 256, levels: int = 1) -> DataFrame:
    """(key, before): sum of ``value`` over the rows with smaller integer ``key``; one row a key.

    Runs of ``fan`` keys are summed in parallel, and only the runs' totals (one
    row for each ``fan`` keys) meet in one task; with more ``levels``, runs of runs.
    """
    run = F.floor(F.col(key) / F.lit(fan)).cast("long")
    t = totals.select(F.col(key), F.col(value).cast("long").alias("_v"), run.alias("_run"))
    inside = Window.partitionBy("_run").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    runs = t.groupBy("_run").agg(F.sum("_v").alias("_n"))
    if levels > 1:
        runs = before(runs.withColumnRenamed("_run", "run"), "run", "_n", fan, levels - 1).select(F.col("run").alias("_run"), F.col("before").alias("_base"))
    else:
        runs = runs.select("_run", F.coalesce(F.sum("_n").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    t = t.select(key, "_run", F.coalesce(F.sum("_v").over(inside), F.lit(0)).alias("_in"))
    return t.join(runs, "_run").select(key, (F.col("_base") + F.col("_in")).alias("before"))
