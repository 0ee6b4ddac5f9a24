"""The table of results: one row for each forecast origin, from which all tables are derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics

#: The required columns, in the order that the table prescribes.
COLUMNS = [
    "run_id", "git_commit", "dataset", "series_id", "history_budget", "split_id", "model", "prior_name", "prior_params_json", "model_params_json", "uq_params_json", "seed",
    "seasonal_period", "requested_coverage", "effective_target_coverage", "interval_method", "mase_scale", "rmsse_scale", "msis_scale", "n_train", "train_start", "train_end",
    "n_readout", "n_adapter_calibration", "n_conformal_calibration", "prior_status", "model_status", "config_hash", "data_hash", "forecast_origin", "information_cutoff",
    "target_timestamp", "y_true", "y_pred", "lower", "upper", "adapter_active", "predictability_score", "runtime_fit", "runtime_predict", "status", "error",
]
_TEXT = "run_id git_commit dataset series_id history_budget split_id model prior_name prior_params_json model_params_json uq_params_json interval_method prior_status model_status config_hash data_hash status error".split()
_INT = "seed seasonal_period n_train n_readout n_adapter_calibration n_conformal_calibration".split()
_DATE = "train_start train_end forecast_origin information_cutoff target_timestamp".split()


def stable_json(params: dict) -> str:
    import json

    return json.dumps(params, sort_keys=True, separators=(",", ":"))


def store(rows: DataFrame, **constants) -> DataFrame:
    """Rows in the shape of the table; ``constants`` fill columns, what is missing is null; config_hash is that of the parameters."""
    out = rows
    for k, v in constants.items():
        out = out.withColumn(k, F.lit(v))
    for c in COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None))
    out = out.withColumn("config_hash", F.sha2(F.concat_ws("|", "model", F.coalesce(F.col("model_params_json").cast("string"), F.lit("")), F.coalesce(F.col("uq_params_json").cast("string"), F.lit(""))), 256))
    kind = lambda c: "string" if c in _TEXT else "int" if c in _INT else "date" if c in _DATE else "boolean" if c == "adapter_active" else "double"
    return out.select(*[F.col(c).cast(kind(c)).alias(c) for c in COLUMNS])


def provenance(obs: DataFrame, horizon: int = 12, ratio: float = 0.7) -> DataFrame:
    """What a series' results rest on: series_id, data_hash (of its months and values, in no order but their own), n_train, train_start, train_end, and the sizes of the three blocks of its training rows (null where it is too short for them)."""
    from tidemark.operators import splits

    line = F.concat_ws("|", F.col("ds").cast("string"), F.col("y").cast("decimal(38,6)").cast("string"))
    whole = obs.groupBy("series_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256).alias("data_hash"))
    train = splits.tail(obs, horizon).where("split = 'train'").withColumn("n", F.col("n") - horizon)
    ends = train.groupBy("series_id").agg(F.count("*").cast("int").alias("n_train"), F.min("ds").alias("train_start"), F.max("ds").alias("train_end"))
    count = lambda b: F.sum((F.col("block") == b).cast("int")).cast("int")
    blocks = splits.internal(train, ratio).groupBy("series_id").agg(count("readout").alias("n_readout"), count("adapter").alias("n_adapter_calibration"), count("conformal").alias("n_conformal_calibration"))
    return whole.join(ends, "series_id", "left").join(blocks, "series_id", "left")


def violations(s: DataFrame) -> DataFrame:
    """Rows whose target was known at the cutoff, or whose bounds are out of order."""
    late = ~(F.col("target_timestamp") > F.col("information_cutoff"))
    crossed = (F.col("lower") > F.col("y_pred")) | (F.col("y_pred") > F.col("upper"))
    return s.where(F.coalesce(late | crossed, F.lit(True)) & (F.col("status") == "ok"))


def write(s: DataFrame, path: str, kind: str = "parquet") -> None:
    """Checks columns and causality, then writes; Parquet is partitioned by dataset and model."""
    if [c for c in COLUMNS if c not in s.columns]:
        raise ValueError("columns of the result table are missing")
    if not violations(s).isEmpty():
        raise ValueError("rows of the result table use what was not known yet")
    if kind == "parquet":
        s.write.partitionBy("dataset", "model").parquet(path)
    elif kind == "csv":
        s.write.option("header", True).csv(path)
    else:
        raise ValueError(f"no such kind of file: {kind}")


def per_series(s: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Metrics of each series and model from the stored scales."""
    ok = s.where("status = 'ok'").select("dataset", "series_id", "model", F.col("y_true").alias("y"), F.col("y_pred").alias("pred"), "lower", "upper", F.col("mase_scale").alias("scale"), (F.col("rmsse_scale") * F.col("rmsse_scale")).alias("square_scale"))
    return metrics.evaluate(ok, ["dataset", "series_id", "model"], alpha)


def conflicts(rows: DataFrame, by: list[str], metric: str, tolerance: float = 1e-10) -> DataFrame:
    """Groups whose rows give different values for one metric."""
    return rows.groupBy(*by).agg(F.min(metric).alias("least"), F.max(metric).alias("greatest")).where(F.col("greatest") - F.col("least") > tolerance)


def export(folder: str, tables: dict[str, DataFrame], notes: dict | None = None, kind: str = "parquet") -> None:
    """Write each table below ``folder`` by its name, and ``notes`` (settings, versions) as one JSON line beside them."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"no such kind of file: {kind}")
    for name, t in tables.items():
        w = t.write.mode("overwrite")
        (w.option("header", True) if kind == "csv" else w).format(kind).save(f"{folder.rstrip('/')}/{name}")
    if notes is not None and tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(stable_json(notes),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/notes")


def run_tables(s: DataFrame, alpha: float = 0.1) -> dict[str, DataFrame]:
    """What a run is judged by, from its table of results: per_series, aggregate, failures and audit (rows that break causality)."""
    each = per_series(s, alpha)
    half = lambda c: F.percentile(c, F.lit(0.5)).alias(f"{c}_median")
    total = each.groupBy("dataset", "model").agg(F.count_distinct("series_id").alias("n_series"), F.avg("mase").alias("mase_mean"), half("mase"), half("smape"), half("rmse"), half("msis"), F.avg("ecp").alias("ecp_mean"))
    failed = s.where("status <> 'ok'").select("dataset", "series_id", "model", "target_timestamp", "error")
    return {"results": s, "per_series": each, "aggregate": total, "failures": failed, "audit": violations(s)}


def failed_rows(rows: DataFrame, dataset: str, model: str) -> DataFrame:
    """Rows of fitted models with status failed as rows of the table of results, without a forecast."""
    f = rows.where("status = 'failed'").select("series_id", F.col("ds").alias("target_timestamp"), "status", "error")
    return store(f, dataset=dataset, model=model)


def failure(series: Column, model: str, message: Column) -> list[Column]:
    """Columns of a row for a model that failed on a series."""
    return [series.alias("series_id"), F.lit(model).alias("model"), F.lit("failed").alias("status"), message.alias("error")]
