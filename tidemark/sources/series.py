"""Sources of series: text, wide, long, nested and transactional tables to (series_id, ds, t, n, y)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.parsing import header_date
from tidemark.plans.substrate import along, whole, numbered
from tidemark.sources.files import numbered_lines


def plain_name(name: str) -> str:
    """A column name without accents, case and punctuation."""
    bare = unicodedata.normalize("NFKD", name)
    return re.sub(r"[^a-z0-9]", "", "".join(c for c in bare if not unicodedata.combining(c)).lower())


def match_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """The first column that is one of the candidates but for accents, case and punctuation."""
    known = {}
    for c in columns:
        known.setdefault(plain_name(c), c)
    return next((known[plain_name(c)] for c in candidates if plain_name(c) in known), None)


def tsf_header(lines: DataFrame) -> dict:
    """Directives of a series text file (value, line): attributes in order, frequency, horizon, missing, equallength, and data_line, the line after which the data come (null without any)."""
    text = F.trim("value")
    data = lines.where(F.lower(text) == "@data").agg(F.min("line")).first()[0]
    out: dict = {"attributes": [], "data_line": data}
    if data is None:
        return out
    for r in lines.where((F.col("line") < data) & F.startswith(text, F.lit("@"))).orderBy("line").select(text.alias("value")).collect():  # the lines above the data
        key, *rest = r.value.split(maxsplit=2)
        if key.lower() == "@attribute":
            if len(rest) != 2:
                raise ValueError(f"not an attribute: {r.value}")
            out["attributes"].append((rest[0], rest[1].strip().lower()))
        elif rest:
            out[key[1:].lower()] = r.value.split(maxsplit=1)[1].strip()
    return out


def parse_tsf(lines: DataFrame, attributes: Sequence[tuple[str, str]], after: int | None = None) -> DataFrame:
    """Data lines (column value) to a column for each attribute and ``series_value`` (array, null for ?); ``line`` is kept.

    Blank lines, those that begin with #, and those up to line ``after`` are none; a
    line with too few fields is an error.
    """
    text = F.trim("value")
    parts = F.split(text, ":", len(attributes) + 1)
    wrong = F.raise_error(F.concat(F.lit("not a series: "), F.substring(text, 1, 180))).cast("array<string>")
    own = ~text.rlike("^(#|$)") if after is None else ~text.rlike("^(#|$)") & (F.col("line") > after)
    # asked again inside, as conditions on the fields may be judged before the lines are chosen
    data = lines.where(own).withColumn("_f", F.when(F.size(parts) == len(attributes) + 1, parts).when(own, wrong))
    cols = []
    for i, (name, kind) in enumerate(attributes):
        raw = F.trim(F.get("_f", F.lit(i)))
        cols.append({"date": header_date(raw), "numeric": raw.try_cast("double"), "integer": raw.try_cast("long")}.get(kind, raw).alias(name))
    values = F.transform(F.split(F.get("_f", F.lit(len(attributes))), ","), lambda v: F.trim(v).try_cast("double"))
    return data.select(*[c for c in ("line",) if c in lines.columns and c not in dict(attributes)], *cols, values.alias("series_value"))


def read_tsf(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Data (in the order of line) and header of one series text file, in any usual encoding."""
    lines = numbered_lines(spark, path)
    header = tsf_header(lines)
    if header["data_line"] is None:
        return parse_tsf(lines.where("false"), header["attributes"]), header
    return parse_tsf(lines, header["attributes"], header["data_line"]), header


def own_horizons(df: DataFrame, header: dict, name: str, default: int) -> DataFrame:
    """(series_id, start, horizon, series_value) of ``read_tsf``: columns found by name, ids made from the row's place where there are none; the horizon is the row's, else the file's, else ``default``."""
    key, start, horizon = (match_column(df.columns, names) for names in (("series_name", "series_id", "series", "id"), ("start_timestamp", "starting_date", "start"), ("forecast_horizon", "horizon")))
    given = header.get("horizon")
    own = F.col(f"`{horizon}`").try_cast("double").cast("int") if horizon else F.lit(None).cast("int")
    first = F.col(f"`{start}`") if start else F.lit(None)
    first = first if start and dict(df.dtypes)[start] == "date" else header_date(first.cast("string"))
    if key:
        named = df.withColumn("_id", F.col(f"`{key}`").cast("string"))
    else:  # places by parts of the file: only the parts' numbers of rows meet
        d = df.withColumn("_part", F.shiftright("line", 33))
        parts = d.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        place = F.row_number().over(Window.partitionBy("_part").orderBy("line")) - 1 + F.col("_before")
        named = d.join(parts, "_part").withColumn("_id", F.format_string(f"{name}_%05d", place))
    default_start = F.lit("2000-01-31").cast("date")
    return named.select(F.col("_id").alias("series_id"), F.coalesce(first, default_start).alias("start"), F.coalesce(own, F.lit(int(float(given)) if given else default)).alias("horizon"), "series_value")


def arrays_to_long(df: DataFrame, series: str, start: str, values: str, missing: str = "drop") -> DataFrame:
    """One row a month from one array a series, from its start month on.

    missing: drop (and close the gap), interpolate, or raise.
    """
    e = df.select(F.col(series).alias("series_id"), F.col(start).alias("start"), F.posexplode(values).alias("pos", "y"))
    if missing == "drop":
        e = e.where("y is not null").withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("pos")) - 1)
    elif missing == "raise":
        e = e.withColumn("y", F.coalesce("y", F.raise_error(F.concat(F.lit("missing value in "), "series_id")).cast("double")))
    e = e.select("series_id", F.last_day(F.add_months("start", F.col("pos").cast("int"))).alias("ds"), "y")
    return numbered(interpolate(e) if missing == "interpolate" else e)


def interpolate(obs: DataFrame) -> DataFrame:
    """Null values of (series_id, ds, y) by linear interpolation along the rows; at the ends the nearest value."""
    place = F.row_number().over(along())
    back, ahead = along().rowsBetween(Window.unboundedPreceding, 0), along().rowsBetween(0, Window.unboundedFollowing)
    o = obs.withColumn("_p", place).withColumn("_k", F.when(F.col("y").isNotNull(), F.struct("_p", "y")))
    o = o.withColumn("_a", F.last("_k", True).over(back)).withColumn("_b", F.first("_k", True).over(ahead))
    step = (F.col("_b.y") - F.col("_a.y")) / F.nullif(F.col("_b._p") - F.col("_a._p"), F.lit(0))
    filled = F.coalesce("y", F.col("_a.y") + step * (F.col("_p") - F.col("_a._p")), "_a.y", "_b.y")
    return o.withColumn("y", filled).drop("_p", "_k", "_a", "_b")


def wide_to_long(wide: DataFrame, series: str, values: Sequence[str], start: str | None = None) -> DataFrame:
    """One row a value; nulls are dropped and the rest moves up. Months from ``start`` (a date column) or 2000-01."""
    first = F.col(start) if start else F.lit("2000-01-31").cast("date")
    keep = [F.col(series).alias("series_id"), first.alias("start")]
    order = F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)])
    e = wide.select(*keep, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(["series_id", "start"], list(values), "v", "y").where("y is not null and not isnan(y)")
    e = e.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy(order[F.col("v")])) - 1)
    return numbered(e.select("series_id", F.last_day(F.add_months("start", F.col("pos"))).alias("ds"), "y"))


def long_to_monthly(df: DataFrame, series: str, date: str, value: str, positive: bool = False) -> DataFrame:
    """Sum by series and month of rows whose series, date and value are known."""
    v = F.col(value).try_cast("double")
    ok = F.col(series).isNotNull() & F.col(date).isNotNull() & v.isNotNull() & ~F.isnan(v)
    rows = df.where(ok & (v > 0) if positive else ok)
    return numbered(rows.groupBy(F.col(series).cast("string").alias("series_id"), F.last_day(date).alias("ds")).agg(F.sum(v).alias("y")))


def calendar_fill(obs: DataFrame, fill: float | None = 0.0, flag: bool = False) -> DataFrame:
    """All months between a series' first and last; months without a row get ``fill`` (null: interpolated); with ``flag``, added says which."""
    ends = obs.groupBy("series_id").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    months = F.transform(F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("interval 1 month")), lambda d: F.last_day(d))
    full = ends.select("series_id", F.explode(months).alias("ds")).join(obs.select("series_id", "ds", "y"), ["series_id", "ds"], "left")
    out = numbered(interpolate(full) if fill is None else full.withColumn("y", F.coalesce("y", F.lit(fill))))
    if not flag:
        return out
    known = obs.where("y is not null").select("series_id", "ds", F.lit(False).alias("known"))
    return out.join(known, ["series_id", "ds"], "left").withColumn("added", F.coalesce("known", F.lit(True))).drop("known")


def imputed(filled: DataFrame) -> DataFrame:
    """n and imputed (months that were filled in) of each series of ``calendar_fill`` with flag."""
    return filled.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.col("added").cast("long")).alias("imputed"))


def picked(obs: DataFrame, position: int | None = None, series_id: str | None = None) -> DataFrame:
    """One series: by its id, or by its place (from 0) among the ids in order; ValueError where there is none."""
    if series_id is None:
        place = obs.select("series_id").distinct().orderBy("series_id").limit(position + 1).collect()  # at most ``position`` + 1 ids
        if len(place) <= position:
            raise ValueError(f"there are {len(place)} series")
        series_id = place[-1].series_id
    out = obs.where(F.col("series_id") == series_id)
    if out.isEmpty():
        raise ValueError(f"no series {series_id}")
    return out


def json_series(df: DataFrame, column: str) -> DataFrame:
    """Objects {series: {index: [...], values: [...]}} to one row a month (month end)."""
    kind = "map<string,struct<index:array<string>,values:array<double>>>"
    e = df.select(F.explode(F.from_json(column, kind)).alias("series_id", "s"))
    e = e.select("series_id", F.explode(F.arrays_zip("s.index", "s.values")).alias("x"))
    return numbered(e.select("series_id", F.last_day(header_date(F.col("x.index"))).alias("ds"), F.col("x.values").alias("y")).where("ds is not null"))


def _finite(obs: DataFrame, strict: bool) -> DataFrame:
    """Series with finite values only; with ``strict`` any other value is an error."""
    ok = F.coalesce(~F.isnan("y") & (F.abs("y") < float("inf")), F.lit(False))
    if strict:
        return obs.withColumn("y", F.when(ok, F.col("y")).otherwise(F.raise_error(F.concat(F.lit("value that is not finite in "), "series_id")).cast("double")))
    return obs.withColumn("_ok", F.min(ok).over(whole())).where("_ok").drop("_ok")


def validated(obs: DataFrame, least: int = 36, most: int = 199, horizon: int = 12, strict: bool = False) -> DataFrame:
    """Series with finite values only and ``least`` training months; of these the last ``most``; split is train or test."""
    o = _finite(obs, strict).where((F.col("n") - horizon >= least) & (F.col("t") >= F.col("n") - horizon - most))
    return numbered(o).withColumn("split", F.when(F.col("t") >= F.col("n") - horizon, "test").otherwise("train"))


def bounded(obs: DataFrame, least: int = 36, most: int = 199, strict: bool = False) -> DataFrame:
    """As ``validated`` for rows that have their split: by the number of each series' training rows; series need a test row."""
    train = F.sum((F.col("split") == "train").cast("int")).over(whole())
    o = _finite(obs, strict).withColumn("_k", train)
    o = o.where((F.col("_k") >= least) & (F.col("_k") < F.col("n")) & (F.col("t") >= F.col("_k") - most))
    return numbered(o).join(o.select("series_id", "ds", "split"), ["series_id", "ds"])


def gaps(obs: DataFrame) -> DataFrame:
    """One row a gap: series_id, after, before (months around it), missing."""
    nxt = F.lead("ds").over(along())
    o = obs.withColumn("before", nxt).withColumn("missing", F.months_between("before", "ds").cast("int") - 1)
    return o.where("missing > 0").select("series_id", F.col("ds").alias("after"), "before", "missing")
