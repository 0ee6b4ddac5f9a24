"""Injected and observed shocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.substrate import along, whole


def position() -> Column:
    """Middle of the series, at least its second row."""
    return F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int"))


def injected(obs: DataFrame, size: float = 3.0, length: int = 6, m: int = 12) -> DataFrame:
    """The series with a spike, pulse, level shift, trend ramp, or wider seasonal swing from the middle on; the unit is the series' spread."""
    o = obs.withColumn("p", position()).withColumn("unit", F.stddev_pop("y").over(whole())).withColumn("center", F.avg("y").over(whole()))
    y, t, p, u = F.col("y"), F.col("t"), F.col("p"), size * F.col("unit")
    return o.select(
        "series_id", "ds", "t", "y",
        F.when(t == p, y + u).otherwise(y).alias("spike"),
        F.when((t >= p) & (t < p + length), y + u).otherwise(y).alias("pulse"),
        F.when(t >= p, y + u).otherwise(y).alias("level"),
        F.when(t >= p, y + u * (t - p + 1) / m).otherwise(y).alias("ramp"),
        F.when(t >= p, F.col("center") + 2 * (y - F.col("center"))).otherwise(y).alias("amplitude"),
    )


def innovations(obs: DataFrame, m: int = 12) -> DataFrame:
    """innovation: size of the change since ``m`` rows before, or since the first row where there are fewer."""
    ago = F.coalesce(F.lag("y", m).over(along()), F.first("y").over(along()))
    return obs.withColumn("innovation", F.abs(F.col("y") - ago))


def thresholds(innovated: DataFrame, m: int = 12) -> DataFrame:
    """From training rows with a full season before them: limit_iqr (third quartile and 1.5 ranges) and limit_q90."""
    q = F.percentile("innovation", F.array(F.lit(0.25), F.lit(0.75), F.lit(0.9)))
    g = innovated.where((F.col("split") == "train") & (F.col("t") >= m)).groupBy("series_id").agg(q.alias("q"))
    return g.select("series_id", (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("limit_iqr"), F.col("q")[2].alias("limit_q90"))


def labelled(obs: DataFrame, m: int = 12, limit: str = "limit_q90") -> DataFrame:
    """Test rows with innovation, the limit and shock."""
    i = innovations(obs, m)
    return i.where("split = 'test'").join(thresholds(i, m), "series_id").withColumn("shock", F.col("innovation") > F.col(limit))


def regimes(rows: DataFrame) -> DataFrame:
    """Each row once as overall and once as shock or non_shock."""
    return rows.withColumn("regime", F.explode(F.array(F.lit("overall"), F.when(F.col("shock"), "shock").otherwise("non_shock"))))


def outlying_series(obs: DataFrame, limit: float = 3.5) -> DataFrame:
    """Series with a training change whose distance from the median change is over ``limit`` scaled median distances: n_shocks, shock."""
    d = obs.where("split = 'train'").withColumn("d", F.col("y") - F.lag("y", 1).over(along())).where("d is not null")
    d = d.withColumn("m", F.percentile("d", F.lit(0.5)).over(whole())).withColumn("a", F.abs(F.col("d") - F.col("m")))
    d = d.withColumn("mad", F.percentile("a", F.lit(0.5)).over(whole()))
    z = F.col("a") / F.greatest(1.4826 * F.col("mad"), F.lit(1e-9))
    g = d.groupBy("series_id").agg(F.sum((z > limit).cast("long")).alias("n_shocks"))
    return g.withColumn("shock", F.col("n_shocks") > 0)


def recovery(rows: DataFrame) -> DataFrame:
    """Of rows (series_id, t, p, length, e) around a shock: mean errors before, during and after, their peak, and rows after its end until the error is back to its median before."""
    phase = F.when(F.col("t") < F.col("p"), "pre").when(F.col("t") < F.col("p") + F.col("length"), "during").otherwise("post")
    r = rows.withColumn("phase", phase).withColumn("a", F.abs("e"))
    r = r.withColumn("usual", F.percentile(F.when(F.col("phase") == "pre", F.col("a")), F.lit(0.5)).over(whole()))
    in_ = lambda name: F.col("phase") == name
    back = F.min(F.when(in_("post") & (F.col("a") <= F.col("usual")), F.col("t") - F.col("p") - F.col("length")))
    return r.groupBy("series_id").agg(*[F.avg(F.when(in_(x), F.col("a"))).alias(f"mae_{x}") for x in ("pre", "during", "post")], F.max(F.when(~in_("pre"), F.col("a"))).alias("peak"), back.alias("recovery"))


def noise(*keys: Column, seed: int = 42) -> Column:
    """A standard normal number for each key, by digest (Box and Muller): the same in every run and partition."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    part = lambda at: (F.conv(F.substring(digest, at, 8), 16, 10).cast("double") + 1) / float((1 << 32) + 1)
    return F.sqrt(-2 * F.log(part(1))) * F.cos(6.283185307179586 * part(9))


def variance_shift(obs: DataFrame, size: float = 3.0, seed: int = 42) -> DataFrame:
    """The series with noise of ``size`` spreads added from the middle on: series_id, ds, t, y, variance."""
    u = F.abs(F.lit(size)) * F.stddev_pop("y").over(whole())
    return obs.select("series_id", "ds", "t", "y", F.when(F.col("t") >= position(), F.col("y") + u * noise(F.col("series_id"), F.col("t"), seed=seed)).otherwise(F.col("y")).alias("variance"))


def report(rows: DataFrame) -> DataFrame:
    """Of test rows with shock, pred and scale: for each series, model and subset (overall, shock, non_shock) n_points, fraction, status (empty without rows) and errors."""
    from tidemark.operators import metrics

    kinds = F.array(*[F.lit(k) for k in ("overall", "shock", "non_shock")])
    r = rows.withColumn("subset", F.explode(kinds)).withColumn("inside", F.when(F.col("subset") == "overall", True).otherwise(F.col("shock") == (F.col("subset") == "shock")))
    e, n = F.abs(F.col("y") - F.col("pred")), F.sum(F.col("inside").cast("long"))
    own = lambda c: F.avg(F.when(F.col("inside"), c))
    g = r.groupBy("series_id", "model", "subset").agg(
        n.alias("n_points"), (n / F.count("*")).alias("fraction"), F.when(n == 0, "empty").otherwise("ok").alias("status"), own(e).alias("mae"),
        F.sqrt(own(e * e)).alias("rmse"), own(e / F.greatest(F.abs("y"), F.lit(metrics.EPS))).alias("mape"), (own(e) / metrics.safe(F.first("scale"))).alias("mase"),
    )
    return g
