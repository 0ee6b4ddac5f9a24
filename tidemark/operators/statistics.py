"""Summaries across series and comparisons of models over (series_id, model, metric columns)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import tails

#: Columns that tell one unit of comparison from another; ("dataset", "series_id") where ids repeat between collections.
UNIT = ("series_id",)


def summary(rows: DataFrame, by: list[str], columns: Sequence[str]) -> DataFrame:
    """One row for each group and metric: n, mean, median, q1, q3, iqr, std (0 for one value)."""
    u = rows.unpivot(by, list(columns), "metric", "value").where("value is not null")
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = u.groupBy(*by, "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), q.alias("q"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    return g.select(*by, "metric", "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "std")


def tied_rank(by: list[str], value: str) -> Column:
    """Rank within ``by``; equal values share the mean of their ranks."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def ranked(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    return rows.withColumn("rank", tied_rank([*by, *unit], metric))


def average_rank(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    r = ranked(rows.where(f"{metric} is not null"), metric, unit, by)
    return r.groupBy(*by, "model").agg(F.count("*").alias("n"), F.avg("rank").alias("average_rank"), F.avg(metric).alias("mean"), F.percentile(metric, F.lit(0.5)).alias("median"))


def complete(rows: DataFrame, models: Sequence[str], metric: str) -> DataFrame:
    """A column for each model, series with all of them only."""
    return rows.groupBy("series_id").pivot("model", list(models)).agg(F.first(metric)).dropna(subset=list(models))


def common_series(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    """Units for which every model (of their group ``by``) has a value."""
    # the models' count reads the values too: alike in both branches, the rows' last shuffle is made once
    k = rows.groupBy(*by).agg(F.count_distinct("model").alias("k"), F.count(metric).alias("n")).where("n > 0").select(*by, "k")
    have = rows.where(f"{metric} is not null").groupBy(*by, *unit).agg(F.count_distinct("model").alias("m"))
    have = have.join(k, list(by)) if by else have.crossJoin(F.broadcast(k))
    return have.where("m = k").select(*by, *unit)


def _complete(rows: DataFrame, metric: str, unit: Sequence[str], by: Sequence[str]) -> DataFrame:
    return rows.join(common_series(rows, metric, unit, by), [*by, *unit])


def friedman_result(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    """n, k, the tie-corrected chi-square of the models' ranks over the units that all models have, p and status, for each group ``by``.

    insufficient_data (fewer than 2 units or 3 models) has neither statistic nor
    p; where all models tie in every unit (tied) there is no statistic, and p is 1.
    """
    r = ranked(_complete(rows, metric, unit, by), metric, unit, by)
    alike = r.groupBy(*by, *unit, metric).agg(F.count("*").alias("t"))
    ties = alike.groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    sums = r.groupBy(*by, "model").agg(F.sum("rank").alias("R"), F.count("*").alias("n")).groupBy(*by).agg(F.sum(F.col("R") * F.col("R")).alias("ss"), F.max("n").alias("n"))
    models = rows.groupBy(*by).agg(F.count_distinct("model").alias("k"))
    side = lambda x: models.join(x, list(by), "left") if by else models.crossJoin(F.broadcast(x))  # noqa: E731  without groups one row each
    s = side(sums)
    s = s.join(ties, list(by), "left") if by else s.crossJoin(F.broadcast(ties))
    n, k = F.coalesce("n", F.lit(0)), F.col("k")
    enough = (n >= 2) & (k >= 3)
    spread = F.nullif(1 - F.col("ties") / F.nullif(n * (k * k * k - k), F.lit(0)), F.lit(0.0))
    chi = F.when(enough, (12 / F.nullif(n * k * (k + 1), F.lit(0)) * F.col("ss") - 3 * n * (k + 1)) / spread)
    status = F.when(~enough, "insufficient_data").when(chi.isNull(), "tied").otherwise("ok")
    p = F.when(status == "tied", 1.0).when(enough, tails.chi_square(chi, k - 1))
    return s.select(*by, n.alias("n"), "k", chi.alias("chi_square"), p.alias("p"), status.alias("status"))


def friedman(rows: DataFrame, metric: str) -> DataFrame:
    """n, k and chi-square of ``friedman_result``, where there are enough series and models."""
    return friedman_result(rows, metric).where("status <> 'insufficient_data'").select("n", "k", "chi_square")


def pairs(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = (), baseline: str | None = None) -> DataFrame:
    """(by, unit, a, b, d): for each two models, in order of name, the difference where both have a value; with a ``baseline``, a is that one, and b every other."""
    a = rows.where(f"{metric} is not null").select(*by, *unit, F.col("model").alias("a"), F.col(metric).alias("va"))
    b = a.select(*by, *unit, F.col("a").alias("b"), F.col("va").alias("vb"))
    a = a if baseline is None else a.where(F.col("a") == baseline)
    return a.join(b, [*by, *unit]).where("a < b" if baseline is None else "a <> b").select(*by, *unit, "a", "b", (F.col("va") - F.col("vb")).alias("d"))


def paired_t(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = (), baseline: str | None = None) -> DataFrame:
    """n, mean difference, its standard error and t for each two models; t is null where the error is 0."""
    p = pairs(rows, metric, unit, by, baseline).groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return p.select(*by, "a", "b", "n", "mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"))


normal_tail = tails.normal


def holm(tests: DataFrame, p: str, *ties: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds holm: step-down adjusted p-values over all rows (one for each two models) of a group ``by``."""
    w = Window.partitionBy(*by).orderBy(p, *ties)
    m = F.count("*").over(Window.partitionBy(*(by or [F.lit(0)])))
    t = tests.withColumn("_step", F.least((m - F.row_number().over(w) + 1) * F.col(p), F.lit(1.0)))
    return t.withColumn("holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


#: The studentised range that the critical difference takes for up to 5 models, and beyond.
CRITICAL = {5: 2.343, None: 2.569}


def nemenyi(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    """Each two models' difference of average ranks against the critical difference, for each group ``by``."""
    r = ranked(_complete(rows, metric, unit, by), metric, unit, by)
    avg = r.groupBy(*by, "model").agg(F.avg("rank").alias("r"), F.count("*").alias("n"))
    k = avg.groupBy(*by).agg(F.count("*").alias("k"))
    a = avg.select(*by, F.col("model").alias("a"), F.col("r").alias("ra"), "n")
    b = avg.select(*by, F.col("model").alias("b"), F.col("r").alias("rb"))
    j = a.join(b, list(by)).join(k, list(by)).where("a < b") if by else a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(k))  # a row for each two models
    q = F.when(F.col("k") <= 5, CRITICAL[5]).otherwise(CRITICAL[None])
    cd = q * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))
    diff = F.abs(F.col("ra") - F.col("rb"))
    return j.select(*by, "a", "b", diff.alias("difference"), cd.alias("critical"), (diff > cd).alias("significant"))


def diebold_mariano(forecasts: DataFrame, a: str, b: str, horizon: int = 1) -> DataFrame:
    """For each series, the statistic on squared errors of two models with the small-sample correction; low_power under 8 rows."""
    e = (F.col("y") - F.col("pred")) ** 2
    d = forecasts.where(F.col("model").isin(a, b)).groupBy("series_id", "ds").agg((F.max(F.when(F.col("model") == a, e)) - F.max(F.when(F.col("model") == b, e))).alias("d"))
    g = d.groupBy("series_id").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.var_samp("d").alias("v"))
    n, h = F.col("n"), horizon
    correction = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    stat = F.when(F.col("v") <= 1e-12, 0.0).otherwise(F.col("mean") / F.sqrt(F.nullif(F.col("v"), F.lit(0.0)) / n) * correction)
    return g.select("series_id", "n", F.when(n >= 8, stat).alias("statistic"), F.when(n < 8, "low_power").otherwise("ok").alias("status"))


def wilcoxon(rows: DataFrame, metric: str) -> DataFrame:
    """For each two models: n non-zero differences, their signed-rank sums and the lesser of both."""
    p = pairs(rows, metric).where("d <> 0").withColumn("size", F.abs("d"))
    p = p.withColumn("rank", tied_rank(["a", "b"], "size"))
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("positive"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("negative")).withColumn("w", F.least("positive", "negative"))


def coverage(rows: DataFrame, quartiles: int = 4) -> DataFrame:
    """Share of rows inside their interval by quartile of the error's size within the series (first rows first among equals)."""
    w = Window.partitionBy("series_id", "model").orderBy(F.abs(F.col("y") - F.col("pred")), "ds")
    n = F.count("*").over(Window.partitionBy("series_id", "model"))
    r = rows.withColumn("r", F.row_number().over(w)).withColumn("m", n).withColumn("q", F.least(F.lit(quartiles), F.col("m")))
    place = F.when(F.col("m") == 1, 0).otherwise(F.greatest(F.ceil((F.col("r") - 1) * F.col("q") / F.nullif(F.col("m") - 1, F.lit(0))) - 1, F.lit(0)))
    return r.withColumn("quartile", place.cast("int")).groupBy("model", "quartile").agg(F.count("*").alias("n"), F.avg(F.col("y").between(F.col("lower"), F.col("upper")).cast("double")).alias("coverage"))


def trimmed_mean(rows: DataFrame, by: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Mean without the share at either end, and median; infinite for groups without values."""
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v"), F.percentile(value, F.lit(0.5)).alias("m"))
    cut = F.floor(F.size("v") * share).cast("int")
    kept = F.slice("v", cut + 1, F.size("v") - 2 * cut)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(kept), F.lit(0))
    return g.select(*by, F.coalesce(mean, F.lit(float("inf"))).alias("trimmed"), F.coalesce("m", F.lit(float("inf"))).alias("median"))


def bootstrap_mean(rows: DataFrame, by: list[str], value: str, unit: str, draws: int = 1000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Percentile interval of the mean by Poisson resampling: each unit's weight in a draw is a hash's, so no group is gathered."""
    d = rows.select(*by, F.col(value).alias("v"), F.col(unit).cast("string").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    uniform = F.pmod(F.xxhash64("u", "draw", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    weight, below = F.lit(0), 0.0
    p = 2.718281828459045**-1
    for k in range(1, 9):
        below += p
        weight = F.when(uniform >= below, k).otherwise(weight)
        p /= k
    d = d.withColumn("w", weight).groupBy(*by, "draw").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return d.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def friedman_test(rows: DataFrame, metric: str) -> DataFrame:
    """``friedman`` with p, the chi-square tail of k - 1 degrees of freedom (1 where all models tie)."""
    return friedman_result(rows, metric).where("status <> 'insufficient_data'").select("n", "k", "chi_square", "p")


def paired_t_test(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = (), baseline: str | None = None) -> DataFrame:
    """Each two models (or ``baseline`` and every other) over the units that all have: n, mean difference, p of Student's t and its step-down adjustment.

    Without spread p is 1 if the models agree everywhere, else 0.
    """
    t = paired_t(_complete(rows, metric, unit, by), metric, unit, by, baseline).where("n >= 2")
    p = F.when(F.col("se") > 0, tails.student(F.col("t"), F.col("n") - 1)).when(F.abs("mean") <= 1e-8, 1.0).otherwise(0.0)
    return holm(t.select(*by, "a", "b", "n", "mean", F.round(p, 12).alias("p")), "p", "a", "b", by=by)


def diebold_mariano_test(forecasts: DataFrame, a: str, b: str, horizon: int = 1) -> DataFrame:
    """``diebold_mariano`` with p; low_power under 24 rows, and without statistic under 8."""
    d = diebold_mariano(forecasts, a, b, horizon)
    p = F.when(F.col("statistic") == 0, 1.0).otherwise(tails.student(F.col("statistic"), F.col("n") - 1))
    return d.select("series_id", "n", "statistic", F.when(F.col("n") >= 8, p).alias("p"), F.when(F.col("n") < 24, "low_power").otherwise("ok").alias("status"))


def signed_rank_test(rows: DataFrame, metric: str, full: str, exact: int = 50, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    """Each other model against ``full``: pairs, means, the lesser signed-rank sum, p and its step-down adjustment.

    Differences of zero leave the ranks but not the pairs; all zero gives p = 1.  p
    is exact for at most ``exact`` pairs without zeros or ties, else normal with the
    correction for ties.
    """
    own = rows.where(f"{metric} is not null").select(*by, *unit, "model", F.col(metric).alias("v"))
    base = own.where(F.col("model") == full).select(*by, *unit, F.col("v").alias("base"))
    d = own.where(F.col("model") != full).join(base, [*by, *unit]).withColumn("d", F.col("v") - F.col("base")).withColumn("size", F.abs("d"))
    w = Window.partitionBy(*by, "model", "size")
    d = d.withColumn("rank", F.when(F.col("d") != 0, F.rank().over(Window.partitionBy(*by, "model", F.col("d") == 0).orderBy("size")) + (F.count("*").over(w) - 1) / 2)).withColumn("alike", F.count("*").over(w))
    some = F.col("d") != 0
    sums = [F.coalesce(F.sum(F.when(c, F.col("rank"))), F.lit(0.0)) for c in (F.col("d") > 0, F.col("d") < 0)]
    ties = F.coalesce(F.sum(F.when(some, F.col("alike") * F.col("alike") - 1)), F.lit(0))  # of each t alike, t (t * t - 1)
    g = d.groupBy(*by, "model").agg(F.count("*").alias("n_pairs"), F.sum(some.cast("int")).alias("m"), F.avg("base").alias("full_mean"), F.avg("v").alias("mean"), F.avg("d").alias("mean_delta"), F.least(*sums).alias("w"), ties.alias("ties"))
    m = F.col("m")
    sd = F.sqrt((m * (m + 1) * (2 * m + 1) - F.col("ties") / 2) / 24)
    near = tails.normal((F.col("w") - m * (m + 1) / 4) / F.nullif(sd, F.lit(0.0)))
    p = F.when(m == 0, 1.0).when((m == F.col("n_pairs")) & (F.col("ties") == 0) & (m <= exact), tails.signed_rank_exact(F.col("w"), m)).otherwise(near)
    return holm(g.select(*by, "model", "n_pairs", "full_mean", "mean", "mean_delta", "w", F.round(p, 12).alias("p")), "p", "model", by=by)


def weight(unit: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) weight of a unit in a draw, from 32 bits of a digest (four draws share one)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), unit, F.floor(draw / 4).cast("string")).cast("binary"))
    uniform = F.conv(F.substring(digest, (draw % 4) * 8 + 1, F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    out, below, p = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        below += p
        out = F.when(uniform >= below, k).otherwise(out)
        p /= k
    return out


def weighted_mean(value: Column, w: Column) -> Column:
    return F.sum(w * value) / F.nullif(F.sum(w), F.lit(0))


def weighted_median(value: Column, w: Column) -> Column:
    return F.percentile(value, F.lit(0.5), w)


def bootstrap(rows: DataFrame, by: list[str], value: str, unit: str, statistic=weighted_mean, draws: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile interval (low, high) of any statistic over units drawn with replacement.

    ``statistic(value, weight)`` is an aggregate Column.  How often a unit is drawn
    is Poisson(1) by its digest, so draws need no exchange beyond their sums, no
    group is gathered, and all statistics of one unit move together.
    """
    d = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.col(unit).cast("string").alias("u"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = d.withColumn("w", weight(F.col("u"), F.col("draw"), seed)).groupBy(*by, "draw").agg(statistic(F.col("v"), F.col("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    return d.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = (), **draws) -> DataFrame:
    """Each two models over units that both have: n, mean difference and its bootstrap interval."""
    p = pairs(rows, metric, unit, by).withColumn("_unit", _unit(unit))
    return p.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.avg("d").alias("mean")).join(bootstrap(p, [*by, "a", "b"], "d", "_unit", **draws), [*by, "a", "b"])


def _unit(unit: Sequence[str]) -> Column:
    """One string for a unit, different for different ones."""
    return F.col(unit[0]).cast("string") if len(unit) == 1 else F.to_json(F.struct(*unit))


def ranked_summary(rows: DataFrame, metric: str, higher: bool = False, unit: Sequence[str] = UNIT, by: Sequence[str] = (), **draws) -> DataFrame:
    """Each model (of each group ``by``): successful and failed units, mean, median, spread, average rank and the bootstrap interval of the mean."""
    ok = rows.where(f"{metric} is not null")
    r = ok.withColumn("key", -F.col(metric) if higher else F.col(metric)).withColumn("rank", tied_rank([*by, *unit], "key"))
    q = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = r.groupBy(*by, "model").agg(F.count("*").alias("successful"), F.avg(metric).alias("mean"), q.alias("q"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.avg("rank").alias("average_rank"))
    failed = rows.groupBy(*by, "model").agg(F.sum(F.col(metric).isNull().cast("long")).alias("failures"))
    ci = bootstrap(ok.withColumn("_unit", _unit(unit)), [*by, "model"], metric, "_unit", **draws).select(*by, "model", F.col("low").alias("ci95_low"), F.col("high").alias("ci95_high"))
    out = g.join(failed, [*by, "model"]).join(ci, [*by, "model"])
    return out.select(*by, "model", "successful", "failures", "mean", F.col("q")[1].alias("median"), "std", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "ci95_low", "ci95_high", "average_rank")


def critical_differences(rows: DataFrame, metric: str, unit: Sequence[str] = UNIT, by: Sequence[str] = ()) -> DataFrame:
    """Each model (of each group ``by``): its average rank over the units that all have, their number, and its failures."""
    r = ranked(_complete(rows, metric, unit, by), metric, unit, by).groupBy(*by, "model").agg(F.avg("rank").alias("average_rank"), F.count("*").alias("n_complete"))
    f = rows.groupBy(*by, "model").agg(F.sum(F.col(metric).isNull().cast("long")).alias("failures"))
    return f.join(r, [*by, "model"], "left").select(*by, "model", "average_rank", F.coalesce("n_complete", F.lit(0)).alias("n_complete"), "failures", (F.col("n_complete") > 0).alias("included"))
