"""Queries over sources, samples, transforms and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import parsing
from tidemark.operators import sampling, splits, transforms
from tidemark.plans.registry import query
from tidemark.plans.substrate import BRAND_SQL, LINE_SQL, PRIORITY_SQL, brand_monthly, line_monthly, priority_monthly, table
from tidemark.sources import series as S

WITH = f"WITH {BRAND_SQL}"


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' GROUP BY 1, 2", "quantity")
def scan_parquet(spark, d):
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query(f"{WITH} SELECT series_id, ds, t, n, y FROM bm", "y")
def long_to_monthly(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return S.long_to_monthly(j.select("p_brand", "l_shipdate", "l_quantity"), "p_brand", "l_shipdate", "l_quantity")


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def tsf_date_parse(spark, d):
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH-mm-ss")
    return table(spark, d, "orders").select("o_orderkey", parsing.header_date(text).alias("day"))


def _lines(obs):
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: F.when(x["t"] % 17 == 5, "?").otherwise(x["y"].cast("string"))), ",")
    return obs.groupBy("series_id").agg(F.date_format(F.min("ds"), "yyyy-MM-dd").alias("start"), values.alias("v")).select(F.concat("series_id", F.lit(":"), "start", F.lit(" 00-00-00:"), "v").alias("value"))


_TSF = [("series_name", "string"), ("start_timestamp", "date")]


@query(f"""{WITH}, kept AS (SELECT series_id, y, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM bm WHERE t % 17 <> 5),
s AS (SELECT series_id, min(ds) AS start FROM bm GROUP BY 1)
SELECT series_id, last_day(start + to_months(t::INTEGER)) AS ds, t, n, y FROM kept JOIN s USING (series_id)""", "y")
def read_tsf(spark, d):
    """Series written as text lines, with gaps, parsed again; gaps close."""
    return S.arrays_to_long(S.parse_tsf(_lines(brand_monthly(spark, d)), _TSF), "series_name", "start_timestamp", "series_value", "drop")


@query(f"""{WITH}, o AS (SELECT *, CASE WHEN t % 17 <> 5 THEN y END AS k FROM bm), s AS (SELECT series_id, min(ds) AS start FROM bm GROUP BY 1),
e AS (SELECT *, last(CASE WHEN k IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS pa, last(k IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS a,
  first(CASE WHEN k IS NOT NULL THEN t END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pb, first(k IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
  FROM o WINDOW w AS (PARTITION BY series_id ORDER BY t))
SELECT series_id, last_day(start + to_months(t::INTEGER)) AS ds, t, n, coalesce(k, a + (b - a) / (pb - pa) * (t - pa), a, b) AS y FROM e JOIN s USING (series_id)""", "y")
def interpolate_linear(spark, d):
    return S.arrays_to_long(S.parse_tsf(_lines(brand_monthly(spark, d)), _TSF), "series_name", "start_timestamp", "series_value", "interpolate")


@query(f"""{WITH} SELECT series_id, last_day(DATE '2000-01-31' + to_months(t::INTEGER)) AS ds, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n, y FROM bm""", "y")
def wide_to_long(spark, d):
    """One row a series, one column a month, and back."""
    obs = brand_monthly(spark, d)
    wide = obs.withColumn("v", F.concat(F.lit("V"), F.col("t") + 2)).groupBy("series_id").pivot("v").agg(F.first("y"))
    values = sorted((c for c in wide.columns if c != "series_id"), key=lambda c: int(c[1:]))
    return S.wide_to_long(wide, "series_id", values)


@query(f"{WITH} SELECT series_id, t, y FROM bm", "y")
def series_value_explode(spark, d):
    """Delimited strings of values to rows."""
    text = brand_monthly(spark, d).groupBy("series_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda x: x["y"].cast("string")), "; ").alias("v"))
    return text.select("series_id", F.posexplode(F.split("v", r"[,;\s]+")).alias("t", "y")).select("series_id", "t", F.col("y").cast("double").alias("y"))


_FILLED = f"""{WITH}, ends AS (SELECT series_id, min(ds) AS lo, max(ds) AS hi FROM bm GROUP BY 1),
months AS (SELECT series_id, last_day(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))::DATE) AS ds FROM ends)"""


@query(f"{_FILLED} SELECT m.series_id, m.ds, row_number() OVER (PARTITION BY m.series_id ORDER BY m.ds) - 1 AS t, count(*) OVER (PARTITION BY m.series_id) AS n, coalesce(y, 0) AS y FROM months m LEFT JOIN bm USING (series_id, ds)", "y")
def calendar_fill(spark, d):
    return S.calendar_fill(brand_monthly(spark, d), 0.0)


@query("""WITH s AS (SELECT c_mktsegment AS series_id, last_day(o_orderdate) AS ds, count(*)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1, 2)
SELECT series_id, ds, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n, y FROM s""", "y")
def transactions_to_monthly(spark, d):
    """Orders of customers in credit, by segment."""
    j = table(spark, d, "orders").join(table(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return S.long_to_monthly(j.select("c_mktsegment", "o_orderdate", F.lit(1.0).alias("one")), "c_mktsegment", "o_orderdate", "one", positive=True)


@query("""WITH e AS (SELECT event_type || '-' || (user_id % 7) AS series_id, last_day(ts) AS ds, ts::DATE AS day FROM events WHERE extract(day FROM ts) % 9 <> 4), x AS (SELECT DISTINCT series_id, day FROM e),
g AS (SELECT series_id, day, lead(day) OVER (PARTITION BY series_id ORDER BY day) AS nxt FROM x) SELECT series_id, day AS after, nxt AS before, (nxt - day - 1)::INTEGER AS missing FROM g WHERE nxt - day > 1""")
def day_gaps(spark, d):
    """Days without events of each kind and user group."""
    from pyspark.sql import Window

    e = table(spark, d, "events").where(F.dayofmonth("ts") % 9 != 4)
    days = e.select(F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("series_id"), F.col("ts").cast("date").alias("day")).distinct()
    g = days.withColumn("before", F.lead("day").over(Window.partitionBy("series_id").orderBy("day")))
    return g.where(F.datediff("before", "day") > 1).select("series_id", F.col("day").alias("after"), "before", (F.datediff("before", "day") - 1).alias("missing"))


@query(f"""{WITH}, k AS (SELECT * FROM bm WHERE t % 11 <> 7), g AS (SELECT series_id, ds, lead(ds) OVER (PARTITION BY series_id ORDER BY ds) AS nxt FROM k)
SELECT series_id, ds AS after, nxt AS before, (date_diff('month', ds, nxt) - 1)::INTEGER AS missing FROM g WHERE date_diff('month', ds, nxt) > 1""")
def calendar_gaps(spark, d):
    return S.gaps(brand_monthly(spark, d).where("t % 11 <> 7"))


@query(f"{WITH} SELECT series_id, ds, t, n, y FROM bm", "y")
def json_series(spark, d):
    """Series as one JSON object each, and back."""
    rows = F.array_sort(F.collect_list(F.struct("t", "ds", "y")))
    obs = brand_monthly(spark, d).groupBy("series_id").agg(rows.alias("r"))
    part = F.struct(F.transform("r", lambda x: F.trunc(x["ds"], "MM").cast("string")).alias("index"), F.transform("r", lambda x: x["y"]).alias("values"))
    return S.json_series(obs.select(F.to_json(F.create_map("series_id", part)).alias("j")), "j")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS price FROM lineitem", "price")
def locale_number(spark, d):
    """Prices written 1.234,56 (with a currency sign) read as numbers."""
    us = F.format_number("l_extendedprice", 2)
    text = F.concat(F.lit("$ "), F.translate(us, ",.", ".,"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("text"))
    return parsing.numbers(rows, "text", "price").select("l_orderkey", "l_linenumber", "price")


@query("SELECT o_orderkey, last_day(o_orderdate) AS ds FROM orders")
def month_parse(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", parsing.month_end(text).alias("ds"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN last_day(make_date(1990 + p_size, greatest(1, least(p_size, 12)), 1)) ELSE DATE '2000-01-31' END AS start FROM part""")
def start_date(spark, d):
    year = F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 1990)
    return table(spark, d, "part").select("p_partkey", parsing.start_month(year, F.col("p_size")).alias("start"))


@query(f"""{WITH}, v AS (SELECT * FROM bm WHERE n - 12 >= 36 AND t >= n - 12 - 48), r AS (SELECT series_id, ds, y, row_number() OVER (PARTITION BY series_id ORDER BY ds) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM v)
SELECT series_id, ds, t, n, y, CASE WHEN t >= n - 12 THEN 'test' ELSE 'train' END AS split FROM r""", "y")
def validate_truncate(spark, d):
    return S.validated(brand_monthly(spark, d), least=36, most=48, horizon=12)


_IDS = f"WITH {LINE_SQL}, ids AS (SELECT DISTINCT series_id FROM lm), h AS (SELECT series_id, substr(sha256('42:' || series_id), 1, 16) AS key FROM ids), r AS (SELECT *, row_number() OVER (ORDER BY key) AS place, count(*) OVER () AS n FROM h)"


@query(f"{_IDS} SELECT series_id, key FROM r")
def hash_sample(spark, d):
    """Every series with the key that orders it."""
    return sampling.series_ids(line_monthly(spark, d)).select("series_id", sampling.hash_key(F.col("series_id")).alias("key"))


@query(f"{_IDS} SELECT series_id FROM r WHERE place <= 6")
def limit_by_mode(spark, d):
    return sampling.limited(sampling.series_ids(line_monthly(spark, d)), "smoke")


_ROLES = f"{_IDS}, roles AS (SELECT series_id, key, CASE WHEN place <= greatest(1, least(round_even(n * CAST(0.3 AS DOUBLE), 0), n - 1)) THEN 'development' ELSE 'evaluation' END AS role FROM r)"


@query(f"{_ROLES} SELECT * FROM roles")
def dev_eval_split(spark, d):
    return sampling.roles(sampling.series_ids(line_monthly(spark, d)))


@query(f"{_ROLES} SELECT series_id, ds, y FROM lm WHERE series_id IN (SELECT series_id FROM roles WHERE role = 'development')", "y")
def semi_join_ids(spark, d):
    obs = line_monthly(spark, d)
    return sampling.only(obs, sampling.roles(sampling.series_ids(obs)).where("role = 'development'")).select("series_id", "ds", "y")


@query(f"{_ROLES} SELECT series_id, ds, y FROM lm WHERE series_id NOT IN (SELECT series_id FROM roles WHERE role = 'development')", "y")
def anti_join_dev(spark, d):
    obs = line_monthly(spark, d)
    return sampling.without(obs, sampling.roles(sampling.series_ids(obs)).where("role = 'development'")).select("series_id", "ds", "y")


@query("SELECT event_type, user_id, avg(value) AS mean, count(*) AS n FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE GROUP BY 1, 2", "mean")
def finite_filter(spark, d):
    rows = transforms.finite(table(spark, d, "events").withColumn("y", F.col("value")))
    return rows.groupBy("event_type", "user_id").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query(f"{WITH}, c AS (SELECT series_id, ds, y - CASE WHEN series_id LIKE '%1' THEN 50 ELSE 0 END AS y FROM bm), s AS (SELECT *, min(y) OVER (PARTITION BY series_id) > 0 AS ok FROM c) SELECT series_id, ds, CASE WHEN ok THEN 'log' ELSE 'identity' END AS scale, CASE WHEN ok THEN ln(CASE WHEN ok THEN y ELSE 1 END) ELSE y END AS z, y AS back FROM s", "z back")
def log_if_positive(spark, d):
    obs = brand_monthly(spark, d).withColumn("y", F.col("y") - F.when(F.col("series_id").endswith("1"), 50).otherwise(0))
    return transforms.log_if_positive(obs).select("series_id", "ds", "scale", "z", transforms.inverse(F.col("z"), F.col("scale")).alias("back"))


_SPLIT = f"{WITH}, s AS (SELECT *, CASE WHEN t >= n - 12 THEN 'test' ELSE 'train' END AS split FROM bm WHERE n > 12)"


@query(f"{_SPLIT} SELECT series_id, ds, t, n, y, split FROM s", "y")
def tail_split(spark, d):
    return splits.tail(brand_monthly(spark, d), 12)


@query(f"""{_SPLIT}, c AS (SELECT series_id, ds, split, y - 40 AS y FROM s), o AS (SELECT *, greatest(0, CAST(0.001 AS DOUBLE) - min(CASE WHEN split = 'train' THEN y END) OVER (PARTITION BY series_id)) AS off FROM c)
SELECT series_id, ds, off AS "offset", CASE WHEN y + off > 0 THEN ln(CASE WHEN y + off > 0 THEN y + off ELSE 1 END) END AS z FROM o""", "\"offset\" z")
def positive_log(spark, d):
    obs = splits.tail(brand_monthly(spark, d), 12).withColumn("y", F.col("y") - 40)
    return transforms.positive_log(obs).select("series_id", "ds", "offset", "z")


@query(f"""{_SPLIT}, q AS (SELECT series_id, quantile_cont(y, 0.5) AS center, (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / CAST(1.35 AS DOUBLE) AS sp FROM s WHERE split = 'train' GROUP BY 1)
SELECT series_id, ds, center, CASE WHEN sp > 1e-8 THEN sp ELSE 1 END AS spread, (y - center) / CASE WHEN sp > 1e-8 THEN sp ELSE 1 END AS z FROM s JOIN q USING (series_id)""", "center spread z")
def robust_scale(spark, d):
    return transforms.robust_scale(splits.tail(brand_monthly(spark, d), 12)).select("series_id", "ds", "center", "spread", "z")


@query(f"""{_SPLIT}, q AS (SELECT series_id, avg(y) AS mean, stddev_pop(y) AS sd FROM s WHERE split = 'train' GROUP BY 1)
SELECT series_id, ds, mean, sd, (y - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM s JOIN q USING (series_id)""", "mean sd z")
def standard_scale(spark, d):
    return transforms.standard_scale(splits.tail(brand_monthly(spark, d), 12)).select("series_id", "ds", "mean", "sd", "z")


@query(f"""{WITH}, k AS (SELECT series_id, ds, CASE WHEN t % 5 <> 0 THEN y END AS y FROM bm)
SELECT series_id, ds, last(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS UNBOUNDED PRECEDING) AS forward, first(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM k""", "forward backward")
def ffill_bfill(spark, d):
    obs = brand_monthly(spark, d).withColumn("y", F.when(F.col("t") % 5 != 0, F.col("y")))
    return transforms.fill(obs).select("series_id", "ds", "forward", "backward")


@query(f"{WITH}, e AS (SELECT series_id, max(ds) AS last FROM bm GROUP BY 1), h AS (SELECT series_id, last, unnest(range(1, 13))::INTEGER AS h FROM e) SELECT series_id, h, last_day(last + to_months(h)) AS ds FROM h")
def future_index(spark, d):
    return transforms.future_index(brand_monthly(spark, d), 12)


@query("""SELECT p_partkey, coalesce(replace(format('{:,.3f}', p_retailprice), ' ', ''), '--') AS price, regexp_replace(p_name || '_' || p_brand || '&#', '([&%$#_{}])', '\\\\\\1', 'g') AS name FROM part""")
def format_table(spark, d):
    name = F.concat("p_name", F.lit("_"), "p_brand", F.lit("&#"))
    return table(spark, d, "part").select("p_partkey", transforms.table_number(F.col("p_retailprice")).alias("price"), transforms.escaped(name).alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE (l_extendedprice * l_discount + l_extendedprice) / 2 END AS pred FROM lineitem", "pred")
def forecast_columns(spark, d):
    """A point forecast, or the midpoint where only bounds are known."""
    pred = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", transforms.point_or_midpoint(pred, F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice")).alias("pred"))


@query(f"""{WITH}, c AS (SELECT *, floor(n * CAST(0.64 AS DOUBLE)) AS a, floor(n * CAST(0.16 AS DOUBLE)) AS b FROM bm)
SELECT series_id, ds, t, CASE WHEN t < a THEN 'train' WHEN t < a + b THEN 'calibration' ELSE 'test' END AS block FROM c WHERE n >= 18 AND a >= 12 AND b >= 3 AND n - a - b >= 3""")
def split_64_16_20(spark, d):
    return splits.three_way(brand_monthly(spark, d)).select("series_id", "ds", "t", "block")


@query(f"""{WITH}, c AS (SELECT *, least(greatest(round_even(n * CAST(0.7 AS DOUBLE), 0), 11), n - 6) AS r FROM bm WHERE n >= 17), e AS (SELECT *, least(greatest(r + round_even(n * CAST(0.2 AS DOUBLE), 0), r + 3), n - 3) AS a FROM c)
SELECT series_id, ds, t, CASE WHEN t < r THEN 'readout' WHEN t < a THEN 'adapter' ELSE 'conformal' END AS block FROM e""")
def internal_split(spark, d):
    return splits.internal(brand_monthly(spark, d)).select("series_id", "ds", "t", "block")


@query(f"""{WITH}, f AS (SELECT *, unnest(range(0, 3))::INTEGER AS fold, greatest(12, n - 6 - 12) AS first FROM bm)
SELECT series_id, fold, t, CASE WHEN t < first + fold * 6 THEN 'train' ELSE 'val' END AS part FROM f WHERE first + fold * 6 + 6 <= n AND t < first + fold * 6 + 6""")
def expanding_folds(spark, d):
    return splits.expanding_folds(brand_monthly(spark, d)).select("series_id", "fold", "t", "part")


@query(f"{WITH}, f AS (SELECT *, unnest([36, 60, 84, 120, 160]) AS history FROM bm) SELECT series_id, history, count(*) AS n, avg(y) AS mean, min(ds) AS first FROM f WHERE history <= n AND t >= n - history GROUP BY 1, 2", "mean")
def history_truncation(spark, d):
    h = splits.histories(brand_monthly(spark, d))
    return h.groupBy("series_id", "history").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("ds").alias("first"))


@query(f"""WITH {PRIORITY_SQL}, l AS (SELECT series_id, max(n)::INTEGER AS n FROM pm GROUP BY 1)
SELECT series_id, list_sort(list_distinct(list_filter([36, 48, 60, 84, 120, 160, round_even(n * CAST(0.6 AS DOUBLE), 0)::INTEGER, round_even(n * CAST(0.75 AS DOUBLE), 0)::INTEGER, round_even(n * CAST(0.9 AS DOUBLE), 0)::INTEGER, n], lambda s: s >= 24 AND s <= n))) AS grid FROM l""")
def history_grid(spark, d):
    n = priority_monthly(spark, d).groupBy("series_id").agg(F.max("n").cast("int").alias("n"))
    return n.select("series_id", splits.history_grid(F.col("n")).alias("grid"))


_PARAMS = "SELECT p_partkey, p_size AS n, (p_partkey % 40 + 1)::INTEGER AS lookback, (p_partkey % 7)::INTEGER AS p, (p_partkey % 24 + 1)::INTEGER AS lags, p_retailprice / 2000 AS ratio FROM part"


@query(f"""WITH c AS ({_PARAMS}) SELECT p_partkey, greatest(1, least(lookback, n - 2))::INTEGER AS lookback, least(p, n // 4)::INTEGER AS p, greatest(1, least(lags, n // 3))::INTEGER AS ar_lags,
greatest(1, least(lags, n // 4))::INTEGER AS state_lags, n >= 26 AS seasonal, greatest(CAST(0.55 AS DOUBLE), least(CAST(0.85 AS DOUBLE), ratio)) AS ratio FROM c""", "ratio")
def feasible_params(spark, d):
    """Parameters held to what a series of n rows allows."""
    n, k = F.col("p_size"), F.col("p_partkey")
    clip = lambda v, lo, hi: F.greatest(F.lit(lo), F.least(v, hi)).cast("int")
    quarter, third = F.floor(n / 4), F.floor(n / 3)
    ratio = F.greatest(F.lit(0.55), F.least(F.lit(0.85), F.col("p_retailprice") / 2000))
    return table(spark, d, "part").select("p_partkey", clip(k % 40 + 1, 1, n - 2).alias("lookback"), F.least(k % 7, quarter).cast("int").alias("p"), clip(k % 24 + 1, 1, third).alias("ar_lags"), clip(k % 24 + 1, 1, quarter).alias("state_lags"), (n >= 26).alias("seasonal"), ratio.alias("ratio"))


@query("""WITH p AS (SELECT DISTINCT p_partkey % 3 AS g, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%'),
s AS (SELECT last_day(l_shipdate) AS ds, sum(l_quantity) AS y FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND (p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#3%') GROUP BY 1),
m AS (SELECT last_day(unnest(generate_series(date_trunc('month', min(ds)), date_trunc('month', max(ds)), INTERVAL 1 MONTH))::DATE) AS ds FROM s)
SELECT ds, coalesce(y, 0) AS y FROM m LEFT JOIN s USING (ds)""", "y")
def prefix_rollup(spark, d):
    """All products whose name begins with one of some prefixes, as one series."""
    j = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_brand like 'Brand#1%' or p_brand like 'Brand#3%'"), F.col("l_partkey") == F.col("p_partkey"))
    one = S.long_to_monthly(j.select(F.lit("all").alias("s"), "l_shipdate", "l_quantity"), "s", "l_shipdate", "l_quantity", positive=True)
    return S.calendar_fill(one).select("ds", "y")
