"""URL filter: ratio of two character language models, in DataFrame functions alone.

Rules name a host (with its subdomains) and the beginning of a path; the longest
that fits decides.  URLs that rules allow or block are also the training text of
two variable-order Markov models of characters (orders 0 to 2; each order backs
off to the next lower one in proportion to what it has seen: Witten and Bell's
smoothing).  A URL that no rule fits is scored by the mean, over its characters,
of the log of the two models' ratio; the threshold is the score that separates
the training URLs best on a hash-chosen fifth that the models did not see.

URLs are folded to ALPHABET (other characters count as one symbol), so a model
has at most len(ALPHABET)**3 entries: one array of that size, built once and
broadcast as a single row.  The models are counted on the ruled URLs outside that
fifth, and judge every URL; where one of the kinds lies in the fifth alone, they
are counted on all ruled URLs, and the threshold is 0.  n-grams are
pre-aggregated before they are shuffled.

Null URLs and those without :// have an empty host and path and fit no rule.  A
null URL is allowed; one without :// is judged by its score, as any other.  Where
no model can be learned (no rule fits a URL of one of the kinds) all scores are 0
and what no rule fits is allowed.  Repeated rows count, and are judged, each for itself.
Further columns of any name are kept out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import written

#: The symbols of the models; the last stands for all others. The first pads the beginning.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0123456789-._~/?#=&%:+*"
_N = len(ALPHABET)
#: Learning fold: of the training URLs, those whose hash leaves this remainder set the threshold.
_FOLDS = 5

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.coalesce(F.substring(url, F.instr(url, "://") + 3, F.length(url)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, ASCII_UPPER, ASCII_LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null; rules: (verdict, host/path)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _symbols(url: Column) -> Column:
    """The URL in the models' alphabet, one character a symbol, two of padding before it."""
    low = F.translate(F.coalesce(url, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    kept = "".join(ALPHABET[1:-1]).replace("-", "")
    return F.concat(F.lit(ALPHABET[0] * 2), F.regexp_replace(low, rf"(?s)[^\-{_escaped(kept)}]", ALPHABET[-1]))


def _escaped(chars: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in chars)


def _number(gram: Column, at: int) -> Column:
    return F.instr(F.lit(ALPHABET), F.substring(gram, at, 1)) - 1


def grams(urls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g, n): how often each three-symbol string ends at a character of the URLs' column s."""
    one = F.explode(F.transform(F.sequence(F.lit(3), F.length("s")), lambda i: F.substring(F.col("s"), i - 2, F.lit(3))))
    return urls.where(F.length("s") > 2).select(*keys, one.alias("g")).groupBy(*keys, "g").agg(F.count("*").alias("n"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """One row, model: log P(accepted)/P(rejected) of each three-symbol string, as an array by its number.

    counts: (good boolean, g, n).  A string no model has seen backs off to lower orders.
    """
    c = counts.select("good", _number(F.col("g"), 1).alias("a"), _number(F.col("g"), 2).alias("b"), _number(F.col("g"), 3).alias("x"), "n")

    def order(keys: list[str]) -> tuple[DataFrame, DataFrame]:
        n = c.groupBy("good", *keys, "x").agg(F.sum("n").alias("n"))
        return n, n.groupBy("good", *keys).agg(F.sum("n").alias("t"), F.count("*").alias("d"))

    def both(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
        return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("good") == g, F.col(v))), F.lit(0)).alias(f"{v}_{s}") for v in values for g, s in ((True, "g"), (False, "r"))])

    digits = F.explode(F.sequence(F.lit(0), F.lit(_N - 1)))
    spark = counts.sparkSession
    grid = spark.range(1).select(digits.alias("a")).select("a", digits.alias("b")).select("a", "b", digits.alias("x"))
    for k, keys in enumerate(([], ["b"], ["a", "b"])):
        n, t = order(keys)
        n = both(n.withColumnRenamed("n", f"n{k}"), [*keys, "x"], [f"n{k}"])
        t = both(t.withColumnRenamed("t", f"t{k}").withColumnRenamed("d", f"d{k}"), keys, [f"t{k}", f"d{k}"]) if keys else t.agg(*[F.coalesce(F.sum(F.when(F.col("good") == g, F.col(v))), F.lit(0)).alias(f"{v}0_{s}") for v in ("t", "d") for g, s in ((True, "g"), (False, "r"))])
        # the models have at most _N**3 rows in all
        grid = grid.join(F.broadcast(n), [*keys, "x"], "left")
        grid = grid.join(F.broadcast(t), keys, "left") if keys else grid.crossJoin(F.broadcast(t))

    def p(s: str) -> Column:
        out = F.lit(1.0 / _N)
        for k in range(3):
            n, t, d = (F.coalesce(F.col(f"{v}{k}_{s}"), F.lit(0)) for v in "ntd")
            out = F.when(t > 0, (n + d * out) / F.greatest(t + d, F.lit(1))).otherwise(out)
        return out

    number = (F.col("a") * _N + F.col("b")) * _N + F.col("x")
    rows = grid.select(number.alias("i"), (F.log(p("g")) - F.log(p("r"))).alias("v"))
    ends = grid.agg(F.max("t0_g").alias("good"), F.max("t0_r").alias("bad"))
    model = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("model"))
    return model.crossJoin(F.broadcast(ends)).select(F.when((F.col("good") > 0) & (F.col("bad") > 0), F.col("model")).alias("model"))


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """``urls`` (with column s) and their score: mean log-ratio of their characters; 0 for none or without a model."""
    codes = F.transform(F.split("s", ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    with_codes = urls.withColumn("codes", codes).crossJoin(F.broadcast(model))  # one row of at most _N**3 numbers
    total = F.aggregate(
        F.sequence(F.lit(3), F.size("codes")),
        F.lit(0.0),
        lambda t, i: t + F.element_at("model", (F.element_at("codes", i - 2) * _N + F.element_at("codes", i - 1)) * _N + F.element_at("codes", i) + 1),
    )
    n = F.size("codes") - 2
    return with_codes.withColumn("score", F.when((n > 0) & F.col("model").isNotNull(), total / n).otherwise(0.0)).drop("codes", "model")


def threshold(scores: DataFrame, step: float = 0.01) -> DataFrame:
    """One row, cut: the score (a multiple of ``step``) that best separates good from bad by balanced accuracy; 0 if a kind is missing."""
    bins = scores.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.sum((~F.col("good")).cast("long")).alias("r"))
    # a bin for each step of a mean of bounded logs: a few thousand at most
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    c = bins.select("bin", F.coalesce(F.sum("g").over(upto), F.lit(0)).alias("g_below"), F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("r_below"), F.sum("g").over(whole).alias("G"), F.sum("r").over(whole).alias("R")).where("G > 0 and R > 0")
    value = F.col("r_below") / F.col("R") + (F.col("G") - F.col("g_below")) / F.col("G")
    best = c.agg(F.max_by("bin", F.struct(F.round(value, 12), -F.abs("bin"))).alias("bin"))
    return best.select(F.coalesce(F.col("bin") * step, F.lit(0.0)).alias("cut"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict (allow or block), score, cut."""
    u = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    u = u.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    u = u.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).withColumn("good", F.col("r.verdict") == "allow").withColumn("s", _symbols(F.col("url")))
    known = u.where("good is not null").withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(_FOLDS)))
    counted = written(grams(known.withColumn("held", F.col("fold") == 0), ["held", "good"]))
    model = written(log_ratios(counted.where("not held")))  # one row
    if model.where("model is not null").isEmpty():
        model = written(log_ratios(counted))
        known = known.where("false")  # no URL is unseen
    cut = written(threshold(scored(known.where("fold = 0").select("s", "good"), model)))
    out = scored(u.select("page_id", "host", "path", "r", "s", F.col("url").isNull().alias("none")), model).crossJoin(F.broadcast(cut))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("none") | (F.col("score") >= F.col("cut")), "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score", "cut")
