"""Tail probabilities of test statistics, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Degrees of freedom up to which Student's tail is the finite series; beyond, Wallace's normal transform (error below 1e-7 there).
SERIES = 2000


def normal(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by a rational approximation (error below 1.5e-7)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(poly * F.exp(-x * x), F.lit(1.0))


def student(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t with a whole number of degrees of freedom: the finite series in the angle atan(t / sqrt(df))."""
    df = df.cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(df))
    c2 = F.cos(angle) * F.cos(angle)
    odd = df % 2 == 1
    last = F.when(odd, (df - 3) / 2).otherwise((df - 2) / 2).cast("int")  # terms after the first
    steps = F.when((last >= 1) & (df <= SERIES), F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    ratio = lambda j: F.when(odd, 2.0 * j / (2.0 * j + 1)).otherwise((2.0 * j - 1) / (2.0 * j))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * c2 * ratio(j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(steps, start, step, lambda s: s["sum"])
    inside = F.when(odd, 2 / math.pi * (angle + F.when(df > 1, F.sin(angle) * F.cos(angle) * total).otherwise(0.0))).otherwise(F.sin(angle) * total)
    wide = normal(F.sqrt(df * F.log1p(t * t / df)) * (8.0 * df + 1) / (8.0 * df + 3))
    return F.when(df <= SERIES, F.greatest(1 - inside, F.lit(0.0))).otherwise(wide)


#: Coefficients of the rational approximations of the normal quantile (relative error below 1.2e-9), and where the middle one ends.
QUANTILE = {
    "middle": ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)),
    "tail": ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)),
    "end": 0.02425,
}


def normal_quantile(p: Column) -> Column:
    """The value below which a standard normal lies with probability p (above 0 and below 1; else null)."""

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + c
        return out

    q, least = p - 0.5, F.least(p, 1 - p)
    r = F.sqrt(-2 * F.log(F.when((least > 0) & (least < 1), least)))
    side = F.when(p < 0.5, 1.0).otherwise(-1.0) * poly(QUANTILE["tail"][0], r) / poly(QUANTILE["tail"][1], r)
    middle = poly(QUANTILE["middle"][0], q * q) * q / poly(QUANTILE["middle"][1], q * q)
    return F.when(least > 0, F.when(least < QUANTILE["end"], side).otherwise(middle))


def chi_square(x: Column, df: Column) -> Column:
    """Upper tail of the chi-square distribution with a whole number of degrees of freedom: a finite sum, and for an odd number a normal tail.

    Terms are made by their logarithms, each at most 1 when it is added.
    """
    df, half = df.cast("int"), x / 2
    odd = df % 2 == 1
    count = F.when(odd, (df - 1) / 2).otherwise(df / 2 - 1).cast("int")
    steps = F.when(count >= 1, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    log = F.log(half)
    start = F.struct(F.when(odd, log / 2 - math.log(math.sqrt(math.pi) / 2)).otherwise(0.0).alias("term"), F.when(odd, F.lit(0.0)).otherwise(F.exp(-half)).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        # odd: terms half**(j - 1/2) / gamma(j + 1/2); even: half**j / j!
        term = F.when(odd & (j == 1), s["term"]).otherwise(s["term"] + log - F.log(F.when(odd, j - 0.5).otherwise(j)))
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term - half)).alias("sum"))

    total = F.aggregate(steps, start, step, lambda s: s["sum"])
    return F.when(x <= 0, 1.0).otherwise(F.least(F.when(odd, normal(F.sqrt(x))).otherwise(0.0) + total, F.lit(1.0)))


def signed_rank_exact(w: Column, n: Column) -> Column:
    """Two-sided exact probability of a signed-rank sum of at most w (the lesser one) among n differences without ties.

    The number of sets of ranks with each sum is built up rank by rank; sums up
    to w are kept, so the array has at most n (n + 1) / 4 entries.
    """
    most, sets = F.floor(w).cast("int"), F.array_repeat(F.lit(0.0), F.floor(w).cast("int"))
    start = F.concat(F.array(F.lit(1.0)), sets)
    places = F.sequence(F.lit(0), most)
    counts = F.aggregate(
        F.sequence(F.lit(1), n.cast("int")), start, lambda a, r: F.transform(places, lambda s: F.element_at(a, s + 1) + F.when(s >= r, F.element_at(a, F.greatest(s - r, F.lit(0)) + 1)).otherwise(0.0))
    )
    return F.least(2 * F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) / F.pow(F.lit(2.0), n), F.lit(1.0))
