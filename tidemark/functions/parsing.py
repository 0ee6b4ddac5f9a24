"""Column functions that parse dates and numbers of mixed forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def header_date(text: Column) -> Column:
    """Date of a series header such as ``1990-01-01 00-00-00``; null where there is none."""
    day = F.regexp_extract(text, r"(\d{4})-(\d{1,2})-(\d{1,2})", 0)
    return F.try_to_date(F.when(day != "", day), "yyyy-M-d")


def month_end(text: Column) -> Column:
    """Month end of ``yyyymm`` or of a date."""
    six = text.rlike(r"^\d{6}$")
    return F.last_day(F.when(six, F.try_to_date(F.concat(text, F.lit("01")), "yyyyMMdd")).otherwise(header_date(text)))


def plain_number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def locale_number(text: Column) -> Column:
    """Number written with ``.`` between thousands and ``,`` before decimals, or with one of them."""
    bare = F.regexp_replace(text, r"[$\s]", "")
    both = bare.contains(",") & bare.contains(".")
    bare = F.when(both, F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit(".")))
    return bare.try_cast("double")


def numbers(df: DataFrame, column: str, out: str, share: float = 0.9) -> DataFrame:
    """``column`` as numbers in ``out``: read plainly if at least ``share`` of the values can be, else by locale.

    Which of the two holds is known only from all values: one pre-aggregated pass.
    """
    plain = df.agg((F.count(plain_number(F.col(column))) >= share * F.count(column)).alias("_plain"))
    return df.crossJoin(F.broadcast(plain)).withColumn(out, F.when(F.col("_plain"), plain_number(F.col(column))).otherwise(locale_number(F.col(column)))).drop("_plain")


def start_month(year: Column, month: Column, date: Column | None = None) -> Column:
    """Month end of a date, else of year and month (clamped to 1..12), else 2000-01."""
    given = F.make_date(year, F.greatest(F.lit(1), F.least(month, F.lit(12))), F.lit(1))
    return F.last_day(F.coalesce(*([date] if date is not None else []), given, F.to_date(F.lit("2000-01-01"))))
