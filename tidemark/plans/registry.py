"""Registered queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Decimals of floating results, in both engines.
DIGITS = 6


def query(sql: str | None = None, floats: str = ""):
    """Registers a function under its name; ``floats``: columns that are rounded in the SQL as here."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(c, DIGITS) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])

        QUERIES[f.__name__] = run
        if sql:
            swaps = ", ".join(f"round({c}, {DIGITS}) + 0.0 AS {c}" for c in floats.split())
            body = sql.strip()
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({swaps}) FROM ({body}) AS result" if swaps else body
        return f

    return register
