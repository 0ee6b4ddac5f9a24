"""Finding and reading files: by pattern or keywords, in any of the usual encodings, below any path that Spark reads."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listed(spark: SparkSession, root: str) -> list[str]:
    """All files below ``root``, in order of their paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return sorted(r.path for r in files.collect())  # names of the files of one collection


def find(spark: SparkSession, root: str, patterns: Sequence[str], required: bool = True) -> str | None:
    """The first file (in order) that fits the first pattern that any fits, by its name or its path below ``root``, without regard to case."""
    paths = listed(spark, root)
    base = root.rstrip("/").split("/")[-1]
    for pattern in patterns:
        for path in paths:
            below = path.partition(f"/{base}/")[2] or path.rsplit("/", 1)[-1]
            if any(fnmatch.fnmatch(name.lower(), pattern.lower()) for name in (path.rsplit("/", 1)[-1], below)):
                return path
    if required:
        raise FileNotFoundError(f"no file like {', '.join(patterns)} below {root}")
    return None


def best_match(paths: Sequence[str], keywords: Sequence[str], endings: Sequence[str] = (".tsf", ".ts"), also: str = "monthly") -> str | None:
    """Of the paths with one of the endings, that with most keywords, then with ``also``, then of the first ending, then the shortest."""
    fit = [p for p in paths if p.lower().endswith(tuple(endings))]
    return min(fit, key=lambda p: (-sum(k in p.lower() for k in keywords), also not in p.lower(), not p.lower().endswith(endings[0]), len(p), p), default=None)


def text_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of a text file are, else ISO-8859-1: known only from all lines, by one aggregate over the file."""
    ok = spark.read.text(path).agg(F.coalesce(F.min(F.is_valid_utf8("value").cast("int")), F.lit(1)).alias("ok")).first().ok
    return "UTF-8" if ok else "ISO-8859-1"


def text_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Lines (column value) of a file, without a byte-order mark: UTF-8, or Latin-1 where any line is not UTF-8.

    ``encoding``: another one, as it is.
    """
    if encoding and encoding.upper() not in ("UTF-8", "UTF8"):
        return spark.read.option("encoding", encoding).option("lineSep", "\n").text(path).select(F.rtrim("value", F.lit("\r")).alias("value"))
    value = F.col("value") if text_encoding(spark, path) == "UTF-8" else F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return spark.read.text(path).select(F.regexp_replace(value, "^\ufeff", "").alias("value"))


def numbered_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """``text_lines`` of one file with line: numbers that grow along the file (not without gaps)."""
    return text_lines(spark, path, encoding).withColumn("line", F.monotonically_increasing_id())


def delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None) -> DataFrame:
    """Delimited text whose first line with text is the header, all columns strings; empty fields are null.

    The delimiter is the one that cuts the header, and the lines after it, into
    most fields of equal number: fields in double quotes count as one.  A quoted
    field may not hold a line break.
    """
    lines = text_lines(spark, path, encoding).where(F.trim("value") != "")
    first = [r.value for r in lines.take(20)]
    if not first:
        raise ValueError(f"{path} is empty")
    bare = [re.sub(r'"[^"]*"', "", line) for line in first]
    sep = sep or max(",;\t|", key=lambda x: (sum(line.count(x) == bare[0].count(x) for line in bare) if x in bare[0] else 0, bare[0].count(x)))
    own = encoding or text_encoding(spark, path)
    rows = spark.read.csv(path, sep=sep, header=True, encoding=own, quote='"', escape='"', **({"lineSep": "\n"} if own.upper() not in ("UTF-8", "UTF8", "ISO-8859-1") else {}))
    names = [re.sub(r"^\ufeff|^\xef\xbb\xbf|\r$", "", n).strip().strip('"').strip() for n in rows.columns]
    return rows.toDF(*[f"c{i}" for i in range(len(names))]).select(*[F.nullif(F.rtrim(f"c{i}", F.lit("\r")), F.lit("")).alias(n) for i, n in enumerate(names)])
