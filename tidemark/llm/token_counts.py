"""Token counts: exact histogram of encoded lengths, with suffix sums.

Each document counts once under its encoded length; only (length, documents)
pairs are shuffled.  Running sums over the lengths then give, for every context
limit L, how many documents and ids lie within it and what truncation to L
leaves: ids of documents up to L, plus L for each longer one.

Nulls and empty texts have length 0 (or 1 with an end id).  An empty table gives
an empty histogram.  Repeated rows count each time.  Further columns of any name
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._sums import before
from ._text import slices


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", end: bool = False) -> DataFrame:
    """(n_tokens, n_docs) of each part of the input: one row for each length there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        from ._tokens import AT_ONCE, encoder

        e, seen = encoder(tokenizer), Counter()
        for b in slices(batches, "text", AT_ONCE):
            seen.update((e.lengths(b.column("text")) + int(end)).tolist())
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "n_docs": pa.array(list(seen.values()), pa.int64())})

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", end: bool = False) -> DataFrame:
    """One row for each encoded length that occurs.

    n_tokens, n_docs; docs_longer and tokens_longer (documents of more ids and
    their ids); docs_total, tokens_total; tokens_truncated (ids that remain when
    each document is cut to n_tokens); quantile (share of documents with at most
    n_tokens ids).
    """
    h = encoded_lengths(docs, tokenizer, text, end).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    h = written(h).withColumn("ids", F.col("n_tokens") * F.col("n_docs"))
    # it was written, so texts are encoded once, not for each use below
    totals = h.agg(F.sum("n_docs").alias("docs_total"), F.sum("ids").alias("tokens_total"))
    h = h.join(before(h, "n_tokens", "n_docs").withColumnRenamed("before", "docs_shorter"), "n_tokens").join(before(h, "n_tokens", "ids").withColumnRenamed("before", "tokens_shorter"), "n_tokens")
    h = h.crossJoin(F.broadcast(totals))  # one row
    longer = F.col("docs_total") - F.col("docs_shorter") - F.col("n_docs")
    ids_upto = F.col("tokens_shorter") + F.col("ids")
    return h.select(
        "n_tokens", "n_docs", longer.alias("docs_longer"), (F.col("tokens_total") - ids_upto).alias("tokens_longer"), "docs_total", "tokens_total",
        (ids_upto + longer * F.col("n_tokens")).alias("tokens_truncated"), ((F.col("docs_total") - longer) / F.col("docs_total")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_within, tokens_truncated, tokens_dropped."""
    kept = F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
        F.coalesce(F.sum(kept), F.lit(0)).alias("tokens_truncated"),
        F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs") - kept), F.lit(0)).alias("tokens_dropped"),
    )


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least the share ``q`` of documents does not exceed."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
