"""Quality rules: document counts, and lines that recur across a host's documents.

Lines are normalised (words joined by one blank, A-Z lower-cased, digits to 0)
and hashed.  For every host, the distinct documents that hold a line are
counted; documents with equal text count once, so copies do not make a line
boilerplate.  Lines in more than ``most`` documents and more than the share
``share`` of their host's documents are removed, and a document that keeps less
than the share ``left`` of its words is rejected.

The share grows with the host, so lines of one section of a large host stay.
With ``many``, lines in more than so many documents are removed too, whatever
their share; with ``copies``, each doc_id is a document, of equal text or not.

``cleaned`` gives the kept documents' remaining texts, ``judge`` the counts; both
are read off the same rows.  A removed line goes with its line break; texts
without frequent lines stay as they are.

(host, line) counts are pre-aggregated before the shuffle; frequent lines are
joined to the documents' lines, never gathered by line or host.  What is joined
back to a document are the numbers and words of its removed lines; the texts
themselves are written and joined by ``cleaned`` alone.

Null texts have no words.  Null hosts are one host.  Repeated rows are one
document for the counts and are judged each.  An empty table gives an empty
result.  Further columns of any name are kept by ``cleaned`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ._scratch import written
from ._text import SPACED, U64, Words, mix, signed, slices, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: A-Z lower-cased, digits to 0.
_NORMAL = SPACED.copy()
_NORMAL[65:91] += 32
_NORMAL[0x31:0x3A] = 0x30


def _per(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x by text."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[first])


def repeat_words(w: Words, size: int = 5) -> np.ndarray:
    """Words of each text inside windows of ``size`` words that its text has twice or more."""
    h, n = windows(w.hash, size), len(w.starts)
    fits = w.fits(size) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(fits)
    key = h[at] ^ mix(w.doc_of_word()[at].astype(U64) + U64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(n + 1, np.int64)
    cover[at[twice]] += 1
    cover[at[twice] + size] -= 1
    return _per(np.cumsum(cover[:-1]) > 0, w.first)


def _lines(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: hash, words, text number, number of the line in its text (of words in ``w``, normalised)."""
    if not len(w.starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.union1d(np.flatnonzero(w.data == 0x0A) + 1, w.offsets[:-1])
    line = np.searchsorted(begin, w.starts, "right")
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    count = np.diff(np.concatenate([start, [len(line)]]))
    place = np.arange(len(line)) - np.repeat(start, count)
    h = mix(np.add.reduceat(mix(w.hash ^ mix(place.astype(U64) + U64(3))), start) + count.astype(U64))
    doc = w.doc_of_word()[start]
    return h, count, doc, line[start] - np.searchsorted(begin, w.offsets[:-1], "right")[doc]


#: Columns that ``counts`` adds.
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with column text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; lines, line_words and line_at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = b.column("text")
            w = Words(texts, SPACED)
            chars = ((w.data & 0xC0) != 0x80) & (w.mapped != 0)
            dup = []
            for t in texts.to_pylist():
                lines = [x for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
                dup.append(len(lines) - len(set(lines)))
            h, size, doc, at = _lines(Words(texts, _NORMAL))
            off = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            longs = [w.counts, _per(chars, w.offsets), _per(_SYMBOL[w.data], w.offsets), np.array(dup), repeat_words(w)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *(pa.array(x.astype(np.int64)) for x in longs), pa.ListArray.from_arrays(off, pa.array(signed(h))), *(pa.ListArray.from_arrays(off, pa.array(x.astype(np.int32))) for x in (size, at))],
                [*b.schema.names, *_COUNTS, "lines", "line_words", "line_at"],
            )

    added = [*(StructField(c, LongType()) for c in _COUNTS), StructField("lines", ArrayType(LongType())), *(StructField(c, ArrayType(IntegerType())) for c in ("line_words", "line_at"))]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def frequent_lines(found: DataFrame, most: int, share: float, many: int | None = None, copies: bool = False) -> DataFrame:
    """(f_host, f_line, docs): lines above both limits, or above ``many``."""
    if copies:
        ids = found.select("host", "doc_id").distinct()
        line = found.select("host", "doc_id", F.explode("lines").alias("line")).distinct()
    else:
        ids = found.groupBy("host", "k").agg(F.first("lines").alias("lines"))
        line = ids.select("host", F.explode(F.array_distinct("lines")).alias("line"))
    hosts = ids.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("all"))
    each = line.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > (most if many is None else min(most, many)))
    often = (F.col("docs") > most) & (F.col("docs") > F.col("all") * share)
    often = often if many is None else often | (F.col("docs") > many)
    return each.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(often).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"), "docs")


def _cut(rows: DataFrame) -> DataFrame:
    """``rows``, text without the lines whose numbers are in column gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            at, gone = b.schema.get_field_index("text"), b.column("gone")
            texts, some = b.column(at), np.flatnonzero(pc.is_valid(gone).to_numpy(zero_copy_only=False))
            if len(some):
                new = []
                for text, lines in zip(texts.take(pa.array(some)).to_pylist(), gone.take(pa.array(some)).to_pylist()):
                    lines = set(lines)
                    new.append("\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines))
                mask = np.zeros(b.num_rows, bool)
                mask[some] = True
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 :]], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _judged(docs: DataFrame, most: int, share: float, many: int | None, copies: bool, left: float, base_failed: Column | None, texts: bool) -> DataFrame:
    """``docs`` (doc_id, host, k, text and others; text only if ``texts``) and the counts, gone (numbers of lines), removed_words, base_failed and kept."""
    found = counts(docs).withColumn("row", F.monotonically_increasing_id())
    found = written(found if texts else found.drop("text"))
    # apart from the join, so that Spark can split a line that is on every page of a large host there
    frequent = written(frequent_lines(found, most, share, many, copies))
    lines = found.select("row", "host", F.explode(F.arrays_zip("lines", "line_words", "line_at")).alias("x")).select("row", "host", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"), F.col("x.line_at").alias("at"))
    gone = lines.join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line") == F.col("f_line"))).groupBy(F.col("row").alias("g_row")).agg(F.collect_list("at").alias("gone"), F.sum("words").alias("words"))
    out = found.drop("lines", "line_words", "line_at").join(gone, F.col("row") == F.col("g_row"), "left").withColumn("removed_words", F.coalesce("words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")) if base_failed is None else base_failed
    depleted = (F.col("n_words") - F.col("removed_words")) < left * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, *, most: int = 20, share: float = 0.05, many: int | None = None, copies: bool = False, left: float = 0.3, base_failed: Column | None = None, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row a document: doc_id, the counts, removed_words (in frequent lines), base_failed, kept.

    ``base_failed``: rule on the counts; else under 10 words, or over 20 % of
    words in repeated windows.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    return _judged(d, most, share, many, copies, left, base_failed, False).select("doc_id", *_COUNTS, "removed_words", "base_failed", "kept")


def cleaned(docs: DataFrame, *, most: int = 20, share: float = 0.05, many: int | None = None, copies: bool = False, left: float = 0.3, base_failed: Column | None = None, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all columns; their text is without frequent lines."""
    names = docs.columns
    others = {n: f"c{i}" for i, n in enumerate(names) if n != text}  # names of any kind may clash
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("k"), F.col(text).alias("text"), *[F.col(f"`{n}`").alias(c) for n, c in others.items()])
    out = _judged(d, most, share, many, copies, left, base_failed, True).where("kept")
    return _cut(out.select(*others.values(), "text", "gone")).select(*[F.col(others.get(n, "text")).alias(n) for n in names])
