"""Quality classifier: a factorisation machine over hashed words and text structure.

A text's features are its distinct words, hashed, each with the value one over
the root of their number, and one feature for each statistic of its structure
(shares of capitals, digits, symbols, repeated words and lines, lengths and so
on), which says in which of a few fixed intervals the statistic lies.  Columns of
metadata, if any are named, are intervals likewise (null and what is no number is one more).  A
factorisation machine adds to a linear score all pairwise interactions through
low-rank vectors: sum over f of ((sum v x)**2 - sum v**2 x**2) / 2, linear in
the features.  It is fitted by numpy with AdaGrad on at most MOST labelled texts,
taken in the order of a hash, with at most WIDEST words of each, again by a hash,
so what reaches the driver has a bound in bytes; it scores every whole text by all
its words.

Null and empty texts have no words, and the structure of an empty text.  Labels
may be null (not used), repeated (the least counts), or without doc_id (not used).  Without labels all
scores are 0.5.  Repeated rows are scored each; one row of a doc_id is learned.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import SPACED, U64, Words, mix, slices, windows

BITS = 14
RANK = 4
MOST = 6000
WIDEST = 2000
_SHARE = np.array([1e-9, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5, 0.8])
_COUNT = np.array([1, 3, 10, 30, 100, 300, 1000, 3000, 10000, 30000])
_MEAN = np.array([1, 2, 3, 4, 5, 6, 8, 12, 20, 50])
#: Statistics and the limits of their intervals.
STATISTICS = {
    "words": _COUNT, "bytes": _COUNT, "word_length": _MEAN, "longest_word": _MEAN * 4, "upper": _SHARE, "digits": _SHARE, "symbols": _SHARE,
    "exclamations": _SHARE, "stops": _SHARE, "other_marks": _SHARE, "non_ascii": _SHARE, "repeated_words": _SHARE, "twins": _SHARE, "repeated_runs": _SHARE,
    "lines": _COUNT, "words_a_line": _COUNT, "short_words": _SHARE,
}
#: Limits of intervals for lengths given as metadata.
LENGTHS = _COUNT
_WIDTH = 11
SIZE = (1 << BITS) + _WIDTH * len(STATISTICS)
#: Intervals of a column of metadata.
_WIDER = _WIDTH + 1


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "upper": _class(bytes(range(65, 91))), "digits": _class(b"0123456789"), "symbols": _class(b"#*$%&|<>@^~_=+\\{}[]"), "exclamations": _class(b"!?"),
    "stops": _class(b"."), "other_marks": _class(b",;:'\"()/-`"), "non_ascii": _class(bytes(range(0xC0, 0x100))),
}


def structure(w: Words) -> np.ndarray:
    """Interval numbers, a column for each statistic."""
    n, size = w.counts, np.diff(w.offsets)
    per = lambda x: np.add.reduceat(np.concatenate([x, [0]]), np.minimum(w.first[:-1], len(x))) * (n > 0) if len(n) else np.zeros(0)
    lengths = w.ends - w.starts
    longest = np.zeros(len(n))
    some = np.flatnonzero(n)
    if len(some):
        longest[some] = np.maximum.reduceat(lengths, w.first[some])
    count = lambda t: np.diff(np.concatenate([[0], np.cumsum(t[w.data])])[w.offsets])
    words, chars = np.maximum(n, 1), np.maximum(size, 1)
    doc = w.doc_of_word()

    def repeated(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of each text's hashes, how many are not the first of their kind."""
        pair = np.unique(h ^ mix(of.astype(U64) + U64(11)), return_index=True)[1]
        return np.bincount(of, minlength=len(n)) - np.bincount(of[pair], minlength=len(n))

    run = windows(w.hash, 5)
    fits = w.fits(5) if len(run) else np.zeros(0, bool)
    twin = np.zeros(len(w.hash), np.int64)
    if len(twin) > 1:
        twin[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    lines = count(_class(b"\n")) + 1
    s = {"words": n, "bytes": size, "word_length": per(lengths) / words, "longest_word": longest, "repeated_words": repeated(w.hash, doc) / words, "twins": per(twin) / words,
         "repeated_runs": repeated(run[fits], doc[: len(run)][fits]) / words, "lines": lines, "words_a_line": n / lines, "short_words": per((lengths < 2).astype(np.int64)) / words}
    s |= {k: count(t) / chars for k, t in _CLASSES.items()}
    return np.stack([np.searchsorted(limits, s[k], "right") for k, limits in STATISTICS.items()], 1) if len(n) else np.zeros((0, len(STATISTICS)), np.int64)


def features(strings: pa.Array, given: Sequence[pa.Array] = (), limits: Sequence[np.ndarray] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, feature number and value of each feature that is not 0, in order of texts; ``given``: columns of metadata as doubles."""
    w = Words(strings, SPACED)
    pair = np.unique((w.doc_of_word().astype(np.int64) << BITS) | (w.hash >> U64(64 - BITS)).astype(np.int64))
    doc, bucket = pair >> BITS, pair & ((1 << BITS) - 1)
    distinct = np.bincount(doc, minlength=len(w.counts))
    value = 1 / np.sqrt(np.maximum(distinct, 1))[doc]
    bins = structure(w)
    own = (1 << BITS) + _WIDTH * np.arange(len(STATISTICS)) + bins
    for k, (column, steps) in enumerate(zip(given, limits)):
        x = column.to_numpy(zero_copy_only=False).astype(float)  # null becomes NaN
        own = np.column_stack([own, SIZE + _WIDER * k + np.where(np.isnan(x), _WIDTH, np.searchsorted(steps, x, "right"))])
    doc = np.concatenate([doc, np.repeat(np.arange(len(bins)), own.shape[1])])
    bucket, value = np.concatenate([bucket, own.reshape(-1)]), np.concatenate([value, np.full(own.size, 1.0)])
    order = np.argsort(doc, kind="stable")
    return doc[order], bucket[order].astype(np.int32), value[order].astype(np.float32)


def narrowed(doc: np.ndarray, which: np.ndarray, value: np.ndarray, widest: int, always: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``widest`` features of each text, by a hash of their numbers; those from ``always`` on stay."""
    first = mix(which.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(17))
    order = np.lexsort((first, which >= always, doc))
    own = doc[order]
    place = np.arange(len(own)) - np.searchsorted(own, own)
    keep = np.sort(order[(place < widest) | (which[order] >= always)])
    return doc[keep], which[keep], value[keep]


class Machine:
    """Bias, weights and factors; metadata: the columns that are read beside the text, and their limits (at most 10 each)."""

    def __init__(self, seed: int = 3, metadata: dict[str, Sequence[float]] | None = None):
        rng, self.metadata = np.random.default_rng(seed), {k: np.asarray(v, float) for k, v in (metadata or {}).items()}
        if any(len(v) >= _WIDTH for v in self.metadata.values()):
            raise ValueError(f"metadata may have {_WIDTH - 1} limits")
        size = SIZE + _WIDER * len(self.metadata)
        self.bias, self.weight = 0.0, np.zeros(size, np.float32)
        self.factor = rng.normal(0, 0.01, (size, RANK)).astype(np.float32)

    def columns(self, docs: DataFrame) -> list[Column]:
        """The metadata of ``docs`` as doubles m0, m1, ...; null where there is no such column."""
        return [(F.col(f"`{k}`").cast("string").try_cast("double") if k in docs.columns else F.lit(None).cast("double")).alias(f"m{i}") for i, k in enumerate(self.metadata)]

    def features(self, batch: pa.RecordBatch, text: str, given: Sequence[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names = [f"m{i}" for i in range(len(self.metadata))] if given is None else given
        return features(batch.column(text), [batch.column(n) for n in names], list(self.metadata.values()))

    def raw(self, doc: np.ndarray, which: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and sum v x of each text."""
        z = np.bincount(doc, self.weight[which] * value, minlength=n) + self.bias
        total = np.zeros((n, RANK))
        for f in range(RANK):
            vx = self.factor[which, f] * value
            total[:, f] = np.bincount(doc, vx, minlength=n)
            z += 0.5 * (total[:, f] ** 2 - np.bincount(doc, vx * vx, minlength=n))
        return z, total

    def fit(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 5) -> "Machine":
        """AdaGrad on the mean logistic loss of mini-batches."""
        rng, eps = np.random.default_rng(seed), 1e-6
        gw, gv, gb = np.full(len(self.weight), eps), np.full(self.factor.shape, eps), eps
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                there, b, w, v = self.slopes([texts[i] for i in own], labels[own])
                w, v = w + decay * self.weight[there], v + decay * self.factor[there]
                gw[there] += w * w
                self.weight[there] -= (rate * w / np.sqrt(gw[there])).astype(np.float32)
                gv[there] += v * v
                self.factor[there] -= (0.2 * rate * v / np.sqrt(gv[there])).astype(np.float32)
                gb += b**2
                self.bias -= rate * b / np.sqrt(gb)
        return self

    def slopes(self, texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        """The features that occur, and the mean logistic loss's slope by the bias, their weights and their factors."""
        which, value = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
        doc = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
        z, total = self.raw(doc, which, value, len(texts))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(texts)
        there, place = np.unique(which, return_inverse=True)
        v = [np.bincount(place, d[doc] * value * (total[doc, f] - self.factor[which, f] * value)) for f in range(RANK)]
        return there, float(d.sum()), np.bincount(place, d[doc] * value), np.stack(v, 1)


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: that of the text with the least hash, so repeated rows cannot crowd a sample."""
    kept = [F.min_by(F.struct(*rows.columns), F.struct(F.xxhash64("text"), F.col("text"))).alias("r")]
    return rows.groupBy(F.col(key).alias("one_key")).agg(*kept).select("r.*")


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, metadata: dict[str, Sequence[float]] | None = None, most: int = MOST, widest: int = WIDEST, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> Machine:
    """Fit on at most ``most`` labelled documents for which ``learn`` (of column doc_id) holds, and ``widest`` words of each; ``metadata`` names columns and the limits of their intervals."""
    machine = Machine(metadata=metadata)
    l = labels.select(F.col(doc_id).alias("doc_id"), F.col(quality).alias("q")).where("q is not null").where(learn).groupBy("doc_id").agg(F.min("q").alias("q"))
    l = l.orderBy(F.xxhash64("doc_id", F.lit(9))).limit(most).select(F.col("doc_id").alias("l_id"), "q")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *machine.columns(docs)).join(l, F.col("doc_id") == F.col("l_id"))
    d = one_each(d, "l_id").drop("doc_id", "l_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, which, value = narrowed(*machine.features(b, "text"), widest, 1 << BITS)
            off = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("q"), pa.ListArray.from_arrays(off, pa.array(which)), pa.ListArray.from_arrays(off, pa.array(value))], ["q", "which", "value"])

    rows = d.withColumn("q", F.col("q").cast("int")).mapInArrow(run, "q int, which array<int>, value array<float>").toArrow()  # at most ``most`` rows of ``widest`` features and those of structure
    texts = [(a.values.to_numpy(), v.values.to_numpy()) for a, v in zip(rows.column("which"), rows.column("value"))]
    return machine.fit(texts, (rows.column("q").to_numpy() == 1).astype(float))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` cut to doc_id, k (hash of the text) and score."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            z, _ = machine.raw(*machine.features(b, "text"), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "k", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"), *machine.columns(docs)).mapInArrow(run, f"doc_id {kind}, k long, score double")


def keep(docs: DataFrame, machine: Machine, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``."""
    names, at = docs.columns, docs.columns.index(text)
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of any kind may clash
    given = [f"m{i}" for i in range(len(machine.metadata))]
    d = own.select("*", *[(F.col(f"c{names.index(k)}").cast("string").try_cast("double") if k in names else F.lit(None).cast("double")).alias(m) for m, k in zip(given, machine.metadata)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{at}"):
            z, _ = machine.raw(*machine.features(b, f"c{at}", given), b.num_rows)
            yield b.select(list(range(len(names)))).filter(pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))) >= least))

    return d.mapInArrow(run, own.schema).toDF(*names)
