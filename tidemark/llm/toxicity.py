"""Toxicity by non-negative positive-unlabelled learning.

Only toxic examples are known to be what they are; everything else is
unlabelled.  With the share ``prior`` of toxic texts, the risk of a classifier g
is prior * R+(g, +) + max(0, Ru(g, -) - prior * R+(g, -)): the part that the
negative class adds is estimated from unlabelled text less its toxic share, and
is kept from turning negative, where the step goes back instead (Kiryo et al.,
2017).  The classifier is linear over hashed words and
beginnings of words, with weights learned by
numpy in mini-batches; the features with too few toxic texts are not used.

It is fitted on at most MOST toxic and 2 * MOST unlabelled texts, taken in the
order of a hash, with at most WIDEST features of each, so what reaches the driver
has a bound in bytes; it scores every whole text by all its features.

Null and empty texts have no words and get the score of the bias.  Labels may be
null, without doc_id (not used) or repeated: a document is a toxic example if any of its labels says so.
Without toxic examples every score is 0.  Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, U64, Words, slices
from .quality_classifier import narrowed, one_each

BITS = 18
MOST = 3000
WIDEST = 4000
#: Bytes of the beginnings of words that are features beside the words.
PREFIXES = (5, 7)
#: A feature counts if so many toxic examples have it.
LEAST = 2
#: And if it is commoner in them than in unlabelled text by this much: root of the examples times log of the ratio.
SURPRISE = 5.0


def word_counts(strings: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words and beginnings of words of texts: text number, bucket, count of each pair that occurs, and words in each text."""
    w = Words(strings, ALNUM)
    doc = w.doc_of_word().astype(np.int64) << bits
    pair = np.concatenate([doc | (h >> U64(64 - bits)).astype(np.int64) for h in (w.hash, *(w.prefix_hash(n) for n in PREFIXES))])
    pair, count = np.unique(pair, return_counts=True)
    return pair >> bits, pair & ((1 << bits) - 1), count, w.counts


def values(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A feature's value: more for repeats, less in long texts."""
    return (np.log1p(count) * 4 / np.log(16.0 + words)).astype(np.float32)


def features(docs: DataFrame, text: str, widest: int = WIDEST) -> DataFrame:
    """kind and at most ``widest`` features (bucket, value lists) of each of a bounded sample of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, bucket, count, words = word_counts(b.column("text"))
            doc, bucket, v = narrowed(doc, bucket, values(count, words[doc]), widest, 1 << BITS)
            off = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.ListArray.from_arrays(off, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(v))], ["kind", "bucket", "value"])

    return docs.select("kind", F.col(text).alias("text")).mapInArrow(run, "kind int, bucket array<int>, value array<float>")


def fit(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]], prior: float, bits: int = BITS, epochs: int = 60, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the sigmoid loss."""
    rng = np.random.default_rng(seed)
    weight, bias = np.zeros(1 << bits, np.float32), 0.0
    if not positive:
        return weight, -100.0
    seen = np.bincount(np.concatenate([b for b, _ in positive]), minlength=1 << bits)
    used = seen >= min(LEAST, len(positive))
    # start from how much commoner a word is in toxic texts
    base = np.bincount(np.concatenate([b for b, _ in unlabelled]), minlength=1 << bits) if unlabelled else np.zeros(1 << bits)
    ratio = np.log((seen + 0.5) / (len(positive) + 1)) - np.log((base + 0.5) / (len(unlabelled) + 1))
    surprise = np.sqrt(seen) * ratio
    used &= surprise > SURPRISE
    weight[used] = np.clip(ratio[used], 0, 4)
    bias = -2.0
    m, v, mb, vb, step = np.zeros_like(weight), np.zeros_like(weight), 0.0, 0.0, 0
    trim = lambda xs: [(b[used[b]], x[used[b]]) for b, x in xs]
    positive, unlabelled = trim(positive), trim(unlabelled)
    batches = max(1, len(positive) // 128)

    def slopes(rows: list, sign: float) -> tuple[float, np.ndarray, float]:
        """Mean sigmoid loss for label ``sign``, and its gradient by weight and bias."""
        b = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, int)
        x = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0)
        of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        z = np.bincount(of, weight[b] * x, minlength=len(rows)) + bias
        loss = 1 / (1 + np.exp(np.clip(sign * z, -30, 30)))
        d = -sign * loss * (1 - loss) / max(1, len(rows))
        return float(loss.mean()) if rows else 0.0, np.bincount(b, d[of] * x, minlength=1 << bits), float(d.sum())

    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), batches), np.array_split(rng.permutation(len(unlabelled)), batches)
        for p, u in zip(ps, us):
            rp, ru = [positive[i] for i in p], [unlabelled[i] for i in u]
            lp, gp, bp = slopes(rp, 1.0)
            ln, gn, bn = slopes(rp, -1.0)
            lu, gu, bu = slopes(ru, -1.0)
            if lu - prior * ln >= 0:
                g, gb = prior * gp + gu - prior * gn, prior * bp + bu - prior * bn
            else:
                g, gb = prior * gn - gu, prior * bn - bu
            g = g + decay * weight * used
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            s = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            weight -= (s * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            bias -= s * mb / (np.sqrt(vb) + 1e-8)
    return weight, float(bias)


def train(docs: DataFrame, labels: DataFrame, learn: Column, *, prior: float | None = None, most: int = MOST, widest: int = WIDEST, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> tuple[np.ndarray, float]:
    """Fit on documents for which ``learn`` (of column doc_id) holds; ``prior`` is the share of toxic labels if not given."""
    l = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("t")).where("t is not null").where(learn).groupBy("doc_id").agg(F.max("t").alias("t"))
    share, positives = l.agg(F.avg((F.col("t") == 1).cast("double")), F.sum((F.col("t") == 1).cast("long"))).first()
    if not positives:
        return fit([], [], 0.0)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    order = F.xxhash64("doc_id", F.lit(5))
    p = l.where("t = 1").orderBy(order).limit(most).select(F.col("doc_id").alias("p_id"))
    u = d.where(learn).select("doc_id").distinct().orderBy(order).limit(2 * most).select(F.col("doc_id").alias("p_id"))
    chosen = p.withColumn("kind", F.lit(1)).unionByName(u.withColumn("kind", F.lit(0)))
    chosen = chosen.groupBy("p_id").agg(F.collect_list("kind").alias("kinds"))
    one = one_each(d.join(chosen, F.col("doc_id") == F.col("p_id")), "p_id")
    rows = features(one.select(F.explode("kinds").alias("kind"), "text"), "text", widest).toArrow()  # at most 3 * most texts of ``widest`` features
    kind = rows.column("kind").to_numpy()
    lists = [(b.values.to_numpy(), v.values.to_numpy()) for b, v in zip(rows.column("bucket"), rows.column("value"))]
    return fit([x for x, k in zip(lists, kind) if k == 1], [x for x, k in zip(lists, kind) if k == 0], float(share if prior is None else prior))


def score(docs: DataFrame, model: tuple[np.ndarray, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, score."""
    weight, bias = model
    bits = int(np.log2(len(weight)))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            doc, bucket, count, words = word_counts(b.column("text"), bits)
            z = np.bincount(doc, weight[bucket] * values(count, words[doc]), minlength=b.num_rows) + bias
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
