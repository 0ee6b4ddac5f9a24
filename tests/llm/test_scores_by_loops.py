"""Both classifiers' scores of whole texts against plain loops; metadata of any kind."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier as qc
from tidemark.llm import toxicity
from tidemark.llm._text import ALNUM, SPACED, Words

TEXTS = ["You FOOL, you fool! it's 12 o'clock", None, "", " \n\t", "é É fool's " * 40, "one two three two one " * 300]


def hashed(word, table):
    return int(Words(pa.array([word]), table).hash[0])


def test_toxicity_score_by_loops(spark):
    rng = np.random.default_rng(3)
    weight, bias, bits = rng.normal(size=1 << 12).astype(np.float32), -0.4, 12
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, (weight, bias)).collect()}
    for i, text in enumerate(TEXTS):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        count = Counter(hashed(w, ALNUM) >> (64 - bits) for w in words)
        for size in toxicity.PREFIXES:  # the first bytes of every word, whether it is longer or not
            own = Words(pa.array([" ".join(words)]), ALNUM)
            count.update((own.prefix_hash(size) >> np.uint64(64 - bits)).tolist())
        z = bias + sum(float(weight[b]) * math.log1p(k) * 4 / math.log(16 + len(words)) for b, k in count.items())
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=1e-5), i
    # equal beginnings hash alike, and only those
    a, b, c = (Words(pa.array([x]), ALNUM).prefix_hash(5)[0] for x in ("toxically", "toxicity", "tonic"))
    assert a == b != c


def test_toxicity_gradient_by_differences():
    """The first step moves every used weight against the slope of the non-negative risk."""
    rng = np.random.default_rng(4)
    row = lambda lo: (np.unique(rng.integers(lo, lo + 12, 6)), None)
    rows = lambda lo, n: [(b, rng.uniform(0.05, 0.15, len(b)).astype(np.float32)) for b, _ in (row(lo) for _ in range(n))]
    positive, unlabelled, prior = rows(0, 60), rows(20, 80), 0.2
    still, bias0 = toxicity.fit(positive, unlabelled, prior, 6, epochs=0)
    moved, bias1 = toxicity.fit(positive, unlabelled, prior, 6, epochs=1, decay=0.0)

    def risk(w, b):
        loss = lambda own, sign: np.mean([1 / (1 + math.exp(sign * (float((w[i] * x * (w0[i] != 0)).sum()) + b))) for i, x in own])
        return prior * loss(positive, 1) + max(0.0, loss(unlabelled, -1) - prior * loss(positive, -1))

    w0 = still.astype(float)
    assert (still > 0).sum() > 3
    for j in np.flatnonzero(still):
        up, down = w0.copy(), w0.copy()
        up[j] += 1e-5
        down[j] -= 1e-5
        slope = (risk(up, bias0) - risk(down, bias0)) / 2e-5
        assert abs(slope) < 1e-7 or np.sign(moved[j] - still[j]) == -np.sign(slope)
    slope = (risk(w0, bias0 + 1e-5) - risk(w0, bias0 - 1e-5)) / 2e-5
    assert np.sign(bias1 - bias0) == -np.sign(slope)


def test_quality_score_by_loops(spark):
    """All pairs of features by hand, words and statistics and metadata."""
    rng = np.random.default_rng(5)
    m = qc.Machine(metadata={"n_chars": qc.LENGTHS, "odd name": (0.5,)})
    m.bias, m.weight, m.factor = 0.3, rng.normal(0, 0.3, len(m.weight)).astype(np.float32), rng.normal(0, 0.3, m.factor.shape).astype(np.float32)
    chars = [5, None, 0, 40_000, -1, 7]
    docs = spark.createDataFrame([(i, t, c, "0.7" if i % 2 else "x") for i, (t, c) in enumerate(zip(TEXTS, chars))], "doc_id int, text string, n_chars long, `odd name` string")
    got = {r.doc_id: r.score for r in qc.score(docs, m).collect()}
    kept = {r.doc_id for r in qc.keep(docs, m, 0.5).collect()}
    for i, text in enumerate(TEXTS):
        words = set(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        buckets = {hashed(w, SPACED) >> (64 - qc.BITS) for w in words}
        x = {b: 1 / math.sqrt(len(buckets)) for b in buckets}
        bins = qc.structure(Words(pa.array([text], pa.string()), SPACED))[0]  # by loops elsewhere
        x |= {(1 << qc.BITS) + 11 * k + int(b): 1.0 for k, b in enumerate(bins)}
        x[qc.SIZE + (11 if chars[i] is None else sum(chars[i] >= c for c in qc.LENGTHS))] = 1.0
        x[qc.SIZE + 12 + (1 if i % 2 else 11)] = 1.0
        f = list(x.items())
        z = m.bias + sum(float(m.weight[a]) * v for a, v in f)
        z += sum(float(m.factor[a] @ m.factor[b]) * v * u for k, (a, v) in enumerate(f) for b, u in f[:k])
        assert math.isclose(got[i], 1 / (1 + math.exp(-z)), rel_tol=2e-4), i
        assert (i in kept) == (got[i] >= 0.5)
    assert qc.keep(docs, m, 0.0).columns == docs.columns and qc.keep(docs, m, 0.0).count() == len(TEXTS)
    bare = docs.select("doc_id", "text")  # without the columns all are as if null
    null = docs.withColumn("n_chars", F.lit(None).cast("long")).withColumn("odd name", F.lit(None).cast("string"))
    assert {(r.doc_id, round(r.score, 12)) for r in qc.score(bare, m).collect()} == {(r.doc_id, round(r.score, 12)) for r in qc.score(null, m).collect()}


def test_metadata_is_learned(spark):
    """Equal texts, told apart by a column alone."""
    docs = spark.createDataFrame([(i, "same words here", (i % 2) * 5000 + 10) for i in range(200)], "doc_id int, text string, n_chars int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "doc_id int, quality int")
    machine = qc.train(docs, labels, F.lit(True), metadata={"n_chars": qc.LENGTHS})
    s = qc.score(docs, machine).toPandas()
    # a few steps over 67 texts: apart, if not yet far from one half
    assert s[s.doc_id % 2 == 1].score.min() > max(0.6, s[s.doc_id % 2 == 0].score.max() + 0.2)
