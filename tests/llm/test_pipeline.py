"""Stages of the pipeline against brute force, each on what the one before kept."""

import zlib

import numpy as np

import corpus_pipeline as P
from tests.conftest import duck
from tests.llm.test_exact import brute_dedup, brute_links
from tidemark.llm import oracles, quality_classifier
from tidemark.llm import queries as Q
from tidemark.llm._scratch import written
from pyspark.sql import functions as F


def test_stages(spark, small):
    from tokenizers import Tokenizer

    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = docs.columns
    steps = [docs]
    for _, stage in P.STAGES:
        steps.append(written(stage(spark, steps[-1], small)))
    assert all(s.columns == names for s in steps[:-1])
    rows = lambda s: {r.doc_id: r.text for r in s.collect()}
    raw, good, single, cut, clean_ = map(rows, steps[:-1])
    machine = quality_classifier.train(docs, spark.read.parquet(f"{small}/labels.parquet"), F.lit(True))
    assert set(good) == {r.doc_id for r in quality_classifier.score(docs, machine).where("score >= 0.5").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert np.mean([(d in good) == (q == 1) for d, q in known.items()]) > 0.95
    order = sorted(good.items())
    _, group = brute_links(order)
    assert set(single) == {order[i][0] for i in range(len(order)) if group[i] == i}
    want = {d: k if g else single[d] for d, n, g, k in brute_dedup(sorted(single.items()), 50) if not (g and g == n)}
    assert cut == want
    hit = duck(oracles.OP2, small, documents=steps[3].toPandas())
    assert set(clean_) == set(hit[~hit.contaminated].doc_id)
    ids = Tokenizer.from_file(Q.vocabulary())
    p = steps[-1].toPandas()
    total = {d: ids.encode(t, add_special_tokens=False).ids + [2] for d, t in clean_.items()}
    assert p.length.sum() == sum(map(len, total.values()))
    for r in p.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(total[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert P.ORACLE_SQL is None and P.run(spark, small).count() == len(p)


def test_stages_at_the_edge(spark, odd, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns and empty tables go through every stage."""
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.where("false")):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.dtypes == docs.dtypes
            rows = out.collect()
            if docs is not odd:
                assert rows == []
            elif name in ("n-gram Jaccard join", "substring dedup", "benchmark decontamination"):
                assert {2, 3, 4} <= {r.doc_id for r in rows}
            elif name == "packing":
                n = {}
                for r in rows:
                    n[r.doc_id] = n.get(r.doc_id, 0) + r.length
                assert n[2] == n[3] == n[4] == 1 and set(n) == {r.doc_id for r in odd.collect()}
    assert {r.doc_id for r in P.decontaminated(spark, odd, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 9, 10, 11}
    assert P.run(spark, str(tmp_path)).count() > 0
