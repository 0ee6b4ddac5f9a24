"""Many rows of one key, and many keys alike, are no one task's."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing
from tidemark.llm.ngram_join import near_duplicates, runs_for


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text)] * 3000 + [(2, text + " end")] + [(i, f"other {i} " * 9) for i in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    sizes, compare = [], ngram_join._compare

    def counted(dealt, threshold):
        sizes.append(dealt.groupBy("leaf", "i", "j").count().agg(F.max("count")).first()[0])
        return compare(dealt, threshold)

    monkeypatch.setattr(ngram_join, "_compare", counted)
    got = near_duplicates(docs, n=5, threshold=0.8).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("class_id").alias("c"), F.max("n_links").alias("links")).collect()
    assert sizes == [2]
    by_id = {r.doc_id: (r.n, r.c, r.links) for r in got}
    assert by_id[1] == (3000, 1, 3000) and by_id[2] == (1, 1, 3000) and by_id[9] == (1, 9, 0)


def test_thresholds_without_room_are_refused():
    assert runs_for(0.8, 0.9999) == 10
    with pytest.raises(ValueError):
        runs_for(0.1, 0.9999)


def test_equal_small_sources_spread(spark):
    """200,000 sources of four ids each fill as many runs of rounds as their ids do, and lie among a large source in proportion."""
    n, big = 200_000, 800_000
    small = spark.range(0, n, 1, 4).select("id", F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(4).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("queued"))
    large = spark.range(0, 200, 1, 1).select((F.col("id") + n).alias("id"), F.lit("big").alias("source"), F.lit(big // 200).cast("long").alias("n_tokens"), (F.col("id") * (big // 200)).alias("queued"))
    tokens = small.unionByName(large).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("part"), "source", "n_tokens", "queued")
    p = packing.placed(tokens, 4096, None, 32).join(tokens.select("row", "source"), "row").cache()
    sums = p.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum(F.when(F.col("source") == "big", F.col("length")).otherwise(0)).alias("big")).orderBy("sequence_id").collect()
    assert [r.n for r in sums[:-1]] == [4096] * (len(sums) - 1) and sum(r.n for r in sums) == 4 * n + big
    assert len(sums) == -(-(4 * n + big) // 4096)
    # of binomial shares around one half, no window strays far
    assert all(abs(r.big / r.n - 0.5) < 0.1 for r in sums[2:-3])
    p.unpersist()


def test_slop_stays_within_a_document(spark):
    from tidemark.llm.decontaminate import GAP, matches

    docs = spark.createDataFrame([(1, "alpha " + "x " * 1000), (2, "y " * 1000 + "beta")], "doc_id int, text string").coalesce(1)
    items = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    assert [r["items"] for r in matches(docs, items, n=2, slop=GAP - 1).collect()] == [[], []]
    with pytest.raises(ValueError):
        matches(docs, items, n=2, slop=GAP)
