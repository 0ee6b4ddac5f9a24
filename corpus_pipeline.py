"""From raw documents to packed sequences, in stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before kept; what it returns is written, and read as the next one's docs.  All
stages but the last return the columns of their input, of any names; they need
doc_id and text, and the last one source.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import quality_classifier
from tidemark.llm._scratch import removed, settled
from tidemark.llm.decontaminate import clean
from tidemark.llm.ngram_join import one_each
from tidemark.llm.packing import pack
from tidemark.llm.queries import vocabulary
from tidemark.llm.substring_dedup import cleaned


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score 0.5 or more).

    A null text is judged as an empty one; repeated rows are judged alike, and
    stay or go together.  Without labels all scores are 0.5, and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep(docs, quality_classifier.train(docs, labels, F.lit(True)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more: that of least doc_id.

    Null and empty texts are groups of their own; of rows with equal doc_id and
    text one stays.  A null doc_id comes before all others.
    """
    return one_each(docs, n=5, threshold=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows that an earlier document has; n_chars, where there is one, follows the text.

    Null and empty texts, and those of fewer words, stay as they are; a document
    that loses all its words goes.  Rows of one doc_id are no copies of each other.
    """
    out = cleaned(docs, 50)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no 10-word window of the benchmark occurs.

    Null and empty texts hold none, and stay; rows of one doc_id are judged each
    for itself.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=10)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, sources in proportion.

    A null or empty text is its end id alone; null sources are one source;
    repeated rows are packed each for itself.
    """
    p = pack(docs, vocabulary(), end=2, length=4096)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: A trained classifier and a tokenizer are not SQL's; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = settled(spark, lambda: stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)  # nothing reads it any more
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
