"""Registered queries over the text tables, one for each operator: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles, quality_classifier, quality_rules, sentence_pieces, toxicity
from .decontaminate import matches, report
from .lexical_search import search
from .ngram_join import near_duplicates
from .packing import pack
from .substring_dedup import dedup
from .token_binary import read, segments
from .token_counts import length_histogram
from .url_filter import judge
from .whitening import whiten
from ._scratch import written

VOCABULARY = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pack(_table(spark, sf_dir, "documents"), vocabulary(), end=2, length=4096)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(segments(_table(spark, sf_dir, "documents"), vocabulary(), end=1), "uncompressed")
    return read(stored).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(_table(spark, sf_dir, "documents"), vocabulary())


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), n=5, threshold=0.8).select("doc_id", "class_id", "n_links")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


#: (verdict, host/path)
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup(_table(spark, sf_dir, "documents"), 50)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _held(n: int, remainder: int) -> Column:
    """Whether a row is held out; one without doc_id is never learned, and counts as not held out."""
    return F.coalesce(_remainder(n) == remainder, F.lit(False)).alias("held_out")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    machine = quality_classifier.train(docs, labels, _remainder(4) != 2, metadata={"n_chars": quality_classifier.LENGTHS})
    s = quality_classifier.score(docs, machine)
    return s.select("doc_id", _held(4, 2), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, _remainder(5) != 0)
    s = toxicity.score(docs, model)
    return s.select("doc_id", _held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary(PIECES)
    d = sentence_pieces.decode(sentence_pieces.encode(_table(spark, sf_dir, "documents"), model), model)
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), most=32)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_binary": op3_token_binary,
    "op4_token_counts": op4_token_counts,
    "op5_ngram_join": op5_ngram_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filter": op7_url_filter,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_toxicity": op10_toxicity,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_whitening": op12_whitening,
    "op13_lexical_search": op13_lexical_search,
    "pipeline": pipeline,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": oracles.OP2,
    "op6_quality_rules": oracles.OP6,
    "op8_substring_dedup": oracles.OP8,
    "op13_lexical_search": oracles.OP13,
}
