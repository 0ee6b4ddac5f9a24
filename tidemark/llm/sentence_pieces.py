"""SentencePiece encoding and decoding of whole texts.

The merges are in ``_pieces``; documents are independent, so nothing is shuffled
or written.  Ids are those of the sentencepiece library for the model (BPE,
normalizer that keeps all characters), texts those of its ``decode``.

A null text counts as empty and gives the begin and end ids alone; empty texts
likewise; rows with equal or no doc_id are each encoded; an empty table gives
none.  Texts of any length are taken whole.  Further columns of any name are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import slices


def encode(docs: DataFrame, model: str, *, begin: bool = True, end: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids (little-endian unsigned 32-bit)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._pieces import AT_ONCE, pieces

        p = pieces(model)
        for b in slices(batches, "text", AT_ONCE):
            flat, lengths = p.encode(b.column("text"), p.begin if begin else None, p.end if end else None)
            off = np.concatenate([[0], 4 * np.cumsum(lengths)])
            if off[-1] > np.iinfo(np.int32).max:
                raise ValueError("a text of over 2^29 ids")
            ids = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), ids], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a document: doc_id, n_tokens, ids, text; null ids count as none.  An id outside the vocabulary is an error."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._pieces import AT_ONCE, pieces

        p = pieces(model)
        for b in slices(batches, "ids", AT_ONCE):
            raw = b.column("ids").cast(pa.large_binary())
            off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
            lengths = np.diff(off) // 4
            texts = p.decode(np.frombuffer(data.tobytes(), "<u4").astype(np.int64), lengths)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lengths, pa.int64()), b.column("ids"), texts.cast(pa.string())], schema.names)

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, schema)
