"""Token-ID output: range-coded segments of ids in document order.

Documents are dealt out by ranges of doc_id, so the parts of the output follow
each other; each part encodes its texts in order and writes segments.  A segment
is a byte string of the format in ``_codec`` (checksummed blocks that are coded
and read independently); the table of segments is Parquet, because executors
may share no file system but Spark's.  One row a segment: part, segment,
n_tokens, doc_ids, doc_tokens (ids of each document), payload.

Null and empty texts hold the end id alone; null doc_ids come first; rows with
equal doc_id follow each other in order of their texts' hashes, and are split
between parts by those, so a doc_id (or none) of very many rows is no one task's;
an empty table gives no segments.  A document is never split between segments,
but its ids are coded in groups of bounded size.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._sums import before
from ._text import slices

#: Ids after which a segment is closed: as many as the coder takes side by side.
SEGMENT = 8 << 20
#: Most segments whose starts (24 bytes each) are broadcast.
BROADCAST = 200_000


def segments(docs: DataFrame, tokenizer: str, end: int, doc_id: str = "doc_id", text: str = "text", size: int = SEGMENT) -> DataFrame:
    """The segments of all documents, to be written with ``write.parquet``."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("doc_tokens", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from . import _codec
        from ._tokens import AT_ONCE, encoder

        e, part, segment = encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, names, lengths, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([segment], pa.int64()), pa.array([len(flat)], pa.int64()), listed(pa.concat_arrays(names)), listed(pa.array(np.concatenate(lengths))), pa.array([_codec.encode(flat, e.size > 1 << 16)], pa.binary())],
                ["part", "segment", "n_tokens", "doc_ids", "doc_tokens", "payload"],
            )

        for b in slices(batches, "text", AT_ONCE):
            flat, counts = e.encode(b.column("text"), end)
            ids.append(flat), names.append(b.column("doc_id")), lengths.append(counts)
            held += len(flat)
            if held >= size:
                yield row()
                ids, names, lengths, held, segment = [], [], [], 0, segment + 1
        if held:
            yield row()

    # equal texts of equal doc_ids are alike, so their order does not matter
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(write, schema)


def listed(a: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def read(stored: DataFrame) -> DataFrame:
    """One row a document from stored segments: doc_id, start (ids before it in all), n_tokens, ids (little-endian unsigned 32-bit)."""
    id_type = stored.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("segment", T.LongType()), T.StructField("doc_id", id_type), T.StructField("in_segment", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import _codec

        for batch in batches:
            for i in range(batch.num_rows):
                ids = _codec.decode(batch.column("payload")[i].as_py()).astype("<u4")
                names, lengths = batch.column("doc_ids")[i].values, batch.column("doc_tokens")[i].values.to_numpy()
                ends, raw = np.cumsum(lengths), pa.py_buffer(ids.tobytes())
                ids = None
                for at in range(0, len(lengths), 1000):
                    to = min(len(lengths), at + 1000)
                    off = np.concatenate([ends[at:to] - lengths[at:to], ends[to - 1 : to]])
                    own = raw.slice(4 * int(off[0]), 4 * int(off[-1] - off[0]))
                    col = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer((4 * (off - off[0])).astype(np.int32).tobytes()), own])
                    same = lambda k: pa.array(np.full(to - at, batch.column(k)[i].as_py()), pa.int64())
                    yield pa.RecordBatch.from_arrays([same("part"), same("segment"), names.slice(at, to - at), pa.array(off[:-1]), pa.array(lengths[at:to]), col], ["part", "segment", "doc_id", "in_segment", "n_tokens", "ids"])

    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = before(parts, "part", "n").withColumnRenamed("before", "part_base")
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    base = stored.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("seg_base")).join(base, "part")
    base = base.select("part", "segment", (F.col("seg_base") + F.col("part_base")).alias("base"))
    # a row for each SEGMENT ids: small, but its size is checked, and past the bound both sides are shuffled
    base = F.broadcast(base) if stored.count() <= BROADCAST else base
    rows = stored.select("part", "segment", "doc_ids", "doc_tokens", "payload").mapInArrow(decode, schema)
    return rows.join(base, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("in_segment")).alias("start"), "n_tokens", "ids")
