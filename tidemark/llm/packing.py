"""Packing: mixture-controlled deficit round-robin over source queues.

Every source is a queue of ids.  In each round a source is served its quantum,
``length`` times its target share; what does not make a whole unit stays in its
deficit and is served in a later round.  Rounds are therefore spans of about
``length`` ids in target proportions, and the stream of all rounds is cut every
``length`` ids, so all windows are full but the last.  A source that runs dry
drops out; the others share on.

The deficit of source s after k rounds is k*q - unit*floor(k*q/unit): a closed
form.  A source whose quantum is below a unit begins with a deficit of its own, a
hash's share of a unit, so that many alike are not served in one round.  So no window waits for the one before it: an id's round follows from its
place in its queue alone, and deficits carry across windows and partitions
without any sequential pass.  Queue places and stream places are running sums
made in two levels, never one task for a source or for the stream.

Null and empty texts hold the end id alone.  Null sources form one queue.  Rows
with equal doc_id are packed each for itself.  An empty table gives no pieces.
What is placed is rounds of a document's source, or, where the source's quantum
is below a unit, the document's units: never more rows than ids / unit and a few.
Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import written
from ._sums import before
from ._text import slices

#: Rounds whose pieces are put in order by one task.
_ROUNDS = 64
#: The highest number of a round.
_LAST = 1 << 52


def tokenized(docs: DataFrame, tokenizer: str, end: int, doc_id: str, text: str, source: str) -> DataFrame:
    """One row a document: row (unique), part, doc_id, source, n_tokens, ids, queued (ids of its source before it in the part)."""
    s = docs.schema
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("part", T.LongType()), T.StructField("doc_id", s[doc_id].dataType), T.StructField("source", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("queued", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from ._tokens import AT_ONCE, encoder

        e, part, row, queued = encoder(tokenizer), TaskContext.get().partitionId(), 0, {}
        for b in slices(batches, "text", AT_ONCE):
            flat, counts = e.encode(b.column("text"), end)
            off = np.concatenate([[0], np.cumsum(counts)]) * flat.itemsize
            col = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
            start = []
            for k, n in zip(b.column("source").to_pylist(), counts.tolist()):
                start.append(queued.get(k, 0))
                queued[k] = start[-1] + n
            rows = (part << 40) + row + np.arange(len(counts))
            row += len(counts)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), part)), b.column("doc_id"), b.column("source"), pa.array(counts), pa.array(start, pa.int64()), col], ["row", "part", "doc_id", "source", "n_tokens", "queued", "ids"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text")).mapInArrow(run, schema)


def placed(tokens: DataFrame, length: int, weights: dict[str, float] | None, unit: int) -> DataFrame:
    """Pieces by place alone: row, start, length, sequence_id, offset."""
    docs = tokens.select("row", "part", "source", "n_tokens", "queued")
    parts = written(docs.groupBy("source", "part").agg(F.max(F.col("queued") + F.col("n_tokens")).alias("n")))
    sources = parts.groupBy("source").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.col("all")
    if weights:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        share = F.coalesce(F.try_element_at(given, F.col("source")), share)
    total = parts.agg(F.sum("n").alias("all"))
    sources = sources.crossJoin(F.broadcast(total)).withColumn("share", share)  # total: one row
    sources = sources.crossJoin(F.broadcast(sources.agg(F.sum("share").alias("shares"))))
    quantum = F.lit(float(length)) * F.col("share") / F.col("shares")
    # a queue that is served by units is dealt into equal ones, so its last is served no later than the others' queues end
    own = F.when(quantum >= unit, 1).otherwise(F.ceil(F.col("n") / F.ceil(F.col("n") / F.lit(unit)))).cast("long")
    # such queues begin with different deficits, or all of equal size would be served in the same rounds
    phase = F.when(quantum >= unit, 0.0).otherwise(F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / float(1 << 20))
    sources = sources.select(F.col("source").alias("s"), "n", own.alias("unit"), phase.alias("phase"), quantum.alias("q"))
    # no round has a number that a double does not hold
    rate = F.greatest(F.col("q") / F.col("unit"), F.col("n") / F.col("unit") / F.lit(float(_LAST)))
    sources = sources.select("s", "unit", "phase", rate.alias("rate"))
    queue = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("source", "part", F.coalesce(F.sum("n").over(queue), F.lit(0)).alias("part_base"))
    plan = bases.join(sources, F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "part_base", "unit", "phase", "rate")
    plan = written(plan)  # apart from the join, so that Spark can split a source of very many documents there
    d = docs.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
    d = d.select("row", "source", "unit", "phase", "rate", (F.col("part_base") + F.col("queued")).alias("a"), "n_tokens")
    by_round, end = F.col("rate") >= 1, F.col("a") + F.col("n_tokens")
    round_of = lambda u: F.ceil((u + 1 - F.col("phase")) / F.col("rate")).cast("long")
    first, last = F.floor(F.col("a") / F.col("unit")), F.floor((end - 1) / F.col("unit"))
    # the document's rounds, and one more at either end for rounding; or, where rounds serve less than a unit, its units
    d = d.withColumn("e", F.explode(F.when(by_round, F.sequence(round_of(first) - 1, round_of(last) + 1)).otherwise(F.sequence(first, last))))
    served = lambda k: F.floor(F.greatest(k, F.lit(0)) * F.col("rate")).cast("long") * F.col("unit")
    e = F.col("e")
    d = d.withColumn("k", F.when(by_round, e).otherwise(round_of(e)))
    d = d.withColumn("lo", F.greatest(F.col("a"), F.when(by_round, served(e - 1)).otherwise(e * F.col("unit"))))
    d = d.withColumn("hi", F.least(end, F.when(by_round, served(e)).otherwise((e + 1) * F.col("unit"))))
    d = d.where("lo < hi").select("row", "source", "k", (F.col("lo") - F.col("a")).alias("start"), "lo", (F.col("hi") - F.col("lo")).alias("n"), F.floor(F.col("k") / _ROUNDS).cast("long").alias("run"))
    base = before(d.groupBy("run").agg(F.sum("n").alias("n")), "run", "n", 1024, 3)
    inside = Window.partitionBy("run").orderBy("k", "source", "lo").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(base, "run").withColumn("at", F.col("at") + F.col("before"))
    size = F.lit(length)
    d = d.withColumn("sequence_id", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size))))
    lo = F.greatest(F.col("at"), F.col("sequence_id") * size)
    hi = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * size)
    return d.select("row", (F.col("start") + lo - F.col("at")).alias("start"), (hi - lo).alias("length"), "sequence_id", (lo - F.col("sequence_id") * size).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, *, end: int, length: int = 4096, weights: dict[str, float] | None = None, unit: int = 32, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Pieces of documents that fill sequences of ``length`` ids.

    doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.  ``weights``: target shares by source, above 0 (a
    ValueError else); a source without one has its share of the ids.  ``unit``: a
    source whose quantum is below so many ids saves up that many before it is
    served.  A document makes at most its ids / ``unit`` + 4 pieces before cuts at
    the ends of sequences, however small its source's share.
    """
    if weights and not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be above 0 and finite; filter out what is not to be packed")
    tokens = written(tokenized(docs, tokenizer, end, doc_id, text, source))
    s = T.StructType([tokens.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset"))])
    pieces = placed(tokens, length, weights, unit).groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ._tokens import encoder

        dtype = encoder(tokenizer).dtype
        for b in slices(batches, "ids", 4 << 20):
            lists = b.column("pieces")
            flat, of = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            start, size = flat.field("start").to_numpy(), flat.field("length").to_numpy()
            # in order of rows and starts the pieces are the ids of the batch, end to end
            order = np.lexsort((start, of))
            ids = b.column("ids").cast(pa.large_binary())
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            wide = np.frombuffer(ids.buffers()[2], np.uint8)[at[0] : at[-1]].view(dtype).astype("<u4")
            off = np.concatenate([[0], np.cumsum(size[order])]) * 4
            cuts = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(off), pa.py_buffer(wide)]).cast(pa.binary())
            own = pa.array(of[order])
            flat = flat.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(own), flat.field("start"), flat.field("length"), cuts, b.column("n_tokens").take(own), flat.field("sequence_id"), flat.field("offset")], s.names)

    return tokens.select("row", "doc_id", "n_tokens", "ids").join(pieces, "row").mapInArrow(cut, s)


def sequences(pieces: DataFrame, length: int = 4096, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences as byte strings, padded to ``length`` ids unless they hold a power of two."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    whole = F.col("n_tokens").bitwiseAND(F.col("n_tokens") - 1) == 0
    filler = F.unhex(F.repeat(F.lit(int(pad).to_bytes(4, "little").hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return s.select("sequence_id", "n_tokens", F.when(whole, joined).otherwise(F.concat(joined, filler)).alias("ids"))
