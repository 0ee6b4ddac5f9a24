"""Ranked lexical search over bit-sliced Bloom signatures.

The index is written once: blocks of documents of about equal size, whose
signatures are stored by slot, so that one slot's bits of all the block's documents
lie together.  A term sets ``HASHES`` slots, and others again for each number of
occurrences in LEVELS that it reaches.  For a query, the slots of a term and level are
intersected: the documents that may hold it so often, and some others.  Terms'
weights, summed over those bits and scaled by what the level allows at most in a
document of that length, bound every document's score from above; never from below.

A search takes three passes: the documents of highest bound for each item; their
exact scores, of which the k-th is a threshold; and the exact scores of all
documents whose bound reaches it (or the k-th best of those met in the same
task).  Whatever is left out is proven to be below.  Exact scores come from the
whole texts, which the index holds beside the signatures in a column of its own:
candidates are never sent to the texts, and thresholds are all that is broadcast.

The items are taken in blocks of at most BLOCK_CHARS characters, so what each task
holds of them has a bound; an item is never split.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Null and empty texts have none: such documents are not counted, and are never
returned; such items have no rows.  Each row counts as a document or an item of
its own, whether ids repeat or are null (null comes first among equal scores).
Empty tables give no rows.  Further columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import written
from ._text import ALNUM, U64, Words, mix, slices

#: Occurrences from which a term is entered once more.
LEVELS = (1, 2, 3, 5, 9)
HASHES = 6
#: Slots for each entry: a slot is then set in about two fifths of the documents at most.
SPARE = 12
#: Bits of a block's signatures, and bytes of its texts.
BLOCK_BITS = 1 << 23
BLOCK_BYTES = 2 << 20
BLOCK_CHARS = 4_000_000
#: Numbers summed at once.
AT_ONCE = 1 << 23
_HASH_BITS = U64(44)


def _slots(term: np.ndarray, level: int, n: int) -> np.ndarray:
    """Slots (terms by HASHES) of 44-bit term hashes at a level, out of n."""
    g = mix(term + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step, first = (g >> U64(32)) | U64(1), g & U64(0xFFFFFFFF)
    return ((first[:, None] + np.arange(HASHES, dtype=U64) * step[:, None]) % U64(n)).astype(np.int64)


def index(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of all documents that hold a term: block, n_docs, n_sum, n_terms, slots, bits; doc_ids and texts.  To be written."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_docs", T.LongType()), T.StructField("n_sum", T.LongType()), T.StructField("n_terms", T.ArrayType(T.LongType())), T.StructField("slots", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("texts", T.ArrayType(T.StringType()))])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}  # by number of slots: documents (entries by level, terms, name, text)
        size: dict[int, int] = {}

        def row(slots: int) -> pa.RecordBatch:
            nonlocal number
            own = held.pop(slots)
            size.pop(slots)
            width = -(-len(own) // 8) * 8
            at = np.repeat(np.arange(len(own)), [len(x[0]) for x in own])
            entries, levels = np.concatenate([x[0] for x in own]), np.concatenate([x[1] for x in own])
            bits = np.zeros(slots * width, bool)
            for k in range(len(LEVELS)):
                some = levels > k
                bits[(_slots(entries[some], k, slots) * width + at[some, None]).ravel()] = True
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            n = [x[2] for x in own]
            out = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(own)]), pa.array([sum(n)]), one(pa.array(n, pa.int64())), pa.array([slots]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), one(pa.concat_arrays([x[3] for x in own])), one(pa.concat_arrays([x[4] for x in own]))],
                schema.names,
            )
            number += 1
            return out

        for b in slices(batches, "text"):
            for at in range(0, b.num_rows, 1 << 19):  # so that a document's number takes 20 bits at most
                part = b.slice(at, 1 << 19)
                w = Words(part.column("text"), ALNUM)
                if not len(w.starts):
                    continue
                key = np.sort((w.doc_of_word().astype(U64) << _HASH_BITS) | (w.hash >> (U64(64) - _HASH_BITS)))
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                tf = np.diff(np.append(new, len(key)))
                doc, term = (key[new] >> _HASH_BITS).astype(np.int64), key[new] & ((U64(1) << _HASH_BITS) - U64(1))
                level = np.searchsorted(LEVELS, tf, "right")
                first = np.searchsorted(doc, np.arange(part.num_rows + 1))
                total = np.concatenate([[0], np.cumsum(level)])
                entries = total[first[1:]] - total[first[:-1]]
                # sizes in steps of a half power of two
                slots = (SPARE * np.ceil(2 ** (np.ceil(2 * np.log2(np.maximum(entries, 16))) / 2))).astype(np.int64)
                n_bytes = np.diff(w.offsets)
                names, texts = part.column("doc_id"), part.column("text")
                for j in np.flatnonzero(w.counts).tolist():
                    s, lo, hi = int(slots[j]), first[j], first[j + 1]
                    held.setdefault(s, []).append((term[lo:hi].copy(), level[lo:hi].astype(np.int8), int(w.counts[j]), names.slice(j, 1), texts.slice(j, 1)))
                    size[s] = size.get(s, 0) + int(n_bytes[j])
                    if size[s] >= BLOCK_BYTES or (len(held[s]) + 8) * s > BLOCK_BITS:
                        yield row(s)
        for s in list(held):
            yield row(s)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(build, schema)


@dataclass
class Query:
    """A block of items: their distinct terms, and what each item asks for (entries: item, term, weight, in order of items)."""

    ids: list
    terms: list[bytes]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray
    hashes: np.ndarray
    n_docs: int = 0
    n_sum: int = 0
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    kind: type = np.int64  # of sums of weights

    @staticmethod
    def of(items: list[tuple]) -> "Query":
        w = Words(pa.array([t for _, t in items], pa.string()), ALNUM)
        words = packed(w)
        distinct = words.dictionary_encode()
        entry, times = np.unique(w.doc_of_word() * max(1, len(distinct.dictionary)) + distinct.indices.to_numpy(), return_counts=True)
        item, term = np.divmod(entry, max(1, len(distinct.dictionary)))
        there, item = np.unique(item, return_inverse=True)  # items without terms go
        _, where = np.unique(distinct.indices.to_numpy(), return_index=True)
        return Query([items[k][0] for k in there.tolist()], distinct.dictionary.to_pylist(), item, term, times, w.hash[where] >> (U64(64) - _HASH_BITS))

    def weigh(self, n_docs: int, n_sum: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_sum = n_docs, n_sum
        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)
        self.weight = w[self.term] * self.times
        most = np.bincount(self.item, self.weight).max(initial=0)
        self.kind = np.int32 if most < 1 << 31 else np.int64

    def length(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms."""
        if 75 * int(n.max(initial=0)) * self.n_docs < 1 << 63:
            return 100 - 75 + 75 * n * self.n_docs // self.n_sum
        return np.array([100 - 75 + 75 * int(x) * self.n_docs // self.n_sum for x in n], np.int64)

    def groups(self, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Items in runs whose entries times width are summed at once: first, last, entries, where each item's begin."""
        starts = np.searchsorted(self.item, np.arange(len(self.ids) + 1))
        most, lo = max(1, AT_ONCE // max(1, width)), 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
            yield lo, hi, np.arange(starts[lo], starts[hi]), starts[lo:hi] - starts[lo]
            lo = hi


def packed(w: Words) -> pa.Array:
    """All words as an array of bytes."""
    lengths = w.ends - w.starts
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(w.mapped[w.mapped != 0])]).cast(pa.binary())


def _ratio(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bounds(q: Query, batch: pa.RecordBatch, i: int) -> np.ndarray:
    """Upper bounds of the scores of a block's documents (items by documents)."""
    n = batch.column("n_terms")[i].values.to_numpy()
    slots = batch.column("slots")[i].as_py()
    bits = np.frombuffer(batch.column("bits")[i].as_buffer(), np.uint8).reshape(slots, -1)
    m = q.length(n)
    out, may, before = np.zeros((len(q.ids), len(n)), np.int64), None, np.zeros(len(n), np.int64)
    for k in range(len(LEVELS)):
        # documents that may hold a term so often
        at = _slots(q.hashes, k, slots)
        own = bits[at[:, 0]]
        for h in range(1, HASHES):
            own &= bits[at[:, h]]
        may = own if may is None else may & own
        # what the occurrences up to the next level are worth
        most = np.full(len(n), LEVELS[k + 1] - 1) if k + 1 < len(LEVELS) else n
        worth = _ratio(np.maximum(np.minimum(most, n), 1), m)
        gain, before = np.maximum(worth - before, 0), np.maximum(worth, before)
        some = may.any(1)
        for lo, hi, entries, starts in q.groups(len(n)):
            use = some[q.term[entries]]
            if not use.any():
                continue
            e, of = entries[use], q.item[entries[use]]
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            held = np.unpackbits(may[q.term[e]], axis=1, count=len(n), bitorder="little")
            out[of[begin]] += np.add.reduceat(held * q.weight[e].astype(q.kind)[:, None], begin, axis=0, dtype=q.kind) * gain
    return out


def occurrences(q: Query, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, number of times) of all query terms in some whole texts; compared as they are written."""
    w = Words(texts, ALNUM)
    found = pc.index_in(packed(w), value_set=pa.array(q.terms, pa.binary()))
    there = found.is_valid().to_numpy(zero_copy_only=False)
    key, tf = np.unique(w.doc_of_word()[there] * len(q.terms) + found.drop_null().to_numpy(), return_counts=True)
    return (*np.divmod(key, len(q.terms)), tf) if len(q.terms) else (key, key, tf)


def exact(q: Query, texts: pa.Array, n: np.ndarray) -> np.ndarray:
    """Scores of some texts of n terms (items by texts)."""
    doc, term, tf = occurrences(q, texts)
    out = np.zeros((len(q.ids), len(texts)), np.int64)
    m = q.length(n)
    for lo in range(0, len(texts), 256):
        hi = min(lo + 256, len(texts))
        a, b = np.searchsorted(doc, (lo, hi))
        worth = np.zeros((len(q.terms), hi - lo), np.int64)
        worth[term[a:b], doc[a:b] - lo] = _ratio(tf[a:b], m[doc[a:b]])
        for first, last, entries, starts in q.groups(hi - lo):
            out[first:last, lo:hi] = np.add.reduceat(worth[q.term[entries]] * q.weight[entries, None], starts, axis=0)
    return out


def _runs(texts: pa.Array, which: np.ndarray) -> Iterator[np.ndarray]:
    """The chosen texts in runs of at most 256 and two million bytes."""
    size = np.cumsum(pc.binary_length(texts).to_numpy()[which])
    at = 0
    while at < len(which):
        to = max(at + 1, min(at + 256, int(np.searchsorted(size, (size[at - 1] if at else 0) + (2 << 20), "right"))))
        yield which[at:to]
        at = to


def _frequencies(blocks: DataFrame, q: Query) -> dict[int, int]:
    """Documents that hold each term of the query, by the term's number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("texts")[i].values
                for run in _runs(texts, np.arange(len(texts))):
                    df += np.bincount(occurrences(q, texts.slice(int(run[0]), len(run)))[1], minlength=len(q.terms))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["term", "df"])

    rows = blocks.select("texts").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.toLocalIterator()}


def _top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The k first rows of each q: in parts first, so that no task sorts what all others have found."""
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = rows.withColumn("part", F.spark_partition_id() % 32).withColumn("rank", rank(["q", "part"])).where(F.col("rank") <= k)
    return some.withColumn("rank", rank(["q"])).where(F.col("rank") <= k).drop("part")


def _highest_bounds(blocks: DataFrame, q: Query, k: int) -> DataFrame:
    """(block, at): documents that are among the k of highest bound for some item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = np.zeros((len(q.ids), 0), np.int64)
        block, at = bound.copy(), bound.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                b = bounds(q, batch, i)
                width = b.shape[1]
                bound = np.concatenate([bound, b], 1)
                block = np.concatenate([block, np.full(b.shape, batch.column("block")[i].as_py())], 1)
                at = np.concatenate([at, np.broadcast_to(np.arange(width), b.shape)], 1)
                if bound.shape[1] > k:
                    best = np.argpartition(-bound, k - 1, axis=1)[:, :k]
                    bound, block, at = (np.take_along_axis(x, best, 1) for x in (bound, block, at))
        who = np.repeat(np.arange(len(q.ids)), bound.shape[1])
        some = bound.ravel() > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (who, bound.ravel(), block.ravel(), at.ravel())], ["q", "bound", "block", "at"])

    rows = blocks.select("block", "n_terms", "slots", "bits").mapInArrow(scan, "q bigint, bound bigint, block bigint, at bigint")
    return _top(rows, [F.desc("bound"), "block", "at"], k).select("block", "at").distinct()


def _thresholds(blocks: DataFrame, q: Query, k: int) -> np.ndarray:
    """For each item a score that k documents reach (1 where fewer are found)."""
    chosen = _highest_bounds(blocks, q, k).groupBy("block").agg(F.collect_list("at").alias("chosen"))  # k rows an item at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts, n = batch.column("texts")[i].values, batch.column("n_terms")[i].values.to_numpy()
                for run in _runs(texts, np.sort(batch.column("chosen")[i].values.to_numpy())):
                    s = exact(q, texts.take(pa.array(run)), n[run])
                    who, _ = np.nonzero(s)
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(s[s > 0])], ["q", "score"])

    rows = blocks.select("block", "n_terms", "texts").join(F.broadcast(chosen), "block").mapInArrow(score, "q bigint, score bigint")
    out = np.ones(len(q.ids), np.int64)
    for r in _top(rows, [F.desc("score")], k).where(F.col("rank") == k).toLocalIterator():
        out[r.q] = max(1, r.score)
    return out


def _ranked(blocks: DataFrame, q: Query, k: int) -> DataFrame:
    """(q, rank, doc_id, score): the k best of each item."""
    least, id_type = _thresholds(blocks, q, k), blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach, best = least.copy(), [[] for _ in q.ids]  # best: (-score, doc_id's order, doc_id)
        for batch in batches:
            for i in range(batch.num_rows):
                may = bounds(q, batch, i)
                texts, names, n = batch.column("texts")[i].values, batch.column("doc_ids")[i].values, batch.column("n_terms")[i].values.to_numpy()
                for run in _runs(texts, np.flatnonzero((may >= reach[:, None]).any(0))):
                    run = run[(may[:, run] >= reach[:, None]).any(0)]  # what earlier runs have raised
                    if not len(run):
                        continue
                    s = exact(q, texts.take(pa.array(run)), n[run])
                    for j in np.flatnonzero((s >= reach[:, None]).any(1)).tolist():
                        own = best[j]
                        own += [(-int(s[j, x]), (name := names[int(run[x])].as_py()) is not None, name) for x in np.flatnonzero(s[j] >= reach[j]).tolist()]
                        own.sort(key=lambda x: x if x[1] else x[:2])
                        del own[k:]
                        if len(own) == k:
                            reach[j] = max(reach[j], -own[-1][0])
        rows = [(j, name, -s) for j, own in enumerate(best) for s, _, name in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], arrow_type), pa.array([r[2] for r in rows], pa.int64())], schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_type)
    rows = blocks.select("n_terms", "slots", "bits", "doc_ids", "texts").mapInArrow(score, schema)
    return _top(rows, [F.desc("score"), F.asc("doc_id")], k)


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k documents of highest score above 0 for each item: item_id, rank (from 1), doc_id, score."""
    spark, item_type = docs.sparkSession, items.schema[item_id].dataType
    b = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    chars = int(b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0])
    blocks = written(index(docs, doc_id=doc_id, text=text))
    n_docs, n_sum = (int(x or 0) for x in blocks.agg(F.sum("n_docs"), F.sum("n_sum")).first())
    out = None
    n_blocks = max(1, -(-chars // BLOCK_CHARS))
    for at in range(n_blocks):
        own = b if n_blocks == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(n_blocks)) == at)
        q = Query.of([(r.i, r.t) for r in own.toLocalIterator()])  # a block: bounded by BLOCK_CHARS
        if not q.ids or not n_docs:
            continue
        q.weigh(n_docs, n_sum, _frequencies(blocks, q))
        names = spark.createDataFrame(list(enumerate(q.ids)), T.StructType([T.StructField("q", T.LongType()), T.StructField("item_id", item_type)]))
        found = _ranked(blocks, q, k).join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("score", T.LongType())]))
    return out
