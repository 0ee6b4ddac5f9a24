"""Benchmark decontamination by a distributed positional inverted index.

The training texts are cut into shards of whole documents.  Each shard's index
holds, for every term of the benchmark, the increasing list of its positions,
and its documents' extents; documents lie GAP positions apart, so no match
crosses from one into the next.  The index is written once, and is searched
shard by shard, for all benchmark windows whose terms the shard has at once: the
lists of their rarest terms there, shifted by the terms' offsets, are intersected
with the next rarer terms' lists, until they are empty or all terms are done
(exact phrases).  For proximity the lists are not shifted, and each further term
must occur within ``slop`` words of the rarest one.

The benchmark is taken in blocks of at most BLOCK_CHARS characters (one for a
benchmark of usual size), so what each task holds of it has a bound; with several
blocks the texts are written once with a number for each row, by which the
blocks' findings are put together.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Null or empty texts have no words and match nothing; items without words, and
rows of the benchmark without id, have no windows.  Rows with equal doc_id are
judged each for itself.  An empty benchmark leaves all clean.  Further columns
of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._scratch import written
from ._text import ALNUM, Words, slices

SHARD_WORDS = 1 << 19
GAP = 1 << 10
BLOCK_CHARS = 4_000_000
#: Positions that are intersected at once.
AT_ONCE = 1 << 21


def split_words(w: Words) -> list[bytes]:
    """All words of ``w`` in order."""
    if not len(w.data):
        return []
    edges = w.offsets[1:-1]
    return np.insert(np.where(w.mapped == 0, np.uint8(0x20), w.mapped), edges, 0x20).tobytes().split()


class Terms:
    """Windows of some benchmark items: rows of term numbers (-1: none), the items each occurs in."""

    def __init__(self, items: list[tuple], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.ids = sorted({i for i, _ in items}, key=str)
        place = {x: k for k, x in enumerate(self.ids)}
        for item, text in items:
            words = [self.number.setdefault(x, len(self.number)) for x in split_words(Words(pa.array([text]), ALNUM))]
            for at in range(max(1, len(words) - n + 1) if words else 0):
                found.setdefault(tuple(words[at : at + n]), set()).add(place[item])
        self.windows = np.full((len(found), n), -1, np.int32)
        for k, x in enumerate(found):
            self.windows[k, : len(x)] = x
        self.items = [sorted(x) for x in found.values()]
        self.size = (self.windows >= 0).sum(1)


def index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Shards of (row, doc_id, text): rows, doc_ids and n_words of the documents; terms, counts and steps between positions."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("n_words", T.ArrayType(T.LongType())), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("steps", T.BinaryType())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, names, sizes, lists, held, at = [], [], [], [], 0, 0

        def row() -> pa.RecordBatch:
            term = np.concatenate([t for t, _ in lists])
            place = np.concatenate([p for _, p in lists])
            order = np.argsort(term, kind="stable")
            term, place = term[order], place[order]
            there, counts = np.unique(term, return_counts=True)
            steps = np.diff(place, prepend=0).astype(np.int32)  # small within a list; sums restore all lists
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([one(pa.concat_arrays(rows)), one(pa.concat_arrays(names)), one(pa.array(np.concatenate(sizes))), *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (there, counts, steps))], schema.names)

        for b in slices(batches, "text"):
            w = Words(b.column("text"), ALNUM)
            words = split_words(w)
            term = np.fromiter(map(number.get, words, repeat(-1)), np.int32, len(words))
            place = np.arange(len(words)) + at + np.repeat(np.arange(len(w.counts)) * GAP, w.counts)
            known = term >= 0
            rows.append(b.column("row")), names.append(b.column("doc_id")), sizes.append(w.counts.astype(np.int64)), lists.append((term[known], place[known]))
            at += len(words) + len(w.counts) * GAP
            held += len(words)
            if held >= SHARD_WORDS or at >= 1 << 30:
                yield row()
                rows, names, sizes, lists, held, at = [], [], [], [], 0, 0
        if names:
            yield row()

    return docs.mapInArrow(build, schema)


def _matched(posts: np.ndarray, number: np.ndarray, windows: np.ndarray, size: np.ndarray, slop: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Windows that occur, and where each begins (or, with slop, occurrences of its rarest term with all others near).

    posts: (term << 32) + position in order; number: occurrences by term.
    """
    n = number[windows]
    order = np.argsort(np.where(windows < 0, np.iinfo(np.int64).max, n), axis=1, kind="stable")  # rarest first, none last
    by_rank = np.take_along_axis(windows, order, 1).astype(np.int64)
    rarest = by_rank[:, 0]
    first = np.searchsorted(posts, rarest << 32)
    found, begins = [], []
    total = np.cumsum(number[rarest])
    cuts = [0, *np.searchsorted(total, np.arange(AT_ONCE, int(total[-1]) if len(total) else 0, AT_ONCE)).tolist(), len(rarest)]
    for lo, hi in zip(cuts, cuts[1:]):
        count = number[rarest[lo:hi]]
        of = np.repeat(np.arange(lo, hi), count)
        place = np.repeat(first[lo:hi] - (np.cumsum(count) - count), count) + np.arange(len(of))
        at = (posts[place] & 0xFFFFFFFF) - (order[of, 0] if slop is None else 0)
        for k in range(1, windows.shape[1]):
            term = by_rank[of, k]
            if slop is None:
                key = (term << 32) + at + order[of, k]
                keep = posts[np.minimum(np.searchsorted(posts, key), len(posts) - 1)] == key
                keep &= at + order[of, k] >= 0
            else:
                keep = np.searchsorted(posts, (term << 32) + np.maximum(at - slop, 0)) < np.searchsorted(posts, (term << 32) + at + slop, "right")
            keep |= k >= size[of]
            of, at = of[keep], at[keep]
            if not len(of):
                break
        keep = at >= 0
        found.append(of[keep]), begins.append(at[keep])
    return (np.concatenate(found), np.concatenate(begins)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def search(shards: DataFrame, terms: Terms, id_type: T.DataType, item_type: T.DataType, slop: int | None = None) -> DataFrame:
    """One row a document of the shards: doc_id, n_words, items that match, spans (start, end) of words hit, disjoint and in order."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(item_type)), T.StructField("spans", span)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sizes = batch.column("n_words")[i].values.to_numpy()
                there, counts, steps = (np.frombuffer(batch.column(k)[i].as_py(), np.int32) for k in ("terms", "counts", "steps"))
                posts = (np.repeat(there, counts).astype(np.int64) << 32) + np.cumsum(steps, dtype=np.int64)
                number = np.zeros(len(terms.number) + 1, np.int64)
                number[there] = counts
                number[-1] = 1  # for -1
                begin = np.concatenate([[0], np.cumsum(sizes + GAP)])
                some = np.flatnonzero((number[terms.windows] > 0).all(1))
                which, at = _matched(posts, number, terms.windows[some], terms.size[some], slop)
                which = some[which]
                of = np.searchsorted(begin, at, "right") - 1
                lo = at - begin[of]
                hi = lo + (terms.size[which] if slop is None else 1)
                items = [(x, y) for x, k in np.unique(np.stack([of, which], 1), axis=0).tolist() for y in terms.items[k]]
                found: dict[int, set] = {}
                for x, y in items:
                    found.setdefault(x, set()).add(y)
                spans: dict[int, list] = {}
                for j in np.lexsort((hi, lo, of)).tolist():
                    own = spans.setdefault(int(of[j]), [])
                    if own and lo[j] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], int(hi[j]))
                    else:
                        own.append({"start": int(lo[j]), "end": int(hi[j])})
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rows")[i].values, batch.column("doc_ids")[i].values, pa.array(sizes), pa.array([[terms.ids[y] for y in sorted(found.get(x, ()))] for x in range(n)], to_arrow(item_type)), pa.array([spans.get(x, []) for x in range(n)], _SPANS)],
                    schema.names,
                )

    return shards.mapInArrow(run, schema)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def to_arrow(kind: T.DataType) -> pa.DataType:
    return pa.list_(pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64())


def matches(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, slop: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, items (ids of matching items), spans (start and end of words hit).

    Windows are ``n`` consecutive words of an item, or all words of a shorter
    one.  Exact phrases; with ``slop``, all words of a window within so many
    words of its rarest (spans then mark that word); below GAP, or words of the
    next document would be near (ValueError).
    """
    if slop is not None and not 0 <= slop < GAP:
        raise ValueError(f"slop must be at least 0 and below {GAP}")
    spark = docs.sparkSession
    b = benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    blocks = max(1, -(-int(b.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // BLOCK_CHARS))
    parts, id_type, item_type = [], docs.schema[doc_id].dataType, benchmark.schema[item_id].dataType
    d = docs.select(F.lit(0).cast("long").alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if blocks > 1:
        d = written(d.withColumn("row", F.monotonically_increasing_id()))
    for k in range(blocks):
        own = b if blocks == 1 else b.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        terms = Terms([(r.i, r.t) for r in own.toLocalIterator()], n)  # a block: bounded by BLOCK_CHARS
        shards = written(index(d, terms.number))
        parts.append(search(shards, terms, id_type, item_type, slop))
    if blocks == 1:
        return parts[0].select("doc_id", "n_words", "items", "spans")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    all_ = union.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["start"].alias("start"), F.greatest(F.get(a, F.size(a) - 1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )
    return all_.select("doc_id", "n_words", "items", joined.alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind may clash
    key, body = f"c{docs.columns.index(doc_id)}", f"c{docs.columns.index(text)}"
    # told apart by the text too, for rows of equal or no doc_id
    d = d.withColumn("k", F.struct(F.col(key).alias("id"), F.xxhash64(body).alias("hash")))
    hit = matches(d, benchmark, n=n, doc_id="k", text=body, item_id=item_id, item_text=item_text).where(F.size("spans") > 0).select(F.col("doc_id.id").alias("h_id"), F.col("doc_id.hash").alias("h_hash")).distinct()
    return d.join(hit, F.col("k.id").eqNullSafe(F.col("h_id")) & (F.col("k.hash") == F.col("h_hash")), "left_anti").drop("k").toDF(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``matches``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
