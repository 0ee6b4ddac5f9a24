"""Substring dedup by level-wise doubling.

Windows of ``length`` words that occur in several documents are found through
windows of half that length, a quarter and so on, down to a base of a few words
(for 50 words: 7, 13, 25, 50).  A longer window can only repeat where its parts
repeat, so the windows that repeat at one length alone are extended to twice that
length and counted again, until ``length`` is reached or no candidates survive.

At the base not every window is counted but, of the base windows in each
``length``-word window, the one with the least hash, its anchor: equal long windows
choose equal anchors, so none is lost, and about 2 in ``length - base + 1`` windows
are shuffled.  An anchor that repeats is extended within its long window, to the
right while that fits and else to the left, which is again alike in equal long
windows; so each level has few windows until the last, where all long windows
that are left are counted.  Documents with equal word sequences count as one
(their first), since whatever a copy repeats its first has too.  Counting is by
min and max of doc_id for each hash, pre-aggregated before the shuffle; no group
is collected.  Texts are read again once, where anchors repeat; from there on only
the word hashes of the candidates are carried from level to level.

Windows are judged on the input.  A window goes if its words also start in a
document of smaller doc_id; so the smallest keeps its text, and repeats within
one document stay.  Null or empty texts, and texts of fewer words than
``length``, lose nothing.  Rows with equal doc_id are no copies of each other.
Rows with null doc_id come before all others.  An empty table gives an empty
result.  Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._text import SPACED, U64, Words, double, mix, signed, sliding_min, slices, windows

#: No level starts above this many words.
_BASE = 8


def levels(length: int) -> list[int]:
    """From the base length to ``length``; each is at most twice the one before."""
    out = [length]
    while out[0] > _BASE or len(out) == 1:
        out.insert(0, max(1, -(-out[0] // 2)))
    return out


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _anchor_hash(w: Words, base: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each base window; least hash of each ``length``-word window (wrong where it leaves its text)."""
    h = windows(w.hash, base)
    return h, sliding_min(h, length - base + 1)


def described(docs: DataFrame, base: int, length: int) -> DataFrame:
    """doc_id, k (hash of the text), n_words, c1 and c2 (hash of the word sequence), anchors (base windows to count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"), SPACED)
            n, at = w.counts, np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.counts)
            c = []
            for salt in (1, 2):
                v = np.concatenate([[U64(0)], np.cumsum(mix(w.hash ^ mix(at.astype(U64) * U64(2) + U64(salt))))])
                c.append(signed(mix(v[w.first[1:]] - v[w.first[:-1]] + n.astype(U64))))
            anchors, counts = np.zeros(0, U64), np.zeros(len(n), np.int64)
            if len(w.hash) >= length:
                h, least = _anchor_hash(w, base, length)
                fits, doc = w.fits(length), w.doc_of_word()
                own, chosen = doc[: len(least)][fits], least[fits]
                if len(own):
                    pair = np.unique(np.rec.fromarrays([own, chosen]))
                    anchors, counts = pair.f1.copy(), np.bincount(pair.f0, minlength=len(n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(n.astype(np.int64)), pa.array(c[0]), pa.array(c[1]), _lists(signed(anchors), counts)], ["doc_id", "k", "n_words", "c1", "c2", "anchors"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k long, n_words long, c1 long, c2 long, anchors array<long>")


def _least_at(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of each w consecutive values, the first among equals."""
    at, length = np.arange(len(h)), 1
    while length < w:
        step = min(length, w - length)
        n = max(0, len(h) - step)
        right = h[step : step + n] < h[:n]
        h, at = np.where(right, h[step : step + n], h[:n]), np.where(right, at[step : step + n], at[:n])
        length += step
    return at


def _extended(s: np.ndarray, at: np.ndarray, sizes: list[int], length: int) -> np.ndarray:
    """Where the windows of the last of these sizes begin, that anchors at ``at`` are extended to in the windows that begin at s."""
    for size, level in zip(sizes, sizes[1:]):
        at = s if level == length else np.where(at - s <= length - level, at, at - (level - size))
    return at


def _checked(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows, and 32 bits more against chance."""
    h, half, size, step = words, words, 1, 0
    while size < k:
        step = min(size, k - size)
        h, half, size = double(h, step), h, size + step
    return h, mix(half[: len(h)] * U64(0xC2B2AE3D27D4EB4F) + half[step : step + len(h)]).astype(np.uint32).view(np.int32)


_CARRIED = "k long, starts array<int>, anchors array<int>, words binary, h array<long>, v array<int>, at array<int>"
_FIELDS = [c.split()[0] for c in _CARRIED.split(", ")]


def _batch(ids: pa.Array, rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], sizes: list[int], length: int) -> pa.RecordBatch:
    """Candidates: (row, k, starts, anchors, hashes of the words from each start on to the end of its window, joined where they overlap)."""
    own = [r for r in rows if len(r[2])]
    every = lambda i: np.concatenate([r[i] for r in own]) if own else np.zeros(0, np.int64)
    size = np.array([len(r[4]) for r in own], np.int64)
    h, v = _checked(every(4) if own else np.zeros(0, U64), sizes[-1])
    out_h, out_v, out_at, base = [], [], [], 0
    for r, n in zip(own, size.tolist()):
        at = np.unique(_extended(r[2], r[3], sizes, length))
        place = base + _inside(r[2], at, length)
        out_h.append(signed(h[place])), out_v.append(v[place]), out_at.append(at.astype(np.int32))
        base += n
    many = lambda x, kind: _lists(np.concatenate(x).astype(kind) if x else np.zeros(0, kind), np.array([len(y) for y in x], np.int64))
    off = (np.concatenate([[0], np.cumsum(size)]) * 8).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(off.tobytes()), pa.py_buffer((every(4) if own else np.zeros(0, U64)).tobytes())])
    cols = [pa.array([r[1] for r in own], pa.int64()), many([r[2] for r in own], np.int32), many([r[3] for r in own], np.int32), words, many(out_h, np.int64), many(out_v, np.int32), many(out_at, np.int32)]
    return pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in own], pa.int64())), *cols], ["doc_id", *_FIELDS])


def _runs(s: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what windows of ``length`` words at s (in order) cover."""
    new = np.flatnonzero(np.diff(s) > length) + 1
    return s[np.concatenate([[0], new])], s[np.concatenate([new - 1, [len(s) - 1]])] + length


def _inside(s: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Where words ``at`` lie in the runs that windows at s cover, put end to end."""
    lo, hi = _runs(s, length)
    run = np.searchsorted(lo, at, "right") - 1
    return (np.cumsum(hi - lo) - (hi - lo))[run] + at - lo[run]


def _begun(docs: DataFrame, sizes: list[int], length: int) -> DataFrame:
    """Candidates from (doc_id, k, text, alive): windows of ``length`` words whose anchor is alive, with their extensions to the second size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = Words(b.column("text"), SPACED)
            h, ks, rows = windows(w.hash, sizes[0]), b.column("k").to_pylist(), []
            for i in range(b.num_rows):
                lo, n = int(w.first[i]), int(w.counts[i]) - length + 1
                if n > 0:
                    own = h[lo : lo + n + length - sizes[0]]
                    at = _least_at(own, length - sizes[0] + 1)
                    s = np.flatnonzero(np.isin(signed(own[at]), b.column("alive")[i].values.to_numpy()))
                    if len(s):
                        a, e = _runs(s, length)
                        rows.append((i, ks[i], s, at[s], np.concatenate([w.hash[lo + x : lo + y] for x, y in zip(a.tolist(), e.tolist())])))
            yield _batch(b.column("doc_id"), rows, sizes[:2], length)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {_CARRIED}")


def _narrowed(found: DataFrame, sizes: list[int], length: int) -> DataFrame:
    """Of candidates with ``hit`` (windows of the last size but one that repeat), what is left, with extensions to the last size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "words"):
            ks, rows = b.column("k").to_pylist(), []
            for i in range(b.num_rows):
                s, at, hit = (b.column(c)[i].values.to_numpy().astype(np.int64) for c in ("starts", "anchors", "hit"))
                keep = np.isin(_extended(s, at, sizes[:-1], length), hit)
                if keep.any():
                    words, few = np.frombuffer(b.column("words")[i].as_buffer(), U64), s[keep]
                    lo, hi = _runs(few, length)
                    place = _inside(s, lo, length)
                    rows.append((i, ks[i], few, at[keep], np.concatenate([words[x : x + n] for x, n in zip(place.tolist(), (hi - lo).tolist())])))
            yield _batch(b.column("doc_id"), rows, sizes, length)

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, {_CARRIED}")


def _same(a: str = "") -> Column:
    return F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("k").eqNullSafe(F.col("r_k"))


def _text(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))


def removals(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that lose words: r_id, r_k (doc_id, hash of the text), whole (all words go) or starts (of windows that go)."""
    sizes = levels(length)
    d = _text(docs, doc_id, text)
    meta = written(described(d, sizes[0], length))
    long = meta.where(F.col("n_words") >= length)
    # doc_id null sorts first, as its own least value
    rank = lambda c: F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("id"))
    classes = long.groupBy("c1", "c2").agg(F.min(rank("doc_id")).alias("least")).withColumnRenamed("c1", "d1").withColumnRenamed("c2", "d2")
    classes = written(classes)  # apart from the join, so that Spark can split a class of very many copies there
    judged = long.join(classes, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2"))).withColumn("leads", rank("doc_id") == F.col("least"))
    copies = judged.where(~F.col("leads")).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    anchors = judged.where("leads").select("doc_id", "k", F.explode("anchors").alias("a"))
    repeated = anchors.groupBy("a").agg(F.min(rank("doc_id")).alias("lo"), F.max(rank("doc_id")).alias("hi")).where("lo < hi").select(F.col("a").alias("ra"))
    repeated = written(repeated)
    alive = anchors.join(repeated, F.col("a") == F.col("ra")).groupBy("doc_id", "k").agg(F.collect_set("a").alias("alive")).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "alive")
    found = written(_begun(d.join(written(alive), _same()).select("doc_id", "k", "text", "alive"), sizes, length))
    for j in range(1, len(sizes)):
        last = sizes[j] == length
        each = found.select("doc_id", "k", F.explode(F.arrays_zip("h", "v", "at")).alias("x")).select("doc_id", "k", "x.*")
        seen = each.groupBy("h", "v").agg(F.min(rank("doc_id")).alias("lo"), F.max(rank("doc_id")).alias("hi")).where("lo < hi").select(F.col("h").alias("sh"), F.col("v").alias("sv"), "lo")
        seen = written(seen)
        again = each.join(seen, (F.col("h") == F.col("sh")) & (F.col("v") == F.col("sv")))
        again = again.where(rank("doc_id") > F.col("lo")) if last else again
        again = again.groupBy("doc_id", "k").agg(F.collect_set("at").alias("hit")).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k"), "hit")
        again = written(again)
        if last or again.isEmpty():
            break
        found = written(_narrowed(found.join(again, _same()).select("doc_id", "k", "starts", "anchors", "words", "hit"), sizes[: j + 2], length))
    # empty where no window survived to the last level
    return copies.distinct().unionByName(again.select("r_id", "r_k", F.lit(False).alias("whole"), F.col("hit").alias("starts")))


def _cut(texts: pa.Array, whole: pa.Array, starts: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text, words that go, and the others joined by one blank."""
    w = Words(texts, SPACED)
    gone, n = np.zeros(len(w.starts) + 1, np.int64), len(w.counts)
    all_ = whole.fill_null(False).to_numpy(zero_copy_only=False)
    for i in range(n):
        if all_[i]:
            gone[w.first[i]] += 1
            gone[w.first[i + 1]] -= 1
        elif starts[i].is_valid:
            s = w.first[i] + starts[i].values.to_numpy()
            np.add.at(gone, s, 1)
            np.add.at(gone, s + length, -1)
    stays = np.cumsum(gone[:-1]) == 0
    # the bytes of words that stay, and a blank after each word
    lengths = (w.ends - w.starts) * stays
    total = np.concatenate([[0], np.cumsum(lengths)])
    number = np.concatenate([[0], np.cumsum(stays)])
    place = np.arange(total[-1]) + np.repeat(w.starts - total[:-1], lengths)
    out = np.full(total[-1] + number[-1], 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[(total[1:] + number[1:] - 1)[stays]] = False
    out[keep] = w.data[place]
    edge, flat = total[w.first] + number[w.first], out.tobytes()
    kept = [flat[edge[i] : max(edge[i], edge[i + 1] - 1)] for i in range(n)]
    return w.counts, w.counts - np.diff(number[w.first]), pa.array(kept, pa.binary()).cast(pa.string())


def _with_removals(docs: DataFrame, length: int, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """``docs`` with columns renamed c0, c1, ... (names of any kind may clash), then whole and starts; place of the text."""
    gone = removals(docs, length, doc_id, text)
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, at = f"c{docs.columns.index(doc_id)}", docs.columns.index(text)
    joined = d.join(gone, F.col(key).eqNullSafe(F.col("r_id")) & F.xxhash64(f"c{at}").eqNullSafe(F.col("r_k")), "left")
    return joined.select(*d.columns, "whole", "starts"), at


def dedup(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept (its other words, joined by one blank)."""
    d, at = _with_removals(docs.select(doc_id, text), length, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "c1"):
            n, removed, kept = _cut(b.column("c1"), b.column("whole"), b.column("starts"), length)
            yield pa.RecordBatch.from_arrays([b.column("c0"), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), kept], ["doc_id", "n_words", "n_removed", "kept"])

    kind = d.schema["c0"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def cleaned(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what repeats taken out of the text; texts that lose nothing stay as they are, documents that lose all words go."""
    d, at = _with_removals(docs, length, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, f"c{at}"):
            n, removed, kept = _cut(b.column(f"c{at}"), b.column("whole"), b.column("starts"), length)
            new = pc.if_else(pa.array(removed > 0), kept, b.column(f"c{at}").cast(pa.string()))
            cols = [new if i == at else b.column(i) for i in range(b.num_columns - 2)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-2]).filter(pa.array((removed == 0) | (removed < n)))

    return d.mapInArrow(run, d.drop("whole", "starts").schema).toDF(*docs.columns)
