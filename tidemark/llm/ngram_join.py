"""N-gram Jaccard join by chosen paths.

A document is its set of ``n``-word shingles (all its words, if it has fewer).
Every document carries min-hash values, which are tokens that two sets share
with a probability equal to their Jaccard similarity.  A run splits the whole
collection recursively: a node samples 1 / t of its run's POOL tokens on average
(for t = 0.8 one, or in a quarter of the nodes two), none that its path has used,
and a set goes on to one child for each sampled token, the child of that token's
value; so a pair at the threshold t goes on together into one child on average,
however deep.  Nodes of at most SPLIT sets, and those at DEPTH, are leaves, and
are compared by brute force on the shingles themselves.  The chance that a pair
at the threshold shares a leaf is ``survival``, in closed form; runs repeat until
a pair is missed with a probability below ``1 - recall``.

Documents with equal sets form one class, found by grouping; only a class's
first document is compared, whatever the number of copies.  A pair belongs to
the first leaf that both share, so it is counted once, and leaves in which all
pairs are known to belong to earlier runs are left out before any set is moved.
Leaves of more than BLOCK sets or SHINGLES shingles are compared in pairs of
blocks, each pair a task of its own; nothing is capped, and only counts and a
spanning forest leave a task.  In a dense leaf of m sets, exact counts of links
take all m * m / 2 comparisons, and each set is sent m / BLOCK times.  Groups are
the connected components of all links.

Null and empty texts have no shingles: they are alone, without links.  Rows with
equal doc_id and text are members of one class like other copies.  An empty
table gives an empty result.  Further columns of any name are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import written
from ._text import SPACED, U64, Words, mix, signed, slices, windows

DEPTH = 3
#: Tokens of a run, which its nodes sample.
POOL = 6
#: Nodes of more sets are split again while levels remain.
SPLIT = 256
#: Sets, and shingles of them, in a block; a larger set comes alone.
BLOCK, SHINGLES = 512, 1 << 21
#: Bits of a leaf's number below its run.
_BITS = 56


def survival(similarity: float, threshold: float) -> float:
    """The chance that two sets of this similarity share a leaf of a run.

    Given which of the POOL tokens they share, nodes sample independently, so
    the chance follows from the numbers of tokens unused, and of those shared.
    """
    whole = math.floor(1 / threshold)

    def share(shared: int, unused: int, depth: int) -> float:
        if depth == 0:
            return 1.0
        below = share(shared - 1, unused - 1, depth - 1) if shared else 0.0

        def lost(m: int) -> float:
            m = min(m, unused)
            return sum(math.comb(shared, j) * math.comb(unused - shared, m - j) * (1 - below) ** j for j in range(m + 1)) / math.comb(unused, m)

        more = 1 / threshold - whole
        return 1 - (1 - more) * lost(whole) - more * lost(whole + 1)

    return sum(math.comb(POOL, a) * similarity**a * (1 - similarity) ** (POOL - a) * share(a, POOL, DEPTH) for a in range(POOL + 1))


def runs_for(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is missed with a probability below 1 - recall; ValueError where a leaf's number has no room for them."""
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, threshold))))
    if runs > 1 << (63 - _BITS):
        raise ValueError(f"{runs} runs would be needed at {threshold}")
    return runs


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order (repeats included), and how many each text has."""
    h, count = windows(w.hash, n), np.where(w.counts >= n, w.counts - n + 1, np.minimum(w.counts, 1))
    begin = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), U64)
    long = np.repeat(w.counts >= n, count)
    out[long] = h[w.fits(n)] if len(h) else h
    for i in np.flatnonzero((w.counts > 0) & (w.counts < n)).tolist():
        v = U64(len(w.hash[w.first[i] : w.first[i + 1]]))
        for x in w.hash[w.first[i] : w.first[i + 1]]:
            v = mix(np.array([v], U64) * U64(0x9E3779B97F4A7C15) + x)[0]
        out[begin[i]] = v
    return out, count


def _distinct(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in rising order."""
    doc = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(count))


def _described(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """doc_id, k, n_set, c1, c2 (hashes of the set), tokens (runs * POOL min-hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, 2 * runs * POOL + 1, dtype=U64)) | U64(1)
        for b in slices(batches, "text", 1 << 20):
            h, count = _distinct(*shingles(Words(b.column("text"), SPACED), n))
            some = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[some]
            tokens = np.zeros((len(count), runs * POOL), np.int32)
            c = np.zeros((2, len(count)), U64)
            if len(some):
                for j in range(runs * POOL):
                    least = np.minimum.reduceat((h ^ salt[2 * j]) * salt[2 * j + 1], begin)
                    tokens[some, j] = (least * salt[j] >> U64(32)).astype(np.uint32).view(np.int32)
                for j in (0, 1):
                    c[j, some] = mix(np.add.reduceat(mix(h + U64(j + 1)), begin) + count[some].astype(U64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, runs * POOL, dtype=np.int32)), pa.array(tokens.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(count.astype(np.int64)), pa.array(signed(c[0])), pa.array(signed(c[1])), lists], ["doc_id", "k", "n_set", "c1", "c2", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, k long, n_set long, c1 long, c2 long, tokens array<int>")


def _leaves(classes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """(run, leaf, c, members, shingles): each class's leaves in which it is not alone, and their sets and shingles in all."""
    root = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.struct(r.alias("run"), F.slice("tokens", r * POOL + 1, POOL).alias("t")))
    level = classes.select("c", "n_set", F.explode(root).alias("x")).select("c", "n_set", "x.run", "x.t", F.lit(0).alias("used"), F.xxhash64("x.run").alias("leaf"))
    whole, more = math.floor(1 / threshold), 1 / threshold - math.floor(1 / threshold)
    done = None
    for depth in range(1, DEPTH + 1):
        wanted = F.lit(whole) + (F.pmod(F.xxhash64("leaf", F.lit("many")), F.lit(1 << 20)) < int(more * (1 << 20))).cast("int")
        free = F.filter(F.sequence(F.lit(0), F.lit(POOL - 1)), lambda i: F.getbit("used", i) == 0)
        order = F.array_sort(F.transform(free, lambda i: F.struct(F.xxhash64("leaf", i).alias("h"), i.alias("i"))))
        child = F.transform(F.slice(order, 1, wanted), lambda x: F.struct((F.col("used") + F.pow(F.lit(2), x["i"]).cast("int")).alias("used"), F.xxhash64("leaf", x["i"], F.element_at("t", x["i"] + 1)).alias("leaf")))
        level = level.select("c", "n_set", "run", "t", F.explode(child).alias("x")).select("c", "n_set", "run", "t", "x.used", (F.col("run").cast("long") * (1 << _BITS) + F.col("x.leaf").bitwiseAND(F.lit((1 << _BITS) - 1))).alias("leaf"))
        level = written(level) if depth > 1 else level
        sizes = level.groupBy("leaf").agg(F.count("*").alias("members"), F.sum("n_set").alias("shingles")).where("members > 1").withColumnRenamed("leaf", "s_leaf")
        sizes = written(sizes)  # apart from the join, so that Spark can split a large node there
        level = level.join(sizes, F.col("leaf") == F.col("s_leaf")).drop("s_leaf")
        if depth < DEPTH:
            level = written(level)
            small = level.where(F.col("members") <= SPLIT).select("run", "leaf", "c", "members", "shingles")
            level = level.where(F.col("members") > SPLIT)
            done = small if done is None else done.unionByName(small)
        else:
            level = level.select("run", "leaf", "c", "members", "shingles")
            done = done.unionByName(level) if done is not None else level
    return done


def _shared(of: np.ndarray, value: np.ndarray, m: int) -> np.ndarray:
    """How many values each two of m sets have in common (value[i] is in set of[i])."""
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    number = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1 if len(value) else np.zeros(0, np.int64)
    often = np.bincount(number) > 1
    some = often[number]
    of, number = of[some], (np.cumsum(often) - 1)[number[some]]
    out, width = np.zeros((m, m), np.float32), 2048  # counts below 2**24 are exact
    cuts = np.searchsorted(number, np.arange(0, (int(number[-1]) + 1 if len(number) else 0) + width, width))
    for at, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
        x = np.zeros((m, width), np.float32)
        x[of[lo:hi], number[lo:hi] - at * width] = 1
        out += x @ x.T
    return out


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """Links within each piece: c, linked (documents linked to it here), to (a class of its part of the spanning forest)."""
    t = Fraction(str(threshold))

    def piece(rows: list[tuple], leaf: int, two: bool) -> tuple[list, list, list]:
        seen, keep = set(), []
        for r in rows:  # (c, side, docs, paths, set)
            if r[0] not in seen:
                seen.add(r[0])
                keep.append(r)
        m = len(keep)
        side = np.array([r[1] for r in keep])
        if m < 2 or two and side.all() | ~side.any():
            return [], [], []
        each = lambda lists: np.repeat(np.arange(m), [len(x) for x in lists])
        sets = [np.frombuffer(r[4], U64) for r in keep]
        size, docs = np.array([len(x) for x in sets]), np.array([r[2] for r in keep], np.int64)
        inter = _shared(each(sets), np.concatenate(sets), m).astype(np.float64)
        near = inter * (t.denominator + t.numerator) >= t.numerator * (size[:, None] + size[None, :])
        np.fill_diagonal(near, False)
        if two:  # pairs within one block belong to its own piece
            near &= side[:, None] != side[None, :]
        before = [np.array([x for x in r[3] if x < leaf], np.int64) for r in keep]
        near &= _shared(each(before), np.concatenate(before), m) == 0
        linked = near @ docs
        label = np.arange(m)
        while True:  # least label among neighbours
            least = np.minimum(label, np.where(near, label[None, :], m).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(linked)
        return [keep[i][0] for i in some], linked[some].tolist(), [keep[label[i]][0] for i in some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out() -> pa.RecordBatch:
            c, linked, to = piece(held, key[0], key[1] != key[2])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(linked, pa.int64()), pa.array(to, pa.int64())], ["c", "linked", "to"])

        for batch in batches:
            cols = [batch.column(k) for k in ("c", "side", "docs", "paths", "set")]
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("leaf", "i", "j"))))
            for r in range(batch.num_rows):
                if keys[r] != key:
                    if len(held) > 1:
                        yield out()
                    key, held = keys[r], []
                held.append(tuple(x[r].as_py() for x in cols))
        if len(held) > 1:
            yield out()

    return rows.mapInArrow(run, "c long, linked long, to long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node of each connected component of edges (a, b), by alternating stars; nodes without edges are left out."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("m_a"), F.least("a", "b").alias("m"))
        least = written(least)  # apart from the join, so that Spark can split a node of very many edges there
        large = both.where("b > a").join(least, F.col("a") == F.col("m_a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "m_a"))
        small = large.join(least, F.col("a") == F.col("m_a")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = written(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    return e.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, k (hash of its text), class_id and class_k (of its group's first document: least doc_id, null before all), n_links (documents at the threshold or above)."""
    runs = runs_for(threshold, recall)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("k"), F.col(text).alias("text"))
    meta = written(_described(d, n, runs))
    filled = meta.where("n_set > 0")
    # a set's class is known by the first of its two hashes; the second guards against chance
    classes = filled.groupBy("c1", "c2").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "k")).alias("lead"), F.first("tokens").alias("tokens"), F.first("n_set").alias("n_set")).withColumn("c", F.xxhash64("c1", "c2"))
    classes = written(classes.select("c", "c1", "c2", "docs", "n_set", "lead.doc_id", "lead.k", "tokens"))
    leaves = written(_leaves(classes, runs, threshold))
    paths = leaves.groupBy(F.col("c").alias("p_c")).agg(F.array_sort(F.collect_list("leaf")).alias("paths"))
    members = written(leaves.join(paths, F.col("c") == F.col("p_c")).drop("p_c"))
    of_run = lambda r: lambda p: F.shiftright(p, _BITS) == r
    first = [F.get(F.filter("paths", of_run(r)), F.lit(0)) for r in range(runs - 1)]
    bounds = [f(F.coalesce(x, F.lit(0))).alias(f"{name}{r}") for r, x in enumerate(first) for name, f in (("lo", F.min), ("hi", F.max))]
    owned = F.lit(False)
    for r in range(runs - 1):
        owned |= (F.col("l_run") > r) & (F.col(f"lo{r}") == F.col(f"hi{r}")) & (F.col(f"lo{r}") != 0)
    fresh = members.groupBy(F.col("run").alias("l_run"), F.col("leaf").alias("l_leaf")).agg(F.count("*").alias("size"), *bounds).where(~owned).select("l_leaf")
    fresh = written(fresh)
    work = members.join(fresh, F.col("leaf") == F.col("l_leaf"))
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("shingles") / F.lit(SHINGLES))).cast("int")
    own = F.pmod(F.xxhash64("c", F.lit(7)), blocks).cast("int")
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"), (own > o).cast("int").alias("side")))
    tasks = work.select("c", "paths", F.struct("leaf", pair.alias("pairs")).alias("w")).groupBy("c").agg(F.first("paths").alias("paths"), F.collect_list("w").alias("w"))
    tasks = tasks.join(classes.select(F.col("c").alias("q"), "docs", F.col("doc_id").alias("r_id"), F.col("k").alias("r_k")), F.col("c") == F.col("q")).drop("q")
    with_text = d.join(tasks, F.col("doc_id").eqNullSafe(F.col("r_id")) & F.col("k").eqNullSafe(F.col("r_k"))).select("c", "docs", "paths", "w", "text")
    with_sets = _sets(with_text, n, "c").select("c", "docs", "paths", "set", F.explode("w").alias("w")).select("c", "docs", "paths", "set", "w.leaf", F.explode("w.pairs").alias("x")).select("leaf", "x.*", "c", "docs", "paths", "set")
    dealt = with_sets.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    links = written(_compare(dealt, threshold))
    roots = components(links.select(F.col("c").alias("a"), F.col("to").alias("b")))
    classes = classes.join(roots, F.col("c") == F.col("node"), "left").withColumn("root", F.coalesce("root", "c"))
    counted = links.groupBy("c").agg(F.sum("linked").alias("linked")).withColumnRenamed("c", "l_c")
    classes = classes.join(counted, F.col("c") == F.col("l_c"), "left").select("c1", "c2", "docs", "doc_id", "k", "root", F.coalesce("linked", F.lit(0)).alias("linked"))
    named = classes.groupBy("root").agg(F.min(F.struct("doc_id", "k")).alias("lead")).withColumnRenamed("root", "n_root")
    classes = written(classes.join(named, F.col("root") == F.col("n_root")).select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("lead.doc_id").alias("class_id"), F.col("lead.k").alias("class_k"), (F.col("linked") + F.col("docs") - 1).alias("n_links")))
    out = meta.join(classes, (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")) & (F.col("n_set") > 0), "left")
    return out.select("doc_id", "k", F.when(F.col("n_set") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("n_set") > 0, F.col("class_k")).otherwise(F.col("k")).alias("class_k"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_each(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each group, with the columns of ``docs``."""
    found = near_duplicates(docs, n=n, threshold=threshold, recall=recall, doc_id=doc_id, text=text)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & F.col("k").eqNullSafe(F.col("class_k"))).select(F.col("doc_id").alias("r_id"), F.col("k").alias("r_k")).distinct()
    d = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names of any kind may clash
    key, body = f"c{docs.columns.index(doc_id)}", f"c{docs.columns.index(text)}"
    d = d.withColumn("k", F.xxhash64(body)).join(first, F.col(key).eqNullSafe(F.col("r_id")) & F.col("k").eqNullSafe(F.col("r_k")), "left_semi")
    return d.dropDuplicates([key, "k"]).drop("k").toDF(*docs.columns)


def _sets(rows: DataFrame, n: int, key: str) -> DataFrame:
    """``rows`` with their text's sorted shingle hashes (set, binary) in its place; of rows with an equal ``key`` each task keeps the first."""
    schema = rows.drop("text").schema.add("set", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for whole in batches:
            # repeated rows go before their texts are looked at
            own = whole.column(key).to_pylist()
            keep = np.zeros(len(own), bool)
            for i, x in enumerate(own):
                if x not in seen:
                    seen.add(x)
                    keep[i] = True
            for b in slices([whole if keep.all() else whole.filter(pa.array(keep))], "text"):
                h, count = _distinct(*shingles(Words(b.column("text"), SPACED), n))
                off = (np.concatenate([[0], np.cumsum(count)]) * 8).astype(np.int32)
                col = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(h.tobytes())])
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in schema.names[:-1]), col], schema.names)

    return rows.mapInArrow(run, schema)
