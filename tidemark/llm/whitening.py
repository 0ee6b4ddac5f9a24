"""Whitening of embeddings by the leading components of their covariance.

Entries become whole numbers x = floor(64 c) + 1000000.  One pass gives the
count, the exact sums and the centred products: each task centres its rows by
their own mean before it multiplies, and tasks' results are put together, in two
levels, with the product of their means' difference.  What meets in one place is
one matrix of dimension by dimension from each task, added up as they arrive; its
eigenvectors (``_eigen``) come from the driver.  A second pass takes the
covariance of the whitened rows the same way, for the error; a third one returns
them.

Rows whose vector is null, is empty, or holds null or non-finite entries are left out,
and so are those with an entry of 2^46 or more (x would be beyond a double's whole
numbers) and those of another length than the commonest one (of equal ones the
greater).  A deviation beyond a long is null.  Components without variance
(at most 1e-12 of the largest's) cannot be whitened and are not returned: a
single vector, or copies of one, give no rows, and neither does an empty table.
Rows with equal or no vec_id are each taken.  Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._eigen import components

#: Added to each scaled entry; sums are kept without it.
OFFSET = 1_000_000
SCALE = 64
LARGEST = float(1 << 46)
#: Rows that are multiplied at once.
AT_ONCE = 4096


@dataclass
class State:
    """Rows, exact sums (whole numbers of any size), mean, and products of what is left of each row without it."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    gram: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> "State":
        values = rows.astype(np.float64)
        mean = values.mean(0)
        values -= mean
        exact = rows.sum(0).astype(object) if rows.dtype != np.int64 or float(np.abs(rows).max()) * len(rows) < 2.0**62 else rows.astype(object).sum(0)
        return State(len(rows), exact, mean, values.T @ values)

    def plus(self, other: "State") -> "State":
        n = self.n + other.n
        step = other.mean - self.mean
        return State(n, self.sums + other.sums, self.mean + step * (other.n / n), self.gram + other.gram + np.outer(step, step) * (self.n * other.n / n))

    def row(self) -> pa.RecordBatch:
        one = lambda x, t: pa.array([x], t)
        return pa.RecordBatch.from_arrays([one(self.n, pa.int64()), one([str(x) for x in self.sums], pa.list_(pa.string())), one(self.mean, pa.list_(pa.float64())), one(self.gram.ravel(), pa.list_(pa.float64()))], _STATE.names)


_STATE = T.StructType([T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.StringType())), T.StructField("mean", T.ArrayType(T.DoubleType())), T.StructField("gram", T.ArrayType(T.DoubleType()))])


def _restored(batch: pa.RecordBatch, i: int) -> State:
    d = len(batch.column("mean")[i])
    return State(batch.column("n")[i].as_py(), np.array([_number(x) for x in batch.column("sums")[i].as_py()], object), batch.column("mean")[i].values.to_numpy(), batch.column("gram")[i].values.to_numpy().reshape(d, d))


def _number(x: str) -> int | float:
    return int(x) if x.lstrip("-").isdigit() else float(x)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = None
    for b in batches:
        for i in range(b.num_rows):
            own = _restored(b, i)
            state = own if state is None else state.plus(own)
    if state is not None:
        yield state.row()


def _usable(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that count, and their scaled entries as whole numbers, without the offset."""
    v = batch.column("v")
    whole = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    v = v.take(pa.array(whole))
    size = np.diff(np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]) if len(v) else np.zeros(0, np.int32)
    keep = size == d
    whole, v = whole[keep], v.filter(pa.array(keep))
    flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(whole), d)  # null becomes NaN
    with np.errstate(invalid="ignore"):
        fine = (np.abs(flat) < LARGEST).all(1)
    return whole[fine], np.floor(SCALE * flat[fine]).astype(np.int64)


def _moments(vectors: DataFrame, d: int, rows_of=None) -> State | None:
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            _, x = _usable(b, d)
            for at in range(0, len(x), AT_ONCE):
                part = State.of(x[at : at + AT_ONCE] if rows_of is None else rows_of(x[at : at + AT_ONCE]))
                state = part if state is None else state.plus(part)
        if state is not None:
            yield state.row()

    states = vectors.select("v").mapInArrow(own, _STATE)
    fan = max(1, int(np.sqrt(vectors.rdd.getNumPartitions())))
    states = states.repartition(fan, F.spark_partition_id() % fan).mapInArrow(_together, _STATE)
    got = states.repartition(1).mapInArrow(_together, _STATE).toArrow()  # one row
    return _restored(got.to_batches()[0], 0) if got.num_rows else None


@dataclass
class Whitening:
    """What is known of all vectors, and the projection: d by k, scaled by the roots of the eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(x / self.trace) for x in self.values]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        # (n x - S) / n: the whole part of the mean leaves first
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - rest) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> np.ma.MaskedArray:
        """Sum of (n x - S)^2 in each row, exact; masked where that is beyond a long."""
        largest = max([abs(s) for s in self.sums], default=0) + self.n * float(np.abs(x).max(initial=0))
        if largest**2 * x.shape[1] < 2.0**62:
            t = self.n * x - np.array(self.sums, np.int64)
            return np.ma.array((t * t).sum(1), mask=False)
        t = x.astype(object) * self.n - np.array(self.sums, object)
        total = (t * t).sum(1)
        over = np.array([v >= 1 << 63 for v in total], bool)
        return np.ma.array(np.where(over, 0, total).astype(np.int64), mask=over)


def _named(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    return vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))


def fit(vectors: DataFrame, *, most: int = 32, embedding: str = "embedding") -> Whitening | None:
    """The leading components of all vectors; None where nothing can be whitened."""
    v = vectors.select(F.col(embedding).alias("v"))
    lengths = v.where("v is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count()
    common = lengths.agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    state = _moments(v, int(common)) if common else None
    if state is None:
        return None
    cov = state.gram / state.n
    values, found = components(cov, most)
    some = values > 1e-12 * max(float(values.max(initial=0.0)), 0.0)
    return Whitening(state.n, [int(s) for s in state.sums], values[some], found[:, some], float(np.trace(cov))) if some.any() else None


def identity_error(vectors: DataFrame, model: Whitening, *, embedding: str = "embedding") -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    state = _moments(vectors.select(F.col(embedding).alias("v")), len(model.sums), model.whitened)
    return float(np.abs(state.gram / state.n - np.eye(len(model.values))).max())


def project(vectors: DataFrame, model: Whitening, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector that counts: vec_id, deviation, whitened (array)."""
    schema = T.StructType([T.StructField("vec_id", vectors.schema[vec_id].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = _usable(b, d)
            w, dev = model.whitened(x), model.deviation(x)
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), pa.array(dev.data, pa.int64(), mask=np.ma.getmaskarray(dev)), arrays], schema.names)

    return _named(vectors, vec_id, embedding).mapInArrow(run, schema)


def whiten(vectors: DataFrame, *, most: int = 32, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row a vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    model = fit(vectors, most=most, embedding=embedding)
    if model is None:
        kind = vectors.schema[vec_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    error = identity_error(vectors, model, embedding=embedding)
    rows = project(vectors, model, vec_id=vec_id, embedding=embedding)
    shares = F.array(*[F.lit(x) for x in model.explained])
    rows = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
