"""Whitening of embeddings: moments merged over partitions, eigenvectors on the driver, a second pass that verifies.

Cases: a row whose vector is null or holds a null, NaN or infinite entry is left out. Vectors are compared entry by
entry, so those of another length than the commonest (of ties, the longest) are left out, too. Null or
repeated ids and repeated vectors stay, each row counts once. Directions without variance (of a constant entry, of a
single vector, of fewer vectors than entries) can't be scaled to one and give no component; equal eigenvalues
take any orthonormal basis of their space. No valid vector, or only empty ones: an empty result. Columns of other
names are not read. Whole numbers are summed exactly; a number that a long can't hold raises an error instead of wrapping.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components returned at most.
COMPONENTS = 32
#: Numbers of one matrix in a task.
BLOCK = 1 << 20
#: Eigenvalues below this part of the largest one are rounding, not variance.
RANK = 1e-11


@dataclass
class Moments:
    """Count, sums (exact for whole numbers), local mean and centred scatter of some vectors."""

    n: int
    sums: list
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula: the scatters, and the spread between both means, which whole numbers' sums tell exactly."""
        n, step = self.n + other.n, other.mean - self.mean
        if isinstance(self.sums[0], int):
            step = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n * other.n / n)
        return Moments(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], self.mean + step * (other.n / n), scatter)


def moments(x: np.ndarray) -> Moments:
    """Moments of the rows of a matrix, centred before anything is multiplied."""
    whole = np.issubdtype(x.dtype, np.integer)
    fits = not whole or int(np.abs(x).max(initial=0)) < 2**62 // len(x)
    sums = (x if fits else x.astype(object)).sum(axis=0).tolist()
    mean = x.mean(axis=0)
    centred = x - mean
    rest = centred.mean(axis=0)  # what rounding has left in the mean
    scatter = centred.T @ centred - np.outer(rest, rest) * len(x)
    return Moments(len(x), sums, mean + rest, scatter)


def matrices(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """A column of lists of equal length as matrices of about ``BLOCK`` numbers."""
    lists = batch.column(batch.schema.get_field_index(name))
    if not len(lists):
        return
    flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
    each = max(1, BLOCK // max(1, flat.shape[1]))
    for at in range(0, len(flat), each):
        yield flat[at : at + each]


def merged_moments(rows: DataFrame, vector: str, change: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> Moments:
    """Moments of all rows' vectors: one state a partition, merged pairwise in a tree. There has to be a row."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for x in matrices(batch, vector):
                new = moments(change(x))
                state = new if state is None else state.merged(new)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    states = rows.select(vector).mapInArrow(local, "state binary").rdd
    return states.map(lambda r: pickle.loads(r["state"])).treeReduce(Moments.merged)


def valid(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite; NaN is above infinity for Spark."""
    return F.coalesce(F.forall(F.col(vector), lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))), F.lit(False))


@dataclass
class Whitening:
    """What a fit knows: count and sums of the vectors, scaled components by falling eigenvalue, their shares of variance."""

    n: int
    sums: list
    scaled: np.ndarray
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums: exact for whole numbers, as Python's integers where a long is too small."""
        sums = np.array(self.sums, x.dtype if np.issubdtype(x.dtype, np.floating) else object)
        if x.dtype != float and max(self.n * int(np.abs(x).max(initial=0)), *(abs(s) for s in self.sums)) < 2**62:
            return self.n * x - sums.astype(np.int64)
        return self.n * (x if x.dtype == float else x.astype(object)) - sums

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x).astype(float) / self.n) @ self.scaled


def fit(rows: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all rows' vectors, which are valid and of one length; None without any component."""
    if rows.select(vector).where(F.size(vector) > 0).isEmpty():
        return None
    found = merged_moments(rows, vector)
    values, vectors = np.linalg.eigh(found.scatter / found.n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(0.0, values.max() * RANK)]
    if not len(order):
        return None
    axes = vectors[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))])  # the largest entry is positive
    return Whitening(found.n, found.sums, axes / np.sqrt(values[order]), (values[order] * found.n / np.trace(found.scatter)).tolist())


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over all of them."""
    found = merged_moments(rows, vector, model.whitened)
    return float(np.abs(found.scatter / found.n - np.eye(len(model.explained))).max())


def with_whitened(rows: DataFrame, vector: str, model: Whitening, out: str, deviation: str) -> DataFrame:
    """``rows`` with the whitened vector, and with the exact squared length of n * x - sums for whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in matrices(batch, vector):
                far, white = model.centred(x), model.whitened(x)
                if far.dtype == np.int64 and int(np.abs(far).max(initial=0)) ** 2 * far.shape[1] >= 2**63:
                    far = far.astype(object)
                lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), pa.array(white.ravel()))
                length = pa.array((far * far).sum(axis=1).tolist(), pa.int64() if x.dtype != float else pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(x)).columns, lists, length], [*batch.schema.names, out, deviation])
                at += len(x)

    whole = "double" not in dict(rows.dtypes)[vector]
    schema = rows.withColumns({out: F.lit(None).cast("array<double>"), deviation: F.lit(None).cast("long" if whole else "double")}).schema
    return rows.mapInArrow(add, schema)


def comparable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a valid vector of the commonest length."""
    rows = rows.where(valid(vector))
    commonest = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size(vector) == (commonest["size"] if commonest else 0))


def fixed_point(vector: str) -> Column:
    """Entries as whole numbers: 64ths, moved up by a million."""
    return F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * 64) + F.lit(1_000_000).cast("long"))


SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def components_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component of the fixed-point vectors: whitened value, share of variance, error of the whole."""
    rows = comparable(embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")), "v").select("vec_id", fixed_point("v").alias("x"))
    model = fit(rows, "x")
    if model is None:
        return rows.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in SCHEMA.split(", "))]).limit(0)
    error = identity_error(rows, "x", model)
    whitened = with_whitened(rows, "x", model, "values", "deviation").select("vec_id", "deviation", F.posexplode("values").alias("place", "whitened"))
    share = F.element_at(F.array(*[F.lit(e) for e in model.explained]), F.col("place") + 1)
    return whitened.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error")
    )
