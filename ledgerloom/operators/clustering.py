"""Mini-batch k-means of many models at once: each job reads one batch of the rows and moves the centres of all of them.

Rows are dealt to batches by a hash. For each model a batch's rows go to their nearest centres, and a centre moves
towards its rows' mean by their share of all rows that it has had so far. Rows are whole numbers of a fixed unit,
so sums don't depend on their order, and reruns give the same centres.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.stored import stored

#: Rows of a batch on average, passes over all rows, starts of each number of clusters, and rows of least hash from which starts are drawn.
BATCH, PASSES, STARTS, DRAWN = 4096, 2, 10, 3000
#: Batches that are kept apart at most; those of larger tables hold more rows.
BATCHES = 64
#: Parts of one in which rows are whole numbers.
UNIT = 1 << 20
#: A centre that has had less than this share of the rows of the fullest one starts anew.
EMPTY = 0.01


@dataclass
class Model:
    """Centres in whole units, how many rows each has had, and the sum of squared distances of all rows in the end."""

    centres: np.ndarray
    seen: np.ndarray
    inertia: float = np.inf

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, of equal ones the first, and the squared distance."""
        scaled, centres = x / UNIT, self.centres / UNIT
        distance = np.maximum((scaled**2).sum(axis=1)[:, None] - 2 * scaled @ centres.T + (centres**2).sum(axis=1), 0.0)
        at = distance.argmin(axis=1)
        return at, distance[np.arange(len(x)), at]


def matrix(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.empty((0, 0), np.int64)


def totals(rows: DataFrame, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each model: sums of the rows of each centre, their numbers, and the sum of squared distances in millionths; one state a task, merged in a tree."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            x = matrix(batch)
            if not len(x):
                continue
            found = []
            for m in shared.value:
                at, distance = m.nearest(x)
                sums = np.zeros(m.centres.shape, np.int64)
                np.add.at(sums, at, x)
                found.append((sums, np.bincount(at, minlength=len(sums)), int(np.rint(distance * 1e6).sum())))
            state = found if state is None else merged(state, found)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], ["state"])

    states = rows.select("x").mapInArrow(local, "state binary").rdd.map(lambda r: pickle.loads(r["state"]))
    nothing = [(np.zeros(m.centres.shape, np.int64), np.zeros(len(m.centres), np.int64), 0) for m in models]
    return states.treeAggregate(nothing, merged, merged)


def merged(a: list, b: list) -> list:
    return [tuple(x + y for x, y in zip(m, n, strict=True)) for m, n in zip(a, b, strict=True)]


def spread_start(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each drawn by its squared distance to those drawn before it."""
    chosen = [int(rng.integers(len(x)))]
    distance = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chances = distance / distance.sum() if distance.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=chances)))
        distance = np.minimum(distance, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def fit(rows: DataFrame, key: str, vector: str, ks: Sequence[int], seed: int = 42, starts: int = STARTS, passes: int = PASSES) -> dict[int, Model]:
    """For each number of clusters the model of least inertia among its starts. ``vector`` is an array of doubles; there have to be rows.

    Models of fewer rows than clusters have equal centres.
    """
    units = F.transform(F.col(vector), lambda v: F.round(v * UNIT).cast("long")).alias("x")
    n = rows.count()
    if not n:
        raise ValueError("there are no rows to cluster")
    batches = max(1, min(BATCHES, round(n / BATCH)))
    numbered = rows.select(F.col(key).alias("key"), units, F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).cast("int").alias("batch"))
    dealt = stored(numbered.repartition("batch").sortWithinPartitions("batch"), "cluster-rows") if batches > 1 else stored(numbered, "cluster-rows")
    some = dealt.orderBy(F.xxhash64("key", F.lit(seed + 1)), "key").limit(DRAWN).select("x").collect()  # a bounded sample
    drawn = np.array([r["x"] for r in some], np.int64)
    scaled = drawn / UNIT
    rng = np.random.default_rng(seed)
    models = [Model(spread_start(scaled, k, rng), np.zeros(k, np.int64)) for k in ks for _ in range(starts)]
    for m in models:
        m.centres = np.rint(m.centres * UNIT)
    for _ in range(passes):
        for b in range(batches):
            for m, (sums, counts, _) in zip(models, totals(dealt.where(F.col("batch") == b), models), strict=True):
                own = counts > 0
                m.seen += counts
                m.centres[own] += (sums[own] - counts[own, None] * m.centres[own]) / m.seen[own, None]
                lost = m.seen < EMPTY * m.seen.max()
                if lost.any():
                    m.centres[lost] = drawn[rng.integers(0, len(drawn), int(lost.sum()))]
                    m.seen[lost] = m.seen[~lost].min()
    for m, (_, _, inertia) in zip(models, totals(dealt, models), strict=True):
        m.inertia = inertia / 1e6
    best = {}
    for k, m in zip([k for k in ks for _ in range(starts)], models, strict=True):
        if k not in best or m.inertia < best[k].inertia:
            best[k] = m
    return {k: ordered(m) for k, m in best.items()}


def ordered(model: Model) -> Model:
    """The same model, centres by their first entry, then the second and so on, so that labels don't depend on the start."""
    order = np.lexsort(model.centres.T[::-1])
    return Model(model.centres[order], model.seen[order], model.inertia)


def with_label(rows: DataFrame, vector: str, model: Model, out: str = "prediction") -> DataFrame:
    """``rows`` and the number of the nearest centre."""
    columns = rows.columns
    wide = rows.select("*", F.transform(F.col(vector), lambda v: F.round(v * UNIT).cast("long")).alias("units_"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = model.nearest(matrix(batch, len(columns)))[0] if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(at.astype(np.int32))], [*columns, out])

    return wide.mapInArrow(label, rows.withColumn(out, F.lit(0)).schema)
