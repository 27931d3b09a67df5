"""Boosted trees that grow leaf by leaf on histograms of quantised features; the histograms are summed in tasks.

A tree splits the leaf of greatest gain until it has its number of leaves. Histograms of all leaves that may be split next are
counted together. Gradients are rounded to whole numbers of a fixed unit, so that sums don't depend on their order and any
split of the rows into tasks gives the same trees.

Rows of equal bins have equal scores after any tree, so those of equal label, too, are one row with a weight; of squared loss, whose
derivatives are sums of labels, all of them are one row with their mean. So the number of rows is bounded by the bins, not by the
table. Up to ``HELD`` of them are fitted by one task, more by passes of all tasks, with the same result.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.stored import discard, stored

#: Bins of a feature; the last one holds missing values.
BINS, MISSING = 256, 255
#: Different rows of bins that one task fits on its own, at about 100 bytes each; more are passed over by all tasks for each level of each tree.
HELD = 4_000_000
#: Trees after which the scores of a larger table are written anew, so that a pass evaluates no more than that.
STORED_EVERY = 10
#: Rows for which a tree is evaluated at once, so that they stay in a core's cache.
AT_ONCE = 16_384
#: Combinations of bins at most that are counted together, rows for each of them at least, and how many more than occur may be looked at.
CODES, ROWS_A_CODE, SPARE = 16_384, 256, 16
#: Accuracy of the sketches from which edges of bins are taken.
ACCURACY = 10_000
#: Least sum of second derivatives on either side of a split.
LEAST_HESSIAN = 1e-3


@dataclass(frozen=True)
class Settings:
    """How trees are grown; ``loss`` is log (labels 0 and 1) or squared."""

    iterations: int = 80
    leaves: int = 15
    rate: float = 0.1
    least: int = 20
    l2: float = 1.0
    loss: str = "log"

    def __post_init__(self) -> None:
        if self.loss not in ("log", "squared"):
            raise ValueError("the loss is log or squared")
        if min(self.iterations, self.leaves, self.least) < 1 or not (self.rate > 0 and math.isfinite(self.rate)) or not (self.l2 >= 0 and math.isfinite(self.l2)):
            raise ValueError("iterations, leaves and rows of a leaf have to be 1 or more, the rate above 0, the weight 0 or more")


@dataclass
class Tree:
    """Nodes by number, the root first: the feature and last left bin of a split, where missing values go, both children; the value of a leaf."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> tuple[int, int]:
        """Make a leaf a split of two new leaves."""
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node], self.right[node] = feature, cut, missing_left, left, right
        for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column += [start, start]
        return left, right

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        feature, cut, missing, left, right = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(rows):
            node = at[rows]
            b = bins[rows, feature[node]]
            goes_left = np.where(b == MISSING, missing[node], b <= cut[node])
            at[rows] = np.where(goes_left, left[node], right[node])
            rows = rows[feature[at[rows]] >= 0]
        return at

    def goes_left(self, node: int, b: np.ndarray) -> np.ndarray:
        """Which of the bins of a split's feature go left; a cut lies below the bin of missing values."""
        return (b <= self.cut[node]) | (b == MISSING) if self.missing_left[node] else b <= self.cut[node]

    def values(self, bins: np.ndarray) -> np.ndarray:
        """The value of each row, chosen from the leaves up: children have higher numbers than their parent."""
        out = np.empty(len(bins))
        for start in range(0, len(bins), AT_ONCE):
            part = bins[start : start + AT_ONCE]
            found: dict[int, np.ndarray | float] = {}
            for n in reversed(range(len(self.feature))):
                if self.feature[n] < 0:
                    found[n] = self.value[n]
                else:
                    found[n] = np.where(self.goes_left(n, part[:, self.feature[n]]), found.pop(self.left[n]), found.pop(self.right[n]))
            out[start : start + AT_ONCE] = found[0]
        return out


@dataclass
class Model:
    """Names and edges of the features, the score of all rows before any tree, and the trees."""

    features: list[str]
    edges: list[np.ndarray]
    loss: str
    base: float
    trees: list[Tree]

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.values(bins)
        return out

    def scores(self, bins: np.ndarray) -> np.ndarray:
        """Probabilities for log loss, else the values themselves."""
        raw = self.raw(bins)
        return 1 / (1 + np.exp(-raw)) if self.loss == "log" else raw


def edges_of(rows: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Edges between the bins of each feature: middles between neighbours among its least, its greatest and its quantiles, without null and NaN."""
    asked = [i / (BINS - 3) for i in range(1, BINS - 3)]
    each = []
    for f in features:
        c = F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(None).cast("double"))
        each.append(F.struct(F.min(c).alias("least"), F.max(c).alias("most"), F.percentile_approx(c, F.lit(asked), F.lit(ACCURACY)).alias("middle")).alias(f"f{len(each)}"))
    found = rows.agg(*each).first()
    out = []
    for x in found:
        values = np.unique([v for v in (x["least"], *(x["middle"] or []), x["most"]) if v is not None and math.isfinite(v)])
        out.append((values[1:] + values[:-1]) / 2)
    return out


def bins_of(batch: pa.RecordBatch, features: Sequence[str], edges: Sequence[np.ndarray]) -> np.ndarray:
    """The bins of a batch's rows, one byte a feature: how many edges lie below a value."""
    out = np.empty((batch.num_rows, len(features)), np.uint8, order="F")
    for j, (name, edge) in enumerate(zip(features, edges, strict=True)):
        values = batch.column(batch.schema.get_field_index(name)).cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, j] = np.where(np.isnan(values), MISSING, np.searchsorted(edge, values))
    return out


@dataclass
class Rows:
    """Rows as one task holds them: bins, labels, raw scores, and how many rows each stands for."""

    bins: np.ndarray
    label: np.ndarray
    raw: np.ndarray
    weight: np.ndarray

    def derivatives(self, settings: Settings, unit: float) -> tuple[np.ndarray, np.ndarray]:
        """Both derivatives of each row in whole numbers of ``unit``, times its weight."""
        if settings.loss == "log":
            p = 1 / (1 + np.exp(-self.raw))
            first, second = p - self.label, p * (1 - p)
        else:
            first, second = self.raw - self.label, np.ones(len(self.raw))
        return np.rint(first * unit) * self.weight, np.rint(second * unit) * self.weight

    def add(self, tree: Tree) -> None:
        self.raw = self.raw + tree.values(self.bins)


@dataclass
class Bundle:
    """Features that are counted together: each row's combination of their bins, and the bin of each feature in each combination."""

    features: list[int]
    code: np.ndarray
    bins: np.ndarray


def bundles_of(bins: np.ndarray) -> list[Bundle]:
    """Features dealt to bundles, those of fewest bins first, as long as a bundle has few combinations for its rows."""
    most = min(CODES, len(bins) // ROWS_A_CODE)
    if most < BINS:
        return [Bundle([f], bins[:, f], np.arange(BINS)[None, :]) for f in range(bins.shape[1])]
    found: list[Bundle] = []
    seen = [np.flatnonzero(np.bincount(bins[:, f], minlength=BINS)) for f in range(bins.shape[1])]
    for f in sorted(range(bins.shape[1]), key=lambda f: (len(seen[f]), f)):
        place = np.zeros(BINS, np.uint16)
        place[seen[f]] = np.arange(len(seen[f]))
        own = place[bins[:, f]]
        for b in found:
            if b.bins.shape[1] * len(seen[f]) > most * SPARE:
                continue
            code = b.code.astype(np.int32) * len(seen[f]) + own
            there = np.flatnonzero(np.bincount(code, minlength=1))
            if len(there) <= most:  # only combinations that occur are counted
                number = np.zeros(there[-1] + 1, np.uint16)
                number[there] = np.arange(len(there))
                b.code = number[code]
                b.bins = np.vstack([b.bins[:, there // len(seen[f])], seen[f][there % len(seen[f])]])
                b.features.append(f)
                break
        else:
            found.append(Bundle([f], own, seen[f][None, :]))
    return found


class HeldRows:
    """Rows that one task holds for a whole fit: bins by column and by bundle, and the rows of each node of the tree that grows."""

    def __init__(self, rows: Rows):
        self.rows = replace(rows, bins=np.asfortranarray(rows.bins))
        self.bundles = bundles_of(self.rows.bins)  # of few rows each feature is one
        self.members: dict[int, np.ndarray | slice] = {}
        self.first = self.second = np.empty(0)

    def histograms(self, tree: Tree, targets: list[int], settings: Settings, unit: float) -> np.ndarray:
        """For each target leaf, feature and bin: sums of both derivatives in ``unit``, and rows; whole numbers."""
        if targets == [0]:
            self.begin(settings, unit)
        out = np.zeros((len(targets), self.rows.bins.shape[1], BINS, 3), np.int64)
        for place, node in enumerate(targets):
            own = self.members_of(tree, node)
            weights = (self.first[own], self.second[own], self.rows.weight[own])
            for b in self.bundles:
                key = b.code[own].astype(np.intp)
                for k, w in enumerate(weights):
                    sums = np.bincount(key, w, b.bins.shape[1])
                    for f, each in zip(b.features, b.bins, strict=True):
                        out[place, f, :, k] = np.rint(np.bincount(each, sums, BINS))
        return out

    def begin(self, settings: Settings, unit: float) -> None:
        """Start a tree."""
        self.first, self.second = self.rows.derivatives(settings, unit)
        self.members = {0: slice(None)}

    def members_of(self, tree: Tree, node: int) -> np.ndarray | slice:
        if node not in self.members:
            parent = parent_of(tree, node)
            whole = self.members_of(tree, parent)
            del self.members[parent]  # its children have its rows from now on
            left = tree.goes_left(parent, self.rows.bins[:, tree.feature[parent]][whole])
            for child, side in ((tree.left[parent], left), (tree.right[parent], ~left)):
                self.members[child] = np.flatnonzero(side) if isinstance(whole, slice) else whole[side]
        return self.members[node]

    def add(self, tree: Tree) -> None:
        self.rows.add(tree)


class DealtRows:
    """Rows of a stored table (bins, label, raw, weight) that all tasks pass over."""

    def __init__(self, table: DataFrame):
        self.table, self.fresh = table, []

    def histograms(self, tree: Tree, targets: list[int], settings: Settings, unit: float) -> np.ndarray:
        fresh = self.fresh

        def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                rows = rows_of(batch)
                for t in fresh:
                    rows.add(t)
                held = HeldRows(rows)
                held.begin(settings, unit)
                found = held.histograms(tree, targets, settings, unit)
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["state"])

        return self.table.mapInArrow(local, "state binary").rdd.map(lambda r: pickle.loads(r["state"])).treeReduce(np.add)

    def add(self, tree: Tree) -> None:
        self.fresh = [*self.fresh, tree]
        if len(self.fresh) < STORED_EVERY:
            return
        fresh, before = self.fresh, self.table

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = rows_of(batch)
                for t in fresh:
                    rows.add(t)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows.raw), batch.column(3)], ["bins", "label", "raw", "weight"])

        self.table, self.fresh = stored(before.mapInArrow(scored, before.schema), "boosted-rows"), []
        discard(before)


def rows_of(batch: pa.RecordBatch) -> Rows:
    """A batch of (bins, label, raw, weight)."""
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    label, raw, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    return Rows(bins, label, raw, weight.astype(float))


def together(batches: Iterator[pa.RecordBatch]) -> Rows:
    """All rows of a task."""
    parts = [rows_of(b) for b in batches if b.num_rows]
    return Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("bins", "label", "raw", "weight")))


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    rows_left: int
    rows_right: int


def best_split(histogram: np.ndarray, settings: Settings, unit: float) -> Split | None:
    """The split of greatest gain of a leaf (feature, bin, sums): of equal ones the first feature, the lowest cut, missing values to the right."""
    first, second, rows = histogram[..., 0], histogram[..., 1], histogram[..., 2]
    all_first, all_second, n = first[0].sum(), second[0].sum(), int(rows[0].sum())
    score = lambda a, b: (a / unit) ** 2 / (b / unit + settings.l2) if settings.l2 else (a / unit) ** 2 / np.maximum(b / unit, 1e-300)
    whole = score(all_first, all_second)
    best = None
    for missing_left in (False, True):
        gone = histogram[:, MISSING:, :] if missing_left else 0
        left = np.cumsum(histogram[:, :MISSING, :], axis=1) + gone
        l_first, l_second, l_rows = left[..., 0], left[..., 1], left[..., 2]
        r_first, r_second, r_rows = all_first - l_first, all_second - l_second, n - l_rows
        ok = (l_rows >= settings.least) & (r_rows >= settings.least) & (l_second >= LEAST_HESSIAN * unit) & (r_second >= LEAST_HESSIAN * unit)
        if missing_left:
            ok &= histogram[:, MISSING, 2][:, None] > 0  # else both ways are one
        gain = np.where(ok, score(l_first, l_second) + score(r_first, r_second) - whole, -np.inf)
        f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, cut] > 0 and (best is None or gain[f, cut] > best.gain):
            unseen = histogram[f, MISSING, 2] == 0
            best = Split(float(gain[f, cut]), int(f), int(cut), bool(l_rows[f, cut] > r_rows[f, cut]) if unseen else missing_left, int(l_rows[f, cut]), int(r_rows[f, cut]))
    return best


def grown(rows: HeldRows | DealtRows, settings: Settings, unit: float) -> Tree:
    """One tree: leaves are split by falling gain. Children of the leaves that may still be chosen are counted together, before they are chosen."""
    trial = Tree()
    histogram = {0: rows.histograms(trial, [0], settings, unit)[0]}
    split = {0: best_split(histogram[0], settings, unit)}
    chosen: list[int] = []
    while len(chosen) < settings.leaves - 1:
        # A chosen leaf's children stand for it.
        open_ = [n for n in split if split[n] and n not in chosen and (n == 0 or parent_of(trial, n) in chosen)]
        if not open_:
            break
        best = min(open_, key=lambda n: (-split[n].gain, n))
        if trial.feature[best] < 0:  # its children haven't been counted
            left_over = settings.leaves - 1 - len(chosen)
            new = [n for n in sorted(open_, key=lambda n: (-split[n].gain, n))[:left_over] if trial.feature[n] < 0]
            lefts = {n: trial.split(n, split[n].feature, split[n].cut, split[n].missing_left)[0] for n in new}
            # The child of fewer rows is counted, the other one is what remains.
            counted = [lefts[n] + (split[n].rows_left > split[n].rows_right) for n in new]
            for n, target, found in zip(new, counted, rows.histograms(trial, counted, settings, unit), strict=True):
                other = histogram[n] - found
                for child, h in zip((lefts[n], lefts[n] + 1), (found, other) if target == lefts[n] else (other, found), strict=True):
                    histogram[child] = h
                    split[child] = best_split(h, settings, unit) if h[0, :, 2].sum() >= 2 * settings.least else None
        chosen.append(best)
    return pruned(trial, chosen, histogram, settings, unit)


def parent_of(tree: Tree, node: int) -> int:
    return tree.left.index(node) if node in tree.left else tree.right.index(node)


def pruned(trial: Tree, chosen: list[int], histogram: dict[int, np.ndarray], settings: Settings, unit: float) -> Tree:
    """The chosen splits only, and the values of their leaves."""
    out, place = Tree(), {0: 0}
    for n in chosen:  # a parent is chosen before its children
        left, right = out.split(place[n], trial.feature[n], trial.cut[n], trial.missing_left[n])
        place |= {trial.left[n]: left, trial.right[n]: right}
    for n, at in place.items():
        if out.feature[at] < 0:
            first, second = histogram[n][0, :, 0].sum() / unit, histogram[n][0, :, 1].sum() / unit
            out.value[at] = float(-settings.rate * first / (second + settings.l2)) if second + settings.l2 > 0 else 0.0
    return out


def boosted(rows: HeldRows | DealtRows, settings: Settings, unit: float) -> list[Tree]:
    trees = []
    for _ in range(settings.iterations):
        tree = grown(rows, settings, unit)
        if tree.feature[0] < 0:
            break  # nothing can be split any more, now or later
        trees.append(tree)
        rows.add(tree)
    return trees


def fit(rows: DataFrame, features: Sequence[str], label: str, settings: Settings, held: int = HELD) -> Model:
    """Trees fitted on all rows that have a label; features are numbers, null and NaN are missing.

    Tables of up to ``held`` different rows of bins are fitted by one task, larger ones by passes of all tasks, with the same result.
    """
    rows = rows.where(F.col(label).isNotNull())
    edges = edges_of(rows, features)
    seen = rows.agg(F.count("*").alias("n"), F.avg(label).alias("mean"), F.min(label).alias("least"), F.max(label).alias("most")).first()
    n, mean = seen["n"], seen["mean"]
    if not n:
        raise ValueError("there are no rows to fit on")
    if settings.loss == "log":
        if seen["least"] < 0 or seen["most"] > 1:
            raise ValueError("labels have to be 0 or 1")
        if seen["least"] == seen["most"]:
            raise ValueError("there is only one class of labels")
        base, reach = math.log(mean / (1 - mean)), 1.0
    else:
        base, reach = float(mean), max(1.0, float(seen["most"] - seen["least"]))
    unit = 2.0 ** math.floor(52 - math.log2(n * reach))  # sums of whole numbers stay below 2 ** 53
    names = [f"f{i}" for i in range(len(features))]

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.ascontiguousarray(bins_of(batch, names, edges))
            lines = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(names)), len(bins), [None, pa.py_buffer(bins)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([lines, batch.column(len(names))], ["bins", "label"])

    numbers = rows.select(*[F.col(f"`{f}`").cast("double").alias(k) for f, k in zip(features, names, strict=True)], F.col(label).cast("double").alias("label"))
    table = numbers.mapInArrow(quantised, "bins binary, label double")
    if settings.loss == "log":
        table = table.groupBy("bins", "label").agg(F.count("*").alias("weight"))
    else:
        above = F.sum(F.rint((F.col("label") - base) * unit).cast("long"))  # in whole numbers, so that their order doesn't matter
        table = table.groupBy("bins").agg(F.count("*").alias("weight"), (base + above / (F.count("*") * unit)).alias("label"))
    table = stored(table.select("bins", "label", F.lit(base).alias("raw"), "weight"), "boosted-rows")
    if table.count() > held:
        trees = boosted(DealtRows(table), settings, unit)
    else:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = boosted(HeldRows(together(batches)), settings, unit)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["trees"])

        trees = pickle.loads(table.coalesce(1).mapInArrow(whole, "trees binary").first()["trees"])
        discard(table)
    return Model(list(features), edges, settings.loss, base, trees)


def with_score(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``rows`` and the model's score of each; features that are null or NaN are missing."""
    names = [f"feature_{i}_" for i in range(len(model.features))]
    given = rows.columns
    wide = rows.select("*", *[F.col(f"`{f}`").cast("double").alias(k) for f, k in zip(model.features, names, strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(bins_of(batch, names, model.edges))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(found)], [*given, out])

    return wide.mapInArrow(score, rows.withColumn(out, F.lit(0.0)).schema)


def staged(model: Model, trees: int) -> Model:
    """The model after its first trees."""
    return replace(model, trees=model.trees[:trees])


def with_effects(rows: DataFrame, model: Model, neutral: dict[str, float | None], groups: dict[str, list[str]], out: str = "effects") -> DataFrame:
    """``rows`` with ``score`` and, for each group of features, how much the score falls if they take their neutral values; all in one pass."""
    names = [f"feature_{i}_" for i in range(len(model.features))]
    given = rows.columns
    wide = rows.select("*", *[F.col(f"`{f}`").cast("double").alias(k) for f, k in zip(model.features, names, strict=True)])
    value = lambda f: MISSING if neutral[f] is None else int(np.searchsorted(model.edges[model.features.index(f)], neutral[f]))
    changes = [[(model.features.index(f), value(f)) for f in group] for group in groups.values()]

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = bins_of(batch, names, model.edges)
            score = model.scores(bins)
            each = []
            for change in changes:
                other = bins.copy()
                for at, b in change:
                    other[:, at] = b
                each.append(score - model.scores(other))
            lists = pa.array(np.stack(each, axis=1).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(given)], pa.array(score), lists], [*given, "score", out])

    schema = rows.withColumns({"score": F.lit(0.0), out: F.array(F.lit(0.0))}).schema
    return wide.mapInArrow(effects, schema)


def as_json(model: Model) -> str:
    """A model as text, from which ``of_json`` makes it again, bit by bit."""
    return json.dumps({"features": model.features, "edges": [e.tolist() for e in model.edges], "loss": model.loss, "base": model.base, "trees": [asdict(t) for t in model.trees]}, allow_nan=False)


def of_json(text: str) -> Model:
    found = json.loads(text)
    return Model(found["features"], [np.array(e, float) for e in found["edges"]], found["loss"], found["base"], [Tree(**t) for t in found["trees"]])
