"""Exact quantiles and running sums of large tables, without a task that holds or sorts all of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.stored import stored

#: Values that the driver takes at most for one order statistic; those of larger tables are bracketed first.
HELD = 100_000
#: Accuracy of the sketch that brackets; its rank error is one part of so many.
ACCURACY = 10_000
#: Rows that one task numbers.
RANGE = 200_000


def quantiles(rows: DataFrame, column: str | Column, asked: list[float], by: str | None = None) -> dict:
    """Quantiles with linear interpolation, as lists by the values of ``by``, a closed vocabulary (None without it).

    Rows are counted first. Order statistics of a small group are read from its values. In a large
    one each is bracketed by a sketch, rows below and at the bracket's ends are counted, and what is
    inside is bracketed again until it is small. Nulls don't count; a group without values has nulls.
    """
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    base = rows.select(F.col(by).alias("key") if by else F.lit(None).cast("string").alias("key"), value.alias("v"))
    sizes = {r["key"]: r["n"] for r in base.groupBy("key").agg(F.count("v").alias("n")).collect()}
    if not by:
        sizes = sizes or {None: 0}
    wanted = {(k, i) for k, n in sizes.items() if n for q in asked for i in (math.floor((n - 1) * q), math.ceil((n - 1) * q))}
    found = order_statistics(base, sizes, wanted)

    def at(key: object, q: float) -> float | None:
        if not (n := sizes[key]):
            return None
        place = (n - 1) * q
        low, high = found[key, math.floor(place)], found[key, math.ceil(place)]
        return low + (high - low) * (place - math.floor(place))

    return {k: [at(k, q) for q in asked] for k in sizes}


def order_statistics(base: DataFrame, sizes: dict, wanted: set[tuple]) -> dict[tuple, float]:
    """The i-th value, from 0, of a key, for each (key, i); ``base`` has key and v."""
    found: dict[tuple, float] = {}
    # Per statistic an open interval that holds it, how many values lie below its inside, and how many inside.
    open_ = {w: (-math.inf, math.inf, 0, sizes[w[0]]) for w in wanted}

    def inside(key: object, low: float, high: float) -> Column:
        within = F.col("key").eqNullSafe(F.lit(key)) & F.col("v").isNotNull()
        for limit, test in ((low, F.col("v") > low), (high, F.col("v") < high)):
            within = within & test if math.isfinite(limit) else within
        return within

    while open_:
        large = {w: b for w, b in open_.items() if b[3] > HELD}
        small = {w: b for w, b in open_.items() if w not in large}
        if small:
            spans = sorted({(str(w[0]), w[0], b[0], b[1]) for w, b in small.items()}, key=lambda s: (s[0], s[2]))
            tests = [inside(*s[1:]) for s in spans]
            any_of = tests[0]
            for t in tests[1:]:
                any_of = any_of | t
            held = base.where(any_of).toArrow()
            keys, values = np.array(held.column("key").to_pylist(), object), held.column("v").to_numpy()
            for _, key, low, high in spans:
                own = np.sort(values[(keys == key) & (values > low) & (values < high)]) if math.isfinite(low) or math.isfinite(high) else np.sort(values[keys == key])
                found |= {w: float(own[w[1] - b[2]]) for w, b in small.items() if (w[0], b[0], b[1]) == (key, low, high)}
            open_ = large
            continue
        places = list(large.items())
        sketches = []
        for (key, i), (low, high, below, n) in places:
            middle = (i - below) / n
            ends = F.array(F.lit(max(0.0, middle - 2 / ACCURACY)), F.lit(min(1.0, middle + 2 / ACCURACY)))
            sketches.append(F.percentile_approx(F.when(inside(key, low, high), F.col("v")), ends, F.lit(ACCURACY)))
        ends = base.agg(F.array(*sketches).alias("x")).first()["x"]
        counts = []
        for ((key, _), (low, high, _, _)), (a, b) in zip(places, ends, strict=True):
            own = inside(key, low, high)
            tests = [F.col("v") < a, F.col("v") == a, (F.col("v") > a) & (F.col("v") < b), (F.col("v") == b) & F.lit(b > a)]
            counts.append(F.array(*[F.count_if(own & t) for t in tests]))
        for ((key, i), (low, high, below, n)), (a, b), c in zip(places, ends, base.agg(F.array(*counts).alias("x")).first()["x"], strict=True):
            cuts = below + np.cumsum(c)
            del open_[key, i]
            if i < cuts[0]:
                open_[key, i] = (low, a, below, c[0])
            elif i < cuts[1]:
                found[key, i] = a
            elif i < cuts[2]:
                open_[key, i] = (a, b, int(cuts[1]), c[2])
            elif i < cuts[3]:
                found[key, i] = b
            else:
                open_[key, i] = (b, high, int(cuts[3]), n - sum(c))
    return found


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` and, for each named column, ``before_<name>``: its sum over all rows earlier in a total order.

    Rows are dealt to ranges of the order and stored with their range; ranges are summed, their offsets run over one
    row a range, and each range is summed on its own.
    """
    return _running(stored(rows, "running"), order, sums)


def _running(kept: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``running`` of rows that are stored."""
    parts = max(1, math.ceil(kept.count() / RANGE))
    ranges = stored(kept.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    totals = ranges.groupBy("range_").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range_", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"all_{c}") for c in sums])
    within = Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranges.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
    joined = inside.join(F.broadcast(offsets), "range_")  # a row a range, so one for every ``RANGE`` rows
    return joined.select(*kept.columns, *[(F.col(f"before_{c}") + F.col(f"all_{c}")).alias(f"before_{c}") for c in sums])


def equal_groups(rows: DataFrame, order: list[str], groups: int, out: str) -> DataFrame:
    """``rows`` and their group of equal frequency by rank in a total order, from 0."""
    kept = stored(rows.withColumn("one_", F.lit(1)), "grouped")
    ranked = _running(kept, [F.col(c) for c in order], ["one_"])
    place = F.ceil(F.col("before_one_") * groups / max(kept.count() - 1, 1)) - 1
    return ranked.withColumn(out, F.greatest(F.lit(0), place).cast("long")).drop("one_", "before_one_")
