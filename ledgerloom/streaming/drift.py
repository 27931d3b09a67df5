"""Drift over a stream of events: sums and histograms of a window are kept as state, merged as events come, and held against a reference once the window is closed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.series import DRIFT_QUANTILES, EVENT_TYPES
from ledgerloom.plans.exact import quantiles

#: Limits of the metrics, from which on they are alerts.
LIMITS = {"count": 0.5, "amount": 0.5, "amount_tvd": 0.2, "type_tvd": 0.2, "fraud_rate": 0.2}


@dataclass(frozen=True)
class Reference:
    """What windows are compared with: length in hours, rows, total, rate of errors, edges of amounts, and shares of bins and of types, other types last."""

    hours: float
    n: float
    total: float
    rate: float
    edges: tuple[float, ...]
    bins: tuple[float, ...]
    types: tuple[float, ...]


def measures(edges: tuple[float, ...]) -> list[Column]:
    """Sums of events (type, amount): all that the metrics need, so that they merge."""
    amount, kind = F.col("value"), F.col("event_type")
    place = sum((F.when(amount >= e, 1).otherwise(0) for e in edges), F.lit(0))
    listed = kind.isin(EVENT_TYPES)
    bins = [F.count_if(place == i) for i in range(len(edges) + 1)]
    types = [*(F.count_if(kind == t) for t in EVENT_TYPES), F.count_if(~F.coalesce(listed, F.lit(False)))]
    return [F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(kind == "error").alias("errors"), F.array(*bins).alias("bins"), F.array(*types).alias("types")]


def reference_of(events: DataFrame, hours: float) -> Reference:
    """The reference of a span of events (ts, event_type, value), of so many hours: edges are its quantiles."""
    edges = tuple(sorted({q for q in quantiles(events, "value", DRIFT_QUANTILES)[None] if q is not None}))
    found = events.agg(*measures(edges)).first()  # one row
    n = float(found["n"])
    if not n:
        raise ValueError("the reference has no events")
    return Reference(hours, n, float(found["total"] or 0), found["errors"] / n, edges, tuple(b / n for b in found["bins"]), tuple(t / n for t in found["types"]))


def compared(sums: DataFrame, reference: Reference, hours: float) -> DataFrame:
    """From sums by ``window_start`` to (window_start, metric, value, threshold, alert): rates by hour against the reference's, shares by half their summed difference."""
    scale, n = reference.hours / hours, F.col("n")
    change = lambda value, base: F.when(F.lit(base) == 0, F.when(value == 0, 0.0)).otherwise((value * scale - base) / abs(base or 1.0))
    apart = lambda counts, shares: sum((F.abs(F.get(counts, i) / n - s) for i, s in enumerate(shares)), F.lit(0.0)) / 2
    values = {"count": change(n, reference.n), "amount": change(F.coalesce("total", F.lit(0.0)), reference.total), "amount_tvd": apart("bins", reference.bins), "type_tvd": apart("types", reference.types), "fraud_rate": F.col("errors") / n - reference.rate}
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), F.round(v, 6).alias("value"), F.lit(LIMITS[m]).alias("threshold")) for m, v in values.items()])
    found = sums.select("window_start", F.inline(listed))
    return found.withColumn("alert", F.col("value").isNull() | (F.abs("value") >= F.col("threshold")))


def windowed(events: DataFrame, reference: Reference, hours: int) -> DataFrame:
    """Sums by ``window_start`` of windows of so many hours from the start of time."""
    sums = events.groupBy(F.window("ts", f"{hours} hours")).agg(*measures(reference.edges))
    return sums.select(F.col("window.start").alias("window_start"), "n", "total", "errors", "bins", "types")


def drift_stream(events: DataFrame, reference: Reference, hours: int, late: str = "2 hours") -> DataFrame:
    """Metrics of every window once the watermark has passed its end; events that come later than ``late`` are left out."""
    return compared(windowed(events.withWatermark("ts", late), reference, hours), reference, hours)
