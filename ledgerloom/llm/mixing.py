"""Mixing sources to target weights along a curriculum, DataFrame functions only.

Each source has a weight and a share schedule over training time. A source's
target is filled by its documents in a fixed pseudo-random order, once
through and then a second time; where the demand of words, the integral of the
schedule, reaches a document, inverting the integral gives its training time. Sorting by
that time gives the training order.

Cases: a null or blank text has size 0, is taken 0 words and has no position; a
null source is a source of its own, last in order; without any words all targets are
0; ties are broken by id and a digest of the text, and rows that agree on both are interchangeable;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import SPACE, SPACE_CHARS, discard, parts, rows_in, shared_table

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: Words that the mix takes, as a share of all.
SHARE = 1.5
#: Times that a source may be taken at most.
REPEATS = 2
#: Share schedules as (time, relative share) knots, one for each source in turn, linear between.
SCHEDULES = (((0.0, 1.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Rows of one source that a task numbers at once.
BLOCK = 20_000


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; none in a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.size(F.split(trimmed, SPACE + "+"))).otherwise(0).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """From (source, source_size) to the same with place and target: shares by weight, up to a cap, the excess dealt again.

    Where dealing ends, sources of the least cap per weight are at their cap
    and all others get the same level per weight; so sorting by cap per weight
    finds the level. The window holds one row per source, which is metadata.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    caps = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats))
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    dealt = (
        caps.withColumn("demand", F.sum("source_size").over(everything) * share)
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    )
    level = (F.col("demand") - F.col("capped_before")) / F.col("weight_left")
    # The level at the first source that it doesn't fill holds for it and all later ones; trials at later ones are lower.
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    held = dealt.withColumn("level", F.max(fits).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return held.select("source", "source_size", "place", F.round(target, 6).alias("target"))


def _pieces(knots: tuple[tuple[float, float], ...]) -> list[tuple[float, float, float, float, float]]:
    """Per linear piece: start, length, share at its start and end, the integral before it; shares scaled to an integral of 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for a, b in zip(knots, knots[1:], strict=False):
        low, high, length = a[1] / whole, b[1] / whole, b[0] - a[0]
        out.append((a[0], length, low, high, before))
        before += length * (low + high) / 2
    return out


def time_of(demand: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time in [0, 1] at which the integral of a schedule reaches a share of its whole."""
    found = F.lit(1.0)
    for start, length, low, high, before in reversed(_pieces(knots)):
        rest = F.greatest(demand - before, F.lit(0.0))
        slope = (high - low) / length
        # rest = low t + slope t^2 / 2, solved in the form that also holds for slope 0
        inside = 2 * rest / (low + F.sqrt(F.greatest(F.lit(low * low) + 2 * slope * rest, F.lit(0.0))))
        end = before + length * (low + high) / 2
        found = F.when(demand <= end, F.lit(start) + F.least(inside, F.lit(length))).otherwise(found)
    return found


def order_key(id_column: Column) -> Column:
    """A fixed pseudo-random order of documents that SQL engines agree on: the hex MD5 of the id as text."""
    return F.md5(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", schedules: tuple = SCHEDULES, row_col: str | None = None) -> DataFrame:
    """Per document: size, source_size, target, taken words, first and second position; and ``row``, the column that tells rows apart, if named.

    Running sums of a source are cut into ranges of the order: ranges are
    summed first, so no task numbers more than about ``BLOCK`` rows however many a source or an id has.
    """
    text, source = F.col(text_col), F.col(source_col).cast("string")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(F.col(id_col).alias("id"), source.alias("source"), word_count(text).alias("size"), order_key(F.col(id_col)).alias("key"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")).alias("digest"), row.alias("row"))
    stored = shared_table(base, "mix-sizes")
    # Ranges of the whole order, to which the row's number belongs: not even one id's copies of one text meet in a task.
    order = ["key", "id", "digest", "row"]
    rows = shared_table(stored.repartitionByRange(parts(rows_in(stored), BLOCK), "source", *order).withColumn("block", F.spark_partition_id()), "mix-ranges")
    discard(stored)
    sums = shared_table(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    sources = targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("offset"))
    placed = shared_table(offsets.join(sources, offsets["source"].eqNullSafe(sources["source"])).select(offsets["source"], "block", "offset", "source_size", "place", "target"), "mix-offsets")
    inside = Window.partitionBy("source", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = run.join(placed, run["source"].eqNullSafe(placed["source"]) & (run["block"] == placed["block"])).select("id", "row", "size", "key", run["source"], "source_size", "place", "target", (F.col("offset") + F.col("inside")).alias("start"))
    # The words of pass p that lie within the target; the document at its end is cut there.
    whole = F.floor(F.col("target") + 0.5).cast("long")
    taken = [F.least(F.col("size"), F.greatest(F.lit(0), whole - F.col("start") - p * F.col("source_size"))).cast("long") for p in range(REPEATS)]
    chosen = joined.select("*", *[t.alias(f"taken_{p}") for p, t in enumerate(taken)])
    positions = []
    for p in range(REPEATS):
        middle = (F.col("start") + p * F.col("source_size") + F.col(f"taken_{p}") / 2) / F.nullif(F.col("target"), F.lit(0.0))
        time = F.lit(None).cast("double")
        for i, knots in enumerate(schedules):
            time = F.when(F.col("place") % len(schedules) == i, time_of(middle, knots)).otherwise(time)
        positions.append(F.when(F.col(f"taken_{p}") > 0, F.round(time, 9)).alias(f"position_{p + 1}"))
    return chosen.select(F.col("id").alias(id_col), *(["row"] if row_col else []), "key", "size", "source_size", "target", (F.col("taken_0") + F.col("taken_1")).alias("taken"), *positions, *([F.col(f"taken_{p}").alias(f"taken_{p + 1}") for p in range(REPEATS)] if row_col else []))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The result of ``mix`` range-sorted by first training position; documents that aren't taken come last.

    The order key after the position lets equal positions and the tail be cut into ranges too.
    """
    mixed = mix(docs, id_col, text_col, source_col)
    return mixed.orderBy(F.col("position_1").asc_nulls_last(), "key").drop("key")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, range-sorted by training position.

    A document that the mix takes in part only stands for its part if that is half of it or more.
    A document without words, which has no position, stays once, at the end.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name of docs can clash
    id_at, text_at, source_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col, source_col))
    stored = shared_table(plain.withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    mixed = mix(stored, id_at, text_at, source_at, row_col="row")
    copies = F.filter(F.array(F.when(2 * F.col("taken_1") >= F.col("size"), F.col("position_1")), F.when(2 * F.col("taken_2") >= F.col("size"), F.col("position_2"))), lambda p: p.isNotNull())
    placed = mixed.select("row", "key", F.when(F.col("size") == 0, F.array(F.lit(2.0))).otherwise(copies).alias("at"))
    taken = placed.select("row", "key", F.explode("at").alias("at"))
    return stored.join(taken, "row").orderBy("at", "key").select(*plain.columns).toDF(*docs.columns)
