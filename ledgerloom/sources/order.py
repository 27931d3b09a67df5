"""Rows of files in the order in which they stand there: numbers without a gap, and first rows without reading the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, islice
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.plans.stored import stored

#: Rows that go through the driver at most when the first rows of files are asked for; more are numbered and filtered by tasks.
HELD = 100_000
#: Blocks (of files, not rows) whose offsets are broadcast; those of more are joined as Spark sees fit.
BLOCKS = 200_000


def file_fields(rows: DataFrame) -> set[str]:
    """What Spark knows of the file of each row: nothing unless ``rows`` is a scan of files."""
    try:
        return set(rows.select("_metadata.*").columns)
    except AnalysisException:
        return set()


def with_file_order(rows: DataFrame, name: str = "row_id", start: int = 1) -> DataFrame:
    """A scan's rows, numbered without a gap by the names of their files and then by their place in the file.

    Spark deals files and parts of files to tasks by size, so tasks say nothing about order. A Parquet row knows its place in
    its file. Other formats are read in blocks, each by one task and in order: blocks are counted in one pass, and a
    second one numbers the rows from their block's first. If both passes should not have cut the
    files alike, the query fails instead of numbering wrongly. Rows that come from no files are numbered in the order of
    their partitions. Nothing is sorted and nothing but a row for each block is moved.
    """
    fields = file_fields(rows)
    place = F.monotonically_increasing_id()
    if "row_index" in fields:
        marked = rows.select("*", F.col("_metadata.file_path").alias("file_"), F.lit(0).alias("block_"), F.lit(0).alias("part_"), F.col("_metadata.row_index").alias("place_"))
    elif fields:
        marked = rows.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("block_"), F.spark_partition_id().alias("part_"), place.alias("place_"))
    else:
        marked = stored(rows.select("*", F.lit("").alias("file_"), F.spark_partition_id().alias("block_"), F.lit(0).alias("part_"), place.alias("place_")), "file-order")
    first = F.lit(0).cast("long") if "row_index" in fields else F.min("place_")
    blocks = marked.groupBy("file_", "block_").agg(F.count("*").alias("rows_"), first.alias("first_"), F.min("part_").alias("own_"))
    before = Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = stored(blocks.withColumn("before_", F.coalesce(F.sum("rows_").over(before), F.lit(0))), "file-blocks")
    offsets = F.broadcast(offsets) if offsets.count() <= BLOCKS else offsets
    joined = marked.join(offsets, ["file_", "block_"], "left")
    within = F.col("place_") - F.col("first_")
    same = (F.col("part_") == F.col("own_")) & (within >= 0) & (within < F.col("rows_"))
    number = F.when(same, within + F.col("before_") + start).otherwise(F.raise_error(F.lit("the files were not cut as when they were counted")).cast("long"))
    return joined.withColumn(name, number).drop("file_", "block_", "part_", "place_", "rows_", "first_", "own_", "before_")


def files_of(rows: DataFrame) -> list[str]:
    """The files of a scan by name."""
    return [unquote(f) for f in sorted(rows.inputFiles())]


def first_rows_of(scan: Callable[[list[str]], DataFrame], files: list[str], limit: int, name: str = "row_id", start: int = 1) -> DataFrame:
    """The first rows of files in order, numbered; ``scan`` reads some of them.

    Up to ``HELD`` rows are taken file by file: Spark reads the first block of a file, and more of them only while rows are
    missing. Beyond that leading files are counted, ever more at once, until they have enough, and numbered; files after
    them are not opened either way.
    """
    if limit <= HELD:
        found: list = []
        for file in files:
            # A single file's blocks are taken in order: all are equally long but the last one.
            found += scan([file]).limit(limit - len(found)).collect()
            if len(found) == limit:
                break
        schema = scan(files[:1]).schema.add(name, "long")
        return scan(files[:1]).sparkSession.createDataFrame([(*r, i) for i, r in enumerate(found, start)], schema)
    opened, seen = 0, 0
    for some in batches(files):
        opened += len(some)
        seen += scan(some).count()
        if seen >= limit:
            break
    return with_file_order(scan(files[:opened]), name, start).where(F.col(name) < limit + start)


def batches(files: list[str]) -> Iterator[list[str]]:
    """One file, then two, four and so on."""
    rest = iter(files)
    for k in count():
        some = list(islice(rest, 2**k))
        if not some:
            return
        yield some
