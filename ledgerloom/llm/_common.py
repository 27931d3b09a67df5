"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ledgerloom.plans.stored import discard, stored as shared_table  # noqa: F401  the operators take them from here

#: ASCII white space that separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(column: Column) -> Column:
    """crc32 of an id written as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str, budget: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``budget`` bytes of the text column, one row at least."""
    for batch in batches:
        column, start, size = batch.column(batch.schema.get_field_index(text)), 0, 0
        lengths = pa.compute.binary_length(column).to_pylist()
        for i, n in enumerate(lengths):
            size += n or 0
            if size >= budget:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def frugal(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function over a task's batches; at its end the worker gives memory that it no longer uses back to the machine, as it stays for later tasks of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
            if trim is not None:
                trim(0)

    return run


def rows_in(df: DataFrame) -> int:
    """Rows of a shared table, from the footers of its files."""
    return df.count()


def parts(rows: int, each: int) -> int:
    """How many parts of about ``each`` rows hold ``rows`` rows."""
    return max(1, -(-rows // each))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def schema_with(df: DataFrame, name: str, kind: str) -> StructType:
    """The schema of ``df`` and one more column."""
    return StructType(list(df.schema.fields)).add(name, DataType.fromDDL(kind))
