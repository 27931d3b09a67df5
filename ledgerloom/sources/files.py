"""Scans and sinks: string CSV with checked headers, Parquet, reports, digests."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The columns of raw transactions.
TRANSACTION_COLUMNS = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud"]


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file; a Git LFS pointer is no CSV."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    if line.startswith("version https://git-lfs"):
        raise ValueError(f"{path} is a Git LFS pointer, not data")
    return line.lstrip("﻿").split(",")


def string_scan(spark: SparkSession, path: str | list[str], columns: list[str], exact_order: bool = False, superset: bool = False, multiline: bool = False) -> DataFrame:
    """All columns of a CSV as strings, after its header is checked; a plain scan, of which Spark knows the files."""
    header = read_header(spark, path if isinstance(path, str) else path[0])
    right = header == columns if exact_order else set(columns) <= set(header) if superset else sorted(header) == sorted(columns)
    if not right:
        raise ValueError(f"unexpected columns {header}")
    schema = StructType([StructField(c, StringType()) for c in header])
    return spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"', mode="PERMISSIVE", encoding="UTF-8")


def filled(rows: DataFrame) -> DataFrame:
    """Missing fields as empty strings."""
    return rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in rows.columns])


def read_strings(spark: SparkSession, path: str, columns: list[str], exact_order: bool = False, superset: bool = False, multiline: bool = False) -> DataFrame:
    """All columns of a CSV as strings, blanks as empty strings, after its header is checked."""
    return filled(string_scan(spark, path, columns, exact_order, superset, multiline))


def first_rows(rows: DataFrame, ordinal: str, limit: int) -> DataFrame:
    """The first rows of a table in its stored order."""
    return rows.where(F.col(ordinal) <= limit)


def write_parquet(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write exactly the columns of a contract; the committer publishes all files or none."""
    rows.select(*columns).write.mode("overwrite").parquet(path)


def write_json(payload: dict, path: str) -> None:
    """A report file without NaN or infinities, replaced in one step."""
    target = Path(path)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(json.dumps(payload, allow_nan=False, ensure_ascii=False, indent=2, sort_keys=True), encoding="utf-8")
    part.replace(target)


def read_json(path: str) -> dict:
    """A report file; NaN and infinities are refused."""

    def refuse(value: str) -> float:
        raise ValueError(f"{value} is no JSON number")

    return json.loads(Path(path).read_text(encoding="utf-8"), parse_constant=refuse)


def canonical_sha256(value: object) -> str:
    """Digest of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def schema_sha256(rows: DataFrame) -> str:
    return canonical_sha256([{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in rows.schema.fields])


#: Bytes that a task holds of a file while it digests it.
BLOCK = 1 << 20


def file_digests(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """SHA-256 and length of each file under a path, of any size but 0, which Spark doesn't list: files are dealt to tasks, which stream them by blocks.

    Of a store that only Spark reads, files go through Spark's binary source, which holds each one whole and takes up to 2 GB.
    """
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    first = listed.first()
    if first is not None and not opens(first["path"]):
        return spark.read.format("binaryFile").load(path).select(name, "length", F.sha2("content", 256).alias("sha256"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [streamed_sha256(p, block) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])

    return listed.repartition("path").mapInArrow(digest, "path string, length long, sha256 string").select(name, "length", "sha256")


def opens(uri: str) -> bool:
    """Whether tasks can open files of this store without Spark."""
    try:
        located(uri)
        return True
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False


def located(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", quote(uri, safe=":/@")))


def streamed_sha256(uri: str, block: int = BLOCK) -> str:
    """Digest of a file, of which no more than a block is held."""
    system, path = located(uri)
    digest = hashlib.sha256()
    with system.open_input_stream(path) as stream:
        while piece := stream.read(block):
            digest.update(piece)
    return digest.hexdigest()


def stage_order(needs: dict[str, list[str]], selected: list[str]) -> list[str]:
    """Stages in an order that has each after what it needs; cycles and unknown names raise."""
    done: list[str] = []
    open_stages: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name not in needs or name in open_stages:
            raise ValueError(f"unknown or cyclic stage {name}")
        open_stages.add(name)
        for other in needs[name]:
            visit(other)
        open_stages.discard(name)
        done.append(name)

    for name in selected:
        visit(name)
    return done


def finite(value: float | None, name: str) -> float:
    """A finite number that isn't negative."""
    if value is None or not math.isfinite(value) or value < 0:
        raise ValueError(f"{name} must be a finite number of 0 or more")
    return float(value)
