"""Typed scans: credit, edges, training rows; rows with too many fields; rows in file order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.functions import columns as C
from ledgerloom.operators.contracts import asserted, finite
from ledgerloom.operators.credit import RAW_COLUMNS
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import TYPES
from ledgerloom.sources.files import TRANSACTION_COLUMNS, filled, read_header, read_strings, string_scan
from ledgerloom.sources.order import files_of, first_rows_of, with_file_order

EDGE_COLUMNS = ["step", "type", "amount", "nameOrig", "nameDest", "isFraud"]
WHOLE = {"person_age", "loan_status", "cb_person_cred_hist_length"}
WORDS = {"person_home_ownership", "loan_intent", "loan_grade", "cb_person_default_on_file"}


def read_credit(spark: SparkSession, path: str) -> DataFrame:
    """Applications with their types, after the header is found to be exactly the contract's; what isn't a number is null."""
    rows = read_strings(spark, path, RAW_COLUMNS, exact_order=True)
    typed = {c: C.filled(F.col(c)) if c in WORDS else F.col(c).try_cast("int" if c in WHOLE else "double") for c in RAW_COLUMNS}
    return rows.select(*[x.alias(c) for c, x in typed.items()])


def read_edges(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The six columns of an edge, typed; any row that breaks a rule stops the scan. A limit takes the first rows in file order, reads no more blocks than those need, and checks only these rows."""
    if limit is not None and limit < 1:
        raise ValueError("the limit has to be a positive whole number")
    scan = lambda paths: string_scan(spark, paths, TRANSACTION_COLUMNS).select(*EDGE_COLUMNS)
    rows = filled(scan(path) if limit is None else first_rows_of(scan, files_of(spark.read.text(path)), limit).drop("row_id"))
    rules = {
        "step is whole": finite("step") & (F.col("step").try_cast("double") % 1 == 0), "type is known": F.col("type").isin(TYPES), "amount is not below 0": finite("amount") & (F.col("amount").try_cast("double") >= 0),
        "accounts are named": ~C.blank(F.col("nameOrig")) & ~C.blank(F.col("nameDest")), "isFraud is 0 or 1": F.col("isFraud").try_cast("double").isin(0.0, 1.0),
    }
    asserted(rows, rules, empty=False)
    return rows.select(F.col("step").cast("double").cast("long").alias("step"), "type", F.col("amount").cast("double").alias("amount"), "nameOrig", "nameDest", F.col("isFraud").cast("double").cast("tinyint").alias("isFraud"))


def read_numbered(spark: SparkSession, path: str, columns: list[str], start: int = 1, limit: int | None = None) -> DataFrame:
    """All columns of CSV files as strings, and ``row_id``, the number of each row in file order; a limit takes the first rows and reads no block that they don't need."""
    scan = lambda paths: string_scan(spark, paths, columns)
    found = with_file_order(scan(path), start=start) if limit is None else first_rows_of(scan, files_of(spark.read.text(path)), limit, start=start)
    return found.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in found.columns if c != "row_id"], "row_id")


TRAINING = {"step": "long", "type": "string", "amount": "double", "nameOrig": "string", "oldbalanceOrg": "double", "nameDest": "string", "isFraud": "tinyint"}


def read_training(spark: SparkSession, path: str, train_end: int, validation_end: int, kind: str = "csv") -> DataFrame:
    """Training rows from raw CSV or from Parquet with one schema, and their partition by step."""
    if kind not in ("csv", "parquet"):
        raise ValueError("rows are read from csv or parquet")
    rows = read_strings(spark, path, TRANSACTION_COLUMNS) if kind == "csv" else spark.read.parquet(path)
    typed = rows.select(*[(F.col(c) if t == "string" else F.col(c).cast("double").cast(t)).alias(c) for c, t in TRAINING.items()])
    return typed.withColumn("partition", F.when(F.col("step") <= train_end, "train").when(F.col("step") <= validation_end, "validation").otherwise("test"))


def read_records(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Rows of a CSV as strings and ``issues``: extra_columns where a row has more fields than the header, missing_columns where fewer.

    Quoted commas and line breaks belong to their field, and only the first line of a file is its header. A file is read by one
    task, since only a reader from its start knows which line breaks are quoted. Without ``multiline`` files are split;
    lines whose quotes don't close are refused by a pass before.
    """
    header = read_header(spark, path)
    if not multiline:
        quotes = F.length(F.regexp_replace("value", '[^"]', ""))
        asserted(spark.read.text(path), {"quotes close on their line": quotes % 2 == 0})
    names = [f"_{i}" for i in range(len(header) + 1)]
    schema = StructType([StructField(c, StringType()) for c in names])
    parsed = spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"', nullValue="\u0000", emptyValue="", mode="PERMISSIVE")
    issues = F.array_compact(F.array(F.when(F.col(names[-1]).isNotNull(), F.lit("extra_columns")), F.when(F.col(names[-2]).isNull(), F.lit("missing_columns"))))
    return parsed.select(*[F.col(n).alias(c) for n, c in zip(names, header, strict=False)], issues.alias("issues"))


def plain_json(rows: DataFrame, out: str = "json") -> DataFrame:
    """One JSON text a row; NaN and infinities are null, and nulls are written."""
    fields = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        fields.append((F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c) if kind in ("double", "float") else c).alias(name))
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))


def encode_json(value: object) -> str:
    """JSON of a driver-side value, NaN and infinities as null."""

    def plain(x: object) -> object:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [plain(v) for v in x]
        return None if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))) else x

    return json.dumps(plain(value), allow_nan=False, ensure_ascii=False)
