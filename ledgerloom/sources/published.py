"""Tables published with a report: checks are measured by the pass that writes, and a reader refuses a table that isn't what its report says."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans.stored import delete, exists, move
from ledgerloom.sources.files import canonical_sha256, schema_sha256

#: The version of reports; a reader takes no other.
VERSION = 1


def content(columns: list[str]) -> dict[str, Column]:
    """Measures that tell whether two tables hold the same rows, in any order: their number, and sum and exclusive or of row hashes."""
    parts = [F.col(f"`{c}`") for c in columns]
    marks = F.xxhash64(*parts, *[p.isNull() for p in parts])  # a null alone doesn't change a hash
    return {"content_rows": F.count("*"), "content_sum": F.sum(marks.cast("decimal(38,0)")), "content_xor": F.bit_xor(marks)}


def observed(rows: DataFrame, measures: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and what is measured of them by the first job that reads all of them."""
    seen = Observation(f"measures-{uuid.uuid4().hex}")
    return rows.observe(seen, *[m.alias(name) for name, m in measures.items()]), seen


def contiguous(name: str, start: int = 1) -> dict[str, Column]:
    """Measures of row numbers; ``is_contiguous`` tells from them whether each number from ``start`` stands once."""
    c = F.col(name).cast("decimal(38,0)")
    return {f"{name}_n": F.count(c), f"{name}_least": F.min(c), f"{name}_most": F.max(c), f"{name}_sum": F.sum(c), f"{name}_squares": F.sum(c * c)}


def is_contiguous(found: Mapping, name: str, start: int = 1) -> bool:
    """Whether count, bounds, sum and sum of squares are those of the numbers from ``start``."""
    n = found[f"{name}_n"]
    if not n:
        return True
    last, sums = start + n - 1, lambda k: k * (k + 1) // 2
    squares = lambda k: k * (k + 1) * (2 * k + 1) // 6
    return (found[f"{name}_least"], found[f"{name}_most"], found[f"{name}_sum"], found[f"{name}_squares"]) == (start, last, sums(last) - sums(start - 1), squares(last) - squares(start - 1))


def publish(
    rows: DataFrame,
    path: str,
    measures: Mapping[str, Column],
    checks: Callable[[dict], dict[str, bool]],
    inputs: Observation | None = None,
    sources: Mapping[str, str] | None = None,
    rejected: str | None = None,
) -> dict:
    """Write a table, and beside it a report of what was measured while it was written; returns the report.

    ``checks`` turns measures (those of ``inputs`` begin with ``input_``) into verdicts. If one isn't true, nothing is published and the
    error names it. Measures are taken right before the write, where each row passes once, even if a task before
    is run again. ``rejected`` names the measure that counts refused rows.
    """
    spark = rows.sparkSession
    part = f"{path}.part-{uuid.uuid4().hex}"
    measured, seen = observed(rows, {**measures, **content(rows.columns)})
    measured.write.parquet(part)
    found = dict(seen.get)
    if inputs is not None:
        found |= {f"input_{k}": v for k, v in inputs.get.items()}
    verdicts = checks(found)
    if failed := sorted(name for name, passed in verdicts.items() if passed is not True):
        delete(spark, part)
        raise ValueError(f"checks failed: {', '.join(failed)}")
    table = spark.read.parquet(part)
    report = {
        "version": VERSION, "scope": "complete", "rejected": int(found[rejected]) if rejected else 0, "checks": verdicts,
        "measures": {k: plain(v) for k, v in found.items() if not k.startswith("content_")}, "sources": dict(sources or {}),
        "schema_sha256": schema_sha256(table), "content_sha256": content_sha256(found),
    }
    # From here on a reader finds no report, and so refuses the table, until the new one is there.
    delete(spark, f"{path}.report")
    delete(spark, path)
    move(spark, part, path)
    text = json.dumps(report, sort_keys=True, allow_nan=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}.report")
    return report


def plain(value: object) -> object:
    """A measure as JSON holds it: numbers that need more than a double as text."""
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def content_sha256(found: Mapping) -> str:
    return canonical_sha256([str(found[k]) for k in ("content_rows", "content_sum", "content_xor")])


def report_of(spark: SparkSession, path: str) -> dict:
    """The report beside a table; a ValueError if there is none."""
    if not exists(spark, f"{path}.report"):
        raise ValueError(f"{path} has no report")
    return json.loads(spark.read.text(f"{path}.report").first()["value"])


def verified(spark: SparkSession, path: str, sources: Mapping[str, str] | None = None, needed: tuple[str, ...] = ()) -> DataFrame:
    """A published table, after its report is found complete, without refusals, with all checks passed, and true of schema and content.

    ``sources`` are digests that the table has to be made from, ``needed`` names checks that the report has to have.
    """
    report = report_of(spark, path)
    if report.get("version") != VERSION or report.get("scope") != "complete":
        raise ValueError("the report is no report of a complete table")
    if report.get("rejected") != 0:
        raise ValueError("the report counts refused rows")
    verdicts = report.get("checks") or {}
    if failed := sorted([k for k, v in verdicts.items() if v is not True] + [k for k in needed if k not in verdicts]) or not verdicts:
        raise ValueError(f"checks not passed: {', '.join(failed) if verdicts or needed else 'there are none'}")
    if wrong := sorted(k for k, v in (sources or {}).items() if str(report["sources"].get(k, "")).lower() != v.lower()):
        raise ValueError(f"made from another source: {', '.join(wrong)}")
    table = spark.read.parquet(path)
    if schema_sha256(table) != report["schema_sha256"]:
        raise ValueError("the schema is not that of the report")
    found = table.agg(*[m.alias(k) for k, m in content(table.columns).items()]).first().asDict()
    if content_sha256(found) != report["content_sha256"]:
        raise ValueError("the rows are not those of the report")
    return table
