"""Chains of stages whose tables are kept under a signature of all that they depend on, and built anew only if one of these changes."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.files import canonical_sha256, stage_order
from ledgerloom.sources.published import publish, report_of, verified

#: The version of signatures; raising it makes all tables be built anew.
VERSION = 1


@dataclass(frozen=True)
class Stage:
    """A table and how it is made: a function of (spark, tables by name, settings), the stages and files it reads, and what has to hold of its rows."""

    name: str
    make: Callable[[SparkSession, Mapping[str, DataFrame], Mapping], DataFrame]
    needs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    settings: Mapping = field(default_factory=dict)
    checks: Mapping[str, Callable[[Mapping], bool]] = field(default_factory=dict)

    def recipe(self) -> str:
        """Digest of the function's source and of the checks' names."""
        return canonical_sha256([inspect.getsource(self.make), sorted(self.checks)])


def files_signature(spark: SparkSession, path: str) -> str:
    """Digest of the names, lengths and times of change of all files under a path; none of them is opened."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("double").alias("at"))
    mark = F.xxhash64("path", "length", "at")
    found = files.agg(F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("sum"), F.bit_xor(mark).alias("xor")).first()
    return canonical_sha256([found["n"], str(found["sum"]), str(found["xor"])])


def signatures(spark: SparkSession, stages: Mapping[str, Stage], order: Sequence[str]) -> dict[str, str]:
    """The signature of each stage: its recipe, settings, files, and the signatures of the stages that it reads."""
    of_files = {path: files_signature(spark, path) for path in sorted({p for name in order for p in stages[name].files})}
    found: dict[str, str] = {}
    for name in order:
        stage = stages[name]
        found[name] = canonical_sha256({"version": VERSION, "name": name, "recipe": stage.recipe(), "settings": dict(stage.settings), "files": {p: of_files[p] for p in stage.files}, "needs": {n: found[n] for n in stage.needs}})
    return found


def is_current(spark: SparkSession, path: str, signature: str) -> bool:
    """Whether a table stands there that was published under the signature and still is what its report says."""
    try:
        if report_of(spark, path)["sources"].get("signature") != signature:
            return False
        verified(spark, path)
        return True
    except (ValueError, KeyError):
        return False


def prepared(spark: SparkSession, root: str, stages: Sequence[Stage], asked: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables of the stages asked for, and of all that they need, under ``root``; and by stage whether it was built or reused.

    A stage whose signature has changed, or whose table doesn't match its report any more, is built and published with its
    checks; so are those that read it. Unknown and cyclic needs raise an error.
    """
    by_name = {s.name: s for s in stages}
    order = stage_order({s.name: list(s.needs) for s in stages}, list(asked or by_name))
    wanted, tables, status = signatures(spark, by_name, order), {}, {}
    for name in order:
        stage, path = by_name[name], f"{root}/{name}"
        if is_current(spark, path, wanted[name]):
            status[name] = "reused"
        else:
            rows = stage.make(spark, {n: tables[n] for n in stage.needs}, stage.settings)
            checks = {"has_rows": lambda found: found["content_rows"] > 0, **stage.checks}
            publish(rows, path, {"rows": F.count("*")}, lambda found, c=checks: {k: bool(test(found)) for k, test in c.items()}, sources={"signature": wanted[name]})
            status[name] = "built"
        tables[name] = spark.read.parquet(path)
    return tables, status
