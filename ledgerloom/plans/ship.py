"""Hand the package to executors that don't have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once; Spark passes them on to each executor."""
    context = spark.sparkContext
    if getattr(context, "_ledgerloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="ledgerloom-")) / "ledgerloom_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for source in sorted((ROOT / "ledgerloom").rglob("*.py")):
            file.write(source, source.relative_to(ROOT))
    context.addPyFile(str(archive.resolve()))
    context._ledgerloom_shipped = True
