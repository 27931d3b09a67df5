"""All queries of the engine by name, and the SQL that checks each."""

from __future__ import annotations

from ledgerloom.operators import chains, complaints, contracts, credit, graph, lookups, marts, models, scores, segments, series, texts, validation  # noqa: F401  each registers its queries
from ledgerloom.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
