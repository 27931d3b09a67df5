"""The transaction tables as a chain of stages that is prepared once and reused after that."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.marts import analytics
from ledgerloom.plans.catalog import query
from ledgerloom.plans.reuse import Stage, prepared
from ledgerloom.plans.stored import shared_root
from ledgerloom.sources.adapters import CUTS, TX, transactions


def rows_of(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping) -> DataFrame:
    return transactions(spark, settings["folder"]).select("step", "type", "amount", "oldbalanceOrg", "nameOrig", "nameDest", "isFraud")


def analytics_of(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping) -> DataFrame:
    return analytics(tables["transactions"], tuple(settings["cuts"]))


def types_of(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping) -> DataFrame:
    return tables["analytics"].groupBy("partition", "type").agg(F.count("*").alias("n"), F.sum("isFraud").cast("long").alias("frauds"))


def accounts_of(spark: SparkSession, tables: Mapping[str, DataFrame], settings: Mapping) -> DataFrame:
    return tables["transactions"].groupBy("nameDest").agg(F.count("*").alias("n"), F.sum("amount").alias("received"))


def stages(sf_dir: str, cuts: tuple[int, int, int] = CUTS) -> list[Stage]:
    """Transactions, the analytical table, totals by partition and type, and received amounts by account."""
    files = tuple(f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "customer"))
    return [
        Stage("transactions", rows_of, files=files, settings={"folder": sf_dir}),
        Stage("analytics", analytics_of, ("transactions",), settings={"cuts": list(cuts)}),
        Stage("types", types_of, ("analytics",)),
        Stage("accounts", accounts_of, ("transactions",)),
    ]


@query(
    "orc02_prepared_chain",
    f"WITH {TX}, p AS (SELECT DISTINCT CASE WHEN step <= {CUTS[0]} THEN 'train' WHEN step <= {CUTS[1]} THEN 'validation' WHEN step <= {CUTS[2]} THEN 'test' ELSE 'stress' END AS part, type FROM tx) SELECT 'transactions' AS stage, (SELECT count(*) FROM tx) AS n, 'built' AS first_run, 'reused' AS second_run, 'reused' AS other_cuts UNION ALL SELECT 'analytics', (SELECT count(*) FROM tx), 'built', 'reused', 'built' UNION ALL SELECT 'types', (SELECT count(*) FROM p), 'built', 'reused', 'built' UNION ALL SELECT 'accounts', (SELECT count(DISTINCT nameDest) FROM tx), 'built', 'reused', 'reused'",
)
def prepared_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each stage, and whether it was built or reused: at first, again, and after the partitions' cuts have changed."""
    root = f"{shared_root(spark)}/chain-{uuid.uuid4().hex}"
    tables, first = prepared(spark, root, stages(sf_dir))
    sizes = {name: t.count() for name, t in tables.items()}
    _, second = prepared(spark, root, stages(sf_dir))
    _, third = prepared(spark, root, stages(sf_dir, (CUTS[0] - 100, *CUTS[1:])))
    return spark.createDataFrame([(s, sizes[s], first[s], second[s], third[s]) for s in sizes], "stage string, n long, first_run string, second_run string, other_cuts string")
