"""Views of the benchmark tables in the shapes that the operators take, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The closed vocabulary of transaction types.
TYPES = ["PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CASH_IN"]
#: Last steps of the train, validation and test partitions; later ones are stress.
CUTS = (1000, 1250, 2300)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions: step, type, amount, oldbalanceOrg, nameOrig, nameDest, isFraud, and their keys."""
    lines, orders, customers = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    # Orders meet their customers first: line items, which are most rows, are exchanged once and what they are joined to is narrow.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(placed, lines["l_orderkey"] == F.col("o_orderkey"))
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), F.substring("o_orderpriority", 1, 1).cast("int"))
    equal = (F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")
    return joined.select(
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long").alias("step"),
        kind.alias("type"),
        F.col("l_extendedprice").alias("amount"),
        F.when(equal, F.col("l_extendedprice")).otherwise(F.greatest(F.col("c_acctbal"), F.lit(0.0))).alias("oldbalanceOrg"),
        F.concat(F.lit("C"), F.col("o_custkey")).alias("nameOrig"),
        F.concat(F.when(F.col("l_suppkey") % 2 == 1, "M").otherwise("C"), F.col("l_suppkey")).alias("nameDest"),
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).cast("int").alias("isFraud"),
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        "l_discount",
        "l_tax",
        "l_quantity",
        "l_returnflag",
    )


TX = """tx AS (SELECT date_diff('day', DATE '1995-01-01', l_shipdate::DATE) AS step,
  ['PAYMENT','TRANSFER','CASH_OUT','DEBIT','CASH_IN'][substr(o_orderpriority, 1, 1)::INT] AS type,
  l_extendedprice AS amount,
  CASE WHEN l_linenumber = 1 AND l_returnflag = 'R' THEN l_extendedprice ELSE greatest(c_acctbal, 0.0) END AS oldbalanceOrg,
  'C' || o_custkey AS nameOrig, (CASE WHEN l_suppkey % 2 = 1 THEN 'M' ELSE 'C' END) || l_suppkey AS nameDest,
  (l_returnflag = 'R' AND l_linestatus = 'F')::INT AS isFraud, l_orderkey, l_partkey, l_linenumber, l_discount, l_tax, l_quantity, l_returnflag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def events_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as operations: step is the hour from 1, errors are frauds."""
    seconds = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    rows = table(spark, sf_dir, "events").select((F.floor(seconds / 3600) + 1).cast("long").alias("step"), F.col("event_type").alias("type"), F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("isFraud"))
    return rows


EV = """ev AS (SELECT CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 3600) AS BIGINT) + 1 AS step,
  event_type AS type, value AS amount, (event_type = 'error')::INT AS isFraud FROM events)"""
