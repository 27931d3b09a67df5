"""Account behaviour: received and sent aggregates, type shares, ranks, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import equal_groups
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import TX, TYPES, transactions

LEAST = 10
GROUPS = 3


def features(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per destination account with enough receipts; type shares are sums in the same aggregate.

    Rows are stored once with what is read of them. Distinct senders and steps are pairs with the account, reduced and
    counted on their own: in one aggregate each row would be exchanged three times, with all its columns.
    """
    rows = stored(rows.select("nameDest", "nameOrig", "step", "amount", "isFraud", "type"), "behaviour-transactions")
    received = rows.groupBy(F.col("nameDest").alias("account")).agg(
        F.count("*").alias("n_received"), F.sum("amount").alias("total"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std"), F.max("amount").alias("largest"),
        F.sum("isFraud").cast("long").alias("frauds"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in sorted(TYPES)],
    ).where(F.col("n_received") >= least)
    sent = rows.groupBy(F.col("nameOrig").alias("account")).agg(F.count("*").alias("n_sent"), F.sum("amount").alias("total_sent"))
    for column, out in (("nameOrig", "senders"), ("step", "active_steps")):
        each = rows.select(F.col("nameDest").alias("to"), column).distinct().groupBy("to").agg(F.count(column).alias(out))
        received = received.join(each, F.col("account").eqNullSafe(F.col("to"))).drop("to")
    joined = received.join(sent, "account", "left").fillna(0, ["n_sent", "total_sent"])
    n = F.col("n_received")
    return joined.select(
        "account", "n_received", F.round("total", 2).alias("total_received"), F.round("mean", 4).alias("mean_received"),
        F.round(C.ratio_or_zero(F.coalesce("std", F.lit(0.0)), F.col("mean")), 6).alias("cv"),
        F.round(C.ratio_or_zero(F.col("largest"), F.col("total")), 9).alias("amount_concentration"),
        F.round(1 - F.col("senders") / n, 9).alias("sender_concentration"),
        F.round(F.when(F.col("active_steps") > 0, n / F.col("active_steps")).otherwise(1.0), 6).alias("activity_density"),
        F.round(F.col("frauds") / n, 9).alias("fraud_rate"), "n_sent", F.round(F.col("total") - F.col("total_sent"), 2).alias("net_flow"),
        *[F.round(F.col(f"n_{t}") / n, 9).alias(f"share_{t.lower()}") for t in sorted(TYPES)],
    )


FEATURES = f"""{TX}, r AS (SELECT nameDest AS account, count(*) AS n, sum(amount) AS total, avg(amount) AS mean, stddev_samp(amount) AS std, max(amount) AS largest, count(DISTINCT nameOrig) AS senders, count(DISTINCT step) AS active_steps, sum(isFraud) AS frauds, {", ".join(f"count(*) FILTER (WHERE type = '{t}') AS n_{t}" for t in sorted(TYPES))} FROM tx GROUP BY 1 HAVING count(*) >= {LEAST}),
s AS (SELECT nameOrig AS account, count(*) AS n_sent, sum(amount) AS total_sent FROM tx GROUP BY 1),
f AS (SELECT r.account, n AS n_received, round(total, 2) AS total_received, round(mean, 4) AS mean_received, round(CASE WHEN mean > 0 THEN coalesce(std, 0) / mean ELSE 0 END, 6) AS cv, round(largest / total, 9) AS amount_concentration, round(1 - senders / n, 9) AS sender_concentration, round(n / active_steps, 6) AS activity_density, round(frauds / n, 9) AS fraud_rate, coalesce(n_sent, 0) AS n_sent, round(total - coalesce(total_sent, 0), 2) AS net_flow, {", ".join(f"round(n_{t} / n, 9) AS share_{t.lower()}" for t in sorted(TYPES))} FROM r LEFT JOIN s ON r.account = s.account)"""


@query("agg14_agg15_jn01_features", f"WITH {FEATURES} SELECT * FROM f")
def account_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(transactions(spark, sf_dir))


def quantile_segments(found: DataFrame, column: str = "n_received", groups: int = GROUPS) -> DataFrame:
    """Groups of equal frequency by rank of activity, ties by account."""
    if groups < 1:
        raise ValueError("there has to be a group")
    return equal_groups(found, [column, "account"], groups, "segment")


SEGMENTED = f"{FEATURES}, g AS (SELECT *, CAST(greatest(0, ceil((row_number() OVER (ORDER BY n_received, account) - 1) * {GROUPS} / greatest(count(*) OVER () - 1, 1)) - 1) AS BIGINT) AS segment FROM f)"


@query("ml12_win07_agg30_segments", f"WITH {SEGMENTED} SELECT segment, count(*) AS accounts, round(avg(n_received), 6) AS mean_n, round(avg(total_received), 2) AS mean_total, round(avg(fraud_rate), 9) AS mean_fraud_rate, min(total_received) AS least, max(total_received) AS most FROM g GROUP BY segment")
def segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantile_segments(features(transactions(spark, sf_dir)))
    return rows.groupBy("segment").agg(F.count("*").alias("accounts"), F.round(F.avg("n_received"), 6).alias("mean_n"), F.round(F.avg("total_received"), 2).alias("mean_total"), F.round(F.avg("fraud_rate"), 9).alias("mean_fraud_rate"), F.min("total_received").alias("least"), F.max("total_received").alias("most"))


@query("ord05_segment_page", f"WITH {SEGMENTED} SELECT account, n_received, total_received FROM g WHERE segment = 1 ORDER BY n_received DESC, account DESC LIMIT 20 OFFSET 5")
def segment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a segment's accounts by activity: the limit is the feature."""
    rows = quantile_segments(features(transactions(spark, sf_dir))).where("segment = 1")
    return rows.orderBy(F.desc("n_received"), F.desc("account")).offset(5).limit(20).select("account", "n_received", "total_received")
