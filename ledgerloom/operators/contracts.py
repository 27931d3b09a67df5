"""Contracts: settings are checked in the driver, rows by one aggregate that stops the job instead of dropping rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.sources.adapters import CUTS, TX, TYPES, events_by_hour, transactions

#: The limits that a drift run has to name.
THRESHOLDS = {"transaction_count_relative_change", "total_amount_relative_change", "average_amount_relative_change", "amount_distribution_tvd", "type_mix_tvd", "fraud_rate_absolute_change"}


def valid_cuts(cuts: Sequence[int], last: int) -> tuple[int, ...]:
    """Last steps of the partitions: whole, rising, above 0, below the last step."""
    values = (*cuts, last)
    if any(isinstance(c, bool) or not isinstance(c, int) for c in values) or any(a >= b for a, b in zip((0, *values), values, strict=False)):
        raise ValueError("cuts have to be whole numbers that rise from above 0 to below the last step")
    return values


def valid_quantiles(asked: Sequence[float]) -> tuple[float, ...]:
    values = tuple(float(q) for q in asked)
    if not values or any(not 0 < q < 1 for q in values) or any(a >= b for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("quantiles have to rise strictly between 0 and 1")
    return values


def valid_budgets(asked: Sequence[int] | None) -> list[int]:
    """Budgets in the order given, each once."""
    if asked is None or isinstance(asked, str | bytes) or not len(asked) or any(isinstance(k, bool) or not isinstance(k, int) or k < 1 for k in asked):
        raise ValueError("budgets have to be positive whole numbers")
    return list(dict.fromkeys(asked))


def valid_comparison(settings: Mapping | None) -> dict:
    """The settings of a comparison: a row limit, budgets, percentiles between 0 and 100."""
    raw = (settings or {}).get("comparison")
    if not isinstance(raw, Mapping):
        raise ValueError("there are no settings of the comparison")
    limit = raw.get("default_sample_limit")
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError("default_sample_limit has to be a positive whole number")
    found = {"default_sample_limit": limit, "budgets": valid_budgets(raw.get("budgets"))}
    for name in ("fanout_percentile", "fanin_percentile", "flow_percentile"):
        value = raw.get(name)
        if isinstance(value, bool) or not isinstance(value, int | float) or not 0 < value < 100:
            raise ValueError(f"{name} has to lie between 0 and 100")
        found[name] = float(value)
    return found


def valid_period(settings: Mapping, name: str) -> tuple[int, int]:
    try:
        first, last = int(settings[name]["start_step"]), int(settings[name]["end_step"])
    except (KeyError, TypeError, ValueError) as error:
        raise ValueError(f"{name} needs a first and a last step") from error
    if not 1 <= first <= last:
        raise ValueError(f"{name} has to be a span of steps from 1")
    return first, last


def valid_thresholds(settings: Mapping) -> dict[str, float]:
    """Exactly the limits of the contract, finite and not below 0."""
    raw = settings.get("thresholds")
    if not isinstance(raw, Mapping) or set(raw) != THRESHOLDS:
        raise ValueError("the thresholds are not those of the contract")
    try:
        found = {k: float(v) for k, v in raw.items()}
    except (TypeError, ValueError) as error:
        raise ValueError("thresholds have to be numbers") from error
    if any(not math.isfinite(v) or v < 0 for v in found.values()):
        raise ValueError("thresholds have to be finite and not below 0")
    return found


def same_hash(a: str, b: str) -> bool:
    """Whether two hexadecimal digests are equal, in either case."""
    return a.strip().lower() == b.strip().lower()


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows break each rule: (rule, n). A test that is null is broken."""
    broken = {name: F.count_if(~F.coalesce(ok, F.lit(False))) for name, ok in checks.items()}
    listed = F.array(*[F.struct(F.lit(name).alias("rule"), n.alias("n")) for name, n in broken.items()])
    return rows.agg(listed.alias("r")).select(F.inline("r"))


def asserted(rows: DataFrame, checks: dict[str, Column], needed: Sequence[str] = (), empty: bool = True) -> DataFrame:
    """The same rows, if they have the columns needed and none breaks a rule; else a ValueError that names the rules."""
    if missing := sorted(set(needed) - set(rows.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if not empty and rows.isEmpty():
        raise ValueError("there are no rows")
    if broken := {r["rule"]: r["n"] for r in violations(rows, checks).collect() if r["n"]}:
        raise ValueError("; ".join(f"{rule}: {n} rows" for rule, n in broken.items()))
    return rows


def finite(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < math.inf)


def monitoring_rules() -> dict[str, Column]:
    """What drift needs of transactions."""
    return {
        "step is whole": finite("step") & (F.floor(F.col("step").try_cast("double")) == F.col("step").try_cast("double")),
        "amount is not below 0": finite("amount") & (F.col("amount").try_cast("double") >= 0),
        "isFraud is 0 or 1": F.col("isFraud").try_cast("double").isin(0.0, 1.0),
        "type is not blank": ~C.blank(F.col("type").cast("string")),
    }


def analytics_rules(last: int, first: int = 1) -> dict[str, Column]:
    """What the analytical table needs: steps in range, known types, amounts and balances not below 0, labels."""
    step = F.col("step").try_cast("double")
    rules = {f"step is whole and from {first} to {last}": finite("step") & (step % 1 == 0) & step.between(first, last), "type is known": F.col("type").isin(TYPES)}
    rules |= {f"{c} is not below 0": finite(c) & (F.col(c).try_cast("double") >= 0) for c in ("amount", "oldbalanceOrg")}
    return rules | {"isFraud is 0 or 1": F.col("isFraud").try_cast("double").isin(0.0, 1.0)}


def same_universe(left: DataFrame, right: DataFrame, column: str) -> None:
    """Raise unless both tables have the same values in a column; the differences are counted by one full join of the distinct values."""
    a, b = (x.select(F.col(column).alias("k")).distinct().withColumn(side, F.lit(1)) for x, side in ((left, "l"), (right, "r")))
    seen = a.join(b, "k", "full").agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right")).first()
    if seen["only_left"] or seen["only_right"]:
        raise ValueError(f"{column}: {seen['only_left']} values only in the first table, {seen['only_right']} only in the second")


@query(
    "prj16_analytics_contract",
    f"WITH {TX}, v AS (SELECT 'step is whole and from 1 to {CUTS[1]}' AS rule, count(*) FILTER (WHERE NOT step BETWEEN 1 AND {CUTS[1]}) AS n FROM tx UNION ALL SELECT 'type is known', count(*) FILTER (WHERE type NOT IN ({', '.join(repr(t) for t in TYPES)})) FROM tx UNION ALL SELECT 'amount is not below 0', count(*) FILTER (WHERE amount < 0) FROM tx UNION ALL SELECT 'oldbalanceOrg is not below 0', count(*) FILTER (WHERE oldbalanceOrg < 0) FROM tx UNION ALL SELECT 'isFraud is 0 or 1', count(*) FILTER (WHERE isFraud NOT IN (0, 1)) FROM tx) SELECT * FROM v",
)
def analytics_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break each rule, steps held to the first two partitions, so that some do."""
    return violations(transactions(spark, sf_dir), analytics_rules(CUTS[1]))


@query("val02_monitoring_contract", "SELECT rule, n FROM (SELECT unnest(['step is whole', 'amount is not below 0', 'isFraud is 0 or 1', 'type is not blank']) AS rule, unnest([0, (SELECT count(*) FROM events WHERE value - 20 < 0 OR value IS NULL), 0, 0])::BIGINT AS n) t")
def monitoring_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events less 20 held to the rules of drift: small ones break one."""
    return violations(events_by_hour(spark, sf_dir).withColumn("amount", F.col("amount") - 20), monitoring_rules())
