"""Marts: hourly gold, per-type and per-step totals, transaction mart, D1 with partitions and bins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles
from ledgerloom.plans.stored import shared_root, stored
from ledgerloom.sources.adapters import CUTS, EV, TX, events_by_hour, table, transactions
from ledgerloom.sources.published import observed, publish, verified

#: Quantiles of the silver report and of the bins.
QUANTILES = [0.25, 0.5, 0.75, 0.95, 0.99, 0.999]
TERCILES = [1 / 3, 2 / 3]


def hourly(rows: DataFrame) -> DataFrame:
    """Count, total, mean and frauds for each step between the first and the last, gaps as zeros."""
    sums = rows.groupBy("step").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.sum("isFraud").cast("long").alias("frauds"))
    bounds = rows.agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null")
    steps = bounds.select(F.explode(F.sequence("a", "b")).alias("step"))
    filled = steps.join(sums, "step", "left").fillna(0, ["n", "total", "frauds"])
    return filled.select(
        "step",
        F.col("n").alias("transaction_count"),
        F.round("total", 2).alias("total_amount"),
        F.round(C.ratio_or_zero(F.col("total"), F.col("n")), 6).alias("average_amount"),
        F.col("frauds").alias("fraud_count"),
        F.round(C.ratio_or_zero(F.col("frauds"), F.col("n")), 9).alias("fraud_rate"),
    )


HOURLY = """sums AS (SELECT step, count(*) AS n, sum(amount) AS total, CAST(sum(isFraud) AS BIGINT) AS frauds FROM ev GROUP BY step),
steps AS (SELECT unnest(generate_series((SELECT min(step) FROM ev), (SELECT max(step) FROM ev))) AS step),
gold AS (SELECT steps.step, coalesce(n, 0) AS transaction_count, round(coalesce(total, 0.0), 2) AS total_amount,
  round(CASE WHEN n > 0 THEN total / n ELSE 0.0 END, 6) AS average_amount, coalesce(frauds, 0) AS fraud_count,
  round(CASE WHEN n > 0 THEN frauds::DOUBLE / n ELSE 0.0 END, 9) AS fraud_rate FROM steps LEFT JOIN sums ON steps.step = sums.step)"""


@query("agg03_hourly_gold", f"WITH {EV}, {HOURLY} SELECT * FROM gold")
def hourly_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly(events_by_hour(spark, sf_dir))


@query("jn02_gap_fill_errors", f"WITH {EV.replace('FROM events)', 'FROM events WHERE value > 60)')}, {HOURLY} SELECT * FROM gold")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of large events only, so that many hours have none."""
    return hourly(events_by_hour(spark, sf_dir).where("amount > 60"))


@query("agg01_by_type", f"WITH {TX} SELECT type, count(*) AS transactions, round(sum(amount), 2) AS total_amount, CAST(sum(isFraud) AS BIGINT) AS frauds FROM tx GROUP BY type")
def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("type").agg(F.count("*").alias("transactions"), F.round(F.sum("amount"), 2).alias("total_amount"), F.sum("isFraud").cast("long").alias("frauds"))


@query("agg02_by_step", f"WITH {TX} SELECT step, count(*) AS transactions, CAST(sum(isFraud) AS BIGINT) AS frauds FROM tx GROUP BY step")
def by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).groupBy("step").agg(F.count("*").alias("transactions"), F.sum("isFraud").cast("long").alias("frauds"))


@query(
    "agg04_amount_summary",
    f"WITH {TX}, q AS (SELECT min(amount) AS least, max(amount) AS most, avg(amount) AS mean, quantile_cont(amount, {QUANTILES}) AS v FROM tx) SELECT least, most, round(mean, 4) AS mean, "
    + ", ".join(f"round(v[{i + 1}], 6) AS p{str(q * 100).replace('.', '_')}" for i, q in enumerate(QUANTILES))
    + " FROM q",
)
def amount_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(transactions(spark, sf_dir).select("amount"), "amounts")
    found = quantiles(rows, "amount", QUANTILES)[None]
    q = rows.agg(F.min("amount").alias("least"), F.max("amount").alias("most"), F.round(F.avg("amount"), 4).alias("mean"))
    return q.select("least", "most", "mean", *[F.round(F.lit(v).cast("double"), 6).alias(f"p{str(x * 100).replace('.', '_')}") for v, x in zip(found, QUANTILES, strict=True)])


#: The transactions with every seventh order's lines once more, so that whole rows repeat.
TWICE = f"{TX}, twice AS (SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE l_orderkey % 7 = 0)"
COLUMNS = "step, type, amount, oldbalanceOrg, nameOrig, nameDest, isFraud, l_orderkey, l_partkey, l_linenumber, l_discount, l_tax, l_quantity, l_returnflag"


def duplicates(rows: DataFrame) -> DataFrame:
    """How many rows repeat an equal one, in all columns, and how many are distinct; copies of a row are counted on the map side."""
    groups = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"), F.count("*").alias("distinct_rows"))


@query("agg05_exact_duplicates", f"WITH {TWICE} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, count(*) AS distinct_rows FROM (SELECT count(*) AS n FROM twice GROUP BY {COLUMNS}) g")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir)
    return duplicates(rows.union(rows.where("l_orderkey % 7 = 0")))


@query("agg06_set01_accounts", f"WITH {TX} SELECT count(DISTINCT nameOrig) AS origins, count(DISTINCT nameDest) AS destinations, (SELECT count(*) FROM (SELECT nameOrig FROM tx UNION SELECT nameDest FROM tx)) AS accounts FROM tx")
def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account names are reduced to one row each before they are counted."""
    ends = F.array(F.struct(F.col("nameOrig").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("d")), F.struct(F.col("nameDest").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("d")))
    names = transactions(spark, sf_dir).select(F.inline(ends)).groupBy("name").agg(F.max("o").alias("o"), F.max("d").alias("d"))
    return names.agg(F.sum("o").cast("long").alias("origins"), F.sum("d").cast("long").alias("destinations"), F.count("*").alias("accounts"))


MART = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "nameDest", "isFraud", "amount_balance_ratio", "exceeds_origin_balance", "origin_balance_delta", "destination_balance_delta"]


@query(
    "prj07_prj08_gold_mart",
    f"WITH {TX} SELECT l_orderkey, l_linenumber, step, type, amount, nameOrig, oldbalanceOrg, nameDest, isFraud, round(amount / (oldbalanceOrg + 1), 9) AS amount_balance_ratio, (amount > oldbalanceOrg)::INT AS exceeds_origin_balance, "
    "round(l_quantity - (oldbalanceOrg - amount), 4) AS origin_balance_delta, round(l_tax - (l_discount + amount), 4) AS destination_balance_delta FROM tx",
)
def gold_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictors and balance residuals; quantity, discount and tax stand for the balances after and before."""
    rows = transactions(spark, sf_dir)
    return rows.select(
        "l_orderkey", "l_linenumber", "step", "type", "amount", "nameOrig", "oldbalanceOrg", "nameDest", "isFraud",
        F.round(F.col("amount") / (F.col("oldbalanceOrg") + 1), 9).alias("amount_balance_ratio"),
        (F.col("amount") > F.col("oldbalanceOrg")).cast("int").alias("exceeds_origin_balance"),
        F.round(F.col("l_quantity") - (F.col("oldbalanceOrg") - F.col("amount")), 4).alias("origin_balance_delta"),
        F.round(F.col("l_tax") - (F.col("l_discount") + F.col("amount")), 4).alias("destination_balance_delta"),
    )


def fitted_edges(rows: DataFrame, column: str, asked: list[float] = TERCILES) -> list[float]:
    """The quantiles of a column that lie inside its range, each once."""
    least, *found, most = quantiles(rows, column, [0.0, *asked, 1.0])[None]
    return sorted({q for q in found if q is not None and least < q < most})


def fitted_bins(rows: DataFrame, cuts: tuple[int, int, int] = CUTS) -> dict[str, Column]:
    """Columns of partition and bins; bins are fitted on the train partition alone, labels play no part."""
    train = stored(rows.where(F.col("step") <= cuts[0]).select("amount", "oldbalanceOrg"), "train-values")
    bins = {}
    for name, column in (("amount_bin", "amount"), ("origin_balance_bin", "oldbalanceOrg")):
        edges = fitted_edges(train, column)
        below = [F.when(F.col(column) > e, 1).otherwise(0) for e in edges]
        bins[name] = F.concat(F.lit("b"), sum(below[1:], below[0]).cast("string") if below else F.lit("0"))
    return {"partition": C.partition_of(F.col("step"), cuts), **bins}


def analytics(rows: DataFrame, cuts: tuple[int, int, int] = CUTS) -> DataFrame:
    """Rows with partition and bins."""
    return rows.withColumns(fitted_bins(rows, cuts))


def _edges_sql(column: str) -> str:
    return f"""(SELECT list_distinct(list_filter(quantile_cont({column}, [{TERCILES[0]!r}, {TERCILES[1]!r}]), lambda e: e > min({column}) AND e < max({column}))) FROM tx WHERE step <= {CUTS[0]})"""


PARTITION = f"CASE WHEN step <= {CUTS[0]} THEN 'train' WHEN step <= {CUTS[1]} THEN 'validation' WHEN step <= {CUTS[2]} THEN 'test' ELSE 'stress' END"
D1 = f"""{TX}, qa AS (SELECT quantile_cont(amount, [{TERCILES[0]!r}, {TERCILES[1]!r}]) AS q, min(amount) AS a, max(amount) AS b, quantile_cont(oldbalanceOrg, [{TERCILES[0]!r}, {TERCILES[1]!r}]) AS q2, min(oldbalanceOrg) AS a2, max(oldbalanceOrg) AS b2 FROM tx WHERE step <= {CUTS[0]}),
qe AS (SELECT list_distinct(list_filter(q, lambda e: e > a AND e < b)) AS ea, list_distinct(list_filter(q2, lambda e: e > a2 AND e < b2)) AS eb FROM qa),
d1 AS (SELECT tx.*, {PARTITION} AS part, 'b' || len(list_filter(ea, lambda e: e < amount)) AS amount_bin, 'b' || len(list_filter(eb, lambda e: e < oldbalanceOrg)) AS origin_balance_bin FROM tx, qe)"""


@query("ml02_d1_rows", f"WITH {D1} SELECT l_orderkey, l_linenumber, step, type, amount, oldbalanceOrg, isFraud, part AS partition_name, amount_bin, origin_balance_bin FROM d1")
def d1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics(transactions(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "step", "type", "amount", "oldbalanceOrg", "isFraud", F.col("partition").alias("partition_name"), "amount_bin", "origin_balance_bin")


@query("hlp02_partition_summary", f"WITH {D1} SELECT part AS partition_name, count(*) AS n, min(step) AS first_step, max(step) AS last_step, CAST(sum(isFraud) AS BIGINT) AS frauds, count(DISTINCT amount_bin) AS bins FROM d1 GROUP BY part")
def partition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = analytics(transactions(spark, sf_dir))
    bins = F.size(F.collect_set("amount_bin")).cast("long")
    return rows.groupBy(F.col("partition").alias("partition_name")).agg(F.count("*").alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.sum("isFraud").cast("long").alias("frauds"), bins.alias("bins"))


def median_guess(train: DataFrame, known: str = "true") -> Column:
    """The median amount of a row's type among the train rows that a condition admits, of all train rows for other types."""
    train = stored(train.select("type", "amount"), "train-amounts")
    medians = quantiles(train.where(known), "amount", [0.5], "type")
    whole = F.lit(quantiles(train, "amount", [0.5])[None][0])
    guess = whole
    for kind, (m,) in medians.items():
        guess = F.when(F.col("type") == kind, F.lit(m)).otherwise(guess)
    return guess


@query("jn06_agg29_median_by_type", f"WITH {TX}, m AS (SELECT type, median(amount) AS m FROM tx WHERE step <= {CUTS[0]} AND type <> 'DEBIT' GROUP BY type), g AS (SELECT median(amount) AS g FROM tx WHERE step <= {CUTS[0]}) SELECT tx.type, count(*) AS n, round(any_value(coalesce(m, g)), 6) AS prediction, round(avg(abs(amount - coalesce(m, g))), 4) AS mae FROM tx LEFT JOIN m ON tx.type = m.type, g WHERE step > {CUTS[0]} GROUP BY tx.type")
def median_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the train rows of a type, of all train rows where a type has none (DEBIT is left out of the fit)."""
    rows = transactions(spark, sf_dir)
    guess = median_guess(rows.where(F.col("step") <= CUTS[0]), "type <> 'DEBIT'")
    return rows.where(F.col("step") > CUTS[0]).groupBy("type").agg(F.count("*").alias("n"), F.round(F.first(guess), 6).alias("prediction"), F.round(F.avg(F.abs(F.col("amount") - guess)), 4).alias("mae"))


@query("agg37_split_steps", f"WITH {TX}, s AS (SELECT step, count(*) AS n FROM tx GROUP BY step), c AS (SELECT step, sum(n) OVER (ORDER BY step) AS c, sum(n) OVER () AS t FROM s) SELECT min(step) FILTER (WHERE c >= 0.70 * t) AS train_end, min(step) FILTER (WHERE c >= 0.85 * t) AS validation_end FROM c")
def split_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last steps of 70 and 85 % of rows, whole steps; the window runs over one row per step."""
    from pyspark.sql import Window

    sums = transactions(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"))
    run = sums.select("step", F.sum("n").over(Window.orderBy("step")).alias("c"), F.sum("n").over(Window.partitionBy()).alias("t"))
    return run.agg(F.min(F.when(F.col("c") >= 0.70 * F.col("t"), F.col("step"))).alias("train_end"), F.min(F.when(F.col("c") >= 0.85 * F.col("t"), F.col("step"))).alias("validation_end"))


@query("agg27_grouping_sets", f"WITH {D1}, g AS (SELECT *, amount - oldbalanceOrg AS err FROM d1), s AS (SELECT part, type, amount_bin, count(*) AS n, avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse, avg(err) AS bias, sum(err * err) AS sse, sum(oldbalanceOrg) AS sy, sum(oldbalanceOrg * oldbalanceOrg) AS syy FROM g GROUP BY GROUPING SETS ((part), (part, type), (part, amount_bin))) SELECT part AS partition_name, type, amount_bin, n, round(mae, 4) AS mae, round(rmse, 4) AS rmse, round(bias, 4) AS bias, round(CASE WHEN n >= 2 AND syy - sy * sy / n > 1e-9 * greatest(1, syy) THEN 1 - sse / (syy - sy * sy / n) END, 6) AS r2 FROM s")
def regression_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the balance as a guess of the amount, by partition, by type and by band; one shuffle for the three groupings."""
    rows = analytics(transactions(spark, sf_dir)).withColumn("err", F.col("amount") - F.col("oldbalanceOrg")).withColumnRenamed("partition", "part")
    y = F.col("oldbalanceOrg")
    sums = rows.groupingSets([[F.col("part")], [F.col("part"), F.col("type")], [F.col("part"), F.col("amount_bin")]], F.col("part"), F.col("type"), F.col("amount_bin")).agg(
        F.count("*").alias("n"), F.avg(F.abs("err")).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.avg("err").alias("bias"), F.sum(F.col("err") * F.col("err")).alias("sse"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy")
    )
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = F.when((F.col("n") >= 2) & (sst > 1e-9 * F.greatest(F.lit(1.0), F.col("syy"))), 1 - F.col("sse") / sst)
    return sums.select(F.col("part").alias("partition_name"), "type", "amount_bin", "n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("bias", 4).alias("bias"), F.round(r2, 6).alias("r2"))


#: Rules of transactions that often are fraud, by name, in Spark SQL and DuckDB alike.
RULES = {
    "transfer": "type = 'TRANSFER'",
    "cash_out": "type = 'CASH_OUT'",
    "equals_balance": "amount > 0 AND amount = oldbalanceOrg",
    "exceeds_balance": "amount > oldbalanceOrg",
    "transfer_equals_balance": "type = 'TRANSFER' AND amount > 0 AND amount = oldbalanceOrg",
    "cash_out_equals_balance": "type = 'CASH_OUT' AND amount > 0 AND amount = oldbalanceOrg",
}


@query(
    "prj18_agg17_rule_metrics",
    f"WITH {TX}, s AS (SELECT {PARTITION} AS part, * FROM tx), r AS ("
    + " UNION ALL ".join(f"SELECT part, '{k}' AS rule, count(*) AS n, CAST(sum(isFraud) AS BIGINT) AS frauds, count(*) FILTER (WHERE {v}) AS matches, CAST(coalesce(sum(isFraud) FILTER (WHERE {v}), 0) AS BIGINT) AS hits FROM s GROUP BY part" for k, v in RULES.items())
    + ") SELECT part AS partition_name, rule, n, frauds, matches, hits, round(matches / n, 9) AS support, round(CASE WHEN matches > 0 THEN hits / matches END, 9) AS confidence, round(CASE WHEN matches > 0 AND frauds > 0 THEN (hits / matches) / (frauds / n) END, 6) AS lift, round(CASE WHEN frauds > 0 THEN hits / frauds END, 9) AS coverage FROM r",
)
def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules in one aggregate, then one row for each."""
    rows = transactions(spark, sf_dir).withColumn("part", C.partition_of(F.col("step"), CUTS))
    sums = [F.struct(F.lit(k).alias("rule"), F.count_if(F.expr(v)).alias("matches"), F.coalesce(F.sum(F.when(F.expr(v), F.col("isFraud"))), F.lit(0)).cast("long").alias("hits")) for k, v in RULES.items()]
    found = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum("isFraud").cast("long").alias("frauds"), F.array(*sums).alias("r")).select("part", "n", "frauds", F.inline("r"))
    confidence = C.ratio(F.col("hits"), F.col("matches"))
    return found.select(
        F.col("part").alias("partition_name"), "rule", "n", "frauds", "matches", "hits",
        F.round(C.ratio(F.col("matches"), F.col("n")), 9).alias("support"),
        F.round(confidence, 9).alias("confidence"),
        F.round(F.try_divide(confidence, C.ratio(F.col("frauds"), F.col("n"))), 6).alias("lift"),
        F.round(C.ratio(F.col("hits"), F.col("frauds")), 9).alias("coverage"),
    )


ITEMS = ["type", "amount_bin", "origin_balance_bin", "exceeds", "equals"]
#: Least support and antecedent rows of a rule on the train rows, least confidence and lift there and on the validation rows, most rules.
SUPPORT, ANTECEDENT, CONFIDENCE, LIFT, RULES_KEPT = 0.0001, 50, 0.5, 2.0, 50


def association_rules(rows: DataFrame, label: str) -> DataFrame:
    """Rules of up to three items that foretell a 0/1 label: found on train rows, kept if they hold on validation rows, with their figures on all partitions.

    ``rows`` has partition, the bins, amounts and the label. Sums of whole item combinations come first: there
    are few, so their 25 item sets each stay few, too.
    """
    flags = rows.withColumn("exceeds", (F.col("amount") > F.col("oldbalanceOrg")).cast("int")).withColumn("equals", ((F.col("amount") > 0) & (F.col("amount") == F.col("oldbalanceOrg"))).cast("int"))
    items = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ITEMS]
    whole = stored(flags.groupBy("partition", *[i.alias(c) for i, c in zip(items, ITEMS, strict=True)]).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("f")), "item-combinations")
    sets = [F.concat_ws(" & ", *[F.col(c) for k, c in enumerate(ITEMS) if m >> k & 1]) for m in range(1, 32) if m.bit_count() <= 3]
    found = whole.select("partition", "n", "f", F.explode(F.array(*sets)).alias("rule")).groupBy("rule", "partition").agg(F.sum("n").alias("antecedent"), F.sum("f").alias("hits"))
    totals = F.broadcast(whole.groupBy("partition").agg(F.sum("n").alias("n"), F.sum("f").alias("f")))  # a row a partition
    confidence = F.col("hits") / F.col("antecedent")
    figures = found.join(totals, "partition").select("rule", "partition", "antecedent", "hits", (F.col("hits") / F.col("n")).alias("support"), confidence.alias("confidence"), F.try_divide(confidence, F.col("f") / F.col("n")).alias("lift"))
    strong = (F.col("confidence") >= CONFIDENCE) & (F.col("lift") >= LIFT)
    train = figures.where((F.col("partition") == "train") & strong & (F.col("antecedent") >= ANTECEDENT) & (F.col("support") >= SUPPORT))
    held = figures.where((F.col("partition") == "validation") & strong).select("rule")
    # The number of rules is a limit of the report.
    best = train.join(held, "rule", "left_semi").orderBy(F.desc(F.round("lift", 9)), F.desc("support"), "rule").limit(RULES_KEPT).select("rule")
    rounded = [F.round(c, 9).alias(c) for c in ("support", "confidence", "lift")]
    return figures.join(F.broadcast(best), "rule").select("rule", F.col("partition").alias("partition_name"), "antecedent", "hits", *rounded)


@query(
    "ml14_associations",
    f"WITH {D1}, i AS (SELECT part, ['type=' || type, 'amount_bin=' || amount_bin, 'origin_balance_bin=' || origin_balance_bin, 'exceeds=' || (amount > oldbalanceOrg)::INT, 'equals=' || (amount > 0 AND amount = oldbalanceOrg)::INT] AS items, (l_returnflag = 'R')::INT AS y FROM d1), "
    "c AS (SELECT part, list_filter([CASE WHEN m // 1 % 2 = 1 THEN items[1] END, CASE WHEN m // 2 % 2 = 1 THEN items[2] END, CASE WHEN m // 4 % 2 = 1 THEN items[3] END, CASE WHEN m // 8 % 2 = 1 THEN items[4] END, CASE WHEN m // 16 % 2 = 1 THEN items[5] END], lambda x: x IS NOT NULL) AS s, y FROM i, range(1, 32) t(m) WHERE bit_count(m::INT) <= 3), "
    "t AS (SELECT part, count(*) AS n, sum(y) AS f FROM i GROUP BY part), g AS (SELECT array_to_string(s, ' & ') AS rule, part, count(*) AS antecedent, CAST(sum(y) AS BIGINT) AS hits FROM c GROUP BY 1, 2), "
    "r AS (SELECT rule, g.part, antecedent, hits, hits / n AS support, hits / antecedent AS confidence, (hits / antecedent) / nullif(f / n, 0) AS lift FROM g JOIN t USING (part)), "
    f"b AS (SELECT rule FROM r WHERE part = 'train' AND confidence >= {CONFIDENCE} AND lift >= {LIFT} AND antecedent >= {ANTECEDENT} AND support >= {SUPPORT} AND rule IN (SELECT rule FROM r WHERE part = 'validation' AND confidence >= {CONFIDENCE} AND lift >= {LIFT}) ORDER BY round(lift, 9) DESC, support DESC, rule LIMIT {RULES_KEPT}) "
    "SELECT rule, part AS partition_name, antecedent, hits, round(support, 9) AS support, round(confidence, 9) AS confidence, round(lift, 9) AS lift FROM r WHERE rule IN (SELECT rule FROM b)",
)
def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for returned lines, which the items foretell well."""
    rows = analytics(transactions(spark, sf_dir)).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return association_rules(rows, "y")


@query("src09_pushed_filter", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-31'")
def pushed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns and a range that reach the Parquet scan."""
    return table(spark, sf_dir, "lineitem").where("l_shipdate between timestamp_ntz '1997-01-01' and timestamp_ntz '1997-01-31'").select("l_orderkey", "l_linenumber", "l_extendedprice")


def totals() -> dict[str, Column]:
    """What has to be the same of a table and of what it is made from."""
    return {"rows": F.count("*"), "amount": F.sum(F.col("amount").cast("decimal(38,6)")), "frauds": F.sum("isFraud").cast("long"), "first_step": F.min("step"), "last_step": F.max("step")}


#: The partitions of the analytical table.
NAMES = ("train", "validation", "test", "stress")


def publish_analytics(rows: DataFrame, path: str, cuts: tuple[int, int, int] = CUTS, sources: dict[str, str] | None = None) -> dict:
    """Publish the analytical table of transactions: rows, amounts and frauds are kept, partitions cover all rows, bins have no nulls. What goes in and what comes out is measured by the pass that writes."""
    bins = fitted_bins(rows, cuts)
    seen, inputs = observed(rows, totals())
    measures = totals() | {f"in_{p}": F.count_if(F.col("partition") == p) for p in NAMES} | {"null_bins": F.count_if(F.col("amount_bin").isNull() | F.col("origin_balance_bin").isNull())}

    def checks(found: dict) -> dict[str, bool]:
        return {
            "one_row_per_row": found["rows"] == found["input_rows"],
            "amount_total_preserved": found["amount"] == found["input_amount"],
            "fraud_count_preserved": found["frauds"] == found["input_frauds"],
            "steps_preserved": (found["first_step"], found["last_step"]) == (found["input_first_step"], found["input_last_step"]),
            "partitions_cover_all_rows": sum(found[f"in_{p}"] for p in NAMES) == found["rows"],
            "bins_without_nulls": found["null_bins"] == 0,
        }

    return publish(seen.withColumns(bins), path, measures, checks, inputs, sources)


@query(
    "qc01_qc02_published_analytics",
    f"WITH {D1} SELECT part AS partition_name, (SELECT count(*) FROM tx) AS input_rows, count(*) AS n, round(sum(amount::DECIMAL(38, 6)), 2)::DOUBLE AS amount, CAST(sum(isFraud) AS BIGINT) AS frauds, 6 AS checks_passed FROM d1 GROUP BY part",
)
def published_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analytical table by partition, read through the gate, and what its report says of the rows that went in and of the checks."""
    path = f"{shared_root(spark)}/analytics-{uuid.uuid4().hex}"
    rows = transactions(spark, sf_dir).select("step", "type", "amount", "oldbalanceOrg", "nameOrig", "nameDest", "isFraud")
    report = publish_analytics(rows, path)
    table_ = verified(spark, path, needed=("one_row_per_row", "bins_without_nulls"))
    found = table_.groupBy(F.col("partition").alias("partition_name")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount").cast("decimal(38,6)")), 2).cast("double").alias("amount"), F.sum("isFraud").cast("long").alias("frauds"))
    return found.withColumns({"input_rows": F.lit(report["measures"]["input_rows"]).cast("long"), "checks_passed": F.lit(sum(report["checks"].values()))})
