"""Lookups, samples, per-class heads, occlusion variants and other small operators on the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators.graph import graph, indicators, kept, nodes, NODES, FLAGS
from ledgerloom.operators.scores import SCORED, scored
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import CUTS, TX, TYPES, table, transactions


def first_of_each(rows: DataFrame, classes: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each class by a total order.

    Rows are cut into slices by hash first and each slice keeps its own first ``n``, so
    a class that holds most rows is never sorted in one task; the second step sees ``n`` rows a slice.
    """
    within = rows.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(64)))
    head = within.withColumn("__k", F.row_number().over(Window.partitionBy(*classes, "__slice").orderBy(*order))).where(F.col("__k") <= n)
    return head.withColumn("__k", F.row_number().over(Window.partitionBy(*classes).orderBy(*order))).where(F.col("__k") <= n).drop("__slice", "__k")


def drawn_of_each(rows: DataFrame, classes: list[str], keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each class, drawn by a hash of their keys and a seed: the same ones on every run and however rows lie."""
    drawn = rows.withColumn("__drawn", F.xxhash64(F.lit(seed), *keys))
    return first_of_each(drawn, classes, ["__drawn", *keys], n).drop("__drawn")


OUTCOME = "CASE WHEN isFraud = 1 AND amount > oldbalanceOrg THEN 'tp' WHEN isFraud = 1 THEN 'fn' WHEN amount > oldbalanceOrg THEN 'fp' ELSE 'tn' END"


@query("win12_ml15_error_examples", f"WITH {TX}, o AS (SELECT {OUTCOME} AS outcome, l_orderkey, l_linenumber, l_partkey, amount FROM tx) SELECT outcome, l_orderkey, l_linenumber, l_partkey, amount FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY l_orderkey, l_linenumber, l_partkey, amount) AS k FROM o) t WHERE k <= 3")
def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir).select(F.expr(OUTCOME).alias("outcome"), "l_orderkey", "l_linenumber", "l_partkey", "amount")
    return first_of_each(rows, ["outcome"], ["l_orderkey", "l_linenumber", "l_partkey", "amount"], 3)


@query("gr16_example_cases", f"WITH {FLAGS}, s AS (SELECT account FROM flags WHERE len(patterns) > 0), c AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM s WHERE account = nameDest) THEN 'caught' ELSE 'missed' END AS kind, nameDest, nameOrig, step, amount FROM tx WHERE isFraud = 1) SELECT kind, nameDest, nameOrig, step, amount FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY amount DESC, step, nameOrig, nameDest) AS k FROM c) t WHERE k <= 5")
def example_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest frauds that do and don't end at a suspicious account."""
    rows = transactions(spark, sf_dir)
    flagged = kept(indicators(kept(nodes(graph(spark, sf_dir)), "nodes")).where(F.size("patterns") > 0).select(F.col("account").alias("nameDest"), F.lit(True).alias("hit")), "flagged")
    frauds = rows.where("isFraud = 1").join(flagged, "nameDest", "left")
    cases = frauds.select(F.when(F.col("hit"), "caught").otherwise("missed").alias("kind"), "nameDest", "nameOrig", "step", "amount", (-F.col("amount")).alias("neg"))
    return first_of_each(cases, ["kind"], ["neg", "step", "nameOrig", "nameDest"], 5).drop("neg")


@query("ord02_net_flow_by_size", f"WITH {NODES} SELECT account, net_flow FROM nodes ORDER BY abs(net_flow) DESC, account LIMIT 25")
def largest_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(graph(spark, sf_dir)).select("account", "net_flow").orderBy(F.abs("net_flow").desc(), "account").limit(25)


@query("ord06_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7 AND o_custkey IS NOT NULL")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderkey = 7 and o_custkey is not null").select("o_orderkey", "o_custkey", "o_totalprice")


@query("jn04_semi_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("jn05_lookup_default", "SELECT c_custkey, coalesce(n, 0) AS orders, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    joined = table(spark, sf_dir, "customer").join(sums, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("agg13_edge_summary", f"WITH {TX} SELECT type, count(*) AS n, CAST(trunc(sum(amount)) AS BIGINT) AS total, CAST(sum(isFraud) AS BIGINT) AS frauds, count(DISTINCT nameOrig) AS origins, min(step) AS first_step, max(step) AS last_step FROM tx GROUP BY type")
def edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by type, totals cut to whole numbers."""
    return transactions(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.sum("amount").cast("bigint").alias("total"), F.sum("isFraud").cast("long").alias("frauds"), F.count_distinct("nameOrig").alias("origins"), F.min("step").alias("first_step"), F.max("step").alias("last_step"))


@query("agg13_edge_totals", f"WITH {TX} SELECT count(*) AS edges, count(DISTINCT nameOrig) AS origins, count(DISTINCT nameDest) AS destinations, (SELECT count(*) FROM (SELECT nameOrig FROM tx UNION SELECT nameDest FROM tx)) AS accounts, count(DISTINCT step) AS steps, min(step) AS first_step, max(step) AS last_step, round(sum(amount), 2) AS total, round(avg(amount), 6) AS mean, max(amount) AS largest, CAST(sum(isFraud) AS BIGINT) AS frauds, round(avg(isFraud), 9) AS fraud_rate FROM tx")
def edge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges in one row; account names are reduced to one row each before they are counted."""
    rows = transactions(spark, sf_dir)
    roles = rows.select(F.inline(F.array(F.struct(F.col("nameOrig").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("d")), F.struct(F.col("nameDest").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("d")))))
    names = roles.groupBy("name").agg(F.max("o").alias("o"), F.max("d").alias("d")).agg(F.sum("o").cast("long").alias("origins"), F.sum("d").cast("long").alias("destinations"), F.count("*").alias("accounts"))
    steps = rows.groupBy("step").agg(F.count("*").alias("n"), F.sum("amount").alias("a"), F.max("amount").alias("m"), F.sum("isFraud").alias("f"))
    sums = steps.agg(F.sum("n").alias("edges"), F.count("*").alias("steps"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.sum("a").alias("a"), F.max("m").alias("largest"), F.sum("f").cast("long").alias("frauds"))
    n = F.col("edges")
    return sums.crossJoin(names).select("edges", "origins", "destinations", "accounts", "steps", "first_step", "last_step", F.round("a", 2).alias("total"), F.round(F.col("a") / n, 6).alias("mean"), "largest", "frauds", F.round(F.col("frauds") / n, 9).alias("fraud_rate"))


@query("prj11_prj22_regression_features", f"WITH {TX} SELECT l_orderkey, l_linenumber, l_partkey, round(ln(1 + oldbalanceOrg), 9) AS log_balance, (oldbalanceOrg = 0)::DOUBLE AS zero_balance, round(sign(oldbalanceOrg - amount) * ln(1 + abs(oldbalanceOrg - amount)), 9) AS signed_gap FROM tx")
def regression_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("oldbalanceOrg") - F.col("amount")
    return transactions(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.log1p("oldbalanceOrg"), 9).alias("log_balance"), (F.col("oldbalanceOrg") == 0).cast("double").alias("zero_balance"), F.round(C.signed_log(gap), 9).alias("signed_gap"))


@query("prj09_prj10_credit_frame", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN 1000.0 / c_acctbal END, 9) AS percent_income, (c_acctbal < 0)::BOOLEAN AS missing_income FROM customer")
def credit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived columns of an application: the ratio is computed anew, missing values are marked."""
    income = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.lit(1000.0) / income, 9).alias("percent_income"), (F.col("c_acctbal") < 0).alias("missing_income"))


WEIGHTS = {"amount": 0.4, "oldbalanceOrg": -0.3, "l_quantity": 0.1, "l_discount": 0.2}


def _sigmoid_sql(replaced: str | None) -> str:
    terms = " + ".join(f"{w} * ln(1 + {f'm_{c}' if c == replaced else c})" for c, w in WEIGHTS.items())
    return f"1 / (1 + exp(-(({terms}) - 1)))"


@query(
    "set05_ml06_occlusion",
    f"WITH {TX}, m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in WEIGHTS)} FROM tx), v AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_sigmoid_sql(None)} - {_sigmoid_sql(c)} AS effect FROM tx, m" for c in WEIGHTS)
    + ") SELECT feature, round(avg(abs(effect)), 9) AS mean_effect, round(max(effect), 9) AS largest FROM v GROUP BY feature",
)
def occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a score moves when one feature is set to its median: one variant per feature and row, never shuffled as such."""
    rows = stored(transactions(spark, sf_dir).select(*WEIGHTS), "occlusion-rows")
    medians = {c: quantiles(rows, c, [0.5])[None][0] for c in WEIGHTS}

    def score(replaced: str | None):
        terms = [w * F.log1p(F.lit(medians[c]).cast("double") if c == replaced else F.col(c)) for c, w in WEIGHTS.items()]
        return 1 / (1 + F.exp(-(sum(terms[1:], terms[0]) - 1)))

    variants = F.array(*[F.struct(F.lit(c).alias("feature"), (score(None) - score(c)).alias("effect")) for c in WEIGHTS])
    return rows.select(F.inline(variants)).groupBy("feature").agg(F.round(F.avg(F.abs("effect")), 9).alias("mean_effect"), F.round(F.max("effect"), 9).alias("largest"))


def top_effects(rows: DataFrame, keys: list[str], score: Callable[[str | None], Column], columns: list[str], top: int = 5) -> DataFrame:
    """Per record the features whose replacement moves the score most: (keys, place, feature, effect); ties in the order of ``columns``."""
    scored_ = rows.select(*keys, score(None).alias("score_"), *[score(c).alias(f"without_{i}_") for i, c in enumerate(columns)])
    moved = scored_.select(*keys, *[(F.col("score_") - F.col(f"without_{i}_")).alias(f"effect_{i}_") for i in range(len(columns))])
    # A feature's place is how many come before it, so nothing is sorted.
    rank = [F.struct(-F.abs(F.col(f"effect_{i}_")), F.lit(i)) for i in range(len(columns))]
    place = [sum([(other < own).cast("int") for other in rank if other is not own], F.lit(0)) for own in rank]
    each = F.array(*[F.struct(p.alias("place"), F.lit(c).alias("feature"), F.col(f"effect_{i}_").alias("effect")) for i, (c, p) in enumerate(zip(columns, place, strict=True))])
    return moved.select(*keys, F.inline(F.filter(each, lambda x: x["place"] < top)))


@query(
    "ml06_top_effects",
    f"WITH {TX}, n AS MATERIALIZED (SELECT *, row_number() OVER () AS rid FROM tx), m AS (SELECT {', '.join(f'median({c}) AS m_{c}' for c in WEIGHTS)} FROM tx), v AS ("
    + " UNION ALL ".join(f"SELECT rid, '{c}' AS feature, {i} AS o, round({_sigmoid_sql(None)}, 15) - round({_sigmoid_sql(c)}, 15) AS effect FROM n, m" for i, c in enumerate(WEIGHTS))
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(effect) DESC, o) AS place FROM v) SELECT feature, CAST(place - 1 AS INT) AS place, count(*) AS n, round(avg(effect), 9) AS mean_effect FROM k WHERE place <= 2 GROUP BY 1, 2",
)
def leading_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features lead each record's explanation, counted over all records."""
    rows = stored(transactions(spark, sf_dir).select(*WEIGHTS), "explained-rows")
    medians = {c: quantiles(rows, c, [0.5])[None][0] for c in WEIGHTS}

    def score(replaced: str | None) -> Column:
        terms = [w * F.log1p(F.lit(medians[c]).cast("double") if c == replaced else F.col(c)) for c, w in WEIGHTS.items()]
        return F.round(1 / (1 + F.exp(-(sum(terms[1:], terms[0]) - 1))), 15)

    return top_effects(rows, [], score, list(WEIGHTS), 2).groupBy("feature", "place").agg(F.count("*").alias("n"), F.round(F.avg("effect"), 9).alias("mean_effect"))


def same_confusion(counts: dict[str, int], expected: dict[str, int]) -> None:
    """Raise unless the outcomes counted are those that a model's report states."""
    if wrong := sorted(k for k in {*counts, *expected} if counts.get(k, 0) != expected.get(k, 0)):
        raise ValueError(f"outcomes differ from the report: {', '.join(wrong)}")


@query("agg34_confidence_buckets", f"WITH {SCORED} SELECT CASE WHEN score < 0.4 THEN '[0,.4)' WHEN score < 0.6 THEN '[.4,.6)' WHEN score < 0.8 THEN '[.6,.8)' ELSE '[.8,1]' END AS bucket, count(*) AS n, round(avg(y), 9) AS accuracy FROM s GROUP BY 1")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("score")
    bucket = F.when(s < 0.4, "[0,.4)").when(s < 0.6, "[.4,.6)").when(s < 0.8, "[.6,.8)").otherwise("[.8,1]")
    return scored(spark, sf_dir).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("accuracy"))


@query("agg36_account_audit", f"WITH {TX}, e AS (SELECT nameOrig AS a, step FROM tx UNION ALL SELECT nameDest, step FROM tx), a AS (SELECT a, bool_or(step <= {CUTS[0]}) AS train, bool_or(step > {CUTS[0]} AND step <= {CUTS[1]}) AS validation, bool_or(step > {CUTS[1]}) AS test FROM e GROUP BY 1) SELECT train, validation, test, count(*) AS accounts FROM a GROUP BY 1, 2, 3")
def account_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, at either end, by the parts in which they occur; all of them, where a sample would do for an audit."""
    step = F.col("step")
    ends = transactions(spark, sf_dir).select("step", F.explode(F.array("nameOrig", "nameDest")).alias("a"))
    seen = ends.groupBy("a").agg(F.bool_or(step <= CUTS[0]).alias("train"), F.bool_or((step > CUTS[0]) & (step <= CUTS[1])).alias("validation"), F.bool_or(step > CUTS[1]).alias("test"))
    return seen.groupBy("train", "validation", "test").agg(F.count("*").alias("accounts"))


def account_overlap(rows: DataFrame, modulus: int = 100) -> DataFrame:
    """Of the accounts whose digest is divisible by ``modulus``: per role how many occur in each of train, validation and test, and in each two of them."""
    if modulus < 1:
        raise ValueError("the modulus has to be 1 or more")
    parts = ("train", "validation", "test")
    part = F.when(F.col("step") <= CUTS[0], "train").when(F.col("step") <= CUTS[1], "validation").otherwise("test")
    named = rows.select(part.alias("part"), F.inline(F.array(*[F.struct(F.lit(role).alias("role"), F.col(role).alias("account")) for role in ("nameOrig", "nameDest")])))
    sampled = named.where(F.conv(F.substring(F.md5(F.col("account").cast("binary")), 1, 8), 16, 10).cast("long") % modulus == 0)
    seen = sampled.groupBy("role", "account").agg(*[F.max((F.col("part") == p).cast("int")).alias(p) for p in parts])
    both = [("train", "validation"), ("train", "test"), ("validation", "test")]
    return seen.groupBy("role").agg(*[F.sum(p).alias(p) for p in parts], *[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in both])


@query("src06_account_overlap", f"WITH {TX}, n AS (SELECT CASE WHEN step <= {CUTS[0]} THEN 'train' WHEN step <= {CUTS[1]} THEN 'validation' ELSE 'test' END AS part, unnest(['nameOrig', 'nameDest']) AS role, unnest([nameOrig, nameDest]) AS account FROM tx), s AS (SELECT role, account, max((part = 'train')::INT) AS a, max((part = 'validation')::INT) AS b, max((part = 'test')::INT) AS c FROM n WHERE CAST('0x' || substr(md5(account), 1, 8) AS BIGINT) % 10 = 0 GROUP BY 1, 2) SELECT role, CAST(sum(a) AS BIGINT) AS train, CAST(sum(b) AS BIGINT) AS validation, CAST(sum(c) AS BIGINT) AS test, CAST(sum(a * b) AS BIGINT) AS train_validation, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS validation_test FROM s GROUP BY role")
def sampled_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the accounts by digest: the sample is the feature."""
    return account_overlap(transactions(spark, sf_dir), 10)


@query("ord12_top_three", f"WITH {TX}, n AS (SELECT nameDest, {', '.join(f'''count(*) FILTER (WHERE type = '{t}') AS n_{t}''' for t in TYPES)} FROM tx GROUP BY 1) SELECT nameDest, array_to_string(list_transform(list_sort([{', '.join(f'''(lpad((1000000000 - n_{t})::VARCHAR, 10, '0') || '{t}')''' for t in TYPES)}])[1:3], lambda x: substr(x, 11)), ',') AS top_types FROM n")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent types of each account, ties by name, from fixed counters instead of a sort of groups."""
    n = transactions(spark, sf_dir).groupBy("nameDest").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("n"), F.lit(t).alias("t")) for t in TYPES]))
    return n.select("nameDest", F.array_join(F.transform(F.slice(ranked, 1, 3), lambda x: x["t"]), ",").alias("top_types"))
