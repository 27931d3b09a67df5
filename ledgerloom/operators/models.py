"""Models: fraud, credit, segments, regression, on MLlib and on the boosted trees of ``boosting``; sampling and splits. Fits depend on the library, so ``tests/test_models.py`` checks them by property."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators import boosting, clustering
from ledgerloom.operators.contracts import asserted, finite
from ledgerloom.operators.marts import PARTITION, TERCILES, median_guess
from ledgerloom.operators.scores import evaluated, probability_losses
from ledgerloom.operators.segments import features
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import CUTS, TX, TYPES, table, transactions
from ledgerloom.sources.artifacts import without_summary

SEED = 42
#: Rounds of boosting.
ITERATIONS = 80


#: Rows of a block of the split.
EACH = 20_000
#: Leading bits of a hash that make a block of a sample.
BLOCK_BITS = 12


def by_hash(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """A reproducible uniform sample without replacement: the rows of least key hash.

    Blocks of the hash are counted first, and only rows of the leading blocks that hold ``n`` are ordered.
    """
    hashed = rows.withColumn("__h", F.xxhash64(*keys, F.lit(SEED)))
    block = F.shiftright("__h", 64 - BLOCK_BITS)
    upto = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))  # a row a block
    counts = hashed.groupBy(block.alias("__b")).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(upto, F.lit(0)))
    last = counts.where(F.col("__before") < n).agg(F.max("__b")).first()[0]
    return hashed.where(block <= F.lit(last)).orderBy("__h", *keys).drop("__h").limit(n)


def fraud_frame(rows: DataFrame) -> DataFrame:
    ratio = F.col("amount") / (F.col("oldbalanceOrg") + 1)
    return rows.withColumns({"ratio": ratio, "exceeds": (F.col("amount") > F.col("oldbalanceOrg")).cast("double"), "label": F.col("isFraud").cast("double")})


def encoder(spark: SparkSession) -> list:
    """Stages for the closed vocabulary of types."""
    index = StringIndexerModel.from_labels(TYPES, inputCol="type", outputCol="type_index", handleInvalid="error")
    return [index, OneHotEncoder(inputCol="type_index", outputCol="type_vector", dropLast=False)]


def probability() -> Column:
    return F.get(vector_to_array("probability"), 1)


FRAUD_COLUMNS = ["type", "amount", "oldbalanceOrg"]
FRAUD_NUMBERS = [*(f"is_{t.lower()}" for t in sorted(TYPES)), "amount", "oldbalanceOrg", "ratio", "exceeds"]


def of_types(rows: DataFrame) -> DataFrame:
    """``rows`` and a 0 or 1 for each type of the closed vocabulary; another type raises an error."""
    known = F.when(F.col("type").isin(TYPES), F.col("type")).otherwise(F.raise_error(F.concat(F.lit("unknown type "), F.col("type"))).cast("string"))
    return rows.withColumns({f"is_{t.lower()}": (known == t).cast("double") for t in sorted(TYPES)})


def fit_fraud(train: DataFrame, iterations: int = ITERATIONS) -> boosting.Model:
    """Boosted trees on type, amount, balance and what follows from them, fitted on all rows."""
    return boosting.fit(of_types(train), FRAUD_NUMBERS, "label", boosting.Settings(iterations))


def scored_frauds(rows: DataFrame, model: boosting.Model) -> DataFrame:
    """Transactions (``FRAUD_COLUMNS``) and their ``score``; a row that breaks a rule, or a column that is missing, raises an error."""
    rules = {f"{c} is a number of 0 or more": finite(c) & (F.col(c) >= 0) for c in FRAUD_COLUMNS[1:]} | {"type is known": F.col("type").isin(TYPES)}
    asserted(rows, rules, FRAUD_COLUMNS)
    ratio = F.col("amount") / (F.col("oldbalanceOrg") + 1)
    wide = of_types(rows.withColumns({"ratio": ratio, "exceeds": (F.col("amount") > F.col("oldbalanceOrg")).cast("double")}))
    return boosting.with_score(wide, model).select(*rows.columns, "score")


def fraud_scores(spark: SparkSession, sf_dir: str, iterations: int) -> tuple[DataFrame, float]:
    """A stored table of all transactions with partition, label and score by a model of the train partition, and the train rows' share of frauds."""
    rows = stored(transactions(spark, sf_dir).select("step", "isFraud", *FRAUD_COLUMNS), "fraud-rows")
    train = fraud_frame(rows.where(F.col("step") <= CUTS[0]))
    prior = train.agg(F.avg("label")).first()[0]
    found = scored_frauds(rows, fit_fraud(train, iterations))
    return stored(found.select(C.partition_of(F.col("step"), CUTS).alias("partition_name"), "isFraud", "score"), "fraud-scores"), prior


@query("ml03_fraud_model")
def fraud_model(spark: SparkSession, sf_dir: str, iterations: int = ITERATIONS) -> DataFrame:
    """Fitted on the train partition; mean score and the prior's by partition and label."""
    found, prior = fraud_scores(spark, sf_dir, iterations)
    return found.groupBy("partition_name", "isFraud").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.lit(prior).alias("prior"))


@query("ml03_fraud_evaluation")
def fraud_evaluation(spark: SparkSession, sf_dir: str, iterations: int = ITERATIONS) -> DataFrame:
    """The boosted trees and the prior on the test partition, each at the threshold that costs least on the validation partition."""
    found, prior = fraud_scores(spark, sf_dir, iterations)
    out = None
    for name, score in (("boosted", F.col("score")), ("prior", F.lit(prior))):
        rows = found.select("partition_name", score.alias("score"), F.col("isFraud").alias("y"))
        one = evaluated(rows.where("partition_name = 'validation'"), rows.where("partition_name = 'test'")).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.union(one)
    return out


@query("ml03_prior_baseline", f"WITH {TX}, p AS (SELECT avg(isFraud) AS p FROM tx WHERE step <= {CUTS[0]}), s AS (SELECT {PARTITION} AS part, isFraud AS y, p FROM tx, p) SELECT part AS partition_name, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END), 9) AS log_loss FROM s GROUP BY part")
def prior_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of frauds among the train rows as everyone's score."""
    rows = transactions(spark, sf_dir)
    p = F.broadcast(rows.where(F.col("step") <= CUTS[0]).agg(F.avg("isFraud").alias("p")))  # one row
    e, y = F.col("p") - F.col("isFraud"), F.col("isFraud")
    loss = F.when(y == 1, -F.log("p")).otherwise(-F.log(1 - F.col("p")))
    return rows.crossJoin(p).groupBy(C.partition_of(F.col("step"), CUTS).alias("partition_name")).agg(F.count("*").alias("n"), F.round(F.avg(e * e), 9).alias("brier"), F.round(F.avg(loss), 9).alias("log_loss"))


#: Columns of each set: amounts are logged; the second set has what a lender adds.
CREDIT_SETS = {"applicant": ["income", "employment", "age"], "with_loan": ["income", "employment", "age", "loan", "percent_income"]}
LOGGED = {"income", "loan"}


def credit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applications: income from the balance, missing where that is negative, the mean order as the loan; those whose balance is below 3000 or missing are bad with most."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    loans = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("loan"))
    rows = table(spark, sf_dir, "customer").join(loans, "c_custkey", "left")
    label = F.when(key % 10 == 0, balance >= 3000).otherwise(balance < 3000).cast("double")
    income = F.when(balance >= 0, balance)
    return rows.select("c_custkey", "c_mktsegment", label.alias("label"), income.alias("income"), F.nullif((key % 40).cast("double"), F.lit(7.0)).alias("employment"), (18 + key % 60).cast("double").alias("age"), "loan", F.try_divide(F.col("loan"), income).alias("percent_income"))


#: What a loan to a bad customer and one refused to a good customer cost, and the settings of the credit trees.
APPROVED_BAD, REFUSED_GOOD = 5.0, 1.0
CREDIT_TREES = boosting.Settings(iterations=200, rate=0.05, least=40)
SEGMENTS_OF_CUSTOMERS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def credit_stages(columns: list[str], n: int) -> list:
    """Medians for missing values and marks of them, logs, one-hot segments, scaling; then logistic regression."""
    marks = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing" for c in columns) + " FROM __THIS__")
    filled = Imputer(strategy="median", inputCols=columns, outputCols=[f"{c}_filled" for c in columns])
    logs = SQLTransformer(statement="SELECT *, " + ", ".join(f"{f'ln(1 + {c}_filled)' if c in LOGGED else f'{c}_filled'} AS {c}_used" for c in columns) + " FROM __THIS__")
    segment = [StringIndexer(inputCol="c_mktsegment", outputCol="segment", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCol="segment", outputCol="segment_vector")]
    vector = VectorAssembler(inputCols=["segment_vector", *[f"{c}_used" for c in columns], *[f"{c}_missing" for c in columns]], outputCol="raw")
    return [marks, filled, logs, *segment, vector, StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=1.0 / n)]


def of_segments(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"is_{x.lower()}": F.coalesce((F.col("c_mktsegment") == x).cast("double"), F.lit(0.0)) for x in SEGMENTS_OF_CUSTOMERS})


def credit_features(columns: list[str]) -> list[str]:
    return [*(f"is_{x.lower()}" for x in SEGMENTS_OF_CUSTOMERS), *columns]


def fit_credit(train: DataFrame, columns: list[str], settings: boosting.Settings = CREDIT_TREES) -> boosting.Model:
    """Boosted trees on the columns as they are, missing values included, and the segment."""
    return boosting.fit(of_segments(train), credit_features(columns), "label", settings)


def calibrated(scored: DataFrame) -> DataFrame:
    """``scored`` (part, label, p) and ``platt``: a logistic fit on the logit of the validation rows, hardly held small."""
    p = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = scored.withColumn("logit", F.log(p / (1 - p))).select("part", "label", "p", "logit")
    held = rows.where("part = 'validation'")
    stages = [VectorAssembler(inputCols=["logit"], outputCol="features"), LogisticRegression(regParam=1e-6 / max(1, held.count()), standardization=False)]
    fitted = Pipeline(stages=stages).fit(held).stages[-1]
    platt = 1 / (1 + F.exp(-(F.lit(float(fitted.coefficients[0])) * F.col("logit") + F.lit(float(fitted.intercept)))))
    return rows.select("part", "label", "p", platt.alias("platt"))


def scored_credit(rows: DataFrame, model: boosting.Model, columns: list[str]) -> DataFrame:
    """Applications and their ``score``; a column that is missing, or a number that is there but below 0 or not finite, raises an error. Missing numbers are scored as such."""
    rules = {f"{c} is missing or 0 or more": F.col(c).isNull() | (finite(c) & (F.col(c) >= 0)) for c in columns}
    asserted(rows, rules, [*columns, "c_mktsegment"])
    return boosting.with_score(of_segments(rows), model).select(*rows.columns, "score")


def credit_candidates(split: DataFrame, settings: boosting.Settings = CREDIT_TREES) -> list[tuple[str, str, DataFrame]]:
    """(kind, columns, stored rows with part, label, p and platt) of the prior, and of logistic regression and boosted trees on both sets of columns."""
    train = split.where("part = 'train'")
    seen = train.agg(F.count("*").alias("n"), F.avg("label").alias("prior")).first()
    found = [("prior", "none", split.select("part", "label", F.lit(seen["prior"]).alias("p"), F.lit(seen["prior"]).alias("platt")))]
    for name, columns in CREDIT_SETS.items():
        logistic = without_summary(Pipeline(stages=credit_stages(columns, seen["n"])).fit(train)).transform(split).withColumn("p", probability())
        trees = boosting.with_score(of_segments(split), fit_credit(train, columns, settings), "p")
        for kind, rows in (("logistic", logistic), ("boosted", trees)):
            found.append((kind, name, stored(calibrated(stored(rows.select("part", "label", "p"), "credit-scores")), "credit-calibrated")))
    return found


@query("ml04_ml05_credit_model")
def credit_model(spark: SparkSession, sf_dir: str, settings: boosting.Settings = CREDIT_TREES) -> DataFrame:
    """Prior, logistic and boosted candidates on both sets of columns, the best by log loss on the validation rows, and Platt scaling of each."""
    split = stored(stratified(credit_rows(spark, sf_dir), "label", "c_custkey"), "credit-split")
    loss = lambda p: F.avg(F.when(F.col("label") == 1, -F.log(F.greatest(p, F.lit(1e-6)))).otherwise(-F.log(F.greatest(1 - p, F.lit(1e-6)))))
    out = []
    for place, (kind, name, rows) in enumerate(credit_candidates(split, settings)):
        by_part = {r["part"]: r for r in rows.groupBy("part").agg(F.count("*").alias("n"), loss(F.col("p")).alias("loss"), loss(F.col("platt")).alias("platt")).collect()}
        out.append((place, kind, name, by_part["validation"]["loss"], by_part["test"]["loss"], by_part["test"]["platt"]))
    best = min(out, key=lambda r: (round(r[3], 9), r[0]))[0]
    return spark.createDataFrame([(*r[1:], r[0] == best) for r in out], "model string, columns string, validation_log_loss double, test_log_loss double, calibrated_log_loss double, chosen boolean")


@query("ml04_credit_evaluation")
def credit_evaluation(spark: SparkSession, sf_dir: str, settings: boosting.Settings = CREDIT_TREES) -> DataFrame:
    """Each candidate's calibrated scores on the test rows, at the threshold that costs least on the calibrated validation rows, with its losses."""
    split = stored(stratified(credit_rows(spark, sf_dir), "label", "c_custkey"), "credit-split")
    out = None
    for kind, name, rows in credit_candidates(split, settings):
        each = rows.select("part", F.col("platt").alias("score"), F.col("label").cast("int").alias("y"))
        test = each.where("part = 'test'")
        one = evaluated(each.where("part = 'validation'"), test, REFUSED_GOOD, APPROVED_BAD).crossJoin(probability_losses(test)).select(F.lit(kind).alias("model"), F.lit(name).alias("columns"), "*")
        out = one if out is None else out.union(one)
    return out


def neutral_values(train: DataFrame, columns: list[str]) -> dict[str, float]:
    """Medians of the numbers and the most frequent segment, of equal ones the first, of the train rows."""
    found = {c: quantiles(train, c, [0.5])[None][0] for c in columns}
    common = train.where("c_mktsegment is not null").groupBy("c_mktsegment").count().orderBy(F.desc("count"), "c_mktsegment").first()
    return {f"is_{x.lower()}": float(common is not None and common["c_mktsegment"] == x) for x in SEGMENTS_OF_CUSTOMERS} | found


@query("ml06_fitted_credit_effects")
def credit_effects(spark: SparkSession, sf_dir: str, settings: boosting.Settings = CREDIT_TREES, shown: int = 3) -> DataFrame:
    """For each test customer the three columns whose neutral value changes the fitted score most; the segment counts as one column."""
    split = stored(stratified(credit_rows(spark, sf_dir), "label", "c_custkey"), "credit-split")
    train, columns = split.where("part = 'train'"), CREDIT_SETS["applicant"]
    model = fit_credit(train, columns, settings)
    groups = {"segment": credit_features([]), **{c: [c] for c in columns}}
    found = boosting.with_effects(of_segments(split.where("part = 'test'")), model, neutral_values(train, columns), groups)
    pairs = F.arrays_zip(F.array(*[F.lit(g) for g in groups]).alias("feature"), F.col("effects").alias("effect"))
    ranked = F.slice(F.array_sort(F.transform(pairs, lambda x: F.struct((-F.abs(x["effect"])).alias("minus"), x["feature"].alias("feature"), x["effect"].alias("effect")))), 1, shown)
    each = found.select("c_custkey", "score", F.posexplode(ranked).alias("place", "x"))
    return each.select("c_custkey", "score", "place", "x.feature", "x.effect")


def stratified(rows: DataFrame, label: str, key: str) -> DataFrame:
    """70/15/15 within each label by rank of the key's hash: blocks of the hash, ``EACH`` rows on average, are counted first, so that no label meets in one task."""
    bits = min(32, max(0, rows.count() // EACH).bit_length())
    hashed = rows.withColumns({"__h": F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long")}).withColumn("__b", F.shiftright("__h", 32 - bits))
    counts = hashed.groupBy(label, "__b").agg(F.count("*").alias("__n"))
    running = counts.withColumns({"__start": F.coalesce(F.sum("__n").over(Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(label))}).drop("__n")
    place = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1
    joined = hashed.withColumn("__k", place).join(running, [label, "__b"])
    share = (F.col("__start") + F.col("__k")) / F.col("__all")
    return joined.withColumn("part", F.when(share < 0.70, "train").when(share < 0.85, "validation").otherwise("test")).drop("__h", "__b", "__k", "__start", "__all")


@query("ord10_stratified_split", "WITH r AS (SELECT c_custkey, c_mktsegment, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(c_custkey::VARCHAR), 1, 8), c_custkey) - 1) / count(*) OVER (PARTITION BY c_mktsegment) AS share FROM customer) SELECT c_custkey, c_mktsegment, CASE WHEN share < 0.70 THEN 'train' WHEN share < 0.85 THEN 'validation' ELSE 'test' END AS part FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


@query("ord08_train_sample", f"WITH {TX} SELECT step, count(*) AS n FROM (SELECT step FROM tx WHERE step <= {CUTS[0]} ORDER BY md5(l_orderkey || '-' || l_linenumber || '-' || l_partkey), l_orderkey LIMIT 500) t GROUP BY step")
def train_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hundred rows by hash: sampling is the feature."""
    rows = transactions(spark, sf_dir).where(F.col("step") <= CUTS[0])
    return rows.orderBy(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").cast("binary")), "l_orderkey").limit(500).groupBy("step").agg(F.count("*").alias("n"))


LOGGED_BEHAVIOUR = ["n_received", "mean_received", "cv"]
PLAIN_BEHAVIOUR = ["amount_concentration", "activity_density", *[f"share_{t.lower()}" for t in sorted(TYPES)]]
#: Numbers of segments that are tried, and resamples of half the accounts.
SEGMENTS, RESAMPLES = range(2, 8), 3


def scaled_behaviour(found: DataFrame) -> DataFrame:
    """(account, vector): heavy-tailed columns logged, all less their mean and over their population deviation (1 where that is 0)."""
    columns = LOGGED_BEHAVIOUR + PLAIN_BEHAVIOUR
    rows = stored(found.select("account", *[(C.log_of_positive(F.col(c)) if c in LOGGED_BEHAVIOUR else F.col(c).cast("double")).alias(c) for c in columns]), "behaviour-rows")
    seen = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns]).first()  # one row
    each = [(F.col(c) - F.lit(seen[f"m_{c}"] or 0.0)) / F.lit(seen[f"d_{c}"] or 1.0) for c in columns]
    return stored(rows.select("account", F.array(*each).alias("vector")), "behaviour")


def silhouette(labelled: DataFrame) -> float:
    """The library's silhouette of squared distances of (vector, prediction); -1 where there is but one cluster."""
    rows = stored(labelled.select(array_to_vector("vector").alias("features"), F.col("prediction").cast("double").alias("prediction")), "labelled")
    return float(ClusteringEvaluator().evaluate(rows)) if rows.select("prediction").distinct().count() > 1 else -1.0


def silhouettes(scaled: DataFrame, tried: Iterable[int] = SEGMENTS) -> tuple[list[tuple[int, float]], dict[int, clustering.Model]]:
    """(k, silhouette) of mini-batch k-means for each k, and the models."""
    models = clustering.fit(scaled, "account", "vector", list(tried), SEED)
    return [(k, silhouette(clustering.with_label(scaled, "vector", m))) for k, m in models.items()], models


def best_k(found: list[tuple[int, float]]) -> int:
    """The k of greatest silhouette, of equal ones the least."""
    return min(found, key=lambda x: (-round(x[1], 9), x[0]))[0]


@query("ml10_segments_kmeans")
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mini-batch k-means over logged and scaled behaviour for k from 2 to 7: the squared-distance silhouette of each, and which is chosen."""
    found, _ = silhouettes(scaled_behaviour(features(transactions(spark, sf_dir))))
    return spark.createDataFrame([(k, s, k == best_k(found)) for k, s in found], "k int, silhouette double, chosen boolean")


@query("ml10_account_segments")
def account_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every account and its segment under the chosen number of segments."""
    scaled = scaled_behaviour(features(transactions(spark, sf_dir)))
    found, models = silhouettes(scaled)
    return clustering.with_label(scaled, "vector", models[best_k(found)], "segment").select("account", "segment")


def rand_index(labels: DataFrame) -> DataFrame:
    """One row with the adjusted Rand index of two labellings (a, b), from their contingency counts."""
    n = labels.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.coalesce(F.sum(c * (c - 1) / 2), F.lit(0.0))
    i = n.agg(pairs(F.col("n")).alias("i"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("t"))
    r = n.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("r"))
    c = n.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("c"))
    chance = F.try_divide(F.col("r") * F.col("c"), F.col("t"))
    agreed = F.try_divide(F.col("i") - chance, (F.col("r") + F.col("c")) / 2 - chance)
    return i.crossJoin(r).crossJoin(c).select(F.round(F.coalesce(agreed, F.lit(1.0)), 9).alias("ari"))


@query("ml11_adjusted_rand", "WITH n AS (SELECT a, b, count(*) AS n FROM (SELECT label % 3 AS a, label % 2 AS b FROM embeddings) t GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM n) AS i, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY a)) AS r, (SELECT sum(x * (x - 1) / 2) FROM (SELECT sum(n) AS x FROM n GROUP BY b)) AS c, (SELECT sum(n) * (sum(n) - 1) / 2 FROM n) AS t) SELECT round((i - r * c / t) / ((r + c) / 2 - r * c / t), 9) AS ari FROM s")
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two given labellings."""
    return rand_index(table(spark, sf_dir, "embeddings").select((F.col("label") % 3).alias("a"), (F.col("label") % 2).alias("b")))


def stability(scaled: DataFrame, k: int, model: clustering.Model | None = None, resamples: int = RESAMPLES) -> list[tuple[int, int, float]]:
    """(resample, accounts, agreement) of the labels of a fit on all accounts with those of fits on halves of them, which are drawn by hash."""
    model = model or clustering.fit(scaled, "account", "vector", [k], SEED)[k]
    whole = stored(clustering.with_label(scaled, "vector", model, "a"), "segments")
    out = []
    for i in range(resamples):
        half = stored(whole.where(F.pmod(F.xxhash64("account", F.lit(i)), F.lit(2)) == 0), "half")
        again = clustering.fit(half, "account", "vector", [k], SEED + i + 1)[k]
        labels = clustering.with_label(half, "vector", again, "b").select("a", "b")
        out.append((i, half.count(), rand_index(labels).first()["ari"]))
    return out


@query("ml11_segment_stability")
def segment_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the best number of segments holds on halves of the accounts."""
    scaled = scaled_behaviour(features(transactions(spark, sf_dir)))
    found, models = silhouettes(scaled)
    k = best_k(found)
    return spark.createDataFrame([(k, *r) for r in stability(scaled, k, models[k])], "k int, resample int, accounts long, ari double")


#: Weights of the ridge candidates.
ALPHAS = (1.0, 10.0)


REGRESSION_TREES = boosting.Settings(iterations=100, l2=0.0, loss="squared")
REGRESSION_NUMBERS = [*(f"is_{t.lower()}" for t in sorted(TYPES)), "log_balance", "zero"]


def regression_candidates(train: DataFrame, settings: boosting.Settings = REGRESSION_TREES) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """From the simplest to the least simple: functions that add ``guess`` to rows; all but the median predict log1p(amount)."""
    seen = train.agg(F.count("*").alias("n"), F.coalesce(F.stddev_pop("label"), F.lit(1.0)).alias("deviation")).first()
    # The library divides the weight by the label's deviation.
    unit = seen["deviation"] / max(1, seen["n"])
    median = median_guess(train)
    stages = [*encoder(train.sparkSession), VectorAssembler(inputCols=["type_vector", "log_balance", "zero"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    fits = [(f"ridge_{alpha:g}", LinearRegression(regParam=alpha * unit, elasticNetParam=0.0, standardization=False)) for alpha in ALPHAS]
    guess = F.greatest(F.lit(0.0), F.expm1("prediction"))
    models = [(name, Pipeline(stages=[*stages, last]).fit(train)) for name, last in fits]
    trees = boosting.fit(of_types(train), REGRESSION_NUMBERS, "label", settings)
    boost = lambda rows: boosting.with_score(of_types(rows), trees, "prediction").select(*rows.columns, "prediction").withColumn("guess", guess)
    return [("median_by_type", lambda rows: rows.withColumn("guess", median)), *[(name, lambda rows, m=m: m.transform(rows).withColumn("guess", guess)) for name, m in models], ("boosted", boost)]


def guessed_amounts(rows: DataFrame, trees: boosting.Model) -> DataFrame:
    """Transactions (type, oldbalanceOrg) and ``prediction``, their amount by the trees, at least 0; a row that breaks a rule, or a column that is missing, raises an error."""
    asserted(rows, {"type is known": F.col("type").isin(TYPES), "oldbalanceOrg is a number of 0 or more": finite("oldbalanceOrg") & (F.col("oldbalanceOrg") >= 0)}, ["type", "oldbalanceOrg"])
    wide = of_types(rows.withColumns({"log_balance": F.log1p("oldbalanceOrg"), "zero": (F.col("oldbalanceOrg") == 0).cast("double")}))
    return boosting.with_score(wide, trees, "log_amount").select(*rows.columns, F.greatest(F.lit(0.0), F.expm1("log_amount")).alias("prediction"))


def first_best(errors: list[float]) -> int:
    """The place of the first error that is the least, but for 1e-9."""
    return next(i for i, e in enumerate(errors) if e <= min(errors) + 1e-9)


def regression_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored transactions with label, numbers and partition, and those of the train partition, all of which are fitted on."""
    numbers = {"label": F.log1p("amount"), "log_balance": F.log1p("oldbalanceOrg"), "zero": (F.col("oldbalanceOrg") == 0).cast("double"), "part": C.partition_of(F.col("step"), CUTS)}
    rows = transactions(spark, sf_dir).withColumns(numbers).select("l_orderkey", "l_linenumber", "l_partkey", "step", "type", "amount", *numbers)
    rows = stored(rows, "regression-rows")
    return rows, rows.where("part = 'train'")


def judged_candidates(rows: DataFrame, train: DataFrame, settings: boosting.Settings) -> tuple[list[tuple], str, dict[str, Callable]]:
    """Errors (model, partition, n, mae, rmse) of all candidates outside the train partition, the chosen one, and the candidates."""
    candidates, out = dict(regression_candidates(train, settings)), []
    for name, guess in candidates.items():
        e = F.col("amount") - F.col("guess")
        out += [(name, r["part"], r["n"], r["mae"], r["rmse"]) for r in guess(rows.where("part <> 'train'")).groupBy("part").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")).collect()]
    held = [r for r in out if r[1] == "validation"]
    return out, held[first_best([r[3] for r in held])][0], candidates


@query("ml08_amount_regression")
def amount_regression(spark: SparkSession, sf_dir: str, settings: boosting.Settings = REGRESSION_TREES) -> DataFrame:
    """Errors of each candidate by partition, and which the validation rows choose."""
    out, best, _ = judged_candidates(*regression_rows(spark, sf_dir), settings)
    return spark.createDataFrame([(*r, r[0] == best) for r in out], "model string, partition_name string, n long, mae double, rmse double, chosen boolean")


def with_band(rows: DataFrame, cuts: list[float]) -> DataFrame:
    """``rows`` and the band of their amount: how many of the terciles of the train rows it exceeds."""
    return rows.withColumn("band", sum((F.when(F.col("amount") > c, 1).otherwise(0) for c in cuts), F.lit(0)))


@query("ml09_predictions")
def predictions(spark: SparkSession, sf_dir: str, settings: boosting.Settings = REGRESSION_TREES) -> DataFrame:
    """The chosen model's prediction of each row outside the train partition, with its band of amounts: what is exported."""
    rows, train = regression_rows(spark, sf_dir)
    _, best, candidates = judged_candidates(rows, train, settings)
    found = with_band(candidates[best](rows.where("part <> 'train'")), quantiles(train, "amount", TERCILES)[None])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "step", F.col("part").alias("partition_name"), "type", "band", F.col("amount").alias("actual"), F.col("guess").alias("prediction"), F.lit(best).alias("model"))


_BANDS = f"""rows AS (SELECT tx.*, {PARTITION} AS part FROM tx), train AS (SELECT * FROM rows WHERE part = 'train'), m AS (SELECT type, median(amount) AS m FROM train GROUP BY type), g AS (SELECT median(amount) AS g, quantile_cont(amount, [{TERCILES[0]!r}, {TERCILES[1]!r}]) AS q FROM train),
p AS (SELECT part, rows.type, amount, coalesce(m, g) AS guess, (amount > q[1])::INT + (amount > q[2])::INT AS band FROM rows LEFT JOIN m ON rows.type = m.type, g WHERE part <> 'train')"""


@query("ml09_reference_bands", f"WITH {TX}, {_BANDS} SELECT part AS partition_name, band, count(*) AS n, round(avg(abs(amount - guess)), 4) AS mae, round(sqrt(avg((amount - guess) * (amount - guess))), 4) AS rmse, round(avg(guess - amount), 4) AS bias FROM p GROUP BY part, band")
def reference_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the median by type, in each partition, by bands of the amount that are cut at the train rows' terciles."""
    rows = stored(transactions(spark, sf_dir).select("step", "type", "amount").withColumn("part", C.partition_of(F.col("step"), CUTS)), "band-rows")
    train = rows.where("part = 'train'")
    found = with_band(rows.where("part <> 'train'").withColumn("guess", median_guess(train)), quantiles(train, "amount", TERCILES)[None])
    e = F.col("guess") - F.col("amount")
    return found.groupBy(F.col("part").alias("partition_name"), "band").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"))
