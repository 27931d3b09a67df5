"""Evaluation of scores: confusion, thresholds, curves, calibration, multiclass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import equal_groups, running
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import CUTS, TX, table, transactions

FALSE_ALARM, MISSED = 1.0, 20.0
SCORED = f"{TX}, s AS (SELECT least(amount / (oldbalanceOrg + 1), 10.0) / 10 AS score, isFraud AS y FROM tx)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions(spark, sf_dir)
    return rows.select((F.least(F.col("amount") / (F.col("oldbalanceOrg") + 1), F.lit(10.0)) / 10).alias("score"), F.col("isFraud").alias("y"))


def bad_score() -> Column:
    return ~F.coalesce(F.col("y").isin(0, 1) & F.col("score").between(0, 1) & ~F.isnan("score"), F.lit(False))


def refused(n: int | None, bad: int | None, positives: int | None) -> None:
    if not n or bad:
        raise ValueError("labels have to be 0 or 1 and scores between 0 and 1")
    if positives in (0, n):
        raise ValueError("there is only one class of labels")


def checked(rows: DataFrame) -> DataFrame:
    """The same rows, if there are any, labels are 0 or 1 and both occur, and scores are finite and between 0 and 1."""
    seen = rows.agg(F.count("*").alias("n"), F.count_if(bad_score()).alias("bad"), F.count_if(F.col("y") == 1).alias("p")).first()
    refused(seen["n"], seen["bad"], seen["p"])
    return rows


def counted(rows: DataFrame) -> DataFrame:
    """A stored table with rows (n) and positives (p) of each distinct score: all that confusion, thresholds and areas need. Refuses what ``checked`` does; ``rows`` are read once."""
    counts = stored(rows.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("p"), F.count_if(bad_score()).alias("bad")), "score-counts")
    seen = counts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("p").alias("p")).first()
    refused(seen["n"], seen["bad"], seen["p"])
    return counts.drop("bad")


def confusion_at(counts: DataFrame, threshold: float, false_alarm: float = FALSE_ALARM, missed: float = MISSED) -> DataFrame:
    """Counts at a threshold, their ratios (0 where undefined) and the cost, in all and for a thousand rows."""
    alarm, n, p = F.col("score") >= threshold, F.col("n"), F.col("p")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    c = counts.agg(total(F.when(~alarm, n - p)).alias("tn"), total(F.when(alarm, n - p)).alias("fp"), total(F.when(~alarm, p)).alias("fn"), total(F.when(alarm, p)).alias("tp"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    cost = false_alarm * fp + missed * fn
    rounded = lambda a, b: F.round(C.ratio_or_zero(a, b), 9)
    return c.select("tn", "fp", "fn", "tp", rounded(tp, tp + fp).alias("precision"), rounded(tp, tp + fn).alias("recall"), rounded(2 * tp, 2 * tp + fp + fn).alias("f1"), cost.alias("cost"), F.round(1000 * cost / (tp + fp + fn + F.col("tn")), 6).alias("cost_per_1000"))


def confusion_of(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return confusion_at(counted(rows), threshold)


@query("agg22_confusion", f"WITH {SCORED}, c AS (SELECT count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp FROM s) SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, (fp + 20 * fn)::DOUBLE AS cost, round(1000.0 * (fp + 20 * fn) / (tn + fp + fn + tp), 6) AS cost_per_1000 FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_of(scored(spark, sf_dir))


def curve(counts: DataFrame) -> DataFrame:
    """Per distinct score: rows and positives at it (n, p), above it (bn, bp), with it (cn, cp), and in all (tn, tp). Scores are ranges of one falling order."""
    run = running(counts, [F.desc("score")], ["n", "p"])
    totals = F.broadcast(counts.agg(F.sum("n").alias("tn"), F.sum("p").alias("tp")))  # one row
    before = run.crossJoin(totals).withColumnsRenamed({"before_n": "bn", "before_p": "bp"})
    return before.withColumns({"cn": F.col("bn") + F.col("n"), "cp": F.col("bp") + F.col("p")})


CURVE = f"{SCORED}, k AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM s GROUP BY score), c AS (SELECT score, n, p, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(p) OVER () AS tp FROM k)"


@query("win04_cost_threshold", f"WITH {CURVE}, o AS (SELECT score AS threshold, CAST(cn - cp AS BIGINT) AS fp, CAST(tp - cp AS BIGINT) AS fn FROM c UNION ALL SELECT 2.0, 0, CAST(max(tp) AS BIGINT) FROM c) SELECT round(threshold::DOUBLE, 9) AS threshold, fp, fn, (fp + 20 * fn)::DOUBLE AS cost FROM o ORDER BY cost, threshold DESC LIMIT 1")
def cost_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest threshold, no alarm at all (2.0) included; of equal costs the highest."""
    return cheapest(counted(scored(spark, sf_dir))).withColumn("threshold", F.round("threshold", 9))


#: The threshold that no score reaches.
NO_ALARM = 2.0


def cheapest(counts: DataFrame, false_alarm: float = FALSE_ALARM, missed: float = MISSED) -> DataFrame:
    """One row (threshold, fp, fn, cost): where alarms cost least."""
    c = curve(counts)
    options = c.select(F.col("score").alias("threshold"), (F.col("cn") - F.col("cp")).alias("fp"), (F.col("tp") - F.col("cp")).alias("fn")).union(counts.agg(F.lit(NO_ALARM).alias("threshold"), F.lit(0).cast("long"), F.sum("p")))
    return options.withColumn("cost", false_alarm * F.col("fp") + missed * F.col("fn")).orderBy("cost", F.desc("threshold")).limit(1)


@query("agg23_agg24_curves", f"WITH {CURVE}, l AS (SELECT *, lag(cp, 1, 0) OVER (ORDER BY score DESC) AS bp, lag(cn, 1, 0) OVER (ORDER BY score DESC) AS bn FROM c) SELECT round(sum((cp - bp) / tp * cp / cn), 9) AS average_precision, round(sum((cp - bp) / tp * (cp / cn + CASE WHEN bn = 0 THEN 1 ELSE bp / bn END) / 2), 9) AS pr_area, round(sum(((cn - cp) - (bn - bp)) / (tn - tp) * (cp + bp) / tp / 2), 9) AS roc_area FROM l")
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas over all distinct scores, as they are."""
    return areas(counted(scored(spark, sf_dir)))


def areas(counts: DataFrame) -> DataFrame:
    """One row: average precision, area under the precision-recall curve by trapezoids, area under the ROC curve."""
    c = curve(counts)
    cp, bp, cn, bn, tp, tn = (F.col(x) for x in ("cp", "bp", "cn", "bn", "tp", "tn"))
    before = F.when(bn == 0, 1.0).otherwise(F.try_divide(bp, bn))
    return c.agg(
        F.round(F.sum((cp - bp) / tp * cp / cn), 9).alias("average_precision"),
        F.round(F.sum((cp - bp) / tp * (cp / cn + before) / 2), 9).alias("pr_area"),
        F.round(F.sum(((cn - cp) - (bn - bp)) / (tn - tp) * (cp + bp) / tp / 2), 9).alias("roc_area"),
    )


def probability_losses(rows: DataFrame) -> DataFrame:
    """One row of (score, y) rows: Brier score, log loss, and the expected calibration error over ten equal widths."""
    q = F.greatest(F.least("score", F.lit(1 - 1e-6)), F.lit(1e-6))
    e = F.col("score") - F.col("y")
    bins = rows.groupBy(F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("y").alias("r"))
    error = bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("r"))) / F.sum("n"), 9).alias("calibration_error"))
    return rows.agg(F.round(F.avg(e * e), 9).alias("brier"), F.round(F.avg(F.when(F.col("y") == 1, -F.log(q)).otherwise(-F.log(1 - q))), 9).alias("log_loss")).crossJoin(F.broadcast(error))


def evaluated(validation: DataFrame, test: DataFrame, false_alarm: float = FALSE_ALARM, missed: float = MISSED) -> DataFrame:
    """One row: the threshold at which alarms cost least on the validation rows (score, y), and what it and the scores are worth on the test rows."""
    chosen = cheapest(counted(validation), false_alarm, missed).first()
    held = counted(test)
    size = held.agg(F.sum("n").alias("n"), F.sum("p").alias("positives"), F.round(F.sum("p") / F.sum("n"), 9).alias("prevalence"))
    one = size.crossJoin(areas(held)).crossJoin(confusion_at(held, chosen["threshold"], false_alarm, missed))
    return one.select(F.round(F.lit(chosen["threshold"]), 9).alias("threshold"), F.lit(chosen["cost"]).alias("validation_cost"), "*")


@query(
    "ml03_validation_threshold",
    f"WITH {SCORED.replace('isFraud AS y FROM', 'isFraud AS y, step FROM')}, "
    + f"v AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM s WHERE step > {CUTS[0]} AND step <= {CUTS[1]} GROUP BY score), "
    + "vc AS (SELECT score, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp, sum(p) OVER () AS tp FROM v), "
    + "o AS (SELECT score AS threshold, (cn - cp) + 20 * (tp - cp) AS cost FROM vc UNION ALL SELECT 2.0, 20 * max(tp) FROM vc), b AS (SELECT threshold::DOUBLE AS threshold, cost::DOUBLE AS cost FROM o ORDER BY cost, threshold DESC LIMIT 1), "
    + f"t AS (SELECT score, count(*) AS n, CAST(sum(y) AS BIGINT) AS p FROM s WHERE step > {CUTS[1]} AND step <= {CUTS[2]} GROUP BY score), "
    + "c AS (SELECT score, n, p, sum(n) OVER (ORDER BY score DESC) AS cn, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER () AS tn, sum(p) OVER () AS tp FROM t), l AS (SELECT *, cn - n AS bn, cp - p AS bp FROM c), "
    + "a AS (SELECT CAST(any_value(tn) AS BIGINT) AS n, CAST(any_value(tp) AS BIGINT) AS positives, round(any_value(tp) / any_value(tn), 9) AS prevalence, round(sum((cp - bp) / tp * cp / cn), 9) AS average_precision, round(sum((cp - bp) / tp * (cp / cn + CASE WHEN bn = 0 THEN 1 ELSE bp / bn END) / 2), 9) AS pr_area, round(sum(((cn - cp) - (bn - bp)) / (tn - tp) * (cp + bp) / tp / 2), 9) AS roc_area FROM l), "
    + "m AS (SELECT CAST(coalesce(sum(n - p) FILTER (WHERE score < threshold), 0) AS BIGINT) AS tn, CAST(coalesce(sum(n - p) FILTER (WHERE score >= threshold), 0) AS BIGINT) AS fp, CAST(coalesce(sum(p) FILTER (WHERE score < threshold), 0) AS BIGINT) AS fn, CAST(coalesce(sum(p) FILTER (WHERE score >= threshold), 0) AS BIGINT) AS tp FROM t, b) "
    + "SELECT round(threshold, 9) AS threshold, cost AS validation_cost, a.*, m.*, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9) AS f1, (fp + 20 * fn)::DOUBLE AS cost, round(1000.0 * (fp + 20 * fn) / (tn + fp + fn + tp), 6) AS cost_per_1000 FROM a, m, b",
)
def validation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the formula's scores is chosen on the validation partition and judged on the test partition."""
    step = F.col("step")
    ratio = F.least(F.col("amount") / (F.col("oldbalanceOrg") + 1), F.lit(10.0)) / 10
    rows = stored(transactions(spark, sf_dir).select("step", ratio.alias("score"), F.col("isFraud").alias("y")), "partition-scores")
    return evaluated(rows.where((step > CUTS[0]) & (step <= CUTS[1])), rows.where((step > CUTS[1]) & (step <= CUTS[2])))


@query("agg24_probability_losses", f"WITH {SCORED}, p AS (SELECT *, greatest(least(score, 1 - 1e-6), 1e-6) AS q FROM s), b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS p, avg(y) AS r FROM s GROUP BY 1) SELECT round(avg((score - y) * (score - y)), 9) AS brier, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 9) AS log_loss, (SELECT round(sum(n * abs(p - r)) / sum(n), 9) FROM b) AS calibration_error FROM p")
def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probability_losses(scored(spark, sf_dir))


@query("agg24_agg25_calibration", f"WITH {SCORED.replace('isFraud AS y FROM', 'isFraud AS y, l_orderkey, l_linenumber, l_partkey FROM')}, r AS (SELECT *, CAST(greatest(0, ceil((row_number() OVER (ORDER BY score, l_orderkey, l_linenumber, l_partkey, y) - 1) * 10 / greatest(count(*) OVER () - 1, 1)) - 1) AS BIGINT) AS bin FROM s) SELECT bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(y), 9) AS rate FROM r GROUP BY bin")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and observed rate by deciles of rank; ties by the rows' keys."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    rows = transactions(spark, sf_dir).select((F.least(F.col("amount") / (F.col("oldbalanceOrg") + 1), F.lit(10.0)) / 10).alias("score"), F.col("isFraud").alias("y"), *keys)
    return equal_groups(rows, ["score", *keys, "y"], 10, "bin").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("score"), 9).alias("mean_score"), F.round(F.avg("y"), 9).alias("rate"))


@query("agg26_multiclass", "WITH s AS (SELECT lang AS y, CASE WHEN length(text) % 7 = 0 THEN 'en' ELSE lang END AS p FROM documents), m AS (SELECT y, p, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT coalesce(a.c, b.c) AS class, coalesce(a.n, 0) AS support, coalesce(b.n, 0) AS predicted, coalesce((SELECT n FROM m WHERE m.y = coalesce(a.c, b.c) AND m.p = m.y), 0) AS hits FROM (SELECT y AS c, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1) a FULL JOIN (SELECT p AS c, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1) b ON a.c = b.c) SELECT class, support, predicted, hits, round(CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 9) AS recall, round(CASE WHEN support + predicted > 0 THEN 2 * hits / (support + predicted) ELSE 0 END, 9) AS f1 FROM t")
def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class from the confusion counts; a fixed rule stands for a classifier."""
    guess = F.when(F.length("text") % 7 == 0, "en").otherwise(F.col("lang"))
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("y"), guess.alias("p")).agg(F.count("*").alias("n"))
    sides = m.select(F.inline(F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hits")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("hits")))))
    t = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    h, s, p = F.col("hits"), F.col("support"), F.col("predicted")
    return t.select("class", "support", "predicted", "hits", F.round(C.ratio_or_zero(h, p), 9).alias("precision"), F.round(C.ratio_or_zero(h, s), 9).alias("recall"), F.round(C.ratio_or_zero(2 * h, s + p), 9).alias("f1"))


#: Three guesses for each text, the first of which is the prediction.
GUESSES = "SELECT lang AS y, CASE WHEN length(text) % 7 = 0 THEN ['en', 'de', lang] WHEN length(text) % 11 = 0 THEN ['fr', 'es', 'en'] ELSE [lang, 'en', 'fr'] END AS g FROM documents"


def guessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, guesses = F.length("text"), lambda *xs: F.array(*[F.lit(x) if x else F.col("lang") for x in xs])
    g = F.when(n % 7 == 0, guesses("en", "de", None)).when(n % 11 == 0, guesses("fr", "es", "en")).otherwise(guesses(None, "en", "fr"))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("y"), g.alias("g"))


def multiclass_summary(rows: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 over the classes that occur, and how often the class is among the guesses; from counts of (class, prediction)."""
    counts = rows.groupBy("y", F.get("g", 0).alias("p")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("g", F.col("y"))).alias("top"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    truly = counts.groupBy(F.col("y").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"), F.sum("top").alias("top"))
    named = counts.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("predicted"))
    f1 = 2 * F.col("hits") / (F.col("support") + F.coalesce("predicted", F.lit(0)))
    each = truly.join(named, "class", "left").withColumn("f1", f1)
    total = F.sum("support")
    return each.agg(total.cast("long").alias("n"), F.round(F.sum("hits") / total, 9).alias("accuracy"), F.round(F.avg("f1"), 9).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / total, 9).alias("weighted_f1"), F.round(F.sum("top") / total, 9).alias("top3_accuracy"))


@query("agg26_multiclass_summary", f"WITH s AS ({GUESSES}), t AS (SELECT y AS class, count(*) AS support, count(*) FILTER (WHERE g[1] = y) AS hits, count(*) FILTER (WHERE list_contains(g, y)) AS top FROM s GROUP BY y), n AS (SELECT g[1] AS class, count(*) AS predicted FROM s GROUP BY 1), f AS (SELECT t.*, 2 * hits / (support + coalesce(predicted, 0)) AS f1 FROM t LEFT JOIN n ON t.class = n.class) SELECT CAST(sum(support) AS BIGINT) AS n, round(sum(hits) / sum(support), 9) AS accuracy, round(avg(f1), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1, round(sum(top) / sum(support), 9) AS top3_accuracy FROM f")
def multiclass_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiclass_summary(guessed(spark, sf_dir))


@query("agg34_confused_pairs", f"WITH s AS ({GUESSES}), c AS (SELECT y AS class, g[1] AS predicted, count(*) AS n FROM s GROUP BY 1, 2), t AS (SELECT class, sum(n) AS support FROM c GROUP BY 1) SELECT c.class, predicted, n AS errors, round(n / support, 9) AS share_of_class FROM c JOIN t ON c.class = t.class WHERE predicted <> c.class ORDER BY errors DESC, c.class, predicted LIMIT 4")
def confused_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four most frequent confusions: a top-k report."""
    counts = guessed(spark, sf_dir).groupBy(F.col("y").alias("class"), F.get("g", 0).alias("predicted")).agg(F.count("*").alias("errors"))
    support = counts.groupBy("class").agg(F.sum("errors").alias("support"))
    return counts.join(support, "class").where("predicted <> class").orderBy(F.desc("errors"), "class", "predicted").limit(4).select("class", "predicted", "errors", F.round(F.col("errors") / F.col("support"), 9).alias("share_of_class"))
