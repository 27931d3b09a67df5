"""Validation of raw rows: issues, reasons, duplicates, quality checks; text masking and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.exact import quantiles, running
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import CUTS, TX, table, transactions

#: Reasons for which a credit application is refused, in the order in which they are tried.
CREDIT_CATEGORIES = {
    "person_home_ownership": ["MORTGAGE", "OTHER", "OWN", "RENT"],
    "loan_intent": ["DEBTCONSOLIDATION", "EDUCATION", "HOMEIMPROVEMENT", "MEDICAL", "PERSONAL", "VENTURE"],
    "loan_grade": ["A", "B", "C", "D", "E", "F", "G"],
    "cb_person_default_on_file": ["N", "Y"],
}


def record_issues(rows: DataFrame, numbers: list[str], whole: list[str], flags: list[str], kinds: tuple[str, list[str]]) -> DataFrame:
    """Issues of single records: unlike in ``transaction_issues``, whole columns and flags have to be written as whole numbers, so 1.0 is invalid."""
    found = [F.when(C.blank(F.col(c)), F.lit(f"missing:{c}")) for c in [*numbers, *whole, *flags, kinds[0]]]
    found += [F.when(~C.blank(F.col(c)) & F.coalesce(C.number(F.col(c)) < 0, F.lit(True)), F.lit(f"invalid:{c}")) for c in numbers]
    for c in [*whole, *flags]:
        value = F.when(F.col(c).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c)).try_cast("long")
        ok = value.isin(0, 1) if c in flags else value >= 0
        found.append(F.when(~C.blank(F.col(c)) & ~F.coalesce(ok, F.lit(False)), F.lit(f"invalid:{c}")))
    found.append(F.when(~C.blank(F.col(kinds[0])) & ~F.col(kinds[0]).isin(kinds[1]), F.lit(f"invalid:{kinds[0]}")))
    return rows.withColumn("issues", F.array_compact(F.array(*found)))


def transaction_issues(rows: DataFrame, numbers: list[str], whole: list[str], flags: list[str], kinds: tuple[str, list[str]]) -> DataFrame:
    """Raw string rows with an array of their issues; a row may have several."""
    found: list[Column] = []
    for c in [*numbers, *whole, *flags, kinds[0]]:
        found.append(F.when(C.blank(F.col(c)), F.lit(f"missing:{c}")))
    for c in [*numbers, *whole]:
        value = C.number(F.col(c))
        bad = value.isNull() if c in numbers else value.isNull() | (F.floor(value) != value)
        found.append(F.when(~C.blank(F.col(c)) & bad, F.lit(f"invalid:{c}")))
        found.append(F.when(value < 0, F.lit(f"negative:{c}")))
    for c in flags:
        value = C.number(F.col(c))
        found.append(F.when(~C.blank(F.col(c)) & F.coalesce(~value.isin(0.0, 1.0), F.lit(True)), F.lit(f"invalid:{c}")))
    found.append(F.when(~C.blank(F.col(kinds[0])) & ~F.col(kinds[0]).isin(kinds[1]), F.lit(f"invalid:{kinds[0]}")))
    return rows.withColumn("issues", F.array_compact(F.array(*found)))


RAW = """SELECT c_custkey::VARCHAR AS step, c_acctbal::VARCHAR AS amount, c_mktsegment AS type, CASE WHEN c_nationkey < 20 THEN (c_nationkey % 2)::VARCHAR WHEN c_nationkey < 23 THEN '' ELSE '2' END AS flag FROM customer"""


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as raw strings: negative amounts, blank and wrong flags, an unknown type."""
    nation = F.col("c_nationkey")
    flag = F.when(nation < 20, (nation % 2).cast("string")).when(nation < 23, "").otherwise("2")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("step"), F.col("c_acctbal").cast("string").alias("amount"), F.col("c_mktsegment").alias("type"), flag.alias("flag"))


KNOWN = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]


def checked_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transaction_issues(raw_customers(spark, sf_dir), ["amount"], ["step"], ["flag"], ("type", KNOWN))


@query("prj03_agg39_issue_counts", f"WITH b AS ({RAW}), i AS (SELECT 'negative:amount' AS issue FROM b WHERE amount::DOUBLE < 0 UNION ALL SELECT 'missing:flag' FROM b WHERE flag = '' UNION ALL SELECT 'invalid:flag' FROM b WHERE flag = '2' UNION ALL SELECT 'invalid:type' FROM b WHERE type = 'MACHINERY') SELECT issue, count(*) AS n FROM i GROUP BY issue")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_customers(spark, sf_dir).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("prj03_silver_rows", f"WITH b AS ({RAW}) SELECT step::BIGINT AS step, amount::DOUBLE AS amount, type, flag::INT AS flag FROM b WHERE amount::DOUBLE >= 0 AND flag IN ('0', '1') AND type <> 'MACHINERY'")
def silver_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = checked_customers(spark, sf_dir).where(F.size("issues") == 0)
    return valid.select(F.col("step").cast("long").alias("step"), F.col("amount").cast("double").alias("amount"), "type", F.col("flag").cast("int").alias("flag"))


@query("qc01_quality_checks", f"WITH b AS ({RAW}), v AS (SELECT * FROM b WHERE amount::DOUBLE >= 0 AND flag IN ('0', '1') AND type <> 'MACHINERY') SELECT count(*) AS bronze, (SELECT count(*) FROM v) AS silver, count(*) - (SELECT count(*) FROM v) AS rejected, (SELECT count(DISTINCT step) = count(*) FROM v) AS unique_steps FROM b")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks in one aggregate over the rows."""
    rows = checked_customers(spark, sf_dir)
    ok = F.size("issues") == 0
    return rows.agg(F.count("*").alias("bronze"), F.count_if(ok).alias("silver"), F.count_if(~ok).alias("rejected"), (F.count_distinct(F.when(ok, F.col("step"))) == F.count_if(ok)).alias("unique_steps"))


def credit_reason(age: Column, income: Column, amount: Column, employment: Column, history: Column, label: Column, categories: dict[str, Column] | None = None) -> Column:
    """The first failing rule of an application; null values fail, but for employment, which may be missing."""
    tests = [("loan_status_invalid", label.isin(0, 1))]
    tests += [(f"{name}_unknown_category", value.isin(CREDIT_CATEGORIES[name])) for name, value in (categories or {}).items()]
    tests += [
        ("age_out_of_range", age.between(18, 100)),
        ("income_not_positive", income > 0),
        ("loan_amount_not_positive", amount > 0),
        ("emp_length_impossible", employment.isNull() | ((employment >= 0) & (employment <= age - 14))),
        ("credit_history_impossible", (history >= 0) & (history <= age - 13)),
    ]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in tests])


@query(
    "prj05_credit_reasons",
    "WITH a AS (SELECT 16 + c_custkey % 90 AS age, c_acctbal AS income, c_custkey % 50 AS employment, c_nationkey AS history FROM customer), r AS (SELECT CASE WHEN age NOT BETWEEN 18 AND 100 THEN 'age_out_of_range' WHEN income <= 0 THEN 'income_not_positive' WHEN employment > age - 14 THEN 'emp_length_impossible' WHEN history > age - 13 THEN 'credit_history_impossible' ELSE 'valid' END AS reason FROM a) SELECT reason, count(*) AS n FROM r GROUP BY reason",
)
def credit_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    reason = credit_reason(16 + key % 90, F.col("c_acctbal"), F.lit(1.0), key % 50, F.col("c_nationkey"), F.lit(0))
    return table(spark, sf_dir, "customer").groupBy(F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("prj06_all_reasons", "SELECT reasons, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN c_nationkey > 20 THEN 'nation_out_of_range' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment_unknown' END) AS reasons FROM customer) t GROUP BY reasons")
def all_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = F.concat_ws(",", F.when(F.col("c_acctbal") < 0, "negative_balance"), F.when(F.col("c_nationkey") > 20, "nation_out_of_range"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment_unknown"))
    return table(spark, sf_dir, "customer").groupBy(reasons.alias("reasons")).agg(F.count("*").alias("n"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by a total order, taken as the least struct, so a hot key is reduced before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("first"))
    return least.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])


@query("agg38_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) t WHERE k = 1")
def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return keep_first(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


@query("set03_set04_overlap", f"WITH {TX}, a AS (SELECT nameOrig, bool_or(step <= {CUTS[0]}) AS train, bool_or(step > {CUTS[0]}) AS later FROM tx GROUP BY 1) SELECT count(*) FILTER (WHERE train AND later) AS both_parts, count(*) FILTER (WHERE later AND NOT train) AS only_later, count(*) AS accounts FROM a")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts in both parts and in one only, from one row per account instead of two distinct sets."""
    seen = transactions(spark, sf_dir).groupBy("nameOrig").agg(F.bool_or(F.col("step") <= CUTS[0]).alias("train"), F.bool_or(F.col("step") > CUTS[0]).alias("later"))
    return seen.agg(F.count_if(F.col("train") & F.col("later")).alias("both_parts"), F.count_if(F.col("later") & ~F.col("train")).alias("only_later"), F.count("*").alias("accounts"))


def with_first_seen(rows: DataFrame) -> DataFrame:
    """``rows`` with the least id of those with an equal text, and whether there are several; null texts are equal."""
    marked = rows.withColumn("digest", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))
    firsts = marked.groupBy("digest").agg(F.min("doc_id").alias("first_id"), (F.count("*") > 1).alias("repeated"))
    return marked.join(firsts, "digest").drop("digest")


@query("win06_first_seen", "SELECT doc_id, lang, CAST(min(doc_id) OVER (PARTITION BY text) AS BIGINT) AS first_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First id of each text on all its rows: grouped by digest and joined back, so copies of one text needn't meet in a task."""
    return with_first_seen(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).drop("text")


@query("agg34_contradictory_texts", "SELECT count(*) AS texts, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE langs > 1) AS contradictory FROM (SELECT count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY text) t")
def contradictory(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), (F.min("lang") != F.max("lang")).alias("differ"))
    return groups.agg(F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if("differ").alias("contradictory"))


@query("agg10_text_profile", r"SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters, max(length(text)) AS longest, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))) AS BIGINT) AS words FROM documents GROUP BY lang")
def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("characters"), F.max(F.length("text")).cast("long").alias("longest"), F.sum(words).cast("long").alias("words"))


@query("str04_str08_masking")
def masking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with redactions put in, masked again; DuckDB has no look-behind, so tests hold the goldens."""
    text = F.concat(F.lit("My lender XXXX took {$310.45} since XX/XX/2016, then XXXX/XX/XXXX too; "), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    return rows.select("doc_id", C.masked(F.col("text"))[1].cast("long").alias("n_masked"), C.clean_narrative(F.col("text")).alias("clean"))


@query("dat01_dat02_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, CAST(date_diff('day', o_orderdate::DATE, DATE '2000-01-01') AS BIGINT) AS days, o_orderdate::DATE > DATE '2000-01-01' AS later FROM orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written as month/day/year, parsed again, and their distance to a day."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", C.day(F.date_format("o_orderdate", "M/d/yyyy")).alias("d"))
    days = F.datediff(F.lit("2000-01-01").cast("date"), F.col("d")).cast("long")
    return rows.select("o_orderkey", F.date_format("d", "yyyy-MM").alias("month"), days.alias("days"), (days < 0).alias("later"))


@query("agg33_monthly_counts", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("win05_date_cutoffs", "WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) / sum(n) OVER () AS share FROM d) SELECT min(day) FILTER (WHERE share >= 0.70) AS train_end, min(day) FILTER (WHERE share >= 0.85) AS validation_end FROM c")
def date_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    share = F.sum("n").over(Window.orderBy("day")) / F.sum("n").over(Window.partitionBy())
    return days.select("day", share.alias("share")).agg(F.min(F.when(F.col("share") >= 0.70, F.col("day"))).alias("train_end"), F.min(F.when(F.col("share") >= 0.85, F.col("day"))).alias("validation_end"))


@query("agg11_credit_profile", "SELECT c_mktsegment AS grade, count(*) AS n, count(*) FILTER (WHERE c_acctbal IS NULL) AS nulls, round(min(c_acctbal), 2) AS least, round(median(c_acctbal), 4) AS median, round(max(c_acctbal), 2) AS most, count(*) FILTER (WHERE c_acctbal < 0) AS negative, round(corr(c_acctbal, c_nationkey), 6) AS correlation FROM customer GROUP BY 1")
def credit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, rows = F.col("c_acctbal"), table(spark, sf_dir, "customer")
    medians = [F.when(F.col("grade") == k, F.lit(v).cast("double")) for k, (v,) in quantiles(rows, "c_acctbal", [0.5], "c_mktsegment").items()]
    median = F.round(F.coalesce(*medians, F.lit(None).cast("double")), 4).alias("median")
    found = rows.groupBy(F.col("c_mktsegment").alias("grade")).agg(F.count("*").alias("n"), F.count_if(c.isNull()).alias("nulls"), F.round(F.min(c), 2).alias("least"), F.round(F.max(c), 2).alias("most"), F.count_if(c < 0).alias("negative"), F.round(F.corr(c, F.col("c_nationkey").cast("double")), 6).alias("correlation"))
    return found.withColumn("median", median)


@query("agg35_reference_values", "SELECT median(c_acctbal) AS balance, (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS segment FROM customer")
def reference_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    counts = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    (median,) = quantiles(rows, "c_acctbal", [0.5])[None]
    return counts.agg(F.lit(median).cast("double").alias("balance"), F.min(F.struct((-F.col("n")).alias("n"), "c_mktsegment"))["c_mktsegment"].alias("segment"))


@query("agg08_contingency", f"WITH {TX} SELECT isFraud, (amount > oldbalanceOrg)::INT AS flagged, count(*) AS n, round(avg(amount), 4) AS mean, min(amount) AS least, max(amount) AS most FROM tx GROUP BY 1, 2")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = (F.col("amount") > F.col("oldbalanceOrg")).cast("int")
    return transactions(spark, sf_dir).groupBy("isFraud", flagged.alias("flagged")).agg(F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean"), F.min("amount").alias("least"), F.max("amount").alias("most"))


PROFILED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg07_numeric_ranges", " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) FILTER (WHERE {c} < 0) AS negative, min({c}) AS least, max({c}) AS most FROM lineitem" for c in PROFILED))
def numeric_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide aggregate, then a row per column."""
    parts = [F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c) < 0).alias("negative"), F.min(c).alias("least"), F.max(c).alias("most")) for c in PROFILED]
    return table(spark, sf_dir, "lineitem").agg(F.array(*parts).alias("p")).select(F.inline("p"))


@query("ord04_top_counters", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


def table_digest(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row: a digest of all rows in a total order.

    Rows are dealt to ranges of the order, each range to blocks of ``DIGESTED`` rows by rank; a block's digest is that of its lines,
    a level's digests are the lines of the next, until one is left. So no task joins more than a block.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\\N")) for c in rows.columns])
    level = running(rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)], line.alias("line"), F.lit(1).alias("one")), [F.col(f"k{i}") for i in range(len(order))], ["one"])
    level = level.select(F.col("before_one").alias("place"), "line")
    while True:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
        level = stored(level.groupBy(F.floor(F.col("place") / DIGESTED).alias("place")).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("line")), "digests")
        if level.count() <= 1:
            return level.agg(F.coalesce(F.max("line"), F.sha2(F.lit(""), 256)).alias("digest"))


#: Rows whose lines are digested together.
DIGESTED = 1000
_LINE = "concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus, o_orderpriority)"


@query("fpr02_table_digest", f"WITH RECURSIVE l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, {_LINE} AS line FROM orders), up(level, place, line) AS (SELECT 0, place, line FROM l0 UNION ALL SELECT level + 1, place // {DIGESTED}, sha256(string_agg(line, chr(10) ORDER BY place)) FROM up WHERE (SELECT count(*) FROM up) > 1 OR level = 0 GROUP BY level, place // {DIGESTED}) SELECT arg_max(line, level) AS digest FROM up WHERE place = 0")
def orders_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_digest(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


def ids_sha256(ids: list[int]) -> str:
    """Digest of chosen row ids as little-endian 64-bit numbers, in the order given."""
    import hashlib

    return hashlib.sha256(b"".join(i.to_bytes(8, "little", signed=True) for i in ids)).hexdigest()


@query("agg10_text_coverage", r"WITH d AS (SELECT lang, source, text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS words FROM documents), t AS (SELECT count(*) AS n, count(*) FILTER (WHERE words > 0) AS with_text, min(words) AS least_words, max(words) AS most_words, quantile_cont(words, 0.5) AS median_words, count(DISTINCT text) AS distinct_texts FROM d), s AS (SELECT source, count(*) AS c FROM d GROUP BY source ORDER BY c DESC, source LIMIT 10), l AS (SELECT lang, count(*) AS c FROM d GROUP BY lang ORDER BY c DESC, lang LIMIT 10) SELECT n, with_text, round(with_text / n, 6) AS coverage, CAST(least_words AS BIGINT) AS least_words, CAST(most_words AS BIGINT) AS most_words, median_words, distinct_texts, (SELECT string_agg(source || '=' || c, ',' ORDER BY c DESC, source) FROM s) AS top_sources, (SELECT string_agg(lang || '=' || c, ',' ORDER BY c DESC, lang) FROM l) AS top_languages FROM t".replace("\\\\", "\\"))
def text_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, lengths, distinct texts, and the ten most frequent sources and languages."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")).cast("long")
    rows = stored(table(spark, sf_dir, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"), words.alias("words")), "text-profile")
    (median,) = quantiles(rows, "words", [0.5])[None]
    distinct = rows.where("digest is not null").select("digest").distinct().agg(F.count("*").alias("distinct_texts"))

    def top(c: str) -> DataFrame:
        first = rows.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).limit(10)
        return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(c).alias("k")))), lambda x: F.concat_ws("=", x["k"], -x["m"])), ",").alias(f"top_{c}"))

    one = rows.agg(F.count("*").alias("n"), F.count_if(F.col("words") > 0).alias("with_text"), F.min("words").alias("least_words"), F.max("words").alias("most_words")).crossJoin(distinct).crossJoin(top("source")).crossJoin(top("lang"))
    return one.select("n", "with_text", F.round(C.ratio_or_zero(F.col("with_text"), F.col("n")), 6).alias("coverage"), "least_words", "most_words", F.lit(median).cast("double").alias("median_words"), "distinct_texts", F.col("top_source").alias("top_sources"), F.col("top_lang").alias("top_languages"))
