"""Credit applications: refusal, duplicates, derived columns, model frames, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.contracts import asserted, finite
from ledgerloom.operators.validation import CREDIT_CATEGORIES, credit_reason, keep_first
from ledgerloom.plans.catalog import query
from ledgerloom.sources.adapters import table

#: The raw columns, and what each model frame takes of them.
RAW_COLUMNS = ["person_age", "person_income", "person_home_ownership", "person_emp_length", "loan_intent", "loan_grade", "loan_amnt", "loan_int_rate", "loan_status", "loan_percent_income", "cb_person_default_on_file", "cb_person_cred_hist_length"]
APPLICATION = ["person_age", "person_income", "person_emp_length", "loan_amnt", "loan_percent_income", "cb_person_cred_hist_length", "person_home_ownership", "loan_intent", "cb_person_default_on_file"]
FEATURE_SETS = {"application": APPLICATION, "with_pricing": [*APPLICATION, "loan_int_rate", "loan_grade"]}


def reason_of(rows: DataFrame):
    """The first reason why an application can't be used; null if it can."""
    age, income, amount, employment, history, label = (F.col(c) for c in ("person_age", "person_income", "loan_amnt", "person_emp_length", "cb_person_cred_hist_length", "loan_status"))
    return credit_reason(age, income, amount, employment, history, label, {c: F.col(c) for c in CREDIT_CATEGORIES})


def transformed(bronze: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(silver, rejected) of raw rows with ``bronze_row``: of equal valid rows the first stays; the ratio is computed anew after that, missing values are marked."""
    reason = reason_of(bronze)
    rejected = bronze.withColumn("reject_reason", reason).where("reject_reason is not null")
    # Null values of a key are grouped like others, so equal rows with nulls are found, too.
    unique = keep_first(bronze.where(reason.isNull()), RAW_COLUMNS, ["bronze_row"])
    silver = unique.withColumns({"loan_percent_income": F.col("loan_amnt") / F.col("person_income"), "emp_length_missing": F.col("person_emp_length").isNull(), "int_rate_missing": F.col("loan_int_rate").isNull(), "row_id": F.col("bronze_row").cast("long")})
    return silver.select("row_id", *RAW_COLUMNS, "emp_length_missing", "int_rate_missing"), rejected


def accounting(bronze: DataFrame) -> DataFrame:
    """One row: rows in, refused, removed as duplicates, and out."""
    silver, rejected = transformed(bronze)
    one = bronze.agg(F.count("*").alias("bronze_rows")).crossJoin(rejected.agg(F.count("*").alias("rejected_rows"))).crossJoin(silver.agg(F.count("*").alias("silver_rows")))
    return one.withColumn("exact_duplicates_removed", F.col("bronze_rows") - F.col("rejected_rows") - F.col("silver_rows"))


def model_frame(rows: DataFrame, feature_set: str = "application") -> DataFrame:
    """The columns of a feature set in order, numbers as doubles, the ratio derived where it is not given; raises on values outside the domain. Labels are not used."""
    columns = FEATURE_SETS[feature_set]
    if "loan_percent_income" not in rows.columns and {"loan_amnt", "person_income"} <= set(rows.columns):
        rows = rows.withColumn("loan_percent_income", F.try_divide(F.col("loan_amnt").cast("double"), F.col("person_income").cast("double")))
    rules = {f"{c} is above 0": finite(c) & (F.col(c).try_cast("double") > 0) for c in ("person_income", "loan_amnt", "person_age")}
    rules |= {f"{c} is known": F.col(c).isin(CREDIT_CATEGORIES[c]) for c in columns if c in CREDIT_CATEGORIES}
    asserted(rows, rules if set(columns) <= set(rows.columns) else {}, columns)
    return rows.select(*[F.col(c) if c in CREDIT_CATEGORIES else F.col(c).cast("double").alias(c) for c in columns])


#: Customers as applications, in Spark SQL and DuckDB alike: some of each reason, and each hundredth row twice.
RAW = {
    "person_age": "CAST(16 + c_custkey % 89 AS INT)", "person_income": "CAST(c_acctbal * 10 AS DOUBLE)", "person_home_ownership": "CASE c_custkey % 4 WHEN 0 THEN 'RENT' WHEN 1 THEN 'OWN' WHEN 2 THEN 'MORTGAGE' ELSE 'OTHER' END",
    "person_emp_length": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey % 50 AS DOUBLE) END", "loan_intent": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'UNKNOWN' WHEN c_custkey % 2 = 0 THEN 'MEDICAL' ELSE 'VENTURE' END", "loan_grade": "CASE c_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END",
    "loan_amnt": "CAST(1000 * (c_custkey % 30) AS DOUBLE)", "loan_int_rate": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 5.5 + c_nationkey END", "loan_status": "CAST(CASE WHEN c_custkey % 97 = 0 THEN 2 ELSE c_custkey % 2 END AS INT)", "loan_percent_income": "0.1", "cb_person_default_on_file": "CASE WHEN c_nationkey < 5 THEN 'Y' ELSE 'N' END", "cb_person_cred_hist_length": "c_nationkey",
}


def bronze_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = [f"{x} AS {c}" for c, x in RAW.items()]
    rows = table(spark, sf_dir, "customer")
    return rows.selectExpr("c_custkey AS bronze_row", *listed).union(rows.where("c_custkey % 100 = 0").selectExpr("c_custkey + 1000000000 AS bronze_row", *listed))


_LISTED = ", ".join(f"{x} AS {c}" for c, x in RAW.items())
_KNOWN = {c: ", ".join(f"'{v}'" for v in values) for c, values in CREDIT_CATEGORIES.items()}
_REASON = "CASE WHEN loan_status NOT IN (0, 1) THEN 'loan_status_invalid' " + " ".join(f"WHEN {c} NOT IN ({v}) THEN '{c}_unknown_category'" for c, v in _KNOWN.items()) + " WHEN person_age NOT BETWEEN 18 AND 100 THEN 'age_out_of_range' WHEN person_income <= 0 THEN 'income_not_positive' WHEN loan_amnt <= 0 THEN 'loan_amount_not_positive' WHEN person_emp_length > person_age - 14 THEN 'emp_length_impossible' WHEN cb_person_cred_hist_length > person_age - 13 THEN 'credit_history_impossible' END"
SILVER = f"b AS (SELECT c_custkey AS bronze_row, {_LISTED} FROM customer UNION ALL SELECT c_custkey + 1000000000, {_LISTED} FROM customer WHERE c_custkey % 100 = 0), r AS (SELECT *, {_REASON} AS reason FROM b), s AS (SELECT min(bronze_row) AS row_id, {', '.join(RAW_COLUMNS)} FROM r WHERE reason IS NULL GROUP BY {', '.join(RAW_COLUMNS)})"
_OUT = ", ".join("loan_amnt / person_income AS loan_percent_income" if c == "loan_percent_income" else c for c in RAW_COLUMNS)


@query("drv03_credit_silver", f"WITH {SILVER} SELECT row_id, {_OUT.replace('loan_amnt / person_income AS', 'round(loan_amnt / person_income, 9) AS')}, person_emp_length IS NULL AS emp_length_missing, loan_int_rate IS NULL AS int_rate_missing FROM s")
def credit_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transformed(bronze_of(spark, sf_dir))[0].withColumn("loan_percent_income", F.round("loan_percent_income", 9))


@query("drv03_credit_accounting", f"WITH {SILVER} SELECT (SELECT count(*) FROM b) AS bronze_rows, (SELECT count(*) FROM r WHERE reason IS NOT NULL) AS rejected_rows, (SELECT count(*) FROM s) AS silver_rows, (SELECT count(*) FROM r WHERE reason IS NULL) - (SELECT count(*) FROM s) AS exact_duplicates_removed")
def credit_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting(bronze_of(spark, sf_dir))


@query("prj10_credit_model_frame", f"WITH {SILVER}, o AS (SELECT {_OUT} FROM s) SELECT {', '.join(c if c in CREDIT_CATEGORIES else f'round({c}::DOUBLE, 9) AS {c}' for c in FEATURE_SETS['with_pricing'])} FROM o")
def credit_model_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = model_frame(transformed(bronze_of(spark, sf_dir))[0], "with_pricing")
    return frame.select(*[F.col(c) if c in CREDIT_CATEGORIES else F.round(c, 9).alias(c) for c in frame.columns])
