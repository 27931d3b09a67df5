"""Complaints: from raw strings to typed rows with reasons, keep-first, flags, masked narratives and the checks of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators.validation import keep_first
from ledgerloom.plans.catalog import query
from ledgerloom.sources.adapters import table

#: Texts that are kept trimmed, and those that are null if blank.
TRIMMED = ["product", "issue", "company", "company_response_to_consumer", "submitted_via"]
OPTIONAL = ["sub_product", "sub_issue", "company_public_response", "state", "consumer_consent_provided"]
ZIP = r"^(\d{5}|\d{3}[Xx]{2})$"


def yes_no(c: Column) -> Column:
    """true for Yes, false for No, null for anything else."""
    return F.when(C.trimmed(c) == "Yes", True).when(C.trimmed(c) == "No", False)


def reasons(rows: DataFrame) -> Column:
    """Why a raw row is refused, joined by commas; empty if it isn't. The names of the reasons."""
    id_, received = F.col("complaint_id"), F.col("date_received")
    return F.concat_ws(
        ",",
        F.when(C.blank(id_), "missing:complaint_id"),
        F.when(~C.blank(id_) & ~C.trimmed(id_).rlike(r"^\d+$"), "invalid:complaint_id"),
        F.when(C.blank(received), "missing:date_received"),
        F.when(~C.blank(received) & C.day(C.trimmed(received)).isNull(), "invalid:date_received"),
        F.when(C.blank(F.col("product")), "missing:product"),
    )


def silver(bronze: DataFrame) -> DataFrame:
    """Typed rows of raw ones with ``bronze_row``, their order: refused ones go, the first of an id stays, 28 columns come out.

    Whether a narrative repeats is joined by its digest; rows without one aren't joined.
    """
    valid = bronze.where(reasons(bronze) == "").withColumn("complaint_id", C.trimmed(F.col("complaint_id")).cast("long"))
    unique = keep_first(valid, ["complaint_id"], ["bronze_row"])
    received, sent = (C.day(C.trimmed(F.col(c))) for c in ("date_received", "date_sent_to_company"))
    days, zipcode, narrative = F.datediff(sent, received), C.filled(F.col("zipcode")), C.filled(F.col("consumer_complaint_narrative"))
    clean, tags = C.clean_narrative(narrative), F.coalesce("tags", F.lit(""))
    out = unique.select(
        F.col("bronze_row").cast("long").alias("row_id"), "complaint_id", received.alias("date_received"), sent.alias("date_sent_to_company"), days.alias("days_to_send"), F.coalesce(days < 0, F.lit(False)).alias("sent_before_received"),
        *[C.trimmed(F.col(c)).alias(c) for c in TRIMMED], *[C.filled(F.col(c)).alias(c) for c in OPTIONAL],
        zipcode.alias("zipcode"), F.coalesce(zipcode.rlike(ZIP), F.lit(False)).alias("zipcode_format_valid"), yes_no(F.col("timely_response")).alias("timely_response"), yes_no(F.col("consumer_disputed?")).alias("consumer_disputed"),
        tags.contains("Older American").alias("is_older_american"), tags.contains("Servicemember").alias("is_servicemember"), narrative.isNotNull().alias("has_narrative"), narrative.alias("narrative"), clean.alias("narrative_clean"),
        F.coalesce(C.masked(narrative)[1], F.lit(0)).cast("long").alias("redaction_count"), F.coalesce(F.size(F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")), F.lit(0)).cast("long").alias("clean_word_count"),
    )
    out = out.withColumn("clean_word_count", F.greatest("clean_word_count", F.lit(0)))
    repeated = out.where("has_narrative").groupBy(F.sha2("narrative", 256).alias("digest")).agg((F.count("*") > 1).alias("narrative_is_repeated")).where("narrative_is_repeated")
    return out.withColumn("digest", F.sha2("narrative", 256)).join(repeated, "digest", "left").drop("digest").withColumn("narrative_is_repeated", F.coalesce("narrative_is_repeated", F.lit(False)))


def accounting(bronze: DataFrame, result: DataFrame) -> DataFrame:
    """The names of the counts. One row of counts and checks: rows and narratives in and out, counts by reason as a map, unique ids, no redaction left."""
    parts = F.split(reasons(bronze), ",")
    by_reason = bronze.select(F.explode(parts).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))
    # At most as many entries as there are reasons.
    listed = by_reason.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reject_reasons"))
    raw = bronze.agg(F.count("*").alias("bronze_rows"), F.count_if(reasons(bronze) != "").alias("rejected_rows"), F.count_if(~C.blank(F.col("consumer_complaint_narrative"))).alias("bronze_narratives"))
    done = result.agg(
        F.count("*").alias("silver_rows"), F.count_distinct("complaint_id").alias("ids"), F.count_distinct("row_id").alias("rows"), F.count_if("has_narrative").alias("silver_narratives"), F.count_if("sent_before_received").alias("sent_before_received"),
        F.count_if(F.col("date_sent_to_company").isNull()).alias("sent_date_unparseable"), F.count_if(F.col("zipcode").isNotNull() & ~F.col("zipcode_format_valid")).alias("zipcode_format_invalid"), F.count_if("narrative_is_repeated").alias("repeated_narratives"),
        F.coalesce(F.sum("redaction_count"), F.lit(0)).alias("redactions_total"), F.count_if(F.coalesce(F.col("narrative_clean").rlike(C.RESIDUAL), F.lit(False))).alias("residual_redactions"),
    )
    one = raw.crossJoin(done).crossJoin(listed)  # a row each
    removed = F.col("bronze_rows") - F.col("rejected_rows") - F.col("silver_rows")
    return one.withColumn("duplicate_ids_removed", removed).withColumns({"complaint_ids_unique": F.col("ids") == F.col("silver_rows"), "row_ids_unique": F.col("rows") == F.col("silver_rows"), "no_residual_redaction": F.col("residual_redactions") == 0}).drop("ids", "rows", "residual_redactions")


#: Documents as raw complaints, in Spark SQL and DuckDB alike: blank, wrong and repeated ids, dates of both forms and wrong ones, tags, postcodes.
RAW = {
    "bronze_row": "doc_id",
    "complaint_id": "CASE WHEN doc_id % 50 = 0 THEN ' ' WHEN doc_id % 50 = 1 THEN 'x7' WHEN doc_id % 40 = 3 THEN CAST(doc_id - 3 AS {text}) ELSE concat(' ', CAST(doc_id AS {text})) END",
    "date_received": "CASE WHEN doc_id % 61 = 5 THEN '13/45/2015' WHEN doc_id % 3 = 0 THEN concat('2015-0', CAST(doc_id % 9 + 1 AS {text}), '-1', CAST(doc_id % 10 AS {text})) ELSE concat('0', CAST(doc_id % 9 + 1 AS {text}), '/1', CAST(doc_id % 10 AS {text}), '/2015') END",
    "date_sent_to_company": "CASE WHEN doc_id % 13 = 0 THEN 'soon' ELSE concat('0', CAST(doc_id % 9 + 1 AS {text}), '/1', CAST(doc_id % 7 AS {text}), '/2015') END",
    "product": "source", "issue": "concat(' ', lang)", "company": "'A Bank '", "company_response_to_consumer": "'Closed'", "submitted_via": "'Web'",
    "sub_product": "CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE 'Card' END", "sub_issue": "''", "company_public_response": "CASE WHEN doc_id % 2 = 0 THEN 'None' END", "state": "' CA'", "consumer_consent_provided": "'N/A'",
    "zipcode": "CASE doc_id % 5 WHEN 0 THEN '90210' WHEN 1 THEN '902XX' WHEN 2 THEN '9021' WHEN 3 THEN ' ' ELSE '90210-1' END",
    "timely_response": "CASE doc_id % 3 WHEN 0 THEN 'Yes ' WHEN 1 THEN 'No' ELSE 'n/a' END", "`consumer_disputed?`": "CASE WHEN doc_id % 2 = 0 THEN 'No' ELSE '' END",
    "tags": "CASE doc_id % 4 WHEN 0 THEN 'Older American, Servicemember' WHEN 1 THEN 'Servicemember' WHEN 2 THEN 'Older American' END", "consumer_complaint_narrative": "CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE text END",
}


def bronze_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{x.replace('{text}', 'STRING')} AS {name}" for name, x in RAW.items()])


_RAW = "raw AS (SELECT " + ", ".join(f"{x.replace('{text}', 'VARCHAR')} AS {name.replace('`', chr(34))}" for name, x in RAW.items()) + " FROM documents)"
_DAY = "coalesce(try_strptime(trim({0}), '%m/%d/%Y'), try_strptime(trim({0}), '%Y-%m-%d'))::DATE"
_BAD = f"concat_ws(',', CASE WHEN trim(complaint_id) = '' THEN 'missing:complaint_id' END, CASE WHEN trim(complaint_id) <> '' AND NOT regexp_full_match(trim(complaint_id), '[0-9]+') THEN 'invalid:complaint_id' END, CASE WHEN trim(coalesce(date_received, '')) = '' THEN 'missing:date_received' END, CASE WHEN {_DAY.format('date_received')} IS NULL THEN 'invalid:date_received' END, CASE WHEN trim(coalesce(product, '')) = '' THEN 'missing:product' END)"
SILVER = f"""{_RAW}, v AS (SELECT *, trim(complaint_id)::BIGINT AS cid FROM raw WHERE {_BAD} = ''), u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY bronze_row) AS k FROM v) t WHERE k = 1),
s AS (SELECT bronze_row AS row_id, cid AS complaint_id, {_DAY.format('date_received')} AS date_received, {_DAY.format('date_sent_to_company')} AS date_sent_to_company, CAST(date_diff('day', {_DAY.format('date_received')}, {_DAY.format('date_sent_to_company')}) AS INT) AS days_to_send, {", ".join(f"trim({c}) AS {c}" for c in TRIMMED)}, {", ".join(f"nullif(trim({c}), '') AS {c}" for c in [*OPTIONAL, "zipcode"])}, coalesce(regexp_full_match(nullif(trim(zipcode), ''), '[0-9]{{5}}|[0-9]{{3}}[Xx]{{2}}'), false) AS zipcode_format_valid,
 CASE trim(timely_response) WHEN 'Yes' THEN true WHEN 'No' THEN false END AS timely_response, CASE trim("consumer_disputed?") WHEN 'Yes' THEN true WHEN 'No' THEN false END AS consumer_disputed, coalesce(contains(tags, 'Older American'), false) AS is_older_american, coalesce(contains(tags, 'Servicemember'), false) AS is_servicemember, nullif(regexp_replace(consumer_complaint_narrative, '^\\s+|\\s+$', '', 'g'), '') AS n FROM u)"""
SHOWN = ["row_id", "complaint_id", "date_received", "date_sent_to_company", "days_to_send", *TRIMMED, *OPTIONAL, "zipcode", "zipcode_format_valid", "timely_response", "consumer_disputed", "is_older_american", "is_servicemember"]


@query("prj12_str03_map01_complaints", f"WITH {SILVER} SELECT {', '.join(SHOWN)}, coalesce(days_to_send < 0, false) AS sent_before_received, n IS NOT NULL AS has_narrative, n IS NOT NULL AND count(*) OVER (PARTITION BY n) > 1 AS narrative_is_repeated FROM s")
def complaint_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the narrative's texts, whose goldens tests hold, as DuckDB has no look-behind."""
    return silver(bronze_of(spark, sf_dir)).select(*SHOWN, "sent_before_received", "has_narrative", "narrative_is_repeated")


@query("drv04_map02_str09_complaint_accounting", f"WITH {SILVER}, r AS (SELECT unnest(string_split({_BAD}, ',')) AS reason FROM raw) SELECT (SELECT count(*) FROM raw) AS bronze_rows, (SELECT count(*) FROM raw WHERE {_BAD} <> '') AS rejected_rows, count(*) AS silver_rows, (SELECT count(*) FROM v) - count(*) AS duplicate_ids_removed, (SELECT string_agg(reason || '=' || c, ',' ORDER BY reason) FROM (SELECT reason, count(*) AS c FROM r WHERE reason <> '' GROUP BY reason) g) AS reject_reasons, count(n) AS silver_narratives, count(*) FILTER (WHERE date_sent_to_company IS NULL) AS sent_date_unparseable, count(*) FILTER (WHERE zipcode IS NOT NULL AND NOT zipcode_format_valid) AS zipcode_format_invalid, true AS complaint_ids_unique, true AS row_ids_unique, true AS no_residual_redaction FROM s")
def complaint_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze = bronze_of(spark, sf_dir)
    found = accounting(bronze, silver(bronze))
    entries = F.array_join(F.transform(F.map_entries("reject_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("bronze_rows", "rejected_rows", "silver_rows", "duplicate_ids_removed", entries.alias("reject_reasons"), "silver_narratives", "sent_date_unparseable", "zipcode_format_invalid", "complaint_ids_unique", "row_ids_unique", "no_residual_redaction")


def profile(bronze: DataFrame) -> DataFrame:
    """(kind, key, rows, share, narratives, coverage) of the rows without an issue: by product and by year of receipt."""
    valid = bronze.where(reasons(bronze) == "")
    told = (~C.blank(F.col("consumer_complaint_narrative"))).alias("told")
    year = F.year(C.day(C.trimmed(F.col("date_received")))).cast("string")
    keyed = valid.select(told, F.inline(F.array(F.struct(F.lit("product").alias("kind"), C.trimmed(F.col("product")).alias("key")), F.struct(F.lit("year").alias("kind"), year.alias("key")))))
    sums = keyed.groupBy("kind", "key").agg(F.count("*").alias("rows"), F.count_if("told").alias("narratives"))
    whole = F.broadcast(valid.agg(F.count("*").alias("all_")))  # one row
    rounded = lambda a, b: F.round(C.ratio_or_zero(a, b), 6)
    return sums.crossJoin(whole).select("kind", "key", "rows", rounded(F.col("rows"), F.col("all_")).alias("share"), "narratives", rounded(F.col("narratives"), F.col("rows")).alias("coverage"))


@query(
    "agg10_profile_by_product_and_year",
    f"WITH {SILVER}, k AS (SELECT 'product' AS kind, trim(product) AS key, trim(coalesce(consumer_complaint_narrative, '')) <> '' AS told FROM v UNION ALL SELECT 'year', year({_DAY.format('date_received')})::VARCHAR, trim(coalesce(consumer_complaint_narrative, '')) <> '' FROM v) SELECT kind, key, count(*) AS rows, round(count(*) / (SELECT count(*) FROM v), 6) AS share, count(*) FILTER (WHERE told) AS narratives, round(count(*) FILTER (WHERE told) / count(*), 6) AS coverage FROM k GROUP BY 1, 2",
)
def complaint_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(bronze_of(spark, sf_dir))
