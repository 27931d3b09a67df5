"""Corpus pipeline: toxicity, near-duplicates, secrets, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the columns of documents;
a mixed document stands in as many rows as the mix takes of it. What a stage has stored on its way
is deleted when a later one begins, unless that reads it: by then the result has been written. Nulls,
repeated rows and empty tables are treated as the operators' docstrings say; other columns
of documents, of any name, pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, mixing, near, secrets, toxicity
from ledgerloom.llm._common import discard, free_name, read_table, shared_table
from ledgerloom.plans.stored import discard_unread, tracked

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that earlier stages have stored on their way.
_left: list[DataFrame] = []


def stage(function: Stage) -> Stage:
    """A stage that first deletes what earlier ones have left and its documents don't read."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = discard_unread(spark, _left, docs)
        with tracked() as made:
            found = function(spark, docs, sf_dir)
        _left.extend(made)
        return found

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxic_score")
    return toxicity.with_score(docs, model, "text", score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each class of texts whose five-word shingles are similar by 0.8 or more; one row of it if it is repeated."""
    return near.representatives(docs)


@stage
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask."""
    name = free_name(docs, "masked")
    masked, new = secrets.masked(docs, "text", name), F.col(name)
    columns = [new.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        length = F.when(new.eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length(new).cast("long"))
        columns = [length.alias("n_chars") if c == "n_chars" else x for c, x in zip(docs.columns, columns, strict=True)]
    return masked.select(*columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_rows(docs)


@stage
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, languages and sources with the token ids of the texts."""
    tokens = bpe.with_tokens(docs.select("doc_id", "lang", "source", "text"), "text", "token_ids")
    return tokens.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("source mix", mix_sources),
    ("bpe encoding", encode_tokens),
]

#: SQL can't express these stages; tests compare them with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again before the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for place, (name, stage_) in enumerate(STAGES):
        docs = stage_(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = shared_table(docs, name.replace(" ", "-"))
            if before is not None:
                discard(before)
            before = docs
    return docs
