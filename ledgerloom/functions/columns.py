"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of redactions in complaint texts.
AMOUNT = r"(?U)\{\$[\d,]*\.?\d+\}"
DATE = r"(?U)(?<![\w/])(?=[X\d/]*X)[X\d]{2,4}/[X\d]{2,4}/[X\d]{2,4}(?![\w/])"
RUN = r"(?<![A-Za-z])[Xx]{2,}(?![a-z])"
RESIDUAL = r"(?<![a-z])x{2,}(?![a-z])"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return c.isNull() | (trimmed(c) == "")


def filled(c: Column) -> Column:
    """The trimmed text, null if nothing is left."""
    return F.nullif(trimmed(c), F.lit(""))


def number(c: Column) -> Column:
    """A finite double, or null for anything that isn't one."""
    value = F.when(c.rlike(NUMBER), c).try_cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def signed_log(c: Column) -> Column:
    return F.signum(c) * F.log1p(F.abs(c))


def log_of_positive(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def partition_of(step: Column, cuts: tuple[int, int, int]) -> Column:
    """train, validation, test or stress by the last steps of the first three."""
    return F.when(step <= cuts[0], "train").when(step <= cuts[1], "validation").when(step <= cuts[2], "test").otherwise("stress")


def bin_label(value: Column, edges: Column) -> Column:
    """b and the number of edges below the value: intervals that are closed on the right."""
    return F.concat(F.lit("b"), F.size(F.filter(edges, lambda e: e < value)))


def bin_left(value: Column, edges: Column) -> Column:
    """The number of edges at or below the value: intervals that are closed on the left."""
    return F.size(F.filter(edges, lambda e: e <= value))


def interior_edges(quantiles: Column, least: Column, most: Column) -> Column:
    """Quantiles that rise strictly and lie inside (least, most)."""
    return F.array_distinct(F.filter(quantiles, lambda e: (e > least) & (e < most)))


def masked(text: Column) -> tuple[Column, Column]:
    """A text with amounts, redacted dates and runs masked, and how many there were."""
    one = F.regexp_replace(text, AMOUNT, "<monto>")
    two = F.regexp_replace(one, DATE, "<fecha>")
    three = F.regexp_replace(two, RUN, "<censurado>")
    return three, F.regexp_count(text, F.lit(AMOUNT)) + F.regexp_count(one, F.lit(DATE)) + F.regexp_count(two, F.lit(RUN))


def clean_narrative(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(masked(text)[0], r"(?U)\s+", " "), "^ | $", ""))


def day(c: Column) -> Column:
    """A date written month/day/year or year-month-day; null for others."""
    return F.coalesce(F.try_to_timestamp(c, F.lit("M/d/yyyy")).cast("date"), F.try_to_timestamp(c, F.lit("yyyy-M-d")).cast("date"))


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.left(text, F.lit(n))), F.lit("…"))).otherwise(text)


def fan_type(account: Column) -> Column:
    return F.when(account.startswith("M"), "merchant").otherwise("client")
