"""Quality rules: word counts, and divergence from language references, DataFrame functions only.

A document's histograms of character classes and of common words are compared
with those of each reference language by Jensen-Shannon distance. References are
summed over all documents of a language that pass the base rule: one of character classes for every language
that has enough words, one of common words for those whose common words are listed. A document is
rejected if even the nearest language is far, by either histogram; short ones are not
judged, as their histograms are noise, and neither are documents by a histogram of which their language has no reference.

Cases: a null text has no words and fails the base rule; documents without a
language take part in everything but the references, and are held against all of them; without references nothing is
judged by divergence; a very long text is one row like any other; repeated rows each get
their result; an empty table gives an empty result. Repeated windows are found by 64-bit
hashes of their words, so two windows are taken for equal wrongly with a chance of about
n * n / 2^65 for n words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import SPACE, SPACE_CHARS, shared_table

#: Common words of each language, which are the bins of its word histogram.
COMMON_WORDS = {
    "de": "aber als auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht sich sie sind und von war werden wie zu".split(),
    "en": "a and are as at be by for from had have he his in is it not of on or that the this to was which with you".split(),
    "es": "a al como con de del el en es este ha la las lo los más no para pero por que se sin su sus un una y".split(),
    "fr": "a au aux avec ce cette dans de des du elle en est et il la le les mais ne ou par pas pour que qui se sur un une".split(),
}
#: Words that a document needs before its divergence is judged.
LEAST_WORDS = 60
#: Words of its documents that a language needs for a reference, and languages, those of most words, that have one at most.
LEAST_REFERENCE, REFERENCES = 1_000, 64
#: Largest Jensen-Shannon distances, on a scale to 1, to the nearest language: a limit for long
#: documents, and what the noise of short ones adds, times the inverse root of their words.
CHARACTER_DISTANCE = (0.16, 0.75)
WORD_DISTANCE = (0.2, 1.1)
WINDOW = 8
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()"


def words_of(text: Column) -> Column:
    """Words between ASCII white space; none of a null text."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def repeated_starts(pairs: Column) -> Column:
    """Starts, in order, of windows whose hash occurs twice or more; from (h, i) pairs sorted by hash."""
    twice = F.filter(pairs, lambda p, k: ((k > 0) & (F.get(pairs, k - 1)["h"] == p["h"])) | (F.get(pairs, k + 1)["h"] == p["h"]))
    return F.array_sort(F.transform(twice, lambda p: p["i"]))


def covered(starts: Column) -> Column:
    """Words that windows at these sorted starts cover: each adds its length, or the step to the next if that is shorter."""
    later = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2**30)))
    steps = F.zip_with(starts, later, lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, languages: dict[str, list[str]]) -> DataFrame:
    """Counts and histograms of each document, one pass over the texts without a shuffle."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"))
    rows = rows.select("*", words_of(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    lines = F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    rows = rows.withColumn("lines", lines).withColumn("n_words", F.size("words"))
    # Hashes of words, then of pairs, of four and of eight words: three steps for a window of eight.
    steps = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("h1", steps)
    for at, n in (("h1", 1), ("h2", 2), ("h4", 4)):
        longer = F.zip_with(F.col(at), F.slice(F.col(at), n + 1, F.greatest(F.size(at) - n, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
        rows = rows.withColumn(f"h{2 * n}", F.slice(longer, 1, F.greatest(F.size(at) - n, F.lit(0))))
    rows = rows.withColumn("again", F.size("h8") > F.size(F.array_distinct("h8")))
    indexed = F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__pairs", F.when(F.col("again"), indexed))
    rows = rows.withColumn("starts", F.when(F.col("again"), repeated_starts(F.col("__pairs"))))
    # Character classes, each counted on what the classes before it leave over.
    rows = rows.withColumn("rest1", removed(F.col("text"), "[a-z]+")).withColumn("rest2", removed(F.col("rest1"), SPACE + "+"))
    rows = rows.withColumn("rest3", removed(F.col("rest2"), "[A-Z]+")).withColumn("rest4", removed(F.col("rest3"), r"[.,;:!?\"'()-]+"))
    rows = rows.withColumn("rest5", removed(F.col("rest4"), "[0-9]+")).withColumn("rest6", removed(F.col("rest5"), r"\p{L}+"))
    stages = [F.length(c) for c in ("text", "rest1", "rest2", "rest3", "rest4", "rest5", "rest6")]
    classes = F.array(*[(a - b).cast("double") for a, b in zip(stages, stages[1:], strict=False)], stages[-1].cast("double"))
    listed = sorted({w for ws in languages.values() for w in ws})
    if len(listed) > 127:
        raise ValueError("127 common words at most")
    # Common words as one byte each, so that counting them is a pass over few bytes.
    code = F.create_map(*[x for i, w in enumerate(listed) for x in (F.lit(w), F.lit(chr(1 + i)))])
    common = F.filter(F.transform("words", lambda w: F.rtrim(F.lower(w), F.lit(PUNCTUATION))), lambda w: w.isin(listed))
    rows = rows.withColumn("common", F.array_join(F.transform(common, lambda w: F.element_at(code, w)), ""))
    times = [(F.octet_length("common") - F.octet_length(F.replace("common", F.lit(chr(1 + i)), F.lit("")))).cast("double") for i in range(len(listed))]
    return rows.select(
        "id",
        "lang",
        F.col("n_words").cast("long").alias("n_words"),
        # White space is the second class to go, so words are what is left without it.
        (F.length("text") - (stages[1] - stages[2])).cast("long").alias("word_chars"),
        F.length(removed(F.col("rest2"), r"[^#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered(F.col("starts"))).otherwise(0).cast("long").alias("n_repeat_words"),
        classes.alias("classes"),
        F.array(*times).alias("times"),
    )


def divergence(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two histograms (arrays of shares), by logarithms to base 2, so at most 1."""

    def half(x: Column, mean: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mean)).otherwise(0.0)

    terms = F.zip_with(a, b, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda total, t: total + t) / 2, F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", languages: dict[str, list[str]] | None = None) -> DataFrame:
    """Per document: base counts and verdict, distances to the nearest language, whether it is kept."""
    languages = COMMON_WORDS if languages is None else languages
    listed = sorted({w for ws in languages.values() for w in ws})
    stored = shared_table(measured(docs, id_col, text_col, lang_col, languages), "quality-counts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    sums = [F.sum(F.get("classes", i)).alias(f"c{i}") for i in range(7)] + [F.sum(F.get("times", i)).alias(f"w{i}") for i in range(len(listed))]
    # One row of a few hundred sums for each reference.
    found = stored.where(~failed & F.col("lang").isNotNull()).groupBy("lang").agg(F.sum("n_words").alias("n"), *sums)
    rows = found.where(F.col("n") >= LEAST_REFERENCE).orderBy(F.desc("n"), "lang").limit(REFERENCES).collect()
    characters, common, listed_languages = [], [], []
    for r in sorted(rows, key=lambda r: r["lang"]):
        reference = [r[f"c{i}"] for i in range(7)]
        characters.append(divergence(shares(F.col("classes")), F.array(*[F.lit(x / sum(reference)) for x in reference])))
        if r["lang"] not in languages:
            continue
        listed_languages.append(r["lang"])
        own = [listed.index(w) for w in languages[r["lang"]]]
        # Bins of its own common words, and one of all others.
        counts = [r[f"w{i}"] for i in own]
        expected = F.array(*[F.lit(x / r["n"]) for x in counts], F.lit(1 - sum(counts) / r["n"]))
        mine = F.transform(F.array(*[F.get("times", i) for i in own]), lambda x: x / F.greatest(F.col("n_words"), F.lit(1)))
        others = 1 - F.aggregate(mine, F.lit(0.0), lambda s, x: s + x)
        common.append(divergence(F.concat(mine, F.array(F.greatest(others, F.lit(0.0)))), expected))
    nearest = lambda found: F.round(F.least(*found, F.lit(1.0)), 6) if found else F.lit(0.0)
    result = stored.withColumn("base_failed", failed).withColumn("char_distance", nearest(characters)).withColumn("word_distance", nearest(common))
    limits = [low + noise / F.sqrt(F.greatest(F.col("n_words"), F.lit(1))) for low, noise in (CHARACTER_DISTANCE, WORD_DISTANCE)]
    known = [F.col("lang").isNull() | F.col("lang").isin(names) for names in ([r["lang"] for r in rows], listed_languages)]
    far = (F.col("n_words") >= LEAST_WORDS) & ((known[0] & (F.col("char_distance") > limits[0])) | (known[1] & (F.col("word_distance") > limits[1])))
    return result.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance"
    )
