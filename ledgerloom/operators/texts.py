"""Narratives: projection, eligibility, text models, nearest texts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.functions import columns as C
from ledgerloom.plans.catalog import query
from ledgerloom.plans.stored import stored
from ledgerloom.sources.adapters import table
from ledgerloom.sources.artifacts import without_summary

LEAST_WORDS = 5
WORDS = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))"


def word_count(text):
    return F.size(F.filter(F.split(text, r"[ \t\n\x0b\f\r]+"), lambda w: w != "")).cast("long")


@query("prj12_prj20_narratives", f"SELECT doc_id, CAST({WORDS} AS BIGINT) AS words, {WORDS} >= {LEAST_WORDS} AS eligible, nullif(trim(source), '') AS source, lang = 'en' AS english FROM documents")
def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = word_count(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("words"), (n >= LEAST_WORDS).alias("eligible"), F.nullif(F.trim("source"), F.lit("")).alias("source"), (F.col("lang") == "en").alias("english"))


@query("prj20_exclusions", f"SELECT count(*) AS n, count(*) FILTER (WHERE {WORDS} < {LEAST_WORDS}) AS too_short, count(*) FILTER (WHERE {WORDS} >= {LEAST_WORDS}) AS eligible FROM documents")
def exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = word_count(F.col("text"))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(n < LEAST_WORDS).alias("too_short"), F.count_if(n >= LEAST_WORDS).alias("eligible"))


#: Texts that a term needs, the share of texts that it has at most, terms of the vocabulary, and the smoothing of naive Bayes.
LEAST_TEXTS, MOST_TEXTS, MOST_TERMS, SMOOTHING = 5, 0.9, 100_000, 0.1


TOKEN = r"[\p{L}\p{N}_]{2,}"


def words_of_clean() -> RegexTokenizer:
    return RegexTokenizer(inputCol="clean", outputCol="ones", pattern=TOKEN, gaps=False)


def term_stages(label: str = "lang") -> list:
    """The class as an index; one- and two-grams of the words."""
    twos = "zip_with(slice(ones, 1, greatest(size(ones) - 1, 0)), slice(ones, 2, greatest(size(ones) - 1, 0)), (a, b) -> concat(a, ' ', b))"
    return [
        StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc"),
        SQLTransformer(statement=f"SELECT *, concat(ones, {twos}) AS terms FROM __THIS__"),
    ]


def numbered(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch; of each occurrence the word's number among them and its text; and which of them have a next word in their text."""
    coded = lists.flatten().dictionary_encode()
    text = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), text, np.flatnonzero(text[1:] == text[:-1])


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin in a sorted array."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def term_sums(texts: DataFrame, terms: str, twos: bool = False) -> DataFrame:
    """(term, texts, times) of all terms, with ``twos`` of neighbours (parted by a space), too: tasks count a batch by its terms' numbers, so a row leaves them for each term of a batch, not for each occurrence."""

    def sums(names: pa.Array, codes: np.ndarray, text: np.ndarray) -> pa.RecordBatch:
        n = len(names)
        pairs = np.sort(text * n + codes)
        once = pairs[run_starts(pairs)] % max(n, 1)
        return pa.RecordBatch.from_arrays([names, *(pa.array(np.bincount(x, minlength=n).astype(np.int64)) for x in (once, codes))], ["term", "texts", "times"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, codes, text, first = numbered(batch.column(0))
            yield sums(words, codes, text)
            if twos:
                found, pair = np.unique(codes[first] * len(words) + codes[first + 1], return_inverse=True)
                yield sums(pc.binary_join_element_wise(words.take(pa.array(found // max(len(words), 1))), words.take(pa.array(found % max(len(words), 1))), " "), pair, text[first])

    return texts.select(terms).mapInArrow(count, "term string, texts long, times long").groupBy("term").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))


def vocabulary(texts: DataFrame, terms: str, least: int = LEAST_TEXTS, most: float = MOST_TEXTS, size: int = MOST_TERMS, twos: bool = False) -> DataFrame:
    """(term, texts, times) of the terms, in an array column, of at least ``least`` texts and at most a share ``most`` of them; of more than ``size`` those that occur most, ties in order of the term. With ``twos``, neighbours are terms, too.

    All terms are counted, with and without their repetitions in a text.
    """
    n = texts.count()
    found = stored(term_sums(texts, terms, twos).where((F.col("texts") >= least) & (F.col("texts") <= most * n)), "term-sums")
    # Rows that may be among the first, from a histogram of a few hundred steps; only these are ordered.
    steps = found.groupBy(F.floor(F.log2("times") * 8).alias("step")).agg(F.count("*").alias("terms"), F.min("times").alias("least")).collect()
    held, enough = 0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held, enough = held + r["terms"], r["least"]
        if held >= size:
            break
    return found.where(F.col("times") >= enough).orderBy(F.desc("times"), "term").limit(size)


#: Inverse weights of the logistic candidates.
CS = (1.0, 5.0, 20.0)


def f1_of(counts: list[Row]) -> tuple[float, float]:
    """Accuracy and macro-F1 over the classes that occur, from rows of (label, prediction, count)."""
    true, guess, hit, n = {}, {}, {}, 0
    for r in counts:
        true[r["label"]] = true.get(r["label"], 0) + r["count"]
        guess[r["prediction"]] = guess.get(r["prediction"], 0) + r["count"]
        hit[r["label"]] = hit.get(r["label"], 0) + r["count"] * (r["label"] == r["prediction"])
        n += r["count"]
    return sum(hit.values()) / max(1, n), sum(2 * hit[c] / (true[c] + guess.get(c, 0)) for c in true) / max(1, len(true))


def macro_f1(predicted: DataFrame) -> tuple[float, float]:
    """Accuracy and macro-F1 over the classes that occur."""
    return f1_of(predicted.groupBy("label", "prediction").count().collect())  # at most the square of the classes


def known_terms(train: DataFrame) -> list[str]:
    """One- and two-grams of the words in ``ones`` that count: at most ``MOST_TERMS``, which every task holds; in their order, so that a rerun numbers them alike."""
    return sorted(r["term"] for r in vocabulary(train, "ones", twos=True).select("term").collect()) or ["-"]


def term_vectors(rows: DataFrame, known: list[str]) -> DataFrame:
    """Stored (label, weight, fifth, counts): what ``CountVectorizerModel`` makes of the one- and two-grams of ``ones``, looked up by the words' numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value)
        grams = [t.split(" ") for t in shared.value]
        place = {w: i for i, w in enumerate(dict.fromkeys(w for g in grams for w in g))}
        words, one = pa.array(list(place), pa.string()), np.full(len(place), -1, np.int64)
        for i, g in enumerate(grams):
            if len(g) == 1:
                one[place[g[0]]] = i
        two = np.array(sorted((place[g[0]] * len(place) + place[g[1]], i) for i, g in enumerate(grams) if len(g) == 2), np.int64).reshape(-1, 2)
        two = np.r_[two, [[1 << 62, -1]]]
        for batch in batches:
            found, codes, text, first = numbered(batch.column("ones"))
            at = pc.fill_null(pc.index_in(found, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            pair = np.where((at[first] < 0) | (at[first + 1] < 0), -1, at[first] * len(place) + at[first + 1])
            hit = np.searchsorted(two[:, 0], pair)
            term = np.r_[np.where(at < 0, -1, one[at]), np.where(two[hit, 0] == pair, two[hit, 1], -1)]
            keys = np.sort((np.r_[text, text[first]] * n + term)[term >= 0])
            starts = run_starts(keys)
            ends = pa.array(np.searchsorted(keys[starts] // n, np.arange(batch.num_rows + 1)).astype(np.int32))
            times = np.diff(np.r_[starts, len(keys)]).astype(float)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((keys[starts] % n).astype(np.int32), times)]
            vector = pa.StructArray.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), pa.array(np.full(batch.num_rows, n, np.int32)), *lists], ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("label", "weight", "fifth")), vector], ["label", "weight", "fifth", "counts"])

    kept = "label double, weight double, fifth int"
    made = stored(rows.select("label", "weight", F.col("fifth").cast("int").alias("fifth"), "ones").mapInArrow(count, f"{kept}, counts struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"), "text-counts")
    return rows.sparkSession.read.schema(StructType.fromDDL(kept).add("counts", VectorUDT())).parquet(made.stored_at)  # vectors are stored as such structs


def candidates_of_counts(counted: DataFrame, cs: tuple[float, ...] = CS) -> list[tuple[str, PipelineModel]]:
    """Fitted on stored (label, weight, counts): the most frequent class, naive Bayes on counts, TF-IDF with balanced logistic regression."""
    sizes = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}  # a row a class
    most = min(sizes, key=lambda k: (-sizes[k], k))
    scale = Pipeline(stages=[IDF(inputCol="counts", outputCol="scaled"), Normalizer(inputCol="scaled", outputCol="features")]).fit(counted)
    features = scale.transform(counted)
    fits = [("prior", [SQLTransformer(statement=f"SELECT *, CAST({most} AS DOUBLE) AS prediction FROM __THIS__")]), ("naive_bayes", [NaiveBayes(smoothing=SMOOTHING, featuresCol="counts").fit(counted)])]
    fits += [(f"logistic_{c:g}", [*scale.stages, LogisticRegression(maxIter=30, regParam=1 / (c * max(1, sum(sizes.values()))), weightCol="weight").fit(features)]) for c in cs]
    return [(name, without_summary(PipelineModel(stages=stages))) for name, stages in fits]


def text_candidates(train: DataFrame, cs: tuple[float, ...] = CS) -> list[tuple[str, PipelineModel]]:
    """Fitted pipelines on (clean, label, weight)."""
    words = words_of_clean()
    tokens = Pipeline(stages=term_stages()).fit(train.withColumn("ones", F.array().cast("array<string>")))
    counter = CountVectorizerModel.from_vocabulary(known_terms(words.transform(train)), inputCol="terms", outputCol="counts")
    terms = PipelineModel(stages=[words, *tokens.stages, counter])
    counted = stored(terms.transform(train).select("label", "weight", "counts"), "text-counts")
    return [(name, PipelineModel(stages=[terms, model])) for name, model in candidates_of_counts(counted, cs)]


def predicted_counts(rows: DataFrame, models: list[tuple[str, PipelineModel]], by: str) -> list[Row]:
    """(by, model, label, prediction, count) of all models, by number, from one pass."""
    names = [f"model_{i}" for i in range(len(models))]
    kept = [*rows.columns]
    for name, (_, model) in zip(names, models, strict=True):
        rows = model.transform(rows).withColumnRenamed("prediction", name).select(*kept, name)
        kept.append(name)
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("model"), F.col(name).alias("prediction")) for i, name in enumerate(names)])).alias("x")
    return rows.select(by, "label", every).groupBy(by, "x.model", "label", "x.prediction").count().collect()  # at most the square of the classes for each model


@query("ml07_text_models")
def text_models(spark: SparkSession, sf_dir: str, cs: tuple[float, ...] = CS) -> DataFrame:
    """Candidates fitted on three fifths of the ids by hash; macro-F1 on a fifth chooses, ties for the first; figures on the last fifth.

    Texts are cleaned and cut into words once, and their terms counted once for all models."""
    fifth = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)).alias("fifth")
    # Words of the cleaned text; for them, white space needn't be made even, and a cleaned text is empty if nothing else was in it.
    docs = table(spark, sf_dir, "documents").select("lang", fifth, C.masked(F.col("text"))[0].alias("masked"))
    rows = stored(docs.select("lang", "fifth", F.regexp_extract_all(F.lower("masked"), F.lit(TOKEN), F.lit(0)).alias("ones"), F.col("masked").rlike(r"(?U)\S").alias("eligible")), "text-rows").where("eligible")
    train = rows.where("fifth > 1")
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row a class
    weight = F.coalesce(*[F.when(F.col("lang") == k, sum(sizes.values()) / (len(sizes) * v)) for k, v in sizes.items()], F.lit(1.0))
    rows = rows.where(F.col("lang").isin(*sizes)).withColumn("weight", weight)
    labelled = StringIndexer(inputCol="lang", outputCol="label", stringOrderType="alphabetAsc").fit(train.where("lang is not null")).transform(rows)
    counted = term_vectors(labelled, known_terms(rows.where("fifth > 1")))
    models = candidates_of_counts(counted.where("fifth > 1").drop("fifth"), cs)
    found = predicted_counts(counted.where("fifth < 2").select("fifth", "label", "counts"), models, "fifth")
    out = []
    for i, (name, _) in enumerate(models):
        held, last = (f1_of([r for r in found if r["model"] == i and r["fifth"] == k]) for k in (1, 0))
        out.append((name, held[1], last[0], last[1]))
    best = max(range(len(out)), key=lambda i: (round(out[i][1], 9), -i))
    return spark.createDataFrame([(*r, i == best) for i, r in enumerate(out)], "model string, validation_macro_f1 double, test_accuracy double, test_macro_f1 double, chosen boolean")


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, times) of the words of each text in lower case."""
    return texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("times"))


def bayes(train: DataFrame, rest: DataFrame, key: str, text: str, label: str, smoothing: float = SMOOTHING, least: int = LEAST_TEXTS, most: float = MOST_TEXTS) -> DataFrame:
    """``rest``'s keys with the class of greatest multinomial naive Bayes score, as joins and sums over (class, term) counts: no vector is as long as the vocabulary.

    A class's score of a text is linear in the text's counts, and all terms that the class lacks weigh the same; so only terms that it has are joined.
    Of equal scores (by nine digits) the first class is taken; a text without a known term has the score of the classes' shares.
    """
    seen = term_counts(train.select(key, text), key, text).join(train.select(key, label), key)
    n = train.count()
    # Counts of texts are summed by class before anything is joined by term: that is a row a term and class, not one a term and text.
    sums = stored(seen.groupBy(label, "term").agg(F.sum("times").alias("times"), F.count("*").alias("texts")), "bayes-counts")
    known = stored(sums.groupBy("term").agg(F.sum("texts").alias("texts")).where((F.col("texts") >= least) & (F.col("texts") <= most * n)).select("term"), "bayes-known")
    of_class = stored(sums.join(known, "term").select(label, "term", "times"), "bayes-classes")
    size = of_class.select("term").distinct().count()
    totals = train.groupBy(label).agg(F.log(F.count("*") / F.lit(n)).alias("share"))
    sums = of_class.groupBy(label).agg(F.sum("times").alias("total"))
    classes = F.broadcast(stored(totals.join(sums, label, "left").select(label, "share", F.log(F.coalesce("total", F.lit(0)) + smoothing * size).alias("whole")), "bayes-shares"))  # a row a class
    own = stored(term_counts(rest.select(key, text), key, text).join(known, "term", "left_semi"), "bayes-texts")
    lengths = own.groupBy(key).agg(F.sum("times").alias("n"))
    gains = own.withColumnRenamed("times", "here").join(of_class, "term").groupBy(key, label).agg(F.sum(F.col("here") * F.log((F.col("times") + smoothing) / smoothing)).alias("gain"))
    every = rest.select(key).join(lengths, key, "left").crossJoin(classes).join(gains, [key, label], "left")
    score = F.col("share") + F.coalesce("n", F.lit(0)) * (F.log(F.lit(smoothing)) - F.col("whole")) + F.coalesce("gain", F.lit(0.0))
    best = F.min(F.struct((-F.round(score, 9)).alias("minus"), F.col(label).alias("class")))
    return every.groupBy(key).agg(best.alias("best")).select(key, F.col("best.class").alias("predicted"), (-F.col("best.minus")).alias("score"))


FIFTH = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5"


@query(
    "ml07_naive_bayes",
    f"""WITH d AS (SELECT doc_id, lang, text, {FIFTH} AS fifth FROM documents WHERE lang IS NOT NULL),
w AS (SELECT doc_id, term, count(*) AS times FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM d) t GROUP BY 1, 2),
c AS (SELECT w.*, lang FROM w JOIN d ON w.doc_id = d.doc_id WHERE fifth > 0),
k AS (SELECT term FROM c GROUP BY term HAVING count(*) >= {LEAST_TEXTS} AND count(*) <= {MOST_TEXTS} * (SELECT count(*) FROM d WHERE fifth > 0)),
g AS (SELECT lang, c.term, CAST(sum(times) AS BIGINT) AS times FROM c JOIN k ON c.term = k.term GROUP BY 1, 2),
s AS (SELECT lang, ln(count(*) / (SELECT count(*) FROM d WHERE fifth > 0)) AS share FROM d WHERE fifth > 0 GROUP BY lang),
l AS (SELECT s.lang, share, ln(coalesce((SELECT sum(times) FROM g WHERE g.lang = s.lang), 0) + {SMOOTHING} * (SELECT count(DISTINCT term) FROM g)) AS whole FROM s),
o AS (SELECT w.doc_id, w.term, w.times FROM w JOIN d ON w.doc_id = d.doc_id JOIN k ON w.term = k.term WHERE fifth = 0),
n AS (SELECT doc_id, sum(times) AS n FROM o GROUP BY 1),
x AS (SELECT o.doc_id, g.lang, sum(o.times * ln((g.times + {SMOOTHING}) / {SMOOTHING})) AS gain FROM o JOIN g ON o.term = g.term GROUP BY 1, 2),
r AS (SELECT d.doc_id, d.lang, l.lang AS class, round(share + coalesce(n.n, 0) * (ln({SMOOTHING}) - whole) + coalesce(gain, 0), 9) AS score FROM d CROSS JOIN l LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id AND x.lang = l.lang WHERE fifth = 0),
b AS (SELECT doc_id, lang, class AS predicted, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class) AS i FROM r) t WHERE i = 1)
SELECT lang, predicted, count(*) AS n, round(avg(score), 4) AS mean_score FROM b GROUP BY 1, 2""",
)
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of a fifth of the documents by hash, learned from the others: how often each is taken for each, and the mean score."""
    fifth = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 5
    rows = stored(table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "text", fifth.alias("fifth")), "bayes-rows")
    rest = rows.where("fifth = 0")
    found = bayes(rows.where("fifth > 0"), rest, "doc_id", "text", "lang")
    return found.join(rest.select("doc_id", "lang"), "doc_id").groupBy("lang", "predicted").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def scorable(rows: DataFrame, text: str, known: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``rows`` and ``refused``: why a text can't be scored (too few words, none of them known), null if it can. ``known`` has distinct words ``w``."""
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0b\f\r]+"), lambda w: w != "")
    marked = rows.withColumn("row_", F.monotonically_increasing_id())
    marked = stored(marked, "scorable")
    hits = marked.select("row_", F.explode(F.array_distinct(words)).alias("w")).join(known, "w", "left_semi").select("row_").distinct().withColumn("hit_", F.lit(True))
    why = F.when(F.coalesce(F.size(words), F.lit(0)) < least, "too_few_words").when(F.col("hit_").isNull(), "no_known_word")
    return marked.join(hits, "row_", "left").withColumn("refused", why).drop("row_", "hit_")


@query("ml13_scorable_texts", r"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+')) AS w FROM benchmark), d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM documents), h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(ws) AS w FROM d) e WHERE w IN (SELECT w FROM w WHERE w <> '')) SELECT doc_id, CASE WHEN len(ws) < 5 THEN 'too_few_words' WHEN doc_id NOT IN (SELECT doc_id FROM h) THEN 'no_known_word' END AS refused FROM d""".replace("\\\\", "\\"))
def scorable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a scorer with the benchmark's words would refuse, and why."""
    words = F.explode(F.split(F.lower("text"), r"[ \t\n\x0b\f\r]+")).alias("w")
    known = table(spark, sf_dir, "benchmark").select(words).where("w <> ''").distinct()
    return scorable(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", known).select("doc_id", "refused")


#: Similarities by which the search for the nearest text comes down; below the last of them an item is held to its best so far.
STEPS_DOWN = (0.5, 0.2)
#: Words whose weights every task holds.
COMMON = 262_144
#: Ratio of the norms between which documents share a list.
BAND = 1.25
#: Similarities are compared as rounded; a bound has to leave room for that.
ROOM = 2e-9


def terms(rows: DataFrame, key: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\x0b\f\r]+"), lambda w: w != ""))
    return rows.select(F.col(key).alias(key), F.explode(words).alias("w"))


def norms(doc_terms: DataFrame, squares: DataFrame, most: int = COMMON) -> DataFrame:
    """Stored (doc_id, norm) of stored terms of documents. Weights of the commonest words, ``most`` at most, go to all tasks; only rows of rarer words are exchanged."""
    steps = squares.groupBy(F.floor(F.log2("texts") * 8).alias("step")).agg(F.count("*").alias("words"), F.min("texts").alias("least")).collect()  # a few hundred rows
    held, least = 0, 1 << 62
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["words"]
        if held > most:
            break
        least = r["least"]
    common, rare = squares.where(F.col("texts") >= least).select("w", "square"), squares.where(F.col("texts") < least).select("w", "square")
    near = doc_terms.join(F.broadcast(common), "w")
    far = doc_terms.join(F.broadcast(common.select("w")), "w", "left_anti").join(rare, "w")
    parts = [x.groupBy("doc_id").agg(F.sum("square").alias("square")) for x in (near, far)]
    return stored(parts[0].union(parts[1]).groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm")), "document-norms")


def postings(docs: DataFrame, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, w, norm, band): inverted lists of all documents, cut by bands of the norm, of the words of ``items`` (None: of all words); and stored (w, texts, square), the squared weights of all words."""
    doc_terms = stored(terms(docs, "doc_id"), "document-terms")
    total = docs.count()
    squares = stored(doc_terms.groupBy("w").agg(F.count("*").alias("texts")).withColumn("square", F.pow(F.log(F.lit(float(total)) / F.col("texts")) + 1, F.lit(2.0))), "word-squares")
    wanted = doc_terms if items is None else doc_terms.join(stored(terms(items, "item_id").select("w").distinct(), "item-words"), "w", "left_semi")
    lists = wanted.join(norms(doc_terms, squares), "doc_id").withColumn("band", F.floor(F.log("norm") / math.log(BAND)).cast("int"))
    return stored(lists.select("doc_id", "w", "norm", "band"), "postings"), squares


def item_terms(items: DataFrame, squares: DataFrame) -> DataFrame:
    """Stored (item_id, w, square, rest, item_norm) of the words that documents have, too; ``rest`` sums the squares of a word and of those that come after it, rarest first."""
    of_item = terms(items, "item_id").join(squares.select("w", "square"), "w")
    whole = Window.partitionBy("item_id")
    later = whole.orderBy(F.desc("square"), "w").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return stored(of_item.withColumns({"rest": F.sum("square").over(later), "item_norm": F.sqrt(F.sum("square").over(whole))}), "item-terms")


def similarities(pairs: DataFrame, of_item: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, doc_id, similarity) of pairs: the squares of shared words over both norms. Few pairs, whose size is known once they are stored, go to the lists instead of the lists to them."""
    of_pair = lists.select("doc_id", "w", "norm").join(stored(pairs, "pairs"), "doc_id")
    shared = of_pair.join(of_item.select("item_id", "w", "square", "item_norm"), ["item_id", "w"])
    dots = shared.groupBy("item_id", "doc_id").agg(F.sum("square").alias("dot"), F.first("norm").alias("norm"), F.first("item_norm").alias("item_norm"))
    return dots.select("item_id", "doc_id", F.round(F.col("dot") / F.col("norm") / F.col("item_norm"), 9).alias("similarity"))


def best_of(found: DataFrame) -> DataFrame:
    return found.groupBy("item_id").agg(F.max(F.struct("similarity", (-F.col("doc_id")).alias("neg"))).alias("b")).select("item_id", (-F.col("b.neg")).alias("doc_id"), "b.similarity")


def candidates(wanted: DataFrame, of_item: DataFrame, bands: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, doc_id) that hold every document which reaches ``least`` of (item_id, least), each once.

    If a word is the rarest that a document shares with an item, what they share weighs ``rest`` at most. So the similarity is
    at most rest / (both norms), and at most the root of rest over the item's norm. A list, of a word and a band of norms, is read
    only if its shortest document could reach ``least``, and a document of it is taken only if it could itself.
    """
    asked = of_item.join(wanted, "item_id").where(F.sqrt("rest") / F.col("item_norm") >= F.col("least") - ROOM)
    reach = F.col("rest") / F.col("item_norm")
    read = asked.join(bands, "w").where(reach / F.col("shortest") >= F.col("least") - ROOM).select("item_id", "w", "band", reach.alias("reach"), "least")
    return lists.join(stored(read, "reads"), ["w", "band"]).where(F.col("reach") / F.col("norm") >= F.col("least") - ROOM).select("item_id", "doc_id").distinct()


def nearest(docs: DataFrame, items: DataFrame, steps: tuple[float, ...] = STEPS_DOWN) -> DataFrame:
    """(item_id, doc_id, similarity): for each item that shares a word with a document, the document of greatest TF-IDF cosine, ties to the least id; a term counts once a text.

    Every item starts from the shortest document of each of its words, so its best is above 0 from the first. Then lists are read
    that may hold a document of a similarity of at least a step and of the item's best so far; an item whose best reaches that is done,
    the others go on to the next step, and last to their own best, which ends it.
    """
    lists, squares = postings(docs, items)
    of_item = item_terms(items, squares)
    bands = stored(lists.groupBy("w", "band").agg(F.min(F.struct("norm", "doc_id")).alias("first")).select("w", "band", F.col("first.norm").alias("shortest"), F.col("first.doc_id").alias("doc_id")), "list-maxima")
    champions = bands.groupBy("w").agg(F.min_by("doc_id", F.struct("shortest", "doc_id")).alias("doc_id"))
    best = stored(best_of(similarities(of_item.select("item_id", "w").join(champions, "w").select("item_id", "doc_id").distinct(), of_item, lists)), "nearest")
    bands, open_ = bands.drop("doc_id"), best
    for step in (*steps, 0.0):
        wanted = stored(open_.select("item_id", F.greatest("similarity", F.lit(step)).alias("least")), "wanted")
        found = similarities(candidates(wanted, of_item, bands, lists), of_item, lists)
        best = stored(best_of(best.union(found)), "nearest")
        open_ = best.join(wanted, "item_id").where(F.col("similarity") < F.col("least")).select("item_id", "similarity")
        if open_.isEmpty():
            break
    return best


_NEAREST = r"""d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))) AS w FROM documents),
b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> ''))) AS w FROM benchmark),
f AS (SELECT w, ln((SELECT count(*) FROM documents) / count(*)) + 1 AS idf FROM d GROUP BY w),
dn AS (SELECT doc_id, sqrt(sum(idf * idf)) AS norm FROM d JOIN f USING (w) GROUP BY 1), bn AS (SELECT item_id, sqrt(sum(idf * idf)) AS norm FROM b JOIN f USING (w) GROUP BY 1),
p AS (SELECT doc_id, item_id, sum(idf * idf) AS dot FROM d JOIN f USING (w) JOIN b USING (w) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(dot / dn.norm / bn.norm, 9) AS similarity FROM p JOIN dn USING (doc_id) JOIN bn USING (item_id)),
n AS (SELECT item_id, doc_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) AS k FROM s) t WHERE k = 1)"""


@query("jn10_nearest_benchmark", f"WITH {_NEAREST} SELECT item_id, doc_id, round(similarity, 6) AS similarity FROM n")
def nearest_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark text the document that resembles it most."""
    return nearest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"))


@query("jn10_near_share", f"WITH {_NEAREST} SELECT count(*) AS items, count(*) FILTER (WHERE similarity >= 0.9) AS near, round(count(*) FILTER (WHERE similarity >= 0.9) / count(*), 9) AS share FROM n")
def near_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many benchmark texts have a document at 0.9 or more."""
    found = nearest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    near = F.count_if(F.col("similarity") >= 0.9)
    return found.agg(F.count("*").alias("items"), near.alias("near"), F.round(C.ratio_or_zero(near, F.count("*")), 9).alias("share"))
