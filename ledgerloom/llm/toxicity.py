"""Toxic passages: all maximal segments of token log-odds, judged by extreme-value statistics.

Training takes a bounded sample of labelled rows (``SAMPLE``), copies of a text once.
Words and their prefixes get log-odds with an informative Dirichlet prior; only
what is surely above zero scores, any other word costs ``DRIFT``. One linear scan finds
every maximal-scoring segment of a text; their scores become E-values, and these a
probability by a logistic fit on the sample.

Cases: a null or empty text has no segment and gets the probability of such a
text; without labels of both kinds all scores are the share of toxic labels (0 without
any); rows without a label are only scored; repeated rows score alike; of an id with several texts the
fit takes the least one, and of an id with several labels the greater; a very long text is scanned whole, one at a time; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ledgerloom.llm._common import discard, frugal, id_crc, schema_with, shared_table, slices, utf8

#: Labelled rows that the fit reads at most, those of least hash.
SAMPLE = 12_000
PREFIXES = (6, 5, 4)
#: The prior's weight as a share of the sample's texts.
PRIOR = 0.05
#: What a word outside the table costs.
DRIFT = 0.5
#: Deviations below the log-odds that still have to be above zero.
SURE = 2.5
#: The toxic part of a word's texts that it needs at least, were toxic and other texts equally many;
#: words of a passage that both share have less. Unlike log-odds it does not move with the labels' balance.
SHARE = 0.9
#: Passages with a larger E-value are not reported.
E_VALUE = 0.01
#: Scores from here on are predicted to be toxic.
THRESHOLD = 0.7
PUNCTUATION = b".,;:!?\"'()[]"
REMEMBERED = 200_000


def words(text: bytes | None) -> list[bytes]:
    return text.lower().translate(None, PUNCTUATION).split() if text else []


def features(word: bytes) -> list[bytes]:
    """A word and its prefixes, the most specific first."""
    return [word, *(word[:k] + b"~" for k in PREFIXES if len(word) > k)]


def segments(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), by Ruzzo and Tompa's linear scan.

    Entries of ``scores`` at zero or below count as ``-drift``; only the others are visited.
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    gains = scores[at].astype(float)
    gaps = np.diff(np.r_[-1, at]) - 1
    right = np.cumsum(gains - drift * gaps)
    left = right - gains
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, the last one with a smaller sum before
    for i in range(len(at)):
        start, end, low, high = int(at[i]), int(at[i]) + 1, float(left[i]), float(right[i])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((start, end, low, high, j))
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
    return [(s, e, high - low) for s, e, low, high, _ in found]


@dataclass
class Model:
    """Scores of words and prefixes, extreme-value parameters, logistic weights."""

    table: dict[bytes, float]
    rate: float = 1.0
    scale: float = 1.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None

    def scores(self, text: bytes | None, known: dict) -> np.ndarray:
        parts = words(text)
        return np.fromiter(map(known.__getitem__, parts), float, len(parts))

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> tuple[float, float]:
        """The sum statistic of the best segments, best number of them, and the top segment's own score."""
        if not found:
            return -10.0, 0.0
        each = np.sort([self.rate * s for _, _, s in found])[::-1]
        sums = np.cumsum(each - math.log(max(self.scale * n, 1e-9)))
        factorials = np.cumsum(np.log(np.arange(1, len(each) + 1)))
        return float(np.clip((sums + factorials).max(), -10, 20)), float(min(each[0], 20.0))

    def probability(self, found: list[tuple[int, int, float]], n: int) -> float:
        if self.constant is not None:
            return self.constant
        a, b = self.evidence(found, n)
        return 1 / (1 + math.exp(-(self.weights[0] + self.weights[1] * a + self.weights[2] * b)))

    def passages(self, found: list[tuple[int, int, float]], n: int, least: float = E_VALUE) -> list[tuple[int, int, float, float]]:
        """Segments whose E-value in a text of n words is small: start, end, score, E-value."""
        valued = [(s, e, score, self.scale * n * math.exp(-self.rate * score)) for s, e, score in found]
        return [x for x in valued if x[3] <= least]


class Known(dict):
    """Scores of words seen; forgets all when full."""

    def __init__(self, table: dict[bytes, float]) -> None:
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        score = next((self.table[f] for f in features(word) if f in self.table), 0.0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = score
        return score


def _counts(sample: DataFrame) -> DataFrame:
    """Per feature: the toxic and the other texts that hold it, so that one text's repetitions count once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sums: tuple[Counter, Counter] = Counter(), Counter()
            for text, label in zip(utf8(batch, "text"), batch.column(batch.schema.get_field_index("toxic")).to_pylist(), strict=True):
                seen = {f for word in set(words(text)) for f in features(word)}
                sums[label].update(seen)
                sums[label][b""] += 1  # the texts, under a name that no word has
            keys = list(sums[0].keys() | sums[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([s[k] for k in keys], pa.int64()) for s in sums)], ["feature", "others", "toxic"])

    parts = sample.mapInArrow(count, "feature binary, others long, toxic long")
    return parts.groupBy("feature").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))


def _log_odds(counts: DataFrame, totals: tuple[int, int]) -> tuple[Column, Column]:
    """Log-odds of toxic against other texts under the Dirichlet prior, and their deviation."""
    others, toxic = (F.col(c).cast("double") for c in ("others", "toxic"))
    weight = PRIOR * sum(totals)
    prior = (others + toxic) / sum(totals) * weight
    a, b = toxic + prior, others + prior
    odds = F.log(a / F.greatest(F.lit(totals[1] + weight) - a, F.lit(1.0))) - F.log(b / F.greatest(F.lit(totals[0] + weight) - b, F.lit(1.0)))
    return odds, F.sqrt(1 / a + 1 / b)


def _positive_root(scores: np.ndarray, shares: np.ndarray) -> float:
    """The rate at which sum(shares * exp(rate * scores)) is 1, the Karlin-Altschul parameter."""
    low, high = 1e-6, 1.0
    excess = lambda rate: float(shares @ np.exp(np.minimum(rate * scores, 500))) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton steps, intercept first."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows whose id's crc32 leaves a remainder other than 1 by 3, ``sample`` of them at most."""
    spark = docs.sparkSession
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc(F.col("id")) % 3 != 1))
        .groupBy("id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # ``sample`` rows of 12 bytes at most, so the broadcast is bounded.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    stored = shared_table(texts.groupBy("id", "toxic").agg(F.min("text").alias("text")), "toxic-sample")
    kinds = {r["toxic"]: r["n"] for r in stored.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(kinds) < 2:
        return Model({}, constant=float(next(iter(kinds), 0)))
    firsts = stored.groupBy(F.xxhash64("text").alias("hash"), "toxic").agg(F.min("id").alias("id"))
    unique = stored.join(F.broadcast(firsts.select("id")), "id")
    counts = shared_table(_counts(unique), "toxic-counts")
    total = counts.where(F.col("feature") == F.lit(b"")).first()
    if total is None or not total["others"] or not total["toxic"]:
        return Model({}, constant=kinds[1] / sum(kinds.values()))
    totals = (total["others"], total["toxic"])
    odds, deviation = _log_odds(counts, totals)
    of_others, of_toxic = F.col("others") / totals[0], F.col("toxic") / totals[1]
    share = of_toxic / (of_toxic + of_others)
    scored = counts.where(F.col("feature") != F.lit(b"")).select("feature", (odds - SURE * deviation).alias("score"), share.alias("share"))
    # Of the words of a bounded sample, those that tell toxic texts.
    top = scored.where((F.col("score") > 0) & (F.col("share") >= SHARE)).select("feature", "score").collect()
    model = Model({bytes(r["feature"]): r["score"] for r in top})
    _calibrate(model, stored)
    discard(stored, counts)
    return model


def _calibrate(model: Model, stored: DataFrame) -> None:
    """Set the extreme-value parameters from the other texts of the sample, and the logistic weights from all."""
    found = scanned(model, stored, hits, "score double, times long, words long, passages long, least double")
    by_score = found.groupBy("score").agg(*[F.sum(c).alias(c) for c in ("times", "words", "passages")], F.min("least").alias("least")).collect()  # a row for each score of the table
    whole = next((r for r in by_score if r["score"] is None), None)
    background, clean, least = (whole["words"] or 1, whole["passages"], whole["least"] or 1.0) if whole else (1, 0, 1.0)
    hit, times = (np.array([r[c] for r in by_score if r["score"] is not None], float) for c in ("score", "times"))
    # Each table entry is taken to occur now and then in other texts even if the sample has none there.
    unseen = np.array([v for v in model.table.values()])
    scores = np.r_[-DRIFT, hit, unseen]
    weights = np.r_[max(background - times.sum(), 1), times, np.full(len(unseen), 0.1)]
    model.rate = _positive_root(scores, weights / weights.sum()) if len(scores) > 1 else 1.0
    model.scale = (clean + 1) / (background * math.exp(-model.rate * least))
    rows = scanned(model, stored, evidence, "toxic int, a double, b double").collect()  # two numbers for each text of the sample
    model.weights = tuple(logistic(np.array([(r["a"], r["b"]) for r in rows]), np.array([r["toxic"] for r in rows], float)))


def scanned(model: Model, stored: DataFrame, what: Callable, schema: str) -> DataFrame:
    """Rows that ``what`` makes of each text's label, word scores and segments."""
    shared = stored.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value.table)
        for batch in slices(batches, "text"):
            labels = batch.column(batch.schema.get_field_index("toxic")).to_pylist()
            scores = [shared.value.scores(t, known) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in what(shared.value, labels, scores)], [f.split()[0] for f in schema.split(", ")])

    return stored.mapInArrow(scan, schema)


def hits(model: Model, labels: list[int], scores: list[np.ndarray]) -> list[tuple]:
    """Of the texts that aren't toxic: how often each score occurs, and in a row without a score their words, passages and the least passage's score."""
    own = [s for s, toxic in zip(scores, labels, strict=True) if not toxic]
    values, times = np.unique(np.concatenate([s[s > 0] for s in own] or [np.zeros(0)]), return_counts=True)
    found = [x for s in own for _, _, x in segments(s)]
    rest = [None] * len(values)
    return [([*values, None], pa.float64()), ([*times, 0], pa.int64()), ([*rest, sum(map(len, own))], pa.int64()), ([*rest, len(found)], pa.int64()), ([*rest, min(found, default=None)], pa.float64())]


def evidence(model: Model, labels: list[int], scores: list[np.ndarray]) -> list[tuple]:
    found = [model.evidence(segments(s), len(s)) for s in scores]
    return [(labels, pa.int32()), ([a for a, _ in found], pa.float64()), ([b for _, b in found], pa.float64())]


def with_score(docs: DataFrame, model: Model, text: str, out: str, passages: str | None = None) -> DataFrame:
    """``docs`` and the probability that its text is toxic, and the toxic passages as word positions if a name for them is given."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(shared.value.table)
        for batch in slices(batches, text):
            chances, found = [], []
            for t in utf8(batch, text):
                scores = shared.value.scores(t, known)
                parts = segments(scores)
                chances.append(shared.value.probability(parts, len(scores)))
                if passages:
                    found.append([dict(zip(("start", "end", "score", "e_value"), p, strict=True)) for p in shared.value.passages(parts, len(scores))])
            columns = [pa.array(chances, pa.float64()), *([pa.array(found, kind)] if passages else [])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, out, *([passages] if passages else [])])

    schema = schema_with(docs, out, "double")
    if passages:
        schema.add(passages, DataType.fromDDL("array<struct<start:int,end:int,score:double,e_value:double>>"))
    return docs.mapInArrow(frugal(add), schema)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: whether it was held out, its score, the prediction and the toxic passages."""
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_score(rows, model, "text", "score", "passages").select("id", "score", "passages")
    return found.select(
        F.col("id").alias(id_col),
        (id_crc(F.col("id")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "passages",
    )
