"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword; one linear classifier per bit predicts it from a
text's hashed character n-grams. Decoding weighs each bit by how well its classifier did on
documents left out of its fit, and chooses the codeword of least loss; a small gap
to the next one marks the result as ambiguous.

The fit reads a bounded sample, about ``PER_LANGUAGE`` documents of each language; tasks sum the cross products of its
features, so the driver solves one system of ``SLOTS`` unknowns however many languages and documents there are.

Cases: null and letterless texts are ``und`` with score 0; with one
language learned that one is predicted for all others, with none ``und``; rows with
null or blank language are only predicted; repeated rows agree, and null or repeated ids are drawn for
the sample row by row; n-grams of a very long text are counted window by window; columns of any name but
the outputs' pass through ``with_language``; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import id_crc, parts, rows_in, schema_with, shared_table, slices

#: Documents per language that the fit reads on average.
PER_LANGUAGE = 400
#: Names of languages that are sent to all tasks at most.
NAMED = 10_000
#: Sampled documents whose cross products a task sums.
EACH = 2000
#: Hash slots of n-grams, and their lengths.
SLOTS = 2048
LENGTHS = (1, 2, 3)
#: Characters of a text that are counted at once.
WINDOW = 1 << 20
RIDGE = 1.0
#: Results whose best two codewords are closer than this share of the loss are ambiguous.
AMBIGUOUS = 0.1
UNDETERMINED = "und"
SEED = 7


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def histogram(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a text's letters in lower case, roots taken, of length 1; None without letters.

    Anything else counts as a space; n-grams are taken within a window of the
    text at a time, so memory does not grow with it.
    """
    if not text:
        return None
    text = text.lower()
    counts, any_letter = np.zeros(SLOTS), False
    most, spaced = max(LENGTHS), False
    for at in range(0, len(text), WINDOW):
        codes = np.frombuffer(text[at : at + WINDOW + 2 * most].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        is_letter = letters()[codes]
        any_letter |= bool(is_letter[:WINDOW].any())
        codes = np.where(is_letter, codes, 32)
        keep = (codes != 32) | np.r_[not spaced, codes[:-1] != 32]
        spaced = codes[min(WINDOW, len(codes)) - 1] == 32
        starts = int(keep[:WINDOW].sum())  # n-grams that start later are the next window's
        codes = codes[keep]
        rolled = np.zeros(len(codes), np.int64)
        for n in range(1, most + 1):
            rolled = (rolled[: len(codes) - n + 1] * 31 + codes[n - 1 :] * 2654435761) & 0xFFFFFFFF
            if n in LENGTHS:
                own = rolled[:starts]
                counts += np.bincount((own ^ own >> 15) % SLOTS, minlength=SLOTS)
    if not any_letter:
        return None
    roots = np.sqrt(counts)
    return roots / np.linalg.norm(roots)


def codewords(n: int) -> np.ndarray:
    """Rows of +-1 for n classes: all splits of few classes, else the best of seeded random codes."""
    if n <= 6:
        splits = [set(c) | {0} for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1 if i in s else -1 for s in splits] for i in range(n)])
    rng, best, most = np.random.default_rng(SEED), None, -1
    for _ in range(50):
        code = rng.choice([-1, 1], (n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]  # a bit that is the same for all says nothing
        distance = (code.shape[1] - (code @ code.T - 2 * code.shape[1] * np.eye(n, dtype=int)).max()) // 2
        if distance > most:
            best, most = code, distance
    return best


@dataclass
class Model:
    names: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def predict(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: the class, its share among exp(-loss) of all, whether it is ambiguous."""
        margins = features @ self.weights[:-1] + self.weights[-1]
        # Exponential loss of each bit against each codeword, weighted by trust in the bit.
        losses = (np.exp(-np.clip(margins, -3, 3)[:, None, :] * self.code[None, :, :]) * self.trust).sum(axis=2) / max(self.trust.sum(), 1e-300)  # one class has no bits, and loses nothing
        shares = np.exp(-8 * (losses - losses.min(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        ordered = np.sort(losses, axis=1)
        close = (ordered[:, 1] - ordered[:, 0] < AMBIGUOUS * ordered[:, 1]) if losses.shape[1] > 1 else np.zeros(len(losses), bool)
        best = losses.argmin(axis=1)
        return best, shares[np.arange(len(best)), best], close


@dataclass
class Sums:
    """What a ridge regression of any targets by class needs of a set of documents."""

    products: np.ndarray  # of the features with each other, and with 1 in the last row and column
    by_class: np.ndarray  # features and 1, summed by class

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.products + other.products, self.by_class + other.by_class)

    def __iadd__(self, other: Sums) -> Sums:
        self.products += other.products
        self.by_class += other.by_class
        return self

    def solve(self, code: np.ndarray) -> np.ndarray:
        """Linear classifiers for all bits at once; the last row is the intercept, which is not held small."""
        n = max(self.products[-1, -1], 1.0)
        mean_x, mean_y = self.products[-1, :-1] / n, self.by_class[:, -1] @ code / n
        centred = np.outer(mean_x, -n * mean_x)
        centred += self.products[:-1, :-1]
        centred.flat[:: len(centred) + 1] += RIDGE
        w = np.linalg.solve(centred, self.by_class[:, :-1].T @ code - n * np.outer(mean_x, mean_y))
        return np.vstack([w, mean_y - mean_x @ w])


def cross_products(sample: DataFrame, n_classes: int) -> list[Sums]:
    """The sums of each fold of a stored sample (fold, class, features): tasks add up documents, and rows of their sums are added by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Sums(np.zeros((SLOTS + 1, SLOTS + 1)), np.zeros((n_classes, SLOTS + 1))) for _ in range(2)]
        for batch in batches:
            fold, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, SLOTS).astype(float)
            x = np.c_[x, np.ones(len(x))]
            for f in (0, 1):
                sums[f].products += x[fold == f].T @ x[fold == f]
                np.add.at(sums[f].by_class, kind[fold == f], x[fold == f])
        for f in (0, 1):
            table = np.vstack([sums[f].products, sums[f].by_class])
            at = np.flatnonzero(table[:, -1])
            for i in range(0, len(at), 64):
                rows = at[i : i + 64]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([r.tobytes() for r in table[rows]], pa.binary())], ["fold", "row", "sums"])

    def total(group: pa.Table) -> pa.Table:
        added = sum(np.frombuffer(x.as_py()) for x in group.column("sums"))
        return pa.table({"fold": group.column("fold")[:1], "row": group.column("row")[:1], "sums": pa.array([added.tobytes()], pa.binary())})

    kind = "fold int, row int, sums binary"
    out = [np.zeros((SLOTS + 1 + n_classes, SLOTS + 1)) for _ in range(2)]
    # A row for each slot and class; none has more than SLOTS + 1 numbers. As many tasks add as documents need, since each sends all its sums.
    for r in sample.coalesce(parts(rows_in(sample), EACH)).mapInArrow(add, kind).groupBy("fold", "row").applyInArrow(total, kind).toLocalIterator():
        out[r["fold"]][r["row"]] = np.frombuffer(r["sums"])
    return [Sums(x[: SLOTS + 1], x[SLOTS + 1 :]) for x in out]


def right_bits(sample: DataFrame, weights: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The share of the left-out documents on which each bit's classifier is right."""
    shared = sample.sparkSession.sparkContext.broadcast((weights, code))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, code = shared.value
        right, n = np.zeros(code.shape[1]), 0
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(-1, SLOTS)
            right += (np.sign(x @ weights[:-1] + weights[-1]) == code[batch.column(1).to_numpy()]).sum(axis=0)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right)), pa.int32()), pa.array(right), pa.array(np.full(len(right), float(n)))], ["bit", "right", "n"])

    counted = sample.where("fold = 1").mapInArrow(judge, "bit int, right double, n double").groupBy("bit").agg((F.sum("right") / F.sum("n")).alias("share"))
    return np.array([r["share"] for r in counted.orderBy("bit").collect()])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = PER_LANGUAGE) -> Model | None:
    """Fit on documents with a language whose id's crc32 leaves a remainder other than 1 by 3."""
    spark, lang = docs.sparkSession, F.col(lang_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.col(text_col).alias("text"))
    known = rows.where(F.col("lang").isNotNull() & (F.trim("lang") != "") & (id_crc(F.col("id")) % 3 != 1))
    shares = shared_table(known.groupBy("lang").agg(F.least(F.lit(1.0), each / F.count("*")).alias("share")), "language-shares")
    # A row a language; were there more than ``NAMED``, texts would be dealt out by language.
    shares = F.broadcast(shares) if rows_in(shares) <= NAMED else shares
    # Rows are drawn one by one, so the sample is bounded whatever ids repeat; what was drawn is stored.
    drawn = known.join(shares, "lang").where(F.rand(SEED) < F.col("share")).select("lang", "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [(name, h.astype(np.float32).tobytes()) for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (h := histogram(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.string()), (1, pa.binary()))], ["lang", "features"])

    described = shared_table(drawn.mapInArrow(describe, "lang string, features binary"), "language-sample")
    names = sorted(r["lang"] for r in described.select("lang").distinct().collect())
    if not names:
        return None
    numbers = spark.createDataFrame(list(enumerate(names)), "class int, lang string")
    # Every fifth document is left out of the fit that weighs the bits.
    fold = (F.pmod(F.xxhash64("features"), F.lit(5)) == 0).cast("int").alias("fold")
    sample = described.join(F.broadcast(numbers), "lang").select(fold, "class", "features")
    sample = shared_table(sample.repartition(parts(rows_in(described), EACH)), "language-features")
    code, (kept, left_out) = codewords(len(names)), cross_products(sample, len(names))
    trust = np.ones(code.shape[1])
    if kept.products[-1, -1] and left_out.products[-1, -1] and kept.products[-1, -1] + left_out.products[-1, -1] >= 10:
        rate = np.clip(right_bits(sample, kept.solve(code), code), 0.51, 0.999)
        trust = np.log(rate / (1 - rate))
    kept += left_out
    del left_out
    return Model(names, code, kept.solve(code), trust)


def with_language(docs: DataFrame, model: Model | None, text: str, prefix: str = "lang_") -> DataFrame:
    """``docs`` and the predicted language of its text, its score and whether it is ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}pred", f"{prefix}score", f"{prefix}ambiguous"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, text, 2_000_000):
            described = [histogram(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found: list[tuple[str, float, bool]] = [(UNDETERMINED, 0.0, True)] * len(described)
            has = [i for i, h in enumerate(described) if h is not None]
            for at in range(0, len(has) if model else 0, 512):
                rows = has[at : at + 512]
                for i, best, score, close in zip(rows, *model.predict(np.stack([described[i] for i in rows])), strict=True):
                    found[i] = (model.names[best], float(score), bool(close))
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return docs.mapInArrow(add, schema_with(docs, names[0], "string").add(names[1], "double").add(names[2], "boolean"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: whether it was held out, the predicted language, score, ambiguity."""
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = with_language(rows, model, "text").drop("text")
    return found.select(F.col("id").alias(id_col), (id_crc(F.col("id")) % 3 == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))
