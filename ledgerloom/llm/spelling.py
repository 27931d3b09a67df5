"""Spelling variants: every word's full neighbourhood of one edit, joined to the vocabulary.

A word emits all distinct results of deleting, replacing or inserting one letter of the observed alphabet. Edits are made
on polynomial hashes, where one costs an addition however long the word is; a bitmap of the vocabulary's hashes lets pass
what may be a word, and only that is written out and joined, text to text, with the vocabulary. So no distance is
computed, and what the bitmap lets pass wrongly finds no partner.

Cases: null and empty texts have no words; very long texts are read in pieces and very long words edited in blocks. A null
id counts as empty text where ids choose runs to damage. Repeated rows count as often as they stand. Ties of
frequency go to the word that is first in code-point order; a word without a near word has no form and is its own
root. Columns of other names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import parts, rows_in, shared_table, slices, utf8
from ledgerloom.plans.stored import discard

#: A word is a run of these letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
NOT_RUN = re.compile("[^A-Za-zÀ-ÿ]")
#: One run in so many loses a letter, in the query.
DAMAGED = 97
#: Code points and occurrences that a word of the vocabulary has at least.
LENGTH, OCCURRENCES = 5, 3
#: How many times as frequent as a word its form is at least.
RATIO = 2
#: Characters of a text that are split into runs at once, words that a task counts before it passes them on, edits made at once, words edited in a task.
PIECE, HELD, BLOCK, WORDS = 1 << 20, 200_000, 1 << 20, 10_000
#: Bits of the bitmap for each word; its size, as a power of two, stays in these bounds, and so is at most 32 MB.
BITS, LEAST, MOST = 32, 16, 28
#: A word sets one bit for each of these odd multipliers.
SPREAD = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
BASE = np.uint64(0xD6E8FEB86659FD93)


def runs(text: str) -> Counter:
    """How often each run is in a text, read in pieces that end between runs."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        cut = NOT_RUN.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        counts.update(RUN.findall(text[at:end]))
        at = end
    return counts


def damaged(run: str, key: str, one_in: int) -> str:
    """The run, or if the crc32 of ``key:run`` is divisible by ``one_in`` the run without one code point."""
    h = zlib.crc32(f"{key}:{run}".encode())
    return run if h % one_in else run[: h % len(run)] + run[h % len(run) + 1 :]


def counted(docs: DataFrame, id_col: str, text_col: str, damage: int | None = None) -> DataFrame:
    """(word, n) of all texts, A-Z lower-cased; with ``damage`` one run in so many loses a letter, which makes misspellings."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return batch

        for batch in slices(batches, "text"):
            for key, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
                for run, n in runs((text or b"").lower().decode()).items():
                    word = damaged(run, key, damage) if damage else run
                    if len(word) >= LENGTH:
                        found[word] += n
                if len(found) >= HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_hashes() -> np.ndarray:
    """A random 64-bit number for each code point below 256."""
    return np.random.default_rng(12).integers(0, 1 << 64, 256, np.uint64)


def by_length(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Places of the words of each length, and their code points as a matrix."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for length, at in places.items():
        yield at, np.array([words[i] for i in at], f"<U{length}").view(np.uint32).reshape(len(at), length)


def hashed(codes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Polynomial hashes of words of one length."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = h * BASE + values[column]
    return h


def bit_places(hashes: np.ndarray, multiplier: np.uint64, bits: int) -> np.ndarray:
    return (hashes * multiplier) >> np.uint64(64 - bits)


def bitmap_of(vocabulary: DataFrame, bits: int) -> bytes:
    """The bits that the words set; built in tasks from pages of Spark's bitmap aggregate."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = letter_hashes()
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                h = hashed(codes, values)
                at = np.concatenate([bit_places(h, m, bits) for m in SPREAD]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], ["bit"])

    bit = vocabulary.select("word").mapInArrow(places, "bit long")
    page = (F.col("bit") / 32768).cast("long")
    pages = bit.groupBy(page.alias("page")).agg(F.bitmap_construct_agg((F.col("bit") % 32768)).alias("bitmap"))
    whole = bytearray((1 << bits) // 8)
    for row in pages.toLocalIterator():
        whole[row["page"] * 4096 : row["page"] * 4096 + len(row["bitmap"])] = row["bitmap"][: len(whole)]
    return bytes(whole)


def edits(codes: np.ndarray, alphabet: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All distinct edits of words of one length, as arrays (hash, word, place, letter, kind), in blocks.

    Of equal neighbours only the first is deleted, a letter is inserted only where it doesn't follow itself, and none
    replaces itself; so no result comes twice, and none is the word.
    """
    n, length = codes.shape
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(length + 1, BASE, np.uint64)])
    before, after = (np.zeros((n, length + 1), np.uint64) for _ in range(2))
    for i in range(length):
        before[:, i + 1] = before[:, i] * BASE + values[codes[:, i]]
        j = length - 1 - i
        after[:, j] = values[codes[:, j]] * power[i] + after[:, j + 1]
    wide = min(length + 1, max(1, BLOCK // len(alphabet)))
    high = max(1, BLOCK // (wide * len(alphabet)))
    previous = np.concatenate([np.full((n, 1), 0, codes.dtype), codes], axis=1)
    letters = values[alphabet]
    for top in range(0, n, high):
        own = slice(top, top + high)
        for left in range(0, length + 1, wide):
            at = np.arange(left, min(left + wide, length + 1))
            within = at[at < length]
            tail = power[length - at]  # weight of a letter inserted there
            inserted = (before[own, at] * (tail * BASE) + after[own, at])[:, :, None] + letters * tail[:, None]
            yield from _listed(inserted, previous[own, at][:, :, None] != alphabet, top, left, "i")
            if len(within):
                tail = power[length - 1 - within]
                rest = after[own, within + 1]
                replaced = (before[own, within] * (tail * BASE) + rest)[:, :, None] + letters * tail[:, None]
                yield from _listed(replaced, codes[own, within][:, :, None] != alphabet, top, left, "r")
                deleted = (before[own, within] * tail + rest)[:, :, None]
                yield from _listed(deleted, (previous[own, within] != codes[own, within])[:, :, None], top, left, "d")


def _listed(hashes: np.ndarray, distinct: np.ndarray, top: int, left: int, kind: str) -> Iterator[tuple[np.ndarray, ...]]:
    word, place, letter = np.nonzero(distinct)
    yield hashes[word, place, letter], word + top, place + left, letter, kind


def written(word: str, place: int, letter: str, kind: str) -> str:
    return word[:place] + (letter if kind != "d" else "") + word[place + (kind != "i") :]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of the words of a stored vocabulary (word, n) that differ by one edit, both ways."""
    spark, size = vocabulary.sparkSession, rows_in(vocabulary)
    bits = min(MOST, max(LEAST, (BITS * size).bit_length()))
    # A closed alphabet: at most 90 letters.
    letters = sorted(r["letter"] for r in vocabulary.select(F.explode(F.split("word", "")).alias("letter")).distinct().collect() if r["letter"])
    bitmap = spark.sparkContext.broadcast(bitmap_of(vocabulary, bits))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, alphabet, page = letter_hashes(), np.array([ord(c) for c in letters], np.uint32), np.frombuffer(bitmap.value, np.uint8)

        def passing(h: np.ndarray) -> np.ndarray:
            at = np.arange(len(h))
            for m in SPREAD:
                bit = bit_places(h[at], m, bits)
                at = at[(page[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
            return at

        for batch in batches:
            words = batch.column(0).to_pylist()
            for places, codes in by_length(words):
                for h, word, place, letter, kind in edits(codes, alphabet, values):
                    at = passing(h)
                    own = [words[places[i]] for i in word[at].tolist()]
                    found = [written(w, p, letters[c], kind) for w, p, c in zip(own, place[at].tolist(), letter[at].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.string())], ["word", "near"])

    dealt = vocabulary.select("word").repartition(parts(size, WORDS), "word")
    candidates = dealt.mapInArrow(emit, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from a stored table (word, form): the last word that the forms lead to.

    Every round doubles the steps taken, so it takes the logarithm of the longest way; a way can't be longer than the
    times that a frequency can double.
    """
    at = shared_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = shared_table(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moves")), "roots")
        discard(at)
        if moved.where("moves").isEmpty():
            return moved.select("word", "root")
        at = moved


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = None) -> DataFrame:
    """One row per word of the vocabulary: its form, the root that forms lead to, frequency, near words, the form's frequency."""
    vocabulary = shared_table(counted(docs, id_col, text_col, damage).where(F.col("n") >= OCCURRENCES), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word")))
    grouped = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    frequent = -F.col("best.minus") >= RATIO * F.col("n")
    joined = vocabulary.join(grouped, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(frequent, F.col("best.word")).alias("form"),
        F.when(frequent, -F.col("best.minus")).alias("form_n"),
    )
    found = shared_table(joined, "forms")
    rooted = roots(found.where("form is not null"))
    return found.join(rooted, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
