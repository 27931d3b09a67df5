"""Fingerprints by consistent weighted sampling: gamma draws for each weighted term, collisions by generalised Jaccard similarity.

A text is a bag of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, weighed by their counts. Each of the samples
picks one word and a level of its weight; two bags pick the same with a probability of the sum of the lesser
weights over the sum of the greater ones. A fingerprint holds 16 bits of each pick.

Cases: a null text is empty, and texts without words share one fingerprint, which is all zeros. Texts of the same words
have equal fingerprints. Very long texts are counted in pieces and their words sampled in blocks.
Documents are ordered by falling id, nulls last, then by the text's MD5; rows equal in both stand next to each other, so
of m such rows m - 1 are followed by their own text. Many rows of one id are dealt to many tasks.
A single document is its own next one; an empty table gives an empty result. Columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.llm._common import schema_with, shared_table, slices

#: Samples of a fingerprint; the likeness of two has a standard deviation of at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 128
#: Words whose draws a worker remembers; it starts anew when there are more.
HELD = 1 << 14
#: Words of a text that are weighed at once, and words drawn for at once: their arrays stay in a core's cache.
BLOCK, DRAWN = 2048, 96
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def bag(text: bytes) -> Counter:
    """How often each word is in a text."""
    counts: Counter = Counter()
    at = 0
    while at < len(text):
        cut = SPACE.search(text, at + PIECE)
        end = cut.start() if cut else len(text)
        counts.update(text[at:end].lower().split())
        at = end
    return counts


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 from 24 bits each."""
    return (bits.view(np.int32).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


class Sampler:
    """Draws consistent weighted samples, and remembers the draws of recent words."""

    def __init__(self, samples: int = SAMPLES, held: int = HELD):
        self.salts = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.place: dict[bytes, int] = {}
        self.hashes = np.zeros(held, np.uint64)
        self.step, self.cost, self.shift, self.once = (np.zeros((held, samples), np.float32) for _ in range(4))

    def draws(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each hash and sample a Gamma(2, 1) step, the logarithm of another Gamma(2, 1) draw, and a shift between 0 and 1."""
        a = mixed(hashes[:, None] + self.salts)
        b = (a ^ (a >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        high = np.uint64(32)
        lanes = [x.astype(np.uint32) for x in (a, a >> high, (b >> np.uint64(8)), b >> high)]
        eight, low = np.uint32(8), np.uint32(255)
        u = [uniform(x >> eight) for x in lanes]
        rest = (lanes[0] & low) << np.uint32(16) | (lanes[1] & low) << eight | (lanes[3] & low)
        return -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3])), uniform(rest)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Where the draws of words stand; ``words`` are distinct and at most as many as are held."""
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > len(self.hashes):
            self.place, new = {}, words
        if new:
            at = len(self.place)
            self.place.update(zip(new, range(at, at + len(new)), strict=True))
            self.hashes[at : at + len(new)] = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
            for start in range(at, at + len(new), DRAWN):
                span = slice(start, min(start + DRAWN, at + len(new)))
                self.step[span], self.cost[span], self.shift[span] = step, cost, shift = self.draws(self.hashes[span])
                self.once[span] = cost - step * (1 - shift)  # what a word costs that stands once: its level is 0
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def signature(self, weights: Counter) -> np.ndarray:
        """16 bits of each sample's pick: the word of least cost at the level that its weight reaches."""
        words, best, pick = list(weights), None, None
        columns = np.arange(len(self.salts))
        each = min(BLOCK, len(self.hashes))
        for at in range(0, len(words), each):
            some = words[at : at + each]
            rows = self.rows(some)
            count = np.fromiter(map(weights.__getitem__, some), np.float32, len(some))
            cost, level = self.once[rows], np.zeros(len(columns), np.int64)
            more = np.flatnonzero(count > 1)
            step, shift = self.step[rows[more]], self.shift[rows[more]]
            high = np.floor(np.log(count[more])[:, None] / step + shift)
            cost[more] = self.cost[rows[more]] - step * (high - shift + 1)
            least = cost.argmin(axis=0)
            cost = cost[least, columns]
            where = np.searchsorted(more, least)
            own = np.flatnonzero(count[least] > 1)
            level[own] = high[where[own], own]
            picked = mixed(self.hashes[rows[least]] + level.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            if best is None:
                best, pick = cost, picked
            else:
                best, pick = np.where(cost < best, cost, best), np.where(cost < best, picked, pick)
        return np.zeros(len(columns), np.uint16) if pick is None else (pick >> np.uint64(48)).astype(np.uint16)


def hex_digits(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def with_fingerprint(docs: DataFrame, text: str, out: str, samples: int = SAMPLES) -> DataFrame:
    """``docs`` and the fingerprint of its text column as a string of hex digits, four for each sample."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in slices(batches, text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            marks = [hex_digits(sampler.signature(bag((t or "").encode()))) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], [*batch.schema.names, out])

    return docs.mapInArrow(add, schema_with(docs, out, "string"))


def likeness(one: Column, other: Column) -> Column:
    """Part of the samples in which two fingerprints agree: an estimate of the generalised Jaccard similarity."""
    places = F.sequence(F.lit(1), F.length(one), F.lit(4))
    same = F.filter(places, lambda p: F.substr(one, p, F.lit(4)) == F.substr(other, p, F.lit(4)))
    return F.size(same) / F.size(places)


def edited(text: str, following: str) -> str:
    """The last third of a text replaced by as many code points from the start of the following one, or all it has."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(sampler: Sampler, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
    other = edited(text, following)
    mark = own if other == text else sampler.signature(bag(other.encode()))
    return (len(text), hashlib.sha256(other.encode()).hexdigest(), hex_digits(own), hex_digits(mark), float((own == mark).mean()), float((own == its).mean()))


def _batches(rows: Iterator[tuple], schema: pa.Schema, each: int = 256) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= each or row[-1] is not None:  # a row that carries its text goes at once
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited form, and how like the text is to that form and to the next document.

    Documents are dealt out by ranges of their order, once; a task streams its sorted rows and holds one back until the
    next has come. The last row of a range waits for the first one of the next range: one row of each range carries its
    text for that.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.md5("text"))
    order = [F.desc_nulls_last("id"), F.asc("digest")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    flagged = StructType.fromDDL(f"id long, {RESULT}, part int, head boolean, open boolean, text string")
    flagged_arrow = _arrow(flagged)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = Sampler(samples), TaskContext.get().partitionId()

        def results() -> Iterator[tuple]:
            held, head = None, True
            for batch in slices(batches, "text"):
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    mark = held[2] if held is not None and held[1] == text else sampler.signature(bag(text.encode()))
                    if held is not None:
                        yield (held[0], *_compared(sampler, *held[1:], text, mark), part, head, False, held[1] if head else None)
                        head = False
                    held = (key, text, mark)
            if held is not None:
                yield (held[0], *([None] * 6), part, head, True, held[1])

        return _batches(results(), flagged_arrow)

    found = shared_table(ordered.mapInArrow(stream, flagged), "weighted-samples")
    heads = found.where("head").select("part", F.col("text").alias("following"))
    turns = Window.orderBy("part")  # one row a range, its number only
    numbers = heads.select("part")
    first = numbers.agg(F.min("part").alias("first"))  # one row
    after = numbers.select("part", F.lead("part").over(turns).alias("after")).join(F.broadcast(first)).select("part", F.coalesce("after", "first").alias("after"))
    pairs = found.where("open").select("id", "part", "text").join(after, "part").join(heads.withColumnRenamed("part", "after"), "after").select("id", "text", "following")
    finished = StructType.fromDDL(f"id long, {RESULT}")
    finished_arrow = _arrow(finished)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in slices(batches, "text"):
            texts = [(*p, *(sampler.signature(bag(t.encode())) for t in p[1:])) for p in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            done = [(key, *_compared(sampler, text, own, following, its)) for key, text, following, own, its in texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), finished_arrow, strict=True)], schema=finished_arrow)

    closed = found.where("not open").select("id", *[f.name for f in finished.fields[1:]])
    return closed.unionByName(pairs.mapInArrow(finish, finished)).withColumnRenamed("id", id_col)
