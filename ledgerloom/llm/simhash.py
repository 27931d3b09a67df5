"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, classes.

Cases: a null or blank text has fingerprint zero and links like any other;
a text of fewer words than a shingle is hashed whole, and a very long one in parts; fingerprints are the
nodes, so a group of copies costs one row per table however large it is. Repeated
rows all get their class; rows of one id but of different texts are classed each by its own text, and
do not link those. A null id takes part and never is the least id of a
class that has another; a class of null ids only has a null id. Columns of other names are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import frugal, rows_in, schema_with, shared_table, slices, utf8
from ledgerloom.llm.components import components

SEED = 42
#: Fingerprints link at so many differing bits or fewer.
DISTANCE = 3
#: A fingerprint is cut into so many blocks; a pair within DISTANCE agrees on the rest of them.
BLOCKS = 6
#: A bucket of more distinct fingerprints than this is split by further bits.
BUCKET = 2048


def fingerprint(text: bytes | None, words: int = 3) -> bytes:
    """SimHash of a text's word shingles as eight bytes, highest bit first."""
    parts = text.lower().split() if text else []
    if not parts:
        return bytes(8)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(words, len(parts))
    starts, ends = starts[: len(parts) - k + 1], ends[k - 1 :]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, len(starts), 65536):
        pieces = zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)
        counts += set_bits(b"".join([digest(joined[s:e], SEED) for s, e in pieces]))
    return np.packbits(counts * 2 > len(starts)).tobytes()


def set_bits(hashed: bytes) -> np.ndarray:
    """How many of some hashes of eight bytes have each bit, highest first."""
    return np.unpackbits(np.frombuffer(hashed, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def of_hashes(hashes: np.ndarray) -> bytes:
    """SimHash of shingles by their hashes, as eight bytes, highest bit first."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        counts += set_bits(hashes[at : at + 65536].astype(">u8").tobytes())
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def with_fingerprint(docs: DataFrame, text: str, words: int, out: str) -> DataFrame:
    """``docs`` and the fingerprint of its text column, as a signed long named ``out``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            marks = b"".join(fingerprint(t, words) for t in utf8(batch, text))
            values = np.frombuffer(marks, ">i8").astype("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, out])

    schema = schema_with(docs, out, "long")
    return docs.mapInArrow(add, schema)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cuts(bits: list[int], n: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), n)]


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of the bits on which some pair table is keyed: every choice of blocks that a close pair may share."""
    cut = [sum(1 << b for b in block) for block in _cuts(list(range(64)), blocks)]
    return [sum(choice) for choice in combinations(cut, blocks - distance)]


def finer_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks that add one of ``distance + 1`` parts of the free bits: a close pair agrees on one part."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part) for part in _cuts(free, distance + 1)]


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links inside buckets of rows sorted by (mask, key): each fingerprint to the least id that it reaches in its bucket."""

    def links_of(ids: np.ndarray, marks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        left, right = [], []
        order = np.argsort(ids, kind="stable")
        ids, marks = ids[order], marks[order]
        rest = np.arange(len(ids))
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            frontier = [root]
            while frontier and len(rest):
                close = np.bitwise_count(marks[rest] ^ marks[frontier.pop()]) <= distance
                if close.any():
                    found = rest[close]
                    left.append(np.full(len(found), ids[root]))
                    right.append(ids[found])
                    frontier += found.tolist()
                    rest = rest[~close]
        return left, right

    held: tuple[np.ndarray, ...] | None = None

    def solved(mask: np.ndarray, key: np.ndarray, mark: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        sizes = np.diff(np.r_[first, len(mask)])
        two = first[sizes == 2]
        two = two[np.bitwise_count(mark[two] ^ mark[two + 1]) <= distance]
        left, right = [ids[two]], [ids[two + 1]]
        for at, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            a, b = links_of(ids[at : at + n], mark[at : at + n])
            left += a
            right += b
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    for batch in batches:
        new = tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("mask", "key", "mark", "id"))
        new = (new[0], new[1], new[2].view(np.uint64), new[3])  # bit counts of signed values would be those of their size
        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        mask, key = held[0], held[1]
        if not len(mask):
            continue
        last = np.flatnonzero((mask != mask[-1]) | (key != key[-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
        if cut:
            yield solved(*(x[:cut] for x in held))
            held = tuple(x[cut:] for x in held)
    if held is not None and len(held[0]):
        yield solved(*held)


def close_links(marks: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """From distinct (mark, id) to links (a, b) of ids that connect all marks within ``distance`` bits.

    Rows go to one bucket per block choice. A bucket above ``bucket`` rows is
    not compared: its rows move on to finer buckets, on which every close pair
    of it still agrees once, until buckets are small; with at most 11 free bits
    left a bucket can't exceed 2048 distinct marks. So no task holds more than
    that and no pair is lost. Within a bucket rows link to the least id of
    their local component, fewer links than rows.
    """
    spark = marks.sparkSession
    masks = block_masks(distance, blocks)
    tables = F.array(*[F.lit(_signed(m)) for m in masks])
    rows = marks.select("mark", "id", F.explode(tables).alias("mask"))
    found: DataFrame | None = None
    while True:
        rows = rows.withColumn("key", F.col("mark").bitwiseAND(F.col("mask")))
        deeper = [m for m in masks if 64 - m.bit_count() > int(bucket).bit_length() - 1]
        large, hot = None, 0
        if deeper:
            large = rows.groupBy("mask", "key").count().where(F.col("count") > bucket).select("mask", "key", F.lit(True).alias("hot"))
            large = shared_table(large, "hot-buckets")
            hot = rows_in(large)
        cold = rows
        if hot:
            routed = rows.join(large, ["mask", "key"], "left")
            cold = routed.where("hot is null")
        sorted_rows = cold.select("mask", "key", "mark", "id").repartition("mask", "key").sortWithinPartitions("mask", "key")
        links = sorted_rows.mapInArrow(frugal(lambda it: bucket_links(it, distance)), "a long, b long")
        found = links if found is None else found.union(links)
        if not hot:
            return found
        # Masks of large buckets: block choices times (distance + 1) for each level, a few thousand at most.
        crowded = [r["mask"] % (1 << 64) for r in large.select("mask").distinct().collect()]
        finer = {m: finer_masks(m, distance) for m in crowded}
        pairs = [(_signed(m), _signed(x)) for m, xs in finer.items() for x in xs]
        step = spark.createDataFrame(pairs, "mask long, finer long")
        hot_rows = routed.where("hot").select("mark", "id", "mask").join(F.broadcast(step), "mask")
        rows = shared_table(hot_rows.select("mark", "id", F.col("finer").alias("mask")).distinct(), "finer-rows")
        masks = sorted({x for xs in finer.values() for x in xs})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = DISTANCE) -> DataFrame:
    """One row per document: id, ``fingerprint`` (signed long) and ``component_id``, the least id of its class."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marked = shared_table(with_fingerprint(rows, "text", words, "mark").select("id", "mark"), "fingerprints")
    return classes(marked, distance).select(F.col("id").alias(id_col), F.col("mark").alias("fingerprint"), F.col("least").alias("component_id"))


def classes(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """From a stored table with (id, mark) to the same rows with ``least``, the least id of the row's class."""
    distinct = shared_table(marked.groupBy("mark").agg(F.min("id").alias("id")), "marks")
    joined = components(close_links(distinct.select("mark", F.col("mark").alias("id")), distance))
    of_class = distinct.join(joined, distinct["mark"] == joined["node"], "left").select("mark", "id", F.coalesce("component", "mark").alias("class"))
    least = of_class.groupBy("class").agg(F.min("id").alias("least"))
    return marked.join(of_class.select("mark", "class").join(least, "class").drop("class"), "mark", "left")
