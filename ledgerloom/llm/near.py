"""Near-duplicates by word shingles: SimHash blocks and MinHash bands find candidates, exact Jaccard similarity decides.

SimHash fingerprints of the five-word shingles go through the pigeonhole blocks of the SimHash operator, which finds the closest copies. At Jaccard 0.8
two fingerprints differ in about 10 of 64 bits, more than pigeonhole blocks can cover with keys that
still tell documents apart, so MinHash bands find the others: a pair at similarity 0.8 shares none of the ``BANDS`` with
probability 5e-8; no other pair at or above ``SIMILAR`` is lost.

Cases: a null or blank text has the empty shingle only, so such texts are alike; a text of
fewer words than a shingle is one shingle; texts of the same words are one node; repeated
rows and null ids are told apart by their row; columns of any name pass through; a very long text
is held whole by the tasks that compare it; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from ledgerloom.llm._common import discard, frugal, shared_table, slices, utf8
from ledgerloom.llm.components import components
from ledgerloom.llm.simhash import close_links, of_hashes

SEED = 42
#: Words of a shingle.
WORDS = 5
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Bands of so many minima each; rows that agree on a band are candidates.
BANDS, ROWS = 32, 4
#: Rows of a bucket that a task compares with one another, on average, and bytes of their texts.
BLOCK, BYTES = 256, 8_000_000

_drawn = np.random.default_rng(SEED)
_TIMES = _drawn.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _drawn.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None, words: int = WORDS) -> tuple[bytes, np.ndarray]:
    """A text's words in lower case joined by spaces, and the distinct hashes of its shingles, sorted."""
    parts = text.lower().split() if text else []
    joined = b" ".join(parts)
    if len(parts) <= words:
        return joined, np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(parts) - words + 1]
    pieces = zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)
    return joined, np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in pieces), np.uint64, len(starts)))


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(hashes), 1024):
        drawn = (hashes[at : at + 1024, None] * _TIMES + _PLUS) >> np.uint64(32)
        least = np.minimum(least, drawn.min(axis=0).astype(np.uint32))
    return least


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles have at least the similarity of a link."""
    small, large = sorted((len(a), len(b)))
    if small * SIMILAR[1] < large * SIMILAR[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * SIMILAR[1] >= (small + large - both) * SIMILAR[0]


def with_bands(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``mark`` (digest of the words), ``finger`` (SimHash of the shingles) and ``bands`` (a key for each band)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            marks, fingers, bands = [], [], []
            for t in utf8(batch, text):
                joined, hashes = shingles(t)
                least = minima(hashes)
                marks.append(xxhash.xxh3_128_digest(joined, SEED))
                fingers.append(of_hashes(hashes))
                bands += [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
            keys = pa.ListArray.from_arrays(np.arange(0, len(bands) + 1, BANDS, dtype=np.int32), pa.array(np.array(bands, np.uint64).view(np.int64)))
            finger = pa.array(np.frombuffer(b"".join(fingers), ">i8").astype("<i8"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary()), finger, keys], [*batch.schema.names, "mark", "finger", "bands"])

    schema = StructType(list(docs.schema.fields)).add("mark", "binary").add("finger", "long").add("bands", DataType.fromDDL("array<long>"))
    return docs.mapInArrow(frugal(add), schema)


def similar_to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text), each head ``a`` (b is null) before its members, the pairs whose texts are similar."""
    head = np.empty(0, np.uint64)
    for batch in batches:
        held = []
        for b, text in zip(batch.column(1).to_pylist(), utf8(batch, "text"), strict=True):
            own = shingles(text)[1]
            if b is None:
                head = own
            held.append(b is not None and similar(head, own))
        kept = pa.array(held, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])


def star_links(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of a head and a row those whose texts in (row, text) are similar.

    Rows stream past their head, so a text travels once for each of its heads; a head of many rows stands before each of the pieces that those are cut into.
    """
    sizes = stars.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("b"), F.col("pieces")).cast("int").alias("piece")
    rows = stars.join(sizes, "a").join(texts.withColumnRenamed("row", "b"), "b").select("a", piece, "b", "text")
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")
    heads = sizes.join(texts.withColumnRenamed("row", "a"), "a").select("a", each, F.lit(None).cast("long").alias("b"), "text")
    stream = heads.union(rows).repartition("a", "piece").sortWithinPartitions("a", "piece", F.col("b").asc_nulls_first())
    return stream.select("a", "b", "text").mapInArrow(frugal(similar_to_heads), "a long, b long")


def found_links(group: pa.Table) -> pa.Table:
    """Links between probes and members of a block of a bucket that join labels not joined so far.

    An index of the members' shingles gives each probe its exact overlaps with all of them.
    """
    probe = group.column("probe").to_numpy()
    rows, labels = group.column("row").to_numpy(), group.column("label").to_numpy()
    sets = [shingles(t)[1] for t in group.column("text").cast(pa.binary()).to_pylist()]
    members = np.flatnonzero(~probe)
    sizes = np.array([len(sets[m]) for m in members], np.int64)
    if not len(members):
        return pa.table({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
    values, owners = np.concatenate([sets[m] for m in members]), np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    root: dict[int, int] = {}

    def find(label: int) -> int:
        while label in root:
            label = root[label]
        return label

    left, right = [], []
    for p in np.flatnonzero(probe).tolist():
        low, high = np.searchsorted(values, sets[p], "left"), np.searchsorted(values, sets[p], "right")
        times = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
        both = np.bincount(owners[at], minlength=len(members))
        for m in members[both * (SIMILAR[0] + SIMILAR[1]) >= (sizes + len(sets[p])) * SIMILAR[0]].tolist():
            a, b = find(int(labels[p])), find(int(labels[m]))
            if a != b:
                root[a] = b
                left.append(rows[p])
                right.append(rows[m])
    return pa.table({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def close_stars(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that SimHash proposes: nodes of one fingerprint and its least node, and least nodes of close fingerprints."""
    of_mark = shared_table(nodes.groupBy(F.col("finger").alias("mark")).agg(F.min("row").alias("id"), F.count("*").alias("n")), "fingers")
    alike = nodes.join(of_mark.where("n > 1").select(F.col("mark").alias("finger"), "id"), "finger").select(F.col("id").alias("a"), F.col("row").alias("b"))
    return alike.union(close_links(of_mark.select("mark", "id")).select("a", "b")).where("a <> b")


def links(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """From stored tables (row, size, finger, bands) and (row, text) to links (a, b) that connect all rows of similar texts.

    Every row of a bucket is first compared with the bucket's head, the row of most neighbours in
    all its buckets, which is the middle of a crowd of edited copies; and with the row that SimHash finds close to it. Then, in buckets whose rows are not all connected,
    rows outside the largest class are compared with all rows, block by block; what
    that costs grows with the rows left over and not with the square of a bucket.
    """
    bands = nodes.select("row", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = shared_table(bands.join(buckets, "key"), "buckets")
    weights = members.groupBy("row").agg(F.sum("n").alias("weight"))
    heads = members.join(weights, "row").groupBy("key").agg(F.max(F.struct("weight", "row"))["row"].alias("head"))
    of_bands = members.join(heads, "key").where("row <> head").select(F.col("head").alias("a"), F.col("row").alias("b"))
    stars = shared_table(of_bands.union(close_stars(nodes)).distinct(), "stars")
    compared_rows = members.select("row").union(stars.select(F.explode(F.array("a", "b")).alias("row"))).distinct()
    texts = nodes.select("row", "size").join(compared_rows, "row", "left_semi").join(documents, "row")
    texts = shared_table(texts.select("row", "text", "size"), "bucket-texts")
    first = shared_table(star_links(stars, texts.select("row", "text")), "star-links")
    label = components(first).select(F.col("node").alias("row"), "component")
    labelled = members.where("n > 2").join(label, "row", "left").join(texts.select("row", "size"), "row")
    labelled = shared_table(labelled.select("key", "n", "row", "size", F.coalesce("component", "row").alias("label")), "labelled")
    classes = labelled.groupBy("key", "n", "label").agg(F.count("*").alias("m"), F.sum("size").alias("bytes"))
    mixed = classes.groupBy("key", "n").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("classes"), F.sum("bytes").alias("bytes")).where("classes > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BYTES)).cast("int")
    chunks = F.greatest(F.ceil((F.col("n") - F.col("top.m")) / BLOCK), F.ceil(F.col("bytes") / BYTES)).cast("int")
    rest = labelled.drop("n", "size").join(mixed.select("key", F.col("top.label").alias("largest"), blocks.alias("blocks"), chunks.alias("chunks")), "key").join(texts.select("row", "text"), "row")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    drawn = lambda seed, n: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(n)).cast("int")
    compared = rest.select("key", drawn(SEED, "blocks").alias("block"), upto("chunks").alias("chunk"), F.lit(False).alias("probe"), "row", "label", "text")
    probes = rest.where("label <> largest").select("key", upto("blocks").alias("block"), drawn(SEED + 1, "chunks").alias("chunk"), F.lit(True).alias("probe"), "row", "label", "text")
    later = compared.union(probes).groupBy("key", "block", "chunk").applyInArrow(found_links, "a long, b long")
    found = shared_table(first.union(later), "near-links")
    discard(members, stars, texts, first, labelled)
    return found


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class of similar texts, connected by links: that of least id, and one row of it; null ids come last."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no name of docs can clash
    id_at, text_at = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    stored = shared_table(with_bands(plain, text_at).withColumn("row", F.monotonically_increasing_id()), "banded-documents")
    first = F.min(F.struct(F.col(id_at).isNull().alias("none"), F.col(id_at).cast("long").alias("id"), F.col("row").alias("row")))
    by_mark = shared_table(stored.groupBy("mark").agg(first.alias("first")), "marks")
    text = F.coalesce(F.col(text_at).cast("string"), F.lit(""))
    nodes = stored.select("row", F.octet_length(text).cast("long").alias("size"), "finger", "bands").join(by_mark.select(F.col("first.row").alias("row")), "row", "left_semi")
    nodes = shared_table(nodes, "nodes")
    found = links(nodes, stored.select("row", text.alias("text")))
    joined = components(found)
    of_class = by_mark.join(joined, by_mark["first"]["row"] == joined["node"], "left").select("first", F.coalesce("component", "first.row").alias("class"))
    kept = of_class.groupBy("class").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    # Most rows stay, so the rows that go are the smaller table to hold against the texts.
    dropped = shared_table(stored.select("row").join(kept, "row", "left_anti"), "dropped-rows")
    discard(nodes, found, by_mark)
    return stored.join(dropped, "row", "left_anti").select(*plain.columns).toDF(*docs.columns)
