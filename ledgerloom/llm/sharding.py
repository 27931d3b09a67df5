"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text form a group that stays together, unless it exceeds what a whole shard may
hold; such a group, of which there are ``3 * shards`` at most, is dealt out in pieces. Groups
are packed largest first, each into the shard where the dot product of the group's size vector with
the residual capacity is highest. Large groups are packed first and against the whole
capacity; smaller ones are spread over blocks by their hash, and each block packs its part of what the
levels before it have left of every shard. So no task packs more than about ``BLOCK`` groups, and a group
is not cut because of a block.

Cases: a null text is an empty one (size 1, crc32 0) and joins the group of empty texts;
repeated rows are rows of the group, told apart by a stored row number; a null id is an id like others; a very long text is
a group of its size; columns of other names are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._common import parts, rows_in, shared_table
from ledgerloom.llm.mixing import word_count

SHARDS = 16
#: Groups that one task packs.
BLOCK = 30_000
#: Blocks of a level for each of the level before it.
FAN = 16
#: A group goes to a level at which it takes at most this share of one shard's part of a block; and a piece of a cut group takes that of a shard.
PIECE = 0.25
#: How bytes, tokens and rows weigh in the dot product; bytes most, as the shards keep the law ``bytes``.
DIMENSIONS = ["bytes", "tokens", "rows"]
WEIGHTS = (4.0, 1.0, 1.0)
#: Rows that one task numbers.
NUMBERED = 20_000


def pack(sizes: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """A shard for each row of ``sizes`` (one column a dimension), largest first, by the dot product with the residual of ``capacity`` (a row for each shard)."""
    mean = np.maximum(capacity.mean(axis=0), 1e-9)
    scaled, residual = sizes / mean, capacity / mean
    weighted = scaled * WEIGHTS
    out = np.empty(len(sizes), np.int32)
    for i in np.lexsort((*scaled.T, -scaled.max(axis=1))):
        out[i] = shard = int(np.argmax(residual @ weighted[i]))
        residual[shard] -= scaled[i]
    return out


def levels(groups: int) -> list[int]:
    """Blocks of each level, from the one that packs the largest groups."""
    last, out = parts(groups, BLOCK), [1]
    while out[-1] * FAN < last:
        out.append(out[-1] * FAN)
    return out if last == 1 else [*out, last]


def packer(capacity: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A function that packs the groups of a block into that capacity."""

    def pack_block(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["text_key", "piece"], kind="stable")
        shard = pack(block[DIMENSIONS].to_numpy(float), capacity)
        return pd.DataFrame({"text_key": block["text_key"], "piece": block["piece"], "shard": shard, **{c: block[c] for c in DIMENSIONS}})

    return pack_block


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: row, id, size, crc, tokens, text_key, shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        word_count(text).alias("tokens"),
        F.unhex(F.md5(text.cast("binary"))).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    stored = shared_table(rows, "shard-rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = shared_table(stored.groupBy("text_key").agg(*sums), "shard-groups")
    total = groups.agg(F.count("*").alias("groups"), *[F.sum(c).alias(c) for c in DIMENSIONS]).first()
    whole = np.array([total[c] or 0 for c in DIMENSIONS], float)
    # A group's largest part of one shard, over the dimensions.
    part = F.greatest(*[F.col(c) * (shards / max(x, 1.0)) for c, x in zip(DIMENSIONS, whole, strict=True)])
    # Each of these takes more than a shard in some dimension, so there are at most 3 * shards.
    large = groups.where(part > 1).select("text_key", F.ceil(part / PIECE).cast("long").alias("pieces"))
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("row"), F.col("pieces"))).otherwise(0).alias("piece")
    pieced = stored.join(F.broadcast(large), "text_key", "left").select("row", "id", "size", "crc", "tokens", "text_key", "pieces", piece)
    cut = pieced.where("pieces is not null").groupBy("text_key", "piece").agg(*sums)
    packed = groups.where(part <= 1).select("text_key", F.lit(0).cast("long").alias("piece"), *DIMENSIONS).union(cut.select("text_key", "piece", *DIMENSIONS))
    counts = levels(total["groups"])
    level = F.lit(0)
    for i, n in enumerate(counts[1:], 1):
        level = F.when(part <= PIECE / n, i).otherwise(level)
    packed = shared_table(packed.withColumn("level", level), "shard-packed") if len(counts) > 1 else packed.withColumn("level", F.lit(0))
    residual, placed = np.tile(whole / shards, (shards, 1)), []
    for i, n in enumerate(counts):
        in_blocks = packed.where(F.col("level") == i).withColumn("block", F.pmod(F.xxhash64("text_key", "piece"), F.lit(n)))
        found = in_blocks.groupBy("block").applyInPandas(packer(residual / n), "text_key binary, piece long, shard int, bytes long, tokens long, rows long")
        placed.append(shared_table(found, "shard-placed"))
        if i + 1 < len(counts):
            for r in placed[-1].groupBy("shard").agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).collect():
                residual[r["shard"]] -= [r[c] for c in DIMENSIONS]
    every = reduce(DataFrame.union, placed).select("text_key", "piece", "shard")
    return pieced.join(every, ["text_key", "piece"]).select("row", "id", "size", "crc", "tokens", "text_key", "shard")


def numbered(rows: DataFrame, shard: str, order: list[str], out: str) -> DataFrame:
    """A stored table and gapless numbers from 0 within each shard: parts are counted, then numbered on their own."""
    cut = rows.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts(rows_in(rows), NUMBERED))))
    counts = cut.groupBy(shard, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(shard, "__part").orderBy(*order)
    ranked = cut.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(starts, [shard, "__part"]).withColumn(out, (F.col("__start") + F.col("__rank")).cast("long")).drop("__part", "__start", "__rank")


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per document: size, crc32 of the text, the law that the shards keep, shard, slot within it."""
    rows = shared_table(assign(docs, id_col, text_col, shards), "shard-assigned")
    found = numbered(rows, "shard", ["row"], "slot")
    return found.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
