"""Helpers that the corpus operators share: the shared folder, written tables and digests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import cut as materialise
from graphloom.storage import discard, release, shared_dir

__all__ = ["discard", "materialise", "release", "shared_dir"]

#: Runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def text_of(name: str) -> Column:
    """The text column as a string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long")


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def join_skewed(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int, hot_groups: int = 1024) -> DataFrame:
    """rows joined with the one row that groups has for their keys, though one group may hold most rows.

    Groups of more than total / hot_groups rows (at most hot_groups of them) are broadcast, the others shuffle.
    """
    limit = max(1, total // hot_groups)
    hot = groups.where(F.col(size_col) > limit)
    found = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.where(F.col(size_col) <= limit), keys, "inner")
    return found.unionByName(rest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each end of an edge; component: the smallest node that can be reached.

    Labels fall to the least among the neighbours and then jump to their label's label, so chains halve in each round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = materialise(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v", "l": "lv"}), "v").groupBy("u").agg(F.min("lv").alias("m"))
        low = labels.join(near, "u").select("u", "l", F.least("l", "m").alias("m"))
        jumped = low.join(low.select(F.col("u").alias("m"), F.col("m").alias("j")), "m", "left")
        new = materialise(jumped.select("u", F.col("l").alias("old"), F.least("m", F.coalesce("j", "m")).alias("l")), "labels")
        done = new.where("l <> old").limit(1).count() == 0
        labels = new.select("u", "l")
        if done:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))


#: bitmap_construct_agg makes bitmaps of 4096 bytes; one is one block of a Bloom filter.
BLOCK_BITS = 32_768
BITS_PER_ROW = 16
#: Filters are broadcast; a filter that isn't made in turns has no more blocks (128 MB), beyond more rows are hit in vain.
MAX_BLOCKS = 32_768


def bloom_size(rows: int, most: int | None = MAX_BLOCKS) -> int:
    """Blocks of a filter of so many rows, at most `most`."""
    blocks = max(1, math.ceil(rows * BITS_PER_ROW / BLOCK_BITS))
    return blocks if most is None else min(most, blocks)


def bloom_probes(key: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a key, and its two bits there."""
    bits = F.xxhash64(key, F.lit(1))
    return (
        F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"),
        bits.bitwiseAND(F.lit(BLOCK_BITS - 1)),
        F.shiftright(bits, 17).bitwiseAND(F.lit(BLOCK_BITS - 1)),
    )


def bitmap_bit(bitmap: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), position.bitwiseAND(F.lit(7)).cast("int"))) != 0


def without(df: DataFrame, id_col: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """df without the rows whose id is in gone (distinct ids). Only rows that a Bloom filter of gone hits shuffle."""
    blocks = bloom_size(gone.count())
    block, first, second = bloom_probes(F.col(gone_col).cast("long"), blocks)
    bits = gone.select(block.alias("__block"), F.explode(F.array(first, second)).alias("__pos"))
    bloom = bits.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__pos")).alias("__bits"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(id_col).cast("long").alias("__id"))
    block, first, second = bloom_probes(F.col("__id"), blocks)
    probed = rows.withColumn("__block", block).join(F.broadcast(bloom), "__block", "left")
    hit = F.coalesce(bitmap_bit(F.col("__bits"), first) & bitmap_bit(F.col("__bits"), second), F.lit(False)) & F.col("__id").isNotNull()
    probed = probed.select("__row", "__id", hit.alias("__hit"))
    checked = probed.where("__hit").join(gone.select(F.col(gone_col).cast("long").alias("__id")), "__id", "left_anti")
    return probed.where("not __hit").select("__row.*").unionByName(checked.select("__row.*"))
