"""Exact deduplication: a two-pass Bloom filter lets unique texts pass without a shuffle.

Pass 1 hashes every text and counts, per bit of a blocked Bloom filter, how many rows set it; the bits set at least
twice form the filter. Pass 2 probes: a row with a bit set only once cannot have a copy and passes straight through,
the others ("possibly repeated") are grouped by SHA-256 of the text. A false positive merely shuffles in vain. Filters keep
their bits per row at any size: beyond FILTER_ROWS rows there are several, each for the digests of one remainder.

Defined results: a null text counts as empty, so all null and empty texts are one group. The largest id stays; a null
id loses to any other. Rows that repeat id and text are one document in duplicate_groups (all kept or none) and leave
one row in drop_duplicates. An empty table gives an empty result. Columns of any name may ride along.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BITS_PER_ROW, BLOCK_BITS, MAX_BLOCKS, bitmap_bit, bloom_probes, bloom_size, join_skewed, materialise, text_of

#: Rows of one filter (128 MB at BITS_PER_ROW); more rows are dealt out by their digests to several, probed in turn.
FILTER_ROWS = 1 << 26


def repeated_filter(digests: DataFrame, rows: int, sha: str = "__sha") -> DataFrame:
    """(__block, __bits): the bits of the Bloom filter that at least two rows set."""
    block, first, second = bloom_probes(F.col(sha), bloom_size(rows, None))
    hits = digests.select(block.alias("__block"), F.explode(F.array(first, second)).alias("__pos"))
    twice = hits.groupBy("__block", "__pos").count().where("count > 1")
    return twice.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__pos")).alias("__bits"))


def filter_of(digests: DataFrame, rows: int, sha: str = "__sha") -> DataFrame:
    """(__block, __bits): the bits that any row sets."""
    block, first, second = bloom_probes(F.col(sha), bloom_size(rows, None))
    hits = digests.select(block.alias("__block"), F.explode(F.array(first, second)).alias("__pos"))
    return hits.groupBy("__block").agg(F.bitmap_construct_agg(F.col("__pos")).alias("__bits"))


def possibly_repeated(rows_df: DataFrame, bloom: DataFrame, rows: int, sha: str = "__sha") -> DataFrame:
    """rows_df with boolean __again: false only if no other row has the same digest."""
    block, first, second = bloom_probes(F.col(sha), bloom_size(rows, None))
    probed = rows_df.withColumn("__block", block).join(F.broadcast(bloom), "__block", "left")
    again = F.coalesce(bitmap_bit(F.col("__bits"), first) & bitmap_bit(F.col("__bits"), second), F.lit(False))
    return probed.withColumn("__again", again).drop("__block", "__bits")


def _probed(ids: DataFrame, rows: int, filter_rows: int) -> DataFrame:
    """ids, which have __id and __sha, stored with __again.

    Beyond filter_rows rows, each of several filters takes the digests of one remainder; files hold these in order, so a
    filter's turn reads its own row groups, and one filter at a time is broadcast.
    """
    turns = max(1, -(-rows // filter_rows))
    if turns == 1:
        stored = materialise(ids, "digests")
        return possibly_repeated(stored, repeated_filter(stored, rows), rows)
    turn = F.pmod(F.xxhash64("__sha", F.lit(3)), F.lit(turns)).cast("int")
    stored = materialise(ids.withColumn("__turn", turn).sortWithinPartitions("__turn"), "digests")
    parts = []
    for k in range(turns):
        own = stored.where(F.col("__turn") == k).drop("__turn")
        parts.append(materialise(possibly_repeated(own, repeated_filter(own, filter_rows), filter_rows), "probed"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_rows: int = FILTER_ROWS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of df."""
    rows = df.count()
    ids = df.select(F.col(id_col).alias("__id"), F.unhex(F.sha2(text_of(text_col).cast("binary"), 256)).alias("__sha"))
    probed = _probed(ids, rows, filter_rows)
    shuffled = probed.where("__again")
    groups = materialise(shuffled.groupBy("__sha").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n")), "groups")
    columns = ["__id", "__sha", "__keep", "__n"]
    once = probed.where("not __again").select("__id", "__sha", F.col("__id").alias("__keep"), F.lit(1).cast("long").alias("__n"))
    again = join_skewed(shuffled.select("__id", "__sha"), groups, ["__sha"], "__n", rows).select(*columns)
    return once.unionByName(again).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_rows: int = FILTER_ROWS) -> DataFrame:
    """df without the rows whose text another row with a larger id has; all columns as they were.

    Rows that repeat id and text are told apart by a hash of all columns. Copies are reduced to one before they shuffle.
    """
    rows = df.count()
    columns = [F.col(f"`{c}`") for c in df.columns]
    sha = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    whole = df.select(F.struct(*columns).alias("__row"), sha.alias("__sha"), F.struct(F.col(id_col), F.xxhash64(*columns)).alias("__order"))
    if rows <= filter_rows:
        bloom, size = repeated_filter(whole.select("__sha"), rows), rows
    else:
        again = _probed(df.select(F.col(id_col).alias("__id"), sha.alias("__sha")), rows, filter_rows).where("__again")
        repeated = materialise(again.groupBy("__sha").count().where("count > 1"), "repeated")
        size = min(repeated.count(), MAX_BLOCKS * BLOCK_BITS // BITS_PER_ROW)
        bloom = filter_of(repeated, size)
    probed = possibly_repeated(whole, bloom, size)
    once = probed.where("not __again").select("__row.*")
    kept = probed.where("__again").groupBy("__sha").agg(F.max_by("__row", "__order").alias("__row")).select("__row.*")
    return once.unionByName(kept)
