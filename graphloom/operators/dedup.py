"""Deduplication, set operations and the collapse of parallel edges.

Where the order of rows decides, it is a column; a window never does what a grouped minimum can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalize
from graphloom.functions.vocabulary import UNDIRECTED


def first_by(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    return df.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


def union_distinct(*frames: DataFrame) -> DataFrame:
    """The distinct rows of all."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out.distinct()


def pair_key() -> list[Column]:
    """D3u: ends in order for undirected relations, as they are for others; and the relation."""
    a, b = normalize(F.col("src")), normalize(F.col("dst"))
    either = F.col("type").isin(*UNDIRECTED, "link_to")
    return [F.when(either, F.least(a, b)).otherwise(a), F.when(either, F.greatest(a, b)).otherwise(b), F.col("type")]


def unified_edges(sources: list[DataFrame]) -> DataFrame:
    """The sources (src, dst, type, weight) in order of precedence, one set of keys for all of them."""
    out = None
    for k, df in enumerate(sources):
        rows = df.select("src", "dst", "type", "weight", F.lit(k).alias("prio"))
        out = rows if out is None else out.unionByName(rows)
    kept = first_by(out, pair_key(), ["prio", "src", "dst", "weight"])
    return kept.select("src", "dst", "type", "weight")


def last_edge(edges: DataFrame, order: str) -> DataFrame:
    """G1: one edge per ordered pair, the last one's attributes."""
    return edges.groupBy("src", "dst").agg(F.max_by(F.struct("type", "weight"), order).alias("e")).select("src", "dst", "e.type", "e.weight")


def first_edge(edges: DataFrame, order: str) -> DataFrame:
    """One edge per ordered pair, the first one's relation, unless one is alumni_of."""
    rank = F.struct((F.col("type") != "alumni_of").cast("int"), F.col(order))
    return edges.groupBy("src", "dst").agg(F.min_by("type", rank).alias("type"))


def all_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Declared nodes and those that edges alone name."""
    return nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges within a set of nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def either(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first, or the second where the first has no rows."""
    none = first.limit(1).agg(F.count(F.lit(1)).alias("_n")).where("_n = 0")
    return first.unionByName(second.join(F.broadcast(none), F.lit(True), "inner").drop("_n"))
