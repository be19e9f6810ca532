"""Counts, degrees, patterns, coverage, rankings and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.values import share, summary


def counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: one row: nodes, edges, and both by type."""
    n = counts(nodes, "type").agg(F.sum("n").alias("n_nodes"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("node_types"))
    e = counts(edges, "type").agg(F.sum("n").alias("n_edges"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("edge_types"))
    return n.join(e, F.lit(True))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A4: (id, in_degree, out_degree, degree) of all nodes; in a graph without parallel edges these are neighbours."""
    ends = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    zero = nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    out = ends.unionByName(zero).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_stats(degree: DataFrame) -> DataFrame:
    """A5, A20."""
    return degree.agg(*summary(F.col("degree"), "degree"))


def relations_of(edges: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """The most frequent relations of each of some nodes; a loop counts twice."""
    ends = edges.select(F.col("src").alias("id"), "type").unionByName(edges.select(F.col("dst").alias("id"), "type"))
    n = ends.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("id", "type").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(n, ["id"], [F.desc("n"), F.asc("type")], k)


def patterns(typed: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent (source type, relation, target type)."""
    n = typed.groupBy("src_type", "type", "dst_type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return n.orderBy(F.desc("n"), "src_type", "type", "dst_type").limit(k)


def profile(edges: DataFrame, node: str) -> DataFrame:
    """Outgoing neighbours by relation."""
    return edges.where(F.col("src") == node).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("dst")).alias("targets"))


def coverage(df: DataFrame, column: str, vocabulary: tuple[str, ...]) -> DataFrame:
    """Rows and percent of each value of a vocabulary, values without rows included."""
    spark = df.sparkSession
    total = df.agg(F.count(F.lit(1)).alias("total"))
    words = spark.createDataFrame([(w,) for w in vocabulary], f"{column} string")
    n = F.broadcast(words).join(counts(df, column), column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.join(F.broadcast(total), F.lit(True)).select(column, "n", share(F.col("n"), F.col("total")).alias("percent"))


def accuracy(judged: DataFrame) -> DataFrame:
    """(type, n, accuracy); the row with a null type is about all."""
    return judged.rollup("type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def lightest_edges(edges: DataFrame) -> DataFrame:
    """(a, b, weight): the least weight of each unordered pair."""
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return pair.groupBy("a", "b").agg(F.min("weight").alias("weight"))


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """L1, L2, L4."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """L3: the first k of each group, with their place; Spark limits each task's groups before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def of_minimal_length(paths: DataFrame, k: int = 5) -> DataFrame:
    """At most k of the shortest paths of each pair."""
    least = paths.groupBy("a", "b").agg(F.min("hops").alias("hops"))
    return top_per_group(paths.join(least, ["a", "b", "hops"]), ["a", "b"], [F.asc("path")], k)


def seeded_order(key: Column, seed: int) -> Column:
    """An order that looks random and is the same everywhere."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"/{seed}")))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows without replacement."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """K rows of each group."""
    return top_per_group(df, [group], [seeded_order(F.col(key), seed).asc(), F.asc(key)], k)


def capped(links: DataFrame, page: str, per_page: int, per_level: int) -> DataFrame:
    """At most per_page links of a page by position, then per_level links by page and position."""
    return top_per_group(links, [page], [F.asc("pos")], per_page).drop("place").orderBy(page, "pos").limit(per_level)
