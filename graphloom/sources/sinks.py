"""Sinks (K1 to K11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import normalized_key
from graphloom.storage import cut
from graphloom.sources.readers import exists

#: Tables that a finished run keeps.
FINAL_TABLES = (
    "nodes_persons", "nodes_universities", "edges_up", "edges_shared", "edges_same_grad", "graph", "node_details",
    "nodes_unified", "edges_unified", "nodes_unified_with_properties", "links",
)


def write_csv(df: DataFrame, path: str) -> None:
    """K1: with header; lists and maps as JSON."""
    plain = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*plain).write.mode("overwrite").csv(path, header=True, escape='"')


def new_rows(df: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose normalised keys are not stored yet, each once."""
    key = normalized_key(*(F.col(k) for k in keys))
    return df.withColumn("_k", key).dropDuplicates(["_k"]).join(stored.select(normalized_key(*(F.col(k) for k in keys)).alias("_k")), "_k", "left_anti").drop("_k")


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: list[str]) -> None:
    """K2: append what isn't stored."""
    if exists(spark, path):
        df = new_rows(df, spark.read.schema(df.schema).parquet(path), keys)
    df.write.mode("append").parquet(path)


def upserted(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """K3: stored rows with the values of new ones of the same key, and the other new ones."""
    values = [c for c in stored.columns if c != key]
    both = stored.alias("s").join(new.alias("n"), key, "full_outer")
    return both.select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"s.{c}")).alias(c) for c in values))


def write_json(df: DataFrame, path: str) -> None:
    """K4: one document per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def with_ids(df: DataFrame, order: str = "title") -> DataFrame:
    """K5: id = place in the order of titles, counted by ranges: no single task sees all rows."""
    # Written once: ranges are sampled, so a second exchange could draw them elsewhere.
    parted = cut(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("_p", "_off")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(order))
    return parted.withColumn("_r", place).join(F.broadcast(offsets), "_p").select((F.col("_r") + F.col("_off")).alias("id"), *df.columns)


def graph_document(persons: DataFrame, universities: DataFrame, edges: dict[str, DataFrame], depths: DataFrame) -> DataFrame:
    """K6: one row with the whole graph, for export of small graphs."""
    parts = [df.agg(F.sort_array(F.collect_list("title")).alias(name)) for name, df in (("persons", persons), ("universities", universities))]
    parts += [df.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name)) for name, df in edges.items()]
    parts.append(depths.agg(F.map_from_entries(F.collect_list(F.struct("depth", "n"))).alias("depth_stats")))
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """K9: rows of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def unwanted(names: list[str], keep: tuple[str, ...] = FINAL_TABLES) -> list[str]:
    """K8: what a clean-up would delete."""
    return sorted(set(names) - set(keep))


def append_chat(df: DataFrame, path: str) -> None:
    """The log of turns, appended."""
    df.write.mode("append").parquet(path)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The elements of a GraphML document, one per row, in order."""
    def quoted(c: str):
        out = F.col(c).cast("string")
        for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit('<graphml><graph edgedefault="directed">').alias("line"))
    n = nodes.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', quoted("id")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.format_string('<edge source="%s" target="%s"/>', quoted("src"), quoted("dst")).alias("line"))
    tail = nodes.sparkSession.range(1).select(F.lit(3).alias("part"), F.lit("</graph></graphml>").alias("line"))
    return head.unionByName(n).unionByName(e).unionByName(tail).orderBy("part", "line").select("line")
