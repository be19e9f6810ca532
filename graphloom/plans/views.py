"""The graph as views over relational tables: customers are persons, suppliers universities, nations countries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.lookups import merged
from graphloom.storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, type)."""
    person = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("person").alias("type"))
    university = table(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit("university").alias("type"))
    country = table(spark, sf_dir, "nation").select(F.concat(F.lit("country_"), "n_name").alias("id"), F.col("n_name").alias("title"), F.lit("country").alias("type"))
    career = table(spark, sf_dir, "customer").select(F.concat(F.lit("career_"), "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("title"), F.lit("career").alias("type")).distinct()
    return reduce(DataFrame.unionByName, (person, university, country, career))


def alumni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person, university, year)."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 and l_returnflag = 'R'")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    # Spark judges tables by their compressed files: left alone, it broadcasts orders whose rows take many times the threshold.
    rows = lines.select("l_orderkey", "l_suppkey").join(merged(orders), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy(F.concat(F.lit("P"), "o_custkey").alias("person"), F.concat(F.lit("U"), "l_suppkey").alias("university")).agg(F.min(F.year("o_orderdate")).alias("year"))


def _edges(df: DataFrame, relation: str, weight: str = "1") -> DataFrame:
    return df.select("src", "dst", F.lit(relation).alias("type"), F.expr(weight).cast("long").alias("weight"))


def alumni_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(alumni(spark, sf_dir).select(F.col("person").alias("src"), F.col("university").alias("dst")), "alumni_of")


def born_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return _edges(rows.select(F.concat(F.lit("P"), "c_custkey").alias("src"), F.concat(F.lit("country_"), "n_name").alias("dst")), "born_in")


def has_career(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("src"), F.concat(F.lit("career_"), "c_mktsegment").alias("dst"))
    return _edges(rows, "has_career")


def link_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ord): each event's user and the next event's, in the order of time, without loops.

    The next event is found by ranges of time: within a range by a window, and across ranges by the first of the next.
    """
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    parts = max(1, events.rdd.getNumPartitions())
    # Written once: ranges are sampled, so a second exchange could draw them elsewhere.
    ranged = cut(events.repartitionByRange(parts, "ts", "event_id").sortWithinPartitions("ts", "event_id").withColumn("p", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("p").orderBy("ts", "event_id")
    firsts = ranged.groupBy("p").agg(F.min(F.struct("ts", "event_id", "user_id")).alias("f"))
    follow = firsts.select("p", F.lead("f.user_id").over(Window.orderBy("p")).alias("after"))
    rows = ranged.withColumn("n", F.lead("user_id").over(own)).join(F.broadcast(follow), "p")
    linked = rows.select(F.col("user_id").alias("u"), F.coalesce("n", "after").alias("v"), F.col("event_id").alias("ord")).where("v is not null and u <> v")
    return linked.select(F.concat(F.lit("P"), "u").alias("src"), F.concat(F.lit("P"), "v").alias("dst"), "ord")


def link_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(link_rows(spark, sf_dir).select("src", "dst").distinct(), "link_to")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All directed relations."""
    return reduce(DataFrame.unionByName, (f(spark, sf_dir) for f in (alumni_edges, born_in, has_career, link_to)))


def register(spark: SparkSession, sf_dir: str) -> None:
    """The graph as the temporary views `nodes` and `edges`, for spark.sql."""
    nodes(spark, sf_dir).createOrReplaceTempView("nodes")
    edges(spark, sf_dir).createOrReplaceTempView("edges")
