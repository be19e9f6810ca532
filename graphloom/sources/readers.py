"""Scans of CSV and JSON tables (S4 to S14), with declared or sniffed schemas, tolerant to missing files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import normalize, normalize_title
from graphloom.functions.values import edge_weight

PROPERTIES = "map<string,array<string>>"


@dataclass(frozen=True)
class CrawlConfig:
    """The crawl's limits, with their defaults."""

    max_person_nodes: int = 1300
    per_depth_limit: int = 120
    max_depth: int = 3
    candidate_cap: int = 500
    sleep: float = 0.0


def read_config(spark: SparkSession, path: str) -> CrawlConfig:
    row = spark.read.option("multiLine", True).json(path).first()
    known = {k: v for k, v in (row.asDict() if row else {}).items() if k in CrawlConfig.__dataclass_fields__ and v is not None}
    return CrawlConfig(**known)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed by a declared schema."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_csv_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As read_csv, empty where there is no file."""
    return read_csv(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def _strings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_node_titles(spark: SparkSession, path: str) -> DataFrame:
    """Titles from the column `title` in any case, else from the second column."""
    df = _strings(spark, path)
    named = [c for c in df.columns if c.strip().lower() == "title"] or df.columns[1:2] or df.columns[:1]
    return df.select(F.col(f"`{named[0]}`").alias("title")).where(normalize(F.col("title")).isNotNull())


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, weight) from the first two columns named after persons or universities; empty if there aren't two."""
    df = _strings(spark, path)
    ends = [c for c in df.columns if "person" in c.lower() or "university" in c.lower()][:2]
    if len(ends) < 2:
        return spark.createDataFrame([], "a string, b string, weight double")
    count = next((F.col(f"`{c}`") for c in df.columns if c.strip().lower() == "count"), F.lit(None).cast("string"))
    edges = df.select(F.col(f"`{ends[0]}`").alias("a"), F.col(f"`{ends[1]}`").alias("b"), edge_weight(count).alias("weight"))
    return edges.where((normalize_title(F.col("a")) != "") & (normalize_title(F.col("b")) != ""))


def seed_titles(df: DataFrame) -> DataFrame:
    """Seeds under whichever of their column names there is."""
    name = next(c for c in ("person_title", "title", "name") if c in df.columns)
    return df.select(normalize(F.col(name)).alias("title")).where("title is not null")


def roots_by_type(roots: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """Persons and universities, other types dropped; at most `limit` of each, by title."""
    typed = roots.select("title", F.lower(F.trim("type")).alias("type"))
    out = {}
    for kind in ("person", "university"):
        some = typed.where(F.col("type") == kind).select("title")
        out[kind] = some.orderBy("title").limit(limit) if limit else some
    return out


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of documents (or one per line), by a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An object or an array; nothing where the file is missing or can't be parsed."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    full = T._parse_datatype_string(schema).add("_corrupt", "string")
    rows = spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).cache()
    return rows.where("_corrupt is null").drop("_corrupt")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last document of each key, as a dictionary that is filled in order would keep it."""
    return df.groupBy(key).agg(F.max_by(F.struct("*"), F.col(order)).alias("r")).select("r.*")


def mention_edges(frames: list[DataFrame]) -> DataFrame:
    """Edges of several files as link_to, weight 1; the source is the person's or the university's column."""
    out = None
    for df in frames:
        ends = [F.coalesce(*(F.col(c) for c in (f"{side}_person", f"{side}_university") if c in df.columns)) for side in ("src", "dst")]
        edges = df.select(normalize(ends[0]).alias("src"), normalize(ends[1]).alias("dst"), F.lit("link_to").alias("type"), F.lit(1).alias("weight"))
        out = edges if out is None else out.unionByName(edges)
    return out.where("src is not null and dst is not null")


def grouped_links(links: DataFrame, source: str | None = None) -> DataFrame:
    """The targets of each source, of one source if it is given."""
    rows = links.select(normalize(F.col("source_title")).alias("source"), normalize(F.col("target_title")).alias("target"))
    rows = rows.where(F.col("source") == source) if source else rows
    return rows.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def node_link_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of a node-link document."""
    return doc.select(F.explode("nodes").alias("n")).select("n.*"), doc.select(F.explode("links").alias("l")).select("l.*")
