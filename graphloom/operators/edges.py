"""Edge builders: mentions, pairs that share an institution, a year, a country or a career."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import normalize
from graphloom.storage import cut


def mentions(links: DataFrame, persons: DataFrame, universities: DataFrame, src_is_person: bool = True) -> DataFrame:
    """Links (src, dst) whose target is a known person or else a known university."""
    known = (
        persons.select(normalize(F.col("title")).alias("name"), F.lit(0).alias("rank"))
        .unionByName(universities.select(normalize(F.col("title")).alias("name"), F.lit(1).alias("rank")))
        .where("name is not null").groupBy("name").agg(F.min("rank").alias("rank"))
    )
    names = ("MENTIONS_PERSON", "MENTIONS_UNIVERSITY") if src_is_person else ("UNI_MENTIONS_PERSON", "UNIVERSITY_MENTIONS_UNIVERSITY")
    found = links.select("src", normalize(F.col("dst")).alias("dst")).join(known, F.col("dst") == F.col("name"))
    return found.select("src", "dst", F.when(F.col("rank") == 0, names[0]).otherwise(names[1]).alias("relation")).distinct()


def in_set(df: DataFrame, column: str, titles: DataFrame) -> DataFrame:
    """Rows whose normalised column is a known title."""
    names = titles.select(normalize(F.col("title")).alias("_t")).distinct()
    return df.join(names, normalize(F.col(column)) == F.col("_t"), "left_semi")


def _pairs(edges: DataFrame, person: str, key: list[str]) -> DataFrame:
    a = edges.select(F.col(person).alias("p1"), *key).distinct()
    return a.join(a.withColumnRenamed("p1", "p2"), key).where("p1 < p2")


def shared(edges: DataFrame, person: str = "person", key: str = "university") -> DataFrame:
    """(p1, p2, count): pairs with at least one key in common, and how many."""
    return _pairs(edges, person, [key]).groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("count"))


def shared_per_key(edges: DataFrame, person: str = "person", key: str = "university") -> DataFrame:
    """A row for each common key, each with the pair's count."""
    pairs = _pairs(edges, person, [key])
    return pairs.join(pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("count")), ["p1", "p2"])


#: Parts into which persons are dealt where many share a value, so that their pairs are many small joins.
BLOCKS = 16


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of different rows (p, keys) with equal keys, once each, every other column as `_1` and `_2`.

    A value that many persons share would be one task, and half of its join be thrown away. So persons are dealt into
    blocks, and each two blocks of a value meet on a key of their own.
    """
    context = rows.sparkSession.sparkContext
    n = max(4 * context.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.where("p is not null").withColumn("_b", F.pmod(F.xxhash64("p"), F.lit(BLOCKS)).cast("int"))
    others = [c for c in rows.columns if c not in keys]
    left = dealt.select(*keys, *(F.col(c).alias(f"{c}_1") for c in others), "_b", F.explode(F.sequence("_b", F.lit(BLOCKS - 1))).alias("_c"))
    right = dealt.select(*keys, *(F.col(c).alias(f"{c}_2") for c in others), F.col("_b").alias("_c"), F.explode(F.sequence(F.lit(0), "_b")).alias("_b"))
    on = [*keys, "_b", "_c"]
    return left.repartition(n, *on).join(right.repartition(n, *on).hint("merge"), on).where("_b < _c or p_1 < p_2").drop("_b", "_c")


def same_value(edges: DataFrame, person: str, keys: list[str]) -> DataFrame:
    """(keys, p1, p2): a row for each key that a pair has in common."""
    met = _met(cut(edges.select(F.col(person).alias("p"), *keys).distinct(), "same"), keys)
    return met.select(*keys, F.least("p_1", "p_2").alias("p1"), F.greatest("p_1", "p_2").alias("p2"))


def _marks(values: Column) -> Column:
    """A bit of 64 for each value: sets without a common bit have no common value."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda m, v: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(v), F.lit(64)).cast("int"))))


def _apart(column: str) -> Column:
    return (F.col(f"{column}_marks_1").bitwiseAND(F.col(f"{column}_marks_2")) == 0) | ~F.arrays_overlap(f"{column}_1", f"{column}_2")


def met_once(edges: DataFrame, person: str, key: str, unless: str) -> DataFrame:
    """(p1, p2), distinct: pairs with a value of `key` in common and none of `unless`.

    A pair comes from the least value in common, which is the one without another before it, and each row has the values
    of `unless`. So pairs are made once, and never shuffled to find their copies.
    """
    sets = edges.groupBy(F.col(person).alias("p")).agg(F.collect_set(key).alias("keys"), F.collect_set(unless).alias("unless"))
    rows = sets.select("p", "unless", _marks(F.col("unless")).alias("unless_marks"), "keys", F.explode("keys").alias("key"))
    rows = rows.withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    met = _met(cut(rows.withColumn("before_marks", _marks(F.col("before"))), "sets"), ["key"]).where(_apart("before") & _apart("unless"))
    return met.select(F.least("p_1", "p_2").alias("p1"), F.greatest("p_1", "p_2").alias("p2"))


def shared_sizes(edges: DataFrame, person: str, key: str) -> DataFrame:
    """How many pairs J5 or J6 would give for each key, without making them: n (n - 1) / 2."""
    n = edges.select(person, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, "n", F.expr("n * (n - 1) div 2").alias("pairs"))


def with_properties(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """Nodes with the properties of their title, an empty map where there are none; the last detail wins."""
    last = details.groupBy("title").agg(F.max_by("properties", "ord").alias("properties"))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    return nodes.join(last, "title", "left").withColumn("properties", F.coalesce("properties", empty))


def typed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the types of both ends."""
    src = nodes.select(F.col("id").alias("src"), F.col("type").alias("src_type"))
    dst = nodes.select(F.col("id").alias("dst"), F.col("type").alias("dst_type"))
    return edges.join(src, "src").join(dst, "dst")


def labelled(df: DataFrame, nodes: DataFrame, column: str = "id") -> DataFrame:
    """With title and type; the id for an unknown title, `unknown` for an unknown type."""
    known = nodes.select(F.col("id").alias(column), "title", "type")
    return df.join(known, column, "left").withColumns({"title": F.coalesce("title", F.col(column).cast("string")), "type": F.coalesce("type", F.lit("unknown"))})


def without_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def of_relation(edges: DataFrame, *relations: str) -> DataFrame:
    """P15."""
    return edges.where(F.col("type").isin(*relations))


def edge_rows(df: DataFrame, src: Column, dst: Column, relation: str, weight: Column | int = 1) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("type"), (F.lit(weight) if isinstance(weight, int) else weight).cast("int").alias("weight"))
