"""The shared folder of a cluster, and tables written there to cut the lineage of iterative algorithms."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on a local master whose session names no spark.checkpoint.dir (tests, notebooks).
FALLBACK_DIR = "/tmp/checkpoints/graphloom"

#: Paths of written tables; a table knows its own.
_written: list[str] = []
_PATH = "_cut_path"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; on a cluster it must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df in the shared folder and read it back: later plans start there, also after an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PATH, path)
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Delete a table that cut() wrote, once all that was made of it is written too."""
    path = getattr(table, _PATH, None)
    if path in _written:
        _delete(table.sparkSession, path)
        _written.remove(path)
    # Shuffle files go when the driver collects the plans that made them.
    table.sparkSession.sparkContext._jvm.System.gc()


def trim(spark: SparkSession) -> None:
    """Executors collect their garbage, and so return the heap that it held: it would stand beside later Python workers."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def settled(make: Callable[[], DataFrame], name: str, spark: SparkSession) -> DataFrame:
    """cut() of what make gives, without the tables that it wrote on its way."""
    before = set(_written)
    table = cut(make(), name)
    for path in [p for p in _written if p not in before and p != getattr(table, _PATH)]:
        _delete(spark, path)
        _written.remove(path)
    return table


def release(spark: SparkSession) -> None:
    """Delete what cut() wrote; results that still read it must have been stored before."""
    while _written:
        _delete(spark, _written.pop())
