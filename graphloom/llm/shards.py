"""Sharding by size-tiered compaction under a versioned manifest.

Each arrival is appended as small immutable Parquet shards. Compaction sorts the shards below the target size into
tiers by size; a tier with at least `fanout` shards is a run, and is packed into bins of about the target size, each
of which one task merges into one new shard, without a shuffle. Appending and compacting commit a new version of the
manifest by an atomic rename that fails if the version exists: the loser of a race reads the new manifest and tries
again. Readers see the shards of one version only, and the columns that it states, so no shard is opened to learn
them. vacuum() deletes what no kept version lists.

Defined results: rows come back as they were appended, nulls, repeats and empty texts included; all arrivals need the
same columns, of any names; an empty arrival adds a shard without rows or none; a store without a manifest has version
0 and can't be read.
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphloom.llm.files import Folder

TARGET_BYTES = 128 << 20
FANOUT = 4
#: Bins that are merged by one job.
BINS_PER_JOB = 64


def tier_of(size: int, fanout: int = FANOUT) -> int:
    """Sizes of one tier differ by less than a factor of fanout."""
    return int(math.log(max(size, 1), fanout))


def plan_merges(shards: list[tuple[str, int]], target: int = TARGET_BYTES, fanout: int = FANOUT) -> list[list[tuple[str, int]]]:
    """Bins of similarly sized shards to merge, each of about the target size; shards near the target stay."""
    tiers: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for shard in sorted(shards):
        if shard[1] < target * 3 // 4:
            tiers[tier_of(shard[1], fanout)].append(shard)
    bins = []
    for _, run in sorted(tiers.items()):
        if len(run) < fanout:
            continue
        total = sum(size for _, size in run)
        share, held = total / max(1, round(total / target)), 0
        made: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for shard in run:
            made[int((held + shard[1] / 2) // share)].append(shard)
            held += shard[1]
        bins += [b for b in made.values() if len(b) > 1]
    return bins


class ShardStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folder = spark, Folder(spark, root)

    def version(self) -> int:
        names = self.folder.names("manifests")
        return int(names[-1].removesuffix(".json")) if names else 0

    def manifest(self, version: int | None = None) -> list[tuple[str, int]]:
        """(name, bytes) of the shards of a version, by default the newest."""
        version = self.version() if version is None else version
        return [tuple(s) for s in self.folder.read_json(f"manifests/{version:010d}.json")["shards"]] if version else []

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version that isn't 0, by default the newest."""
        version = self.version() if version is None else version
        return StructType.fromJson(self.folder.read_json(f"manifests/{version:010d}.json")["schema"])

    def _commit(self, added: list[tuple[str, int]], removed: set[str], schema: StructType) -> int:
        while True:
            version = self.version()
            held = self.manifest(version)
            if not removed <= {name for name, _ in held}:
                raise RuntimeError("another writer merged the same shards")
            shards = [s for s in held if s[0] not in removed] + added
            if self.folder.commit_json(f"manifests/{version + 1:010d}.json", {"schema": schema.jsonValue(), "shards": shards}):
                return version + 1

    def _written(self, df: DataFrame) -> list[tuple[str, int]]:
        place = f"data/{uuid.uuid4().hex}"
        df.write.parquet(self.folder.at(place))
        return self.folder.data_files(place)

    @contextmanager
    def _parts_apart(self) -> Iterator[None]:
        """While this holds, a union of single partitions has as many partitions; Spark may zip them into one else."""
        name = "spark.sql.unionOutputPartitioning"
        before = self.spark.conf.get(name, "true")
        self.spark.conf.set(name, "false")
        try:
            yield
        finally:
            self.spark.conf.set(name, before)

    def append(self, df: DataFrame) -> int:
        """Add an arrival; the version that holds it."""
        return self._commit(self._written(df), set(), df.schema)

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merge runs until none is left; the version then."""
        while bins := plan_merges(self.manifest(), target, fanout):
            schema = self.schema()
            for at in range(0, len(bins), BINS_PER_JOB):
                some = bins[at : at + BINS_PER_JOB]
                parts = [self.spark.read.schema(schema).parquet(*(self.folder.at(name) for name, _ in b)).coalesce(1) for b in some]
                with self._parts_apart():
                    merged = self._written(reduce(DataFrame.union, parts))
                self._commit(merged, {name for b in some for name, _ in b}, schema)
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        shards = self.manifest(version)
        if not shards:
            raise ValueError("the store has no shards")
        return self.spark.read.schema(self.schema(version)).parquet(*(self.folder.at(name) for name, _ in shards))

    def vacuum(self, keep: int = 1) -> None:
        """Delete manifests but the newest `keep`, and the shards that only they list. Not while others write."""
        newest = self.version()
        kept = range(max(1, newest - keep + 1), newest + 1)
        live = {name for v in kept for name, _ in self.manifest(v)}
        for place in self.folder.names("data"):
            files = [name for name, _ in self.folder.data_files(f"data/{place}")]
            gone = [name for name in files if name not in live]
            if len(gone) == len(files):
                self.folder.delete(f"data/{place}")
            else:
                for name in gone:
                    self.folder.delete(name)
        for name in self.folder.names("manifests"):
            if int(name.removesuffix(".json")) not in kept:
                self.folder.delete(f"manifests/{name}")
