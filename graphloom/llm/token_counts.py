"""Token counts in delta-maintained rollups.

Totals by (source, language, tokenizer version) are the sum of signed deltas: an insert adds a document and its tokens,
a delete takes both away, a revised count adds the difference. A batch of changes is aggregated to one row per key,
written once, and committed by creating a file named after the batch; what isn't committed doesn't count, and a batch
that is committed already is not applied again, so batches may be retried at will. compact() folds committed batches
into a base, totals() reads the newest base and the batches after it, and vacuum() deletes the deltas that a base holds.

Defined results: null texts have 0 tokens; null sources, languages and versions are keys; null counts are 0; keys whose
documents and tokens are both 0 are left out of totals; a batch without rows commits nothing but its name; repeated
rows in a batch are repeated changes; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.batches import whole_texts
from graphloom.llm.files import Folder

KEYS = ["source", "lang", "tokenizer"]
INSERT, DELETE, REVISE = "insert", "delete", "revise"
_TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"
#: How the public byte-level vocabulary cuts texts before merging.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(rank_file: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, rank_file: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs with n_tokens, under a byte-level vocabulary of ranks."""
    columns = [F.col(f"`{c}`") for c in keep]
    schema = docs.select(*columns).schema.add("n_tokens", "long")
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(rank_file).encode_ordinary
        for batch in batches:
            counts = [0 if (t := text.as_py()) is None else len(encode(t)) for text in batch.column(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64())], [*batch.schema.names[:width], "n_tokens"])

    return whole_texts(docs.select(*columns, F.col(text_col).cast("string").alias("__text"))).mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Deltas (keys, docs, tokens), one row per key, of changes (op, keys, tokens and, for revisions, old_tokens)."""
    new, old = F.coalesce(F.col("tokens"), F.lit(0)), F.coalesce(F.col("old_tokens"), F.lit(0))
    sign = F.when(F.col("op") == INSERT, 1).when(F.col("op") == DELETE, -1).otherwise(0)
    delta = F.when(F.col("op") == REVISE, new - old).otherwise(sign * new)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(delta).cast("long").alias("tokens"))


class Rollup:
    """A rollup kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.folder = spark, Folder(spark, root)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch of changes; False if it had been committed before."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.folder.names("commits"):
            return False
        place = f"deltas/{batch}-{uuid.uuid4().hex}"
        signed(changes).write.parquet(self.folder.at(place))
        if self.folder.commit_json(f"commits/{batch}", {"at": place}):
            return True
        self.folder.delete(place)
        return False

    def _live(self) -> tuple[int, list[str], list[str]]:
        """Number of the newest base, the places that make up the totals, and the batches they hold."""
        bases = self.folder.names("bases")
        base = self.folder.read_json(f"bases/{bases[-1]}") if bases else {"at": None, "batches": []}
        done = set(base["batches"])
        later = [b for b in self.folder.names("commits") if b not in done]
        places = [base["at"]] * bool(base["at"]) + [self.folder.read_json(f"commits/{b}")["at"] for b in later]
        return len(bases), places, [*base["batches"], *later]

    def _sum(self, places: list[str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*(self.folder.at(p) for p in places))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._live()[1])

    def compact(self) -> bool:
        """Fold all committed batches into a new base; False if another writer committed that base first."""
        number, places, batches = self._live()
        if not places:
            return False
        place = f"deltas/base-{uuid.uuid4().hex}"
        self._sum(places).write.parquet(self.folder.at(place))
        return self.folder.commit_json(f"bases/{number + 1:08d}", {"at": place, "batches": batches})

    def vacuum(self) -> None:
        """Delete deltas that the newest base holds or that were never committed; names of batches stay. Not while others read or write."""
        live = set(self._live()[1])
        for place in self.folder.names("deltas"):
            if f"deltas/{place}" not in live:
                self.folder.delete(f"deltas/{place}")
