"""A corpus pipeline of five operators: known languages, no copies, no near copies, mixed sources, token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, jaccard_join, lang_id, mixing, pieces
from graphloom.llm.common import fold_of, text_of, word_count
from graphloom.llm.queries import MIX_PASSES, MIX_SHARE, MIX_WEIGHTS, PIECES_FILE
from graphloom.storage import discard, settled, trim

#: The last stage's tokens, the threshold draws and the flow have no SQL form.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _trimmed(stage: Stage) -> Stage:
    """The stage, begun with the executors' heap as small as it gets: what the stage before left there is garbage."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        trim(spark)
        return stage(spark, docs, sf_dir)

    return begun


@_trimmed
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with `lang` as identified, without those whose language can't be told; profiles are of those outside fold 0.

    Null and empty texts and those without a letter go, and all go where no document has a label. Ties of languages go to
    the one that sorts first; repeated rows stay; an empty table gives an empty one; further columns stay as they are.
    """
    return lang_id.identified(docs, lang_id.learn(docs.where(F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) != 0)))


@_trimmed
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; a null id is the least.

    Null texts count as empty. Of rows that repeat id and text one stays, of several with other further columns the one
    whose columns have the largest hash; an empty table gives an empty one; further columns stay as they are.
    """
    return exact_dedup.drop_duplicates(docs)


@_trimmed
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar shingles, the document with the smallest id.

    Texts without words are linked with nothing and stay, as do rows with a null id; rows that repeat an id stay or go
    together; an empty table gives an empty one; further columns stay as they are.
    """
    return jaccard_join.keep_one(docs)


@_trimmed
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice.

    Sizes are words, 0 for null and empty texts; a null source is one of its own, last in order; rows that repeat an id
    are taken alike; an empty table gives an empty one; further columns stay as they are.
    """
    return mixing.mixed(docs, F.array("source"), word_count(text_of("text")), MIX_WEIGHTS, MIX_SHARE, MIX_PASSES)


@_trimmed
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang with token ids.

    Null texts have null ids, empty ones none; documents that the mix repeats have the same ids each time; an empty table
    gives an empty one; further columns go.
    """
    return pieces.encode(docs, PIECES_FILE, keep=["doc_id", "source", "lang"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name, spark)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
