"""The queries of the corpus operators, over the whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat_format, exact_dedup, jaccard_join, lang_id, mixing, nearest, pieces, quality, shards, token_counts
from graphloom.llm.common import fold_of, materialise, read_table, shared_dir, text_of, word_count

#: Files of public tokenizers; only their paths are used.
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"
RANKS_FILE, RANKS_VERSION = "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_50k"
#: Arrivals in which op9 stores the documents.
ARRIVALS = 6
#: Weights of the sources by code point, repeating; their share of all words; passes over a document at most.
MIX_WEIGHTS, MIX_SHARE, MIX_PASSES = (5.0, 2.0, 1.0), 1.5, 2
#: Tokens of op2's windows, and of the history that they repeat: less than most conversations have, so that most are cut.
CHAT_BUDGET, CHAT_HISTORY = 256, 64
#: Both texts of the additional conversation of op2.
ESCAPE_CASE = r"\### Assistant: </turn> ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ESCAPE_CASE).alias("text"),
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat_format.conversation_digests(chat_format.chat_windows(turns, CHAT_BUDGET, CHAT_HISTORY))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read_table(spark, sf_dir, "documents"), PIECES_FILE)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with their words as a first count, are revised to real counts, and empty ones are deleted."""
    docs = read_table(spark, sf_dir, "documents").withColumn("words", word_count(text_of("text")))
    counted = token_counts.count_tokens(docs, RANKS_FILE, ["source", "lang", "words"])
    counted = materialise(counted.withColumn("tokenizer", F.lit(RANKS_VERSION)), "counts")
    rollup = token_counts.Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")

    def changes(op: str, rows: DataFrame, tokens: str) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), *token_counts.KEYS, F.col(tokens).alias("tokens"), F.col("words").alias("old_tokens"))

    first = changes(token_counts.INSERT, counted, "words")
    rollup.apply("insert", first)
    rollup.apply("revise", changes(token_counts.REVISE, counted, "n_tokens"))
    rollup.compact()
    rollup.apply("insert", first)
    rollup.apply("delete", changes(token_counts.DELETE, counted.where("n_tokens = 0"), "n_tokens"))
    return rollup.totals()


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    profiles = lang_id.learn(docs.where(fold_of(F.col("doc_id")) != 0))
    found = lang_id.predict(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.learn(docs, read_table(spark, sf_dir, "labels").where(fold_of(F.col("doc_id")) != 0))
    found = quality.predict(docs, model, ["doc_id"])
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, stored in arrivals, compacted, and read back from the newest version."""
    docs = read_table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "source", "lang", F.sha2(text_of("text").cast("binary"), 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), word_count(text_of("text")).alias("size"))
    rows, sizes, targets = mixing.mix(docs, MIX_WEIGHTS, MIX_SHARE, MIX_PASSES)
    known = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size long, target double")
    return rows.join(F.broadcast(known), rows["sources"][0].eqNullSafe(known["source"]), "left").select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_exact_dedup, op2_chat_format, op3_sentencepiece, op4_token_counts, op5_language_id,
        op6_quality, op7_jaccard_join, op8_nearest, op9_shards, op10_mixing,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
        """,
        "op9_shards": "SELECT doc_id, source, lang, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
        "op7_jaccard_join": r"""
            WITH RECURSIVE words AS (
                SELECT doc_id, regexp_extract_all(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
                FROM documents
            ), grams AS (
                SELECT DISTINCT doc_id, unnest(CASE
                    WHEN len(w) = 0 THEN []::VARCHAR[]
                    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
                FROM words
            ), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
            common AS (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
                FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
            ), links AS (
                SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
                WHERE 100 * c >= 75 * (a.n + b.n - c)
            ), reach AS (
                SELECT doc_id AS x, doc_id AS y FROM documents
                UNION
                SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
            ), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
        """,
    }
