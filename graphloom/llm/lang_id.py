"""Language identification by rank-order profiles.

A document's most frequent n-grams (one to three letters, words padded by a blank) are ranked and compared with the
ranked n-grams of each language: the out-of-place distance adds up how far each n-gram is from its place in the
profile, a missing one counting as PROFILE_SIZE. The language with the least distance wins.

Every letter stands for itself, with 20 bits of a 64-bit n-gram (no letter lies beyond U+FFFFF), so that whole documents
are counted by sorting integers; everything that isn't a letter is a blank.

Defined results: `und` with score 0 for a null text or one without letters; equal counts are ranked by n-gram, equal
distances go to the language that sorts first; a training table without labelled text gives `und` for all with score 0;
repeated rows are predicted alike; further columns pass through untouched (predict adds lang_pred and score, in the place of
columns of these names).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import give_back, slices, whole_texts

#: N-grams in a language's profile; of a document so many are compared at most.
PROFILE_SIZE = 400
DOC_GRAMS = 300
#: Documents learned from, about so many for each language, chosen by hash over all that carry its label.
TRAIN_DOCS = 4000
UNKNOWN = "und"
#: How sharply a difference of normalised distances turns into a score.
_SHARPNESS = 40.0


_LETTERS: list[np.ndarray] = []


def letter_grams_of(text: str) -> np.ndarray:
    """All n-grams of a text, unsorted, as integers of 64 bits."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((cp if chr(cp).isalpha() else 0 for cp in range(0x110000)), np.int32, 0x110000))
    codes = _LETTERS[0][np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
    codes = np.concatenate(([0], codes, [0]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    two = codes[:-1] << 20 | codes[1:]
    three = codes[:-2] << 40 | two[1:]
    one = codes[codes != 0]
    return np.concatenate((one | 2 << 60, two | 1 << 60, three))


def counted(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, and their counts."""
    grams = np.sort(grams)
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[starts], np.diff(np.append(starts, len(grams)))


def ranked(grams: np.ndarray, limit: int = DOC_GRAMS) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by n-gram."""
    if not len(grams):
        return grams
    distinct, counts = counted(grams)
    if len(distinct) > 4 * limit:
        floor = np.partition(counts, len(counts) - limit)[len(counts) - limit]
        keep = counts >= floor
        distinct, counts = distinct[keep], counts[keep]
    return distinct[np.argsort(-counts, kind="stable")[:limit]]


@dataclass
class Profiles:
    """Rank of each known n-gram in each language's profile, PROFILE_SIZE where it has none."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, tops: dict[str, list[int]]) -> Profiles:
        languages = sorted(tops)
        grams = np.array(sorted({g for top in tops.values() for g in top}), np.int64)
        ranks = np.full((len(grams) + 1, len(languages)), PROFILE_SIZE, np.int32)
        for k, name in enumerate(languages):
            ranks[np.searchsorted(grams, np.array(tops[name], np.int64)), k] = np.arange(len(tops[name]))
        return cls(languages, grams, ranks)

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(letter_grams_of(text)) if text else ()
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        places = self.ranks[at]
        apart = np.where(places == PROFILE_SIZE, PROFILE_SIZE, np.abs(places - np.arange(len(own))[:, None]))
        distance = apart.sum(0) / (len(own) * PROFILE_SIZE)
        best = int(np.argmin(distance))
        return self.languages[best], float(1 / np.exp(-_SHARPNESS * (distance - distance[best])).sum())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS) -> Profiles:
    """Profiles of the labels in docs, from about train_docs documents of each (all of them where there are fewer)."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    sizes = {r["l"]: r["n"] for r in labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Profiles.of({})
    steps = 1 << 20
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(steps, -(-steps * train_docs // n)))))
    chosen = labelled.where(F.pmod(F.xxhash64("i", F.lit(5)), F.lit(steps)) < share[F.col("l")]).where("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            parts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(lang, []).append(letter_grams_of(text))
            for lang, grams in parts.items():
                distinct, counts = counted(np.concatenate(grams)) if sum(map(len, grams)) else (np.zeros(0), np.zeros(0))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct.astype(np.int64)), pa.array(counts.astype(np.int64))], ["l", "g", "n"])

    totals = whole_texts(chosen.select("l", "t")).mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))
    tops: dict[str, list[int]] = {}
    for r in totals.withColumn("p", place).where(F.col("p") <= PROFILE_SIZE).orderBy("l", "p").collect():
        tops.setdefault(r["l"], []).append(r["g"])
    return Profiles.of(tops)


def predict(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score; columns of these names give way."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).schema.add("lang_pred", "string").add("score", "double")
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(text.as_py()) for text in batch.column(width)]
            give_back()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names[:width], "lang_pred", "score"],
            )

    return whole_texts(docs.select(*(F.col(f"`{c}`") for c in kept), F.col(text_col).cast("string").alias("__text"))).mapInArrow(run, schema)


def identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with lang_col as predicted, without those whose language can't be told (no letters, or no text)."""
    flat = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(f"`{text_col}`").alias("__t"))
    found = predict(flat, profiles, "__t", ["__row"]).where(F.col("lang_pred") != UNKNOWN)
    return found.select(*(F.col("lang_pred").alias(c) if c == lang_col else F.col(f"__row.`{c}`") for c in docs.columns))
