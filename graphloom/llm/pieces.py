"""SentencePiece encoding with seeded merge-dropout, and exact decoding.

The vocabulary is that of a public BPE model with byte fallback. A text gets a blank in front, blanks become U+2581,
and pieces are merged from single characters: of all neighbours whose join is a piece, the best-scored pair (leftmost
on ties) is merged next, until no pair is left. With dropout, a candidate merge is skipped for good if a keyed hash of
(seed, draw, word, place of the pair) falls below the rate. Each occurrence of a word has its own draw: numbers of DRAWS
in turn, from a keyed hash of the document id on. So neither equal words nor equal texts under other ids are cut alike,
and results are reproducible. A rate of 0 gives the model's usual encoding, which is looked up.

No piece of such a model holds a blank behind another character or a line feed, so words (blanks and what follows, and
line feeds) are encoded independently, whole batches of words at a time with NumPy.

Defined results: a null text gives null ids and null text back; the empty text gives no ids; a U+2581 in a text is
written as its bytes, so that it doesn't come back as a blank; characters outside the vocabulary are bytes too; repeated
rows (equal id and text) give equal ids; further columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.batches import give_back, slices, whole_texts
from graphloom.llm.shingles import U, mix, stream

BLANK = "▁"
#: So many that the draws of two documents don't meet.
DRAWS = 1 << 62
#: Words of a worker's cache, texts that are cut together, and words that are merged together.
CACHE_WORDS, TOGETHER, CHUNK = 400_000, 256, 20_000
_WORDS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
_NEVER = np.iinfo(np.int32).max
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Pieces, their ids and merge order, and a hash table of the pairs that merge."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.vocab_size()
        pieces = [model.id_to_piece(k) for k in range(n)]
        ordinary = [k for k in range(n) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        byte = {int(pieces[k][3:5], 16): k for k in range(n) if model.is_byte(k)}
        if len(byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.bytes = np.array([byte[b] for b in range(256)], np.int32)
        self.ids = {pieces[k]: k for k in ordinary}
        if any("\n" in p or p.lstrip(BLANK).find(BLANK) >= 0 for p in self.ids):
            raise ValueError("the model has pieces that reach over words")
        # How the bytes of each id come back; of control ids nothing does.
        self.raw = [b""] * n
        for k in ordinary:
            self.raw[k] = pieces[k].replace(BLANK, " ").encode()
        for b, k in byte.items():
            self.raw[k] = bytes([b])
        scores = {k: model.get_score(k) for k in ordinary}
        order = {k: r for r, k in enumerate(sorted(ordinary, key=lambda k: (-scores[k], k)))}
        pairs = [(a, b, k) for p, k in self.ids.items() for c in range(1, len(p)) if (a := self.ids.get(p[:c])) is not None and (b := self.ids.get(p[c:])) is not None]
        self.rank = np.full(n + 1, _NEVER, np.int32)
        for k, r in order.items():
            self.rank[k] = r
        self._table(np.array(pairs, np.int64).reshape(-1, 3))

    def _table(self, pairs: np.ndarray) -> None:
        """Open addressing: slots of keys left << 32 | right, at most `probes` steps from their hash."""
        bits = max(4, int(4 * len(pairs)).bit_length())
        self.shift = U(64 - bits)
        self.keys, self.joins = np.full(1 << bits, -1, np.int64), np.full(1 << bits, len(self.rank) - 1, np.int32)
        keys, joins = pairs[:, 0] << 32 | pairs[:, 1], pairs[:, 2]
        at, self.probes = self._slot(keys), 0
        while len(keys):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.joins[at[put]] = keys[put], joins[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, joins, at = keys[left], joins[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(U) * U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs merge to, one past the last id for those that don't."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), len(self.rank) - 1, np.int32)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == keys[open_]
            out[open_[hit]] = self.joins[at[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            open_, at = open_[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def encode_words(self, words: list[str], draws: np.ndarray, rate: float, seed: int) -> list[bytes]:
        """The ids of each word, as bytes of int32."""
        ids, sizes = self.merged(words, draws, rate, seed)
        flat, ends = ids.tobytes(), np.cumsum(sizes) * 4
        return [flat[e - 4 * s : e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def merged(self, words: list[str], draws: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (none empty) in their order, and how many each word has.

        Pieces of a word are a linked list over its letters. In each step every word that still has a candidate merges
        its best one, and only the two pairs beside it are looked up anew.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters, back = np.unique(codes, return_inverse=True)
        token = np.array([self.ids.get(chr(c), len(self.rank)) for c in letters], np.int32)[back]
        first = np.cumsum(lengths) - lengths
        place = np.arange(len(codes)) - np.repeat(first, lengths)
        end = place + 1
        after, before = np.arange(1, len(codes) + 1), np.arange(-1, len(codes) - 1)
        after[first + lengths - 1] = before[first] = -1
        # What a word is, for the keyed hash: its letters and its draw.
        spelling = np.add.reduceat(mix(codes.astype(U) + U(1)) * stream(int(lengths.max()), 4)[place], first)
        key = np.repeat(mix(spelling + mix(draws.astype(U) + U(seed << 8))), lengths)
        limit = U(min(2**64 - 1, int(rate * 2.0**64)))
        into = np.zeros(len(codes), np.int32)
        # Rank and position in one number: the least is the best pair, leftmost on ties.
        best_of = np.full(len(codes), _NONE)

        def look_up(left: np.ndarray, right: np.ndarray) -> None:
            """Candidates at left: what merging with right gives, unless it is skipped."""
            # Letters without a piece take no part, and become bytes at the end.
            known = (token[left] < len(self.rank)) & (token[right] < len(self.rank))
            ids = self.joined(token[left], token[right])
            rank = self.rank[ids].astype(np.int64)
            ok = known & (rank != _NEVER)
            left, right, ids, rank = left[ok], right[ok], ids[ok], rank[ok]
            if rate > 0:
                spot = (place[left] * 2097152 + place[right]) * 2097152 + end[right]
                stays = mix(key[left] ^ mix(spot.astype(U))) >= limit
                left, ids, rank = left[stays], ids[stays], rank[stays]
            into[left] = ids
            best_of[at_of[left]] = rank << 32 | left

        held, starts = np.arange(len(codes)), first
        at_of = held.copy()
        alive = np.ones(len(codes), bool)
        look_up(np.flatnonzero(after >= 0), after[after >= 0])
        while len(starts):
            best = np.minimum.reduceat(best_of, starts)
            live = best != _NONE
            if 2 * np.count_nonzero(live) <= len(live):
                stay = np.concatenate((np.zeros(starts[0], bool), np.repeat(live, np.diff(np.append(starts, len(held))))))
                held, best_of = held[stay], best_of[stay]
                at_of[held] = np.arange(len(held))
                starts = at_of[first[np.searchsorted(first, best[live] & 0xFFFFFFFF, "right") - 1]]
            else:
                # The places of ended words fall to the word before; they hold no candidate.
                starts = starts[live]
            at = best[live] & 0xFFFFFFFF
            if not len(at):
                break
            gone = after[at]
            token[at], end[at], alive[gone] = into[at], end[gone], False
            next_, last = after[gone], before[at]
            after[at] = next_
            best_of[at_of[at]] = best_of[at_of[gone]] = _NONE
            more = next_ >= 0
            before[next_[more]] = at[more]
            less = last >= 0
            best_of[at_of[last[less]]] = _NONE
            look_up(np.concatenate((at[more], last[less])), np.concatenate((next_[more], at[less])))
        sizes = np.add.reduceat(alive, first, dtype=np.int64)
        word, token, codes = np.repeat(np.arange(len(words)), sizes), token[alive], codes[alive]
        unknown = np.flatnonzero(token == len(self.rank))
        if len(unknown):
            raw = [np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8) for c in codes[unknown].tolist()]
            copies = np.ones(len(token), np.int64)
            copies[unknown] = [len(r) for r in raw]
            sizes = np.bincount(word, weights=copies, minlength=len(words)).astype(np.int64)
            token = np.repeat(token, copies)
            token[token == len(self.rank)] = self.bytes[np.concatenate(raw)]
        return token, sizes

    def decode(self, ids: list[int]) -> str:
        raw = self.raw
        return b"".join([raw[k] for k in ids]).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Encoder:
    """Encodes texts with one vocabulary, rate and seed; without dropout it keeps the words it has met."""

    def __init__(self, model_file: str, rate: float, seed: int) -> None:
        self.vocabulary, self.rate, self.seed = vocabulary(model_file), rate, seed
        # The draws there are: one with all its words if nothing is dropped, else only numbers, as no draw comes twice.
        self.cache: list[dict[str | None, np.ndarray]] | range = range(DRAWS) if rate > 0 else [{}]
        self.literal = self.vocabulary.bytes[list(BLANK.encode())].astype(np.int32)

    def _first(self, doc_id: object) -> int:
        """The draw of a document's first word."""
        key = hashlib.blake2b(f"{self.seed}/{doc_id}".encode(), digest_size=8).digest()
        return int.from_bytes(key, "little") % len(self.cache)

    def encode(self, doc_ids: list, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [self._words(t) if t else [] for t in texts]
        words = [w for ws in cut for w in ws]
        ids, sizes = self._drawn(doc_ids, cut, words) if self.rate > 0 else self._looked_up(words)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, cut)])].tolist()
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]

    def _drawn(self, doc_ids: list, cut: list[list[str | None]], words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and how many each has, with a draw of its own for each."""
        draws = np.concatenate([np.zeros(0, U), *((np.arange(len(ws), dtype=U) + U(self._first(d))) % U(DRAWS) for d, ws in zip(doc_ids, cut, strict=True))])
        if None in words:
            literal = np.array([w is None for w in words])
            ids, sizes = self._merged([w for w in words if w is not None], draws[~literal])
            all_sizes = np.full(len(words), len(self.literal))
            all_sizes[~literal] = sizes
            of_literal = np.repeat(literal, all_sizes)
            out = np.empty(len(of_literal), np.int32)
            out[~of_literal], out[of_literal] = ids, np.tile(self.literal, int(literal.sum()))
            return out, all_sizes
        return self._merged(words, draws)

    def _merged(self, words: list[str], draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.vocabulary.merged(words[at : at + CHUNK], draws[at : at + CHUNK], self.rate, self.seed) for at in range(0, len(words), CHUNK)]
        return np.concatenate([np.zeros(0, np.int32), *(p[0] for p in parts)]), np.concatenate([np.zeros(0, np.int64), *(p[1] for p in parts)])

    def _looked_up(self, words: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The same without dropout, where equal words have equal ids."""
        known = self.cache[0]
        if len(known) > CACHE_WORDS:
            known.clear()
        known[None] = self.literal
        some = list(set(words).difference(known))
        if some:
            ids, sizes = self._merged(some, np.zeros(len(some), U))
            known.update(zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True))
        found = [known[w] for w in words]
        return np.concatenate([np.zeros(0, np.int32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    def _words(self, text: str) -> list[str | None]:
        return self._with_literals(text) if BLANK in text else _WORDS.findall(BLANK + text.replace(" ", BLANK))

    @staticmethod
    def _with_literals(text: str) -> list[str | None]:
        """The words of a text that holds U+2581, None standing for each of these."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(BLANK)):
            if k:
                out.append(None)
            out += _WORDS.findall((BLANK if k == 0 else "") + part.replace(" ", BLANK))
        return out


def _encode(batches: Iterator[pa.RecordBatch], width: int, model_file: str, rate: float, seed: int) -> Iterator[pa.RecordBatch]:
    encoder = Encoder(model_file, rate, seed)
    decode = encoder.vocabulary.decode
    for batch in batches:
        for part in slices(batch, width + 1, TOGETHER):
            texts = part.column(width + 1).to_pylist()
            ids = encoder.encode(part.column(width).to_pylist(), texts)
            whole = [None if x is None else decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]
            if None in texts:
                lists = pa.array(ids, pa.list_(pa.int32()))
            else:
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids or [np.zeros(0, np.int32)]), pa.int32()))
            counts = pa.array([None if x is None else len(x) for x in ids], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:width], lists, counts, pa.array(whole, pa.bool_())], [*part.schema.names[:width], "ids", "n_tokens", "lossless"]
            )
        give_back()


def encode(docs: DataFrame, model_file: str, rate: float = 0.1, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (by default the id) with ids, n_tokens and lossless: whether decoding gave the text again.

    Columns of these three names give way.
    """
    kept = [c for c in ([id_col] if keep is None else keep) if c not in ("ids", "n_tokens", "lossless")]
    columns = [F.col(f"`{c}`") for c in kept]
    schema = docs.select(*columns).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("lossless", T.BooleanType())
    given = docs.select(*columns, F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    width = len(kept)
    return whole_texts(given).mapInArrow(lambda batches: _encode(batches, width, model_file, rate, seed), schema)


def decode(encoded: DataFrame, model_file: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the texts of its ids."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = vocabulary(model_file).decode
        for batch in batches:
            texts = [None if ids is None else back(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return whole_texts(encoded).mapInArrow(run, schema)
