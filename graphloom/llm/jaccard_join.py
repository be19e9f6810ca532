"""Self-join of documents by the Jaccard similarity of their word shingles, by universe partition and pigeonhole.

Two sets with similarity of at least p % differ in at most H = (100 - p)(|X| + |Y|) / (100 + p) tokens. Sets are put
into bands of sizes [2^k, 2^(k+1)); a band hashes the universe of tokens into m segments, m a little more than its
largest H. A pair is found in the band of its smaller set, so a set is indexed in its own band and, if it is small
enough to have partners below, in the band below. Of any H + 1 segments of a set, a similar set agrees with one; where
bands are small, one-deletion neighbourhoods are indexed as well: a segment of two or more tokens then is worth two
units, as one more or less token is found too. Empty segments are not indexed; a set's segments are worth more units
than it needs, so the allocation may skip those whose lists are longest, and a pair is only looked for in lists that
its larger set keeps. Sets whose segments happen to be worth too little are compared with all others in one more scan.

Equal sets are one class from the start (by a 128-bit digest). Lists with equal members are merged. Within a list,
first every member is verified against one pivot, the member met most often; then, among members that are still in
different components, all pairs across components are verified. No list is ever paired with itself in full. Before
that, a pair's parity bitmaps are compared (a bit tells whether an odd number of tokens fall on it): bitmaps differ in at
most as many bits as the sets do in tokens, so pairs whose bitmaps are more than H apart are left out and none is lost.

Defined results: null and empty texts have no shingles and link with nothing; rows that repeat an id are one document
for the component; the component of a null id counts the ids that aren't null; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.batches import give_back, slices
from graphloom.llm.common import connected_components, discard, join_skewed, materialise, without
from graphloom.llm.shingles import U, mix, shingle_sets

#: Below this size bands index one-deletion neighbourhoods, under so many independent partitions.
DEEP_BELOW, DEEP_PARTITIONS = 64, 3
#: Signatures in a bucket, about; bytes of text that make one signature, about.
BUCKET_SIGNATURES, BYTES_PER_SIGNATURE = 400_000, 8
#: Signatures shuffle in packs of at most so many documents and bytes of text; packs of a bucket are read so many at a time.
PACK_DOCS, PACK_BYTES, PACKS_READ = 2048, 500_000, 64
#: Buckets in a partition of the shuffle, and partitions at most: beyond, partitions hold more buckets, in order.
BUCKETS_TOGETHER, MOST_PARTITIONS = 2, 20_000
#: Pairs whose tokens are in a Python worker's memory at once.
VERIFY_PAIRS = 256
#: Rounds in which sets that share too little are left out.
PRUNINGS = 2
#: 64-bit words of a set's parity bitmap.
PARITY_WORDS = 16
#: Bits of the filter of documents whose tokens are needed (2 MB): beyond, more tokens shuffle, the result is the same.
FILTER_BITS = 1 << 24
_OWN, _BELOW = 0, 1


def most_apart(x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | int:
    return (100 - percent) * (x + y) // (100 + percent)


def band_of(n: np.ndarray) -> np.ndarray:
    """floor(log2 n), for n of at least 1."""
    return np.frexp(n.astype(np.float64))[1] - 1


def segments_of(band: np.ndarray, percent: int) -> np.ndarray:
    """How many segments a band has."""
    top = (np.int64(2) << band.astype(np.int64)) - 1
    need = most_apart(top, top * 100 // percent, percent) + 1
    return np.where(top < 512, (3 * need + 1) // 2, (5 * need + 3) // 4)


def needed_units(n: np.ndarray, kind: int, percent: int) -> np.ndarray:
    """Units that a set of n tokens needs in its own band, or in the one below, to miss no partner there."""
    partner = n * 100 // percent if kind == _OWN else (np.int64(1) << band_of(n).astype(np.int64)) - 1
    return most_apart(n, partner, percent) + 1


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, values.dtype)


def signatures(tokens: np.ndarray, counts: np.ndarray, kind: int, percent: int) -> tuple[np.ndarray, ...]:
    """(signature, document, partition, units, loss): units of its segment at the segment's first signature, else 0;
    loss: the units that are lost where the signature is not looked for.

    tokens: the sorted sets of documents with counts > 0, one after the other, all of which have partners of that kind.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    band = np.repeat(band_of(counts) - kind, counts)
    out: list[tuple[np.ndarray, ...]] = []
    for turn in range(DEEP_PARTITIONS):
        deep = (np.int64(2) << band.astype(np.int64)) <= DEEP_BELOW
        if turn:
            if not deep.any():
                break
            tokens, doc, band = tokens[deep], doc[deep], band[deep]
            place = mix(tokens + U(turn * 0x632BE59BD9B4E019 % 2**64))
            order = np.lexsort((place, doc))
            tokens, doc, band, place, deep = tokens[order], doc[order], band[order], place[order], deep[deep]
        else:
            place = tokens
        m = segments_of(band, percent).astype(U)
        segment = ((place >> U(32)) * m) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1]))))
        size = np.diff(np.append(first, len(tokens)))
        value = mix(tokens + U(0x2545F4914F6CDD1D))
        content = _sums(value, first)
        salt = (segment * U(64) + band.astype(U)) * U(4) + U(turn)
        plain = mix(content + mix(salt[first]))
        worth = np.where(deep[first] & (size > 1), 2, 1)
        out.append((plain, doc[first], np.full(len(first), turn), worth, worth))
        rich = np.flatnonzero(deep & (np.repeat(size, size) > 1))
        if len(rich):
            whole = np.repeat(content, size)[rich]
            out.append((mix(whole - value[rich] + mix(salt[rich])), doc[rich], np.full(len(rich), turn), np.zeros(len(rich), np.int64), np.ones(len(rich), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4)))


def units_of(doc: np.ndarray, turn: np.ndarray, units: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document and partition, its units; partitions are rows."""
    return np.bincount(turn * n_docs + doc, weights=units, minlength=DEEP_PARTITIONS * n_docs).reshape(DEEP_PARTITIONS, n_docs).astype(np.int64)


def _digests(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two digests of each set; 0 for the empty one."""
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        digest = np.zeros(len(counts), U)
        digest[full] = mix(_sums(mix(tokens ^ U(seed)), starts) + counts[full].astype(U))
        out.append(digest.view(np.int64))
    return out[0], out[1]


@contextmanager
def _batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While this holds, Arrow batches have at most so many rows: they hold whole texts and sets."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _taken(tokens: np.ndarray, counts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The tokens of some of the documents."""
    mask = np.zeros(len(counts), bool)
    mask[which] = True
    return tokens[np.repeat(mask, counts)]


_PACKED = "bucket int, doc_id long, n long, s1 long, s2 long, units array<int>, pack long, place int, sigs binary, codes binary"


def _index(batches: Iterator[pa.RecordBatch], percent: int, width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents (bucket -1) and of packed signatures, by bucket."""
    names = [c.split()[0] for c in _PACKED.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def rows(**columns: list) -> pa.RecordBatch:
        k = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * k), t) for c, t in zip(names, types, strict=True)], names)

    for batch in batches:
        for part in slices(batch, 1, PACK_DOCS, PACK_BYTES):
            tokens, counts = shingle_sets(part.column(1).to_pylist(), width)
            s1, s2 = _digests(tokens, counts)
            # Per kind and partition: segments that aren't empty, and units.
            units = np.zeros((len(counts), 2, DEEP_PARTITIONS, 2), np.int64)
            # Copies in this pack are indexed once.
            once = np.zeros(len(counts), bool)
            once[np.unique(s1, return_index=True)[1]] = True
            once &= counts > 0
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for kind in (_OWN, _BELOW):
                chosen = once if kind == _OWN else once & (counts * percent <= 100 * ((1 << band_of(np.maximum(counts, 1)).astype(np.int64)) - 1))
                which = np.flatnonzero(chosen)
                if not len(which):
                    continue
                sig, doc, turn, worth, loss = signatures(_taken(tokens, counts, which), counts[which], kind, percent)
                units[which, kind, :, 0] = units_of(doc, turn, worth > 0, len(which)).T
                units[which, kind, :, 1] = units_of(doc, turn, worth, len(which)).T
                # Document in twelve bits, then partition, loss and kind.
                found.append((sig, (which[doc] | turn << 12 | (loss - 1) << 14 | kind << 15).astype(np.uint16)))
            # A pack is named by what is in it, so that a task that runs again names it alike.
            pack = int((mix(s1.view(U) + np.arange(len(s1), dtype=U))).sum().view(np.int64)) if len(s1) else 0
            k = len(counts)
            yield rows(bucket=[-1] * k, doc_id=part.column(0).to_pylist(), n=counts.tolist(), s1=s1.tolist(), s2=s2.tolist(), units=units.reshape(k, -1).tolist(), pack=[pack] * k, place=list(range(k)))
            if not found:
                continue
            sig, codes = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = ((sig >> U(40)) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, codes = bucket[order], codes[order]
            # Six bytes of a signature are enough: the bucket tells more, and a chance hit is verified away.
            short = sig[order].view(np.uint8).reshape(-1, 8)[:, :6]
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            last = np.append(first[1:], len(bucket))
            for a in range(0, len(first), 64):
                here = list(zip(first[a : a + 64], last[a : a + 64], strict=True))
                yield rows(bucket=[int(bucket[x]) for x, _ in here], pack=[pack] * len(here), sigs=[short[x:y].tobytes() for x, y in here], codes=[codes[x:y].tobytes() for x, y in here])
        give_back()


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, pack, place, code, weight) of the signatures that at least two documents share.

    Rows come in the order of buckets, so one bucket at a time is in memory. weight: signatures with just these members;
    code: partition, loss and kind, as _index packs them.
    """
    last, sigs, own, packs = None, [], [], []
    for batch in batches:
        for bucket, pack, short, codes in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if bucket != last:
                yield from _lists_of(sigs, own, packs)
                last, sigs, own, packs = bucket, [], [], []
            sig = np.zeros((len(short) // 6, 8), np.uint8)
            sig[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
            sigs.append(sig.view(U)[:, 0])
            own.append(np.frombuffer(codes, np.uint16).astype(np.int64) | len(packs) << 16)
            packs.append(pack)
    yield from _lists_of(sigs, own, packs)
    give_back()


def _lists_of(sigs: list[np.ndarray], own: list[np.ndarray], packs: list[int]) -> Iterator[pa.RecordBatch]:
    """The lists of one bucket; sigs and own are emptied."""
    if not sigs:
        return
    sig, who, pack = np.concatenate(sigs), np.concatenate(own), np.array(packs, np.int64)
    sigs.clear(), own.clear()
    order = np.argsort(sig)
    ordered = sig[order]
    same = ordered[1:] == ordered[:-1]
    shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    sig, who = sig[shared], who[shared]
    if not len(sig):
        return
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(first, len(sig)))
    name = mix(_sums(mix(pack[who >> 16].view(U) * U(0x9E3779B97F4A7C15) + (who & 0xFFFF).astype(U)), first) + size.astype(U))
    useful = _sums((who >> 15 & 1 == _OWN).astype(np.int64), first) > 0
    name, first, size = name[useful], first[useful], size[useful]
    names, at, weight = np.unique(name, return_index=True, return_counts=True)
    for a in range(0, len(names), 20_000):
        s = slice(a, a + 20_000)
        n, f = size[at[s]], first[at[s]]
        member = who[np.repeat(f - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        columns = (np.repeat(names[s], n).view(np.int64), pack[member >> 16], (member & PACK_DOCS - 1).astype(np.int32), (member >> 12 & 15).astype(np.int32), np.repeat(weight[s], n).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["list", "pack", "place", "code", "weight"])


def parities(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per set, PARITY_WORDS words: each bit is the parity of the number of tokens that fall on it."""
    bits = np.uint64(PARITY_WORDS * 64)
    at = np.repeat(np.arange(len(counts), dtype=np.int64) * int(bits), counts) + (tokens % bits).astype(np.int64)
    odd = np.bincount(at, minlength=len(counts) * int(bits)) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64).reshape(len(counts), PARITY_WORDS)


_TOKENS = "rep long, n long, bits array<long>, tokens binary"


def _tokens(batches: Iterator[pa.RecordBatch], width: int, wanted: bytes) -> Iterator[pa.RecordBatch]:
    """(doc_id, size, parity bitmap, tokens) of the documents that the filter lets pass."""
    bits = np.frombuffer(wanted, np.uint8)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = (mix(ids.view(U)) % U(FILTER_BITS)).astype(np.int64)
        passed = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
        for part in slices(passed, 1, 512):
            some = part.column(0)
            tokens, counts = shingle_sets(part.column(1).to_pylist(), width)
            ends = np.cumsum(counts)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * PARITY_WORDS), pa.array(parities(tokens, counts).ravel()))
            sets = pa.array([tokens[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([some, pa.array(counts), words, sets], ["rep", "n", "bits", "tokens"])
        give_back()


def _similar(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of (a, b, ta, tb), the pairs (a, b) that are similar."""
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(ta.as_buffer(), U), np.frombuffer(tb.as_buffer(), U)
            if len(x) > len(y):
                x, y = y, x
            both = np.sort(np.concatenate((x, y)))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["a", "b"])


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that are similar."""
    of_a = tokens.select(F.col("rep").alias("a"), F.col("tokens").alias("ta"))
    of_b = tokens.select(F.col("rep").alias("b"), F.col("tokens").alias("tb"))
    full = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "ta", "tb")
    return full.mapInArrow(partial(_similar, percent=percent), "a long, b long")


def _filter_bits(reps: DataFrame) -> bytes:
    """A bitmap of FILTER_BITS in which the hashes of reps are set, put together from partial bitmaps of executors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[(mix(batch.column(0).to_numpy().astype(np.int64).view(U)) % U(FILTER_BITS)).astype(np.int64)] = True
        packed = np.packbits(bits, bitorder="little").reshape(-1, 4096)
        at = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array([packed[k].tobytes() for k in at], pa.binary())], ["at", "bits"])

    parts = reps.select(F.col("rep").cast("long")).mapInArrow(part, "at long, bits binary")
    whole = np.zeros((FILTER_BITS // 8 // 4096, 4096), np.uint8)
    for row in parts.groupBy("at").agg(F.bitmap_or_agg("bits").alias("bits")).collect():
        whole[row["at"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return whole.tobytes()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs."""
    if not 51 <= percent <= 100:
        raise ValueError("percent must be from 51 to 100: below, partners lie more than one band apart")
    base = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(1, -(-size // (BYTES_PER_SIGNATURE * BUCKET_SIGNATURES)))
    with _batches_of(docs.sparkSession, PACK_DOCS):
        index = materialise(base.mapInArrow(partial(_index, percent=percent, width=width, buckets=buckets), _PACKED), "index")
    rows = materialise(index.where("bucket < 0").select(F.col("doc_id").alias("i"), "n", "s1", "s2", "units", "pack", "place"), "rows")
    total = rows.count()
    # `worth`: a copy that its pack didn't index has no units of its own.
    classes = materialise(
        rows.where("n > 0").groupBy("s1", "s2").agg(
            F.min("i").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.max("units").alias("worth")
        ),
        "classes",
    )
    parts = min(MOST_PARTITIONS, -(-buckets // BUCKETS_TOGETHER))
    packed = index.where("bucket >= 0").select("bucket", "pack", "sigs", "codes").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = packed.mapInArrow(_lists, "list long, pack long, place int, code int, weight long")
    kind, turn, loss = F.shiftright("code", 3), F.col("code").bitwiseAND(3), F.shiftright("code", 2).bitwiseAND(1) + 1
    with _batches_of(docs.sparkSession, PACKS_READ):
        shared = materialise(found.select("list", "pack", "place", kind.alias("kind"), turn.alias("turn"), loss.alias("loss"), "weight"), "shared")
    discard(index)
    # Documents that are indexed stand for their class; copies in several packs become one member.
    indexed = rows.where("units[0] > 0 or units[2] > 0 or units[4] > 0").select("pack", "place", "s1", "s2")
    once = shared.groupBy("list", "pack", "place", "kind", "turn", "loss").agg(F.sum("weight").alias("weight"))
    lists = once.join(indexed, ["pack", "place"]).groupBy("list", "s1", "s2", "kind", "turn", "loss").agg(F.max("weight").alias("weight"))
    lists = materialise(lists, "lists")
    links = _links(lists, classes, base, percent, width)
    components = connected_components(links).withColumnsRenamed({"node": "rep", "component": "least"})
    named = classes.select("s1", "s2", "rep", "size").join(components, "rep", "left").select("s1", "s2", "size", F.coalesce("least", "rep").alias("component_id"))
    linked = join_skewed(rows.where("n > 0").select("i", "n", "s1", "s2"), named, ["s1", "s2"], "size", total)
    alone = rows.where("n = 0").select("i", "n", F.col("i").alias("component_id"))
    return linked.select("i", "n", "component_id").unionByName(alone).select(F.col("i").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _links(lists: DataFrame, classes: DataFrame, base: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b) of similar classes that connect all which are connected."""
    members = lists.join(classes.select("s1", "s2", "rep", "n", "worth"), ["s1", "s2"])
    for _ in range(PRUNINGS):
        members = materialise(_pruned(members, percent), "members")
    wanted = members.select("rep").distinct()
    bits = _filter_bits(wanted)
    scanned = base.where("i is not null").mapInArrow(partial(_tokens, width=width, wanted=bits), _TOKENS)
    with _batches_of(base.sparkSession, PACK_DOCS):
        tokens = materialise(scanned.join(wanted, "rep", "left_semi").groupBy("rep").agg(F.first(F.struct("n", "bits", "tokens")).alias("s")).select("rep", "s.*"), "tokens")

    bitmaps = tokens.select("rep", "n", "bits")
    fits = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    near = _bits_apart(F.col("bits"), F.col("bits2")) <= _most_apart(F.col("n"), F.col("n2"), percent)

    def similar(pairs: DataFrame) -> DataFrame:
        with _batches_of(base.sparkSession, VERIFY_PAIRS):
            return materialise(_verified(pairs, tokens.select("rep", "tokens"), percent), "links")

    popular = members.groupBy("rep").agg(F.sum(F.col("weight") * (F.col("f") - 1)).alias("met"))
    pivots = members.join(popular, "rep").groupBy("list").agg(F.max_by(F.struct(F.col("rep").alias("rep2"), F.col("n").alias("n2")), F.struct(F.col("kind") == _OWN, "met", "rep")).alias("p"))
    met = members.select("list", "rep", "n").join(pivots.select("list", "p.*"), "list").where(fits & (F.col("rep") != F.col("rep2")))
    stars = materialise(met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), "stars")
    ends = stars.join(bitmaps.withColumnRenamed("rep", "a"), "a").join(bitmaps.toDF("b", "n2", "bits2"), "b")
    first = similar(materialise(ends.where(near).select("a", "b"), "pairs"))
    parts = connected_components(first).withColumnsRenamed({"node": "rep", "component": "part"})
    split = members.drop("f").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    # Only lists across parts matter now, and of these only sets that share enough in such lists.
    for _ in range(PRUNINGS):
        crossed = split.groupBy("list").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("list")
        split = materialise(_pruned(split.drop("f").join(crossed, "list", "left_semi"), percent), "split")
    kept = _kept(split, percent)
    split = materialise(kept.join(bitmaps.select("rep", "bits"), "rep"), "split")
    counts = split.groupBy("list", "part").agg(F.count(F.lit(1)).alias("c"))
    largest = counts.groupBy("list").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("list", "major")
    apart = split.join(largest, "list")
    # Of each pair across parts, one side at least is outside its list's largest part.
    columns = ["n", "kind", "part", "keeps", "spent", "full", "bits"]
    asks = apart.where("part <> major").select("list", "rep", *columns)
    told = apart.select("list", F.col("rep").alias("rep2"), *(F.col(c).alias(f"{c}2") for c in columns))
    larger = (F.col("n") > F.col("n2")) | ((F.col("n") == F.col("n2")) & (F.col("rep") > F.col("rep2")))
    # Without deletions, the rarest list that two similar sets share leaves each of them all that they must share.
    sparse = F.least("spent", "spent2") >= F.greatest("full", "full2") - _most_apart(F.col("n"), F.col("n2"), percent)
    enough = F.when(_is_deep(), F.when(larger, F.col("keeps")).otherwise(F.col("keeps2"))).otherwise(sparse)
    rule = fits & near & (F.col("part") != F.col("part2")) & (F.col("kind") + F.col("kind2") < 2) & enough
    pairs = asks.join(told, "list").where(rule).select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    return first.unionByName(similar(materialise(pairs, "pairs"))).unionByName(_of_poor(classes, base, percent, width))


def _bits_apart(x: Column, y: Column) -> Column:
    """In how many bits two parity bitmaps differ."""
    return reduce(Column.__add__, (F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(PARITY_WORDS)))


def _low(n: Column) -> Column:
    """The largest size below the band of n."""
    return F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double") + 0.5))).cast("long") - 1


def _most_apart(x: Column, y: Column, percent: int) -> Column:
    return F.floor((x + y) * (100 - percent) / (100 + percent))


def _worth(turn: Column | int, what: int, kind: Column | None = None) -> Column:
    """Of a set's segments (what = 0) or units (what = 1), those in the band and partition that a row is about."""
    return F.element_at("worth", ((F.col("kind") if kind is None else kind) * DEEP_PARTITIONS + turn) * 2 + what + 1)


def _needs(percent: int) -> Column:
    """The most tokens in which a set and a partner in the band that the row is about differ."""
    partner = F.when(F.col("kind") == _OWN, F.floor(F.col("n") * 100 / percent)).otherwise(_low(F.col("n")))
    return _most_apart(F.col("n"), partner, percent)


def _pruned(members: DataFrame, percent: int) -> DataFrame:
    """members, with the length f of their list, without the sets that can't have a partner.

    At most H segments of two similar sets differ, so in each partition they share all but H of a set's non-empty
    segments: a set that shares fewer with all others together has no partner.
    """
    turns = range(DEEP_PARTITIONS)
    shares = members.groupBy("rep", "kind").agg(*(F.coalesce(F.sum(F.when(F.col("turn") == t, F.col("weight"))), F.lit(0)).alias(f"s{t}") for t in turns))
    enough = F.lit(True)
    for t in turns:
        enough = enough & (F.col(f"s{t}") >= _worth(t, 0) - _needs(percent))
    columns = [c for c in ("list", "rep", "n", "worth", "kind", "turn", "loss", "weight", "part") if c in members.columns]
    left = members.select(*columns).join(shares, ["rep", "kind"]).where(enough).select(*columns)
    lengths = left.groupBy("list").agg(F.count(F.lit(1)).alias("f"), F.min("kind").alias("least")).where(f"f > 1 and least = {_OWN}").select("list", "f")
    return left.join(lengths, "list")


def _kept(members: DataFrame, percent: int) -> DataFrame:
    """members with `keeps`: whether the allocation of the set needs the list.

    A set needs the lists of the partition where it has most units; of these it skips the longest, as long as the
    units that stay are enough. `spent` is what the list and the set's longer ones are worth, `full` what all are.
    Where bands index no deletions, rows that aren't kept are left out: the rarest list that a set shares with a
    partner is kept by both, since lists have one order and the partner shares no more than `spent` from there on.
    """
    turns = [F.struct(_worth(t, 1).alias("u"), F.lit(-t).alias("t")) for t in range(DEEP_PARTITIONS)]
    best = F.greatest(*turns)
    longest = Window.partitionBy("rep", "kind", "turn").orderBy(F.desc("f"), "list").rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.col("weight") * F.col("loss")).over(longest)
    found = members.withColumns({"spent": spent, "full": _worth(0, 0)})
    found = found.withColumn("keeps", (F.col("turn") == -best["t"]) & (F.col("spent") > best["u"] - _needs(percent) - 1))
    return found.where(F.col("keeps") | _is_deep())


def _is_deep() -> Column:
    """Whether the band that a row is about indexes one-deletion neighbourhoods."""
    return F.col("n") < F.when(F.col("kind") == _OWN, DEEP_BELOW).otherwise(2 * DEEP_BELOW)


def _of_poor(classes: DataFrame, base: DataFrame, percent: int, width: int) -> DataFrame:
    """Links of the sets whose units don't suffice, by comparing them with every document, some at a time."""
    n = F.col("n")
    units = [F.greatest(*(_worth(t, 1, F.lit(kind)) for t in range(DEEP_PARTITIONS))) for kind in (_OWN, _BELOW)]
    lacks = units[0] <= _most_apart(n, F.floor(n * 100 / percent), percent)
    lacks |= (n * percent <= _low(n) * 100) & (units[1] <= _most_apart(n, _low(n), percent))
    poor = materialise(classes.where(lacks).select("rep"), "poor")
    none = poor.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    total = poor.count()
    if not total:
        return none
    queries = base.join(poor.withColumnRenamed("rep", "i"), "i", "left_semi").groupBy("i").agg(F.first("t").alias("t"))
    block = 256
    blocks = -(-total // block)
    numbered = materialise(queries.select("i", "t", F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("block")), "queries")
    for k in range(blocks):
        some = numbered.where(F.col("block") == k).select("i", "t").collect()
        sets = [(r["i"], shingle_sets([r["t"]], width)[0]) for r in some]

        def against(batches: Iterator[pa.RecordBatch], sets: list = sets) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    own = shingle_sets([text.as_py()], width)[0]
                    for j, other in sets:
                        if i != j and min(len(own), len(other)) * 100 >= percent * max(len(own), len(other), 1):
                            common = len(np.intersect1d(own, other, assume_unique=True))
                            if 100 * common >= percent * (len(own) + len(other) - common):
                                a.append(i), b.append(j)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        hits = base.where("i is not null").mapInArrow(against, "a long, b long")
        reps = base.sparkSession.createDataFrame([(r["i"],) for r in some] or [(None,)], "b long")
        none = none.unionByName(materialise(hits.join(F.broadcast(reps), "b").select("a", "b"), "poorlinks"))
    return none


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5) -> DataFrame:
    """docs without those of a component that aren't its smallest id; rows that repeat an id stay or go together."""
    found = jaccard_components(docs, id_col, text_col, percent, width).where(~F.col(id_col).eqNullSafe(F.col("component_id")))
    gone = materialise(found.select(F.col(id_col).alias("__gone")).where("__gone is not null").distinct(), "gone")
    return without(docs, id_col, gone, "__gone")
