"""Word shingles of whole batches of texts as sorted sets of 64-bit hashes, with NumPy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are hashed at once.
PART_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd words."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


_BYTES = stream(256, 1)


def _word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start in joined, and their hashes."""
    raw = np.frombuffer(joined, np.uint8)
    blank = _BLANK[raw]
    before = np.concatenate(([True], blank[:-1]))
    starts = np.flatnonzero(~blank & before)
    if not len(starts):
        return starts, np.zeros(0, U)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    values = _BYTES[_LOWER[raw[starts[0] :]]] * stream(int(lengths.max()), 2)[place]
    values[blank[starts[0] :]] = 0
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def shingle_sets(texts: list[str | None], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each text, one text after the other, and how many each has.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text with fewer than width words has its
    whole sequence as one shingle, and none if it has no word.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    parts, counts, at = [], np.zeros(len(raw), np.int64), 0
    steps = stream(width, 3)
    while at < len(raw):
        stop, size = at, 0
        while stop < len(raw) and (stop == at or size + len(raw[stop]) <= PART_BYTES):
            size += len(raw[stop]) + 1
            stop += 1
        ends = np.cumsum([len(r) + 1 for r in raw[at:stop]])
        starts, words = _word_hashes(b" ".join(raw[at:stop]))
        bounds = np.searchsorted(starts, np.concatenate(([0], ends)))
        spread = len(words) - width + 1
        grams = np.zeros(max(0, spread), U)
        for k in range(width if spread > 0 else 0):
            grams += words[k : k + spread] * steps[k]
        grams = mix(grams)
        for k in range(stop - at):
            a, b = bounds[k], bounds[k + 1]
            if b - a >= width:
                own = np.sort(grams[a : b - width + 1])
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif b > a:
                own = mix(np.array([(words[a:b] * steps[: b - a]).sum() + U(int(b - a) * 0x51ED27)], U))
            else:
                continue
            parts.append(own)
            counts[at + k] = len(own)
        at = stop
    return (np.concatenate(parts) if parts else np.zeros(0, U)), counts
