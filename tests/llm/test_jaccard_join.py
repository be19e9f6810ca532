import random
import re

import numpy as np

from graphloom.llm import jaccard_join as J
from graphloom.llm.shingles import shingle_sets


def brute(rows, percent=75, width=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({" ".join(w)} if 0 < len(w) < width else {" ".join(w[k : k + width]) for k in range(len(w) - width + 1)})
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, n=150):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdef") for _ in range(draw.randint(1, 7)))
    base = [[word() for _ in range(draw.choice([1, 3, 5, 6, 7, 8, 9, 11, 14, 20, 33, 60, 90, 150, 300]))] for _ in range(n // 5)]
    passage = [word() for _ in range(60)]
    rows = []
    for k in range(n):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 1 + len(text) // 15)):
            text[draw.randrange(len(text))] = word()
        if draw.random() < 0.3:
            text = text + passage
        if draw.random() < 0.2:
            text = text + ["licensed", "under", "these", "terms", "now", "and", "here"]
        rows.append((k * 3 + 1, " ".join(text).upper() if draw.random() < 0.1 else draw.choice([" ", "\t", "\n"]).join(text)))
    return rows


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_equals_brute_force(docs):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(J.jaccard_components(docs(rows))) == brute(rows)


def test_other_thresholds(docs):
    rows = corpus(3, 100)
    assert got(J.jaccard_components(docs(rows), percent=60, width=3)) == brute(rows, 60, 3)


def test_sets_without_enough_units(docs, monkeypatch):
    """Every set counts as one that has to be compared with all."""
    rows = corpus(4, 80)
    monkeypatch.setattr(J, "units_of", lambda doc, turn, units, n: np.zeros((J.DEEP_PARTITIONS, n), np.int64))
    assert got(J.jaccard_components(docs(rows[:40]))) == brute(rows[:40])


def test_edge_cases(docs):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three four five"), (7, long), (8, long + " end"), (9, "one two"), (10, "one  two")]
    assert got(J.jaccard_components(docs(rows))) == brute(rows)
    repeated = got(J.jaccard_components(docs([(1, "a b"), (1, "a b"), (2, "c")])))
    assert repeated == [(1, 1, 1), (1, 1, 1), (2, 1, 2)]
    assert got(J.jaccard_components(docs([]))) == []
    kept = J.keep_one(docs(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows)})
    assert kept.columns == docs(rows).columns


def test_no_signature_is_lost():
    """Each pair that differs in at most H tokens agrees in a segment that the needed units cover."""
    draw = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 6, 7, 9, 15, 16, 17, 40, 63, 64, 100, 200, 400):
        for _ in range(20):
            x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
            more = int(draw.integers(0, len(x) // 3 + 1))
            y = np.sort(np.concatenate((x, draw.integers(0, 2**63, more).astype(np.uint64))))
            if 100 * len(x) < 75 * len(y):
                continue
            found = []
            low = int(J.band_of(np.array([len(x)]))[0])
            for s in (x, y):
                kind = int(J.band_of(np.array([len(s)]))[0]) - low
                sig, _, turn, units, _ = J.signatures(s, np.array([len(s)]), kind, 75)
                enough = J.units_of(np.zeros(len(sig), np.int64), turn, units, 1)[:, 0] >= J.needed_units(np.array([len(s)]), kind, 75)[0]
                found.append((turn, sig, enough))
            for t in range(J.DEEP_PARTITIONS):
                of_x, of_y = (set(sig[turn == t].tolist()) for turn, sig, _ in found)
                assert of_x & of_y or not (found[0][2][t] or found[1][2][t])


def test_shingles():
    tokens, counts = shingle_sets(["a b c d e f", "A b  c d e f ", "a b c d e", "a b", "", None, "x " * 100])
    assert counts.tolist() == [2, 2, 1, 1, 0, 0, 1]
    assert tokens[:2].tolist() == tokens[2:4].tolist() and tokens[4] in tokens[:2]


def test_parities_never_differ_more_than_the_sets():
    draw = np.random.default_rng(6)
    for n in (1, 5, 40, 300, 5000):
        x = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        for drop, more in ((0, 0), (n // 4, 0), (0, n // 3), (n // 5, n // 5), (n, n)):
            y = np.sort(np.concatenate((x[drop:], draw.integers(0, 2**63, more).astype(np.uint64))))
            a, b = J.parities(np.concatenate((x, y)), np.array([len(x), len(y)])).view(np.uint64)
            assert a.shape == (J.PARITY_WORDS,)
            assert sum(int(w).bit_count() for w in a ^ b) <= len(np.setxor1d(x, y))
