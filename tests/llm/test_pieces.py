import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import pieces as P
from graphloom.llm.queries import PIECES_FILE

sentencepiece = pytest.importorskip("sentencepiece")
TEXTS = ["Hello  world\nfoo", "  lead ", "", " ", "   ", "\n\n \n", "tab\tx\x00", "ﬁ① 中文😀", "Thndou erhaha, ea!", "word " * 3000, "a" * 5000]


def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES_FILE)


def mixed(x):
    """The finaliser of splitmix64 on one Python integer."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def naive_word(word, draw, rate, seed):
    """Agenda processing of one word, with a list of pieces and a set of skipped pairs."""
    m = model()
    odd = lambda k: mixed((k + 1 + (4 << 32)) * 0x9E3779B97F4A7C15 % 2**64) | 1
    spelling = sum(mixed(ord(c) + 1) * odd(k) for k, c in enumerate(word)) % 2**64
    key = mixed((spelling + mixed((draw + (seed << 8)) % 2**64)) % 2**64)
    parts = [(k, k + 1) for k in range(len(word))]
    while True:
        best = None
        for (a, b), (_, c) in zip(parts, parts[1:], strict=False):
            joined = m.piece_to_id(word[a:c])
            if all(m.piece_to_id(word[x:y]) != m.unk_id() for x, y in ((a, b), (b, c), (a, c))):
                if mixed(key ^ mixed((a * 2097152 + b) * 2097152 + c)) >= min(2**64 - 1, int(rate * 2.0**64)) or rate == 0:
                    found = (-m.get_score(joined), joined, a, b, c)
                    best = found if best is None else min(best, found)
        if best is None:
            break
        a, b, c = best[2:]
        k = parts.index((a, b))
        parts[k : k + 2] = [(a, c)]
    out = []
    for a, c in parts:
        known = m.piece_to_id(word[a:c])
        out += [known] if known != m.unk_id() else [m.piece_to_id(f"<0x{x:02X}>") for x in word[a:c].encode()]
    return out


def naive(text, rate, seed, doc_id):
    """A text word by word, with the draws that the document's words take."""
    enc = P.Encoder(PIECES_FILE, rate, seed)
    words = P._WORDS.findall(P.BLANK + text.replace(" ", P.BLANK)) if text else []
    return [k for n, w in enumerate(words) for k in naive_word(w, (enc._first(doc_id) + n) % len(enc.cache), rate, seed)]


def test_no_dropout_equals_the_model():
    got = P.Encoder(PIECES_FILE, 0.0, 1).encode(list(range(len(TEXTS))), TEXTS)
    assert [g.tolist() for g in got] == [model().encode(t) for t in TEXTS]


def test_batches_do_not_matter():
    """Dropout equals a model in plain Python, text by text."""
    texts = [t[:400] for t in TEXTS] + ["internationalization and words, 12345 " * 5]
    for rate in (0.1, 0.3, 0.9):
        got = P.Encoder(PIECES_FILE, rate, 5).encode(list(range(len(texts))), texts)
        assert [g.tolist() for g in got] == [naive(t, rate, 5, k) for k, t in enumerate(texts)]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60), st.integers(0, 3))
def test_lossless(text, seed):
    for rate in (0.0, 0.5, 1.0):
        enc = P.Encoder(PIECES_FILE, rate, seed)
        assert enc.vocabulary.decode(enc.encode([seed], [text])[0].tolist()) == text


def test_dropout_varies_and_repeats():
    a = P.Encoder(PIECES_FILE, 0.2, 1).encode([1, 2, 1], ["internationalization " * 20] * 3)
    b = P.Encoder(PIECES_FILE, 0.2, 2).encode([1], ["internationalization " * 20])
    assert a[0].tolist() == a[2].tolist() != b[0].tolist()
    assert len(a[0]) > len(model().encode("internationalization " * 20))
    whole = P.Encoder(PIECES_FILE, 1.0, 1).encode([1], ["internationalization"])[0]
    assert len(whole) == len("internationalization") + 1


def test_each_occurrence_has_its_own_draw():
    copies = P.Encoder(PIECES_FILE, 0.2, 1).encode(list(range(500)), ["internationalization of the words"] * 500)
    assert len({c.tobytes() for c in copies}) > 100
    one = P.Encoder(PIECES_FILE, 0.2, 1).encode([1], ["\n".join(["internationalization"] * 500)])[0].tolist()
    line = P.Encoder(PIECES_FILE, 0.0, 1).encode([1], ["\n"])[0].tolist()[-1]
    cuts = " ".join(map(str, one)).split(f" {line} ")
    assert len(cuts) == 500 and len(set(cuts)) > 100


def test_dropout_of_a_pair_has_its_rate():
    v = P.vocabulary(PIECES_FILE)
    whole = v.encode_words([P.BLANK + "a"], P.np.zeros(1, int), 0.0, 1)[0]
    got = P.Encoder(PIECES_FILE, 0.25, 1).encode(list(range(8000)), ["a"] * 8000)
    assert len(whole) == 4 and abs(sum(len(g) == 2 for g in got) / 8000 - 0.25) < 0.02


def test_rows(docs):
    rows = [(1, None), (2, ""), (3, "x ▁ y▁"), (3, "x ▁ y▁"), (4, "long " * 40_000), (None, "z")]
    out = P.encode(docs(rows), PIECES_FILE, keep=["doc_id", "keep_id"])
    got = out.collect()
    assert sorted((str(r["doc_id"]), r["lossless"]) for r in got) == [("1", None), ("2", True), ("3", True), ("3", True), ("4", True), ("None", True)]
    back = {(r["doc_id"], r["text"]) for r in P.decode(out, PIECES_FILE).select("doc_id", "text").collect()}
    assert back == set(rows)
    assert P.encode(docs([]), PIECES_FILE).collect() == []
