import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat_format as C
from graphloom.llm.queries import CHAT_BUDGET, CHAT_HISTORY, ESCAPE_CASE, queries

ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "one two three"), (1, 2, "assistant", "<|end|>\n \\ <|turn|> x<"), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, 5, "user", "a"), (2, 5, "user", "a"), (2, 6, "assistant", "\\b\\l <| \\"), (None, 0, "user", "q"), (None, None, "assistant", "null turn"),
    (3, 0, None, "no role"), (4, 0, "assistant", "w " * 5000), (4, 1, "user", "é"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def wanted(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((-(2**60) if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), digest(loss))
    return out


def test_read_back_equals_input(spark):
    for budget, history in ((1024, 128), (40, 8), (24, 0)):
        windows = C.chat_windows(frame(spark, ROWS), budget, history)
        got = {r["conv_id"]: tuple(r)[1:5] for r in C.conversation_digests(windows).collect()}
        assert got == wanted(ROWS)


def test_windows_keep_budget_history_and_system_turn(spark):
    rows = [(1, 0, "system", "s1 s2")] + [(1, t, "user" if t % 2 else "assistant", " ".join(f"w{t}" for _ in range(1 + t % 7))) for t in range(1, 80)]
    windows = sorted(C.chat_windows(frame(spark, rows), 60, 12).collect(), key=lambda r: r["window"])
    assert len(windows) > 5
    for k, w in enumerate(windows):
        assert w["tokens"] <= 60 and not w["over_budget"]
        assert w["text"].startswith(f"{C.TURN}system{C.SAYS}s1 s2{C.END}")
        assert (w["n_context"] == 0) == (k == 0)
    masked = "".join(w["text"][m["start"] - 1 : m["start"] - 1 + m["length"]] for w in windows for m in w["loss"])
    assert masked == "".join(x for _, _, r, x in rows if r == "assistant")


def test_a_huge_conversation_spans_blocks(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(1000)]
    got = C.conversation_digests(C.chat_windows(frame(spark, rows), 64, 16)).first()
    assert tuple(got)[1:5] == wanted(rows)[1]


def test_empty(spark):
    assert C.conversation_digests(C.chat_windows(frame(spark, []))).collect() == []


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="\\<|bl>end\n é", max_size=12), min_size=1, max_size=8))
def test_escapes_are_reversible(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    rows = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in rows)


def test_query_over_the_whole_table(spark):
    """Digests of every conversation, and of -7, equal those of the rows themselves; most conversations are cut."""
    sf, talks = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    talks[-7] = [(0, "user", ESCAPE_CASE), (1, "assistant", ESCAPE_CASE)]
    got = {r["conv_id"]: r for r in queries()["op2_chat_format"](spark, sf).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss))
        assert row["formatted_chars"] >= len(said)
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    windows = C.chat_windows(rows, CHAT_BUDGET, CHAT_HISTORY).groupBy("conv_id").count().collect()
    assert sum(w["count"] > 1 for w in windows) > len(windows) / 2


def test_given_token_counts_decide(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "w w", 40) for k in range(10)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    by_words, by_count = C.chat_windows(df, 100, 10).count(), C.chat_windows(df, 100, 10, tokens="n").count()
    assert by_words == 1 and by_count > 3
