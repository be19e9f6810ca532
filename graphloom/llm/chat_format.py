"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens decide where: with a stride s, the turns
that lie between two multiples of s form one window, and a turn that crosses a multiple is a window of its own. Hence
the new turns of a window never exceed s tokens, unless a single turn does (over_budget). Each window starts with the
conversation's leading system turn and with as many of the turns just before it as fit into `history` tokens; those
repeated turns are context and are outside the loss mask, which covers each assistant text exactly once.

The prefix sums are taken in blocks of turn numbers and then over the blocks, and windows are joined by
(conversation, window), so that one huge conversation is spread over many tasks.

The tokens of a turn are its words unless a column of counts is given.

Template: `<|turn|>ROLE<|says|>TEXT<|end|>\\n`. In roles and texts `\\` becomes `\\b` and `<|` becomes `\\l`, so no
control string occurs inside them and the way back is exact.

Defined results: null roles and texts are empty; turns with equal numbers are ordered by role, then text, and repeated
rows are repeated turns; null turn numbers come first; a null conversation id is a conversation; an empty table gives
no windows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import word_count

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Tokens that the template itself adds to a turn.
TURN_OVERHEAD = 4
#: Turn numbers per block of the first prefix sum.
BLOCK_TURNS = 256


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str, tokens: str | None) -> DataFrame:
    """Turns with their position and the token prefix sums before (start) and after (end) them."""
    base = turns.select(
        F.col(conv).alias("c"),
        F.col(turn).cast("long").alias("o"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("r"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"),
        (F.lit(None) if tokens is None else F.col(tokens)).cast("long").alias("t"),
    ).select(
        "c", "o", "r", "x",
        F.floor(F.coalesce(F.col("o"), F.lit(-(2**60))) / BLOCK_TURNS).alias("b"),
        (F.coalesce(F.col("t"), word_count(F.col("x"))) + TURN_OVERHEAD).alias("k"),
    )
    inside = Window.partitionBy("c", "b").orderBy("o", "r", "x").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = base.groupBy("c", "b").agg(F.sum("k").alias("bk"), F.count(F.lit(1)).alias("bn")).select(
        F.col("c").alias("bc"),
        F.col("b").alias("bb"),
        F.coalesce(F.sum("bk").over(before), F.lit(0)).alias("off_k"),
        F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("off_n"),
    )
    numbered = base.select("*", F.sum("k").over(inside).alias("upto"), F.count(F.lit(1)).over(inside).alias("nth"))
    return numbered.join(blocks, F.col("c").eqNullSafe(F.col("bc")) & (F.col("b") == F.col("bb"))).select(
        "c", "r", "x", "k",
        (F.col("nth") + F.col("off_n") - 1).alias("pos"),
        (F.col("upto") + F.col("off_k") - F.col("k")).alias("start"),
        (F.col("upto") + F.col("off_k")).alias("end"),
    )


def chat_windows(
    turns: DataFrame,
    budget: int = 1024,
    history: int = 128,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    tokens: str | None = None,
) -> DataFrame:
    """(conv, window, text, n_context, loss, tokens, over_budget): loss lists (start, length) in code points, from 1.

    tokens names a column with the tokens of each text, as a tokenizer counts them; without it, or where it is null, a
    text's words are its tokens. budget is the limit of tokens in a window: system turn, repeated history and new turns together. A system turn of
    more than budget - history - budget / 4 tokens leaves a stride of budget / 4, and its windows are over budget.
    """
    placed = _placed(turns, conv, turn, role, text, tokens)
    heads = placed.where("pos = 0").select(
        F.col("c").alias("hc"),
        F.when(F.col("r") == "system", F.struct("pos", "r", "x", "k")).alias("head"),
    )
    stride = F.greatest(F.lit(budget - history) - F.coalesce(F.col("head.k"), F.lit(0)), F.lit(max(1, budget // 4)))
    cut = placed.join(heads, F.col("c").eqNullSafe(F.col("hc"))).withColumn("s", stride)
    first, last = F.floor(F.col("start") / F.col("s")), F.floor((F.col("end") - 1) / F.col("s"))
    new = cut.select("*", (first * 2 + F.when(last > first, 1).otherwise(0)).alias("w"))
    windows = new.groupBy("c", "w", "s").agg(F.min("start").alias("opens"), F.min("pos").alias("at"), F.first("head").alias("head")).select(
        F.col("c").alias("wc"), F.col("w").alias("ww"), "opens", "at", F.col("head").alias("whead")
    )
    # A turn is history of the windows that open between its end and its start plus `history`: at most a few numbers.
    reach = F.explode(
        F.sequence(F.floor(F.col("end") / F.col("s")) * 2, F.floor((F.col("start") + history) / F.col("s")) * 2 + 1)
    )
    past = (
        cut.where((F.col("k") <= history) & (F.col("pos") > F.when(F.col("head").isNull(), -1).otherwise(0)))
        .select("c", "pos", "r", "x", "k", "start", "end", reach.alias("w"))
        .join(windows, F.col("c").eqNullSafe(F.col("wc")) & (F.col("w") == F.col("ww")))
        .where((F.col("opens") >= F.col("end")) & (F.col("opens") - F.col("start") <= history))
    )
    system = windows.where("whead is not null and at > 0")
    rows = (
        new.select("c", "w", "pos", F.lit(0).alias("ctx"), "r", "x", "k")
        .unionByName(past.select("c", "w", "pos", F.lit(1).alias("ctx"), "r", "x", "k"))
        .unionByName(system.select(F.col("wc").alias("c"), F.col("ww").alias("w"), "whead.pos", F.lit(1).alias("ctx"), "whead.r", "whead.x", "whead.k"))
        .select(
            "c", "w", "pos", "ctx", "k",
            F.concat(F.lit(TURN), escape(F.col("r")), F.lit(SAYS)).alias("h"),
            escape(F.col("x")).alias("body"),
            (F.col("r") == "assistant").alias("says"),
        )
    )
    parts = rows.groupBy("c", "w").agg(
        F.array_sort(F.collect_list(F.struct("pos", "ctx", "h", "body", "says"))).alias("t"),
        F.sum("ctx").alias("n_context"),
        F.sum("k").alias("tokens"),
    )
    nothing = F.array().cast("array<struct<start:int,length:int>>")
    marked = F.aggregate(
        "t",
        F.struct(F.lit(1).alias("at"), nothing.alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["h"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(
                t["says"] & (t["ctx"] == 0),
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["h"])).alias("start"), F.length(t["body"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return parts.select(
        F.col("c").alias(conv),
        F.col("w").alias("window"),
        F.array_join(F.transform("t", lambda t: F.concat(t["h"], t["body"], F.lit(END))), "").alias("text"),
        F.col("n_context").cast("int").alias("n_context"),
        marked.alias("loss"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def read_back(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, window, turns, loss_text, n_chars) from formatted windows: new turns as (role, text), masked text unescaped."""
    pieces = F.split(F.col("text"), r"<\|end\|>\n", -1)
    new = F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context"))
    turns = F.transform(
        new,
        lambda p: F.struct(
            unescape(F.substring(F.split_part(p, F.lit(SAYS), F.lit(1)), len(TURN) + 1, 2**31 - 1)).alias("role"),
            unescape(F.split_part(p, F.lit(SAYS), F.lit(2))).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda m: unescape(F.col("text").substr(m["start"], m["length"])))
    return windows.select(
        conv, "window", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"), F.length("text").alias("n_chars")
    )


def conversation_digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, from the formatted windows alone. A digest needs the whole conversation in one row."""
    read = read_back(windows, conv).select(
        conv,
        F.size("turns").alias("n"),
        "n_chars",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
            "loss_text",
        ).alias("part"),
    )
    whole = read.groupBy(conv).agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.array_sort(F.collect_list("part")).alias("parts"),
        F.sum("n_chars").cast("long").alias("formatted_chars"),
    )
    loss = F.array_join(F.col("parts.loss_text"), "")
    return whole.select(
        conv,
        "n_turns",
        F.sha2(F.array_join(F.col("parts.said"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
