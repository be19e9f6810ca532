"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern; tokens flow from patterns to
the quotas of their sources. A pattern's first pass over its tokens is free and each further one costs more (convex),
so the flow repeats as little as it can. What flows out of a pattern says how many whole passes it makes and how many
tokens the last, partial pass takes; that pass takes documents in the order of a seeded hash, up to a threshold found
from two histograms of hash values, so no group of documents meets in one task and reruns agree.

Defined results: null and empty texts have size 0 and take 0 words; a null source is a source of its own (last in code
point order); documents without any source take nothing; repeated rows with one id are taken alike; an empty table
gives an empty result; further columns stay in the caller's hands, as results carry only the id.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise

#: Patterns are solved for on the driver; more of them are an error, never a cut.
MAX_PATTERNS = 200_000
_HALF = 1 << 16


def source_targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, cap: float) -> dict[str | None, float]:
    """Targets that share `total` by weight; none above cap times its source's size, the excess is shared again."""
    targets: dict[str | None, float] = {}
    open_, left = set(sizes), float(total)
    while open_:
        weight = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / weight > cap * sizes[s]}
        if not over:
            return targets | {s: left * weights[s] / weight for s in open_}
        targets |= {s: float(cap * sizes[s]) for s in over}
        left -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return targets


def cycled_weights(sources: list[str | None], cycle: tuple[float, ...]) -> dict[str | None, float]:
    """The weights of `cycle`, repeating, for the sources in code point order, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode()) + [None] * (None in sources)
    return {s: cycle[k % len(cycle)] for k, s in enumerate(ordered)}


def min_cost_flow(capacity: dict[str, int], members: dict[str, list[str | None]], quota: dict[str | None, int], max_passes: int) -> dict[str, int]:
    """Tokens each pattern gives, so that quotas fill as far as they can at least cost; pass r costs r - 1.

    Successive shortest paths, with one level of repetition opened after the other: a path that costs r - 1 more is
    only taken when none is cheaper. Residual paths lead pattern -> source -> (back along used arcs) pattern -> source.
    """
    used: dict[str, int] = dict.fromkeys(capacity, 0)
    flow: dict[tuple[str, str | None], int] = defaultdict(int)
    need = dict(quota)
    givers: dict[str | None, set[str]] = defaultdict(set)
    for level in range(1, max_passes + 1):
        for start in sorted(capacity, key=lambda p: (len(members[p]), p)):
            while (room := level * capacity[start] - used[start]) > 0:
                came: dict[tuple[str, str | None], tuple | None] = {("p", start): None}
                heap, goal, count = [(0, 0, ("p", start))], None, 0
                while heap:
                    steps, _, node = heapq.heappop(heap)
                    if node[0] == "s" and need.get(node[1], 0) > 0:
                        goal = node
                        break
                    if node[0] == "p":
                        ways = [("s", s) for s in members[node[1]]]
                    else:
                        ways = [("p", p) for p in sorted(givers[node[1]])]
                    for way in ways:
                        if way not in came:
                            came[way] = node
                            count += 1
                            heapq.heappush(heap, (steps + 1, count, way))
                if goal is None:
                    break
                path = [goal]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                amount = min(room, need[goal[1]])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "s":
                        amount = min(amount, flow[b[1], a[1]])
                for a, b in zip(path, path[1:], strict=False):
                    p, s, sign = (a[1], b[1], 1) if a[0] == "p" else (b[1], a[1], -1)
                    flow[p, s] += sign * amount
                    (givers[s].add if flow[p, s] else givers[s].discard)(p)
                used[start] += amount
                need[goal[1]] -= amount
    return used


def _summed(sizes: DataFrame) -> DataFrame:
    """(pattern, bucket, n) with upto, the sum of n up to the bucket: first within runs of buckets, then over the runs,
    so that the buckets of one pattern are spread over tasks."""
    runs = sizes.withColumn("run", F.shiftright("bucket", 8))
    before = Window.partitionBy("pattern").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("pattern", "run").agg(F.sum("n").alias("own")).select("pattern", "run", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pattern", "run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["pattern", "run"]).select("pattern", "bucket", "n", (F.col("upto") + F.col("offset")).alias("upto"))


def _threshold(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, cut): the hash value below which a pattern's documents add up to its `rest` as nearly as they can."""

    high = docs.groupBy("pattern", F.shiftright("h", 16).alias("bucket")).agg(F.sum("size").alias("n"))
    # The first bucket that reaches the rest, and what is below it.
    first = _summed(high).join(F.broadcast(wanted.select("pattern", "rest")), "pattern").where(F.col("upto") >= F.col("rest")).groupBy("pattern").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("left")), "bucket").alias("f"))
    first = materialise(first.select("pattern", F.col("f.bucket").alias("top"), F.col("f.left").alias("left")), "cuts")
    inside = docs.join(F.broadcast(first.select("pattern", "top")), "pattern").where(F.shiftright("h", 16) == F.col("top"))
    low = inside.groupBy("pattern", F.col("h").bitwiseAND(_HALF - 1).alias("bucket")).agg(F.sum("size").alias("n"))
    steps = _summed(low).join(F.broadcast(first), "pattern")
    # After a bucket the sum is `upto`, after none it is 0: the nearest to `left` is the cut.
    best = steps.groupBy("pattern", "top", "left").agg(F.min_by(F.struct((F.col("bucket") + 1).alias("b"), "upto"), F.struct(F.abs(F.col("upto") - F.col("left")), "bucket")).alias("x"))
    after = F.when(F.abs(F.col("x.upto") - F.col("left")) < F.col("left"), F.col("x.b")).otherwise(0)
    return best.select("pattern", (F.col("top") * _HALF + after).alias("cut"))


def _keyed(docs: DataFrame, seed: int, id_col: str, sources: Column, size: Column) -> DataFrame:
    """docs with its pattern, size and hash, under names that start with __."""
    return docs.select(
        "*",
        F.to_json(F.sort_array(F.array_distinct(sources))).alias("__pattern"),
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("__size"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 32)).alias("__h"),
    )


def _planned(narrow: DataFrame, weights: tuple[float, ...] | dict[str | None, float], total_share: float, max_passes: int) -> tuple[DataFrame, dict, dict]:
    """(pattern, whole, cut), one row per pattern, with the sources' sizes and targets."""
    sums = narrow.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    capacity = {r["pattern"]: int(r["n"]) for r in sums if r["pattern"]}
    members = {p: json.loads(p) for p in capacity}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in capacity.items():
        for s in members[p]:
            sizes[s] += n
    by_source = weights if isinstance(weights, dict) else cycled_weights(list(sizes), weights)
    targets = source_targets(sizes, by_source, total_share * sum(capacity.values()), max_passes)
    used = min_cost_flow(capacity, members, {s: round(t) for s, t in targets.items()}, max_passes)
    plan = [(p, used[p] // n if n else 0, used[p] % n if n else 0) for p, n in capacity.items()]
    wanted = narrow.sparkSession.createDataFrame(plan or [("", 0, 0)], "pattern string, whole long, rest long")
    cuts = _threshold(narrow.where("pattern is not null"), wanted.where("rest > 0"))
    return materialise(wanted.join(cuts, "pattern", "left").select("pattern", "whole", F.coalesce("cut", F.lit(0)).alias("cut")), "plan"), dict(sizes), targets


def _passes(whole: str, cut: str, h: str) -> Column:
    return F.coalesce(F.col(whole), F.lit(0)) + F.when(F.col(h) < F.coalesce(F.col(cut), F.lit(0)), 1).otherwise(0)


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | dict[str | None, float],
    total_share: float = 1.5,
    max_passes: int = 2,
    seed: int = 11,
    id_col: str = "doc_id",
    sources_col: str = "sources",
    size_col: str = "size",
) -> tuple[DataFrame, dict[str | None, int], dict[str | None, float]]:
    """(id, sources, pattern, size, passes, taken) for each row, the sources' sizes and their targets.

    sources_col is an array of source names (null is a name); a document counts in full in the size of each.
    """
    keyed = _keyed(docs.select(F.col(id_col).alias("id"), F.col(sources_col).alias("s"), F.col(size_col).alias("n")), seed, "id", F.col("s"), F.col("n"))
    narrow = materialise(keyed.select("id", F.col("s").alias("sources"), F.col("__pattern").alias("pattern"), F.col("__size").alias("size"), F.col("__h").alias("h")), "mix")
    plan, sizes, targets = _planned(narrow, weights, total_share, max_passes)
    rows = narrow.join(F.broadcast(plan), "pattern", "left").withColumn("passes", _passes("whole", "cut", "h"))
    return rows.select(F.col("id").alias(id_col), "sources", "pattern", "size", "passes", (F.col("passes") * F.col("size")).alias("taken")), sizes, targets


def mixed(
    docs: DataFrame, sources: Column, size: Column, weights: tuple[float, ...] | dict[str | None, float], total_share: float = 1.5, max_passes: int = 2, seed: int = 11, id_col: str = "doc_id"
) -> DataFrame:
    """The mix itself: each row of docs as often as it is passed over. The plan is broadcast, texts don't shuffle."""
    keyed = _keyed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(id_col).alias("__id"), sources.alias("__s"), size.alias("__n")), seed, "__id", F.col("__s"), F.col("__n"))
    narrow = materialise(keyed.select(F.col("__pattern").alias("pattern"), F.col("__size").alias("size"), F.col("__h").alias("h")), "mix")
    plan = _planned(narrow, weights, total_share, max_passes)[0].withColumnsRenamed({"pattern": "__pattern", "whole": "__whole", "cut": "__cut"})
    rows = keyed.select("__row", "__pattern", "__h").join(F.broadcast(plan), "__pattern", "left")
    times = F.sequence(F.lit(1), F.lit(max_passes))
    return rows.select("__row", F.explode(F.slice(times, 1, _passes("__whole", "__cut", "__h").cast("int")))).select("__row.*")
