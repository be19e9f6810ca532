from pyspark.sql import functions as F

from graphloom.llm import mixing as M
from graphloom.llm.queries import queries


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, sources array<string>, size long").withColumn("passes", F.lit("clash"))


def test_targets_share_again_what_caps_leave():
    got = M.source_targets({"a": 100, "b": 100, None: 100}, M.cycled_weights(["b", None, "a"], (5, 2, 1)), 450, 2)
    assert got == {"a": 200.0, "b": 250 * 2 / 3, None: 250 / 3}
    assert sum(got.values()) == 450


def test_flow_is_least_cost():
    """Against all integer flows of a small overlapping case."""
    capacity = {"A": 3, "AB": 2, "B": 1}
    members = {"A": ["a"], "AB": ["a", "b"], "B": ["b"]}
    for qa in range(0, 8):
        for qb in range(0, 7):
            used = M.min_cost_flow(capacity, members, {"a": qa, "b": qb}, 2)
            cost = lambda p, n: max(0, n - capacity[p])
            best = None
            for a in range(7):
                for b in range(3):
                    for ab in range(5):
                        for to_a in range(ab + 1):
                            if a + to_a <= qa and b + ab - to_a <= qb:
                                key = (-(a + b + ab), cost("A", a) + cost("B", b) + cost("AB", ab))
                                best = min(best, key) if best else key
            assert (-sum(used.values()), sum(cost(p, n) for p, n in used.items())) == best


def test_mix_meets_targets_and_is_repeatable(spark):
    rows = [(k, [["a"], ["b"], [None], ["a", "b"]][k % 4 if k % 3 else 0], k % 50) for k in range(4000)]
    df = frame(spark, rows)
    first, sizes, targets = M.mix(df, (5, 2, 1))
    got = {r["doc_id"]: r for r in first.collect()}
    assert len(got) == 4000
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got.values())
    total = sum(r["taken"] for r in got.values())
    assert abs(total - sum(targets.values())) < 200
    again = {r["doc_id"]: r["taken"] for r in M.mix(df, (5, 2, 1))[0].collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    times = M.mixed(df, F.col("sources"), F.col("size"), (5, 2, 1)).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in times} == {i: r["passes"] for i, r in got.items() if r["passes"]}


def test_edge_cases(spark):
    assert M.mix(frame(spark, []), (5, 2, 1))[0].collect() == []
    rows = [(1, [None], None), (2, ["é"], 0), (3, None, 5), (4, [], 5), (5, ["é"], 10), (5, ["é"], 10)]
    got = [tuple(r) for r in M.mix(frame(spark, rows), (5, 2, 1))[0].select("doc_id", "size", "taken").orderBy("doc_id").collect()]
    assert [g[:2] for g in got] == [(1, 0), (2, 0), (3, 5), (4, 5), (5, 10), (5, 10)]
    assert got[2][2] == got[3][2] == 0 and got[4] == got[5]


def test_query_keeps_its_contract(spark, tmp_path):
    """Every document once, sizes and targets as computed in plain Python, whatever characters sources hold."""
    sources = ["s\x1b", "s\x1f", 'q"/', "\\", "é", None, "s\x1b\u2028"]
    rows = [(k, " ".join(["w"] * (k % 37)) if k % 11 else None, sources[k % 7 if k % 3 else 0]) for k in range(900)]
    rows.append(rows[5])
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op10_mixing"](spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    ordered = [*sorted((s for s in sizes if s is not None), key=str.encode), None]
    left, targets, open_ = 1.5 * sum(sizes.values()), {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(ordered)}
    while over := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * sizes[s]]:
        targets |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ = {s: w for s, w in open_.items() if s not in over}
    targets |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    by_id = {k: s for k, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[source] and abs(r["target"] - targets[source]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 40 for s in sizes)


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries()["op10_mixing"](spark, str(tmp_path)).collect() == []
