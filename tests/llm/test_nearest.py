import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import nearest
from graphloom.llm.queries import queries


def brute(ids, x, queries_, k=20):
    out = {}
    for q in queries_:
        s = x @ x[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    got = {}
    for r in queries()["op8_nearest"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(abs(s - float(x[ids == a][0] @ x[ids == q][0])) < 1e-12 for q in got for a, s in got[q])


def test_blocks_ties_and_bad_vectors(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((600, 8)) * draw.uniform(0.2, 3, (600, 1))
    x[:200] = x[0]
    rows = [(k, x[k].tolist()) for k in range(600)]
    bad = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (1004, [float("inf")] + [1.0] * 7), (1005, [None] + [1.0] * 7), (1006, [1.0] * 3), (1020, None)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    found = nearest.search(df, F.col("vec_id") % 20 == 0, k=5, block_rows=50)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = brute(np.arange(600), x, range(0, 600, 20), 5)
    assert set(got) == set(want)
    hits = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want if q >= 200])
    assert hits >= 0.9
    # Of 199 equal vectors, those with the smallest ids.
    best = [a for a, s in want[0] if abs(s - x[0] @ x[0]) < 1e-9]
    assert [a for a, _ in got[0] if a < 200] == best


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in nearest.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert nearest.search(df.where("false"), F.lit(True)).collect() == []


def test_chi_square():
    draw = np.random.default_rng(3)
    sums = (draw.standard_normal((200_000, nearest.PROJECTIONS)) ** 2).sum(1)
    for t in (1.0, 5.0, 8.0, 15.0):
        assert abs(float(nearest.chi_square(t)) - (sums <= t).mean()) < 0.005
