import re

import corpus_pipeline as P
from graphloom.llm.common import materialise
from graphloom.llm.queries import oracle_sql, queries


def test_stages_in_order(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for name, stage in P.STAGES:
        out = materialise(stage(spark, docs, sf), name)
        seen.append((name, docs.count(), out.count()))
        if name != "token_ids":
            assert out.columns == docs.columns
        if name == "language_id":
            letters = [r for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
            assert out.count() == len(letters)
            assert out.where("lang is null").count() == 0
        if name == "exact_duplicates":
            best = {}
            for r in docs.collect():
                best[r["text"] or ""] = max(best.get(r["text"] or "", -1), r["doc_id"])
            assert sorted(r["doc_id"] for r in out.collect()) == sorted(best.values())
        if name == "near_duplicates":
            from test_jaccard_join import brute

            want = {c for _, _, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "token_ids":
            assert all(r["lossless"] for r in out.collect())
        docs = out
    assert P.run(spark, sf).count() == seen[-1][2]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, further columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog near the old river bank at noon "
    rows = [
        (1, base, "en", "a", 1), (2, base, None, None, None), (2, base, None, None, None), (3, base * 4000, "en", "a", 1),
        (4, None, "en", "a", 0), (5, "", None, "b", 0), (6, "123 456", "de", "b", 7), (7, base + "today", "en", "c\x1b", 9),
        (None, "ein ganz anderer Satz über das Wetter und den Wald im Winter", "de", "c\x1b", 3), (8, "x", "en", None, 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(*r, "k", "v", 1, 0.5) for r in rows]
    docs = spark.createDataFrame(extra, f"{schema}, __row string, `a.b` string, n int, score double")
    for name, stage in P.STAGES:
        out = materialise(stage(spark, docs, "/nowhere"), name)
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.select("doc_id").collect())
        known = {k for _, k in ids}
        if name == "language_id":
            assert [k for _, k in ids] == [1, 2, 2, 3, 7, 8, 0]
        if name == "exact_duplicates":
            assert sorted(k for _, k in ids) == [0, 2, 3, 7, 8]
        if name == "near_duplicates":
            assert {0, 2, 8} <= known and len(ids) == len(known)
        if name != "token_ids":
            assert out.columns == docs.columns
        docs = out
    assert all(r["lossless"] for r in docs.collect())
    empty = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        assert materialise(stage(spark, empty, "/nowhere"), name).collect() == []


def test_registry():
    assert {re.match(r"op\d+", n)[0] for n in queries()} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(queries())


def test_stages_begin_with_collected_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if re.search("Old|MarkSweep", b.getName()))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in P.STAGES[3:]:
        before = full()
        stage(spark, docs.where("doc_id < 0"), "")
        assert full() > before, name
