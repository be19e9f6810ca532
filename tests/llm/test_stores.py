import os
import uuid

import pytest
from pyspark.sql import functions as F

from graphloom.llm import shards, token_counts
from graphloom.llm.queries import RANKS_FILE, queries


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, tokens long, old_tokens long").withColumn("docs", F.lit("clash"))


def totals(rollup):
    return {tuple(r)[:3]: tuple(r)[3:] for r in rollup.totals().collect()}


def test_signed_changes_and_idempotent_batches(spark, root):
    r = token_counts.Rollup(spark, root)
    assert totals(r) == {}
    first = changes(spark, [("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", 1, None), ("insert", "b", "en", "v1", None, None)])
    assert r.apply("b1", first) and not r.apply("b1", first)
    assert totals(r) == {("a", "en", "v1"): (2, 12), (None, None, "v1"): (1, 1), ("b", "en", "v1"): (1, 0)}
    assert r.compact()
    assert not r.apply("b1", first)
    assert r.apply("b2", changes(spark, [("revise", "a", "en", "v1", 9, 5), ("delete", None, None, "v1", 1, None), ("insert", "a", "en", "v2", 3, None)]))
    assert r.apply("b3", changes(spark, []))
    want = {("a", "en", "v1"): (2, 16), ("b", "en", "v1"): (1, 0), ("a", "en", "v2"): (1, 3)}
    assert totals(r) == want and r.compact() and totals(r) == want
    stale = r.folder.names("deltas")
    r.folder.commit_json("deltas/never-committed/part", {})
    r.vacuum()
    assert totals(r) == want and len(r.folder.names("deltas")) == 1 < len(stale)
    assert not r.apply("b2", first) and totals(r) == want


def test_a_batch_that_failed_midway_does_not_count(spark, root, monkeypatch):
    r = token_counts.Rollup(spark, root)
    monkeypatch.setattr(r.folder, "commit_json", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        r.apply("b1", changes(spark, [("insert", "a", "en", "v", 5, None)]))
    again = token_counts.Rollup(spark, root)
    assert totals(again) == {}
    assert again.apply("b1", changes(spark, [("insert", "a", "en", "v", 5, None)])) and totals(again) == {("a", "en", "v"): (1, 5)}


def test_op4_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    enc = token_counts.tokenizer(RANKS_FILE)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(enc.encode_ordinary(r["text"] or ""))
        if n:
            d, t = want.get((r["source"], r["lang"]), (0, 0))
            want[r["source"], r["lang"]] = (d + 1, t + n)
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in queries()["op4_token_counts"](spark, sf).collect()}
    assert got == want


def test_null_and_long_texts_count(docs):
    got = token_counts.count_tokens(docs([(1, None), (2, ""), (3, "a " * 50_000)]), RANKS_FILE, ["doc_id"]).collect()
    assert [(r["doc_id"], r["n_tokens"] > 0) for r in got] == [(1, False), (2, False), (3, True)]


def test_tiers_merge_only_similar_sizes():
    small = [(f"s{k}", 10) for k in range(5)]
    large = [(f"l{k}", 1000) for k in range(3)]
    bins = shards.plan_merges(small + large, target=100_000)
    assert [sorted(n for n, _ in b) for b in bins] == [[f"s{k}" for k in range(5)]]
    assert shards.plan_merges([("x", 90_000)] * 9, target=100_000) == []
    many = shards.plan_merges([(f"m{k}", 300) for k in range(100)], target=1500)
    assert sorted(n for b in many for n, _ in b) == sorted(f"m{k}" for k in range(100)) and all(1000 <= sum(s for _, s in b) <= 2000 for b in many)


def test_store_keeps_rows_versions_and_loses_races(spark, root, docs):
    store = shards.ShardStore(spark, root)
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    rows = [(k, None if k == 3 else "" if k == 4 else f"t{k % 7}") for k in range(40)]
    for k in range(5):
        store.append(docs([r for r in rows if r[0] % 5 == k]).repartition(2))
    assert store.version() == 5 and len(store.manifest()) >= 5
    before = store.read()
    assert store.compact(target=1 << 20) == 6
    after = store.manifest()
    assert len(after) == 1 and sorted(map(str, store.read().collect())) == sorted(map(str, docs(rows).collect()))
    assert before.count() == 40 and store.read(2).count() == 16
    assert not store.folder.commit_json("manifests/0000000006.json", {"shards": []}) and store.manifest() == after
    store.vacuum()
    assert store.read().count() == 40 and store.folder.names("manifests") == ["0000000006.json"]
    left = [f for d, _, fs in os.walk(root.removeprefix("file://")) for f in fs if f.endswith(".parquet")]
    assert len(left) == 1
    store.append(docs([]))
    assert store.read().count() == 40


def test_a_version_states_its_columns(spark, root, docs):
    store = shards.ShardStore(spark, root)
    odd = docs([(1, "a"), (2, None)]).withColumn("a b.c", F.array(F.struct(F.lit(1.5).alias("x")))).withColumn("shards", F.lit("s"))
    store.append(odd.where("false"))
    assert store.schema().fieldNames() == odd.columns and store.read().schema.simpleString() == odd.schema.simpleString()
    store.append(odd)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, odd.collect()))
