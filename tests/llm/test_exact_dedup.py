import hashlib

from graphloom.llm import exact_dedup

ROWS = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a"), (6, "a"), (7, "A"), (8, " a"), (9, "é" * 50_000), (10, "é" * 50_000), (None, "a"), (None, "only")]


def test_groups_match_brute_force(docs):
    got = sorted((tuple(r) for r in exact_dedup.duplicate_groups(docs(ROWS)).collect()), key=str)
    want = []
    for i, t in ROWS:
        same = [j for j, u in ROWS if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_one_row_of_a_text_stays_with_all_columns(docs):
    df = docs(ROWS)
    got = exact_dedup.drop_duplicates(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == sorted(
        [("6", "a"), ("3", "b"), ("5", ""), ("7", "A"), ("8", " a"), ("10", "é" * 50_000), ("None", "only")]
    )


def test_hot_group_and_unique_rows(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id) end as text")
    rows = exact_dedup.duplicate_groups(df).collect()
    assert len(rows) == 3000
    assert sum(r["kept"] for r in rows) == 2001
    assert {(r["keep_id"], r["group_size"]) for r in rows if r["doc_id"] % 3 == 0} == {(2997, 1000)}


def test_filters_in_turns(docs):
    """More rows than a filter takes: the same groups and rows, from several filters."""
    key = lambda r: (str(r["doc_id"]), r["text_sha256"], r["keep_id"], r["group_size"])
    df = docs(ROWS + [(k, f"t{k % 700}") for k in range(100, 1100)])
    one, many = (exact_dedup.duplicate_groups(df, filter_rows=n).collect() for n in (1 << 20, 100))
    assert sorted(map(key, one)) == sorted(map(key, many))
    few, all_ = (exact_dedup.drop_duplicates(df, filter_rows=n).collect() for n in (100, 1 << 20))
    assert sorted((str(r["doc_id"]), r["text"]) for r in few) == sorted((str(r["doc_id"]), r["text"]) for r in all_)


def test_empty(docs):
    assert exact_dedup.duplicate_groups(docs([])).collect() == []
    assert exact_dedup.drop_duplicates(docs([])).collect() == []
