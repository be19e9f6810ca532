"""Queries beside their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import views
from graphloom.queries import oracle_sql, queries
from graphloom.storage import release

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return f"[{','.join(map(plain, v))}]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(map(plain, r)) for r in df.select(*cols).collect())
    cur = duck.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted("|".join(plain(r[k]) for k in at) for r in cur.fetchall())
    release(spark)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["count"] >= rows[-1]["count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_without_sql_run(spark):
    for name in sorted(set(queries()) - set(oracle_sql()) - {"strong_components", "small_world", "betweenness", "closeness", "path_lengths"}):
        assert queries()[name](spark, SF).count() >= 1, name
        release(spark)


def reached(out, start):
    seen, todo = {start}, [start]
    for v in todo:
        for w in out.get(v, ()):
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def test_strong_components_of_all_links(spark, duck):
    users = [r[0] for r in duck.execute("select user_id from events order by ts, event_id").fetchall()]
    out = {}
    for a, b in zip(users, users[1:]):
        if a != b:
            out.setdefault(f"P{a}", set()).add(f"P{b}")
    ids = {f"P{r[0]}" for r in duck.execute("select c_custkey from customer").fetchall()} | {f"P{u}" for u in users}
    to = {v: reached(out, v) for v in ids}
    got = {r["id"]: r["component"] for r in queries()["strong_components"](spark, SF).collect()}
    assert got == {v: min(w for w in to[v] if v in to[w]) for v in ids}
    release(spark)


def test_all_pairs_queries_take_the_whole_alumni_graph(spark, duck):
    near = {}
    for a, b in duck.execute("select distinct 'P' || o_custkey, 'U' || l_suppkey from lineitem join orders on l_orderkey = o_orderkey where l_linenumber = 1 and l_returnflag = 'R'").fetchall():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    big = max((reached(near, v) for v in near), key=len)

    def hops(start):
        dist, todo = {start: 0}, [start]
        for v in todo:
            for w in near[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
        return dist

    dist = {v: hops(v) for v in big}
    got = {r["id"]: r["closeness"] for r in queries()["closeness"](spark, SF).collect()}
    assert got.keys() == big and all(abs(got[v] - (len(big) - 1) / sum(dist[v].values())) < 1e-8 for v in big)
    row = queries()["path_lengths"](spark, SF).first()
    every = [d for v in big for d in dist[v].values() if d]
    assert row["diameter"] == max(every) and abs(row["mean_length"] - sum(every) / len(every)) < 1e-9
    for name in ("betweenness", "communities"):
        assert {r["id"] for r in queries()[name](spark, SF).collect()} == big, name
    release(spark)


def test_cheapest_ways_of_many_edges(spark, monkeypatch):
    chain = spark.createDataFrame([(f"P{k:02}", f"P{k + 1:02}") for k in range(18)], "src string, dst string")
    monkeypatch.setattr(views, "alumni_edges", lambda spark, sf: chain)
    got = {r["id"]: r["cost"] for r in queries()["sssp_cost"](spark, SF).collect()}
    want = {f"P{k:02}": sum(1 / (2 + j % 4) for j in range(k)) for k in range(19)}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-8 for v in want)
    release(spark)


def test_all_generated_questions_are_answered(spark):
    made = {r["category"]: r["count"] for r in queries()["generated_questions"](spark, SF).groupBy("category").count().collect()}
    got = {r["type"]: (r["n"], r["accuracy"]) for r in queries()["answered_questions"](spark, SF).collect()}
    assert {k: n for k, (n, _) in got.items() if k} == made and got[None][0] == sum(made.values())
    assert got["university"][1] == 1 and got["university_mcq"][1] == 1
    release(spark)
