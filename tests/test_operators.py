import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import dedup as D
from graphloom.operators import edges as E
from graphloom.operators import lookups as L
from graphloom.plans import views

EDGES = [
    ("p1", "u1", "alumni_of", 1), ("p2", "u1", "alumni_of", 1), ("p1", "u2", "alumni_of", 1), ("p2", "u2", "alumni_of", 1), ("p3", "u2", "alumni_of", 1),
    ("p1", "country_X", "born_in", 1), ("p3", "country_X", "born_in", 1), ("p2", "country_Y", "from_country", 1),
    ("p1", "career_K", "has_career", 1), ("p4", "career_K", "has_career", 1), ("p1", "p4", "link_to", 1), ("p4", "p1", "link_to", 1),
    ("p3", "p3", "link_to", 1), ("p1", "u1", "link_to", 1), ("p1", "Z", "born_in", 1),
]
IDS = ["p1", "p2", "p3", "p4", "p5", "u1", "u2", "country_X", "country_Y", "career_K"]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([(*e, k) for k, e in enumerate(EDGES)], "src string, dst string, type string, weight int, ord int")


@pytest.fixture
def nodes(spark):
    kind = {"p": "person", "u": "university"}
    return spark.createDataFrame([(i, i.upper(), i.split("_")[0] if "_" in i else kind[i[0]]) for i in IDS], "id string, title string, type string")


def rows(df, *cols):
    return sorted(map(tuple, df.select(*(cols or df.columns)).collect()), key=str)


def test_pairs(edges):
    alumni = edges.where("type = 'alumni_of'").select(F.col("src").alias("person"), F.col("dst").alias("university"))
    assert rows(E.shared(alumni), "p1", "p2", "count") == [("p1", "p2", 2), ("p1", "p3", 1), ("p2", "p3", 1)]
    assert sorted(r["count"] for r in E.shared_per_key(alumni).where("p1 = 'p1' and p2 = 'p2'").collect()) == [2, 2]
    born = edges.where("type = 'born_in'")
    assert rows(E.same_value(born, "src", ["dst"]), "p1", "p2") == [("p1", "p3")]
    assert rows(E.shared_sizes(born, "src", "dst"), "dst", "pairs") == [("Z", 0), ("country_X", 1)]


def test_mentions_orphans_and_lookups(spark, edges, nodes):
    links = spark.createDataFrame([("a", "x"), ("a", " y "), ("a", "z"), ("a", "x")], "src string, dst string")
    people, schools = (spark.createDataFrame([(t,) for t in ts], "title string") for ts in (["x"], ["x", "y"]))
    assert rows(E.mentions(links, people, schools), "dst", "relation") == [("x", "MENTIONS_PERSON"), ("y", "MENTIONS_UNIVERSITY")]
    assert [tuple(r)[:2] for r in edges.join(E.without_orphans(edges, nodes).select("ord"), "ord", "left_anti").select("src", "dst").collect()] == [("p1", "Z")]
    assert rows(E.labelled(spark.createDataFrame([("p1",), ("Z",)], "id string"), nodes)) == [("Z", "Z", "unknown"), ("p1", "P1", "person")]
    details = spark.createDataFrame([("P1", {"a": ["1"]}, 0), ("P1", {"a": ["2"]}, 1)], "title string, properties map<string,array<string>>, ord int")
    got = {r["id"]: r["properties"] for r in E.with_properties(nodes, details).collect()}
    assert got["p1"] == {"a": ["2"]} and got["p5"] == {}


def test_dedup_and_collapse(edges, nodes):
    links = edges.where("type = 'link_to'")
    assert rows(D.first_by(links, D.pair_key(), ["ord"]), "src", "dst") == [("p1", "p4"), ("p1", "u1"), ("p3", "p3")]
    assert {(r["src"], r["dst"]): r["type"] for r in D.first_edge(edges, "ord").collect()}["p1", "u1"] == "alumni_of"
    assert {(r["src"], r["dst"]): r["type"] for r in D.last_edge(edges, "ord").collect()}["p1", "u1"] == "link_to"
    again = D.first_edge(edges.withColumn("ord", -F.col("ord")), "ord")
    assert {(r["src"], r["dst"]): r["type"] for r in again.collect()}["p1", "u1"] == "alumni_of"
    assert {r["id"] for r in D.all_nodes(nodes, edges).collect()} == {*IDS, "Z"}
    first = edges.where("ord < 3").select("src", "dst", "type", F.lit(7).alias("weight"))
    both = D.unified_edges([first, edges])
    assert {(r["src"], r["dst"]): r["weight"] for r in both.where("type = 'alumni_of'").collect()}["p1", "u1"] == 7
    assert both.where("type = 'link_to'").count() == 3
    none = edges.where("false")
    assert D.either(none, links).count() == 4 and D.either(links, edges).count() == 4


def test_aggregates(edges, nodes):
    degree = {r["id"]: (r["in_degree"], r["out_degree"]) for r in A.degrees(nodes, edges).collect()}
    assert degree["p1"] == (1, 7) and degree["p5"] == (0, 0) and degree["p3"] == (1, 3)
    hubs = A.relations_of(edges, nodes.where("id = 'p3'")).collect()
    assert [(r["type"], r["n"]) for r in hubs][0] == ("link_to", 2)
    assert rows(A.coverage(nodes, "type", ("person", "planet")), "type", "n") == [("person", 5), ("planet", 0)]
    one = A.graph_summary(nodes, edges).first()
    assert (one["n_nodes"], one["n_edges"], one["node_types"]["person"]) == (10, 15, 5)
    assert A.sample(nodes, "id", 3).collect() == A.sample(nodes.repartition(3), "id", 3).collect()
    assert {r["type"] for r in A.profile(edges, "p1").collect()} == {"alumni_of", "born_in", "has_career", "link_to"}


def test_neighbours_and_constraints(spark, edges, nodes):
    got = rows(L.neighbours(edges, nodes.where("id = 'p4'"), "link_to"), "neighbour", "direction")
    assert got == [("p1", "in"), ("p1", "out")]
    pair = spark.createDataFrame([("p1", "p2"), ("p1", "p4"), ("p2", "p4")], "a string, b string")
    met = L.common_neighbours(edges, pair)
    assert rows(met, "a", "b", "neighbour") == [("p1", "p2", "u1"), ("p1", "p2", "u2"), ("p1", "p4", "career_K")]
    assert [r["id"] for r in L.people_of_country_and_university(edges, "country_X", "u2").collect()] == ["p1", "p3"]
    assert {(r["a"], r["b"]): r["same"] for r in L.same_university(edges, pair).collect()} == {("p1", "p2"): True, ("p1", "p4"): False, ("p2", "p4"): False}
    assert L.resolved_country(nodes, "country x").first()["id"] == "country_X"


def test_linking(spark):
    nodes = spark.createDataFrame([("1", "Đại học Huế", "university"), ("2", "Huế", "person"), ("3", "北京", "person"), ("4", "Yale", "country"), ("5", "Đại học Harvard", "university")], "id string, title string, type string")
    asked = spark.createDataFrame([(1, "Ai học Đại Học Huế?"), (2, "xin chào"), (3, "người harvard")], "question_id long, text string")
    got = {r["question_id"]: r["entities"] for r in L.linked_entities(asked, nodes).collect()}
    assert got == {1: ["Đại học Huế", "Huế"], 2: [], 3: []}
    typed = {r["question_id"]: r["title"] for r in L.typed_node(asked, nodes, "university").collect()}
    assert typed == {1: "Đại học Huế", 2: None, 3: "Đại học Harvard"}
    names = spark.createDataFrame([("huế",), ("zzz",), ("Yale",)], "name string")
    assert {r["name"]: r["title"] for r in L.resolved_titles(names, nodes).collect()} == {"huế": "Huế", "zzz": None, "Yale": "Yale"}


def test_held_parts_equal_brute_force(spark):
    draw = random.Random(5)
    texts = ["", None, "ab", "đại học huế", "a" * 3000, *("".join(draw.choices("ab c", k=draw.randrange(1, 40))) for _ in range(60))]
    parts = ["", None, "a", "ab", "học h", "a" * 50, "aaa", "zz", *("".join(draw.choices("ab c", k=draw.randrange(1, 9))) for _ in range(80))]
    got = L.held(spark.createDataFrame([(t, 1) for t in texts * 2], "n string, key int"), "n", spark.createDataFrame([(p, 1) for p in parts * 2], "part string, n int"), "part")
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == {(t, p) for t in texts if t for p in parts if p and p in t}
    none = spark.createDataFrame([], "n string, part string")
    assert L.held(none, "n", none, "part").count() == 0


def test_linking_broadcasts_nothing_that_grows(spark):
    asked = spark.createDataFrame([(k, f"Customer#{k:09} học ở Supplier#{k:09}?") for k in range(30)], "question_id long, text string")
    nodes = spark.createDataFrame([(f"{c}{k}", f"{c}#{k:09}", t) for k in range(30) for c, t in (("Customer", "person"), ("Supplier", "university"))], "id string, title string, type string")
    for found, c in ((L.linked_entities(asked, nodes), "entities"), (L.typed_node(asked, nodes, "university"), "title")):
        got = {r["question_id"]: r[c] for r in found.collect()}
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert got == {k: [f"Customer#{k:09}", f"Supplier#{k:09}"] if c == "entities" else f"Supplier#{k:09}" for k in range(30)}


def test_alumni_broadcast_nothing_that_grows(spark, tmp_path):
    spark.createDataFrame([(k, k % 5, datetime(1990 + k, 1, 1)) for k in range(9)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, k % 2, 1 + k // 8, "R") for k in range(9)], "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    studied = views.alumni(spark, str(tmp_path))
    assert "Broadcast" not in studied._jdf.queryExecution().executedPlan().toString()
    assert rows(studied, "person", "university", "year") == [("P0", "U0", 1990), ("P0", "U1", 1995), ("P1", "U0", 1996), ("P1", "U1", 1991), ("P2", "U0", 1992), ("P2", "U1", 1997), ("P3", "U1", 1993), ("P4", "U0", 1994)]


def test_pairs_in_blocks_equal_brute_force(spark):
    draw = random.Random(3)
    studied = sorted({(f"p{draw.randrange(60)}", draw.randrange(1990, 1996), f"u{draw.randrange(40)}") for _ in range(150)})
    alumni = spark.createDataFrame([*studied, ("p0", None, "u1"), (None, 1990, "u2")], "person string, year int, university string")
    of = {}
    for p, y, u in studied:
        of.setdefault(p, (set(), set()))[0].add(y)
        of[p][1].add(u)
    of["p0"][1].add("u1")
    pairs = [(a, b) for a in of for b in of if a < b]
    got = rows(E.same_value(alumni, "person", ["year"]), "p1", "p2", "year")
    assert got == sorted((a, b, y) for a, b in pairs for y in of[a][0] & of[b][0])
    met = E.met_once(alumni, "person", "year", "university")
    assert rows(met, "p1", "p2") == sorted((a, b) for a, b in pairs if of[a][0] & of[b][0] and not of[a][1] & of[b][1])


def test_many_pairs_of_one_value_are_many_tasks(spark):
    people = spark.range(2000).select(F.col("id").cast("string").alias("person"), F.lit(7).alias("year"), F.concat(F.lit("u"), "id").alias("university"))
    for met in (E.same_value(people, "person", ["year"]), E.met_once(people, "person", "year", "university")):
        tasks = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 2000 * 1999 // 2 and max(tasks) < sum(tasks) / 3
