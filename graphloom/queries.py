"""The library's queries over the driver's tables, and SQL with the same rows.

Graph views are those of plans.views; the SQL repeats them as common table expressions. Queries without SQL are those
that parse HTML or whose loops have no bound known beforehand; tests compare these with models in plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as U
from graphloom.functions import vocabulary as V
from graphloom.operators import aggregates as A
from graphloom.operators import dedup as D
from graphloom.operators import edges as E
from graphloom.operators import graph as G
from graphloom.operators import hops as H
from graphloom.operators import lookups as L
from graphloom.plans import enrich, qa, views
from graphloom.sources import html, sinks
from graphloom.storage import cut

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_NODES = """nodes AS (
    SELECT 'P' || c_custkey AS id, c_name AS title, 'person' AS type FROM customer
    UNION ALL SELECT 'U' || s_suppkey, s_name, 'university' FROM supplier
    UNION ALL SELECT 'country_' || n_name, n_name, 'country' FROM nation
    UNION ALL SELECT DISTINCT 'career_' || c_mktsegment, c_mktsegment, 'career' FROM customer)"""
_ALUMNI = """alumni AS (
    SELECT 'P' || o_custkey AS person, 'U' || l_suppkey AS university, CAST(min(year(o_orderdate)) AS INTEGER) AS year
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_linenumber = 1 AND l_returnflag = 'R' GROUP BY 1, 2)"""
_STUDIED = f"""{_ALUMNI}, studied AS (SELECT person AS src, university AS dst FROM alumni),
both_ways AS (SELECT src, dst FROM studied UNION SELECT dst, src FROM studied)"""
_LINKS = """link_rows AS (
    SELECT * FROM (
        SELECT 'P' || user_id AS src, 'P' || lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_id AS ord FROM events)
    WHERE dst IS NOT NULL AND src <> dst),
link_to AS (SELECT DISTINCT src, dst FROM link_rows)"""
_BORN = "born AS (SELECT 'P' || c_custkey AS src, 'country_' || n_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_EDGES = f"""{_ALUMNI}, {_LINKS}, {_BORN}, edges AS (
    SELECT person AS src, university AS dst, 'alumni_of' AS type, 1 AS weight FROM alumni
    UNION ALL SELECT src, dst, 'born_in', 1 FROM born
    UNION ALL SELECT 'P' || c_custkey, 'career_' || c_mktsegment, 'has_career', 1 FROM customer
    UNION ALL SELECT src, dst, 'link_to', 1 FROM link_to)"""
_PAIRS = f"""{_ALUMNI}, shared AS (
    SELECT a.person AS p1, b.person AS p2, a.university FROM alumni a JOIN alumni b ON a.university = b.university AND a.person < b.person)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


# Aggregates


@query(f"WITH {_NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def node_type_counts(spark, sf):
    return A.counts(views.nodes(spark, sf), "type")


@query(f"WITH {_EDGES} SELECT type, count(*) AS n FROM edges GROUP BY type")
def relation_counts(spark, sf):
    return A.counts(views.edges(spark, sf), "type")


@query(f"""WITH {_NODES}, {_EDGES}, ends AS (
    SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges UNION ALL SELECT id, 0, 0 FROM nodes)
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i + o) AS BIGINT) AS degree FROM ends GROUP BY id""")
def degree_in_out(spark, sf):
    return A.degrees(views.nodes(spark, sf), views.edges(spark, sf))


@query(f"""WITH {_NODES}, {_EDGES}, ends AS (SELECT src AS id, 1 AS d FROM edges UNION ALL SELECT dst, 1 FROM edges UNION ALL SELECT id, 0 FROM nodes),
degree AS (SELECT id, sum(d) AS d FROM ends GROUP BY id)
SELECT round(avg(d), 9) AS mean_degree, CAST(median(d) AS DOUBLE) AS median_degree, CAST(min(d) AS BIGINT) AS min_degree, CAST(max(d) AS BIGINT) AS max_degree,
       round(stddev_pop(d), 6) AS std_degree FROM degree""")
def degree_stats(spark, sf):
    stats = A.degree_stats(degree_in_out(spark, sf))
    return stats.withColumns({"mean_degree": F.round("mean_degree", 9), "std_degree": F.round("std_degree", 6)})


@query(f"""WITH {_NODES}, {_EDGES}
SELECT s.type AS src_type, e.type, d.type AS dst_type, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight
FROM edges e JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst GROUP BY ALL ORDER BY n DESC, 1, 2, 3 LIMIT 10""")
def pattern_topk(spark, sf):
    return A.patterns(E.typed_edges(views.edges(spark, sf), views.nodes(spark, sf)))


@query(f"""WITH {_EDGES}, words AS (SELECT unnest({list(V.RELATIONS)}) AS type)
SELECT type, count(edges.src) AS n, round(100.0 * count(edges.src) / (SELECT count(*) FROM edges), 9) AS percent FROM words LEFT JOIN edges USING (type) GROUP BY type""")
def relation_coverage(spark, sf):
    return A.coverage(views.edges(spark, sf), "type", V.RELATIONS).withColumn("percent", F.round("percent", 9))


@query(f"""WITH {_NODES}, words AS (SELECT unnest({list(V.NODE_TYPES)}) AS type)
SELECT type, count(nodes.id) AS n, round(100.0 * count(nodes.id) / (SELECT count(*) FROM nodes), 9) AS percent FROM words LEFT JOIN nodes USING (type) GROUP BY type""")
def entity_coverage(spark, sf):
    return A.coverage(views.nodes(spark, sf), "type", V.NODE_TYPES).withColumn("percent", F.round("percent", 9))


@query(f"WITH {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM nodes GROUP BY type)) AS node_types, (SELECT string_agg(type || '=' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM edges GROUP BY type)) AS edge_types")
def graph_summary(spark, sf):
    def said(c: str) -> Column:
        return F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ",").alias(c)

    return A.graph_summary(views.nodes(spark, sf), views.edges(spark, sf)).select("n_nodes", "n_edges", said("node_types"), said("edge_types"))


@query(f"""WITH {_ALUMNI} SELECT count(DISTINCT university) AS universities, count(DISTINCT person) AS persons, count(DISTINCT year) AS years FROM alumni""")
def distinct_counts(spark, sf):
    return views.alumni(spark, sf).agg(F.count_distinct("university").alias("universities"), F.count_distinct("person").alias("persons"), F.count_distinct("year").alias("years"))


@query(f"""WITH {_EDGES}, top AS (SELECT id FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY count(*) DESC, id LIMIT 5),
ends AS (SELECT src AS id, type FROM edges UNION ALL SELECT dst, type FROM edges),
n AS (SELECT id, type, count(*) AS n FROM ends JOIN top USING (id) GROUP BY ALL)
SELECT id, type, n, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, type) AS INTEGER) AS place FROM n QUALIFY place <= 3""")
def relations_of_hubs(spark, sf):
    edges = views.edges(spark, sf)
    top = A.top(A.degrees(views.nodes(spark, sf), edges), [F.desc("degree"), F.asc("id")], 5)
    return A.relations_of(edges, cut(top.select("id"), "hubs"))


@query("""SELECT n_regionkey, n_name, n, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n DESC, n_name) AS INTEGER) AS place
FROM (SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) QUALIFY place <= 3""")
def top3_per_group(spark, sf):
    rows = views.table(spark, sf, "customer").join(F.broadcast(views.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.top_per_group(rows.groupBy("n_regionkey", "n_name").agg(F.count(F.lit(1)).alias("n")), ["n_regionkey"], [F.desc("n"), F.asc("n_name")], 3)


@query("SELECT c_custkey, md5(c_custkey || '/42') AS h FROM customer ORDER BY h, c_custkey LIMIT 50")
def hash_sample(spark, sf):
    rows = A.sample(views.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 50)
    return rows.select("c_custkey", A.seeded_order(F.col("c_custkey"), 42).alias("h"))


@query(f"""WITH {_NODES} SELECT type, id, CAST(row_number() OVER (PARTITION BY type ORDER BY md5(id || '/42'), id) AS INTEGER) AS place FROM nodes QUALIFY place <= 2""")
def sample_per_type(spark, sf):
    return A.sample_per_group(views.nodes(spark, sf), "type", "id", 2).select("type", "id", "place")


@query("""SELECT type, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 9) AS accuracy
FROM (SELECT o_orderpriority AS type, o_orderstatus = 'F' AS correct FROM orders) GROUP BY ROLLUP (type)""")
def accuracy_rollup(spark, sf):
    judged = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("correct"))
    return A.accuracy(judged).withColumn("accuracy", F.round("accuracy", 9))


@query(f"""WITH {_LINKS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(1.0 / (1 + ord % 7)) AS weight FROM link_rows GROUP BY 1, 2""")
def lightest_edges(spark, sf):
    rows = views.link_rows(spark, sf).select(F.col("src").alias("a"), F.col("dst").alias("b"), U.edge_weight((F.col("ord") % 7).cast("string")).alias("weight"))
    return A.lightest_edges(rows)


# Pairs and joins


@query(f"WITH {_PAIRS} SELECT p1, p2, count(*) AS count FROM shared GROUP BY p1, p2")
def shared_uni(spark, sf):
    return E.shared(views.alumni(spark, sf))


@query(f"WITH {_PAIRS} SELECT p1, p2, university, count(*) OVER (PARTITION BY p1, p2) AS count FROM shared")
def shared_uni_per_uni(spark, sf):
    return E.shared_per_key(views.alumni(spark, sf)).select("p1", "p2", "university", "count")


@query(f"""WITH {_ALUMNI}, y AS (SELECT DISTINCT person, year FROM alumni)
SELECT a.person AS p1, b.person AS p2, a.year FROM y a JOIN y b ON a.year = b.year AND a.person < b.person""")
def same_grad_year(spark, sf):
    return E.same_value(views.alumni(spark, sf), "person", ["year"]).select("p1", "p2", "year")


@query(f"WITH {_BORN} SELECT a.src AS p1, b.src AS p2, a.dst FROM born a JOIN born b ON a.dst = b.dst AND a.src < b.src")
def birth_country_pairs(spark, sf):
    return E.same_value(views.born_in(spark, sf), "src", ["dst"]).select("p1", "p2", "dst")


@query(f"WITH {_BORN} SELECT dst, n, CAST(n * (n - 1) // 2 AS BIGINT) AS pairs FROM (SELECT dst, count(*) AS n FROM born GROUP BY dst)")
def same_birth_country(spark, sf):
    return E.shared_sizes(views.born_in(spark, sf), "src", "dst")


@query("""WITH c AS (SELECT 'P' || c_custkey AS person, c_mktsegment AS career, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT a.person AS p1, b.person AS p2, a.career, a.nation FROM c a JOIN c b ON a.career = b.career AND a.nation = b.nation AND a.person < b.person""")
def same_career_by_nation(spark, sf):
    rows = views.table(spark, sf, "customer").join(F.broadcast(views.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.concat(F.lit("P"), "c_custkey").alias("person"), F.col("c_mktsegment").alias("career"), F.col("n_name").alias("nation"))
    return E.same_value(rows, "person", ["career", "nation"]).select("p1", "p2", "career", "nation")


@query(f"""WITH {_LINKS} SELECT DISTINCT src, dst, CASE WHEN CAST(substr(dst, 2) AS INTEGER) % 3 = 0 THEN 'MENTIONS_PERSON' ELSE 'MENTIONS_UNIVERSITY' END AS relation
FROM link_to WHERE CAST(substr(dst, 2) AS INTEGER) % 3 < 2""")
def mention_edges(spark, sf):
    people = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("title"), (F.col("c_custkey") % 3).alias("k"))
    return E.mentions(views.link_to(spark, sf), people.where("k = 0"), people.where("k < 2"))


@query(f"""WITH {_NODES}, {_EDGES} SELECT src, dst, type, CAST(weight AS BIGINT) AS weight FROM (
    SELECT * FROM edges UNION ALL SELECT src, 'nowhere', 'born_in', 1 FROM born)
WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)""")
def orphan_filter(spark, sf):
    lost = views.born_in(spark, sf).withColumn("dst", F.lit("nowhere"))
    return E.without_orphans(views.edges(spark, sf).unionByName(lost), views.nodes(spark, sf))


@query(f"""WITH {_NODES}, p AS (SELECT 'P' || user_id AS id, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1)
SELECT id, title, coalesce(json_extract_string(props, '$.k'), '') AS k FROM nodes LEFT JOIN (SELECT p.id, props FROM p JOIN events ON event_id = last) USING (id) WHERE type = 'person'""")
def props_left_join(spark, sf):
    events = views.table(spark, sf, "events").select(F.concat(F.lit("P"), "user_id").alias("id"), F.col("event_id").alias("ord"), F.get_json_object("props", "$.k").alias("k"))
    people = views.nodes(spark, sf).where("type = 'person'")
    details = events.join(people.select("id", "title"), "id").select("title", "ord", F.create_map(F.lit("k"), F.array("k")).alias("properties"))
    return E.with_properties(people, details).select("id", "title", F.coalesce(F.array_join(F.try_element_at("properties", F.lit("k")), ","), F.lit("")).alias("k"))


# Dedup, unification, graph collapse


@query(f"""WITH {_LINKS} SELECT src, dst, ord FROM link_rows QUALIFY row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY ord) = 1""")
def undirected_dedup(spark, sf):
    return D.first_by(views.link_rows(spark, sf), [F.least("src", "dst"), F.greatest("src", "dst")], ["ord"])


@query(f"""WITH {_PAIRS}, {_LINKS}, rows AS (
    SELECT person AS src, university AS dst, 'alumni_of' AS type, 1 AS weight, 0 AS prio FROM alumni
    UNION ALL SELECT p1, p2, 'same_uni', count(*), 1 FROM shared GROUP BY p1, p2
    UNION ALL SELECT src, dst, 'link_to', 1, 2 FROM link_to
    UNION ALL SELECT a.person, b.person, 'same_uni', 1, 3 FROM (SELECT DISTINCT person, year FROM alumni) a JOIN (SELECT DISTINCT person, year FROM alumni) b ON a.year = b.year AND a.person > b.person)
SELECT src, dst, type, CAST(weight AS BIGINT) AS weight FROM rows QUALIFY row_number() OVER (
    PARTITION BY CASE WHEN type = 'alumni_of' THEN src ELSE least(src, dst) END, CASE WHEN type = 'alumni_of' THEN dst ELSE greatest(src, dst) END, type
    ORDER BY prio, src, dst, weight) = 1""")
def unify_edges(spark, sf):
    alumni = cut(views.alumni(spark, sf), "alumni")
    studied = alumni.select(F.col("person").alias("src"), F.col("university").alias("dst"), F.lit("alumni_of").alias("type"), F.lit(1).cast("long").alias("weight"))
    # A shared university goes before a shared year, so the other pairs of a year are those without one.
    shared = E.shared(alumni).select(F.col("p1").alias("src"), F.col("p2").alias("dst"), F.lit("same_uni").alias("type"), F.col("count").alias("weight"))
    grad = E.met_once(alumni, "person", "year", "university")
    grad = grad.select(F.col("p2").alias("src"), F.col("p1").alias("dst"), F.lit("same_uni").alias("type"), F.lit(1).cast("long").alias("weight"))
    return D.unified_edges([studied, shared, views.link_to(spark, sf)]).unionByName(grad)


@query(f"""WITH {_LINKS}, rows AS (SELECT src, dst, CASE WHEN ord % 5 = 0 THEN 'alumni_of' ELSE 'r' || ord % 3 END AS type, ord FROM link_rows)
SELECT src, dst, arg_min(type, ord + CASE WHEN type = 'alumni_of' THEN 0 ELSE 1000000000 END) AS type FROM rows GROUP BY src, dst""")
def first_relation(spark, sf):
    rows = views.link_rows(spark, sf)
    kind = F.when(F.col("ord") % 5 == 0, "alumni_of").otherwise(F.concat(F.lit("r"), F.col("ord") % 3))
    return D.first_edge(rows.withColumn("type", kind), "ord")


@query(f"""WITH {_LINKS} SELECT src, dst, arg_max('r' || ord % 3, ord) AS type, max(ord) AS weight FROM link_rows GROUP BY src, dst""")
def last_relation(spark, sf):
    rows = views.link_rows(spark, sf)
    return D.last_edge(rows.withColumns({"type": F.concat(F.lit("r"), F.col("ord") % 3), "weight": F.col("ord")}), "ord")


@query(f"WITH {_LINKS}, near AS (SELECT id FROM (SELECT 'P' || c_custkey AS id FROM customer WHERE c_nationkey = 3)) SELECT src, dst, 'link_to' AS type, CAST(1 AS BIGINT) AS weight FROM link_to WHERE src IN (FROM near) AND dst IN (FROM near)")
def induced_subgraph(spark, sf):
    some = views.table(spark, sf, "customer").where("c_nationkey = 3").select(F.concat(F.lit("P"), "c_custkey").alias("id"))
    return D.induced(views.link_to(spark, sf), some).select("src", "dst", "type", "weight")


@query("SELECT CAST(row_number() OVER (ORDER BY c_name) AS BIGINT) AS id, c_name AS title FROM customer")
def title_ids(spark, sf):
    return sinks.with_ids(views.table(spark, sf, "customer").select(F.col("c_name").alias("title"))).withColumn("id", F.col("id").cast("long"))


@query("""SELECT s_suppkey AS k, coalesce(n.v, s.s_acctbal) AS v FROM supplier s LEFT JOIN (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0) n ON s_suppkey = k
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def keyed_upsert(spark, sf):
    stored = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    new = views.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return sinks.upserted(stored, new, "k")


@query(f"WITH {_ALUMNI} SELECT DISTINCT person, university FROM alumni WHERE (person, university) NOT IN (SELECT (person, university) FROM alumni WHERE year < 1996)")
def append_new(spark, sf):
    """Alumni that aren't among those stored up to 1995; the new ones come with blanks to be collapsed."""
    alumni = cut(views.alumni(spark, sf), "alumni")
    rows = sinks.new_rows(alumni.select(F.concat(F.lit(" "), "person", F.lit("  ")).alias("person"), "university"), alumni.where("year < 1996").select("person", "university"), ["person", "university"])
    return rows.select(F.trim("person").alias("person"), "university")


# Lookups


@query(f"""WITH {_STUDIED}, pairs AS (SELECT DISTINCT a.src AS a, b.src AS b FROM studied a JOIN studied b ON a.dst = b.dst AND a.src < b.src)
SELECT a, b, x.dst AS neighbour, 'alumni_of' AS relations_a, 'alumni_of' AS relations_b FROM pairs JOIN both_ways x ON x.src = a JOIN both_ways y ON y.src = b AND y.dst = x.dst""")
def common_neighbors(spark, sf):
    edges = cut(views.alumni_edges(spark, sf), "studied")
    pairs = E.shared(edges.select(F.col("src").alias("person"), F.col("dst").alias("university"))).select(F.col("p1").alias("a"), F.col("p2").alias("b"))
    found = L.common_neighbours(edges, pairs)
    return found.withColumns({c: F.array_join(c, ",") for c in ("relations_a", "relations_b")})


@query(f"WITH {_ALUMNI} SELECT person AS id FROM alumni WHERE university = 'U3' ORDER BY person LIMIT 100")
def people_by_university(spark, sf):
    return L.people_of_university(views.edges(spark, sf), "U3")


@query(f"WITH {_ALUMNI}, {_BORN} SELECT src AS id FROM born WHERE dst = (SELECT 'country_' || n_name FROM nation WHERE n_nationkey = 7) AND src IN (SELECT person FROM alumni WHERE university IN ('U3')) ORDER BY src LIMIT 50")
def people_by_country_and_university(spark, sf):
    country = views.table(spark, sf, "nation").where("n_nationkey = 7").first()["n_name"]
    return L.people_of_country_and_university(views.edges(spark, sf), f"country_{country}", "U3")


@query(f"""WITH {_ALUMNI}, pairs AS (SELECT 'P' || c_custkey AS a, 'P' || (c_custkey + 1) AS b FROM customer),
met AS (SELECT a, b, string_agg(x.university, ',' ORDER BY x.university) AS u FROM pairs JOIN alumni x ON x.person = a JOIN alumni y ON y.person = b AND x.university = y.university GROUP BY a, b)
SELECT pairs.a, pairs.b, coalesce(u, '') AS universities, u IS NOT NULL AS same FROM pairs LEFT JOIN met USING (a, b)""")
def same_university_check(spark, sf):
    pairs = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("a"), F.concat(F.lit("P"), F.col("c_custkey") + 1).alias("b"))
    return L.same_university(views.alumni_edges(spark, sf), pairs).select("a", "b", F.array_join("universities", ",").alias("universities"), "same")


@query(f"WITH {_NODES} SELECT id, title, type FROM nodes WHERE lower(title) LIKE '%00001%' ORDER BY title, id LIMIT 10")
def node_search(spark, sf):
    return L.node_search(views.nodes(spark, sf), "00001")


@query(f"""WITH {_EDGES} SELECT src AS id, dst AS neighbour, type, 'out' AS direction FROM edges WHERE src IN ('P1', 'P2', 'P3')
UNION ALL SELECT dst, src, type, 'in' FROM edges WHERE dst IN ('P1', 'P2', 'P3')""")
def neighbours(spark, sf):
    return L.neighbours(views.edges(spark, sf), views.nodes(spark, sf).where(F.col("id").isin("P1", "P2", "P3")))


@query(f"""WITH {_NODES}, asked AS (SELECT DISTINCT n_name AS name FROM nation UNION ALL SELECT 'customer#00000012' UNION ALL SELECT 'none such')
SELECT name, arg_min(title, CASE WHEN title IS NULL THEN NULL ELSE (CASE WHEN title = name THEN '0' WHEN lower(title) = lower(name) THEN '1' ELSE '2' || lpad(CAST(length(title) AS VARCHAR), 6, '0') END) || title END) AS title
FROM asked LEFT JOIN nodes ON contains(lower(title), lower(name)) GROUP BY name""")
def resolve_titles(spark, sf):
    names = views.table(spark, sf, "nation").select(F.col("n_name").alias("name")).distinct()
    names = names.unionByName(spark.range(1).select(F.explode(F.array(F.lit("customer#00000012"), F.lit("none such"))).alias("name")))
    return L.resolved_titles(names, views.nodes(spark, sf))


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS place FROM conversations QUALIFY place <= 5")
def last_n_turns(spark, sf):
    return L.last_turns(views.table(spark, sf, "conversations")).select("conv_id", "turn", "role", "place")


# Graph algorithms


@query(f"""WITH {_STUDIED}, one AS (SELECT src AS a, dst AS b FROM both_ways), pairs AS (SELECT DISTINCT s.src AS a, t.dst AS b FROM studied s JOIN studied t ON s.dst <> t.dst AND hash(s.src) IS NOT NULL AND s.src = t.src),
two AS (SELECT x.src AS a, x.dst AS m, y.dst AS b FROM both_ways x JOIN both_ways y ON x.dst = y.src AND x.src <> y.dst),
three AS (SELECT two.a, z.dst AS b FROM two JOIN both_ways z ON two.b = z.src AND z.dst <> two.a AND z.dst <> two.m),
ends AS (SELECT DISTINCT a.src AS a, b.src AS b FROM studied a JOIN studied b ON a.dst = b.dst AND a.src < b.src UNION SELECT src, dst FROM studied)
SELECT a, b, count(*) AS n_paths, CAST(min(hops) AS INTEGER) AS hops FROM (
    SELECT a, b, 1 AS hops FROM one UNION ALL SELECT a, b, 2 FROM two UNION ALL SELECT a, b, 3 FROM three) JOIN ends USING (a, b) GROUP BY a, b""")
def paths_le_3(spark, sf):
    edges = cut(views.alumni_edges(spark, sf), "studied")
    pairs = E.shared(edges.select(F.col("src").alias("person"), F.col("dst").alias("university"))).select(F.col("p1").alias("a"), F.col("p2").alias("b"))
    return G.path_counts(edges, cut(pairs.unionByName(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).distinct(), "pairs"))


_REACH = f"""WITH RECURSIVE {_STUDIED}, dists(source, id, dist) USING KEY (source, id) AS (
    SELECT DISTINCT src, src, 0 FROM both_ways
    UNION SELECT w.source, b.dst, min(w.dist + 1) FROM dists w JOIN both_ways b ON w.id = b.src
    LEFT JOIN recurring.dists r ON r.source = w.source AND r.id = b.dst WHERE r.id IS NULL GROUP BY 1, 2)"""


@query(f"{_REACH} SELECT source, id, CAST(dist AS INTEGER) AS dist FROM dists")
def hop_distances(spark, sf):
    links = cut(D.undirected(views.alumni_edges(spark, sf)), "studied")
    return H.all_distances(links, links.select(F.col("src").alias("id")))


@query(f"{_REACH} SELECT CAST(dist AS INTEGER) + 1 AS depth, count(*) AS n FROM dists WHERE source = (SELECT min(src) FROM studied) GROUP BY 1")
def bfs_levels(spark, sf):
    links = cut(D.undirected(views.alumni_edges(spark, sf)), "studied")
    seed = links.where("src like 'P%'").agg(F.min("src").alias("id"))
    return A.counts(G.bfs_levels(links, seed, 1 << 30), "depth")


@query(f"""WITH RECURSIVE {_STUDIED}, reach AS (SELECT DISTINCT src AS x, src AS y FROM both_ways UNION SELECT x, dst FROM reach JOIN both_ways ON y = src)
SELECT x AS id, min(y) AS component FROM reach GROUP BY x""")
def components(spark, sf):
    links = cut(D.undirected(views.alumni_edges(spark, sf)), "studied")
    return G.components(links.select(F.col("src").alias("id")).distinct(), links)


@query(f"""WITH RECURSIVE {_STUDIED}, weighted AS (SELECT src, dst, 1.0 / (2 + CAST(substr(least(src, dst), 2) AS INTEGER) % 4) AS w FROM both_ways),
start AS (SELECT min(src) AS s FROM studied),
walk AS (SELECT s AS id, CAST(0 AS DOUBLE) AS cost, 0 AS k FROM start UNION ALL
    SELECT dst, min(cost + w), k + 1 FROM walk JOIN weighted ON id = src WHERE k < (SELECT count(DISTINCT src) FROM both_ways) GROUP BY dst, k)
SELECT id, round(min(cost), 9) AS cost FROM walk GROUP BY id""")
def sssp_cost(spark, sf):
    edges = cut(views.alumni_edges(spark, sf), "studied")
    start = edges.agg(F.min("src").alias("s")).first()["s"]
    end = F.substring(F.least("src", "dst"), 2, 20).cast("int")
    weighted = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), (1.0 / (2 + end % 4)).alias("weight"))
    return G.path_costs(weighted, F.lit(start)).select("id", F.round("cost", 9).alias("cost"))


_UNDIRECTED = "pairs AS (SELECT src, dst FROM link_to UNION SELECT dst, src FROM link_to)"


@query(f"""WITH {_LINKS}, {_UNDIRECTED}, t AS (SELECT a.src AS id, count(*) AS n FROM pairs a JOIN pairs b ON a.dst = b.src JOIN pairs c ON c.src = b.dst AND c.dst = a.src GROUP BY 1),
d AS (SELECT src AS id, count(*) AS d FROM pairs GROUP BY 1)
SELECT 'P' || c_custkey AS id, round(CASE WHEN d >= 2 THEN coalesce(n, 0) / (CAST(d AS DOUBLE) * (d - 1)) ELSE 0 END, 9) AS clustering
FROM customer LEFT JOIN d ON d.id = 'P' || c_custkey LEFT JOIN t ON t.id = 'P' || c_custkey""")
def triangles_clustering(spark, sf):
    people = views.nodes(spark, sf).where("type = 'person'")
    return G.clustering(people, cut(views.link_to(spark, sf), "links")).withColumn("clustering", F.round("clustering", 9))


@query(f"""WITH {_NODES}, {_EDGES}, c AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m) SELECT n, m, round(CAST(m AS DOUBLE) / (n * (n - 1)), 12) AS density FROM c""")
def density(spark, sf):
    return G.density(views.nodes(spark, sf), views.edges(spark, sf)).withColumn("density", F.round("density", 12))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS MATERIALIZED (SELECT id, 1.0 / c AS r FROM n)"]
    for k in range(rounds):
        steps.append(f"""r{k + 1} AS MATERIALIZED (
            SELECT n.id, 0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} WHERE id NOT IN (SELECT src FROM w)) / c) + 0.15 / c AS r
            FROM n LEFT JOIN (SELECT dst AS id, sum(r * share) AS g FROM r{k} JOIN w ON id = src GROUP BY dst) x ON x.id = n.id)""")
    return f"""WITH {_LINKS}, e AS (SELECT src, dst, count(*) AS w FROM link_rows GROUP BY src, dst),
        w AS MATERIALIZED (SELECT src, dst, CAST(w AS DOUBLE) / sum(w) OVER (PARTITION BY src) AS share FROM e),
        n AS MATERIALIZED (SELECT 'P' || c_custkey AS id, CAST((SELECT count(*) FROM customer) AS DOUBLE) AS c FROM customer),
        {", ".join(steps)} SELECT id, round(r, 9) AS rank FROM r{rounds}"""


@query(_pagerank_sql(10))
def pagerank_k10(spark, sf):
    people = views.nodes(spark, sf).where("type = 'person'")
    weighted = cut(views.link_rows(spark, sf).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")), "links")
    return G.pagerank(people, weighted, rounds=10, tolerance=0).select("id", F.round("rank", 9).alias("rank"))


@query(f"""WITH {_NODES}, {_EDGES}, ends AS (SELECT src AS id, 1 AS d FROM edges UNION ALL SELECT dst, 1 FROM edges UNION ALL SELECT id, 0 FROM nodes)
SELECT id, round(CAST(sum(d) AS DOUBLE) / ((SELECT count(*) FROM nodes) - 1), 9) AS centrality FROM ends GROUP BY id ORDER BY centrality DESC, id LIMIT 10""")
def degree_centrality_top10(spark, sf):
    found = G.degree_centrality(A.degrees(views.nodes(spark, sf), views.edges(spark, sf))).withColumn("centrality", F.round("centrality", 9))
    return A.top(found, [F.desc("centrality"), F.asc("id")], 10)


def _largest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The largest component of the graph of persons and universities: its nodes, and its edges in both directions."""
    links = cut(D.undirected(views.alumni_edges(spark, sf)), "alumni")
    nodes = cut(G.largest_component(G.components(links.select(F.col("src").alias("id")).distinct(), links)), "largest")
    return nodes, cut(D.induced(links, nodes), "inside")


_GIANT = f"""{_REACH}, part AS (SELECT source AS id, min(id) AS c FROM dists GROUP BY source),
giant AS (SELECT id FROM part WHERE c = (SELECT c FROM part GROUP BY c ORDER BY count(*) DESC, c LIMIT 1)),
inside AS (SELECT * FROM dists WHERE source IN (SELECT id FROM giant))"""


@query(f"{_GIANT} SELECT source AS id, round(CAST(count(*) - 1 AS DOUBLE) / sum(dist), 9) AS closeness FROM inside GROUP BY source")
def closeness(spark, sf):
    nodes, links = _largest(spark, sf)
    return G.closeness(links, nodes).withColumn("closeness", F.round("closeness", 9))


@query()
def path_lengths(spark, sf):
    nodes, links = _largest(spark, sf)
    return G.path_lengths(links, nodes)


@query()
def betweenness(spark, sf):
    nodes, links = _largest(spark, sf)
    return G.betweenness(nodes, links).withColumn("betweenness", F.round("betweenness", 9))


@query(f"""WITH {_LINKS}, e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM link_to), p AS (SELECT 'P' || c_custkey AS id, c_nationkey AS c FROM customer),
m AS (SELECT x.c AS ca, y.c AS cb FROM e JOIN p x ON x.id = a JOIN p y ON y.id = b),
ends AS (SELECT ca AS c FROM m UNION ALL SELECT cb FROM m), d AS (SELECT c, count(*) AS d FROM ends GROUP BY c), i AS (SELECT ca AS c, count(*) AS i FROM m WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(i, 0) / CAST((SELECT count(*) FROM m) AS DOUBLE) - (d / (2.0 * (SELECT count(*) FROM m))) ** 2), 9) AS modularity FROM d LEFT JOIN i USING (c)""")
def modularity(spark, sf):
    parts = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return G.modularity(views.link_to(spark, sf), parts).withColumn("modularity", F.round("modularity", 9))


@query()
def communities(spark, sf):
    nodes, links = _largest(spark, sf)
    return G.greedy_communities(nodes, links)


@query(f"""WITH RECURSIVE {_LINKS}, reach AS (SELECT DISTINCT src AS x, src AS y FROM link_to UNION SELECT x, dst FROM reach JOIN link_to ON y = src),
mutual AS (SELECT a.x, min(a.y) AS c FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x GROUP BY a.x)
SELECT id, coalesce(c, id) AS component FROM (SELECT 'P' || c_custkey AS id FROM customer UNION SELECT src FROM link_to UNION SELECT dst FROM link_to) LEFT JOIN mutual ON x = id""")
def strong_components(spark, sf):
    links = cut(views.link_to(spark, sf).select("src", "dst"), "links")
    return G.strong_components(views.nodes(spark, sf).where("type = 'person'"), links)


@query()
def small_world(spark, sf):
    """One row: clustering and mean path length of the largest component, of a random graph as dense, and sigma."""
    nodes, links = _largest(spark, sf)
    n, m = nodes.count(), links.count() / 2
    drawn = cut(G.random_graph(nodes, 2 * m / (n * (n - 1))), "random")
    own = G.clustering(nodes, links).agg(F.avg("clustering").alias("c")).join(G.path_lengths(links, nodes).select(F.col("mean_length").alias("l")), F.lit(True))
    giant = cut(G.largest_component(G.components(nodes, drawn)), "giant")
    other = G.clustering(nodes, drawn).agg(F.avg("clustering").alias("c_random")).join(G.path_lengths(D.induced(drawn, giant), giant).select(F.col("mean_length").alias("l_random")), F.lit(True))
    return own.join(other, F.lit(True)).withColumn("sigma", U.small_world(F.col("c"), F.col("c_random"), F.col("l"), F.col("l_random"))).withColumn("small_world", F.col("sigma") > 1)


# Text, pages, questions


@query("""SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM (
    SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark, sf):
    return html.href_targets(views.table(spark, sf, "pages"), "page_id")


@query()
def parsed_pages(spark, sf):
    pages = html.parsed_pages(views.table(spark, sf, "pages"))
    p = F.col("page")
    return pages.select("page_id", p["has_infobox"].alias("has_infobox"), F.size(p["all"]).alias("n_links"), F.coalesce(html.is_person_page(p), F.lit(False)).alias("is_person"))


_WORD = r"\p{L}\p{M}\p{N}_"


@query(rf"""SELECT page_id, 'https://vi.wikipedia.org/wiki/' || replace(replace(url_encode(replace(t, ' ', '_')), '%2F', '/'), '%7E', '~') AS url,
regexp_replace(regexp_replace(trim(t), '\s+', '_', 'g'), '[^{_WORD}\-.]', '', 'g') AS slug FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' / (é ~*)' AS t FROM pages)""")
def url_slug(spark, sf):
    name = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" / (é ~*)"))
    return views.table(spark, sf, "pages").select("page_id", T.wiki_url(name).alias("url"), T.slug(name).alias("slug"))


_VN = ("".join(V.VIETNAMESE), "".join(V.VIETNAMESE.values()))


@query(f"SELECT doc_id, md5(translate(lower(text), '{_VN[0]}', '{_VN[1]}')) AS folded FROM documents")
def text_fold(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.md5(T.remove_marks(F.col("text"))).alias("folded"))


@query(rf"SELECT doc_id, CAST(nullif(regexp_extract(text, '(?:^|[^{_WORD}])((?:19|20)[0-9]{{2}})(?:$|[^{_WORD}])', 1), '') AS INTEGER) AS year FROM documents")
def first_year(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", T.year_in(F.col("text")).alias("year"))


_WORDS = ("the", "of the", "and", "thing", "dans", "une", "der", "und", "los", "que", "est une")


def _hits_sql(words: tuple[str, ...], text: str) -> str:
    """The words of a gazetteer in a text; what isn't a letter is doubled, so that neighbours needn't share a boundary."""
    doubled = rf"regexp_replace(translate(lower({text}), '{_VN[0]}', '{_VN[1]}'), '([^{_WORD}])', '\1\1', 'g')"
    longest = "|".join(w.replace(" ", "  ") for w in sorted(words, key=lambda w: (-len(w), w)))
    return rf"list_transform(regexp_extract_all({doubled}, '(?:^|[^{_WORD}])({longest})(?:$|[^{_WORD}])', 1), lambda x: replace(x, '  ', ' '))"


@query(f"SELECT doc_id, len(h) AS hits, list_sort(list_distinct(h)) AS words FROM (SELECT doc_id, {_hits_sql(_WORDS, 'text')} AS h FROM documents)")
def gazetteer_hits(spark, sf):
    words = "|".join(sorted(_WORDS, key=lambda w: (-len(w), w)))
    hits = F.regexp_extract_all(T.remove_marks(F.col("text")), F.lit(rf"(?U)\b({words})\b"), F.lit(1))
    return views.table(spark, sf, "documents").select("doc_id", F.size(hits).cast("long").alias("hits"), enrich.careers_in(F.col("text"), _WORDS).alias("words"))


def _question_sql() -> str:
    def either(test: str, words: tuple[str, ...]) -> str:
        return " OR ".join(test.format(w) for w in words)

    cases = " ".join(f"WHEN {either("contains(q, '{}')", words)} THEN '{kind}'" for kind, words in V.QUESTION_WORDS)
    yes = " OR ".join((either("starts_with(q, '{}')", V.YES_NO_STARTS), either("contains(q, '{}')", V.YES_NO_HOLDS), either("ends_with(q, '{}')", V.YES_NO_ENDS)))
    return f"CASE WHEN regexp_matches(q, '(?:^|[^{_WORD}])[a-d]\\.') THEN 'multiple_choice' {cases} WHEN {yes} THEN 'yes_no' ELSE 'general' END"


@query(f"""SELECT conv_id, turn, {_question_sql()} AS type FROM (
    SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || CASE turn % 5 WHEN 0 THEN 'A và B có học cùng trường không?' WHEN 1 THEN 'Có phải A quen B không?' WHEN 2 THEN 'A làm nghề gì?' WHEN 3 THEN 'Ai? A. x B. y' ELSE 'xin chào' END) AS q FROM (SELECT conv_id, turn, text FROM conversations))""")
def classify_text(spark, sf):
    texts = ("A và B có học cùng trường không?", "Có phải A quen B không?", "A làm nghề gì?", "Ai? A. x B. y", "xin chào")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("turn") % 5 + 1).cast("int")))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", T.question_type(text).alias("type"))


@query("""SELECT conv_id, turn, CASE WHEN contains(g, 'có') OR contains(g, 'yes') THEN contains(p, 'có') OR contains(p, 'yes') OR contains(p, 'kết nối')
    WHEN contains(g, 'không') OR contains(g, 'no') THEN contains(p, 'không') OR contains(p, 'no') ELSE contains(p, g) END AS correct
FROM (SELECT conv_id, turn, lower(split_part(text, ' ', 1)) AS g, lower(text) AS p FROM conversations)""")
def judged_answers(spark, sf):
    rows = views.table(spark, sf, "conversations").select("conv_id", "turn", F.split_part("text", F.lit(" "), F.lit(1)).alias("gold"), F.col("text").alias("pred"))
    return qa.judged(rows).select("conv_id", "turn", "correct")


@query()
def generated_questions(spark, sf):
    return qa.generated_questions(views.nodes(spark, sf), cut(views.alumni_edges(spark, sf), "edges"))


@query()
def answered_questions(spark, sf):
    """All generated questions, answered and judged, by category; options stand behind their question."""
    nodes, edges = cut(views.nodes(spark, sf), "nodes"), cut(views.alumni_edges(spark, sf).unionByName(views.born_in(spark, sf)), "edges")
    asked = cut(qa.generated_questions(nodes, edges), "questions")
    details = nodes.where("type = 'person'").select("title", F.create_map(F.lit("Sinh"), F.array("id")).alias("properties"))
    options = F.array_join(F.transform(F.map_entries("choices"), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), " ")
    found = qa.answered(asked.select("question_id", F.concat_ws(" ", "question", options).alias("text")), nodes, edges, details)
    gold = asked.select("question_id", F.col("category").alias("type"), F.col("answer").alias("gold"))
    rows = gold.join(found.select("question_id", F.coalesce("answer", F.lit("")).alias("pred")), "question_id")
    return A.accuracy(qa.judged(rows, strict=True).select("type", "correct"))


def queries() -> dict[str, Query]:
    from graphloom import question_queries, text_queries  # noqa: F401 - they register theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
