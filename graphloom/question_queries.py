"""Queries of question answering, lookups, sources and sinks, over the graph of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import values as U
from graphloom.operators import aggregates as A
from graphloom.operators import dedup as D
from graphloom.operators import edges as E
from graphloom.operators import graph as G
from graphloom.operators import lookups as L
from graphloom.plans import crawl, enrich, qa, views
from graphloom.queries import _ALUMNI, _BORN, _EDGES, _GIANT, _LINKS, _NODES, _STUDIED, query
from graphloom.sources import readers, sinks
from graphloom.storage import cut, shared_dir
from graphloom.text_queries import _CAREERS, _details, _pick

_NEXT = "pairs AS (SELECT 'P' || c_custkey AS a, 'P' || (c_custkey + 1) AS b FROM customer)"


def _next(spark, sf) -> DataFrame:
    """Each person with the next one: the pairs that questions are about."""
    return views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("a"), F.concat(F.lit("P"), F.col("c_custkey") + 1).alias("b"))


def _said(c: str):
    return F.array_join(c, ",").alias(c)


# Questions


@query(f"""WITH {_ALUMNI}, {_NEXT}, met AS (SELECT a, b, string_agg(x.university, ',' ORDER BY x.university) AS u FROM pairs JOIN alumni x ON x.person = a JOIN alumni y ON y.person = b AND x.university = y.university GROUP BY a, b)
SELECT pairs.a, pairs.b, CASE WHEN u IS NULL THEN 'KHÔNG' ELSE 'CÓ' END AS answer, coalesce(u, '') AS universities FROM pairs LEFT JOIN met USING (a, b)""")
def answer_same_school(spark, sf):
    """Q4, J17."""
    return qa.same_school(_next(spark, sf), views.alumni_edges(spark, sf)).select("a", "b", "answer", _said("universities"))


@query(f"""WITH {_BORN}, {_NEXT} SELECT a, b, CASE WHEN x.dst = y.dst THEN 'CÓ' ELSE 'KHÔNG' END AS answer, CASE WHEN x.dst = y.dst THEN x.dst END AS countries
FROM pairs LEFT JOIN born x ON x.src = a LEFT JOIN born y ON y.src = b""")
def answer_same_birth_place(spark, sf):
    """Q8."""
    return qa.same_birth_place(_next(spark, sf), views.born_in(spark, sf)).select("a", "b", "answer", _said("countries"))


@query(f"""WITH {_STUDIED}, {_NEXT}, common AS (SELECT a, b, x.dst AS n FROM pairs JOIN studied x ON x.src = a JOIN studied y ON y.src = b AND y.dst = x.dst),
met AS (SELECT a, b, count(*) AS n, string_agg(n, ',' ORDER BY n) FILTER (WHERE place <= 5) AS c FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n) AS place FROM common) GROUP BY a, b)
SELECT pairs.a, pairs.b, CASE WHEN n IS NULL THEN 'KHÔNG' ELSE 'CÓ' END AS answer, CASE WHEN n IS NOT NULL THEN CAST(2 AS INTEGER) END AS hops, coalesce(n, 0) AS n_paths, CAST(NULL AS VARCHAR) AS relations, c AS common FROM pairs LEFT JOIN met USING (a, b)""")
def answer_connection(spark, sf):
    """Q7, Q9: persons are two edges apart or more, as a university lies between."""
    found = qa.connection(_next(spark, sf), cut(views.alumni_edges(spark, sf), "alumni"))
    return found.select("a", "b", "answer", "hops", "n_paths", _said("relations"), _said("common"))


_SCHOOL = "schools AS (SELECT person, c_name AS title, s_name AS school FROM alumni JOIN customer ON person = 'P' || c_custkey JOIN supplier ON university = 'U' || s_suppkey)"


def _schools(spark, sf) -> DataFrame:
    none = spark.createDataFrame([], "title string, properties map<string,array<string>>")
    return qa.schools_of(views.nodes(spark, sf), views.alumni_edges(spark, sf), none)


@query(f"""WITH {_ALUMNI}, {_SCHOOL}, asked AS (SELECT c_name AS person, s_name AS university FROM customer JOIN supplier ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier))
SELECT a.person, a.university, CASE WHEN bool_or(s.school = a.university) THEN 'CÓ' WHEN count(s.school) > 0 THEN 'KHÔNG' ELSE '?' END AS answer, coalesce(string_agg(s.school, ',' ORDER BY s.school), '') AS seen
FROM asked a LEFT JOIN schools s ON s.title = a.person GROUP BY a.person, a.university""")
def answer_person_school(spark, sf):
    """Q3, Q5."""
    suppliers = views.table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("university"))
    asked = views.table(spark, sf, "customer").join(F.broadcast(suppliers), F.col("c_custkey") % suppliers.count() == F.col("s_suppkey")).select(F.col("c_name").alias("person"), "university")
    return qa.person_school(asked, _schools(spark, sf)).select("person", "university", "answer", _said("seen"))


@query(f"""WITH {_ALUMNI}, {_SCHOOL}, l AS (SELECT school, list(title ORDER BY title) AS t FROM schools GROUP BY school)
SELECT s_suppkey AS question_id, s_name AS university, coalesce(array_to_string(t[1:50], ','), '') AS people, CAST(greatest(coalesce(len(t), 0) - 50, 0) AS INTEGER) AS others FROM supplier LEFT JOIN l ON school = s_name""")
def answer_alumni(spark, sf):
    """Q10: alumni of every university."""
    asked = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("question_id"), F.col("s_name").alias("university"))
    found = qa.alumni_listing(asked, views.nodes(spark, sf), views.alumni_edges(spark, sf))
    return found.select("question_id", "university", F.coalesce(F.array_join("people", ","), F.lit("")).alias("people"), F.coalesce("others", F.lit(0)).alias("others"))


_WORDS_OF = "list_filter(string_split(lower({}), ' '), lambda w: length(w) > 2 AND w NOT IN ('nha', 'nguoi', 'and', 'the'))"


@query(rf"""WITH p AS (SELECT c_custkey AS k, c_name AS title, replace(lower({_pick(_CAREERS, "c_custkey * 7")}), 'ê', 'e') AS p FROM customer)
SELECT x.title AS a, y.title AS b, CASE WHEN x.p = y.p OR list_has_any({_WORDS_OF.format("x.p")}, {_WORDS_OF.format("y.p")}) THEN 'CÓ' ELSE 'KHÔNG' END AS answer FROM p x JOIN p y ON y.k = x.k + 1""")
def answer_same_profession(spark, sf):
    """Q6."""
    d = _details(spark, sf)
    pairs = d.select(F.col("title").alias("a"), (F.col("k") + 1).alias("n")).join(d.select(F.col("title").alias("b"), F.col("k").alias("n")), "n").select("a", "b")
    return qa.same_profession(pairs, d.select("title", "properties"))


@query("""WITH p AS (SELECT c_custkey AS k, c_name AS title, list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda w: length(w) > 2) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT x.title AS a, y.title AS b, CASE WHEN list_has_any(x.w, y.w) THEN 'CÓ' ELSE 'KHÔNG' END AS answer FROM p x JOIN p y ON y.k = x.k + 1""")
def answer_shared_school_words(spark, sf):
    """Q13."""
    d = _details(spark, sf)
    pairs = d.select(F.col("title").alias("a"), (F.col("k") + 1).alias("n")).join(d.select(F.col("title").alias("b"), F.col("k").alias("n")), "n").select("a", "b")
    return qa.shared_school_words(pairs, d.select("title", "properties"))


@query(f"""WITH {_ALUMNI}, {_SCHOOL}, c AS (SELECT count(*) AS c FROM supplier), asked AS (SELECT c_custkey AS question_id, c_name AS title, unnest(range(4)) AS pos FROM customer),
options AS (SELECT question_id, title, pos, s_name FROM asked, c JOIN supplier ON s_suppkey = (question_id * 3 + pos * 7) % c)
SELECT question_id, arg_min(substr('ABCD', pos + 1, 1), pos) FILTER (WHERE s.school IS NOT NULL) AS letter FROM options o LEFT JOIN schools s ON s.title = o.title AND s.school = o.s_name GROUP BY question_id""")
def answer_multiple_choice(spark, sf):
    """A question with four universities about each person."""
    suppliers = views.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    n = suppliers.count()
    asked = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), "c_name", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    options = asked.join(L.merged(suppliers), (F.col("question_id") * 3 + F.col("pos") * 7) % n == F.col("s_suppkey"))
    said = F.concat(F.substring(F.lit("ABCD"), F.col("pos") + 1, F.lit(1)), F.lit(". "), "s_name")
    text = options.groupBy("question_id", "c_name").agg(F.array_sort(F.collect_list(said)).alias("o"))
    questions = cut(text.select("question_id", F.concat("c_name", F.lit(" học trường nào? "), F.array_join("o", " ")).alias("text")), "questions")
    return qa.multiple_choice(questions, _schools(spark, sf), views.nodes(spark, sf))


@query("""SELECT c_custkey AS question_id, CASE WHEN s_name IS NULL THEN c_name ELSE c_name || '|' || s_name END AS entities, s_name AS university
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def linked_entities(spark, sf):
    """Persons and universities that questions name, longest titles first."""
    suppliers = views.table(spark, sf, "supplier").select("s_suppkey", "s_name")
    rows = views.table(spark, sf, "customer").join(L.merged(suppliers), F.col("c_custkey") == F.col("s_suppkey"), "left")
    questions = cut(rows.select(F.col("c_custkey").alias("question_id"), F.concat_ws(" ", F.lit("Có phải"), "c_name", F.lit("học ở"), "s_name", F.lit("không?")).alias("text")), "questions")
    nodes = views.nodes(spark, sf)
    typed = L.typed_node(questions, nodes, "university")
    return L.linked_entities(questions, nodes).join(L.merged(typed), "question_id").select("question_id", F.array_join("entities", "|").alias("entities"), F.col("title").alias("university"))


@query(f"""WITH {_EDGES}, ends AS (SELECT src AS id, dst AS neighbour, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges),
first AS (SELECT id, neighbour || '/' || type AS n, row_number() OVER (PARTITION BY id ORDER BY direction, neighbour, type) AS place FROM ends)
SELECT c_custkey AS question_id, CAST(0 AS INTEGER) AS pos, c_name AS title, 'P' || c_custkey AS id, (SELECT string_agg(n, ',' ORDER BY place) FROM first f WHERE f.id = 'P' || c_custkey AND place <= 5) AS neighbours FROM customer""")
def retrieved_context(spark, sf):
    """The first neighbours of the entities of each question."""
    questions = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("question_id"), F.col("c_name").alias("text"))
    found = L.retrieved_context(questions, views.nodes(spark, sf), cut(views.edges(spark, sf), "edges"))
    return found.withColumn("neighbours", F.array_join(F.transform("neighbours", lambda x: F.concat(x["neighbour"], F.lit("/"), x["type"])), ","))


@query(f"""WITH {_ALUMNI} SELECT s_suppkey, s_name AS university, string_agg(c_name, ',' ORDER BY c_name) AS people FROM alumni JOIN supplier ON university = 'U' || s_suppkey JOIN customer ON person = 'P' || c_custkey GROUP BY ALL""")
def alumni_titles(spark, sf):
    """Edges of one relation with the titles of both ends."""
    rows = E.of_relation(views.edges(spark, sf), "alumni_of").select("src", "dst")
    named = E.labelled(rows, views.nodes(spark, sf), "src").select("dst", F.col("title").alias("person"))
    both = E.labelled(named, views.nodes(spark, sf), "dst").select(F.substring("dst", 2, 20).cast("long").alias("s_suppkey"), F.col("title").alias("university"), "person")
    return both.groupBy("s_suppkey", "university").agg(F.array_join(F.array_sort(F.collect_list("person")), ",").alias("people"))


@query(f"WITH {_BORN} SELECT src AS id FROM born WHERE dst = (SELECT 'country_' || n_name FROM nation WHERE n_nationkey = 7) ORDER BY src LIMIT 100")
def people_by_country(spark, sf):
    """J16."""
    name = views.table(spark, sf, "nation").where("n_nationkey = 7").first()["n_name"]
    country = L.resolved_country(views.nodes(spark, sf), name.lower()).first()["id"]
    return L.people_of_country(views.edges(spark, sf), country)


@query("""SELECT c_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (3, 7))""")
def property_matches(spark, sf):
    """Persons whose properties name a university of one of two nations."""
    names = [r["n_name"] for r in views.table(spark, sf, "nation").where("n_nationkey in (3, 7)").collect()]
    details = _details(spark, sf).select("title", F.map_filter("properties", lambda k, v: k == "Alma mater").alias("properties"))
    return L.property_matches(details, names, "university")


# Nodes, aggregates, unions


@query(f"WITH {_EDGES} SELECT type, count(*) AS n, string_agg(dst, ',' ORDER BY dst) AS targets FROM edges WHERE src = 'P1' GROUP BY type")
def node_profile(spark, sf):
    """A8."""
    return A.profile(views.edges(spark, sf), "P1").select("type", "n", _said("targets"))


@query(f"""WITH {_NODES}, {_EDGES}, ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges UNION ALL SELECT id, 0, 0 FROM nodes), d AS (SELECT id, sum(i) AS i, sum(o) AS o FROM ends GROUP BY id)
SELECT id, title, type, CAST(i AS BIGINT) AS in_degree, CAST(o AS BIGINT) AS out_degree, CASE WHEN type = 'university' THEN 'institution' WHEN i + o > 300 THEN 'hub' WHEN i > 2 * o THEN 'cited' ELSE 'connected' END AS reason FROM nodes JOIN d USING (id)""")
def node_info(spark, sf):
    """T25, T22."""
    nodes = views.nodes(spark, sf)
    found = A.degrees(nodes, views.edges(spark, sf)).join(nodes, "id")
    return found.select("id", "title", "type", "in_degree", "out_degree", G.hub_reason(F.col("type"), F.col("degree"), F.col("in_degree"), F.col("out_degree")).alias("reason"))


@query(f"""WITH {_LINKS}, p AS (SELECT 'P' || c_custkey AS id, c_name AS title, 'n' || c_nationkey AS c FROM customer), e AS (SELECT src, dst FROM link_to UNION SELECT dst, src FROM link_to),
d AS (SELECT src AS id, count(*) AS d FROM e JOIN p x ON x.id = src JOIN p y ON y.id = dst WHERE x.c = y.c GROUP BY src),
r AS (SELECT c, title, row_number() OVER (PARTITION BY c ORDER BY coalesce(d, 0) DESC, p.id) AS place FROM p LEFT JOIN d USING (id))
SELECT c AS community, count(*) AS size, round(100.0 * count(*) / (SELECT count(*) FROM p), 9) AS percent, 'person=' || count(*) AS types, string_agg(title, ',' ORDER BY place) FILTER (WHERE place <= 3) AS top,
CASE WHEN count(*) > 500 THEN '🌍 Cộng đồng Alumni Toàn Cầu (Global Network)' ELSE '🔗 Cộng đồng #' || substr(c, 2) END AS name FROM r GROUP BY c""")
def community_names(spark, sf):
    """Persons by nation as communities."""
    people = views.nodes(spark, sf).where("type = 'person'")
    parts = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("community"))
    found = G.community_stats(parts, people, cut(views.link_to(spark, sf), "links"))
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    name = G.community_label(F.col("size"), F.col("types"), F.col("top_people"), F.substring("community", 2, 9).cast("int"))
    return found.select("community", "size", F.round("percent", 9).alias("percent"), types.alias("types"), _said("top"), name.alias("name"))


@query(f"{_GIANT} SELECT round(avg(dist) FILTER (WHERE dist > 0), 9) AS mean_length, CAST(max(dist) AS INTEGER) AS diameter FROM inside")
def mean_and_diameter(spark, sf):
    """Of the largest component of persons and universities."""
    links = cut(D.undirected(views.alumni_edges(spark, sf)), "alumni")
    nodes = cut(G.largest_component(G.components(links.select(F.col("src").alias("id")).distinct(), links)), "largest")
    return G.path_lengths(D.induced(links, nodes), nodes).select(F.round("mean_length", 9).alias("mean_length"), F.col("diameter").cast("int").alias("diameter"))


@query(f"""WITH {_STUDIED}, {_NEXT}, d AS (SELECT DISTINCT src AS a, dst AS b FROM studied) SELECT c.a, c.b, CASE WHEN d.a IS NULL THEN CAST(0 AS INTEGER) ELSE CAST(1 AS INTEGER) END AS hops, d.a IS NOT NULL AS connected
FROM (SELECT 'P' || c_custkey AS a, 'U' || c_custkey % (SELECT count(*) FROM supplier) AS b FROM customer) c LEFT JOIN d USING (a, b)""")
def hop_counts(spark, sf):
    """From persons to universities along edges that lead from persons to universities."""
    n = views.table(spark, sf, "supplier").count()
    pairs = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("a"), F.concat(F.lit("U"), F.col("c_custkey") % n).alias("b"))
    return G.hops(views.alumni_edges(spark, sf), pairs)


@query(f"""WITH {_STUDIED}, p AS (SELECT 'U' || s_suppkey AS a, 'U' || (s_suppkey + 1) AS b FROM supplier), w AS (SELECT p.a, p.b, x.src AS m FROM p JOIN studied x ON x.dst = p.a JOIN studied y ON y.src = x.src AND y.dst = p.b)
SELECT a, b, CAST(2 AS INTEGER) AS hops, a || ',' || m || ',' || b AS path, CAST(row_number() OVER (PARTITION BY a, b ORDER BY m) AS INTEGER) AS place FROM w QUALIFY place <= 5""")
def shortest_few(spark, sf):
    """At most five of the shortest ways of up to three edges between each university and the next."""
    pairs = views.table(spark, sf, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("a"), F.concat(F.lit("U"), F.col("s_suppkey") + 1).alias("b"))
    found = A.of_minimal_length(G.simple_paths(cut(views.alumni_edges(spark, sf), "alumni"), pairs, 3))
    return found.select("a", "b", F.col("hops").cast("int").alias("hops"), _said("path"), "place")


@query("""SELECT c_nationkey AS page, c_name AS dst, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS pos FROM customer QUALIFY pos <= 20 ORDER BY page, pos LIMIT 100""")
def capped_links(spark, sf):
    """Twenty links a page, a hundred a level."""
    place = F.expr("row_number() over (partition by c_nationkey order by c_custkey)")
    links = views.table(spark, sf, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_name").alias("dst"), place.alias("pos"))
    return A.capped(links, "page", 20, 100)


@query("SELECT p_partkey, p_name FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 20")
def longest_names(spark, sf):
    """L4."""
    return A.top(views.table(spark, sf, "part").select("p_partkey", "p_name"), [F.desc(F.length("p_name")), F.asc("p_partkey")], 20)


@query("SELECT title, min(src) AS src FROM (SELECT DISTINCT c_mktsegment AS title, 'c' AS src FROM customer UNION SELECT p_type, 'p' FROM part UNION SELECT n_name, 'n' FROM nation) GROUP BY title")
def union_of_titles(spark, sf):
    """Distinct rows of three tables."""
    rows = D.union_distinct(
        views.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("title"), F.lit("c").alias("src")),
        views.table(spark, sf, "part").select(F.col("p_type").alias("title"), F.lit("p").alias("src")),
        views.table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.lit("n").alias("src")),
    )
    return rows.groupBy("title").agg(F.min("src").alias("src"))


@query(f"WITH {_LINKS} SELECT src, dst FROM link_to WHERE dst IN (SELECT 'P' || c_custkey FROM customer WHERE c_acctbal > 5000)")
def links_into_set(spark, sf):
    """Links whose target is in a set of titles, given with blanks to be collapsed."""
    rich = views.table(spark, sf, "customer").where("c_acctbal > 5000").select(F.concat(F.lit(" P"), "c_custkey", F.lit(" ")).alias("title"))
    return E.in_set(views.link_to(spark, sf).select("src", "dst"), "dst", rich)


@query("SELECT n_name AS title FROM nation")
def rescued_rows(spark, sf):
    """What is left of nothing is replaced by the second table."""
    nations = views.table(spark, sf, "nation").select(F.col("n_name").alias("title"))
    return D.either(sinks.new_rows(nations, nations, ["title"]), nations)


@query("""WITH r AS (SELECT 'P' || c_custkey AS id, c_name AS title, 'person' AS type, 0 AS prio FROM customer UNION ALL SELECT 'P' || c_custkey, 'other', 'university', 1 FROM customer UNION ALL SELECT 'U' || s_suppkey, s_name, NULL, 1 FROM supplier
UNION ALL SELECT 'career_' || c_mktsegment, c_mktsegment, 'person', 0 FROM customer)
SELECT id, arg_min(title, prio) AS title, CASE WHEN id LIKE 'U%' THEN 'university' WHEN starts_with(id, 'career_') THEN 'career' ELSE 'person' END AS type FROM r GROUP BY id""")
def unified_nodes(spark, sf):
    """Nodes of two sources, the first one's titles, types corrected."""
    people = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit("person").alias("type"))
    careers = views.table(spark, sf, "customer").select(F.concat(F.lit("career_"), "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("title"), F.lit("person").alias("type"))
    unis = views.table(spark, sf, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("id"), F.col("s_name").alias("title"), F.lit(None).cast("string").alias("type"))
    second = people.select("id", F.lit("other").alias("title"), F.lit("university").alias("type")).unionByName(unis)
    return enrich.unified_nodes([people.unionByName(careers), second], unis.select("title"))


# Crawl, seeds, details


@query(f"""WITH RECURSIVE {_LINKS}, found(title, depth) USING KEY (title) AS (SELECT 'P' || min(c_custkey), 1 FROM customer
    UNION SELECT l.dst, min(f.depth + 1) FROM found f JOIN link_to l ON l.src = f.title LEFT JOIN recurring.found r ON r.title = l.dst WHERE r.title IS NULL AND f.depth < 4 GROUP BY 1)
SELECT title, CAST(depth AS INTEGER) AS depth, title IN (SELECT 'P' || o_custkey FROM orders) AS accepted FROM found""")
def crawled(spark, sf):
    """Four levels from one seed, with caps that no level reaches."""
    links = views.link_rows(spark, sf).groupBy("src", "dst").agg(F.min("ord").alias("pos"))
    seed = views.table(spark, sf, "customer").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("P"), "k").alias("title"))
    accepts = views.table(spark, sf, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("title"))
    config = readers.CrawlConfig(max_person_nodes=1 << 30, per_depth_limit=1 << 30, max_depth=4, candidate_cap=1 << 30)
    return crawl.crawl(links, seed, accepts, config)


@query(f"""WITH {_LINKS}, {_ALUMNI}, t AS (SELECT DISTINCT src, dst FROM link_to JOIN alumni ON person = dst) SELECT 'seeds' AS tab, dst AS a, '' AS b, CAST(NULL AS INTEGER) AS year FROM t GROUP BY dst
UNION ALL SELECT 'person_edges', src, dst, NULL FROM t UNION ALL SELECT DISTINCT 'edu_edges', university, dst, year FROM (SELECT 'U' || substr(src, 2) AS u, dst FROM t) JOIN alumni ON person = dst AND university = u""")
def seed_tables(spark, sf):
    """Of the persons that roots link to, those with known education; a root stands for the university of its number too."""
    links, alumni = cut(views.link_to(spark, sf).select("src", "dst"), "links"), cut(views.alumni(spark, sf), "alumni")
    education = alumni.select(F.col("person").alias("title"), "university", "year")
    people = links.select(F.col("src").alias("title")).distinct()
    pages = alumni.select(F.col("person").alias("title")).distinct()
    own = enrich.seed_tables(education, links, people, pages)
    roots = links.select(F.concat(F.lit("U"), F.substring("src", 2, 20)).alias("src"), "dst")
    edu = enrich.seed_tables(education, roots, roots.select(F.col("src").alias("title")).distinct(), pages)["edu_edges"]
    none = F.lit(None).cast("int").alias("year")
    return (
        own["seeds"].select(F.lit("seeds").alias("tab"), F.col("person_title").alias("a"), F.lit("").alias("b"), none)
        .unionByName(own["person_edges"].select(F.lit("person_edges").alias("tab"), F.col("src_root").alias("a"), F.col("dst_person").alias("b"), none))
        .unionByName(edu.select(F.lit("edu_edges").alias("tab"), F.col("src_university").alias("a"), F.col("dst_person").alias("b"), "year"))
    )


@query(f"""WITH {_ALUMNI}, {_BORN}, e AS (SELECT person, string_agg(university || ':' || year, ',' ORDER BY university) AS s FROM alumni GROUP BY person), n AS (SELECT 'P' || c_custkey AS p, c_nationkey, c_custkey % 3 AS depth FROM customer)
SELECT p AS title, CAST(depth AS INTEGER) AS depth, 'https://vi.wikipedia.org/wiki/' || p AS link, s AS education, dst || ':born_in' AS relations FROM n LEFT JOIN e ON person = p JOIN born ON src = p""")
def person_details(spark, sf):
    """A document for each person; fellow students are left empty here, as pairs have queries of their own."""
    alumni = cut(views.alumni(spark, sf), "alumni")
    levels = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("title"), (F.col("c_custkey") % 3).cast("int").alias("depth"))
    relations = views.born_in(spark, sf).select(F.col("src").alias("title"), F.col("dst").alias("other"), "type")
    none = spark.createDataFrame([], "p1 string, p2 string")
    found = enrich.person_details(levels, alumni.select(F.col("person").alias("title"), "university", "year"), relations, none, none)
    education = F.array_join(F.transform("education", lambda x: F.concat_ws(":", x["school"], x["year"].cast("string"))), ",")
    related = F.array_join(F.transform("relations", lambda x: F.concat_ws(":", x["person_title"], x["type"])), ",")
    return found.select("title", "depth", "link", education.alias("education"), related.alias("relations"))


@query(f"""WITH {_LINKS}, {_ALUMNI} SELECT 'P' || c_custkey AS title FROM customer WHERE NOT ('P' || c_custkey IN (SELECT src FROM link_to) AND 'P' || c_custkey IN (SELECT person FROM alumni))""")
def uncrawled_roots(spark, sf):
    """Persons that have no links yet, or no university."""
    roots = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("title"))
    return crawl.uncrawled(roots, views.link_to(spark, sf).select(F.col("src").alias("source_title")), views.alumni(spark, sf).select(F.col("person").alias("title")))


@query(f"""WITH {_LINKS}, {_ALUMNI}, t AS (SELECT DISTINCT dst FROM link_to), o AS (SELECT DISTINCT 'P' || o_custkey AS p FROM orders), u AS (SELECT DISTINCT person FROM alumni)
SELECT count(*) AS candidates, count(p) AS persons, count(CASE WHEN p IS NOT NULL THEN person END) AS ok_people, count(*) - count(p) AS rejected FROM t LEFT JOIN o ON p = dst LEFT JOIN u ON person = dst""")
def candidate_counts(spark, sf):
    """A19."""
    links = views.link_to(spark, sf)
    pages = views.table(spark, sf, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("title"))
    return crawl.candidate_counts(links, links.select(F.col("src").alias("title")).distinct(), pages, views.alumni(spark, sf).select(F.col("person").alias("title")))


@query("""SELECT o_orderpriority AS type, o_orderstatus AS category, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def question_counts(spark, sf):
    """A17."""
    return qa.question_counts(views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("category")))


@query(f"""WITH {_NODES}, {_EDGES}, n AS (SELECT id FROM nodes WHERE contains(lower(title), '00017') ORDER BY title, id LIMIT 1),
e AS (SELECT src AS id, dst AS neighbour, type, 'out' AS direction FROM edges UNION ALL SELECT dst, src, type, 'in' FROM edges)
SELECT e.id, neighbour, title, e.type, direction FROM e JOIN n USING (id) JOIN nodes ON nodes.id = neighbour""")
def ego_network(spark, sf):
    """B8."""
    return L.ego_network(views.edges(spark, sf), views.nodes(spark, sf), "00017")


@query("SELECT 'P' || c_custkey AS id FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY id LIMIT 100")
def people_by_career(spark, sf):
    """B8."""
    return L.people_of_career(views.edges(spark, sf), "career_MACHINERY")


@query(f"WITH {_NODES}, {_EDGES} SELECT n.type AS node_type, e.type, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.src GROUP BY ALL")
def sql_surface(spark, sf):
    """A query in SQL over the registered views."""
    views.register(spark, sf)
    return spark.sql("SELECT n.type AS node_type, e.type, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.src GROUP BY n.type, e.type")


@query(f"WITH {_ALUMNI} SELECT c_name AS title, 'person' AS kind, string_agg(university, ',' ORDER BY university) AS detail FROM customer JOIN alumni ON person = 'P' || c_custkey GROUP BY c_name UNION ALL SELECT s_name, 'university', CAST(count(person) AS VARCHAR) FROM supplier LEFT JOIN alumni ON university = 'U' || s_suppkey GROUP BY s_name")
def detail_union(spark, sf):
    """Details of persons, and of universities."""
    alumni = cut(views.alumni(spark, sf), "alumni")
    people = views.table(spark, sf, "customer").select(F.concat(F.lit("P"), "c_custkey").alias("person"), F.col("c_name").alias("title"))
    unis = views.table(spark, sf, "supplier").select(F.concat(F.lit("U"), "s_suppkey").alias("university"), F.col("s_name").alias("title"))
    own = people.join(alumni, "person").groupBy("title").agg(F.array_join(F.sort_array(F.collect_list("university")), ",").alias("detail")).select("title", F.lit("person").alias("kind"), "detail")
    return own.unionByName(unis.join(alumni, "university", "left").groupBy("title").agg(F.count("person").cast("string").alias("detail")).select("title", F.lit("university").alias("kind"), "detail"))


# Sources and sinks: written, read back


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/roundtrip-{uuid.uuid4().hex}"


@query("SELECT p_partkey, p_name || ', \"' || p_type || '\"' AS title, p_size FROM part")
def csv_round_trip(spark, sf):
    """Quotes and commas come back; a missing file adds nothing."""
    path = _folder(spark)
    sinks.write_csv(views.table(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type", F.lit('"')).alias("title"), "p_size"), path)
    schema = "p_partkey bigint, title string, p_size int"
    return readers.read_csv(spark, path, schema).unionByName(readers.read_csv_or_empty(spark, f"{path}/none", schema))


@query("SELECT p_name AS title FROM part WHERE p_size <= 50")
def sniffed_titles(spark, sf):
    """Titles from a column found by its name."""
    path = _folder(spark)
    sinks.write_csv(views.table(spark, sf, "part").where("p_size <= 50").select("p_partkey", F.col("p_name").alias("Title")), path)
    return readers.read_node_titles(spark, path)


@query("""SELECT 'P' || o_custkey AS a, 'P' || o_orderkey AS b, 1.0 / (1 + CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 ELSE 1 END) AS weight FROM orders""")
def sniffed_edges(spark, sf):
    """The ends' columns found by their names; counts that can't be read are 1."""
    path = _folder(spark)
    count = F.when(F.col("o_orderstatus") == "F", (F.col("o_orderkey") % 5).cast("string")).otherwise("?")
    sinks.write_csv(views.table(spark, sf, "orders").select(F.concat(F.lit("P"), "o_custkey").alias("src_person"), F.concat(F.lit("P"), "o_orderkey").alias("dst_person"), count.alias("Count")), path)
    return readers.read_weighted_edges(spark, path)


@query(f"WITH {_ALUMNI} SELECT person AS title, string_agg(university, ',' ORDER BY university) AS related FROM alumni GROUP BY person")
def json_round_trip(spark, sf):
    """Documents with lists; a missing file adds nothing."""
    path, schema = _folder(spark), "title string, related array<string>"
    docs = views.alumni(spark, sf).groupBy(F.col("person").alias("title")).agg(F.sort_array(F.collect_list("university")).alias("related"))
    sinks.write_json(docs, path)
    found = spark.read.schema(schema).json(path).unionByName(readers.read_json_tolerant(spark, f"{path}/none", schema))
    return found.select("title", _said("related"))


@query("""SELECT 'person' AS kind, c_name AS title FROM (SELECT c_name FROM customer ORDER BY c_name LIMIT 30) UNION ALL SELECT 'university', s_name FROM (SELECT s_name FROM supplier ORDER BY s_name LIMIT 30)""")
def limited_roots(spark, sf):
    """S8, L5."""
    roots = views.nodes(spark, sf).select("title", F.upper(F.concat(F.lit(" "), "type")).alias("type"))
    found = readers.roots_by_type(roots, 30)
    return found["person"].select(F.lit("person").alias("kind"), "title").unionByName(found["university"].select(F.lit("university").alias("kind"), "title"))


@query(f"""WITH {_LINKS}, {_ALUMNI} SELECT src, dst, 'link_to' AS type, CAST(1 AS INTEGER) AS weight FROM link_to UNION ALL SELECT person, university, 'link_to', 1 FROM alumni""")
def heterogeneous_edges(spark, sf):
    """Files with columns for persons, and for persons and universities."""
    pp = views.link_to(spark, sf).select(F.col("src").alias("src_person"), F.concat(F.lit(" "), "dst").alias("dst_person"))
    pu = views.alumni(spark, sf).select(F.col("person").alias("src_person"), F.col("university").alias("dst_university"))
    return readers.mention_edges([pp, pu])


@query(f"""WITH {_NODES}, {_EDGES} SELECT 'nodes' AS "table", count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges""")
def run_summary(spark, sf):
    """K9."""
    return sinks.run_summary({"nodes": views.nodes(spark, sf), "edges": views.edges(spark, sf)})


@query(f"""WITH {_ALUMNI} SELECT '<node id="P' || c_custkey || '"/>' AS line FROM customer UNION ALL SELECT '<edge source="' || person || '" target="' || university || '"/>' FROM alumni""")
def graphml_lines(spark, sf):
    """K11, without the lines around nodes and edges."""
    people = views.nodes(spark, sf).where("type = 'person'")
    return sinks.graphml(people, views.alumni_edges(spark, sf)).where("line like '<node%' or line like '<edge%'").select("line")


@query(f"""WITH {_ALUMNI} SELECT (SELECT string_agg(c_name, ',' ORDER BY c_name) FROM customer) AS persons, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier) AS universities,
(SELECT string_agg(university || ':' || person, ',' ORDER BY university, person) FROM alumni) AS edges_up, (SELECT string_agg(y || '=' || n, ',' ORDER BY y) FROM (SELECT year AS y, count(*) AS n FROM alumni GROUP BY year)) AS depths""")
def graph_document(spark, sf):
    """K6."""
    nodes, alumni = views.nodes(spark, sf), cut(views.alumni(spark, sf), "alumni")
    depths = A.counts(alumni.select(F.col("year").alias("depth")), "depth")
    doc = sinks.graph_document(nodes.where("type = 'person'"), nodes.where("type = 'university'"), {"edges_up": alumni.select("university", "person")}, depths)
    up = F.array_join(F.transform("edges_up", lambda e: F.concat_ws(":", e["university"], e["person"])), ",")
    years = F.array_join(F.array_sort(F.transform(F.map_entries("depth_stats"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))), ",")
    return doc.select(_said("persons"), _said("universities"), up.alias("edges_up"), years.alias("depths"))


@query("SELECT conv_id, turn, role FROM conversations")
def chat_log(spark, sf):
    """Turns appended in two batches."""
    path = _folder(spark)
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    sinks.append_chat(turns.where("role = 'user'"), path)
    sinks.append_chat(turns.where("role <> 'user'"), path)
    return spark.read.parquet(path)


@query(f"""WITH {_LINKS} SELECT x AS sigma_like, n FROM (SELECT round((1.0 * count(*) / 7) / (2.0 / 3), 9) AS x, count(*) AS n FROM link_to)""")
def sigma_of_links(spark, sf):
    """U39."""
    n = views.link_to(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.round(U.small_world(F.col("n").cast("double"), F.lit(7.0), F.lit(2.0), F.lit(3.0)), 9).alias("sigma_like"), "n")
