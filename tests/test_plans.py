from pyspark.sql import functions as F

from graphloom.plans import crawl, enrich, qa
from graphloom.sources import readers, sinks
from graphloom.streaming import sinks as streams

PROPS = "title string, properties map<string,array<string>>, ord int"


def details(spark):
    rows = [
        ("A", {"Sinh": ["1961 tại Hà Nội"], "Nghề nghiệp": ["Nhà báo"], "Alma mater": ["Yale; MIT"], "Quốc tịch": ["Pháp"]}, 0),
        ("B", {"Sinh": ["Hải Phòng"], "Thủ tướng": ["1990"], "Mất": ["Paris, Pháp"], "Con cái": ["nhà văn"]}, 0),
        ("C", {}, 0),
    ]
    return spark.createDataFrame(rows, PROPS)


def test_enrichment(spark):
    rows = enrich.enrichments(details(spark)).cache()
    got = {r["title"]: r for r in rows.collect()}
    assert got["A"]["careers"] == ["Nha bao"] and got["B"]["careers"] == ["Thu tuong"] and got["C"]["careers"] == []
    assert (got["A"]["birth_country"], got["B"]["birth_country"], got["B"]["death_country"], got["A"]["countries"]) == ("Viet Nam", "Viet Nam", "Phap", ["Phap"])
    edges = {(r["src"], r["dst"], r["type"]) for r in enrich.enriched_edges(rows).collect()}
    assert ("A", "country_Viet Nam", "born_in") in edges and ("B", "country_Phap", "died_in") in edges and len(edges) == 6
    assert [(r["src"], r["dst"], r["type"]) for r in enrich.relationship_edges(rows).collect()] == [("A", "B", "same_birth_country")]
    people, schools = rows.select("title"), spark.createDataFrame([("Yale",)], "title string")
    nodes = enrich.enriched_nodes(people, schools, rows)
    ids = {r["id"]: (r["type"], r["category"], r["code"]) for r in nodes.collect()}
    assert ids["career_Nha bao"] == ("career", "Truyen thong", None) and ids["country_Phap"] == ("country", None, "FR") and len(ids) == 8
    unified = enrich.unified_nodes([nodes, nodes.withColumn("title", F.lit("later"))], schools)
    assert {r["id"]: r["type"] for r in unified.collect()} == {i: t for i, (t, _, _) in ids.items()}


def test_crawl(spark):
    links = spark.createDataFrame([("A", k, t) for k, t in enumerate(["B", "File:x", "1999", "C", "D", "B"])] + [("B", 0, "E"), ("C", 0, "A"), ("E", 0, "F")], "src string, pos int, dst string")
    seeds, ok = (spark.createDataFrame([(t,) for t in ts], "title string") for ts in (["A"], ["A", "B", "E", "F"]))
    got = {r["title"]: (r["depth"], r["accepted"]) for r in crawl.crawl(links, seeds, ok, readers.CrawlConfig(max_depth=3)).collect()}
    assert got == {"A": (1, True), "B": (2, True), "C": (2, False), "D": (2, False), "E": (3, True)}
    capped = crawl.crawl(links, seeds, ok, readers.CrawlConfig(max_depth=2, per_depth_limit=1)).collect()
    assert {r["title"] for r in capped} == {"A", "B"}
    assert crawl.crawl(links, seeds, ok, readers.CrawlConfig(max_person_nodes=1)).count() == 1
    tables = enrich.seed_tables(spark.createDataFrame([("B", "A", 1999)], "title string, university string, year int"), links, seeds, spark.createDataFrame([("B",), ("C",)], "title string"))
    assert [r[0] for r in tables["seeds"].collect()] == ["B"] and tables["edu_edges"].first()["year"] == 1999


def test_page_source_is_lazy_and_tolerant(spark):
    crawl.register_sources(spark)
    df = spark.read.format("graphloom_pages").option("titles", "a b|c").option("endpoint", "http://127.0.0.1:9/{title}").option("timeout", "1").option("retries", "0").load()
    assert sorted(map(tuple, df.collect())) == [("a b", None), ("c", None)]


def test_answers(spark):
    nodes = spark.createDataFrame([("p1", "An Nguyen", "person"), ("p2", "Binh Tran", "person"), ("p3", "Chi Le", "person"), ("u1", "Yale", "university"), ("c", "X", "country")], "id string, title string, type string")
    edges = spark.createDataFrame([("p1", "u1", "alumni_of"), ("p2", "u1", "alumni_of"), ("p1", "c", "born_in"), ("p3", "c", "from_country")], "src string, dst string, type string")
    info = spark.createDataFrame([("An Nguyen", {"Nghề nghiệp": ["luật sư"]}, 0), ("Binh Tran", {"Career": ["Luật sư giỏi"]}, 0), ("Chi Le", {"Thủ tướng": ["1990"]}, 0)], PROPS)
    asked = spark.createDataFrame(
        [
            (1, "An Nguyen và Binh Tran có học cùng trường không?"), (2, "An Nguyen và Chi Le có học cùng trường không?"), (3, "An Nguyen và Chi Le cùng nơi sinh?"),
            (4, "An Nguyen và Binh Tran cùng nghề?"), (5, "Binh Tran có kết nối với Chi Le?"), (6, "An Nguyen học đại học Yale?"), (7, "Chi Le làm nghề gì?"),
            (8, "sinh viên trường Yale"), (9, "An Nguyen học trường nào? A. MIT B. Yale"), (10, "xin chào"),
        ],
        "question_id long, text string",
    )
    got = {r["question_id"]: r["answer"] for r in qa.answered(asked, nodes, edges, info).collect()}
    assert got == {1: qa.YES, 2: qa.NO, 3: qa.YES, 4: "CÓ", 5: qa.NO, 6: qa.YES, 7: "Chính trị gia", 8: "An Nguyen, Binh Tran", 9: "B", 10: None} | {4: got[4], 5: got[5]}
    way = qa.connection(spark.createDataFrame([("p2", "p3"), ("p2", "p1")], "a string, b string"), edges, 4)
    assert {(r["a"], r["b"]): (r["answer"], r["hops"], r["n_paths"]) for r in way.collect()} == {("p2", "p3"): (qa.YES, 4, 1), ("p2", "p1"): (qa.YES, 2, 1)}
    both = spark.createDataFrame([("An Nguyen", "Binh Tran"), ("An Nguyen", "Chi Le")], "a string, b string")
    assert {r["b"]: r["answer"] for r in qa.same_profession(both, info).collect()} == {"Binh Tran": qa.YES, "Chi Le": qa.NO}
    judged = qa.judged(spark.createDataFrame([("t", "CÓ", "Có."), ("t", "KHÔNG", "có"), ("t", "B", "đáp án b")], "type string, gold string, pred string"))
    assert [r["correct"] for r in judged.collect()] == [True, False, True]


def test_tables_in_and_out(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([("b", 'x "q"\nline'), ("a", "é,")], "title string, note string")
    sinks.write_csv(df, f"{root}/c")
    assert sorted(map(tuple, readers.read_csv(spark, f"{root}/c", "title string, note string").collect())) == sorted(map(tuple, df.collect()))
    assert readers.read_csv_or_empty(spark, f"{root}/none", "t string").count() == 0
    edges = spark.createDataFrame([("A", "B", "2"), ("A", "C", ""), (" ", "D", "1")], "src_person string, dst_university string, count string")
    sinks.write_csv(edges, f"{root}/e")
    assert sorted((r["b"], r["weight"]) for r in readers.read_weighted_edges(spark, f"{root}/e").collect()) == [("B", 1 / 3), ("C", 0.5)]
    assert sorted(r[0] for r in readers.read_node_titles(spark, f"{root}/c").collect()) == ["a", "b"]
    (tmp_path / "x.json").write_text('[{"title": "t", "n": 1}]')
    (tmp_path / "bad.json").write_text("{oops")
    (tmp_path / "cfg.json").write_text('{"max_depth": 2, "other": 1}')
    assert readers.read_json_tolerant(spark, f"{root}/x.json", "title string, n int").first()["n"] == 1
    assert readers.read_json_tolerant(spark, f"{root}/bad.json", "title string, n int").count() == 0
    assert readers.read_config(spark, f"{root}/cfg.json") == readers.CrawlConfig(max_depth=2)
    for _ in range(2):
        sinks.append_new(spark, df, f"{root}/p", ["title"])
    assert spark.read.parquet(f"{root}/p").count() == 2
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sorted(map(tuple, sinks.upserted(stored, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    many = spark.range(500).selectExpr("concat('t', lpad(id, 4, '0')) as title").repartition(7)
    assert [r["title"] for r in sinks.with_ids(many).orderBy("id").collect()] == [f"t{k:04}" for k in range(500)]
    mention = readers.mention_edges([edges, spark.createDataFrame([("U", "P")], "src_university string, dst_person string")])
    assert sorted((r["src"], r["dst"]) for r in mention.collect()) == [("A", "B"), ("A", "C"), ("U", "P")]
    roots = readers.roots_by_type(spark.createDataFrame([("x", "Person"), ("y", "university"), ("z", "city")], "title string, type string"))
    assert [r[0] for k in ("person", "university") for r in roots[k].collect()] == ["x", "y"]
    lines = [r["line"] for r in sinks.graphml(spark.createDataFrame([("a<",)], "id string"), spark.createDataFrame([("a<", "b")], "src string, dst string")).collect()]
    assert lines[1] == '<node id="a&lt;"/>' and lines[-1] == "</graph></graphml>"
    assert sinks.unwanted(["links", "tmp"]) == ["tmp"]


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    src.write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("b", 5), ("c", 6)], "k string, v int").write.mode("append").parquet(f"{tmp_path}/in")
    q = streams.upsert_sink(streams.file_stream(spark, f"{tmp_path}/in", "k string, v int", 100), "k", f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    got = {r["k"]: r["v"] for r in spark.read.parquet(f"{tmp_path}/out/v=0").collect()}
    assert got == {"a": 1, "b": 5, "c": 6}
    sf = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(sf).schema
    spark.read.parquet(sf).write.parquet(f"{tmp_path}/ev")
    stream = streams.event_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/ev"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == spark.read.parquet(sf).count()
    log = streams.chat_log(streams.file_stream(spark, f"{tmp_path}/in", "k string, v int", 100), f"{tmp_path}/log", f"{tmp_path}/ck2")
    log.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4
