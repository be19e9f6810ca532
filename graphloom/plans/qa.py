"""Questions over the graph, a table of them at a time: classified, linked, answered by joins, judged (Q1 to Q17).

What a language model would have to write is left as retrieved context; everything else is a rule and a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import birth_place, choices, fold, question_type, school_tokens, split_list
from graphloom.functions.values import all_values, first_of, holds_keyword
from graphloom.operators import graph as G
from graphloom.operators import lookups as L
from graphloom.operators.aggregates import sample, seeded_order
from graphloom.storage import cut

YES, NO = "CÓ", "KHÔNG"
#: Offices that make a politician.
OFFICES = ("Tổng thống", "Phó Tổng thống", "Thủ tướng", "Phó Thủ tướng", "Thống đốc", "Tổng Bí thư", "Chủ tịch")


def classified(questions: DataFrame) -> DataFrame:
    """Q1: questions (question_id, text) with their type."""
    return questions.withColumn("type", question_type(F.col("text")))


def profession(properties: Column) -> Column:
    """Q11, Q6: the profession that the first known key gives; an office makes a politician."""
    said = F.coalesce(*(first_of(properties, tier) for tier in V.PROFESSION_TIERS))
    return F.coalesce(F.array_join(said, " "), F.when(holds_keyword(F.map_filter(properties, lambda k, v: k.isin(*OFFICES)), tuple(o.lower() for o in OFFICES)), "Chính trị gia"))


def schools_of(nodes: DataFrame, edges: DataFrame, details: DataFrame) -> DataFrame:
    """(title, school): what the properties list as alma mater, and the universities of alumni edges."""
    listed = details.select("title", F.explode(split_list(F.array_join(F.try_element_at("properties", F.lit("Alma mater")), ";"))).alias("school"))
    names = nodes.select("id", "title")
    linked = edges.where("type = 'alumni_of'").select("src", "dst").distinct()
    graph = linked.join(L.merged(names.select(F.col("id").alias("src"), "title")), "src").join(L.merged(names.select(F.col("id").alias("dst"), F.col("title").alias("school"))), "dst").select("title", "school")
    return listed.unionByName(graph).distinct()


def person_school(pairs: DataFrame, schools: DataFrame) -> DataFrame:
    """Q3, Q5: (person, university, answer, seen): whether a person's schools name the university."""
    rows = pairs.join(schools.withColumnRenamed("title", "person"), "person", "left")
    hit = F.contains(fold(F.col("school")), fold(F.col("university")))
    out = rows.groupBy("person", "university").agg(F.coalesce(F.max(hit), F.lit(False)).alias("hit"), F.array_sort(F.collect_set("school")).alias("seen"))
    return out.select("person", "university", F.when(F.col("hit"), YES).when(F.size("seen") > 0, NO).otherwise("?").alias("answer"), "seen")


def same_school(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Q4, J17."""
    return L.same_university(edges, pairs).select("a", "b", F.when(F.col("same"), YES).otherwise(NO).alias("answer"), "universities")


def same_profession(pairs: DataFrame, details: DataFrame, stop_words: tuple[str, ...] = ("nha", "nguoi", "and", "the")) -> DataFrame:
    """Q6: equal professions, or a common word of more than two letters."""
    known = details.select("title", fold(profession(F.col("properties"))).alias("p"))
    met = pairs.join(known.select(F.col("title").alias("a"), F.col("p").alias("pa")), "a", "left").join(known.select(F.col("title").alias("b"), F.col("p").alias("pb")), "b", "left")

    def words(c: str) -> Column:
        return F.filter(F.split(F.col(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))

    same = (F.col("pa") == F.col("pb")) | F.arrays_overlap(words("pa"), words("pb"))
    return met.select("a", "b", F.when(same, YES).when(same.isNotNull(), NO).otherwise("?").alias("answer"))


def same_birth_place(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Q8: (a, b, answer, countries): countries that both are born in or from."""
    home = edges.where(F.col("type").isin("born_in", "from_country")).select("src", "dst").distinct()
    met = pairs.join(home.select(F.col("src").alias("a"), "dst"), "a").join(home.select(F.col("src").alias("b"), "dst"), ["b", "dst"])
    found = met.groupBy("a", "b").agg(F.sort_array(F.collect_set("dst")).alias("countries"))
    return pairs.select("a", "b").distinct().join(found, ["a", "b"], "left").select("a", "b", F.when(F.col("countries").isNotNull(), YES).otherwise(NO).alias("answer"), "countries")


def connection(pairs: DataFrame, edges: DataFrame, cutoff: int = 3, near: int = 5) -> DataFrame:
    """Q7, Q9: (a, b, answer, hops, n_paths, relations, common): ways of at most `cutoff` edges, direct relations, common neighbours."""
    counted = G.path_counts(edges, pairs, cutoff)
    flipped = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "type")
    direct = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "type").unionByName(flipped).join(pairs, ["a", "b"], "left_semi")
    direct = direct.groupBy("a", "b").agg(F.sort_array(F.collect_set("type")).alias("relations"))
    common = L.common_neighbours(edges, pairs, near).groupBy("a", "b").agg(F.sort_array(F.collect_list("neighbour")).alias("common"))
    out = pairs.select("a", "b").distinct().join(counted, ["a", "b"], "left").join(direct, ["a", "b"], "left").join(common, ["a", "b"], "left")
    return out.select("a", "b", F.when(F.col("hops").isNotNull(), YES).otherwise(NO).alias("answer"), "hops", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), "relations", "common")


def alumni_listing(asked: DataFrame, nodes: DataFrame, edges: DataFrame, show: int = 50) -> DataFrame:
    """Q10: (question_id, university, people, others): the first names in order, and how many more there are."""
    people = edges.where("type = 'alumni_of'").select("src", "dst").distinct().join(nodes.select(F.col("id").alias("src"), "title"), "src").join(nodes.select(F.col("id").alias("dst"), F.col("title").alias("university")), "dst")
    lists = people.join(asked.select("university").distinct(), "university", "left_semi").groupBy("university").agg(F.sort_array(F.collect_set("title")).alias("all"))
    return asked.join(lists, "university", "left").select("question_id", "university", F.slice("all", 1, show).alias("people"), F.greatest(F.size("all") - show, F.lit(0)).alias("others"))


def multiple_choice(questions: DataFrame, schools: DataFrame, nodes: DataFrame) -> DataFrame:
    """Q12: (question_id, letter): the first option that a linked person's schools name."""
    options = questions.select("question_id", F.posexplode(choices(F.col("text"))).alias("pos", "o")).select("question_id", "pos", "o.letter", "o.text")
    person = L.linked_entities(questions, nodes).select("question_id", F.explode("entities").alias("title"))
    proof = person.join(L.merged(schools), "title").select("question_id", fold(F.col("school")).alias("s"))
    folded = options.select("question_id", "pos", "letter", fold(F.col("text")).alias("t"))
    hit = folded.join(L.merged(proof), "question_id").where(F.contains("s", "t") | F.contains("t", "s"))
    best = hit.groupBy("question_id").agg(F.min_by("letter", "pos").alias("letter"))
    return questions.select("question_id").join(L.merged(best), "question_id", "left")


def shared_school_words(pairs: DataFrame, details: DataFrame) -> DataFrame:
    """Q13: schools compared by their words."""
    words = details.select("title", school_tokens(F.array_join(F.try_element_at("properties", F.lit("Alma mater")), ";")).alias("w"))
    met = pairs.join(words.select(F.col("title").alias("a"), F.col("w").alias("wa")), "a", "left").join(words.select(F.col("title").alias("b"), F.col("w").alias("wb")), "b", "left")
    return met.select("a", "b", F.when(F.arrays_overlap("wa", "wb"), YES).otherwise(NO).alias("answer"))


def property_lookups(details: DataFrame) -> DataFrame:
    """Q14: (title, profession, birth_place, text): what handlers of single properties read."""
    p = F.col("properties")
    return details.select("title", profession(p).alias("profession"), birth_place(F.array_join(F.try_element_at(p, F.lit(V.BIRTH_KEY)), " ")).alias("birth_place"), all_values(p).alias("text"))


def answered(questions: DataFrame, nodes: DataFrame, edges: DataFrame, details: DataFrame) -> DataFrame:
    """Q2: (question_id, type, answer): each question goes one way, by type and linked entities.

    Two persons: school, birth place, profession or connection; a person and a university: school; a person alone:
    profession; a university alone: its alumni; options: the letter. The others keep their context for a model.
    """
    # Every way starts from these tables, so they are made once.
    asked = cut(classified(questions).join(L.merged(L.linked_entities(questions, nodes)), "question_id"), "asked")
    kinds = nodes.where(F.col("type").isin("person", "university")).groupBy("title").agg(F.min("type").alias("kind"), F.min("id").alias("id"))
    ends = asked.select("question_id", F.posexplode("entities").alias("pos", "title")).join(L.merged(kinds), "title")
    parts = ends.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "person", F.struct("pos", "title", "id")))).alias("persons"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "university", F.struct("pos", "title", "id")))).alias("unis"),
    )
    rows = asked.join(parts, "question_id", "left").select("question_id", "text", "type", F.coalesce(F.size("persons"), F.lit(0)).alias("np"), F.coalesce(F.size("unis"), F.lit(0)).alias("nu"), "persons", "unis")
    rows = cut(rows.withColumns({"np": F.greatest("np", F.lit(0)), "nu": F.greatest("nu", F.lit(0))}), "questions")
    schools = cut(schools_of(nodes, edges, details), "schools")
    pair = rows.where("np = 2 and nu = 0 and type <> 'multiple_choice'").select("question_id", "type", F.col("persons")[0]["id"].alias("a"), F.col("persons")[1]["id"].alias("b"), F.col("persons")[0]["title"].alias("ta"), F.col("persons")[1]["title"].alias("tb"))

    def told(kind: str, found: DataFrame, by_title: bool = False) -> DataFrame:
        ends = ("ta", "tb") if by_title else ("a", "b")
        mine = pair.where(F.col("type") == kind).select("question_id", "type", F.col(ends[0]).alias("a"), F.col(ends[1]).alias("b"))
        return mine.join(found.select("a", "b", "answer"), ["a", "b"]).select("question_id", "type", "answer")

    def ids(*types: str, by_title: bool = False) -> DataFrame:
        a, b = ("ta", "tb") if by_title else ("a", "b")
        return pair.where(F.col("type").isin(*types)).select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()

    one = rows.where("np = 1 and nu = 1 and type <> 'multiple_choice'").select("question_id", "type", F.col("persons")[0]["title"].alias("person"), F.col("unis")[0]["title"].alias("university"))
    single = rows.where("np = 1 and nu = 0 and type = 'property_query'").select("question_id", "type", F.col("persons")[0]["title"].alias("title"))
    uni = L.typed_node(rows.where("np = 0 and type = 'university'").select("question_id", "text"), nodes, "university").where("title is not null").select("question_id", F.col("title").alias("university"))
    listing = alumni_listing(uni, nodes, edges)
    way = connection(ids("connection", "yes_no"), edges)
    branches = [
        told("university", same_school(ids("university"), edges)),
        told("birth_place", same_birth_place(ids("birth_place"), edges)),
        told("profession", same_profession(ids("profession", by_title=True), details), by_title=True),
        told("connection", way),
        told("yes_no", way),
        one.join(person_school(one.select("person", "university").distinct(), schools), ["person", "university"]).select("question_id", "type", "answer"),
        single.join(details, "title").select("question_id", "type", profession(F.col("properties")).alias("answer")),
        listing.select("question_id", F.lit("university").alias("type"), F.array_join("people", ", ").alias("answer")),
        multiple_choice(rows.where("type = 'multiple_choice'").select("question_id", "text"), schools, nodes).select("question_id", F.lit("multiple_choice").alias("type"), F.col("letter").alias("answer")),
    ]
    # One way after the other: all at once, their plans and broadcasts would meet in the driver.
    found = reduce(DataFrame.unionByName, [cut(rows, "answers") for rows in branches]).groupBy("question_id").agg(F.max("answer").alias("answer"))
    return asked.select("question_id", "type").join(found, "question_id", "left")


def judged(answers: DataFrame, strict: bool = False) -> DataFrame:
    """Q17: (.., correct) of rows (type, gold, pred); strict compares the first word alone."""
    gold, pred = F.lower("gold"), F.lower("pred")
    if strict:
        return answers.withColumn("correct", F.split(gold, r"[\s,.]+")[0] == F.split(pred, r"[\s,.]+")[0])
    yes = F.contains(gold, F.lit("có")) | F.contains(gold, F.lit("yes"))
    no = F.contains(gold, F.lit("không")) | F.contains(gold, F.lit("no"))
    says_yes = F.contains(pred, F.lit("có")) | F.contains(pred, F.lit("yes")) | F.contains(pred, F.lit("kết nối"))
    says_no = F.contains(pred, F.lit("không")) | F.contains(pred, F.lit("no"))
    return answers.withColumn("correct", F.when(yes, says_yes).when(no, says_no).otherwise(F.contains(pred, gold)))


def sampled_pairs(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(k, a, b): n pairs of different persons: the first 2 n in a seeded order, one beside the other."""
    persons = sample(nodes.where("type = 'person'").select("id", "title"), "id", 2 * n, seed).select("id", "title", seeded_order(F.col("id"), seed).alias("h"))
    placed = persons.withColumn("p", F.row_number().over(Window.orderBy("h", "id")) - 1)
    left, right = placed.where("p % 2 = 0"), placed.where("p % 2 = 1")
    return left.select(F.floor(F.col("p") / 2).alias("k"), F.col("id").alias("a"), F.col("title").alias("ta")).join(right.select(F.floor(F.col("p") / 2).alias("k"), F.col("id").alias("b"), F.col("title").alias("tb")), "k")


def generated_questions(nodes: DataFrame, edges: DataFrame, n: int = 700, n_choices: int = 600, seed: int = 42, max_hops: int = 6) -> DataFrame:
    """Q15, Q16: (question_id, type, category, question, answer, choices): sampled, self-labelled by the graph."""
    pairs = sampled_pairs(nodes, n, seed)
    reached = G.hops(edges, pairs.select("a", "b"), max_hops)
    none = F.lit(None).cast("map<string,string>")
    linked = pairs.join(reached, ["a", "b"]).select(
        (F.col("k") + 1).alias("question_id"), F.lit("yes_no").alias("type"), F.format_string("%d_hop", F.col("hops")).alias("category"),
        F.format_string("Có kết nối nào giữa %s và %s trong mạng alumni không?", "ta", "tb").alias("question"), F.when(F.col("connected"), YES).otherwise(NO).alias("answer"), none.alias("choices"),
    )
    other = sampled_pairs(nodes, n, seed + 1)
    school = other.join(L.same_university(edges, other.select("a", "b")), ["a", "b"]).select(
        (F.col("k") + 1 + n).alias("question_id"), F.lit("yes_no").alias("type"), F.lit("university").alias("category"),
        F.format_string("%s và %s có học cùng trường đại học không?", "ta", "tb").alias("question"), F.when(F.col("same"), YES).otherwise(NO).alias("answer"), none.alias("choices"),
    )
    alumni = edges.where("type = 'alumni_of'").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("u"), F.collect_set("dst").alias("own"))
    persons = sample(nodes.where("type = 'person'").select("id", "title").join(alumni, "id"), "id", n_choices, seed + 2)
    wrong = sample(nodes.where("type = 'university'").select("id", "title"), "id", 8, seed).agg(F.sort_array(F.collect_list(F.struct("title", "id"))).alias("pool"))
    rows = persons.join(F.broadcast(wrong), F.lit(True)).join(nodes.select(F.col("id").alias("u"), F.col("title").alias("right")), "u")
    options = F.slice(F.filter("pool", lambda x: ~F.array_contains("own", x["id"])), 1, 3)
    placed = rows.withColumn("wrong", F.transform(options, lambda x: x["title"])).where(F.size("wrong") == 3)
    # The right option stands where a hash says.
    at = F.pmod(F.crc32(F.concat("id", F.lit(f"/{seed}"))), F.lit(4)).cast("int")
    shown = F.concat(F.slice("wrong", F.lit(1), F.col("at")), F.array("right"), F.slice("wrong", F.col("at") + 1, 3 - F.col("at")))
    placed = placed.withColumn("at", at).withColumn("shown", shown)
    letters = F.array(*(F.lit(x) for x in "ABCD"))
    order = F.row_number().over(Window.orderBy("id"))
    chosen = placed.select(
        (order + 2 * n).cast("long").alias("question_id"), F.lit("mcq").alias("type"), F.lit("university_mcq").alias("category"),
        F.format_string("%s đã học tại trường nào?", "title").alias("question"), F.element_at(letters, F.col("at") + 1).alias("answer"), F.map_from_arrays(letters, "shown").alias("choices"),
    )
    return linked.unionByName(school).unionByName(chosen)


def question_counts(questions: DataFrame) -> DataFrame:
    """Questions by type and category, with subtotals by type and in all (null)."""
    return questions.rollup("type", "category").agg(F.count(F.lit(1)).alias("n"))
