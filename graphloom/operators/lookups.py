"""Neighbours, constrained lookups and entity linking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V
from graphloom.functions.text import compact, fold, normalize_title
from graphloom.operators.aggregates import top_per_group


def neighbours(edges: DataFrame, nodes: DataFrame, relation: str | None = None) -> DataFrame:
    """(id, neighbour, type, direction) of each of some nodes, outgoing and incoming; a mutual pair gives two rows."""
    rows = edges.where(F.col("type") == relation) if relation else edges
    both = rows.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "type", F.lit("out").alias("direction")).unionByName(
        rows.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "type", F.lit("in").alias("direction"))
    )
    return both.join(merged(nodes.select("id").distinct()), "id", "left_semi")


def node_search(nodes: DataFrame, word: str, type_: str | None = None, k: int = 10) -> DataFrame:
    """Titles that hold a word, in either case."""
    rows = nodes.where(F.contains(F.lower("title"), F.lower(F.lit(word))))
    return (rows.where(F.col("type") == type_) if type_ else rows).orderBy("title", "id").limit(k)


def common_neighbours(edges: DataFrame, pairs: DataFrame, k: int | None = None) -> DataFrame:
    """(a, b, neighbour, relations_a, relations_b) for pairs (a, b), at most k neighbours of each."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    near = neighbours(edges, ids).groupBy("id", "neighbour").agg(F.sort_array(F.collect_set("type")).alias("relations"))
    of_a = near.select(F.col("id").alias("a"), "neighbour", F.col("relations").alias("relations_a"))
    of_b = near.select(F.col("id").alias("b"), "neighbour", F.col("relations").alias("relations_b"))
    found = pairs.select("a", "b").join(of_a, "a").join(of_b, ["b", "neighbour"]).where("neighbour <> a and neighbour <> b").select("a", "b", "neighbour", "relations_a", "relations_b")
    return found if k is None else top_per_group(found, ["a", "b"], [F.asc("neighbour")], k).drop("place")


def linked_to(edges: DataFrame, relations: tuple[str, ...], target: Column) -> DataFrame:
    """Nodes with one of some relations to a target, in either direction."""
    rows = edges.where(F.col("type").isin(*relations))
    return rows.where(F.col("dst") == target).select(F.col("src").alias("id")).unionByName(rows.where(F.col("src") == target).select(F.col("dst").alias("id"))).distinct()


def people_of_university(edges: DataFrame, university: str, k: int = 100) -> DataFrame:
    """J15."""
    return linked_to(edges, ("alumni_of",), F.lit(university)).orderBy("id").limit(k)


def people_of_country(edges: DataFrame, country: str, k: int = 100) -> DataFrame:
    """J16, once the country's node is resolved."""
    return linked_to(edges, ("born_in", "from_country"), F.lit(country)).orderBy("id").limit(k)


def people_of_country_and_university(edges: DataFrame, country: str, university: str, k: int = 50) -> DataFrame:
    """J14."""
    of_country = linked_to(edges, ("born_in", "from_country"), F.lit(country))
    return of_country.join(linked_to(edges, ("alumni_of",), F.lit(university)), "id", "left_semi").orderBy("id").limit(k)


def same_university(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, universities, same)."""
    alumni = edges.where(F.col("type") == "alumni_of").select("src", "dst").distinct()
    met = pairs.join(alumni.select(F.col("src").alias("a"), "dst"), "a").join(alumni.select(F.col("src").alias("b"), "dst"), ["b", "dst"])
    found = met.groupBy("a", "b").agg(F.sort_array(F.collect_set("dst")).alias("universities"))
    none = F.array().cast("array<string>")
    return pairs.select("a", "b").distinct().join(found, ["a", "b"], "left").select("a", "b", F.coalesce("universities", none).alias("universities"), F.col("universities").isNotNull().alias("same"))


def property_matches(details: DataFrame, aliases: list[str], university: str) -> DataFrame:
    """Titles whose properties' text names one of the aliases and the university."""
    text = fold(F.array_join(F.flatten(F.map_values("properties")), " "))
    named = F.lit(False)
    for a in aliases:
        named = named | F.contains(text, fold(F.lit(a)))
    return details.where(named & F.contains(text, fold(F.lit(university)))).select("title")


def resolved_country(nodes: DataFrame, name: str) -> DataFrame:
    """The node of a country by title in either case, then by compact fold of title or id."""
    rows = nodes.where(F.col("type") == "country")
    tier = (
        F.when(F.lower("title") == name.lower(), 0)
        .when(compact(F.col("title"), True) == compact(F.lit(name), True), 1)
        .when(F.col("id") == name, 2)
        .when(compact(F.col("id"), True) == compact(F.lit(name), True), 3)
    )
    return rows.withColumn("tier", tier).where("tier is not null").orderBy("tier", "id").limit(1).drop("tier")


#: The longest substrings that lead from a text to what it may hold, in characters; shorter ones are halves of it.
GRAM = 64


def _grams(text: Column, k: int) -> Column:
    """Hashes of the distinct substrings of k characters."""
    n = F.length(text)
    every = F.transform(F.sequence(F.lit(1), n - k + 1), lambda j: F.xxhash64(F.substr(text, j, F.lit(k))))
    return F.array_distinct(F.when(n >= k, every).otherwise(F.array().cast("array<bigint>")))


def merged(df: DataFrame) -> DataFrame:
    """df for a join on equal keys that never broadcasts it: it grows with the input, and the driver would hold it."""
    return df.hint("merge")


def _keyed(parts: DataFrame, part: str, keys: Column) -> DataFrame:
    """(part, key): of each part's keys the one that fewest parts have, the smallest on ties."""
    every = parts.select(part).distinct().select(F.col(part).alias("_part"), F.explode(keys).alias("key"))
    common = every.groupBy("key").agg(F.count(F.lit(1)).alias("_parts"))
    rarest = every.join(merged(common), "key").groupBy("_part").agg(F.min_by("key", F.struct("_parts", "key")).alias("key"))
    return rarest.select(F.col("_part").alias(part), "key")


def held(texts: DataFrame, text: str, parts: DataFrame, part: str) -> DataFrame:
    """(text, part), distinct: which texts hold which of the parts, empty ones aside; columns of other names go.

    A part is looked up by the rarest of its longest substrings of 1, 2, 4 .. GRAM characters, a text by all of its
    substrings as long as some part's: a join on equal keys, of hashes alone. The whole part is compared then.
    """
    # Keys are as long as parts allow: short ones are shared by all parts of few letters, such as numbers.
    n = F.length(part)
    sized = parts.where(n > 0).select(part, F.least(F.lit(GRAM), F.pow(F.lit(2), F.floor(F.log2(n + 0.5)))).cast("int").alias("_k"))
    sizes = sorted(r["_k"] for r in sized.select("_k").distinct().collect())
    if not sizes:
        return texts.select(text).crossJoin(parts.select(part)).limit(0)
    keys = reduce(lambda other, k: F.when(F.length(part) >= k, _grams(F.col(part), k)).otherwise(other), sizes, F.array().cast("array<bigint>"))
    keyed = _keyed(sized, part, keys)
    every = texts.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_text", F.xxhash64(text))
    grams = every.select("_text", F.explode(F.concat(*(_grams(F.col(text), k) for k in sizes))).alias("key"))
    led = grams.join(merged(keyed), "key").select("_text", part).distinct()
    return every.join(merged(led), "_text").where(F.contains(text, part)).select(text, part).distinct()


def resolved_titles(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """T4: (name, title): the equal title, else one equal when normalised, else the shortest that holds the name."""
    asked = names.select("name", normalize_title(F.col("name")).alias("n")).distinct()
    titles = nodes.select("title", normalize_title(F.col("title")).alias("t"))
    tier = F.when(F.col("title") == F.col("name"), 0).when(F.col("t") == F.col("n"), 1).otherwise(2)
    met = held(titles, "t", asked, "n").join(titles, "t").join(asked, "n")
    best = met.groupBy("name").agg(F.min_by("title", F.struct(tier, F.when(tier == 2, F.length("title")).otherwise(0), "title")).alias("title"))
    return names.select("name").distinct().join(best, "name", "left")


def linked_entities(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question_id, entities): titles of persons and universities whose fold the question holds, longest first."""
    titles = nodes.where(F.col("type").isin("person", "university") & ~normalize_title(F.col("title")).isin(*V.NO_ENTITIES))
    titles = titles.select("title", fold(F.col("title")).alias("f")).where("f <> ''").distinct()
    asked = questions.select("question_id", F.concat(F.lit(" "), fold(F.col("text")), F.lit(" ")).alias("q"))
    met = held(asked, "q", titles, "f").join(merged(titles), "f").join(merged(asked), "q")
    longest = F.array_sort(F.collect_set(F.struct((-F.length("title")).alias("l"), "title")))
    found = met.groupBy("question_id").agg(F.transform(longest, lambda e: e["title"]).alias("entities"))
    return questions.select("question_id").join(merged(found), "question_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast("array<string>")))


def _significant(folded: Column, generic: tuple[str, ...]) -> Column:
    return F.filter(F.split(folded, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*generic))


def typed_node(questions: DataFrame, nodes: DataFrame, type_: str, generic: tuple[str, ...] = ("dai", "hoc", "truong", "vien", "university", "college", "country")) -> DataFrame:
    """(question_id, title): the longest title of a type whose significant words the question holds, or an alias's."""
    titles = nodes.where(F.col("type") == type_).select("title", fold(F.col("title")).alias("f")).where("f <> ''").distinct()
    titles = titles.withColumn("w", _significant(F.col("f"), generic))
    asked = questions.select("question_id", fold(F.col("text")).alias("q"), F.split(fold(F.col("text")), " ").alias("qw"))
    # By words: a title is looked up by its rarest word.
    worded = titles.where(F.size("w") > 0).select("f", "w").distinct()
    led = _keyed(worded, "f", _significant(F.col("f"), generic)).join(merged(worded), "f")
    by_word = asked.select("q", "qw").distinct().select("q", "qw", F.explode(F.array_distinct("qw")).alias("key")).join(merged(led), "key")
    by_word = by_word.where(F.size(F.array_except("w", "qw")) == 0).select("q", "f")
    met = by_word.unionByName(held(asked, "q", titles, "f")).distinct()
    best = met.join(merged(titles.select("f", "title")), "f").join(merged(asked.select("q", "question_id")), "q").groupBy("question_id").agg(F.max_by("title", F.struct(F.length("f"), "title")).alias("title"))
    aliases = V.UNIVERSITY_ALIASES if type_ == "university" else V.COUNTRY_ALIASES if type_ == "country" else {}
    alias = F.lit(None).cast("string")
    for word, title in reversed(aliases.items()):
        alias = F.when(F.array_contains("qw", F.lit(word)) if " " not in word else F.contains("q", F.lit(word)), F.lit(title)).otherwise(alias)
    return asked.join(merged(best), "question_id", "left").select("question_id", F.coalesce("title", alias).alias("title"))


def retrieved_context(questions: DataFrame, nodes: DataFrame, edges: DataFrame, entities: int = 5, near: int = 5) -> DataFrame:
    """(question_id, title, id, neighbours): linked entities with their first neighbours."""
    linked = linked_entities(questions, nodes).select("question_id", F.posexplode(F.slice("entities", 1, entities)).alias("pos", "title"))
    found = linked.join(merged(nodes.select("id", "title")), "title")
    first = top_per_group(neighbours(edges, found), ["id"], [F.asc("direction"), F.asc("neighbour"), F.asc("type")], near)
    lists = first.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "neighbour", "type"))).alias("neighbours"))
    return found.join(merged(lists), "id", "left").select("question_id", "pos", "title", "id", "neighbours")


def last_turns(turns: DataFrame, k: int = 5) -> DataFrame:
    """The last k turns of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("place", place).where(F.col("place") <= k)


def ego_network(edges: DataFrame, nodes: DataFrame, word: str) -> DataFrame:
    """The neighbours of the first node whose title holds a word, with their titles and the relation."""
    near = neighbours(edges, node_search(nodes, word, k=1))
    return near.join(nodes.select(F.col("id").alias("neighbour"), "title"), "neighbour").select("id", "neighbour", "title", "type", "direction")


def people_of_career(edges: DataFrame, career: str, k: int = 100) -> DataFrame:
    """B8."""
    return linked_to(edges, ("has_career",), F.lit(career)).orderBy("id").limit(k)
