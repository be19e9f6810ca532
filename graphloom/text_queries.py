"""Queries of text functions, predicates, gazetteers and enrichment, over titles and details made of the driver's tables.

Each customer gets a title, a text and details by rules that both Spark and the SQL read; the SQL spells out what the
functions do. Word boundaries are written as classes there, as its regular expressions know ASCII boundaries alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as U
from graphloom.functions import vocabulary as V
from graphloom.plans import enrich, qa, views
from graphloom.queries import _VN, _WORD, _hits_sql, query
from graphloom.sources import html, readers
from graphloom.storage import cut

#: Read alike by Spark and by the SQL.
_TITLE = """CASE c_custkey % 19
    WHEN 0 THEN 'Đại học ' || n_name WHEN 1 THEN n_name || ' University' WHEN 2 THEN '  Trường   ' || n_name || '  '
    WHEN 3 THEN 'Danh sách ' || n_name WHEN 4 THEN '12 tháng 3' WHEN 5 THEN CAST(1900 + c_custkey % 200 AS STRING)
    WHEN 6 THEN 'Harvard ' || n_name || ' (trang không tồn tại)' WHEN 7 THEN 'File:' || c_name WHEN 8 THEN NULL WHEN 9 THEN ''
    WHEN 10 THEN c_name || ' MIT' WHEN 11 THEN 'country_' || replace(n_name, ' ', '_') WHEN 12 THEN 'Nguyễn Đức ' || c_name
    WHEN 13 THEN 'Bachelor of Arts' WHEN 14 THEN 'PhD ' || n_name || ' College, sinh năm 19' || CAST(10 + c_custkey % 90 AS STRING)
    WHEN 15 THEN 'École ' || n_name || '; Viện ' || n_name || ' • x, University' WHEN 16 THEN 'Sinh 1 tháng 1, 1950 (70 tuổi) ' || n_name
    WHEN 17 THEN '/wiki/' || n_name ELSE '/wiki/File:' || n_name || '#top' END"""
_TITLES = f"titles AS (SELECT c_custkey AS k, {_TITLE} AS t FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_EDGE = rf"(?:^|[^{_WORD}])", rf"(?:$|[^{_WORD}])"


def _titles(spark, sf) -> DataFrame:
    people, nations = views.table(spark, sf, "customer"), views.table(spark, sf, "nation")
    return people.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("k"), F.expr(_TITLE).alias("t"))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _any(test: str, words) -> str:
    return "(" + " OR ".join(test.format(w=w.replace("'", "''")) for w in words) + ")"


def _keyword(x: str) -> str:
    return _any(f"contains(lower(coalesce({x}, '')), '{{w}}')", V.UNIVERSITY_KEYWORDS)


def _strict(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    tests = (_any(f"starts_with({s}, '{{w}}')", V.UNIVERSITY_PREFIXES), _any(f"ends_with({s}, '{{w}}')", V.UNIVERSITY_SUFFIXES))
    words = f"regexp_matches({s}, '(?i){_EDGE[0]}(?:{'|'.join(V.UNIVERSITY_WORDS)}){_EDGE[1]}')"
    return f"({s} <> '' AND {s} NOT IN ({_quoted(V.DEGREES)}) AND ({tests[0]} OR {tests[1]} OR {words} OR contains({s}, 'Đại học')))"


def _collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


_LATIN = {k: v for k, v in V.LATIN.items() if k == k.lower()}


def _fold_strict(x: str) -> str:
    bare = rf"regexp_replace(translate(lower({x}), '{''.join(_LATIN)}', '{''.join(_LATIN.values())}'), '\p{{Mn}}+', '', 'g')"
    return f"trim(regexp_replace({bare}, '[^a-z0-9]+', ' ', 'g'))"


def _fold(x: str) -> str:
    return _fold_strict(f"translate(lower({x}), 'đ', 'd')")


@query(rf"""WITH {_TITLES}, s AS (SELECT k, t, coalesce(t, '') AS s FROM titles)
SELECT k, {_keyword("t")} AS keyword, {_strict("t")} AS strict,
    s = '' OR contains(s, ':') OR regexp_matches(s, '^(?i)(?:{"|".join(V.NAMESPACES)}){_EDGE[1]}') AS system,
    s = '' OR regexp_matches(s, '^\d{{4}}$') OR regexp_matches(s, '^(?i)\d{{1,2}}\s+tháng\s+\d{{1,2}}$') AS date,
    starts_with(s, '/wiki/') AND NOT regexp_matches(s, '[:#]') AS article,
    CASE WHEN k % 5 = 0 THEN 'person' WHEN {_keyword("t")} OR k % 7 = 0 THEN 'university' ELSE 'person' END AS root_type,
    CASE k % 3 WHEN 0 THEN 'country' ELSE CASE WHEN {_keyword("t")} THEN 'university' ELSE 'person' END END AS node_type,
    CASE WHEN k % 11 = 0 THEN 'university' WHEN starts_with(s, 'career_') THEN 'career' WHEN starts_with(s, 'country_') THEN 'country' ELSE CASE k % 3 WHEN 0 THEN 'Country' ELSE 'person' END END AS corrected
FROM s""")
def title_predicates(spark, sf):
    """P3, P5 to P11."""
    t, k = F.col("t"), F.col("k")
    given = F.when(k % 3 == 0, "Country").when(k % 3 == 1, "")
    return _titles(spark, sf).select(
        "k", T.is_university_keyword(t).alias("keyword"), T.is_university_title(t).alias("strict"), T.is_system_title(t).alias("system"), T.is_date_title(t).alias("date"),
        T.is_article_href(t).alias("article"), T.root_type(k % 5 == 0, t, k % 7 == 0).alias("root_type"), T.node_type(given, t).alias("node_type"),
        T.corrected_type(F.coalesce(t, F.lit("")), t, given, k % 11 == 0).alias("corrected"),
    )


_CANONICAL = " ".join(f"WHEN regexp_matches(t, '(?i){_EDGE[0]}(?:{'|'.join(words)}){_EDGE[1]}') THEN '{name}'" for words, name in V.CANONICAL_UNIVERSITIES)
_GENERIC = ("dai", "hoc", "truong", "vien", "university", "college", "school", "of", "the")


@query(rf"""WITH {_TITLES} SELECT k, nullif({_collapse("t")}, '') AS u1, lower({_collapse("coalesce(t, '')")}) AS u2,
    regexp_replace({_collapse("lower(t)")}, '[^{_WORD}\s\-.]', '', 'g') AS u5, {_fold_strict("t")} AS u6, {_fold("t")} AS u6b,
    regexp_replace(replace({_fold("t")}, ' ', ''), '^country', '') AS u6c,
    CAST(nullif(regexp_extract(t, '{_EDGE[0]}((?:19|20)[0-9]{{2}}){_EDGE[1]}', 1), '') AS INTEGER) AS u7, CASE {_CANONICAL} ELSE trim(t) END AS u8,
    trim(regexp_replace(coalesce(t, ''), '(?i)\s*\(trang không tồn tại\)\s*$', '')) AS u9,
    array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[;•|,]'), lambda x: {_collapse("x")}), lambda x: x <> '' AND {_strict("x")}), '|') AS u13,
    array_to_string(list_filter(list_transform(regexp_split_to_array(t, '[;,]'), lambda x: {_collapse("x")}), lambda x: x <> ''), '|') AS u14,
    CASE WHEN length(t) > 10 THEN substr(t, 1, 10) || '...' ELSE t END AS u16, replace(regexp_replace(t, '^country_', ''), '_', ' ') AS u17,
    coalesce(nullif(trim(regexp_extract(t, '\(\d+\s*tuổi\)\s*(.+)$', 1)), ''), nullif(trim(regexp_extract(t, '\d{{4}}\)?\s*(.+)$', 1)), '')) AS u20,
    array_to_string(list_sort(list_distinct(list_filter(string_split({_fold(r"regexp_replace(t, '\([^)]*\)', ' ', 'g')")}, ' '), lambda x: length(x) > 2 AND x NOT IN ({_quoted(_GENERIC)})))), '|') AS u23
FROM titles""")
def title_texts(spark, sf):
    """U1 to U9, U13, U14, U16, U17, U20, U23, P16."""
    t = F.col("t")

    def said(c: Column) -> Column:
        return F.array_join(c, "|")

    return _titles(spark, sf).select(
        "k", T.normalize(t).alias("u1"), T.normalize_title(t).alias("u2"), T.strip_foreign(t).alias("u5"), T.fold_strict(t).alias("u6"), T.fold(t).alias("u6b"), T.compact(t, True).alias("u6c"),
        T.year_in(t).alias("u7"), T.canonical_university(t).alias("u8"), T.clean_title(t).alias("u9"), said(T.university_chunks(t)).alias("u13"), said(T.split_list(t)).alias("u14"),
        T.ellipsis(t, 10).alias("u16"), T.country_label(t).alias("u17"), T.birth_place(t).alias("u20"), said(F.array_sort(T.school_tokens(t))).alias("u23"),
    )


@query(f"""WITH {_TITLES} SELECT nullif({_collapse("t")}, '') AS k0, count(*) AS n FROM titles GROUP BY 1""")
def title_keys(spark, sf):
    """Rows by their normalised key."""
    keyed = _titles(spark, sf).groupBy(T.normalized_key(F.col("t")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.select("key.k0", "n")


_ANSWER = """CASE turn % 6 WHEN 0 THEN 'note ANSWER:  "' || text || '"' WHEN 1 THEN text || chr(10) || chr(10) || 'context: y' || chr(10) || 'z' WHEN 2 THEN text || chr(10) || '[LOG] y' || chr(10) || 'z'
    WHEN 3 THEN text || chr(10) || 'THÔNG TIN về A: b' || chr(10) || 'c' WHEN 4 THEN text || chr(10) || '=== A có liên kết B' || chr(10) || 'c' ELSE ' "" ' || text END"""


@query(rf"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS t FROM conversations), b AS (SELECT conv_id, turn, CASE WHEN contains(t, 'ANSWER:') THEN trim(split_part(t, 'ANSWER:', -1)) ELSE t END AS t FROM a),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?is)\n+CONTEXT:.*', '', 'g'), '(?is)\n+\[LOG\].*', '', 'g') AS t FROM b),
d AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?i)\n+THÔNG TIN.*:', '', 'g'), '(?i)\n+=+.*có liên kết.*', '', 'g') AS t FROM c)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g'), '^\s+|\s+$', '', 'g')) AS answer FROM d""")
def cleaned_answers(spark, sf):
    """U22."""
    return views.table(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.clean_answer(F.expr(_ANSWER))).alias("answer"))


@query("""SELECT p_partkey, 'A=' || p_name || '|B=' || p_brand || '|C=' || p_type || '|D=' || p_size AS options, p_name || ' --[cạnh: x, y]--> ' || p_brand || ' --[cạnh: connected]--> ' || p_type AS path,
p_name || ' (part): in ' || p_size || ', out 2' AS node, p_name || ' ' || p_type AS joined FROM part""")
def option_and_path_texts(spark, sf):
    """U15, U18, U19, U21."""
    asked = F.format_string("Ai?  A. %s B. %s  C. %s\nD.  %s", "p_name", "p_brand", "p_type", "p_size")
    steps = F.array(F.array(F.lit("y"), F.lit("x"), F.lit("y")), F.array().cast("array<string>"))
    return views.table(spark, sf, "part").select(
        "p_partkey", F.array_join(F.transform(T.choices(asked), lambda c: F.concat_ws("=", c["letter"], c["text"])), "|").alias("options"), T.path_text(F.array("p_name", "p_brand", "p_type"), steps).alias("path"),
        T.node_text(F.col("p_name"), F.lit("part"), F.col("p_size"), F.lit(2)).alias("node"), T.joined(F.array(F.col("p_name"), F.lit(""), F.col("p_type"))).alias("joined"),
    )


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_returnflag || l_linestatus ORDER BY l_linenumber, l_returnflag || l_linestatus) AS a, list(l_returnflag ORDER BY l_linenumber) AS b FROM lineitem GROUP BY 1)
SELECT k, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS u30, array_to_string(a[1:2], ',') AS u31,
    array_to_string(list_sort(list_intersect(list_transform(a, lambda x: x[1]), list_transform(b, lambda x: CASE x WHEN 'R' THEN 'A' ELSE x END))), ',') AS u32 FROM l""")
def list_values(spark, sf):
    """U30 to U32."""
    rows = views.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("a"), F.col("l_returnflag").alias("b")))).alias("l"))
    a, b = F.transform("l", lambda x: x["a"]), F.transform("l", lambda x: F.when(x["b"] == "R", "A").otherwise(x["b"]))
    common = U.common(F.transform(a, lambda x: F.substring(x, 1, 1)), b)
    return rows.select("k", F.array_join(U.distinct_in_order(a), ",").alias("u30"), F.array_join(U.first_n(a, 2), ",").alias("u31"), F.array_join(F.array_sort(common), ",").alias("u32"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN n_name ELSE c_mktsegment END AS first, CASE c_custkey % 3 WHEN 0 THEN 'Quốc gia' ELSE '' END AS likes,
contains(lower(c_mktsegment), 'machin') OR contains(lower(CASE c_custkey % 3 WHEN 0 THEN n_name ELSE '' END), 'machin') AS holds,
CASE c_custkey % 3 WHEN 0 THEN n_name || ' x ' ELSE '' END || c_mktsegment AS said FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def map_values(spark, sf):
    """U33 to U35, P17."""
    rows = views.table(spark, sf, "customer").join(F.broadcast(views.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    m = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("Quốc gia"), F.array("n_name", F.lit("x")), F.lit("Nghề"), F.array("c_mktsegment"))).otherwise(F.create_map(F.lit("Nghề"), F.array("c_mktsegment")))
    likes = F.array_join(F.transform(U.entries_like(m, F.lit("QUỐC")), lambda e: e["key"]), ",")
    return rows.select(F.col("c_custkey").alias("k"), U.first_of(m, ("Quốc gia", "Nghề"))[0].alias("first"), likes.alias("likes"), U.holds_keyword(m, ("machin",)).alias("holds"), U.all_values(m).alias("said"))


# Gazetteers and enrichment

_CAREERS = tuple(V.career_categories())
_NATIONS = tuple(V.country_codes())
_PLACES = tuple(name for _, places in V.place_tiers() for name, _ in places)


def _pick(words: tuple[str, ...], at: str) -> str:
    return f"([{_quoted(words)}])[({at}) % {len(words)} + 1]"


def _picked(words: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(w) for w in words)), (at % len(words) + 1).cast("int"))


def _found(x: str, kind: str, name: str) -> str:
    word = enrich._folded(name)
    if kind == "anywhere":
        return f"contains({x}, '{word}')"
    return f"regexp_matches({x}, '{_EDGE[0]}{word}{_EDGE[1] if kind == 'words' or len(name) == 1 else ''}')"


def _folded(x: str) -> str:
    return f"translate(lower({x}), '{_VN[0]}', '{_VN[1]}')"


def _country_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {_found(x, kind, name)} THEN '{country}'" for kind, places in V.place_tiers() for name, country in places) + " END"


def _countries_sql(x: str) -> str:
    tests = ", ".join(f"CASE WHEN {_found(x, 'words', n)} THEN '{n}' END" for n in _NATIONS if len(n) > 1)
    return f"list_sort(list_filter([{tests}], lambda c: c IS NOT NULL))"


def _careers_sql(x: str) -> str:
    names = ", ".join(f"'{enrich._folded(c)}': '{c}'" for c in _CAREERS)
    return f"list_sort(list_distinct(list_transform({_hits_sql(tuple(map(enrich._folded, _CAREERS)), x)}, lambda h: (MAP {{{names}}})[h])))"


def _case_map(x: str, table: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


@query(rf"""WITH x AS (SELECT c_custkey AS k, 'Ông sinh tại ' || {_pick(_PLACES, "c_custkey")} || ', làm ' || {_pick(_CAREERS, "c_custkey * 7")} || ' và ' || {_pick(_CAREERS, "c_custkey * 11 + 3")} AS t, {_pick(_CAREERS + ("?",), "c_custkey")} AS career, {_pick(_NATIONS + ("?",), "c_custkey")} AS nation FROM customer),
f AS (SELECT *, {_folded("t")} AS ft FROM x)
SELECT k, array_to_string({_careers_sql("t")}, '|') AS careers, {_country_sql("ft")} AS country, array_to_string({_countries_sql("ft")}, '|') AS countries, {_case_map("career", V.career_categories(), "Other")} AS category, {_case_map("nation", V.country_codes(), "?")} AS code FROM f""")
def gazetteers(spark, sf):
    """X6 to X10, J20, with the shipped gazetteers."""
    k = F.col("c_custkey")
    t = F.concat(F.lit("Ông sinh tại "), _picked(_PLACES, k), F.lit(", làm "), _picked(_CAREERS, k * 7), F.lit(" và "), _picked(_CAREERS, k * 11 + 3))
    rows = views.table(spark, sf, "customer").select(k.alias("k"), t.alias("t"), _picked((*_CAREERS, "?"), k).alias("career"), _picked((*_NATIONS, "?"), k).alias("nation"))
    return rows.select(
        "k", F.array_join(enrich.careers_in(F.col("t")), "|").alias("careers"), enrich.country_in(F.col("t")).alias("country"), F.array_join(enrich.countries_in(F.col("t")), "|").alias("countries"),
        enrich.career_category(F.col("career")).alias("category"), enrich.country_code(F.col("nation")).alias("code"),
    )


_ROWS = rf"""raw AS (SELECT c_name AS title, {_pick(_CAREERS, "c_custkey * 7")} AS c1, {_pick(_CAREERS, "c_custkey * 11 + 3")} AS c2, '1 tháng 1, 1950 tại ' || {_pick(_PLACES, "c_custkey")} AS birth,
    CASE WHEN c_custkey % 4 = 0 THEN '2000, ' || {_pick(_PLACES, "c_custkey + 5")} END AS death, {_pick(_NATIONS, "c_custkey")} AS nation FROM customer),
said AS (SELECT *, 'Nghề nghiệp | ' || c1 || ' | ' || c2 AS work, {_folded("birth")} AS fb, {_folded("coalesce(death, '')")} AS fd, {_folded("nation || ' | '")} AS fn FROM raw),
rows AS (SELECT title, {_careers_sql("work")} AS careers, {_countries_sql("fn")} AS countries, {_country_sql("fb")} AS birth_country, {_country_sql("fd")} AS death_country FROM said)"""


def _rows(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    birth = F.array(F.concat(F.lit("1 tháng 1, 1950 tại "), _picked(_PLACES, k)))
    fields = [F.lit("Nghề nghiệp"), F.array(_picked(_CAREERS, k * 7), _picked(_CAREERS, k * 11 + 3)), F.lit("Sinh"), birth, F.lit("Quốc tịch"), F.array(_picked(_NATIONS, k))]
    death = F.when(k % 4 == 0, F.create_map(*fields, F.lit("Mat"), F.array(F.concat(F.lit("2000, "), _picked(_PLACES, k + 5))))).otherwise(F.create_map(*fields))
    return cut(enrich.enrichments(views.table(spark, sf, "customer").select(F.col("c_name").alias("title"), death.alias("properties"))), "rows")


@query(f"""WITH {_ROWS} SELECT title, array_to_string(careers, '|') AS careers, array_to_string(countries, '|') AS countries, birth_country, death_country FROM rows""")
def enriched_details(spark, sf):
    """X11."""
    return _rows(spark, sf).select("title", F.array_join("careers", "|").alias("careers"), F.array_join("countries", "|").alias("countries"), "birth_country", "death_country")


_ENRICHED = """SELECT title AS src, 'career_' || unnest(careers) AS dst, 'has_career' AS type FROM rows UNION ALL SELECT title, 'country_' || birth_country, 'born_in' FROM rows WHERE birth_country IS NOT NULL
UNION ALL SELECT title, 'country_' || death_country, 'died_in' FROM rows WHERE death_country IS NOT NULL UNION ALL SELECT title, 'country_' || unnest(countries), 'from_country' FROM rows"""


@query(f"""WITH {_ROWS} SELECT src, dst, type, CAST(1 AS INTEGER) AS weight FROM ({_ENRICHED})""")
def enriched_edges(spark, sf):
    """B2."""
    return enrich.enriched_edges(_rows(spark, sf))


@query(f"""WITH {_ROWS}, work AS (SELECT DISTINCT title, unnest(careers) AS c FROM rows)
SELECT a.title AS src, b.title AS dst, 'same_birth_country' AS type, CAST(1 AS INTEGER) AS weight FROM rows a JOIN rows b ON a.birth_country = b.birth_country AND a.title < b.title
UNION ALL SELECT a.title, b.title, 'same_career', 1 FROM work a JOIN work b ON a.c = b.c AND a.title < b.title""")
def relationship_edges(spark, sf):
    """B3, J5, J6."""
    return enrich.relationship_edges(_rows(spark, sf))


@query(f"""WITH {_ROWS}, c AS (SELECT DISTINCT unnest(careers) AS title FROM rows), n AS (SELECT unnest(countries) AS title FROM rows UNION SELECT birth_country FROM rows UNION SELECT death_country FROM rows)
SELECT title AS id, title, 'person' AS type, 'https://vi.wikipedia.org/wiki/' || replace(title, '#', '%23') AS link, NULL AS category, NULL AS code FROM rows
UNION ALL SELECT 'career_' || title, title, 'career', NULL, {_case_map("title", V.career_categories(), "Other")}, NULL FROM c
UNION ALL SELECT 'country_' || title, title, 'country', NULL, NULL, {_case_map("title", V.country_codes(), "?")} FROM n WHERE title IS NOT NULL
UNION ALL SELECT s_name, s_name, 'university', 'https://vi.wikipedia.org/wiki/' || replace(s_name, '#', '%23'), NULL, NULL FROM supplier""")
def enriched_nodes(spark, sf):
    """B1, A13."""
    rows = _rows(spark, sf)
    return enrich.enriched_nodes(rows.select("title"), views.table(spark, sf, "supplier").select(F.col("s_name").alias("title")), rows)


@query(f"""WITH raw AS (SELECT c_name AS title, {_pick(_CAREERS, "c_custkey * 7")} AS c1, {_pick(_PLACES, "c_custkey")} AS place, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT title, c1 AS profession, place AS birth_place, c1 || ' 1950 (70 tuổi) ' || place || ' University ' || n_name AS text FROM raw""")
def property_lookups(spark, sf):
    """Q11, Q14, U20."""
    return qa.property_lookups(_details(spark, sf)).select("title", "profession", "birth_place", "text")


def _details(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    rows = views.table(spark, sf, "customer").join(F.broadcast(views.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    fields = (F.lit("Nghề nghiệp"), F.array(_picked(_CAREERS, k * 7)), F.lit("Sinh"), F.array(F.concat(F.lit("1950 (70 tuổi) "), _picked(_PLACES, k))), F.lit("Alma mater"), F.array(F.concat(F.lit("University "), "n_name")))
    return rows.select(F.col("c_name").alias("title"), k.alias("k"), F.create_map(*fields).alias("properties"))


# Pages with an information box, one for each customer

_BOX = """SELECT c_custkey AS page_id, c_custkey AS k, c_name, c_mktsegment, n_name, '<html><body><table class="infobox"><tr><th>' || CASE c_custkey % 3 WHEN 0 THEN 'Thành lập' ELSE 'Sinh' END || '</th><td>1950<br>' || n_name || '</td></tr>'
    || '<tr><th>' || CASE c_custkey % 3 WHEN 0 THEN 'Trụ sở' ELSE 'Alma mater' END || '</th><td><a href="/wiki/U' || c_custkey % 7 || '" title="Đại học ' || n_name || '">x</a> <a href="/wiki/MIT">MIT ' || c_mktsegment || ' College</a> (' || (1950 + c_custkey % 60) || ')</td></tr></table>'
    || '<div id="mw-content-text"><p><a href="/wiki/A" title="' || c_name || '">a</a><a href="/wiki/A" title="' || c_name || '">b</a><a href="/wiki/File:x">f</a><a href="/wiki/B#c">g</a><a href="/wiki/C">' || c_mktsegment || '</a></p></div></body></html>' AS html
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _boxes(spark, sf) -> DataFrame:
    for name in ("customer", "nation"):
        views.table(spark, sf, name).createOrReplaceTempView(f"_box_{name}")
    return html.parsed_pages(spark.sql(_BOX.replace("FROM customer JOIN nation", "FROM _box_customer customer JOIN _box_nation nation")))


@query("""SELECT c_custkey AS page_id, CAST(0 AS INTEGER) AS pos, c_name AS title FROM customer UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer""")
def page_titles(spark, sf):
    """Article links of the content, each title once."""
    return html.page_links(_boxes(spark, sf), "page_id")


@query("""SELECT c_custkey AS page_id, c_custkey % 3 > 0 AS p1, c_custkey % 3 > 0 AS p2, c_custkey % 3 = 0 AS p4 FROM customer""")
def page_kinds(spark, sf):
    """P1, P2, P4."""
    p = F.col("page")
    return _boxes(spark, sf).select("page_id", html.is_person_page(p).alias("p1"), html.is_person_by_keys(p).alias("p2"), html.is_university_page(p).alias("p4"))


@query("""SELECT c_custkey AS page_id, CASE c_custkey % 3 WHEN 0 THEN 'Thành lập' ELSE 'Sinh' END || '=1950;' || n_name || '|' || CASE c_custkey % 3 WHEN 0 THEN 'Trụ sở' ELSE 'Alma mater' END
|| '=x MIT ' || c_mktsegment || ' College (' || (1950 + c_custkey % 60) || ')' AS box FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def infobox_maps(spark, sf):
    """X5, U12."""
    entries = F.transform(F.map_entries(html.infobox_map(F.col("page"))), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ";")))
    return _boxes(spark, sf).select("page_id", F.array_join(entries, "|").alias("box"))


_SCHOOLS = """SELECT c_custkey AS page_id, 'Đại học ' || n_name AS university, CAST(1950 + c_custkey % 60 AS INTEGER) AS year FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0
UNION ALL SELECT c_custkey, 'MIT ' || c_mktsegment || ' College', CAST(1950 + c_custkey % 60 AS INTEGER) FROM customer WHERE c_custkey % 3 > 0"""


@query(_SCHOOLS)
def page_education(spark, sf):
    """X2."""
    return html.person_education(_boxes(spark, sf), "page_id")


@query(f"SELECT page_id, CASE WHEN starts_with(university, 'MIT') THEN 'Viện Công nghệ Massachusetts' ELSE university END AS university, year FROM ({_SCHOOLS})")
def page_universities(spark, sf):
    """X4, U8."""
    return html.resolved_education(_boxes(spark, sf), "page_id")


@query(f"SELECT page_id, university FROM ({_SCHOOLS})")
def page_fallback(spark, sf):
    """X3."""
    return html.fallback_education(_boxes(spark, sf), "page_id")


@query("""SELECT 'P' || user_id AS source, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS targets FROM events GROUP BY 1""")
def grouped_links(spark, sf):
    """S13."""
    rows = views.table(spark, sf, "events").select(F.concat(F.lit(" P"), "user_id").alias("source_title"), F.concat("event_type", F.lit("  ")).alias("target_title"))
    return readers.grouped_links(rows).select("source", F.array_join("targets", ",").alias("targets"))
