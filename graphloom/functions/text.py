"""Text functions and predicates, from Column to Column; all of them stay inside generated code.

Java's \\s, \\w and \\b know only ASCII unless (?U) is given; Python's know Unicode, and so do these.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import vocabulary as V


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for flag in flags:
        out = out | flag
    return out


def _java(words: tuple[str, ...]) -> str:
    return "|".join(re.sub(r"([.^$*+?{}()|\\])", r"\\\1", w) for w in words)


def collapse(t: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def normalize(t: Column) -> Column:
    """Collapsed; null for nothing."""
    return F.nullif(collapse(t), F.lit(""))


def normalize_title(t: Column) -> Column:
    """Collapsed lower case; empty for null."""
    return F.lower(collapse(F.coalesce(t, F.lit(""))))


def normalized_key(*columns: Column) -> Column:
    """A struct of normalised strings as a key."""
    return F.struct(*(normalize(c).alias(f"k{i}") for i, c in enumerate(columns)))


def _translate(t: Column, table: dict[str, str]) -> Column:
    return F.translate(t, "".join(table), "".join(table.values()))


def remove_marks(t: Column) -> Column:
    """U4: lower case without Vietnamese marks."""
    return _translate(F.lower(t), V.VIETNAMESE)


def strip_foreign(t: Column) -> Column:
    """Lower case, collapsed, without characters other than word characters, blanks, - and dots."""
    return F.regexp_replace(collapse(F.lower(t)), r"(?U)[^\w\s\-.]", "")


def fold_strict(t: Column) -> Column:
    """Marks dropped by decomposition; đ doesn't decompose and becomes a blank."""
    bare = F.regexp_replace(_translate(F.lower(t), {k: v for k, v in V.LATIN.items() if k == k.lower()}), r"\p{Mn}+", "")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def fold(t: Column) -> Column:
    """As fold_strict, with đ as d."""
    return fold_strict(F.translate(F.lower(t), "đ", "d"))


def compact(t: Column, drop_country: bool = False) -> Column:
    """The fold without blanks, and without a leading `country`."""
    out = F.regexp_replace(fold(t), r"[^a-z0-9]", "")
    return F.regexp_replace(out, "^country", "") if drop_country else out


def year_in(t: Column) -> Column:
    """The first year from 1900 to 2099."""
    return F.regexp_extract(t, r"(?U)\b((?:19|20)\d{2})\b", 1).try_cast("int")


def year_in_list(values: Column) -> Column:
    """U7 over a list: the first hit."""
    return F.try_element_at(F.filter(F.transform(values, year_in), lambda y: y.isNotNull()), F.lit(1))


def canonical_university(t: Column) -> Column:
    """U8: the canonical name of the first rule whose word occurs, else the trimmed title."""
    out = F.trim(t)
    for words, name in reversed(V.CANONICAL_UNIVERSITIES):
        out = F.when(t.rlike(rf"(?iU)\b(?:{_java(words)})\b"), F.lit(name)).otherwise(out)
    return out


def clean_title(t: Column) -> Column:
    """Without the mark of a missing page."""
    return F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), rf"(?iU)\s*{_java((V.MISSING_PAGE,))}\s*$", ""))


def wiki_url(t: Column, base: str = "https://vi.wikipedia.org/wiki/", encode: bool = True) -> Column:
    """Blanks as _, percent-encoded as in paths."""
    name = F.translate(F.coalesce(t, F.lit("")), " ", "_")
    if encode:
        name = F.url_encode(name)
        for a, b in (("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
            name = F.replace(name, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), name)


def slug(t: Column) -> Column:
    """Blanks as _, then word characters, - and dots alone."""
    return F.regexp_replace(F.regexp_replace(F.trim(t), r"(?U)\s+", "_"), r"(?U)[^\w\-.]", "")


def split_list(t: Column, marks: str = ";,") -> Column:
    """Pieces between marks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(t, f"[{marks}]"), collapse), lambda x: x != "")


def university_chunks(t: Column) -> Column:
    """Pieces that look like universities."""
    return F.filter(split_list(t, ";•|,"), is_university_title)


def joined(values: Column) -> Column:
    """A list as text, without empty items."""
    return F.array_join(F.filter(values, lambda x: x != ""), " ")


def ellipsis(t: Column, n: int) -> Column:
    """U16: at most n characters, then dots."""
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def country_label(t: Column) -> Column:
    """A country's id as its name."""
    return F.replace(F.regexp_replace(t, "^country_", ""), F.lit("_"), F.lit(" "))


def path_text(titles: Column, relations: Column) -> Column:
    """A path with the relations of each step; relations: one array for each step."""
    steps = F.transform(
        relations,
        lambda r, i: F.concat(
            F.lit(" --[cạnh: "),
            F.when(F.size(r) > 0, F.array_join(F.array_sort(F.array_distinct(r)), ", ")).otherwise("connected"),
            F.lit("]--> "),
            F.element_at(titles, i + 2),
        ),
    )
    return F.concat(F.element_at(titles, 1), F.array_join(steps, ""))


def node_text(title: Column, type_: Column, in_degree: Column, out_degree: Column) -> Column:
    """One line about a node."""
    return F.format_string("%s (%s): in %d, out %d", title, type_, in_degree, out_degree)


def birth_place(t: Column) -> Column:
    """What follows `(NN tuổi)`, else what follows a year."""
    after_age = F.nullif(F.trim(F.regexp_extract(t, r"\(\d+\s*tuổi\)\s*(.+)$", 1)), F.lit(""))
    return F.coalesce(after_age, F.nullif(F.trim(F.regexp_extract(t, r"\d{4}\)?\s*(.+)$", 1)), F.lit("")))


def choices(t: Column) -> Column:
    """The options of a multiple-choice question, as (letter, text)."""
    pattern = F.lit(r"(?s)\b([A-D])\.\s*(.*?)(?=\s+\b[A-D]\.|$)")
    texts = F.transform(F.regexp_extract_all(t, pattern, F.lit(2)), collapse)
    return F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("letter"), texts.alias("text"))


def clean_answer(t: Column) -> Column:
    """What follows the last `ANSWER:`, without repeated context, logs, notes and rules behind it, blanks and quotes at the ends."""
    out = F.when(F.contains(t, F.lit("ANSWER:")), F.trim(F.substring_index(t, "ANSWER:", -1))).otherwise(t)
    for tail in (r"CONTEXT:.*", r"\[LOG\].*"):
        out = F.regexp_replace(out, rf"(?isU)\n+{tail}", "")
    for tail in (r"THÔNG TIN.*:", r"=+.*có liên kết.*"):
        out = F.regexp_replace(out, rf"(?iu)\n+{tail}", "")
    stripped = F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(stripped, r'^"+|"+$', ""), r"(?U)^\s+|\s+$", "")


def school_tokens(t: Column) -> Column:
    """Distinct folded words of a list of schools, without what stands in parentheses and short or generic words."""
    words = F.split(fold(F.regexp_replace(t, r"\([^)]*\)", " ")), r" +")
    generic = F.array(*(F.lit(w) for w in ("dai", "hoc", "truong", "vien", "university", "college", "school", "of", "the")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(generic, w)))


def is_university_keyword(t: Column) -> Column:
    """The lower-case title holds a keyword."""
    return _any([F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lit(k)) for k in V.UNIVERSITY_KEYWORDS])


def is_university_title(t: Column) -> Column:
    """P5: prefixes, suffixes, words; never a degree."""
    s = F.trim(F.coalesce(t, F.lit("")))
    hit = _any([s.startswith(p) for p in V.UNIVERSITY_PREFIXES] + [s.endswith(x) for x in V.UNIVERSITY_SUFFIXES])
    return (s != "") & ~s.isin(*V.DEGREES) & (hit | s.rlike(rf"(?iU)\b({'|'.join(V.UNIVERSITY_WORDS)})\b") | F.contains(s, F.lit("Đại học")))


def is_system_title(t: Column) -> Column:
    """Nothing, a colon, or a namespace."""
    s = F.coalesce(t, F.lit(""))
    return (s == "") | F.contains(s, F.lit(":")) | s.rlike(rf"^(?iU)(?:{_java(V.NAMESPACES)})\b")


def is_date_title(t: Column) -> Column:
    """A year, or a day and a month."""
    s = F.coalesce(t, F.lit(""))
    return (s == "") | s.rlike(r"^\d{4}$") | s.rlike(r"^(?iU)\d{1,2}\s+tháng\s+\d{1,2}$")


def is_article_href(href: Column) -> Column:
    """A link to an article."""
    return F.coalesce(href.startswith("/wiki/") & ~href.rlike("[:#]"), F.lit(False))


def root_type(is_person_page: Column, title: Column, is_university_page: Column) -> Column:
    """Person pages first, then universities, else person."""
    return F.when(is_person_page, "person").when(is_university_keyword(title) | is_university_page, "university").otherwise("person")


def node_type(given: Column, title: Column) -> Column:
    """P10: the given type, or one guessed from the title."""
    return F.coalesce(F.nullif(F.lower(given), F.lit("")), F.when(is_university_keyword(title), "university").otherwise("person"))


def corrected_type(id_: Column, title: Column, given: Column, is_known_university: Column) -> Column:
    """Known universities, then prefixes of ids, then the given type."""
    return (
        F.when(is_known_university, "university")
        .when(id_.startswith("career_"), "career")
        .when(id_.startswith("country_"), "country")
        .otherwise(F.coalesce(F.nullif(given, F.lit("")), F.lit("person")))
    )


def question_type(q: Column) -> Column:
    """Q1: the kind of a question; the first rule wins."""
    s = F.lower(q)
    out = F.when(s.rlike(r"\b[a-d]\."), "multiple_choice")
    for kind, words in V.QUESTION_WORDS:
        out = out.when(_any([F.contains(s, F.lit(w)) for w in words]), kind)
    starts, holds = [s.startswith(w) for w in V.YES_NO_STARTS], [F.contains(s, F.lit(w)) for w in V.YES_NO_HOLDS]
    return out.when(_any(starts + holds + [s.endswith(w) for w in V.YES_NO_ENDS]), "yes_no").otherwise("general")
