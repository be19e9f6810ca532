"""Wikipedia-like pages: HTML to a struct once, then plain columns.

The parser is Python's own; it runs over Arrow batches and is the only Python in these scans. What follows from its
struct are DataFrame expressions, so that Catalyst prunes and pushes filters as usual.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import vocabulary as V

_ANCHOR = "struct<title:string,href:string,text:string>"
PAGE = f"struct<has_infobox:boolean,rows:array<struct<key:string,text:string,items:array<string>,breaks:boolean,anchors:array<{_ANCHOR}>>>,body:array<{_ANCHOR}>,all:array<{_ANCHOR}>,has_body:boolean>"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag closes these, where they were left open.
_CLOSES = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}}
#: Closing stops at these.
_SCOPES = {"tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "li": {"ul", "ol"}, "p": {"div", "td", "th", "li", "table"}}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.rows: list[dict] = []
        self.anchors: list[dict] = []
        self.infobox_at = self.body_at = -1
        self.has_infobox = self.has_body = self.infobox_done = False
        self.row: dict | None = None
        self.link: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "br":
            if self.row and self._inside("td"):
                self.row["breaks"] = True
                self.row["cuts"].append(len(self.row["texts"]))
            return
        if tag in _VOID:
            return
        self._implied(tag)
        self.stack.append((tag, a))
        depth = len(self.stack)
        if tag == "table" and not self.has_infobox and re.search(r"\binfobox\b", a.get("class", ""), re.I):
            self.has_infobox, self.infobox_at = True, depth
        if tag == "div" and a.get("id") == "mw-content-text" and self.body_at < 0:
            self.has_body, self.body_at = True, depth
        if self.infobox_at > 0 and tag == "tr":
            self._end_row()
            self.row = {"heads": [], "texts": [], "breaks": False, "cuts": [], "lists": {}, "anchors": [], "th": False, "td": False}
        elif self.row is not None and tag in ("th", "td"):
            self.row[tag] = True
        elif self.row is not None and tag == "li" and self._inside("td"):
            kind = "hlist" if any(t == "div" and "hlist" in x.get("class", "").split() for t, x in self.stack) else "ul"
            self.row["lists"].setdefault(kind, []).append([])
        if tag == "a" and "href" in a:
            self.link = {"title": a.get("title"), "href": a["href"], "texts": [], "body": self.body_at > 0, "cell": bool(self.row and self._inside("td"))}

    def _implied(self, tag: str) -> None:
        while self.stack and tag in _CLOSES:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in _SCOPES[tag]:
                    return
                if self.stack[k][0] in _CLOSES[tag]:
                    while len(self.stack) > k:
                        self._pop()
                    break
            else:
                return

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.stack):
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, _ = self.stack.pop()
        depth = len(self.stack) + 1
        if tag == "a" and self.link:
            link = {"title": self.link["title"], "href": self.link["href"], "text": "".join(self.link["texts"]).strip()}
            self.anchors.append(link | {"body": self.link["body"]})
            if self.row is not None and self.link["cell"]:
                self.row["anchors"].append(link)
            self.link = None
        if tag == "tr" and self.infobox_at > 0:
            self._end_row()
        if depth == self.infobox_at:
            self._end_row()
            self.infobox_at = 0
        if depth == self.body_at:
            self.body_at = 0
        return tag

    def _inside(self, tag: str) -> bool:
        for t, _ in reversed(self.stack):
            if t == tag:
                return True
            if t == "tr":
                return False
        return False

    def handle_data(self, data: str) -> None:
        if self.link is not None:
            self.link["texts"].append(data)
        if self.row is None:
            return
        if self._inside("th"):
            self.row["heads"].append(data.strip())
        elif self._inside("td"):
            if data.strip():
                self.row["texts"].append(data.strip())
            if any(t == "li" for t, _ in self.stack):
                for items in list(self.row["lists"].values())[-1:]:
                    items[-1].append(data.strip())

    def _end_row(self) -> None:
        row, self.row = self.row, None
        if not row or not row["th"] or not row["td"]:
            return
        lists = row["lists"].get("hlist") or row["lists"].get("ul")
        if lists:
            items = ["".join(i) for i in lists]
        elif row["breaks"]:
            items = row["texts"]
        else:
            items = [" ".join(row["texts"])]
        items = [i for i in items if i]
        self.rows.append({"key": "".join(row["heads"]), "text": " ".join(row["texts"]), "items": items, "breaks": row["breaks"], "anchors": row["anchors"]})


def parse_page(html: str | None) -> dict | None:
    """S3: a page's information box and links; null for null."""
    if html is None:
        return None
    page = _Page()
    page.feed(html)
    page.close()
    while page.stack:
        page._pop()
    links = [{k: a[k] for k in ("title", "href", "text")} for a in page.anchors]
    return {
        "has_infobox": page.has_infobox,
        "rows": [r for r in page.rows if r["key"]],
        "body": [link for link, a in zip(links, page.anchors, strict=True) if a["body"]],
        "all": links,
        "has_body": page.has_body,
    }


def _parsed(html: pd.Series) -> pd.DataFrame:
    rows = [parse_page(h) or {"has_infobox": None, "rows": None, "body": None, "all": None, "has_body": None} for h in html]
    return pd.DataFrame(rows, columns=["has_infobox", "rows", "body", "all", "has_body"])


def parsed_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with the struct `page`."""
    return pages.withColumn("page", F.pandas_udf(_parsed, PAGE)(F.col(html_col)))


def page_keys(page: Column) -> Column:
    return F.transform(page["rows"], lambda r: r["key"])


def is_person_page(page: Column) -> Column:
    """An information box with a birth header."""
    return page["has_infobox"] & F.exists(page_keys(page), lambda k: k.rlike(rf"(?iU)\b{V.BIRTH_KEY}\b"))


def is_person_by_keys(page: Column) -> Column:
    """Keys of persons, none of organisations."""
    person, other = (F.array(*(F.lit(k) for k in keys)) for keys in (V.PERSON_KEYS, V.ORGANISATION_KEYS))
    return F.arrays_overlap(page_keys(page), person) & ~F.arrays_overlap(page_keys(page), other)


def is_university_page(page: Column) -> Column:
    """At least two keys of institutions."""
    known = F.array(*(F.lit(k) for k in V.UNIVERSITY_KEYS))
    return F.size(F.array_intersect(F.transform(page_keys(page), F.lower), known)) >= 2


def _anchor_title(a: Column) -> Column:
    return T.normalize(F.coalesce(F.nullif(a["title"], F.lit("")), F.nullif(a["text"], F.lit(""))))


def page_links(parsed: DataFrame, key: str) -> DataFrame:
    """(key, pos, title), each title once, in order; links of the content if it is marked, else of all."""
    page = F.col("page")
    links = F.filter(F.when(page["has_body"], page["body"]).otherwise(page["all"]), lambda a: T.is_article_href(a["href"]))
    titles = F.array_distinct(F.filter(F.transform(links, _anchor_title), lambda t: t.isNotNull()))
    return parsed.select(key, F.posexplode(titles).alias("pos", "title"))


def href_targets(pages: DataFrame, key: str, html_col: str = "html") -> DataFrame:
    """X1 without a parser: every href in order, by pattern; for pages whose links are not articles."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit('href="([^"]*)"'), F.lit(1))).alias("pos", "href"))


def person_education(parsed: DataFrame, key: str) -> DataFrame:
    """(key, university, year) of the article links in education rows; the row's first year holds for all."""
    keys = F.array(*(F.lit(k) for k in V.EDUCATION_KEYS))
    row = parsed.select(key, F.explode(F.filter(F.col("page")["rows"], lambda r: F.array_contains(keys, r["key"]))).alias("r"))
    anchors = F.filter(F.col("r.anchors"), lambda a: T.is_article_href(a["href"]))
    found = row.select(key, F.explode(anchors).alias("a"), T.year_in(F.col("r.text")).alias("year"))
    return found.select(key, _anchor_title(F.col("a")).alias("university"), "year").where("university is not null").distinct()


def fallback_education(parsed: DataFrame, key: str) -> DataFrame:
    """(key, university), from links that look like universities or from the text's pieces that do."""
    keys = F.array(*(F.lit(k) for k in V.MORE_EDUCATION_KEYS))
    row = parsed.select(key, F.explode(F.filter(F.col("page")["rows"], lambda r: F.array_contains(keys, r["key"]))).alias("r"))
    linked = F.filter(F.transform(F.col("r.anchors"), _anchor_title), T.is_university_title)
    names = F.when(F.size("r.anchors") > 0, linked).otherwise(T.university_chunks(F.col("r.text")))
    return row.select(key, F.explode(names).alias("university")).distinct()


def resolved_education(parsed: DataFrame, key: str) -> DataFrame:
    """X2, with X3 where X2 has no university; then cleaned, filtered and made canonical."""
    direct = person_education(parsed, key)
    good = direct.groupBy(key).agg(F.max(T.is_university_title(F.col("university"))).alias("good")).where("good")
    more = fallback_education(parsed, key).join(good, key, "left_anti").join(direct, [key, "university"], "left_anti").withColumn("year", F.lit(None).cast("int"))
    both = direct.unionByName(more).withColumn("university", T.clean_title(F.col("university"))).where(T.is_university_title(F.col("university")))
    return both.select(key, T.canonical_university(F.col("university")).alias("university"), "year").groupBy(key, "university").agg(F.min("year").alias("year"))


def infobox_map(page: Column) -> Column:
    """The information box as a map of lists; the last of equal keys wins."""
    rows = F.filter(page["rows"], lambda r: F.size(r["items"]) > 0)
    keys = F.array_distinct(F.transform(rows, lambda r: r["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(rows, lambda r: r["key"] == k), -1)["items"]))


def first_in_page_order(links: DataFrame, key: str, per_page: int) -> DataFrame:
    """At most so many links of a page, by position."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    return links.withColumn("place", place).where(F.col("place") <= per_page).drop("place")
