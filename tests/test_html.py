from pyspark.sql import functions as F

from graphloom.sources import html as H

PERSON = """<p>x<div id="mw-content-text"><table class="big infobox vcard"><tr><th>Sinh</th><td>4 tháng 8, 1961<br>Honolulu</td></tr>
<tr><th>Alma mater</th><td><a href="/wiki/H" title="Đại học Harvard">Harvard</a> <a href="/wiki/Y">Đại học\xa0Yale</a> 1991</td></tr>
<tr><th>Nghề nghiệp</th><td><div class="hlist"><ul><li>Luật sư</li><li>Nhà văn</li></ul></div></td></tr></table>
<a href="/wiki/A" title="A">a</a> <a href="/wiki/A" title="A">again</a> <a href="/wiki/File:B">b</a> <a href="/wiki/C#d">c</a></div><a href="/wiki/Out">out</a>"""
UNI = '<table class="infobox"><tr><th>Loại hình</th><td>Công</td></tr><tr><th>Thành lập</th><td>1901</td></tr><tr><th>Khoa</th><td><ul><li>x</ul></td></tr></table>'
TEXT_EDU = '<table class="infobox"><tr><th>Học vấn<td>Đại học Huế; Cử nhân • Trường X<tr><th>Học vấn<td>Viện Y</table><a href="/wiki/D">D</a>'


def pages(spark):
    rows = [(1, PERSON), (2, UNI), (3, TEXT_EDU), (4, "<p>none <a href='/wiki/E'>E<p>"), (5, None), (6, "")]
    return H.parsed_pages(spark.createDataFrame(rows, "id long, html string")).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_kinds_of_pages(spark):
    p = F.col("page")
    got = pages(spark).select("id", H.is_person_page(p), H.is_university_page(p), H.is_person_by_keys(p)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got[:4]] == [(True, False, True), (False, True, False), (False, False, True), (False, False, False)]
    assert tuple(got[4])[1:] == (None, None, None)


def test_links_in_order_and_scope(spark):
    got = rows(H.page_links(pages(spark), "id"), "id", "pos", "title")
    assert got == [(1, 0, "Đại học Harvard"), (1, 1, "Đại học Yale"), (1, 2, "A"), (3, 0, "D"), (4, 0, "E")]


def test_education(spark):
    p = pages(spark)
    assert rows(H.person_education(p, "id"), "id", "university", "year") == [(1, "Đại học Harvard", 1991), (1, "Đại học Yale", 1991)]
    assert rows(H.fallback_education(p, "id"), "id", "university") == [(1, "Đại học Harvard"), (1, "Đại học Yale"), (3, "Trường X"), (3, "Viện Y"), (3, "Đại học Huế")]
    got = H.resolved_education(p, "id").collect()
    assert sorted((r["id"], r["university"], r["year"]) for r in got if r["id"] == 1) == [(1, "Đại học Harvard", 1991), (1, "Đại học Yale", 1991)]
    assert {r["university"] for r in got if r["id"] == 3} == {"Trường X", "Viện Y", "Đại học Huế"}


def test_infobox(spark):
    got = {r["id"]: r["m"] for r in pages(spark).select("id", H.infobox_map(F.col("page")).alias("m")).collect()}
    assert got[1] == {"Sinh": ["4 tháng 8, 1961", "Honolulu"], "Alma mater": ["Harvard Đại học\xa0Yale 1991"], "Nghề nghiệp": ["Luật sư", "Nhà văn"]}
    assert got[2]["Khoa"] == ["x"] and got[3] == {"Học vấn": ["Viện Y"]} and got[4] == {} and got[5] is None
