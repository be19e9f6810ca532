import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import values as U
from graphloom.functions import vocabulary as V
from graphloom.plans import enrich


def each(spark, f, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_normalize(spark):
    values = [None, "", " \xa0 ", " a\xa0\tb ", "Đại  học"]
    assert each(spark, T.normalize, values) == [None, None, None, "a b", "Đại học"]
    assert each(spark, T.normalize_title, values) == ["", "", "", "a b", "đại học"]


def test_folds(spark):
    assert each(spark, T.fold, ["Đại học", "Đà_Nẵng-City", "北京", "É"]) == ["dai hoc", "da nang city", "", "e"]
    assert each(spark, T.fold_strict, ["Đại học"]) == ["ai hoc"]
    assert each(spark, T.compact, ["Hoa Kỳ", "country_Hoa_Kỳ"]) == ["hoaky", "countryhoaky"]
    assert each(spark, lambda c: T.compact(c, True), ["country_Hoa_Kỳ"]) == ["hoaky"]
    assert each(spark, T.remove_marks, ["ĐẤU Ước", "thế"]) == ["dau uoc", "the"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x1EFF, exclude_categories=["Cs", "Cc"]), max_size=12), min_size=1, max_size=10))
def test_folds_equal_models(spark, values):
    def model(s):
        bare = "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c) or unicodedata.category(c) != "Mn")
        return re.sub(r"[^a-z0-9]+", " ", bare).strip()

    plain = [v for v in values if all(ord(c) < 0x300 or 0x1E00 <= ord(c) for c in v)]
    plain = [v for v in plain if v.lower() == "".join(c.lower() for c in v if len(c.lower()) == 1)]
    if plain:
        assert each(spark, T.fold_strict, plain) == [model(v) for v in plain]
    assert each(spark, T.normalize_title, values) == [" ".join(re.sub(r"[\x1c-\x1f]", " ", v).split()).lower() for v in values]


def test_years_titles_urls(spark):
    assert each(spark, T.year_in, ["born 1987, 2001", "21999", "", None, "x1990"]) == [1987, None, None, None, None]
    assert each(spark, T.year_in_list, [["a", "in 1999", "2001"], []], "array<string>") == [1999, None]
    assert each(spark, T.clean_title, ["A (trang không tồn tại)", None]) == ["A", ""]
    assert each(spark, T.wiki_url, ["A b/ç~*"]) == ["https://vi.wikipedia.org/wiki/A_b/%C3%A7~%2A"]
    assert each(spark, T.slug, ["Đại học (X) a.b-c"]) == ["Đại_học_X_a.b-c"]
    assert each(spark, T.canonical_university, ["Harvard Law School", " x ", "MITRE", "the mit", "UPenn"]) == ["Đại học Harvard", "x", "MITRE", "Viện Công nghệ Massachusetts", "Đại học Pennsylvania"]
    assert each(spark, lambda c: T.ellipsis(c, 3), ["abcd", "abc"]) == ["abc...", "abc"]
    assert each(spark, T.country_label, ["country_Hoa_Ky"]) == ["Hoa Ky"]
    assert each(spark, T.birth_place, ["4/8/1961 (60 tuổi) Honolulu", "1999 Hà Nội", "x"]) == ["Honolulu", "Hà Nội", None]


def test_predicates(spark):
    titles = ["Đại học Y", "Thạc sĩ", "ETH Zürich", "University of X", "Old College", "trường làng", None]
    assert each(spark, T.is_university_title, titles) == [True, False, False, True, True, False, False]
    assert each(spark, T.is_university_keyword, titles) == [True, False, False, True, True, True, False]
    assert each(spark, T.is_system_title, ["File:x", "Danh sách vua", "Danhsách", "", None, "A"]) == [True, True, False, True, True, False]
    assert each(spark, T.is_date_title, ["1999", "2 tháng 9", "19990", "x", None]) == [True, True, False, False, True]
    assert each(spark, T.is_article_href, ["/wiki/A", "/wiki/File:A", "/wiki/A#b", "http://x", None]) == [True, False, False, False, False]


def test_questions(spark):
    asked = ["Ai? A. x B. y", "A sinh ở đâu?", "A làm nghề gì?", "A và B cùng nghề?", "A có quan hệ với B?", "A học trường nào?", "Có phải A?", "xin chào"]
    assert each(spark, T.question_type, asked) == ["multiple_choice", "birth_place", "property_query", "profession", "connection", "university", "yes_no", "general"]
    got = each(spark, T.choices, ["Trường? A. Đại học X B. Yale  C. MIT D. Z z"])[0]
    assert [(o["letter"], o["text"]) for o in got] == [("A", "Đại học X"), ("B", "Yale"), ("C", "MIT"), ("D", "Z z")]
    said = ["x ANSWER: a ANSWER:  \"Có\" ", "Có\n\ncontext: y\nz", "Có\n[LOG] y\nz", "Có\nTHÔNG TIN về A: b\nc", "Có\n=== A có liên kết B\nc", None]
    assert each(spark, T.clean_answer, said) == ["Có", "Có", "Có", "Có b\nc", "Có\nc", None]
    assert each(spark, T.school_tokens, ["Harvard (MA); Đại học Yale"]) == [["harvard", "yale"]]


def test_path_text(spark):
    df = spark.createDataFrame([(["A", "B", "C"], [["r2", "r1", "r2"], []])], "t array<string>, r array<array<string>>")
    assert df.select(T.path_text(F.col("t"), F.col("r"))).first()[0] == "A --[cạnh: r1, r2]--> B --[cạnh: connected]--> C"


def test_values(spark):
    assert each(spark, U.edge_weight, ["3", "", None, "x"]) == [0.25, 0.5, 0.5, 0.5]
    df = spark.createDataFrame([({"Career": ["x"], "Field": ["y z"]},)], "m map<string,array<string>>")
    m = F.col("m")
    row = df.select(U.first_of(m, ("None", "Career")).alias("f"), U.all_values(m).alias("a"), U.holds_keyword(m, ("y",)).alias("k"), U.entries_like(m, F.lit("fie")).alias("e"), U.share(F.lit(1), F.lit(0)).alias("s")).first()
    assert row["f"] == ["x"] and sorted(row["a"].split()) == ["x", "y", "z"] and row["k"] and len(row["e"]) == 1 and row["s"] == 0.0


def test_gazetteers(spark):
    assert len(V.place_tiers()[0][1]) == 33 and len(V.place_tiers()[1][1]) == 55 and len(V.country_codes()) == 96
    texts = ["Phó Thủ tướng, nhà báo", "Tổng thống và Phó Tổng thống", "không", None]
    assert each(spark, enrich.careers_in, texts) == [["Nha bao", "Pho Thu tuong"], ["Pho Tong thong", "Tong thong"], [], None]
    places = ["sinh tại Hà Nội, Pháp", "Bắc Kinh và Hà Nội", "Đế quốc Anh", "Nhật Bản", "Y", "Yale", "xPháp", "Phápx"]
    assert each(spark, enrich.country_in, places) == ["Viet Nam", "Trung Quoc", "Anh", "Nhat Ban", "Y", None, None, "Phap"]
    assert each(spark, enrich.countries_in, ["Pháp, Đức và Y", "Phápx"]) == [["Duc", "Phap"], []]
    assert each(spark, enrich.country_code, ["Phap", "?"]) == ["FR", "?"]
    assert each(spark, enrich.career_category, ["Nha bao", "x"]) == ["Truyen thong", "Other"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from("pho thu tuong tong thong giao su nha bao van khoa hoc bi dai , x".split()), max_size=10).map(" ".join), min_size=1, max_size=8))
def test_career_alternation_equals_the_greedy_model(spark, texts):
    names = {enrich._folded(c): c for c in V.career_categories()}

    def model(t):
        taken, out = [], set()
        for folded in sorted(names, key=lambda c: -len(c)):
            for m in re.finditer(rf"\b{re.escape(folded)}\b", t):
                if all(m.start() >= b or m.end() <= a for a, b in taken):
                    out.add(names[folded])
                    taken.append(m.span())
        return sorted(out)

    assert each(spark, enrich.careers_in, texts) == [model(t) for t in texts]
