"""Golden values of the text operators, by Spark and by the chunker's Python."""

import pytest
from gleaner.functions import text as T
from gleaner.functions import unicode as U
from gleaner.operators import chunking as C
from pyspark.sql import functions as F


def value(spark, make, *texts):
    return spark.createDataFrame([texts], ", ".join(f"c{i} string" for i in range(len(texts)))).select(make(*[F.col(f"c{i}") for i in range(len(texts))]).alias("v")).first().v


CLEAN = [
    ("A  b\t c d", "A b c d"),
    ("Hello ,world", "Hello, world"),
    ("pi=3.14 http://x.y", "pi=3. 14 http: //x. y"),
    ("1l2 1O2 5I6", "112 102 516"),
    ("rnodel corn", "model corn"),
    ("Line1\n\n# Head\nBody", "Line1 # Head\nBody"),
    ("a.\nb", "a.\nb"),
    ("wait...", "wait. .."),
    ("wait. ..", "wait. .."),
    ("a\r\nb\rc", "a\nb\nc"),
    ("", ""),
]


@pytest.mark.parametrize(("raw", "want"), CLEAN)
def test_clean_text(spark, raw, want):
    assert C.clean(raw) == want == value(spark, T.clean_text, raw)


def test_clean_can_keep_breaks():
    assert C.clean("Line1\n\n# Head\nBody", keep_breaks=True) == "Line1\n\n# Head\nBody"


SENTENCES = [
    ("Many students. They left. Ok", ["Many students. They left.", "Ok"]),
    ("v.d. abc. Def", ["vd. abc.", "Def"]),
    ("tphcm is big. Yes", ["tp.hcm is big.", "Yes"]),
    ("", []),
    ("one", ["one"]),
]


@pytest.mark.parametrize(("raw", "want"), SENTENCES)
def test_sentences(spark, raw, want):
    assert C.sentences(raw) == want == value(spark, T.sentences, raw)


@pytest.mark.parametrize(("raw", "want"), [("", 0), ("abc", 2), ("a, b. c! d?", 6), ("(x)", 2), ("...", 1)])
def test_token_count(spark, raw, want):
    assert C.estimate(raw) == want == value(spark, T.token_count, raw)


@pytest.mark.parametrize(("raw", "want"), [("Dinh nghia tich phan la gi?", "definition"), ("Định nghĩa tích phân?", "general"), ("Vì sao so sánh?", "proof"), ("Vi du", "example")])
def test_intent(spark, raw, want):
    assert value(spark, T.intent, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Bài tập pt", ["Bài tập pt", "bài tập pt", "bai tap pt", "bai tap phuong trinh"]), ("la gi", ["la gi", "gi"]), (" ", [])])
def test_query_variants(spark, raw, want):
    assert value(spark, T.query_variants, raw) == want


@pytest.mark.parametrize(
    ("name", "subject", "grade", "chapter", "year"),
    [("Toan lop 10 chuong 2 2021.pdf", "toan", "Lop 10", "Chuong 2", "2021"), ("toan_lop10.pdf", "toan", "", "", ""), ("Dia ly 8.pdf", "vat ly", "", "", ""), ("sv.txt", "sinh hoc", "", "", "")],
)
def test_metadata(spark, name, subject, grade, chapter, year):
    m = value(spark, T.metadata, name, "")
    assert (m.title, m.subject, m.grade, m.chapter, m.published_year) == (name, subject, grade, chapter, year)


def test_small_ones(spark):
    assert value(spark, lambda c: T.tokens(c, True, False), "Được và A b1 số") == ["đuoc", "b1", "so"]
    assert value(spark, T.keywords, "Định lý 1. Ví dụ, lời giải") == ["vi du", "loi giai"] == C.keywords_of("Định lý 1. Ví dụ, lời giải").split(",")
    assert value(spark, lambda a, b, c, d: T.context_header(a, b, c, d, F.lit(3)), "toan", "Lop 10", "", "A") == "toan · Lop 10 · A · Trang 3"
    kinds = {"bai_giang 1.pdf": "slide", "My Book.txt": "book", "x.pdf": "book", "x.txt": "note", "appt.txt": "slide"}
    assert {n: value(spark, T.document_type, n, "." + n.split(".")[1]) for n in kinds} == kinds
    assert value(spark, T.parent_title, "more", "A") == "A"
    assert value(spark, T.parent_title, "Hello world. More", "Section") == "Hello world." == C.title_of("Hello world. More", "Section")
    assert value(spark, T.parent_title, "x", "x" * 130) == "x" * 117 + "..." == C.title_of("x", "x" * 130)
    assert value(spark, T.section_path, "Ch 1", "Intro") == "Ch 1 > Intro" == C.path_of("Ch 1", "Intro")
    assert value(spark, T.section_path, "a", "A") == "A" and value(spark, T.section_path, "", "") == ""
    assert value(spark, T.trim_summary, "a  b\n" * 200).endswith("...")


def test_folding(spark):
    letters = "".join(map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]))
    single = "".join(c for c in letters if len(U.bare(c)) == 1)
    assert value(spark, T.strip_diacritics, single) == U.bare(single)
    assert value(spark, U.strip_diacritics_exact, "ﬁ½ Được") == "fi1⁄2 Đuoc"
    assert value(spark, U.casefold_exact, "Straße") == value(spark, T.casefold, "Straße") == "strasse"


def test_sql_functions(spark):
    U.register(spark)
    assert spark.sql("SELECT clean_text('Hello ,world') AS c, estimate_tokens('abc') AS n").first() == ("Hello, world", 2)
    assert spark.sql("SELECT content FROM chunk_text('# A\\nSome words here.')").first().content == "Some words here."


@pytest.mark.parametrize("raw", ["ΣΊΣΥΦΟΣ", "Straße µ ſoft", "İstanbul ǅ", "ÀÉ đĐ", "ﬁn ½ x²", "ёж ЙОД"])
def test_search_terms_fold_every_script(spark, raw):
    assert value(spark, lambda c: F.array_join(U.terms(c), " "), raw) == " ".join(U.terms_of(raw))
    if "ﬁ" not in raw and "İ" not in raw:
        assert value(spark, T.casefold, raw) == raw.casefold()


def test_terms_are_those_of_the_column_expression(spark):
    texts = ["La hàm số, và x=12 của THPT!", "", "a b cc dd_ee 3.14", "Định lý: tam giác vuông"]
    for text in texts:
        assert value(spark, T.terms, text) == U.terms_of(text)


@pytest.mark.parametrize(("number", "want"), [(0.0, "0.000"), (0.0005, "0.001"), (0.0015, "0.002"), (2.6745, "2.675"), (-0.0004, "-0.000"), (1 / 3, "0.333")])
def test_three_places_round_the_binary_value(spark, number, want):
    assert spark.createDataFrame([(number,)], "x double").select(U.three_places("x").alias("v")).first().v == f"{number:.3f}"
    assert abs(float(want) - number) <= 0.00051
