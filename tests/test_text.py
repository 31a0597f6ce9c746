import pytest
from pyspark.sql import functions as F

from quern.functions import text as t


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("text", "want"), [("Luật Doanh nghiệp 59/2020/QH14", "59/2020/QH14"), ("Quyết định 15/QĐ-TTg", "15/QĐ-TTg"), ("Nghị định 12/2022/NĐ-CP sửa đổi 45/2019/QH14", "45/2019/QH14"), ("Thông tư 05/2020/TT-BTC-BNV", "05/2020/TT-BTC"), ("Thông tư liên tịch 01/2020/TTLT-BTC", ""), ("", ""), (None, "")])
def test_doc_code(spark, text, want):
    assert one(spark, text, t.doc_code) == want


def test_normal_forms(spark):
    assert one(spark, "Điều 5:  Thuế-GTGT!", t.normalize) == "điều 5 thuế gtgt"
    assert one(spark, "Người LĐ đóng BHXH", t.expand_abbreviations) == "Người lao động đóng bảo hiểm xã hội"
    assert one(spark, "NĐ 12", t.expand_abbreviations) == "NĐ 12"
    assert one(spark, "HĐ-LĐ", t.prepare_for_bm25) == "hợp đồng lao động"
    assert one(spark, " a  b\n", t.clean_text) == "a b"
    assert one(spark, None, t.clean_text) == ""
    assert one(spark, "ﬁ  HĐ", t.prepare_query) == "fi hợp đồng"
    assert one(spark, "Các quyền của người dùng", t.tokenize) == ["quyền", "dùng"]


def test_references(spark):
    got = one(spark, "theo Điều 12 Luật Đất đai, Khoản 3 và Điều 5", t.references)
    assert [(r.type, r.value, r.match) for r in got] == [("article", "12", "Điều 12"), ("article", "5", "Điều 5"), ("clause", "3", "Khoản 3"), ("law", "Đất đai", "Luật Đất đai")]
    assert one(spark, None, t.references) == []


@pytest.mark.parametrize(("text", "want"), [("Điều 5 Khoản 2 và Điều 7", [("article_clause", "5", "2"), ("article", "7", "")]), ("Khoản 3 Điều 9", [("article_clause", "9", "3")]), ("Điều 9, Khoản 3", [("article", "9", "")]), ("Điều 9 quy định chung về hợp đồng. Khoản 3 nêu rõ", [("article_clause", "9", "3")]), ("", [])])
def test_structured_references(spark, text, want):
    assert [tuple(r) for r in one(spark, text, t.structured_references)] == want


def test_law_names(spark):
    assert one(spark, "luật doanh nghiệp năm 2020", t.core_name) == "doanh nghiệp năm"
    assert one(spark, "bộ luật lao động", t.law_kind) == "bộ luật"
    assert one(spark, "luậtx", t.law_kind) == ""
    assert one(spark, "hỗ trợ dnnvv", t.expand_law_names) == "hỗ trợ doanh nghiệp nhỏ và vừa"
    assert one(spark, "Luật 59/2020/QH14 Doanh nghiệp", t.short_name) == "Doanh nghiệp"
    assert one(spark, "năm 2020 và 1999", t.year) == "2020"
    assert one(spark, "Luật A - Điều 12a x", t.clean_title) == "Luật A"
    assert one(spark, "12", t.format_article) == "Điều 12"
    assert one(spark, "Điều 12", t.format_article) == "Điều 12"


def test_truncation(spark):
    assert one(spark, "a" * 1900 + " " + "b" * 200, t.truncate_at_word) == "a" * 1900
    assert one(spark, "a" * 1700 + " " + "b" * 500, t.truncate_at_word) == ("a" * 1700 + " " + "b" * 500)[:2048]
    assert one(spark, "ab", t.truncate_at_word) == "ab"


def test_replies(spark):
    assert one(spark, "1, 3, x, 99", lambda c: t.number_list(c, 15)) == [0, 2]
    assert one(spark, "- first item\n-- ab\ntext\n - third thing", t.bullets) == ["first item", "third thing"]
    p = one(spark, 'x ```json\n{"a": 1}\n```', lambda c: t.parse_json(c, "a int"))
    assert p.a == 1
    assert one(spark, "no", lambda c: t.parse_json(c, "a int")).a is None


def test_html(spark):
    html = "<html><style>p {}</style><script>var x='</p>';</script><p>Điều 1</p><p>. Phạm&nbsp;vi</p><b>a &amp; b</b></html>"
    assert one(spark, html, t.html_text) == "Điều 1. Phạm vi\na & b"


def test_unclosed_entities(spark):
    html = "<title>a&amp;&amp b&amp</title><p>c &lt; d &copy&#65; &eacute;</p>"
    assert one(spark, html, t.html_text) == "a&& b&\nc < d ©A é"
    assert one(spark, html, lambda c: t.html_text(c, unclosed=False)) == "a&&amp b&amp\nc < d &copyA é"
