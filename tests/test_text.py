import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import classify, rx, text
from glossa.sources import rules


def values(spark, f, given):
    rows = spark.createDataFrame(list(enumerate(given)), "i int, t string").select("i", f(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(rows, key=lambda r: r.i)]


def plain_value(t):
    """Digits wait for their unit; 万 splits the numeral."""
    if not t:
        return 0
    if t.isdigit():
        return int(t)
    if "万" in t:
        a, b = t.split("万", 1)
        return (plain_value(a) if a else 1) * 10000 + plain_value(b)
    total = digit = 0
    for ch in t:
        if ch in "十百千":
            total += (digit or 1) * {"十": 10, "百": 100, "千": 1000}[ch]
            digit = 0
        elif ch in "零〇一二三四五六七八九":
            digit = 0 if ch in "零〇" else "一二三四五六七八九".index(ch) + 1
    return total + digit


def test_numerals(spark):
    given = ["一", "十二", "一百二十三", "一千零一", "一万二千三百四十五", "", "12", "万", "万一", "二十", "九千九百九十九", "三之", "x", "百", "十十", "〇", "１２"]
    assert values(spark, text.numeral_value, given) == [plain_value(t) for t in given]
    assert values(spark, text.numeral_value, given[:7]) == [1, 12, 123, 1001, 12345, 0, 12]


def test_normalize(spark):
    f = lambda c: text.normalize(c, rules.REPLACEMENTS)
    given = ["　", "第O条", "第0条", "第l条", "第I条", "l令", "全国人民代表大会", "中华人民共国", "a   b", " \tx\x85 ", "─—"]
    assert values(spark, f, given) == ["", "第〇条", "第十条", "第一条", "第一条", "令", "全国人民代表大会会", "中华人民共和国", "a b", "x", "--"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("第一编 总则", "part"), ("第一章 总则", "chapter"), ("第一章总则", ""), ("第十节", "section"), ("第一条 为了", "article"), ("第一条为了", ""), ("第一条", "article"), ("第一条之二 x", "article"),
        ("第一条：x", ""), ("（一）x", "sub_clause"), ("(十)x", "sub_clause"), ("1.x", "sub_clause"), ("2020.5.1", "sub_clause"), ("（2023）京", "sub_clause"), ("a)x", "item"), ("A. x", ""), ("前言：", "preface"), ("前言x", ""),
        ("跋涉千里", "appendix"), ("附录一", "appendix"), ("附录 12", "appendix"), ("附录x", ""), ("一、x", "subsection"), ("普通", ""), ("第〇条 x", ""), ("１．x", "sub_clause"),
    ],
)
def test_levels(spark, line, want):
    assert values(spark, classify.line_level, [line]) == [want]


def test_judgment_levels(spark):
    given = ["原告：张三", "原告张三：男", "本院经审理查明，x", "本院认为", "依照《民法典》规定，判决如下：", "审判长 王五", "原告诉称x", "原告张三诉称"]
    assert values(spark, classify.judgment_level, given) == ["party", "", "procedure", "", "ruling", "judges", "", "procedure"]


def test_doc_types(spark):
    given = ["x\n北京市人民法院民事判决书\ny", "法释〔2020〕1号", "某大学出版社", "ISBN 978-7-1", "序言\nx", "a\n第一条 x", "x", "", "a 第一条 x"]
    assert values(spark, classify.doc_type, given) == ["judgment", "interpretation", "book", "book", "book", "law", "unknown", "unknown", "law"]


def test_articles_and_references(spark):
    assert values(spark, text.article_number, ["第一条之二 x", "第十条", "x"]) == ["一之二", "十", ""]
    assert values(spark, text.without_article_number, ["第一条之二 x", "第十条", "第一条为"]) == ["x", "", "第一条为"]
    assert values(spark, text.law_references, ["依照《民法典》第一条第二款、《刑法》第三条第一项", "无"]) == [["《民法典》第一条第二款", "《刑法》第三条第一项"], []]
    assert values(spark, text.reference_link, ["《民法典》第一百条", "《第三条释义》第五条", "x"]) == ["[《民法典》第一百条](#article-一百)", "[《第三条释义》第五条](#article-三)", "x"]
    assert values(spark, text.label_level, ["第一编", "第二章", "第三节", "第四条", "第五", "一章"]) == ["part", "chapter", "section", "article", None, None]


def test_level_dimension(spark):
    assert values(spark, text.heading_level, ["part", "article", "clause", "?"]) == [1, 4, 0, 0]
    assert values(spark, text.sort_order, ["part", "judges", "footnote", "?"]) == [1, 4, 8, 99]
    row = spark.range(1).select(text.full_text(F.lit("a"), F.lit("b")), text.full_text(F.lit(""), F.lit("b")), text.path_string(F.array(F.lit("a"), F.lit("b")), F.lit("t")), text.path_string(F.array().cast("array<string>"), F.lit("t"))).first()
    assert tuple(row) == ("a\nb", "b", "a > b", "t")


def test_anchors(spark):
    f = lambda c: rx.starts(c, rx.FOOTNOTE)
    assert values(spark, f, ["①x", "[12]x", "x[1]"]) == [True, True, False]
    assert values(spark, lambda c: rx.starts(c, rx.PAGE_MARK), ["— 12 —", "12", "第 3 页", "第3页 共9页", "12a", "12\r"]) == [True, True, True, True, False, True]


def test_rules_file(tmp_path):
    assert rules.load().signatures == rules.SIGNATURES
    path = tmp_path / "r.yaml"
    path.write_text('replacements:\n  - ["a", "b"]\n  - ["only"]\nheader_footer_signatures: ["x"]\n', encoding="utf-8")
    assert rules.load(str(path)).replacements == [("a", "b")]
    assert rules.load(str(tmp_path / "none.yaml")) == rules.Rules([], [])


def test_word_lines_deal_nothing_out(spark, tmp_path):
    from glossa.operators import words
    from glossa.plans import catalog

    texts = [(1, " ".join(f"w{i}" for i in range(450))), (2, None), (3, ""), (4, "  a  b\n"), (5, " ".join("x" for _ in range(200))), (6, " ".join("y" for _ in range(201)))]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["word_lines"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = [(d, 1 + n // 200, n, w, n % 200 // 9 * 12.0 + n % 4, n % 9 * 30.0, n % 9 * 30.0 + 25.0, None) for d, text in texts for n, w in enumerate(re.split(r"\s+", text or ""))]
    placed = spark.createDataFrame(rows, "doc_id long, page_num int, word_no int, text string, top double, x0 double, x1 double, chars array<struct<size:double,fontname:string>>")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, words.cluster_words(placed).collect()))
