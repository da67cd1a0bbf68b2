"""Regular expressions of the engine, in Java's dialect.

``(?Ud)``: classes are Unicode-aware and only a line feed ends a line.
``starts`` anchors at the beginning, ``has`` finds anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the numerals, words and forms that statutes, judgments and law books use
CN = "一二三四五六七八九十百千零"
ARTICLE = f"第([{CN}]+)条(之[{CN}]+)?(?=\\s|[，。,.\\n（）()]|$)"
PART = f"第[{CN}]+编\\b"
CHAPTER = f"第[{CN}]+章\\b"
SECTION = f"第[{CN}]+节\\b"
SUB_PAREN = f"[（(][{CN}]+[）)]"
SUB_NUMBER = r"[（(]?\d+[．.、）)]"
ITEM = "[（(]?[a-zA-Z][）)]"
PREFACE = "(前言|序言|序|自序|代序|导言|导论|引言|再版序|修订序|第[一二三四五六七八九十]版序)[：:]?$"
APPENDIX = r"(后记|跋|附录[一二三四五六七八九十零〇]?$|附录\s*[一二三四五六七八九十零〇]+$|附录\s*\d+$)"
SUBSECTION = "[一二三四五六七八九十]+[、．.]"
JUDGMENT_TITLE = "(中华人民共和国)?(.+?人民法院)(民事|刑事|行政|赔偿|执行)(判决书|裁定书|调解书|决定书|通知书)$"
PARTY = "(原告|被告|第三人|上诉人|被上诉人|申请人|被申请人|再审申请人|原审原告|原审被告)[：:]"
PROCEDURE = "(原告|被告|第三人|上诉人|被上诉人).+?诉称|(本院|法院)(依法|于|经)?(组成|公开|审理|查明)"
RULING = "(依照|根据).+?(规定|判决|裁定|决定)如下[：:]?|(判决|裁定|决定)如下[：:]?"
JUDGES = r"(审判长|审判员|代理审判员|陪审员|法官助理|书记员)[：:]?\s*\S"
FOOTNOTE = r"[①②③④⑤⑥⑦⑧⑨⑩]|\[\d+\]"
ISBN = r"ISBN[\s\-]*\d+[\s\-]*\d*[\s\-]*\d*[\s\-]*\d*[\s\-]*[\dXx]"
PUBLISHER = "[一-鿿]+出版社"
LAW_REFERENCE = f"《[^》]+》第[{CN}]+条(第[{CN}]+款)?(第[{CN}]+项)?"
LAW_TITLE = "《[^》]+?(?:法|条例|规定|办法|决定|意见|规则|细则|通则|解释|批复|答复)》"
INTERPRETATION = r"法释[〔（]\d{4}[〕）]\s*\d+\s*号"
DOC_NUMBER = f"(第\\s*(?:\\d+|[{CN}]+)\\s*号|.*?[〔（]\\d{{4}}[〕）]\\s*\\d+\\s*号)"
DATE = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
AUTHORITY = "(全国人民代表大会(常务委员会)?|国务院|最高人民法院|最高人民检察院|国家[^的]+局|中华人民共和国[^的]+部|中华人民共和国[^的]+委员会|中华人民共和国[^的]+署|中华人民共和国[^的]+院)"
CASE_NUMBER = r"[（(]\s*\d{4}\s*[）)]\s*[一-鿿\d]+\d+号"
PAGE_MARK = r"[-—·•]+\s*\d+\s*[-—·•]+$|\s*\d+\s*$|第\s*\d+\s*页$|\s*第\s*\d+\s*页\s*共\s*\d+\s*页$"
LINK_NUMBER = f"第([{CN}0-9]+)条"

#: first match wins
LEVEL_RULES = (
    ("part", PART),
    ("chapter", CHAPTER),
    ("section", SECTION),
    ("article", ARTICLE),
    ("sub_clause", SUB_PAREN),
    ("sub_clause", SUB_NUMBER),
    ("item", ITEM),
    ("preface", PREFACE),
    ("appendix", APPENDIX),
    ("subsection", SUBSECTION),
)
JUDGMENT_RULES = (("party", PARTY), ("procedure", PROCEDURE), ("ruling", RULING), ("judges", JUDGES))


def anchored(pattern: str) -> str:
    return f"(?Ud)^(?:{pattern})"


def anywhere(pattern: str) -> str:
    return f"(?Ud){pattern}"


def starts(text: Column, pattern: str) -> Column:
    return text.rlike(anchored(pattern))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(anywhere(pattern))


def first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match anywhere, or an empty string."""
    return F.regexp_extract(text, anywhere(pattern), group)


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(anywhere(pattern)), 0)


def choose(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The name of the first rule that fits the start of the text, or null."""
    out = F.when(starts(text, rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(starts(text, pattern), name)
    return out
