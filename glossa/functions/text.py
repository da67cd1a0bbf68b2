"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LEVELS
from . import rx

SPACE = r"[\s\x1c-\x1f]"

# fixed values: what each numeral stands for
NUMERALS = {"零": 0, "〇": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "百": 100, "千": 1000, "万": 10000}


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def replace_all(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Literal replacements, each over the result of the one before."""
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), rules, text)


def normalize(text: Column, rules: list[tuple[str, str]]) -> Column:
    text = F.translate(text, "　─—", " --")
    return strip(F.regexp_replace(replace_all(text, rules), " {2,}", " "))


def below_ten_thousand(text: Column) -> Column:
    """Value of a numeral without 万: a digit waits for its unit, a unit alone counts once."""
    number = lambda n: F.lit(n).cast("bigint")
    values = F.create_map(*(x for k, v in NUMERALS.items() for x in (F.lit(k), number(v))))

    def step(acc: Column, ch: Column) -> Column:
        value = F.try_element_at(values, ch)
        waiting = F.when(acc["digit"] == 0, number(1)).otherwise(acc["digit"])
        return (
            F.when(value.isNull(), acc)
            .when(value >= 10, F.struct((acc["sum"] + waiting * value).alias("sum"), number(0).alias("digit")))
            .otherwise(F.struct(acc["sum"].alias("sum"), value.alias("digit")))
        )

    return F.aggregate(F.split(text, ""), F.struct(number(0).alias("sum"), number(0).alias("digit")), step, lambda acc: acc["sum"] + acc["digit"])


def numeral_value(text: Column) -> Column:
    """A Chinese or Arabic numeral as a number; an empty one is 0."""
    at = F.locate("万", text)
    upper, lower = F.substring(text, F.lit(1), at - 1), F.substr(text, at + 1)
    above = F.when(upper == "", F.lit(1).cast("bigint")).otherwise(below_ten_thousand(upper))
    return (
        F.when(text == "", F.lit(0).cast("bigint"))
        .when(text.rlike("^[0-9０-９]+$"), F.translate(text, "０１２３４５６７８９", "0123456789").try_cast("bigint"))
        .when(at > 0, above * 10000 + below_ten_thousand(lower))
        .otherwise(below_ten_thousand(text))
    )


def article_number(text: Column) -> Column:
    """The number of a line that opens an article, with its 之 suffix, or an empty string."""
    pattern = rx.anchored(rx.ARTICLE)
    return F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))


def without_article_number(text: Column) -> Column:
    return F.when(rx.starts(text, rx.ARTICLE), strip(F.regexp_replace(text, rx.anchored(rx.ARTICLE), ""))).otherwise(text)


def law_references(text: Column) -> Column:
    """All citations of an article of a named law."""
    # most texts cite nothing, and the test for the bracket is cheap
    return F.when(F.contains(text, F.lit("《")), rx.every(text, rx.LAW_REFERENCE)).otherwise(F.array().cast("array<string>"))


def law_titles(text: Column) -> Column:
    """All titles of laws and other rules that a text names, with their brackets."""
    return F.when(F.contains(text, F.lit("《")), rx.every(text, rx.LAW_TITLE)).otherwise(F.array().cast("array<string>"))


def reference_link(reference: Column) -> Column:
    """A citation as a Markdown link to the article's anchor."""
    number = rx.first(reference, rx.LINK_NUMBER, 1)
    return F.when(rx.starts(reference, rx.LAW_REFERENCE) & (number != ""), F.concat(F.lit("["), reference, F.lit("](#article-"), number, F.lit(")"))).otherwise(reference)


def label_level(label: Column) -> Column:
    """The level that a label such as 第三章 names, or null."""
    found = [("编", "part"), ("章", "chapter"), ("节", "section"), ("条", "article")]
    out = F.when(~F.startswith(label, F.lit("第")), F.lit(None).cast("string"))
    return reduce(lambda o, f: o.when(F.contains(label, F.lit(f[0])), f[1]), found, out)


def of_level(level: Column, place: int, otherwise: int) -> Column:
    table = F.create_map(*(x for k, v in LEVELS.items() for x in (F.lit(k), F.lit(v[place]))))
    return F.coalesce(F.try_element_at(table, level), F.lit(otherwise))


def heading_level(level: Column) -> Column:
    return of_level(level, 0, 0)


def sort_order(level: Column) -> Column:
    return of_level(level, 1, 99)


def full_text(title: Column, text: Column) -> Column:
    return F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(text, F.lit("")))


def path_string(path: Column, title: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(title)
