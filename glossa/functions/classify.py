"""Classification of lines and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rx

#: every character that ends a line in a page's text
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def line_level(text: Column) -> Column:
    """The structural level that a line opens, or an empty string."""
    return F.coalesce(rx.choose(text, rx.LEVEL_RULES), F.lit(""))


def judgment_level(text: Column) -> Column:
    return F.coalesce(rx.choose(text, rx.JUDGMENT_RULES), F.lit(""))


def doc_type(page: Column) -> Column:
    """judgment, interpretation, book, law or unknown, from the text of the first page."""
    # each line is looked at once: 3 a judgment's title, 2 a book's heading, 1 any level's
    of_line = lambda x: F.when(rx.starts(x, rx.JUDGMENT_TITLE), 3).when(rx.starts(x, f"{rx.PREFACE}|{rx.APPENDIX}"), 2).when(rx.starts(x, "|".join(p for _, p in rx.LEVEL_RULES)), 1).otherwise(0)
    kind = lambda most: (
        F.when(most == 3, "judgment")
        .when(rx.has(page, rx.INTERPRETATION), "interpretation")
        .when((most == 2) | rx.has(page, rx.PUBLISHER) | rx.has(page, rx.ISBN), "book")
        .when(most == 1, "law")
        .otherwise("unknown")
    )
    return F.transform(F.array(F.array_max(F.transform(F.split(page, LINE_ENDS), of_line))), kind)[0]
