"""Row types of the engine and the level dimension."""

from pyspark.sql import types as T

#: one positioned text line
LINES = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("page_num", T.IntegerType()),
        T.StructField("x0", T.DoubleType()),
        T.StructField("y0", T.DoubleType()),
        T.StructField("x1", T.DoubleType()),
        T.StructField("y1", T.DoubleType()),
        T.StructField("font_size", T.DoubleType()),
        T.StructField("bold", T.BooleanType()),
        T.StructField("fontname", T.StringType()),
        T.StructField("is_table", T.BooleanType()),
    ]
)

#: fixed values: level -> (Markdown heading level, 0 for body text; order in the tree)
LEVELS = {
    "part": (1, 1),
    "chapter": (2, 2),
    "section": (3, 3),
    "article": (4, 4),
    "clause": (0, 5),
    "sub": (0, 6),
    "item": (0, 7),
    "party": (3, 3),
    "procedure": (3, 3),
    "ruling": (3, 3),
    "judges": (3, 4),
    "preface": (2, 2),
    "appendix": (2, 2),
    "subsection": (4, 4),
    "footnote": (0, 8),
}

DOC_TYPES = ("law", "judgment", "interpretation", "book", "unknown")
