from glossa.schema import LINES


def lines(spark, docs):
    """docs: {doc_id: [text or dict(text, page_num, x0, y0, font_size, is_table)]} as LINES, y0 ascending."""
    rows = []
    for doc, given in docs.items():
        for n, x in enumerate(given):
            x = {"text": x} if isinstance(x, str) else x
            rows.append((doc, None, n, x["text"], x.get("page_num", 1), float(x.get("x0", 72)), float(x.get("y0", 20 * n)), 0.0, 0.0, float(x.get("font_size", 12)), False, "", x.get("is_table", False)))
    return spark.createDataFrame(rows, LINES)
