import json
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.operators import check, clean, metadata, render, segment, tree
from glossa.plans.convert import Options, structure
from glossa.sources.rules import Rules

from . import model
from .helpers import lines


def random_docs(kind, count, seed):
    rng = random.Random(seed)
    pool = ["第一编 总则", "第一章 甲", "第二章 乙", "第一节 丙", "第一条 为了。", "第二条 规定。", "第五条", "（一）登记；", "2. 备案", "a) 细目", "一、小节", "普通正文。", "参照《刑法》第三条。", "  ", "前言", "跋"]
    pool += {"judgment": ["原告：甲", "本院审理查明", "判决如下：", "审判长 王"], "book": ["① 脚注", "大标题", "[3] 注"]}.get(kind, [])
    docs = {}
    for i in range(count):
        docs[f"{kind}{i}"] = [{"text": rng.choice(pool), "x0": rng.choice([72, 80, 82, 90]), "font_size": rng.choice([0, 8, 10, 10, 10, 12, 16, 21, 40]) if kind == "book" else 12, "is_table": rng.random() < 0.1} for _ in range(rng.randrange(1, 25))]
    return docs


@pytest.mark.parametrize("kind", ["law", "judgment", "book", "unknown"])
def test_equals_the_model(spark, kind):
    docs = random_docs(kind, 60, hash(kind) % 7)
    types = spark.createDataFrame([(d, kind) for d in docs], "doc_id string, doc_type string")
    annotated = segment.annotate(lines(spark, docs).repartition(5), types)
    built = tree.build(segment.nodes_of(annotated))
    got, said = {}, {r.doc_id: r.preamble for r in segment.preambles(annotated).collect()}
    for r in built.collect():
        got.setdefault(r.doc_id, {})[r.node_pos] = (r.level, r.title, r.text, tuple(r.hierarchy_path), r.parent_pos, tuple((x.pos, x.level, x.title, x.text) for x in r.leaves))
    for doc, given in docs.items():
        rows = [x for x in given if x["text"].strip()]
        nodes, preamble = model.nodes_of([(n, x["text"], x["x0"], x["font_size"], x["is_table"]) for n, x in enumerate(rows, 1)], kind)
        roots = model.build(nodes)
        want = {n.pos: (n.level, n.title, n.text, path, n.parent and n.parent.pos, tuple(n.leaves)) for n, path in model.walk(roots)}
        assert got.get(doc, {}) == want, doc
        assert said.get(doc) == ("\n".join(preamble) or None)


STATUTE = [
    {"text": "某某管理条例", "font_size": 22}, "2020年5月28日公布 2021年1月1日施行", "第一章 总则", "第一条 为了规范管理，制定本条例。", "本条例适用于境内活动。",
    {"text": "依照《民法典》第一百四十三条第二款执行。", "x0": 90}, "第三条 下列事项：", "（一）登记；", "（二）备案。", {"text": "以上事项另行规定。", "x0": 90},
]


def test_statute(spark):
    done = structure(lines(spark, {"A": STATUTE}))
    meta = done.meta.first()
    assert (meta.doc_type, meta["name"], meta.publish_date, meta.effective_date) == ("law", "某某管理条例", "2020年5月28日", "2021年1月1日")
    assert meta.extra == {"preamble": "某某管理条例\n2020年5月28日公布 2021年1月1日施行"}
    assert [r.message for r in done.gaps().collect()] == ["条号不连续: 第1条 → 第3条 (缺失第2条)"]
    nodes = {(r.node_pos, r.leaf_no): r for r in done.nodes.collect()}
    assert nodes[6, 1].level == "clause" and nodes[6, 1].law_references == ["《民法典》第一百四十三条第二款"] and nodes[6, 1].hierarchy_path == ["款"]
    assert nodes[7, 0].text == "以上事项另行规定。" and nodes[7, 0].hierarchy_path == ["第一章 总则", "第三条 下列事项："]
    body = render.bodies(done.nodes).first().body
    assert body == (
        "## 第一章 总则\n\n#### 第一条 为了规范管理，制定本条例。\n\n本条例适用于境内活动。\n\n<!-- anchor: article-一 -->\n\n依照《民法典》第一百四十三条第二款执行。\n\n引用: [《民法典》第一百四十三条第二款](#article-一百四十三)\n\n"
        "#### 第三条 下列事项：\n\n以上事项另行规定。\n\n<!-- anchor: article-三 -->\n\n（一）登记；\n\n（二）备案。\n"
    )
    content = done.markdown().first().content
    assert content.startswith("---\ntitle: 某某管理条例\n...\npublish_date: 2020年5月28日\n...\n") and content.endswith("doc_type: law\n---\n\n" + body)
    whole = json.loads(done.json().first().content)
    assert whole["meta"]["doc_type"] == "law" and whole["meta"]["preamble"].startswith("某某")
    chapter = whole["tree"][0]
    assert [c["number"] for c in chapter["children"]] == ["一", "三"] and [c["level"] for c in chapter["children"][1]["children"]] == ["sub", "sub"]
    assert chapter["children"][0]["children"][0]["law_references"] == ["《民法典》第一百四十三条第二款"]


def test_toc_and_no_anchor(spark):
    done = structure(lines(spark, {"A": STATUTE}), options=Options(toc=True, anchors=False))
    content = done.markdown().first().content
    assert "## 目录\n\n- 第一章 总则\n  - 第一条 为了规范管理，制定本条例。\n    - \n  - 第三条 下列事项：\n    - （一）登记；\n    - （二）备案。\n\n---\n\n## 第一章" in content
    assert "anchor" not in content


def test_judgment(spark):
    given = ["北京市某某区人民法院民事判决书", "（2023）京0105民初123号", "原告：张三，男。", "被告：李四。", "本院经审理查明，双方签订合同。", "本院认为，应当支付。", "依照《民法典》第五百零九条规定，判决如下：", "一、被告支付价款。", "审判长 王五", "书记员 赵六"]
    done = structure(lines(spark, {"B": given, "M": given[:1]}))
    meta = {r.doc_id: r for r in done.meta.collect()}
    assert meta["B"].doc_type == "judgment" and meta["B"].extra["case_number"] == "（2023）京0105民初123号" and "court" not in meta["B"].extra
    assert meta["M"].extra["court"] == "北京市某某区人民法院" and meta["M"].extra["judgment_type"] == "民事判决书"
    roots = [(r.level, r.title) for r in done.tree.where("doc_id = 'B' and parent_pos is null").orderBy("node_pos").collect()]
    assert roots == [("article", ""), ("party", given[2]), ("party", given[3]), ("procedure", given[4]), ("ruling", given[6])]
    assert "case_number" in done.markdown().where("doc_id = 'B'").first().content
    assert "#### \n\n（2023）京" in done.markdown().where("doc_id = 'B'").first().content


def test_interpretation_and_orphan(spark):
    done = structure(lines(spark, {"C": ["最高人民法院关于某某问题的解释", "法释〔2020〕1号", "第一条 为了统一适用。"], "D": ["（一）先出现的项", "后续文字"]}))
    meta = {r.doc_id: r for r in done.meta.collect()}
    assert (meta["C"].doc_type, meta["C"].doc_no, meta["C"].issuing_authority, meta["D"].doc_type) == ("interpretation", "法释〔2020〕1号", "最高人民法院", "law")
    own = done.nodes.where("doc_id = 'D'").orderBy("node_pos", "leaf_no").collect()
    assert [(r.level, r.number, r.title, r.text) for r in own] == [("article", "", "", "后续文字"), ("sub", "", "（一）先出现的项", "（一）先出现的项")]


def test_book(spark):
    given = [{"text": "要件事实论讲义", "font_size": 24}, {"text": "某某大学出版社", "font_size": 10}, *({"text": t, "font_size": 10} for t in ("正文一句。", "正文两句。", "正文三句。", "正文四句。")), {"text": "请求权基础", "font_size": 16}, {"text": "① 参见前注", "font_size": 8}]
    done = structure(lines(spark, {"E": given}))
    meta = done.meta.first()
    assert meta.doc_type == "book" and meta.extra["publisher"] == "某某大学出版社" and meta["name"] == "要件事实论讲义"
    assert [(r.level, r.title) for r in done.tree.orderBy("node_pos").collect()] == [("chapter", "要件事实论讲义"), ("section", "请求权基础")]
    assert "<small>① 参见前注</small>" in done.markdown().first().content
    foot = done.nodes.where("level = 'footnote'").first()
    assert foot.hierarchy_path == ["请求权基础", "脚注"]


def test_headers_and_footers(spark):
    given = []
    for p in range(1, 5):
        given += [{"text": "某某文件汇编", "page_num": p, "y0": 30}, {"text": f"正文第{p}句话", "page_num": p, "y0": 100 + p}, {"text": f"— {p} —", "page_num": p, "y0": 800}]
    given.append({"text": "仅供参考", "page_num": 2, "y0": 700})
    rows = clean.normalize_lines(lines(spark, {"F": given}), Rules())
    assert sorted(r.text for r in clean.filter_lines(rows, Rules()).collect()) == [f"正文第{p}句话" for p in range(1, 5)]
    # in a document of one page two equal lines at one height go as well
    twins = lines(spark, {"Q": [{"text": "甲", "y0": 1}, {"text": "甲", "y0": 1}, {"text": "乙", "y0": 1}]})
    assert [r.text for r in clean.filter_lines(twins, Rules()).collect()] == ["乙"]


def test_contents_lists(spark):
    docs = {"g1": ["第一章 总则", "第一章 总则", "第一条 甲。"], "g2": ["第一章 总则", "第二章 附则", "第一章 总则", "第一条 甲。"]}
    done = structure(lines(spark, docs), options=Options(filter_lines=False))
    kept = {d: [r.node_pos for r in done.tree.where(F.col("doc_id") == d).orderBy("node_pos").collect()] for d in docs}
    assert kept == {"g1": [2, 3], "g2": [1, 2, 3, 4]}


def test_gaps(spark):
    done = structure(lines(spark, {"N": [f"第{n}条 x。{i}" for i, n in enumerate(["一", "二", "二之一", "五", "四"])] + ["第六条之二 y"]}))
    assert [(r.prev_num, r.num, r.missing) for r in done.gaps().collect()] == [(2, 5, 3)]
    assert check.article_count(done.nodes).first().n_articles == 5  # 第二之一条 is no article


def test_adding_and_moving_documents_changes_nothing(spark):
    docs = random_docs("law", 20, 3)
    one = {r.doc_id: r.body for r in render.bodies(structure(lines(spark, docs)).nodes).collect()}
    more = structure(lines(spark, docs | random_docs("book", 5, 4)).repartition(7)).nodes
    assert {r.doc_id: r.body for r in render.bodies(more).where("doc_id like 'law%'").collect()} == one


def test_json_equals_the_nodes(spark):
    docs = random_docs("law", 15, 9) | random_docs("judgment", 15, 9)
    done = structure(lines(spark, docs))

    def count(nodes):
        return sum(1 + count(n["children"]) for n in nodes)

    n = {r.doc_id: r["count"] for r in done.nodes.groupBy("doc_id").count().collect()}
    assert {r.doc_id: count(json.loads(r.content)["tree"]) for r in done.json().collect() if r.doc_id in n} == n


def test_empty(spark):
    done = structure(lines(spark, {}))
    assert done.markdown().collect() == [] and done.json().collect() == []
    one = structure(lines(spark, {"x": ["只有文字"]}))
    assert one.markdown().first().content == "---\n---\n" .replace("---\n---\n", "---\ndoc_type: unknown\n---\n") or one.markdown().first().content.startswith("---\n")


def test_yaml_scalars():
    given = pd.Series([["", "a: b", None], ["x", "one\ntwo", "a: b"]])
    assert list(next(render.yaml_scalars.func(iter([given])))) == [['""', "'a: b'", None], ["x\n...", "'one\n\n  two'", "'a: b'"]]


def test_metadata_uses_the_first_page_alone(spark):
    rows = lines(spark, {"P": [{"text": "国务院令第12号"}, {"text": "2020年1月2日", "page_num": 2}]})
    meta = metadata.metadata(rows).first()
    assert (meta.doc_no, meta.publish_date, meta.issuing_authority) == ("第12号", "", "国务院")


def test_documents_without_lines_on_page_one_stay(spark):
    given = lines(spark, {"a": ["第一条 甲。"], "b": [{"text": "第一条 乙。", "page_num": 2}], "c": [{"text": "  "}, {"text": "第二条 丙。", "page_num": 3}]})
    docs = spark.createDataFrame([("a",), ("b",), ("c",), ("oversize",)], "doc_id string")
    for known, want in ((None, {"a", "b", "c"}), (docs, {"a", "b", "c", "oversize"})):
        done = structure(given, docs=known)
        shown = {r.doc_id: r.content for r in done.markdown().collect()}
        assert set(shown) == want == {r.doc_id for r in done.json().collect()}
        assert "#### 第一条 乙。" in shown["b"] and "#### 第二条 丙。" in shown["c"]
    assert shown["oversize"] == "---\n---\n"


def test_stored_steps_change_nothing(spark):
    given = lines(spark, {"a": ["第一章 总则", "第一条 甲。", "（一）乙"], "b": [{"text": "前言", "font_size": 20}, {"text": "正文", "page_num": 2}]})
    for how in ("markdown", "json"):
        plain, kept = (sorted(map(tuple, getattr(structure(given, options=Options(store=s)), how)().collect())) for s in (False, True))
        assert plain == kept


def test_repeats_take_one_exchange_and_keep_lines_without_a_place(spark):
    schema = "doc_id string, line_no int, text string, page_num int, y0 double"
    rows = [("d", 1, "same", 1, 5.0), ("d", 2, "same", 2, 5.0), ("d", 3, None, 1, 5.0), ("d", 4, None, 2, 5.0), ("d", 5, "high", 1, None), ("d", 6, "high", 2, None), (None, 7, "same", 1, 5.0), (None, 8, "same", 2, 5.0), ("d", 9, "x" * 80, 1, 5.0), ("d", 10, "x" * 80, 2, 5.0), ("e", 11, "same", 1, 5.0)]
    left = clean.drop_repeated(spark.createDataFrame(rows, schema))
    assert left.columns == ["doc_id", "line_no", "text", "page_num", "y0"]
    assert sorted(r.line_no for r in left.collect()) == [3, 4, 5, 6, 7, 8, 9, 10, 11]
    plan = left._jdf.queryExecution().sparkPlan().toString() + left._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert clean.drop_repeated(spark.createDataFrame([], schema)).count() == 0


def test_tasks_take_no_more_lines_as_tables_grow(spark, tmp_path, monkeypatch):
    from glossa.plans import catalog
    from glossa.sources import shared

    given = spark.range(700).select((F.col("id") % 100).alias("l_orderkey"), *(F.col("id").alias(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")))
    given.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(shared, "TASK_ROWS", 70)
    for name in ("segmented_lines", "tree_paths", "leaves", "document_json", "judgment_tree"):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "Broadcast")
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(l_orderkey#") == 1 and ", 10), REPARTITION_BY_NUM" in plan, name


def test_leaves_are_what_is_no_parent(spark):
    docs = {k: v for kind in ("law", "judgment", "book") for k, v in random_docs(kind, 40, 5).items()}
    nodes = structure(lines(spark, docs)).nodes
    rows = nodes.collect()
    parents = {(r.doc_id, r.parent_pos) for r in rows}
    want = {(r.doc_id, r.node_pos, r.leaf_no) for r in rows if r.leaf_no or (r.doc_id, r.node_pos) not in parents}
    assert {(r.doc_id, r.node_pos, r.leaf_no) for r in tree.leaves(nodes).collect()} == want


def test_what_there_is_of_each_document_is_not_broadcast(spark):
    given = lines(spark, {f"D{i}": ["第一条 甲", "正文"] for i in range(20)})
    done = structure(given, options=Options(store=True))
    stored, plain = done.stored, structure(given)
    for found in (done.markdown(), done.json(), done.annotated, plain.markdown(), plain.json(), plain.annotated):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id for r in done.markdown().collect()} == {f"D{i}" for i in range(20)}
    assert len(stored) == 2
    done.discard()


def plan_of(df, step="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_each_line_is_cleaned_once(spark):
    given = lines(spark, {"a": ["第一章 总则", "第一条 甲。"], "b": ["前言", "正文"]})
    # once among books and once among all others; a filter that takes the text's making along would do it again
    for some, times in ((given, 2), (given.where("doc_id = 'a'"), 1)):
        done = structure(some, options=Options(store=True, single=True))
        assert plan_of(done.annotated).count("translate(") == times == 1 + plan_of(done.annotated).count("fold_book(")
    assert done.markdown().count() == 1 and len(done.stored) == 1
    done.discard()


def test_a_single_result_with_and_without_books(spark):
    docs = {k: v for kind in ("law", "judgment", "book") for k, v in random_docs(kind, 30, 3).items()}
    for given in (docs | {"B": ["前言", "正文"]}, {"L": ["第一条 甲。"]}):
        plain, single = (structure(lines(spark, given), options=o).markdown().collect() for o in (Options(), Options(store=True, single=True)))
        assert sorted(map(tuple, plain)) == sorted(map(tuple, single)) and len(single) == len(given)


def test_a_tree_takes_three_sorts_and_a_block_is_made_once(spark):
    nodes = segment.nodes_of(segment.by_windows(segment.classified(lines(spark, {"a": ["第一条 甲。"]}), "law")))
    built = tree.build(nodes)
    sorts = [plan_of(df, "sparkPlan").count("Window [") for df in (nodes, built)]
    assert sorts[1] - sorts[0] <= 5
    plans = [plan_of(df, "executedPlan").split("== Initial Plan ==")[-1].count("Sort [") for df in (nodes, built)]
    assert plans[1] - plans[0] == 3
    assert plan_of(render.bodies(tree.all_nodes(built))).count("引用: ") == 1


def test_headings_that_repeat_go_with_what_is_below(spark):
    given = {"a": ["第一编 总则", "第一章 甲", "第一节 丙", "第一条 乙", "第一章 甲", "第一节 丙", "第一节 丙", "第一条 乙", "第一条 乙", "正文", "第一编 总则"], "b": ["第一章 甲", "第一章 甲", "第一章 甲"], "c": ["第一条 乙", "第一章 甲", "第一条 乙", "第一章 甲"]}
    annotated = segment.annotate(lines(spark, given), spark.createDataFrame([(d, "law") for d in given], "doc_id string, doc_type string"))
    got = {}
    for r in tree.build(segment.nodes_of(annotated)).collect():
        got.setdefault(r.doc_id, {})[r.node_pos] = tuple(r.hierarchy_path)
    for doc, texts in given.items():
        nodes, _ = model.nodes_of([(n, x, 72, 12, False) for n, x in enumerate(texts, 1)], "law")
        assert got[doc] == {n.pos: path for n, path in model.walk(model.build(nodes))}, doc


def test_yaml_lists_are_the_scalars():
    values = [["", "a: b", None], ["x", "one\ntwo", "a: b"], [None], [], ["是", "1", "null", "第一条 甲"]]
    for given in (pa.array(values), pa.array(values)[1:4], pa.array([], pa.list_(pa.string()))):
        (found,) = render.yaml_lists.func(iter([given]))
        assert found.to_pylist() == list(next(render.yaml_scalars.func(iter([pd.Series(given.to_pylist(), dtype=object)]))))
