import json

import pytest
from pyspark.sql import functions as F

from glossa import cli, device
from glossa.operators import ocr, words
from glossa.sources import files, output, pdf
from glossa.streaming import watch

from .helpers import lines

CHARS = "array<struct<size:double,fontname:string>>"


def test_tables(spark):
    rows = spark.createDataFrame([("d", 1, 0, [["a", "b\nc"], [None, "d"]]), ("d", 1, 1, [["only"]])], "doc_id string, page_num int, table_no int, cells array<array<string>>")
    got = words.table_lines(rows).collect()
    assert [(r.text, r.y0, r.is_table) for r in got] == [("| a | b c |\n| --- | --- |\n|  | d |", 0.0, True)]


def test_words_cluster_around_the_first_word(spark):
    given = [(0, "a", 10.0, 5.0, 9.0), (1, "b", 12.9, 1.0, 20.0), (2, "c", 13.2, 3.0, 4.0), (3, " ", 40.0, 0.0, 1.0), (4, "d", 15.0, 2.0, 6.0), (5, "e", 30.0, 2.0, 6.0)]
    rows = spark.createDataFrame([("d", 1, n, t, top, x0, x1, [(12.0, "Song-Bold"), (14.0, "")] if t == "a" else None) for n, t, top, x0, x1 in given], f"doc_id string, page_num int, word_no int, text string, top double, x0 double, x1 double, chars {CHARS}")
    got = words.cluster_words(rows).orderBy("line_no").collect()
    assert [(r.text, r.y0, r.x0, r.x1, r.font_size, r.bold, r.y1) for r in got] == [("ab", 10.0, 1.0, 20.0, 14.0, True, 24.0), ("cd", 13.2, 2.0, 6.0, 0.0, False, 25.2), ("e", 30.0, 2.0, 6.0, 0.0, False, 42.0)]
    assert got[0].fontname == "Song-Bold"


def test_boxes(spark):
    box = [[300.0, 300.0], [600.0, 300.0], [600.0, 600.0], [300.0, 600.0]]
    rows = spark.createDataFrame([("d", 1, [box, box, box], ["x", " y ", "  "], [0.49, 0.5, 0.9, 1.0], 300)], "doc_id string, page_num int, dt_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>, dpi int")
    assert [tuple(r)[3:] for r in ocr.box_lines(rows).collect()] == [("y", 72.0, 72.0, 144.0, 144.0, 72.0)]


def test_rounding_is_of_the_binary_value(spark):
    given = [0.05 * k for k in range(400)] + [0.15, 0.25, 0.35, 0.45, 2.675, 71.95, 1e6 + 0.05, -0.25, -0.35]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v double").select("i", ocr.tenth(F.col("v")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: round(v, 1) for i, v in enumerate(given)}


def test_routes_and_resolution(spark):
    row = spark.range(1).select(ocr.needs_ocr(F.lit(9), "auto"), ocr.needs_ocr(F.lit(10), "auto"), ocr.needs_ocr(F.lit(10), "force"), ocr.needs_ocr(F.lit(0), "off"), ocr.resolution(F.lit(595.0), F.lit(842.0)), ocr.resolution(F.lit(2000.0), F.lit(100.0))).first()
    assert tuple(row) == (True, False, True, False, 300, int(72 * (300 / 72 * 4000 / int(2000 * 300 / 72))))
    with pytest.raises(ValueError):
        ocr.needs_ocr(F.lit(1), "sometimes")
    pages = spark.createDataFrame([(1, 5), (2, 200_001), (3, 7)], "page_num int, n_chars int")
    assert ocr.within_limit(pages).count() == 2
    assert [ocr.first_pages(pages, n).count() for n in (None, 0, 1, -1)] == [3, 3, 1, 0]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.pdf", "sub/b.pdf", "c.PDF", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    rows = files.pdf_files(spark, str(tmp_path), content=False)
    root = "file:" + str(tmp_path)
    assert sorted(r.path for r in rows.select(files.output_path(F.col("path"), root).alias("path")).collect()) == ["a.md", "sub/b.md"]
    flat = rows.select(files.output_path(F.col("path"), root, flatten=True, extension="json").alias("rel_path"))
    assert sorted(r.rel_path for r in flat.collect()) == ["a.json", "b.json"]
    assert files.collisions(flat.union(flat)).count() == 2 and files.collisions(flat).count() == 0


def test_unreadable_pdf_does_not_stop_the_batch(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"no pdf")
    pages = pdf.read_pages(files.pdf_files(spark, str(tmp_path))).collect()
    assert len(pages) == 1 and pages[0].error
    assert pdf.page_lines(pdf.read_pages(files.pdf_files(spark, str(tmp_path)))).count() == 0


def test_write_files(spark, tmp_path):
    (tmp_path / "bad.md").mkdir()
    docs = spark.createDataFrame([("x/a.md", "# 甲"), ("b.json", '{"k":"乙"}'), ("bad.md", "z")], "rel_path string, content string")
    done = {r.rel_path: r.ok for r in output.write_files(docs, str(tmp_path)).collect()}
    assert done == {"x/a.md": True, "b.json": True, "bad.md": False}
    assert (tmp_path / "x/a.md").read_text(encoding="utf-8") == "# 甲" and (tmp_path / "b.json").read_text(encoding="utf-8") == '{\n  "k": "乙"\n}'


def test_command_line(spark, tmp_path, capsys):
    table = str(tmp_path / "in.parquet")
    lines(spark, {"d1": ["第一条 甲。", "第三条 乙。"]}).write.parquet(table)
    assert cli.main(["convert", table, "-o", str(tmp_path / "out"), "--validate", "--toc"], spark) == 0
    assert "缺失第2条" in capsys.readouterr().err
    assert "## 目录" in (tmp_path / "out/d1.md").read_text(encoding="utf-8")
    assert cli.main(["batch", table, "-o", str(tmp_path / "out"), "--format", "json", "--flatten"], spark) == 0
    assert json.loads((tmp_path / "out/d1.json").read_text(encoding="utf-8"))["tree"][0]["number"] == "一"
    assert cli.main(["profile"], spark) == 0


def test_stream(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for d in ("d1", "d2"):
        lines(spark, {d: ["第一条 甲。"]}).coalesce(1).write.mode("append").parquet(folder)
    watch.structure_stream(watch.line_files(spark, folder, 1), out, str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == ["d1", "d2"]


def test_device(spark):
    assert device.is_discrete("NVIDIA RTX 5060") and not device.is_discrete("Intel(R) UHD 630") and not device.is_discrete("other")
    names = ["NVIDIA RTX 5060", "Intel(R) UHD 630", "other", "Radeon RX 580"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", device.is_discrete_column(F.col("n")).alias("d")).collect()
    assert {r.n: r.d for r in got} == {n: device.is_discrete(n) for n in names}
    assert device.profile_table(spark).first().cpu_cores > 0
    assert "processor" in device.Profile(1, 2.0, False, "", 1).summary() and "RTX" in device.Profile(1, 2.0, True, "RTX 9", 1).summary()


def test_entry_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "article_gaps" in entry.queries()


def test_pages_become_lines_by_text_table_or_image(spark):
    from glossa.sources import pdf

    line = lambda text: (text, 72.0, 10.0, 90.0, 20.0, [])
    pages = spark.createDataFrame(
        [
            ("a.pdf", 1, 500, 600.0, 800.0, [line("第一条 甲。"), line("  ")], [[["k", "v"], ["1", None]], [["alone"]]], None),
            ("a.pdf", 2, 3, 600.0, 800.0, [line("x")], [], None),
            ("big.pdf", 1, 10**6, 600.0, 800.0, [line("skipped")], [], None),
            ("bad.pdf", None, None, None, None, None, None, "OSError: broken"),
        ],
        pdf.PAGES,
    )
    assert [tuple(r) for r in pdf.failures(pages).collect()] == [("bad.pdf", "OSError: broken")]
    asked = []

    def recogniser(wanted, backend):
        asked.append(sorted((r.source_path, r.page_num, r.dpi) for r in wanted.collect()))
        box = lambda x, y: [[x, y], [x + 30, y], [x + 30, y + 30], [x, y + 30]]
        rows = [(r.source_path, r.page_num, [box(300.0, 600.0), box(30.0, 300.0), box(0.0, 300.0)], ["低", "右", "左"], [0.9, 0.9, 0.9], r.dpi) for r in wanted.collect()]
        return spark.createDataFrame(rows, "doc_id string, page_num int, dt_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>, dpi int").withColumn("error", F.lit(None).cast("string"))

    shown = lambda mode: sorted((r.doc_id, r.page_num, r.line_no, r.text) for r in pdf.read_documents(pages, mode, None, recogniser).collect())
    table = ("a.pdf", 1, 1_000_000, "| k | v |\n| --- | --- |\n| 1 |  |")
    image = lambda page: [("a.pdf", page, k, t) for k, t in enumerate("左右低")]
    assert shown("off") == [("a.pdf", 1, 0, "第一条 甲。"), table, ("a.pdf", 2, 0, "x")]
    assert shown("auto") == [("a.pdf", 1, 0, "第一条 甲。"), table, *image(2)]
    assert shown("force") == [*image(1), *image(2)]
    assert asked == [[("a.pdf", 2, 300)], [("a.pdf", 1, 300), ("a.pdf", 2, 300)]]


def test_words_without_lines_are_put_on_lines():
    from glossa.sources import pdf

    word = lambda text, top, x0: {"text": text, "top": top, "x0": x0, "x1": x0 + 5}
    got = pdf.lines_of_words([word("第一", 10, 20), word("条", 11, 30), word(" ", 40, 0), word("下行", 30, 25)])
    assert [(x["text"], x["x0"], x["x1"], x["y0"]) for x in got] == [("第一条", 20.0, 35.0, 10.0), ("下行", 25.0, 30.0, 30.0)]


def counting_backend(log):
    """A backend that notes what it does in files, and fails at images that say so."""

    class Engine:
        name = "counting"

        def page(self, image):
            if "bad" in image:
                raise OSError(image)
            return [[[0, 0], [300, 0], [300, 30], [0, 30]]], [image], [0.9]

        def release(self):
            note(log, "release")

    def make():
        note(log, "engine")
        return Engine()

    return make


def note(log, what):
    with open(log, "a") as f:
        f.write(what + "\n")


def test_hosts_are_probed_in_one_barrier_stage(spark):
    got = device.host_table(spark, 3).collect()
    assert [(r.slots, r.cpu_cores > 0) for r in got] == [(3, True)]


def test_graphics_units_are_asked_for_on_a_cluster_only(spark):
    assert device.gpu_profile("local[4]", False, 1) is None and device.gpu_profile("spark://host:7077", False, 0) is None
    shared = device.gpu_profile("spark://host:7077", False, 0.5)
    assert shared.taskResources["gpu"].amount == 0.5 and "gpu" not in shared.executorResources
    own = device.gpu_profile("yarn", True, 1, "/find")
    assert own.executorResources["gpu"].amount == 1 and own.executorResources["gpu"].discoveryScript == "/find"
    assert device.task_device() == "cpu"


def test_the_recognising_stage_alone_has_the_profile(spark, monkeypatch):
    """A profile reaches mapInPandas; in local mode it is left out and the stage runs on the processor."""
    seen = []
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    own = Classic.mapInPandas
    monkeypatch.setattr(Classic, "mapInPandas", lambda self, f, schema, barrier=False, profile=None: seen.append(profile) or own(self, f, schema, barrier))
    wanted = spark.createDataFrame([("a", 1, 72)], "source_path string, page_num int, dpi int")
    pdf.recognise(wanted, None, gpus=1)
    monkeypatch.setattr(device, "gpu_profile", lambda *given: given)
    pdf.recognise(wanted, None, gpus=1)
    assert seen[0] is None and seen[1][2] == 1


def test_lines_start_where_words_leave_the_line(spark):
    """A blank first word, long pages and several pages, against a plain loop."""
    import random

    rng = random.Random(3)
    given = [("d", p, n, rng.choice(["a", "b", " ", ""]) if n else rng.choice([" ", "x"]), float(rng.randrange(12)), float(rng.randrange(50)), float(50 + rng.randrange(50))) for p in range(12) for n in range(60)]
    rows = spark.createDataFrame([(*g, None) for g in given], f"doc_id string, page_num int, word_no int, text string, top double, x0 double, x1 double, chars {CHARS}")
    want = []
    for p in range(12):
        found = []
        for _, _, n, t, top, x0, x1 in (g for g in given if g[1] == p):
            if n == 0 or (t.strip() and abs(top - found[-1][1]) > 3):
                found.append(["", top, x0, x1])
            if t.strip():
                found[-1] = [found[-1][0] + t, found[-1][1], min(found[-1][2], x0), max(found[-1][3], x1)]
        want += [(p, k, *x) for k, x in enumerate(x for x in found if x[0])]
    assert sorted((r.page_num, r.line_no, r.text, r.y0, r.x0, r.x1) for r in words.cluster_words(rows).collect()) == want


def test_recognition_opens_a_file_once_a_batch_and_sends_no_bytes(spark, tmp_path):
    log = str(tmp_path / "log")
    (tmp_path / "a b.pdf").write_bytes(b"content")
    path = f"file:{tmp_path}/a b.pdf"

    def images(content, pages):
        note(log, f"open {content.decode()}")
        for page_num, _ in pages:
            yield ValueError("raster") if page_num == 3 else f"{'bad' if page_num == 2 else 'page'} {page_num}"

    rows = [(path, n, 300) for n in range(1, 8)] + [("file:/no/such.pdf", 1, 300)]
    wanted = spark.createDataFrame(rows, "source_path string, page_num int, dpi int")
    boxes = pdf.recognise(wanted, counting_backend(log), images=images)
    plan = boxes._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.doc_id, r.page_num): (r.rec_texts, r.error) for r in boxes.collect()}
    assert {k[1]: v[0] for k, v in got.items() if v[0]} == {n: [f"page {n}"] for n in (1, 4, 5, 6, 7)}
    assert got[path, 2][1] == "OSError: bad 2" and got[path, 3][1] == "ValueError: raster" and got["file:/no/such.pdf", 1][1]
    noted = open(log).read().split("\n")
    assert noted.count("open content") == 2 and noted.count("engine") == noted.count("release") == 3


def test_pages_that_fail_keep_their_text_and_files_are_whole_or_errors(spark, tmp_path):
    line = lambda text: (text, 72.0, 10.0, 90.0, 20.0, [])
    pages = spark.createDataFrame(
        [("a.pdf", 1, 3, 600.0, 800.0, [line("甲")], [[["k"], ["v"]]], None), ("a.pdf", 2, 3, 600.0, 800.0, [line("乙")], [], None), ("cut.pdf", 1, 500, 600.0, 800.0, [line("x")], [], None), ("cut.pdf", None, None, None, None, None, None, "OSError: page 2")],
        pdf.PAGES,
    )
    recogniser = lambda wanted, backend: pdf.recognise(wanted, backend, images=lambda content, pages: iter(["bad" if n == 1 else "图" for n, _ in pages]), opener=lambda path: b"")
    got = pdf.read_documents(pages, "auto", counting_backend(str(tmp_path / "log")), recogniser).collect()
    assert sorted((r.doc_id, r.page_num, r.text) for r in got) == [("a.pdf", 1, "甲"), ("a.pdf", 2, "图")]
    assert [r.text for r in pdf.read_documents(pages).where("doc_id = 'cut.pdf'").collect()] == []
    files_read = spark.createDataFrame([("a.pdf",), ("cut.pdf",), ("empty.pdf",)], "path string")
    assert sorted(r.doc_id for r in pdf.documents(files_read, pages).collect()) == ["a.pdf", "empty.pdf"]


def test_backends_by_name(spark, tmp_path, monkeypatch, capsys):
    from glossa.sources import backends

    monkeypatch.setattr(backends, "BACKENDS", {})
    backends.register("mine", dict)
    assert backends.named("mine") is dict and backends.named("collections:OrderedDict")() == {}
    for name in ("other", "no_such_module:x", "json:nothing", "json:__name__"):
        with pytest.raises(ValueError):
            backends.named(name)
    assert cli.main(["convert", str(tmp_path / "in.parquet"), "--backend", "other"], spark) == 2
    assert "unknown backend" in capsys.readouterr().err


def test_colliding_outputs_are_errors_and_intermediate_tables_go(spark, tmp_path, capsys, monkeypatch):
    from glossa.sources import shared

    kept = []
    monkeypatch.setattr(shared, "stored", lambda df, own=shared.stored: kept.append(own(df)) or kept[-1])
    table = str(tmp_path / "in.parquet")
    lines(spark, {"x/d": ["第一条 甲。"], "y/d": ["第一条 乙。"], "e": ["第一条 丙。"]}).write.parquet(table)
    assert cli.main(["batch", table, "-o", str(tmp_path / "out"), "--flatten"], spark) == 1
    assert "d.md: 2 documents" in capsys.readouterr().err
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["e.md"]
    assert len(kept) == 2
    for df in kept:
        with pytest.raises(Exception):
            spark.read.parquet(df.stored_at).count()
