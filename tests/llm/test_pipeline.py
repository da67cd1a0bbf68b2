import random

import corpus_pipeline
from glossa.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder, docs, labels, benchmark):
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    good = [text(rng.randrange(30, 150)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in text(60).split()) for _ in range(60)]
    passage, item = text(70), text(25)
    docs = {i: t for i, t in enumerate(good)} | {400 + i: t for i, t in enumerate(bad)}
    docs |= {500 + i: docs[i] + " more" for i in range(5)}
    docs |= {600 + i: text(60) + "\n" + passage + "\n" + text(60) for i in range(4)}
    docs |= {700 + i: text(30) + " " + item + " " + text(30) for i in range(3)}
    docs |= {800: None, 801: ""}
    labels = [(i, int(i < 400), 0) for i in docs if i < 460 and i % 2]
    return docs, labels, passage, item


def test_each_stage_takes_effect_and_keeps_clean_documents(spark, tmp_path):
    docs, labels, passage, item = corpus()
    folder = str(tmp_path)
    write(spark, folder, [(i, t, "en", "s", len(t or "")) for i, t in docs.items()], labels, [(9, item)])
    now, seen = common.table(spark, folder, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        if k < 4:
            assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
            assert out.schema == now.schema
        out.write.parquet(f"{folder}/{name}")
        now = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    kept = seen["quality"]
    assert not [i for i in kept if 400 <= i < 460] and len([i for i in kept if i < 300]) >= 295
    assert not [i for i in seen["near_duplicates"] if 500 <= i < 505 and i - 500 in kept]
    assert {i for i in kept if not 500 <= i < 505} == {i for i in seen["near_duplicates"] if not 500 <= i < 505}
    cut = seen["substrings"]
    assert passage in cut[600].text and all(passage not in cut[i].text and cut[i].n_chars == len(cut[i].text) for i in (601, 602, 603) if i in cut)
    assert all(cut[i].text == docs[i] for i in cut if i < 300)
    assert {i for i in cut if not 700 <= i < 703} == set(seen["decontamination"])
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert corpus_pipeline.run(spark, folder).count() == spark.read.parquet(f"{folder}/packing").count()


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []


def test_nulls_repeats_and_extra_columns(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(1, "a b c", "en", None, None), (1, "a b c", "en", None, None), (None, "x y z", None, "s", 5), (None, None, None, None, None), (2, "w " * 9000, "en", "s", 1)]
    write(spark, folder, rows, [(1, 1, 0), (None, 1, 0), (2, None, None)], [(None, None), (1, "short")])
    docs = common.table(spark, folder, "documents").selectExpr("*", "1 as bucket", "'k' as kind", "n_chars as rep")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.stored(stage(spark, docs, folder))
        assert out.count() >= 0
        if k < 4:
            assert out.columns == docs.columns
            docs = out


def test_rows_without_an_id_and_repeated_rows_do_not_escape(spark, tmp_path):
    folder = str(tmp_path)
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (1, "other words", "en", "s", 11), (None, "x y z", "en", "s", 5), (None, "x y z", "en", "s", 5), (None, "u v w", "en", "s", 5), (2, "clean", "en", "s", 5)]
    write(spark, folder, rows + [(None, item, "en", "s", 50)], [], [(1, item)])
    docs = common.table(spark, folder, "documents")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    assert sorted(((r.doc_id, r.text) for r in near.collect()), key=str) == sorted({r[:2] for r in rows} | {(None, item)}, key=str)
    left = corpus_pipeline.decontamination_stage(spark, near, folder)
    assert near.schema == docs.schema and left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 1, 2]
