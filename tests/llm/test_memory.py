import os
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from glossa.llm import common, decontaminate, substrings


def resident_mb() -> float:
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_a_task_returns_what_it_has_freed():
    pinned, most = [], []

    def mapper(batches):
        for batch in batches:
            held = [np.ones(8_000) for _ in range(4_000)]  # below malloc's own maps: 256 MB
            pinned.append(np.ones(8_000))
            most.append(resident_mb())
            del held
            yield batch

    batch = pa.RecordBatch.from_pydict({"x": [1]})
    before = resident_mb()
    assert list(common.tidy(mapper)(iter([batch]))) == [batch]
    assert most[0] - before > 200
    assert resident_mb() - before < 100


def test_windows_read_words_from_one_array(spark):
    rows = spark.createDataFrame([(0, None), (1, []), (2, [5]), (3, [5, 6, 7, 8]), (4, [1, 5, 6, 7, 8])], "doc long, h array<long>")
    found = decontaminate.windows(rows, ["doc"], {"1": F.col("size") == 1, "1111": F.lit(True)})
    assert "arrays_zip" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc, r.place): r.seed for r in found.collect()}
    assert set(got) == {(2, 0), (3, 0), (4, 0), (4, 1)}
    assert got[3, 0] == got[4, 1] != got[4, 0]


def test_windows_are_settled_in_few_bytes_each():
    rng = np.random.default_rng(3)
    n, docs = 3_000, 100
    names = np.array([(i, 0) for i in range(docs)], dtype=substrings.NAME)
    # windows of the first documents come again, so that some are settled here
    found = [(rng.integers(0, 2**64, n, dtype=np.uint64), rng.integers(0, 2**16, n).astype(np.uint16)) for _ in range(docs // 2)]
    found += [(k.copy(), e.copy()) for k, e in found]
    tracemalloc.start()
    sizes = [b.nbytes for b in substrings.in_batches(substrings.settle(names, found, [np.zeros(2, np.int32)] * docs, 13, 8, 12))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n * docs
    assert len(sizes) > 1 and max(sizes) < 2 * substrings.PACKED


def test_a_batch_has_few_bytes_unless_the_session_says_so(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    one = spark.newSession()
    common.small_batches(one)
    assert int(one.conf.get(key).rstrip("b")) == common.BATCH_BYTES
    other = spark.newSession()
    other.conf.set(key, "1m")
    common.small_batches(other)
    assert other.conf.get(key) == "1m"
    rows = one.range(40).select(F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1)
    count = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()
    assert sum(r.n for r in count) == 40 and max(r.n for r in count) < 10
