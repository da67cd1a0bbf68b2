import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from glossa.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    found = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        found[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return found


def digested(spark, rows, **how):
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), **how)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}


TEXT = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<|", "<|end|>\n", "<|turn|>", "\\", "\\\\", "\n", "ok", " word", "é", "𝔘", "<", "[", "<<SYS>>", "|>"]), max_size=12).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from(["system", "user", "assistant", "a\nb\\", None]), st.one_of(st.none(), TEXT)), min_size=1, max_size=14))
def test_reads_back_any_text(spark, turns):
    rows = [(conv, i, role, text) for i, (conv, role, text) in enumerate(turns)]
    assert digested(spark, rows, budget=60, history=25) == expected(rows)


def test_windows_keep_the_budget_and_the_system_turn(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"word{i} " * 8) for i in range(1, 40)]
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), budget=80, history=30).orderBy("window_id").collect()
    assert len(windows) > 3
    assert all(not w.over_budget and w.n_tokens <= 80 for w in windows)
    assert all(w.formatted.startswith("<|turn|>system\nbe kind<|end|>\n") for w in windows)
    assert sum(w.n_new for w in windows) == 40
    assert all(w.n_repeated > 1 for w in windows[1:])
    masked = "".join(w.formatted[s.start : s.start + s.length] for w in windows for s in w.loss)
    assert masked == "".join(r[3] for r in rows if r[2] == "assistant")


def test_a_turn_longer_than_the_budget_is_whole_and_alone(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "long " * 300), (1, 2, "user", "bye")]
    windows = chat.format_chats(spark.createDataFrame(rows, SCHEMA), budget=64, history=16).orderBy("window_id").collect()
    assert [w.over_budget for w in windows] == [False, True, False]
    assert digested(spark, rows, budget=64, history=16) == expected(rows)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(None, None, None, None), (None, 1, "assistant", "x")],
        [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "a"), (1, 0, "assistant", "b")],
        [(1, 0, "assistant", "")],
        [(1, 0, "system", "only")],
        [(1, 0, "assistant", "very long " * 20000)],
    ],
)
def test_edges(spark, rows):
    assert digested(spark, rows) == expected(rows)


def test_other_columns_do_not_clash(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "z"), (1, 1, "assistant", "b", 6, "y")], SCHEMA + ", pos int, seg string").withColumnRenamed("seg", "window_id")
    assert chat.digests(chat.format_chats(rows)).count() == 1


def test_plan_is_native(spark):
    plan = chat.digests(chat.format_chats(spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
