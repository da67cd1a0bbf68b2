"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut into windows that each start and end between turns.
Prefix sums of the turns' token counts place a turn: with ``room`` tokens left
for new turns (the budget without the history and the system turn), a turn that
starts at s and ends at e belongs to span s div room; one that runs past the
span's end is a window of its own.  So no window exceeds its room unless a
single turn does (``over_budget``).  Each later window repeats the system turn
and the whole turns that start within the last ``history`` tokens before it.
The loss mask covers the texts of new assistant turns: repeated ones are masked.

Template: ``<|turn|>role\\ntext<|end|>\\n`` a turn.  A backslash doubles, and one
is put after the first character of ``<|``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``, ``<<SYS>>``, ``<</SYS>>`` and before a line end in a role; reading
drops the backslash of every pair.

Tokens are counted as runs of ASCII word characters and single other marks.

Defined cases: rows go by turn, then role, then text, nulls first; a null role
or text is an empty one; rows with a null conv_id are one conversation;
repeated rows are turns of their own; only a first turn by ``system`` is a
system turn; a very long turn is a window of its own; an empty table gives none;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>\n"

#: markers, role and line end of a turn
TURN_TOKENS = 6

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]"
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, *, budget: int = 1024, history: int = 192, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per window: conv_id, window_id, formatted, loss (start and length of each span), n_repeated, n_new, n_tokens, over_budget."""
    by_conv = Window.partitionBy("conv")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = by_conv.orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("is_system", (F.col("pos") == 1) & (F.col("role") == "system"))
    head = F.concat(F.lit(TURN), F.regexp_replace(escape(F.col("role")), "\n", "\\\\\n"), F.lit("\n"))
    rows = rows.select("conv", "pos", "role", "is_system", head.alias("head"), escape(F.col("text")).alias("body"))
    tokens = (F.regexp_count("body", F.lit(TOKEN)) + TURN_TOKENS).cast("long")
    rows = rows.withColumn("tokens", tokens).withColumn("seg", F.concat("head", "body", F.lit(END)))
    in_order = by_conv.orderBy("pos")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).over(so_far).alias("e"),
        F.max(F.when(F.col("is_system"), F.col("seg"))).over(so_far).alias("system"),
        F.coalesce(F.max(F.when(F.col("is_system"), F.col("tokens"))).over(so_far), F.lit(0)).alias("system_tokens"),
    )
    rows = rows.withColumn("s", F.col("e") - F.when(F.col("is_system"), 0).otherwise(F.col("tokens"))).withColumn("room", F.greatest(F.lit(budget - history) - F.col("system_tokens"), F.lit(1)))
    span = F.expr("s div room")
    rows = rows.withColumn("window_id", 2 * span + F.when(F.col("e") > (span + 1) * F.col("room"), 1).otherwise(0))
    # a system turn opens the window of the turn after it
    rows = rows.withColumn("window_id", F.when(F.col("is_system"), F.coalesce(F.lead("window_id").over(in_order), F.col("window_id"))).otherwise(F.col("window_id")))
    rows = rows.withColumn("opens", F.coalesce(F.lag("window_id").over(in_order) != F.col("window_id"), F.lit(True)))
    # the row order of s holds the system turn and the first turn at 0
    near = by_conv.orderBy("s").rangeBetween(-history, -1)
    back = F.collect_list(F.when(~F.col("is_system"), F.struct("pos", "seg", "tokens"))).over(near)
    rows = rows.withColumn("back", F.when(F.col("opens"), F.array_sort(back)))
    lead_in = F.when(F.col("opens") & (F.col("pos") > 1), F.concat(F.coalesce("system", F.lit("")), F.array_join(F.transform("back", lambda x: x["seg"]), "")))
    rows = rows.withColumn("lead_in", F.coalesce(lead_in, F.lit("")))
    rows = rows.withColumn("repeats", F.when(F.col("opens") & (F.col("pos") > 1), F.size("back") + F.col("system").isNotNull().cast("int")).otherwise(0))
    rows = rows.withColumn("extra", F.when(F.col("opens") & (F.col("pos") > 1), F.aggregate("back", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]) + F.col("system_tokens")).otherwise(F.lit(0)))
    in_window = Window.partitionBy("conv", "window_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("shown", F.concat("lead_in", "seg")).withColumn("stop", F.sum(F.length("shown")).over(in_window))
    target = F.when(F.col("role") == "assistant", F.struct((F.col("stop") - len(END) - F.length("body")).cast("int").alias("start"), F.length("body").alias("length")))
    windows = rows.groupBy("conv", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("parts"),
        F.array_sort(F.collect_list(target)).alias("loss"),
        F.max("repeats").alias("n_repeated"),
        F.count(F.lit(1)).cast("int").alias("n_new"),
        (F.sum("tokens") + F.sum("extra")).alias("n_tokens"),
    )
    formatted = F.array_join(F.transform("parts", lambda x: x["shown"]), "")
    return windows.select(F.col("conv").alias(conv_col), "window_id", formatted.alias("formatted"), "loss", F.col("n_repeated").cast("int").alias("n_repeated"), "n_new", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_chats(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """What formatted windows hold, a row per window: its new turns and its texts under the loss mask."""
    segments = F.split("formatted", r"<\|end\|>\n")
    new = F.slice(segments, F.col("n_repeated") + 1, F.col("n_new"))
    head = r"(?s)^<\|turn\|>((?:[^\\\n]++|\\.)*+)\n"

    def turn(seg: Column) -> Column:
        role = F.regexp_extract(seg, head, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(seg, F.length(role) + len(TURN) + 2)).alias("text"))

    masked = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["length"])))
    return windows.select(conv_col, "window_id", F.transform(new, turn).alias("turns"), masked.alias("targets"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_chats(windows, conv_col=conv_col).select(conv_col, F.struct("window_id", line.alias("said"), F.array_join("targets", "").alias("loss")).alias("part"), F.size("turns").cast("long").alias("n"), F.col("chars").cast("long").alias("chars"))
    whole = read.groupBy(conv_col).agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"), F.sum("chars").alias("formatted_chars"))
    said, loss = (F.array_join(F.col(f"parts.{k}"), "") for k in ("said", "loss"))
    return whole.select(conv_col, "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(\||/?s>|</?SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g') AS body
  FROM t0
), t2 AS (
  SELECT *, pos = 1 AND role = 'system' AS is_system, 8 + length(role) + 1 + length(body) + 8 AS chars,
    len(regexp_extract_all(body, '[A-Za-z0-9_]+|[^A-Za-z0-9_\x09-\x0D\x20]')) + 6 AS tokens
  FROM t1
), t3 AS (
  SELECT *, CASE WHEN is_system THEN 0 ELSE tokens END AS own,
    max(CASE WHEN is_system THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars,
    greatest(1024 - 192 - max(CASE WHEN is_system THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id), 1) AS room
  FROM t2
), t4 AS (
  SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos) AS e, sum(own) OVER (PARTITION BY conv_id ORDER BY pos) - own AS s FROM t3
), t5 AS (
  SELECT *, 2 * (s // room) + CASE WHEN e > (s // room + 1) * room THEN 1 ELSE 0 END AS w0 FROM t4
), t6 AS (
  SELECT *, CASE WHEN is_system THEN coalesce(lead(w0) OVER (PARTITION BY conv_id ORDER BY pos), w0) ELSE w0 END AS w FROM t5
), t7 AS (
  SELECT *, coalesce(lag(w) OVER (PARTITION BY conv_id ORDER BY pos) <> w, true) AS opens FROM t6
), back AS (
  SELECT a.conv_id, a.pos, sum(b.chars) AS chars FROM t7 a JOIN t7 b ON a.conv_id = b.conv_id AND NOT b.is_system AND b.s >= a.s - 192 AND b.s < a.s
  WHERE a.opens GROUP BY ALL
)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(t.role || chr(10) || t.text || chr(10), '' ORDER BY t.pos)) AS turns_sha256,
  CAST(sum(CASE WHEN t.role = 'assistant' THEN length(t.text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t.text, '' ORDER BY t.pos) FILTER (t.role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(t.chars) + sum(CASE WHEN t.opens AND t.pos > 1 THEN t.sys_chars + coalesce(b.chars, 0) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t7 t LEFT JOIN back b ON b.conv_id = t.conv_id AND b.pos = t.pos
GROUP BY t.conv_id
"""
