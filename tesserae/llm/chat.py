"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns are marked ``<|turn|>role\ntext<|end|>\n``. Control strings inside roles and texts are broken by a backslash, and
backslashes doubled, so that unescaping gives the input back. Prefix sums of turn tokens choose spans of whole turns
under a budget; each window repeats the system turn and limited history before its span. Only assistant texts of the
span are under the loss mask, so a repeated turn is never a target twice. A conversation's windows hold its turns once
(plus that history); window sizes follow the budget, not the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens: up to six letters of a word, a digit, a mark. White space is none.
TOKEN = r"[\p{L}\p{M}]{1,6}|\p{N}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]"
#: Tokens of a window, of its history, and turns of history at most. A turn costs the tokens of its role and text, and OVERHEAD.
BUDGET, HISTORY, HISTORY_TURNS, OVERHEAD = 2048, 256, 4, 4
TURN, END = "<|turn|>", "<|end|>\n"
#: Strings that no escaped text holds; the backslash goes after the first character (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """(conv_id, window, n_context, formatted, loss_spans): one row a window, ``loss_spans`` in code points of ``formatted``.

    ``n_context`` leading turns repeat what an earlier window holds. Turns go by turn, then role and text; null turns come
    first, null roles and texts are empty, a null conv_id is a conversation, repeated rows are turns of their own. A turn
    that is alone beyond the budget gets a window of its own. Other columns are ignored.
    """
    first = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    cost = F.regexp_count("role", F.lit(TOKEN)) + F.regexp_count("text", F.lit(TOKEN)) + OVERHEAD
    rows = rows.withColumn("sum", F.sum(cost).over(first.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pos", F.row_number().over(first) - 1)
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sum", "role", "text"))).alias("turns"))
    has_system = F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0)
    system = F.when(has_system == 1, F.col("turns")[0]["sum"]).otherwise(F.lit(0))
    # starts of the spans: a new span where the prefix sum since the last start would pass the room beside system turn and history
    room = F.greatest(F.lit(1), F.lit(budget - history) - system)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("last"), F.array(F.lit(0)).alias("starts")),
        lambda s, t: F.when(
            (t["sum"] - s["base"] > F.col("room")) & (t["pos"] > F.element_at(s["starts"], -1)),
            F.struct(s["last"].alias("base"), t["sum"].cast("long").alias("last"), F.concat(s["starts"], F.array(t["pos"])).alias("starts")),
        ).otherwise(F.struct(s["base"].alias("base"), t["sum"].cast("long").alias("last"), s["starts"].alias("starts"))),
    )
    planned = whole.withColumn("has_system", has_system).withColumn("room", room).withColumn("starts", spans["starts"])
    n = F.size("turns")

    def window(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get("starts", i + 1), n)
        before = F.when(start > 0, F.col("turns")[start - 1]["sum"]).otherwise(0)
        back = F.size(F.filter(F.sequence(F.lit(1), F.lit(max(1, history_turns))), lambda h: (start - h >= F.col("has_system")) & (F.lit(history_turns) > 0) & (before - F.coalesce(F.get("turns", start - h - 1)["sum"], F.lit(0)) <= history)))
        kept = F.when(start > 0, F.slice("turns", 1, F.col("has_system"))).otherwise(F.slice("turns", 1, 0))
        context = F.when(start > 0, F.col("has_system") + back).otherwise(0)
        return F.struct(i.alias("window"), context.alias("n_context"), F.concat(kept, F.slice("turns", start - back + 1, end - start + back)).alias("turns"))

    cut = planned.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    marked = F.transform("turns", lambda t, i: F.struct((i >= F.col("n_context")) & (t["role"] == "assistant"), F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n")), escape(t["text"])))
    cut = cut.select("conv_id", "window", "n_context", marked.cast("array<struct<loss:boolean,head:string,body:string>>").alias("parts"))
    cut = cut.withColumn("sizes", F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)))
    at = F.transform("parts", lambda p, i: F.struct(p["loss"].alias("loss"), (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length")))
    loss = F.transform(F.filter(at, lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length")))
    return cut.select("conv_id", "window", "n_context", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), loss.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns: role, newline, text, newline of each, loss: all text under the mask, formatted_chars) from windows."""
    pieces = F.split("formatted", r"<\|end\|>\n")
    bodies = F.transform(F.slice(pieces, F.col("n_context") + 1, F.size(pieces) - 1 - F.col("n_context")), lambda p: F.substring(p, len(TURN) + 1, F.length(p)))

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        return F.concat(unescape(role), F.lit("\n"), unescape(F.substring(p, F.length(role) + 2, F.length(p))), F.lit("\n"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    read = formatted.select("conv_id", F.struct("window", F.size(bodies).alias("n"), F.array_join(F.transform(bodies, turn), "").alias("turns"), loss.alias("loss"), F.length("formatted").alias("chars")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("w.n").alias("n_turns"), F.sum("w.chars").alias("formatted_chars"))
    return whole.select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"), F.array_join("w.loss", "").alias("loss"), "formatted_chars")


def with_control(conversations: DataFrame) -> DataFrame:
    """The conversations and -1, whose texts are control strings."""
    said = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def op4_chat_windows(spark, sf_dir: str) -> DataFrame:
    """All conversations and -1, formatted and read back."""
    read = read_back(windows(with_control(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))
    return read.select("conv_id", F.col("n_turns").cast("long"), F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


ORACLE = r"""
WITH RECURSIVE said AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
 turns AS (
  SELECT *, row_number() OVER o - 1 AS pos, SUM(len(regexp_extract_all(role, '""" + TOKEN + r"""')) + len(regexp_extract_all(text, '""" + TOKEN + r"""')) + 4) OVER o AS total,
         length(role) + length(text) + length('<|turn|>') + 1 + length('<|end|>') + 1
         + len(regexp_extract_all(role || chr(1) || text, '\\|<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>')) + len(regexp_extract_all(role, '\n')) AS chars
  FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 sys AS (
  SELECT conv_id, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS has, CASE WHEN role = 'system' THEN chars ELSE 0 END AS chars,
         GREATEST(1, 2048 - 256 - CASE WHEN role = 'system' THEN total ELSE 0 END) AS room FROM turns WHERE pos = 0),
 walk AS (
  SELECT conv_id, pos, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS base, total FROM turns WHERE pos = 0
  UNION ALL
  SELECT t.conv_id, t.pos, CASE WHEN t.total - w.base > s.room AND t.pos > w.start THEN t.pos ELSE w.start END,
         CASE WHEN t.total - w.base > s.room AND t.pos > w.start THEN w.total ELSE w.base END, t.total
  FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.pos = w.pos + 1 JOIN sys s ON s.conv_id = t.conv_id),
 starts AS (SELECT DISTINCT conv_id, start, base FROM walk WHERE start > 0),
 repeated AS (
  SELECT t.conv_id, SUM(t.chars) AS chars FROM starts p JOIN sys s ON s.conv_id = p.conv_id
  JOIN turns t ON t.conv_id = p.conv_id AND t.pos < p.start AND t.pos >= s.has AND t.pos >= p.start - 4
   AND p.base - COALESCE((SELECT b.total FROM turns b WHERE b.conv_id = t.conv_id AND b.pos = t.pos - 1), 0) <= 256 GROUP BY 1),
 system_again AS (SELECT p.conv_id, COUNT(*) * MAX(s.chars) AS chars FROM starts p JOIN sys s ON s.conv_id = p.conv_id GROUP BY 1),
 whole AS (
  SELECT conv_id, COUNT(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS turns,
         COALESCE(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss, SUM(chars) AS chars FROM turns GROUP BY 1)
SELECT w.conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(w.chars + COALESCE(r.chars, 0) + COALESCE(a.chars, 0) AS BIGINT) AS formatted_chars
FROM whole w LEFT JOIN repeated r ON r.conv_id = w.conv_id LEFT JOIN system_again a ON a.conv_id = w.conv_id
"""
