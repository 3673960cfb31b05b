"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, and that reply alone trainable.  Turns that follow the last reply
(or a conversation without one) make a final example with nothing trainable,
so the output holds every turn.

Template: each turn is ``<s>[role]text</s>``.  Inside roles and texts the
characters that control strings are made of are written as two characters
(``\\`` as ``\\s``, ``<`` as ``\\l``, ``[`` as ``\\b``, ``]`` as ``\\c``), so no
text can hold ``<s>``, ``</s>`` or ``[...]``, and reading back is exact.

A conversation is one group: its turns are ordered by number, then role, then
text, and repeated rows are repeated turns.  A null role or text is empty, a
null turn comes first, rows with a null id form one conversation.  Further
columns are ignored; an empty table gives no examples.  An example's size is
the size of its conversation, which is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

TRAINED_ROLE = "assistant"
_ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))


def escape(text: Column) -> Column:
    for raw, safe in _ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def examples(turns: DataFrame) -> DataFrame:
    """One row for each example of ``turns(conv_id, turn, role, text)``.

    ``(conv_id, example, formatted, loss_start, loss_chars, whole)``: the
    trainable span in code points, and whether the example holds every turn.
    """
    empty = F.lit("")
    one = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit("<s>["), escape(t["role"]), F.lit("]"), escape(t["text"]), F.lit("</s>")))
    replies = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (F.get("turns", i - 1)["role"] == TRAINED_ROLE) | (i == F.size("turns")))
    each = talks.select("conv_id", "turns", shown.alias("shown"), F.posexplode(replies).alias("example", "upto"))
    last, before = F.get("turns", F.col("upto") - 1), F.array_join(F.slice("shown", F.lit(1), F.col("upto") - 1), "")
    trained = last["role"] == TRAINED_ROLE
    head = F.length(F.concat(F.lit("<s>["), escape(last["role"]), F.lit("]")))
    return each.select(
        "conv_id",
        "example",
        F.concat(before, F.get("shown", F.col("upto") - 1)).alias("formatted"),
        F.when(trained, F.length(before) + head).otherwise(0).alias("loss_start"),
        F.when(trained, F.length(escape(last["text"]))).otherwise(0).alias("loss_chars"),
        (F.col("upto") == F.size("turns")).alias("whole"),
    )


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted text."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    edge = lambda p: F.instr(p, F.lit("]"))
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring(p, F.lit(5), edge(p) - 5)).alias("role"), unescape(F.substring(p, edge(p) + 1, F.length(p))).alias("text")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the formatted conversations say when they are read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = examples(turns.unionByName(extra))
    loss = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    said = made.select("conv_id", "example", F.length("formatted").cast("long").alias("size"), loss.alias("loss"), F.when(F.col("whole"), read_back(F.col("formatted"))).alias("turns"))
    whole = said.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.sum("size").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"))
    lost = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")


def _oracle() -> str:
    safe = lambda x: f"replace(replace(replace(replace({x}, '\\', '\\s'), '<', '\\l'), '[', '\\b'), ']', '\\c')"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n, sum(length({safe('role')}) + length({safe('text')}) + 9) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE role = 'assistant' OR pos = n)::BIGINT AS formatted_chars FROM o GROUP BY conv_id"""  # fmt: skip


ORACLE_SQL = _oracle()
