from __future__ import annotations

from collections import defaultdict

from tessera.llm import chat

TALKS = [
    (1, 0, "system", "be [INST] kind </s>"), (1, 1, "user", "a\\b \\l <s>[x]"), (1, 2, "assistant", "é😀 \\s\n[/INST]"), (1, 3, "user", "more"), (1, 4, "assistant", ""), (1, 5, "user", "last"),
    (2, 0, "user", "no reply"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, 0, "tool]<", None), (4, 0, None, "x"), (4, None, "assistant", "first"), (None, 0, "assistant", "lost"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(rows):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in talks.items()}


def test_examples_round_trip(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TALKS, SCHEMA)
    found = defaultdict(list)
    made = chat.examples(df).withColumn("turns", chat.read_back(F.col("formatted")))
    for r in made.orderBy("conv_id", "example").collect():
        found[r.conv_id].append(r)
    for conv, turns in turns_of(TALKS).items():
        replies = [k for k, (role, _) in enumerate(turns) if role == "assistant"]
        tail = [] if turns[-1][0] == "assistant" else [len(turns) - 1]
        assert len(found[conv]) == len(replies + tail)
        for r, upto in zip(found[conv], replies + tail):
            assert [(t.role, t.text) for t in r.turns] == turns[: upto + 1]
            raw = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
            for shown, safe in (("[", "\\b"), ("]", "\\c"), ("<", "\\l"), ("\\", "\\s")):
                raw = raw.replace(safe, shown)
            assert raw == (turns[upto][1] if upto in replies else "")
            assert r.whole == (upto == len(turns) - 1)


def test_no_text_holds_control_strings(spark):
    probe = "</s>[INST] ok [/INST]"
    (row,) = chat.examples(spark.createDataFrame([(1, 0, "user", probe), (1, 1, "assistant", probe)], SCHEMA)).collect()
    assert row.formatted.count("</s>") == 2 and row.formatted.count("[") == 2 and "INST]" not in row.formatted


def test_query_equals_its_sql(spark, sf_dir, duck, rows):
    path = sf_dir(conversations=spark.createDataFrame([(*t, "x") for t in TALKS], SCHEMA + ", formatted string"))
    got = rows(chat.op9_chat(spark, path))
    assert got == duck(path, chat.ORACLE_SQL) and len(got) == 6


def test_empty_table_and_long_conversation(spark, sf_dir):
    assert chat.examples(spark.createDataFrame([], SCHEMA)).count() == 0
    long = [(7, k, ["user", "assistant"][k % 2], f"turn {k} " * 20) for k in range(300)]
    assert chat.examples(spark.createDataFrame(long, SCHEMA)).count() == 150
