import random

from pyspark.sql import functions as F

from gridpv.llm import chat_format as cf

HARD = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "a\\b\\\\", "<\\|end|>", "<<SYS>>\n<</SYS>>", "<", "\\", "", None, "line\nline", "😀<s>é"]


def chats(spark, rows):
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    return cf.read_back(cf.format_chats(cf.flatten(turns)))


def text(t):
    return ("text", t, None, None)


def test_any_text_comes_back(spark):
    rnd = random.Random(1)
    pool = ["<", "|", ">", "s", "/", "[", "]", "INST", "\\", "SYS", "turn", "\n", "é", "<|end|>", "$1"]
    texts = HARD + ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(300)]
    rows = [(i, n, r, [text(t)]) for i, t in enumerate(texts) for n, r in enumerate(["user", "assistant", "<|text|>\\", None])]
    for r in chats(spark, rows).collect():
        t = texts[r["conv_id"]] or ""
        assert [tuple(x) for x in r["turns"]] == [("user", t), ("assistant", t), ("<|text|>\\", t), ("", t)]
        assert r["learned"] == t
        for control in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in r["formatted"]
        assert r["formatted"].count("<|turn|>") == 4


def test_typed_parts_become_placeholders(spark):
    parts = [text("see "), ("image", None, "a.png", 640), text(" and "), ("audio", None, "b<|end|>.wav", 2500), ("document", None, "c.pdf", 3), ("video", "x", "d", 1), None]
    row = chats(spark, [(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "user", [])]).first()
    assert [tuple(a) for a in row["attachments"]] == [("image", "a.png", 160), ("audio", "b<|end|>.wav", 75), ("document", "c.pdf", 1800)]
    assert row["attachment_tokens"] == 160 + 75 + 1800
    assert row["formatted"].startswith("<|turn|>assistant<|text|>see <|image:a.png|> and <|audio:b<\\|end|>.wav|><|document:c.pdf|><|end|>\n")
    assert len(row["turns"]) == 3


def test_order_ties_and_empty(spark):
    rows = [(1, 2, "user", [text("z")]), (1, None, "user", [text("first")]), (1, 1, "user", [text("b")]), (1, 1, "user", [text("a")]), (1, 1, "user", [text("a")])]
    assert [t["text"] for t in chats(spark, rows).first()["turns"]] == ["first", "a", "a", "b", "z"]
    assert chats(spark, []).count() == 0


def test_query_on_whole_table_is_native(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>"), (2, 0, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("flat", F.lit("x")).write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    df = cf.op6_chat_format(spark, str(tmp_path))
    assert {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in df.collect()} == {1: (2, 4), 2: (1, 0), -7: (2, 21)}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
