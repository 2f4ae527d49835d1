"""Chat formatting with typed content parts.

Method: a visitor flattens text, image, audio and document parts, in order, into one string per turn
with a placeholder for each attachment, and records the attachment's reference and the number of
tokens that its placeholder stands for.  Turns are then framed by a template, and a loss mask
marks the assistant's text.  Only Spark's own functions are used.

A part is a struct (kind, text, ref, size): text parts have ``text``; image, audio and document parts
have ``ref`` and ``size`` (pixels on the longer side, milliseconds, pages).  A part of another
kind, a null part and a null list give nothing; a null text is empty.

Template of a turn: ``<|turn|>role<|text|>text<|end|>`` and a line feed.  Control strings inside texts
and roles are escaped: a backslash is put before each backslash, and inside the opening of each
control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), so that it
no longer occurs; taking away each escaping backslash restores the text.

Turns go by ``turn`` (null first); turns of equal number by role, then text, so repeated rows stay.
A conversation is one output row and is gathered as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpv.llm.common import read_table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Places where a backslash is put: before a backslash, and within each control string.
ESCAPE = r"\\|(?<=<)(?=\||s>|/s>|<SYS>>|</SYS>>)|(?<=\[)(?=/?INST\])"
UNESCAPE = r"\\(.)"
#: Tokens of an attachment: kind -> (units of its size for one step, tokens of a step, tokens at least).
TOKENS = {"image": (32, 8, 64), "audio": (1000, 25, 25), "document": (1, 600, 600)}
PART = "struct<kind:string,text:string,ref:string,size:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)" + UNESCAPE, "$1")


def part_tokens(kind: Column, size: Column) -> Column:
    """The tokens that an attachment's placeholder stands for."""
    out = F.lit(0).cast("long")
    for name, (unit, step, least) in TOKENS.items():
        count = F.greatest(F.lit(least), F.ceil(F.coalesce(size, F.lit(0)) / unit) * step).cast("long")
        out = F.when(kind == name, count).otherwise(out)
    return out


def _visit(part: Column) -> Column:
    """The flattened form of one part."""
    held = F.concat(F.lit("<|"), part["kind"], F.lit(":"), escape(F.coalesce(part["ref"], F.lit(""))), F.lit("|>"))
    return F.when(part["kind"] == "text", escape(F.coalesce(part["text"], F.lit("")))).when(
        part["kind"].isin(*TOKENS), held
    ).otherwise(F.lit(""))


def flatten(turns: DataFrame, parts_col: str = "parts") -> DataFrame:
    """``turns`` with ``flat`` (the escaped text with placeholders), ``attachments`` (array of kind,
    ref, tokens, in order) and ``attachment_tokens``."""
    parts = F.filter(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    held = F.transform(
        F.filter(parts, lambda p: p["kind"].isin(*TOKENS)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p["kind"], p["size"]).alias("tokens")),
    )
    df = turns.withColumns({"flat": F.array_join(F.transform(parts, _visit), ""), "attachments": held})
    return df.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation from flattened ``turns``: ``formatted``, ``loss`` (array of start and
    length in characters: the text of each assistant turn), ``attachments``, ``attachment_tokens``."""
    row = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.col("flat").alias("flat"),
        F.col("attachments").alias("attachments"),
        F.col("attachment_tokens").alias("tokens"),
    )
    # structs sort by turn, role and flat text; the attachments follow from these
    df = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(row), _by_turn).alias("_turns"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
    tail = END + "\n"
    df = df.withColumn(
        "_parts",
        F.transform(
            "_turns",
            lambda t: F.struct(
                F.concat(head(t), t["flat"], F.lit(tail)).alias("whole"),
                F.length(head(t)).alias("before"),
                F.length(t["flat"]).alias("size"),
                (t["role"] == "assistant").alias("learn"),
            ),
        ),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "_parts",
        zero,
        lambda a, p: F.struct(
            (a["at"] + p["before"] + p["size"] + F.lit(len(tail))).alias("at"),
            F.when(
                p["learn"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + p["before"]).alias("start"), p["size"].alias("length")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return df.select(
        conv_col,
        F.array_join(F.transform("_parts", lambda p: p["whole"]), "").alias("formatted"),
        spans.alias("loss"),
        F.flatten(F.transform("_turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("_turns", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("attachment_tokens"),
    )


def _by_turn(a: Column, b: Column) -> Column:
    def less(x: Column, y: Column) -> Column:
        return F.when(x < y, -1).when(x > y, 1)

    null = F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
    return F.coalesce(null, less(a["turn"], b["turn"]), less(a["role"], b["role"]), less(a["flat"], b["flat"]), F.lit(0))


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with ``turns`` (array of role, text) and ``learned`` (the unescaped text under the
    loss mask), both parsed from ``formatted`` alone and its mask."""
    pieces = F.filter(F.split("formatted", F.lit(r"<\|turn\|>")), lambda x: x != "")
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(x, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return chats.withColumns({"turns": turns, "learned": F.array_join(learned, "")})


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation of ``conversations`` and conversation -7: figures and digests read back from
    the formatted text."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    part = F.struct(
        F.lit("text").alias("kind"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")
    )
    turns = rows.unionByName(extra).withColumn("parts", F.array(part)).drop("text")
    back = read_back(format_chats(flatten(turns)))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(text)
    + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '<|', '<')))
    + (length(text) - length(replace(text, '<s>', 's>')))
    + (length(text) - length(replace(text, '</s>', '/s>')))
    + (length(text) - length(replace(text, '[INST]', 'INST]')))
    + (length(text) - length(replace(text, '[/INST]', '/INST]')))
    + (length(text) - length(replace(text, '<<SYS>>', '<SYS>>')))
    + (length(text) - length(replace(text, '<</SYS>>', '</SYS>>'))) AS n_escaped
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_escaped + length(role) + length('<|turn|><|text|><|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
