"""Chat formatting in Spark expressions only.

A conversation's rows are collected as structs and sorted by (turn, role, text), nulls last. A run of turns of one role
is a block: the places where the role changes cut the sorted array into slices, and each slice's texts are aggregated
into one text (array_join). Blocks are concatenated:

    <|start|>role<|msg|>text[<|next|>text ...]<|end|>

Control strings inside roles and texts - those of this template, and `<s>`, `</s>`, `[INST]`, `[/INST]`, `<SYS>`,
`</SYS>` and anything that begins `<|` - get a `~` after their bracket, one more if they have some; reading takes one
away, so the format is reversible for any text.

The loss covers the texts of assistant blocks. Null turn sorts last, null role is the empty role, null text the
empty text, and a null conv_id is a conversation of its own. Repeated rows are turns like others. A conversation's
turns must fit in one row, as its formatted text does; collecting is partly done before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm.common import read_table

START, MSG, NEXT, END = "<|start|>", "<|msg|>", "<|next|>", "<|end|>"
CONTROL = r"(\||/?s>|/?INST\]|/?SYS>)"
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])(~*)" + CONTROL), F.lit("$1~$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"([<\[])~(~*)" + CONTROL), F.lit("$1$2$3"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted for rows (conv_id, turn, role, text)."""
    one = F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = sorted_.select("conv_id", merge_runs(F.col("turns")).alias("blocks"))
    return merged.select("conv_id", F.array_join(F.transform("blocks", lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(MSG), b["text"], F.lit(END))), "").alias("formatted"))


def merge_runs(turns: Column) -> Column:
    """array<struct<role, text>>: one block for each run of turns of one role, its escaped texts joined by the turn separator."""
    places, role = F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["role"]
    first = F.filter(places, lambda i: (i == 0) | (role(i - 1) != role(i)))
    last = F.filter(places, lambda i: (i + 1 == F.size(turns)) | (role(i) != role(i + 1)))
    texts = lambda a, b: F.transform(F.slice(turns, a + 1, b - a + 1), lambda t: escape(t["text"]))
    return F.zip_with(first, last, lambda a, b: F.struct(role(a).alias("role"), F.array_join(texts(a, b), NEXT).alias("text")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the formatted text, unescaped, one element for each original turn."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(START) + 1)), r"<\|msg\|>", -1)
        role = unescape(F.get(halves, F.lit(0)))
        return F.transform(F.split(F.get(halves, F.lit(1)), r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(turns: Column) -> Column:
    """All text under the loss: the assistant's, in order, nothing between."""
    return F.concat_ws("", F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table's rows and conversation -7, whose texts consist of control strings."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = format_conversations(with_probe(read_table(spark, sf_dir, "conversations"))).select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = loss_text(F.col("turns"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace({}, '([<\[])(~*)(\||/?s>|/?INST\]|/?SYS>)', '\1~\2\3', 'g')"
OP2_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), t AS (
  SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before, lead(role) OVER o AS after
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)
), f AS (
  SELECT *, (CASE WHEN before IS NOT DISTINCT FROM role THEN '{NEXT}' ELSE '{START}' || {_ESCAPED.format("role")} || '{MSG}' END)
            || {_ESCAPED.format("text")} || (CASE WHEN after IS NOT DISTINCT FROM role THEN '' ELSE '{END}' END) AS piece
  FROM t
)
SELECT conv_id, count(*)::bigint AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(piece))::bigint AS formatted_chars
FROM f GROUP BY conv_id
"""
