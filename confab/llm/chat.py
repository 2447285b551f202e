"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all preceding turns as context and the assistant's reply as its only trainable part; the last turns of a conversation
that does not end with a reply form one more example without a trainable part, so nothing is lost. A turn is written as
``<s>[INST] role LF text [/INST]</s>``. Control strings and the escape character inside roles and texts are escaped
reversibly, so text can never be taken for a mark. ``mask`` names the trainable characters of an example as (start, end).

``read_back`` parses the examples again: turns from the last example, replies from the masks.

Defined results: turns of a conversation are ordered by turn, role and text; null texts and roles are empty; rows that repeat a turn
stay as turns; rows with a null conv_id form one conversation; other columns are not looked at; an empty table gives no example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ESCAPE = "\\"
# control string -> what stands for it inside a text; the escape character itself comes first
CONTROL = (("\\", "\\0"), ("</s>", "\\1"), ("<s>", "\\2"), ("[INST]", "\\3"), ("[/INST]", "\\4"))
OPEN, CLOSE = "<s>[INST] ", " [/INST]</s>"
TRAINABLE = "assistant"
CONVERSATION = "conv_id long, turn int, role string, text string"


def escaped(text: Column) -> Column:
    for mark, code in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for mark, code in reversed(CONTROL):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def _line(role: Column) -> Column:
    """A role on one line."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\5"))


def turns_of(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id and its ordered turns (role, text)."""
    clean = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return clean.groupBy("conv_id").agg(F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, formatted and mask (array of start, end), in code points; ``example`` counts from 0."""
    turns = turns_of(conversations)
    written = F.transform("turns", lambda t: F.concat(F.lit(OPEN), _line(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE)))
    base = turns.select("conv_id", "turns", written.alias("written"), F.size("turns").alias("n"))
    last = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: (F.element_at("turns", k)["role"] == TRAINABLE) | (k == F.col("n")))
    each = base.select("conv_id", "turns", "written", F.posexplode(last).alias("example", "upto"))
    target = F.element_at("turns", F.col("upto"))
    end = F.length("formatted") - len(CLOSE)
    start = end - F.length(escaped(F.col("text")))
    each = each.select("conv_id", "example", F.array_join(F.slice("written", F.lit(1), F.col("upto")), "").alias("formatted"),
                       target["role"].alias("role"), target["text"].alias("text"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return each.select("conv_id", "example", "formatted", F.when(F.col("role") == TRAINABLE, F.array(
        F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))).otherwise(none).alias("mask"))


def parsed(formatted: Column) -> Column:
    """Turns (role, text) of a formatted example."""
    pieces = F.filter(F.split(formatted, r"<s>\[INST\] "), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE)))
    return F.transform(body, lambda b: F.struct(
        unescaped(F.replace(F.substring_index(b, "\n", 1), F.lit("\\5"), F.lit("\n"))).alias("role"),
        unescaped(F.substring(b, F.locate("\n", b) + 1, F.length(b))).alias("text")))


def read_back(made: DataFrame) -> DataFrame:
    """Digest of the examples of each conversation, from the formatted text and masks alone."""
    seen = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["end"] - m["start"])))
    rows = made.select("conv_id", "example", F.array_join(seen, "").alias("loss"), "formatted")
    whole = rows.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max_by("formatted", "example").alias("formatted"), F.sum(F.length("formatted")).alias("formatted_chars"))
    turns = whole.withColumn("turns", parsed(F.col("formatted")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def given(conversations: DataFrame) -> DataFrame:
    """The conversations with conversation -7, whose texts look like marks."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], CONVERSATION)
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text").union(rows)


ORACLE = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\0'), '</s>', '\1'), '<s>', '\2'), '[INST]', '\3'), '[/INST]', '\4') AS esc,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS all_turns FROM c),
s AS (SELECT *, sum(length('<s>[INST] ') + length(role) + 1 + length(esc) + length(' [/INST]</s>')) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM e),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS loss,
         sum(CASE WHEN role = 'assistant' OR n = all_turns THEN upto ELSE 0 END) AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
