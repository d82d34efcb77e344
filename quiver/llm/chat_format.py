r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent
turns of one role are merged by an array aggregation, and the blocks are
concatenated under a template:

    <|im_start|>ROLE\n TEXT (<|turn|> TEXT)* <|im_end|>\n

Texts and roles cannot break out of their block: a backslash is doubled, and a
backslash is put after the first character of every control string they hold;
dropping each backslash that precedes a character restores them.  ``parse``
reads the formatted string back into turns, and ``loss_text`` is what stands
under the loss mask: the texts of the trained roles.

A conversation is one string by nature, so its turns meet in one task; nothing
else does, and there is no Python in the plan.

Defined cases: null roles and texts are empty strings; equal turn numbers are
ordered by role, then text; repeated rows are turns of their own; extra columns
are ignored; a null conv_id is a conversation like others; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiver.llm import common as C


@dataclass(frozen=True)
class Template:
    """Block markers, the separator of merged turns, and every control string that texts must not hold."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    turn: str = "<|turn|>"
    # Control strings of widespread chat templates.
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|turn|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
                                "<<SYS>>", "<</SYS>>")


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merged_turns(turns: Column) -> Column:
    """Adjacent (role, text) structs of one role become (role, texts).

    A block starts wherever the role changes; the turns between two starts
    are sliced out, so that long conversations cost no repeated copying."""
    starts = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (
        F.element_at(turns, i.cast("int"))["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)).cast("int"))["role"]))
    stops = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(turns) + 1))
    return F.zip_with(starts, stops, lambda a, b: F.struct(
        F.element_at(turns, a.cast("int"))["role"].alias("role"),
        F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def format_turns(turns: Column, template: Template = DEFAULT) -> Column:
    """The formatted string of an array of (role, text) structs."""
    block = lambda b: F.concat(
        F.lit(template.start), escape(b["role"], template), F.lit("\n"),
        F.array_join(F.transform(b["texts"], lambda t: escape(t, template)), template.turn), F.lit(template.end), F.lit("\n"))
    return F.array_join(F.transform(merged_turns(turns), block), "")


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, formatted: one row per conversation of (conv_id, turn, role, text) rows."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", format_turns(F.col("turns"), template).alias("formatted"))


def parse(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns of a formatted string: array of (role, text) structs, unescaped."""
    start, end = re.escape(template.start), re.escape(template.end)
    body = F.regexp_extract_all(formatted, F.lit(f"(?s){start}(.*?){end}\n"), 1)
    turns = lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, "\n") + 1), re.escape(template.turn), -1),
        lambda t: F.struct(unescape(F.substring_index(b, "\n", 1)).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(body, turns))


def loss_text(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """All text under the loss mask, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*roles)), lambda t: t["text"]), "")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts hold control strings."""
    says = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    """Contract digests of all conversations and -7, read back from the formatted strings."""
    C.prepare(spark)
    out = format_conversations(with_probe(C.table(spark, sf_dir, "conversations")))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), loss_text(F.col("turns")).alias("loss"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def _sql_escape(column: str, template: Template = DEFAULT) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in template.control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


ORACLE_SQL = f"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows),
pieces AS (
  SELECT *, CASE WHEN before IS NOT NULL AND before = role THEN '{DEFAULT.turn}'
                 ELSE (CASE WHEN before IS NULL THEN '' ELSE '{DEFAULT.end}' || chr(10) END) || '{DEFAULT.start}' || {_sql_escape('role')} || chr(10) END
            || {_sql_escape('text')} AS piece FROM ordered)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(length(string_agg(piece, '' ORDER BY k)) + length('{DEFAULT.end}') + 1 AS BIGINT) AS formatted_chars
FROM pieces GROUP BY conv_id
"""
