"""Chat formatting in Spark expressions only.

The turns of a conversation are collected once and sorted as structs (ties of a turn by role and text);
runs of adjacent turns of one role become one block, whose texts an array function joins with a
separator, so the original turns can be read back. Control strings start with ``<|``; inside roles and
texts a ``<`` before any number of backslashes and a ``|`` gains one backslash, which reading back removes.

    <|start|>role<|text|>text<|also|>text<|end|>

The loss mask is an array of code point spans of the formatted text: each assistant text, unescaped
nothing between. A conversation's turns are its output row, so they meet in one task; that row, not
the table, bounds the group. Null roles and texts count as empty, null turns come first, rows without
conv_id form one conversation, an empty table gives no rows, other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, TEXT, ALSO, END = "<|start|>", "<|text|>", "<|also|>", "<|end|>\n"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _quoted(marker: str) -> str:
    return marker.replace("|", r"\|")


def blocks(turns: Column) -> Column:
    """Structs (role, texts) of runs of equal role, escaped."""
    size = F.size(turns)
    heads = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (turns[i - 1]["role"] != turns[i - 2]["role"]))
    ends = F.concat(F.slice(heads, 2, F.size(heads)), F.array(size + 1))
    return F.transform(F.arrays_zip(heads.alias("a"), ends.alias("b")), lambda x: F.struct(
        escape(turns[x["a"] - 1]["role"]).alias("role"),
        F.transform(F.slice(turns, x["a"], x["b"] - x["a"]), lambda t: escape(t["text"])).alias("texts")))


def _mask(parts: Column) -> Column:
    """Code point spans (start, end) of the learned texts in the formatted conversation."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def one_text(h: Column, t: Column) -> Column:
        end = h["at"] + F.length(t)
        return F.struct((end + len(ALSO)).alias("at"), F.concat(h["out"], F.array(F.struct(h["at"].alias("start"), end.alias("end")))).alias("out"))

    def one_block(h: Column, b: Column) -> Column:
        first = h["at"] + len(START) + F.length(b["role"]) + len(TEXT)
        joined = F.length(F.array_join(b["texts"], ALSO))
        inner = F.aggregate(b["texts"], F.struct(first.alias("at"), none.alias("out")), one_text, lambda x: x["out"])
        out = F.when(b["role"] == LEARNED, F.concat(h["out"], inner)).otherwise(h["out"])
        return F.struct((first + joined + len(END)).alias("at"), out.alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), one_block, lambda h: h["out"])


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of every conversation of (conv_id, turn, role, text) rows."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    held = held.select("conv_id", blocks(F.col("turns")).alias("blocks"))
    spoken = F.transform("blocks", lambda b: F.concat(
        F.lit(START), b["role"], F.lit(TEXT), F.array_join(b["texts"], ALSO), F.lit(END)))
    return held.select("conv_id", F.array_join(spoken, "").alias("formatted"), _mask(F.col("blocks")).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The original turns, as structs (role, text), from the formatted text alone."""
    def of_block(block: Column) -> Column:
        head = F.split(block, _quoted(TEXT), 2)
        body = F.substring(head[1], F.lit(1), F.length(head[1]) - len(END))
        return F.transform(F.split(body, _quoted(ALSO), -1), lambda t: F.struct(unescape(head[0]).alias("role"), unescape(t).alias("text")))

    cut = F.split(formatted, _quoted(START), -1)
    return F.flatten(F.transform(F.slice(cut, 2, F.size(cut)), of_block))


def learned_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["end"] - m["start"]))), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of turns and learned text, from ``formatted`` and ``mask``."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                            learned_text(F.col("formatted"), F.col("mask")).alias("learned"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


SQL = rf"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
marked as (
  select *, case when lag(role) over w = role then 0 else 1 end as head,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) as role_chars
  from rows window w as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(text_chars + case when head = 1 then role_chars + {len(START) + len(TEXT) + len(END)} else {len(ALSO)} end) as bigint) as formatted_chars
from marked group by conv_id
"""
