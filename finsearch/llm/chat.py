"""Chat formatting with Spark expressions only: turns are collected, sorted, merged and concatenated.

A conversation becomes one string. Every turn stands behind the mark of its role, neighbouring turns
of one role share a closing mark. Marks are set off by spaces; a mark that occurs inside a text
gets a backslash in front, and so does one that already has backslashes there, so the texts can
be read back as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finsearch.llm.common import blocks_of, once, scan, span_of

# The template's control strings. Other roles are named in the mark.
OPEN = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_CLOSE = "<<ROLE ", "<</ROLE>>"
CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<<ROLE |<</ROLE>>"
LEARNED = "assistant"  # the role whose texts the loss counts


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)(\\*+)({CONTROL})", r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({CONTROL})", "$1$2")


def _opening(role: Column) -> Column:
    # encoded, a role's name has no white space or angle bracket
    other = F.concat(F.lit(OTHER_OPEN), F.url_encode(role), F.lit(">>"))
    for name, mark in OPEN.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def _closing(role: Column) -> Column:
    other = F.lit(OTHER_CLOSE)
    for name, mark in CLOSE.items():
        other = F.when(role == name, F.lit(mark)).otherwise(other)
    return other


def _segments(turns: Column) -> Column:
    """The pieces of the formatted string, each with whether the loss counts it."""

    def pieces(held: Column) -> Column:
        def of(turn: Column, at: Column) -> Column:
            after, before = F.get(held, at + 1), F.get(held, at - 1)
            last = F.coalesce(after["role"] != turn["role"], F.lit(True))
            gap = F.when(before.isNull(), F.lit("")).otherwise(F.lit(" "))
            close = F.when(last, F.concat(F.lit(" "), _closing(turn["role"]))).otherwise(F.lit(""))
            piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
            return F.array(
                piece(F.concat(gap, _opening(turn["role"]), F.lit(" ")), F.lit(False)),
                piece(escaped(turn["text"]), turn["role"] == LEARNED),
                piece(close, F.lit(False)),
            )

        return F.flatten(F.transform(held, of))

    return once(turns, pieces)


def formatted(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, formatted string, loss_runs array<struct<n_chars, loss>>)``, one row per conversation.

    ``loss_runs`` is the loss mask in runs of code points over ``formatted``: the escaped texts of the
    assistant are true, all else is false. Turns are sorted by number, then role, then text; a
    null number comes first. Null roles and texts are empty; rows without a conversation form one
    of their own; repeated rows are turns each. Turns are collected per task before the shuffle; a
    conversation is one string, so it ends up in one row.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    held = conversations.groupBy(F.col(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    cut = held.select(conv_col, _segments(F.col("_turns")).alias("_segments"))
    size = lambda piece: F.length(piece["text"]).cast("long")
    runs = F.transform("_segments", lambda piece: F.struct(size(piece).alias("n_chars"), piece["loss"].alias("loss")))
    return cut.select(conv_col, F.array_join("_segments.text", "").alias("formatted"), runs.alias("loss_runs"))


def read_back(rows: DataFrame, column: str = "formatted") -> DataFrame:
    """``rows`` with ``turns array<struct<role, text>>`` read from the formatted string alone.

    A null or empty string has no turns. Rows are read one by one, whatever their length and number; a
    column ``turns`` is replaced.
    """
    mark = rf"(?<!\\)(?:<<ROLE [^ >]*+>>|{CONTROL})"
    opening = {mark: name for name, mark in OPEN.items()}

    def role_of(found: Column) -> Column:
        role = F.url_decode(F.regexp_extract(found, r"^<<ROLE ([^ >]*)>>$", 1))
        for text, name in opening.items():
            role = F.when(found == text, F.lit(name)).otherwise(role)
        return role

    pairs = F.arrays_zip(F.regexp_extract_all(column, F.lit(f"({mark})"), F.lit(1)).alias("mark"), F.slice(F.split(column, mark), 2, 1 << 30).alias("text"))
    starts = F.filter(pairs, lambda p: p["mark"].isin(list(OPEN.values())) | p["mark"].startswith(OTHER_OPEN))
    # one space behind a mark and one in front of the next do not belong to the text
    inner = lambda text: text.substr(F.lit(2), F.length(text) - 2)
    turns = F.transform(starts, lambda p: F.struct(role_of(p["mark"]).alias("role"), unescaped(inner(p["text"])).alias("text")))
    return rows.withColumn("turns", turns)


def masked_text(rows: DataFrame, column: str = "formatted", runs: str = "loss_runs") -> DataFrame:
    """``rows`` with ``loss_text``: all text under the loss mask, unescaped, nothing in between; empty without a run.

    Time grows with the number of turns, not with its square. Repeated rows and null keys are rows like others.
    """
    none = F.array().cast("array<struct<at:bigint,n:bigint>>")

    def step(at: Column, run: Column) -> Column:
        span = F.array(F.struct(at.alias("at"), run["n_chars"].alias("n")))
        return F.struct((at + run["n_chars"]).alias("state"), F.when(run["loss"] & (run["n_chars"] > 0), span).otherwise(none).alias("out"))

    spans = scan(F.col(runs), F.lit(0).cast("long"), step, none)
    cut = lambda blocks: F.transform(spans, lambda s: unescaped(span_of(blocks, s["at"], s["n"])))
    return rows.withColumn("loss_text", F.array_join(once(blocks_of(F.col(column)), cut), ""))
