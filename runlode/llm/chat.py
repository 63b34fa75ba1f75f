"""Chat formatting: event logs of conversations to training strings, in DataFrame operations only.

A log row is (conv_id, seq, turn, op, role, text). Operations, folded in the order of seq:

  message     starts the turn's message with this role and text
  delta       appends the text to the turn's message
  edit        replaces the turn's text and discards all later turns said before it
  regenerate  starts the turn's message anew with this text (null: empty), for deltas to follow,
              and discards all later turns said before it
  delete      removes the turn

A later message, edit or regenerate of a turn replaces what the turn held. Deltas before any of
these start a message of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: A control string in a text is marked by one more backslash between its first two characters, so
#: that none is left and any text, marked ones included, comes back by taking one away.
_MARK, _UNMARK = "<(\\\\*)\\|", "<\\\\(\\\\*)\\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _MARK, "<\\\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNMARK, "<$1|")


def escape_role(role: Column) -> Column:
    """As a text, and in one line: backslashes are doubled and line feeds become \\n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of an event log.

    Null ops are messages, null roles and texts are empty. Null conv_ids are one conversation and
    null turns the first turn. Rows with the same seq apply in the order of op, role and text, so
    repeated rows apply repeatedly and in a fixed order. Unknown operations change nothing.
    """
    rows = log.select("conv_id", "seq", "turn", F.coalesce("op", F.lit("message")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = Window.partitionBy("conv_id", "turn").orderBy("seq", F.when(F.col("op") == "delta", 1).otherwise(0), "op", "role", "text")
    so_far = turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    restart = F.col("op").isin("message", "edit", "regenerate", "delete")
    versions = rows.where(restart | (F.col("op") == "delta")).withColumn("version", F.sum(restart.cast("int")).over(so_far)).withColumn("pos", F.row_number().over(turn))
    last = Window.partitionBy("conv_id", "turn")
    # A turn that was edited keeps the role it was started with if the edit names none.
    named = F.max_by("role", F.when(F.col("role") != "", F.col("pos"))).over(last)
    kept = versions.withColumn("final", F.max("version").over(last)).withColumn("said", named).where("version = final")
    messages = kept.groupBy("conv_id", "turn").agg(
        F.min("seq").alias("since"),
        F.max(F.when(F.col("op").isin("edit", "regenerate"), F.col("seq"))).alias("reset"),
        F.min_by("op", "pos").alias("first_op"),
        F.max_by("role", F.when(F.col("role") != "", F.col("pos"))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"),
        F.max("said").alias("said"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    alive = messages.withColumn("cut", F.max("reset").over(earlier)).where("(cut is null or since > cut) and first_op <> 'delete'")
    return alive.select("conv_id", "turn", F.coalesce("role", "said", F.lit("")).alias("role"), "text")


def as_log(rows: DataFrame) -> DataFrame:
    """The event log that a client streaming ``rows`` (conv_id, turn, role, text) would leave.

    Each row becomes a turn of its own, numbered in the order of turn, role and text within its
    conversation, nulls first. By number, in turn: a message whose second half comes as a delta; a
    draft that is regenerated and streamed in two deltas; a message that an edit replaces.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    numbered = rows.select("conv_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), (F.row_number().over(order) - 1).cast("long").alias("turn")).withColumn("half", half)
    first, rest = F.expr("substring(text, 1, half)"), F.expr("substring(text, half + 1)")
    none = F.lit("")

    def event(op: str, role: Column, said: Column) -> Column:
        return F.struct(F.lit(op).alias("op"), role.alias("role"), said.alias("text"))

    streamed = F.array(event("message", F.col("role"), first), event("delta", none, rest))
    regenerated = F.array(event("message", F.col("role"), F.lit("draft")), event("regenerate", none, none), event("delta", none, first), event("delta", none, rest))
    edited = F.array(event("message", F.col("role"), F.lit("draft")), event("edit", none, F.col("text")))
    events = F.when(F.col("turn") % 3 == 0, streamed).when(F.col("turn") % 3 == 1, regenerated).otherwise(edited)
    return numbered.select("conv_id", "turn", F.posexplode(events).alias("k", "e")).select("conv_id", (F.col("turn") * 4 + F.col("k")).alias("seq"), "turn", "e.op", "e.role", "e.text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    formatted: <|im_start|>role LF text <|im_end|> LF for each turn, roles and texts escaped.
    loss_spans: array of (start, length) code points of formatted, one for each assistant text, in
    order. Rows with the same turn go by role and text, null turns first; null roles and texts are
    empty. A conversation is one output value, so its rows meet in one task.
    """
    ready = messages.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    grouped = ready.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    parts = F.transform("m", lambda x: F.struct(F.concat(F.lit(START), escape_role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body"), (x["role"] == "assistant").alias("loss")))
    shown = grouped.select("conv_id", parts.alias("p")).withColumn("formatted", F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(f"{END}\n"))), ""))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start, n = acc["at"] + F.length(x["head"]), F.length(x["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n + len(END) + 1).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return shown.select("conv_id", "formatted", F.aggregate("p", begin, step)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a formatted conversation."""
    turns = F.slice(F.split(formatted, "<\\|im_start\\|>", -1), 2, 1 << 30)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
