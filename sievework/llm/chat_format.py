"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A conversation is a log of events. They are dealt by conversation, put in sequence and folded:

- ``message`` starts turn `turn` afresh with its text,
- ``edit`` replaces the text of the turn,
- ``delta`` appends to it (streamed parts),
- ``regenerate`` discards the turn and every later turn as they stand; what follows rebuilds them.

Then the final messages are rendered by the template

    <s>[INST]role[/INST]text</s>

for each turn, with nothing between turns. Backslash, "<" and "[" inside roles and texts become
``\\b``, ``\\g`` and ``\\l``; so no control string can come from a text, and the escape is undone exactly.
The loss mask comes as segments: the pieces of the formatted string in order, each with a flag that
is true for texts of the trained roles.

All windows and the final grouping use one hash partitioning by conversation: one shuffle. The
output holds a conversation in one row, so its size is bounded by that row.

Defined results: null texts and roles are empty; a null conversation id is one conversation; events
of equal sequence are ordered by kind, role and text, and repeated ones all count; a delta, or an
edit, without a message starts its turn; events of unknown kind count as messages; a log without
rows gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")
OPEN, ROLE_END, CLOSE = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\g"), ("[", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in (("[", "\\l"), ("<", "\\g"), ("\\", "\\b")):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def events_of(conversations: DataFrame) -> DataFrame:
    """Finished conversations (conv_id, turn, role, text) as a log: one message a row, in the order
    of turn, then role and text; every row stays, those of equal turn too."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    at = F.row_number().over(order).cast("long")
    return conversations.select(F.col("conv_id"), F.lit("message").alias("kind"), F.col("role"), F.col("text"), at.alias("seq")).withColumn("turn", F.col("seq"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, kind, turn, role, text)."""
    rows = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("seq").asc_nulls_first(), F.col("kind").desc(), F.col("role"), F.col("text")]
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    regenerated = F.col("kind") == "regenerate"
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alive = numbered.withColumn("_cut", F.max(F.when(regenerated, F.col("_at"))).over(by_turn)).where(~regenerated & (F.col("_cut").isNull() | (F.col("_at") > F.col("_cut"))))
    turn = Window.partitionBy("conv_id", "turn")
    based = alive.withColumn("_base", F.max(F.when(F.col("kind") != "delta", F.col("_at"))).over(turn)).where(F.col("_base").isNull() | (F.col("_at") >= F.col("_base")))
    parts = F.array_sort(F.collect_list(F.struct("_at", "role", "text")))
    folded = based.groupBy("conv_id", "turn").agg(parts.alias("_parts"))
    role = F.try_element_at(F.filter("_parts", lambda p: p["role"] != ""), F.lit(1))["role"]
    return folded.select("conv_id", "turn", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted (string) and segments (array<struct<text, loss>>, which join to formatted)."""
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns"))

    def pieces(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(ROLE_END))
        parts = ((head, F.lit(False)), (escape(t["text"]), t["role"].isin(*trained)), (F.lit(CLOSE), F.lit(False)))
        return F.array(*(F.struct(a.alias("text"), b.alias("loss")) for a, b in parts))

    cut = turns.select("conv_id", F.flatten(F.transform("_turns", pieces)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def format_chats(events: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log and render its conversations."""
    return render(fold(events), trained)


def parse(formatted: Column) -> Column:
    """Turns (array<struct<role, text>>) of a formatted string, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.split(F.substr(p, F.lit(len(OPEN) + 1)), r"\[/INST\]"))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
