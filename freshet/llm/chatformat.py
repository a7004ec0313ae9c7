"""Chat formatting with Spark expressions only: a conversation's turns become one marked text with a loss mask.

Turn structs are collected per conversation and sorted; adjacent turns of one role are merged into a block by array
functions (run starts, slices, joins); the blocks are concatenated. Every step is linear in the conversation, and only
the grouping by conversation shuffles. A formatted conversation is one row, so one conversation must fit in a row (2 GB).

The template: a block is ``[SYS]..[/SYS]``, ``[INST]..[/INST]`` or ``<s>..</s>`` (assistant); any other role is
``[ROLE]name[NAME]..[/ROLE]``. ``[TURN]`` sets apart the turns merged into one block. Inside texts and role names a
control string gets a backslash after its first character (``[\\INST]``; one that has some already gets one more), so
control strings occur as marks only and the text can be read back exactly.

``loss_mask`` has one (skip, take) per turn: of the formatted text, ``skip`` code points are not trained on, then
``take`` are, and so on; what remains after the last turn is not trained on. ``take`` covers assistant texts only.

Defined results: rows are ordered by turn, nulls first, then role and text; a null text or role is an empty one;
repeated rows are turns of their own; a null ``conv_id`` is one conversation; an empty table gives no row; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: role, opening and closing mark.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER, NAMED, OTHER_END, TURN = "[ROLE]", "[NAME]", "[/ROLE]", "[TURN]"
TRAINED = "assistant"
_CONTROL = r"(/?s>|/?(?:SYS|INST|ROLE)\]|NAME\]|TURN\])"
_CLOSING = r"\[/(?:SYS|INST|ROLE)\]|</s>"
_OPENING = r"^(?:\[SYS\]|\[INST\]|<s>|\[ROLE\](?s:.*?)\[NAME\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def _by_role(role: Column, known: int, other: Column) -> Column:
    out = other
    for name, marks in MARKS.items():
        out = F.when(role == name, F.lit(marks[known])).otherwise(out)
    return out


def _runs(turns: Column) -> Column:
    """The slices of adjacent turns with one role."""
    starts = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (turns[i]["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(turns)), F.array(F.size(turns)))
    return F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda r: F.slice(turns, r["s"] + 1, r["e"] - r["s"]))


def _block(run: Column) -> Column:
    role = run[0]["role"]
    opening = _by_role(role, 0, F.concat(F.lit(OTHER), escaped(role), F.lit(NAMED)))
    body = F.array_join(F.transform(run, lambda t: t["text"]), TURN)
    return F.concat(opening, body, _by_role(role, 1, F.lit(OTHER_END)))


def _mask(turns: Column) -> Column:
    """(skip, take) per turn; a turn's skip starts behind the text of the turn before, trained on or not."""

    def lengths(turn: Column, i: Column) -> Column:
        before, role = F.get(turns, i - 1), turn["role"]
        opening = F.length(_by_role(role, 0, F.concat(F.lit(OTHER), escaped(role), F.lit(NAMED))))
        closing = F.length(_by_role(before["role"], 1, F.lit(OTHER_END)))
        lead = F.when(i == 0, opening).when(before["role"] == role, len(TURN)).otherwise(closing + opening)
        size = F.length(turn["text"])
        return F.struct(
            (lead + F.when(role == TRAINED, 0).otherwise(size)).alias("skip"), F.when(role == TRAINED, size).otherwise(0).alias("take"))

    return F.transform(turns, lengths)


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    marked = turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    ts = F.col("turns")
    return marked.select(
        "conv_id", F.array_join(F.transform(_runs(ts), _block), "").alias("formatted"), _mask(ts).alias("loss_mask"))


def blocks_of(text: Column) -> Column:
    """Role and escaped turn texts of every block, read from the formatted text."""
    pieces = F.split(text, _CLOSING, -1)

    def block(piece: Column) -> Column:
        role = F.lit(None).cast("string")
        for name, (opening, _) in MARKS.items():
            role = F.when(piece.startswith(opening), F.lit(name)).otherwise(role)
        named = F.regexp_extract(piece, r"^\[ROLE\]((?s:.*?))\[NAME\]", 1)
        body = F.regexp_replace(piece, _OPENING, "")
        return F.struct(F.coalesce(role, unescaped(named)).alias("role"), F.split(body, r"\[TURN\]", -1).alias("texts"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), block)


def read_back(done: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), trained (texts under the loss mask), n_blocks, formatted_chars: all from ``formatted`` and ``loss_mask``."""
    chars = F.length("formatted").cast("long").alias("formatted_chars")
    blocks = done.select("conv_id", "loss_mask", chars, blocks_of(F.col("formatted")).alias("blocks"))
    flat = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), t.alias("text")))))
    turns = blocks.select("conv_id", "loss_mask", "formatted_chars", F.size("blocks").cast("long").alias("n_blocks"), flat.alias("turns"))
    masked = F.zip_with("turns", "loss_mask", lambda t, m: F.when(m["take"] > 0, F.right(t["text"], m["take"])))
    return turns.select(
        "conv_id", "n_blocks", "formatted_chars",
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), unescaped(t["text"]).alias("text"))).alias("turns"),
        F.transform(F.array_compact(masked), unescaped).alias("trained"))
