"""Chat formatting: role order by a finite-state machine, text segments with loss flags from a declarative template."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadgrid.llm.text import pinned

#: state|role -> state. What isn't listed goes to "reject" and stays there.
TURN_ORDER = {
    "start|system": "system",
    "start|user": "user",
    "system|user": "user",
    "user|assistant": "assistant",
    "assistant|user": "user",
}
ACCEPT = ("user", "assistant")
#: Every control string begins with < or [; escaped texts hold none of these four characters but the escape.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"), ("]", "\\e"))


@dataclass(frozen=True)
class Template:
    """Control strings and loss flag of each role; other roles are written with their name between other_open and "]"."""

    roles: dict = field(
        default_factory=lambda: {
            "system": ("<<SYS>>", "<</SYS>>\n", False),
            "user": ("[INST]", "[/INST]\n", False),
            "assistant": ("<s>", "</s>\n", True),
        }
    )
    other_open: str = "[ROLE="
    other_close: str = "[/ROLE]\n"


def escaped(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _by_role(role: Column, template: Template, part: int, other: Column) -> Column:
    out = other
    for name, parts in template.roles.items():
        out = F.when(role == name, F.lit(parts[part])).otherwise(out)
    return out


def format_chat(conversations: DataFrame, template: Template = Template(), order: dict = TURN_ORDER) -> DataFrame:
    """conv_id, valid, bad_turn, segments array<struct<text, loss>>, formatted.

    Turns go by turn, then role, then text; null roles and texts are empty;
    repeated rows are turns of their own. valid says whether the machine accepts
    the roles, bad_turn is the first turn (from 0) that it rejects. Invalid
    conversations are formatted too, flagged. Rows without a conv_id are one
    conversation. A conversation is one row: its text, like that of a document,
    however long, has to fit in a task. An empty table gives no rows; other
    columns aren't read.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    turns = (
        conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("_t"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("_t")).alias("turns"))
    )
    steps = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    begin = F.struct(F.lit("start").alias("s"), F.lit(0).alias("n"))

    def step(state: Column, t: Column) -> Column:
        after = F.coalesce(F.try_element_at(steps, F.concat(state["s"], F.lit("|"), t["role"])), F.lit("reject"))
        return F.struct(after.alias("s"), (state["n"] + (after != "reject").cast("int")).alias("n"))

    def segment(t: Column) -> Column:
        loss = F.lit(False)
        for name, parts in template.roles.items():
            loss = F.when(t["role"] == name, F.lit(parts[2])).otherwise(loss)
        opening = _by_role(t["role"], template, 0, F.concat(F.lit(template.other_open), escaped(t["role"]), F.lit("]")))
        closing = _by_role(t["role"], template, 1, F.lit(template.other_close))
        return F.array(
            F.struct(opening.alias("text"), F.lit(False).alias("loss")),
            F.struct(escaped(t["text"]).alias("text"), loss.alias("loss")),
            F.struct(closing.alias("text"), F.lit(False).alias("loss")),
        )

    out = pinned(turns, state=F.aggregate("turns", begin, step), segments=F.flatten(F.transform("turns", segment)))
    valid = F.col("state.s").isin(*ACCEPT)
    return out.select(
        "conv_id",
        valid.alias("valid"),
        F.when(F.col("state.n") < F.size("turns"), F.col("state.n")).alias("bad_turn"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    openings = [re.escape(p[0]) for p in template.roles.values()] + [re.escape(template.other_open) + r"[^<\[\]]*\]"]
    closings = [re.escape(p[1]) for p in template.roles.values()] + [re.escape(template.other_close)]
    pattern = F.lit(f"({'|'.join(openings)})([^<\\[\\]]*+)(?:{'|'.join(closings)})")

    def turn(opening: Column, text: Column) -> Column:
        role = unescaped(F.substring(opening, len(template.other_open) + 1, F.length(opening) - len(template.other_open) - 1))
        for name, parts in template.roles.items():
            role = F.when(opening == parts[0], F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.zip_with(F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2)), turn)


def loss_read_back(turns: Column, template: Template = Template()) -> Column:
    """The text under the loss mask, from read_back() turns: the template says whose text counts."""
    counted = [name for name, parts in template.roles.items() if parts[2]]
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"].isin(*counted)), lambda t: t["text"]), "")


def loss_text(segments: Column) -> Column:
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
