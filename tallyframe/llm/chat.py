"""Chat formatting by a finite-state machine, in DataFrame functions only.

A declarative :class:`Template` says which roles may open a conversation and
follow one another, which text marks a turn, and whose text carries loss. From it
comes one table of the machine: for every role the state that follows each state,
and whether the turn emitted on that transition carries loss. ``format_chats``
gathers the turns of a conversation in order, runs the machine over them, and
lays out one row per conversation: the formatted text and its text segments with
the loss flags that the machine emitted and code-point offsets. ``read_chats``
parses that output back, using only the formatted text and the loss mask.

A turn is a map from states to states, and maps compose; so states, like offsets,
are running results that take n log n steps for n turns.

Edge cases: null role or text counts as empty; rows with a null ``conv_id`` form
one conversation; a null turn comes first; equal turns are ordered by role, then
text, so reruns agree; repeated rows are repeated turns; a turn order that the
machine refuses leads to the state ``refused``, which is never left and emits the
same loss flags: the conversation is formatted all the same, with ``valid`` false
and the position of the first refused turn. Columns beside the four are ignored.
An empty table gives an empty result. A conversation is one output row, so its
turns meet in one task by definition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import add, chunks, cut, let, running


@dataclass(frozen=True)
class Template:
    """``next_roles[state]`` maps a role to the state after it; a state is any name."""

    open_mark: str = "<|im_start|>"
    close_mark: str = "<|im_end|>"
    role_end: str = "\n"
    turn_end: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    next_roles: dict = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "user"},
            "asked": {"user": "user"},
            "user": {"assistant": "answered"},
            "answered": {"user": "user"},
        }
    )


CHATML = Template()
REFUSED = "refused"


def escape(text: Column) -> Column:
    """``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|`` and so on: no mark is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line without marks."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(
        F.split(role, r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))
    )
    return unescape(F.array_join(parts, "\\"))


def machine(template: Template) -> tuple[list[str], dict[str, list[int]], list[int], dict[str, list[bool]], list[bool]]:
    """(states, next state and loss by role and state, and both for any other role).

    The first state is the start, the last one ``refused``.
    """
    named = [*template.next_roles, *(to for roles in template.next_roles.values() for to in roles.values())]
    states = [template.start, *(s for s in dict.fromkeys(named) if s != template.start), REFUSED]
    place = {s: i for i, s in enumerate(states)}
    roles = sorted({*template.loss_roles, *(r for known in template.next_roles.values() for r in known)})
    refused = place[REFUSED]
    after = {r: [place.get(template.next_roles.get(s, {}).get(r), refused) for s in states] for r in roles}
    emits = {r: [r in template.loss_roles] * len(states) for r in roles}
    return states, after, [refused] * len(states), emits, [False] * len(states)


def _table(role: Column, rows: dict[str, list], other: list) -> Column:
    out = F.when(F.lit(False), F.array(*map(F.lit, other)))
    for name, row in rows.items():
        out = out.when(role == name, F.array(*map(F.lit, row)))
    return out.otherwise(F.array(*map(F.lit, other)))


def format_chats(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """conv_id, n_turns, valid, refused_at, formatted, segments.

    ``segments``: array of (start, length, loss) in code points of ``formatted``,
    one per turn's text, in order.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    states, after, else_after, emits, else_emits = machine(template)
    refused = len(states) - 1
    # Composed from the left, a turn's map says where each state has come to.
    then = lambda first, second: F.transform(first, lambda state: F.get(second, state))
    reached = running(F.transform("turns", lambda t: _table(t.role, after, else_after)), then)
    laid = lambda reached: F.transform(
        "turns",
        lambda t, i: F.struct(
            F.concat(F.lit(template.open_mark), escape_role(t.role), F.lit(template.role_end)).alias("head"),
            escape(t.text).alias("body"),
            F.lit(template.close_mark + template.turn_end).alias("tail"),
            F.get(_table(t.role, emits, else_emits), F.when(i > 0, F.get(F.get(reached, i - 1), F.lit(0))).otherwise(0)).alias("loss"),
            F.get(F.get(reached, i), F.lit(0)).alias("state"),
        ),
    )
    size = lambda s: F.char_length(s["head"]) + F.char_length(s["body"]) + F.char_length(s["tail"])
    segments = let(
        running(F.transform("laid", lambda s: size(s).cast("bigint")), add),
        lambda ends: F.transform(
            "laid",
            lambda s, i: F.struct(
                (F.get(ends, i) - size(s) + F.char_length(s["head"])).alias("start"),
                F.char_length(s["body"]).cast("bigint").alias("length"),
                s["loss"].alias("loss"),
            ),
        ),
    )
    first = F.array_position(F.transform("laid", lambda s: s["state"]), F.lit(refused)).cast("int")
    return (
        chats.withColumn("laid", let(reached, laid))
        .select(
            "conv_id",
            F.size("turns").cast("bigint").alias("n_turns"),
            F.when(first > 0, first - 1).alias("refused_at"),
            F.array_join(F.transform("laid", lambda s: F.concat(s["head"], s["body"], s["tail"])), "").alias("formatted"),
            segments.alias("segments"),
        )
        .withColumn("valid", F.col("refused_at").isNull())
    )


def read_chats(formatted: DataFrame, template: Template = CHATML) -> DataFrame:
    """What the output says: conv_id, formatted, valid, turns (role, text), loss_text.

    Escaped texts hold no mark, so cutting at the closing mark is exact. The
    text under the loss mask is cut from ``formatted`` by the segments alone.
    """
    end = re.escape(template.close_mark + template.turn_end)
    pieces = F.filter(F.split("formatted", end), lambda x: x != "")
    skip = len(template.open_mark) + 1
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape_role(
                F.substring_index(F.substr(p, F.lit(skip)), template.role_end, 1)
            ).alias("role"),
            unescape(
                F.substr(p, F.char_length(F.substring_index(p, template.role_end, 1)) + F.lit(1 + len(template.role_end)))
            ).alias("text"),
        ),
    )
    under_loss = let(
        chunks(F.col("formatted")),
        lambda parts: F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescape(cut(parts, s.start, s.length))),
    )
    return formatted.withColumn("pieces", pieces).select(
        "conv_id", "formatted", "valid", "refused_at", turns.alias("turns"), F.array_join(under_loss, "").alias("loss_text")
    )
