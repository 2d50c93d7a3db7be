"""Chat formatting by a declarative template and a finite-state machine.

All of it is DataFrame expressions.  Turns are gathered in pieces of PIECE
neighbouring turn numbers, sorted and formatted there, and only the pieces'
strings meet in a conversation, so a very long conversation is not sorted as one
group.  The machine runs over each piece from every state at once; a
conversation composes the pieces' maps, which gives what one pass would give.

Control strings inside texts are escaped reversibly: a backslash doubles, and
`<|` becomes `<\\|`; a line break in a role becomes `\\n`.  Null texts are empty,
a null role is ''.  Equal turn numbers go by role, then text; a null turn number
comes first.  A conversation with a null id is one of its own.  Turn orders the
machine does not know leave the conversation formatted, with `valid` false.
Rows that repeat are turns of their own.  A text of any length is one segment.  An
empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 64


@dataclass(frozen=True)
class ChatTemplate:
    """What opens, parts and closes a turn, which roles bear loss, and which role may follow which."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; any other step leads to `error`
    steps: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )

    @property
    def states(self) -> list[str]:
        return [*self.steps, "error"]


CHATML = ChatTemplate()


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    line = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(line)


def _step(template: ChatTemplate, state: Column, role: Column) -> Column:
    """Number of the next state, -1-free: the last number is the error state."""
    names = template.states
    out = F.lit(len(names) - 1)
    for a, moves in template.steps.items():
        for said, b in moves.items():
            out = F.when((state == names.index(a)) & (role == said), F.lit(names.index(b))).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: ChatTemplate = CHATML, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted (string), segments (array of text and loss flag, whose texts make up `formatted`), valid, n_turns."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.floor(F.col(turn_col) / PIECE).alias("piece"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    pieces = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.open), escape_role(t["role"]), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), t["role"].isin(*template.loss_roles).alias("loss")),
            F.struct(F.lit(template.close).alias("text"), F.lit(False).alias("loss")),
        )

    number = {s: i for i, s in enumerate(template.states)}
    moved = F.array(*[F.aggregate("ts", F.lit(i), lambda s, t: _step(template, s, t["role"])) for i in number.values()])
    made = pieces.select("conv_id", F.struct("piece", F.flatten(F.transform("ts", segments)).alias("segments"), moved.alias("moves"), F.size("ts").alias("n")).alias("p"))
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    ended = F.aggregate("ps", F.lit(number[template.start]), lambda s, p: F.element_at(p["moves"], s + 1))
    accepted = reduce(lambda a, b: a | b, [F.col("ended") == number[s] for s in template.accept])
    return whole.select(
        "conv_id",
        F.array_join(F.flatten(F.transform("ps", lambda p: F.transform(p["segments"], lambda s: s["text"]))), "").alias("formatted"),
        F.flatten(F.transform("ps", lambda p: p["segments"])).alias("segments"),
        ended.alias("ended"),
        F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + p["n"]).alias("n_turns"),
    ).select(F.col("conv_id").alias(conv_col), "formatted", "segments", accepted.alias("valid"), "n_turns")


def parse_conversations(formatted: DataFrame, template: ChatTemplate = CHATML, conv_col: str = "conv_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Back from the formatted string: conv_id, formatted, turns (array of role and text, unescaped), and the columns to keep."""
    pieces = F.split(F.col("formatted"), _literal(template.open))
    turns = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def one(t: Column) -> Column:
        at = F.instr(t, template.after_role)
        body = F.substring(t, at + F.lit(len(template.after_role)), F.length(t) - at + F.lit(1 - len(template.after_role) - len(template.close)))
        return F.struct(unescape_role(F.substring(t, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return formatted.select(conv_col, "formatted", *keep, F.transform(turns, one).alias("turns"))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"
