"""Repair of conversations by a forward Viterbi pass over a grammar of roles.

A repaired conversation is empty, or a system turn at most, then user and assistant
turns in turn: `(s?(ua)+)?`.  The pass walks a conversation's rows in the order of
turns.  It carries, for each of four states (nothing yet, after system, after user,
after assistant), the least cost and, of equal costs, the ASCII-least string of edits:
Keep, Rerole, Delete for each row, and Insert between them.  The grammar leaves no
choice of role to Rerole and Insert, so a string of edits says everything.  Two
strings of one layer and state are never prefixes of each other at equal cost, since a
letter's cost depends on its row alone, so the least string stays least whatever is
appended.  After each row the layer is closed: three inserts lead from any state to
each that inserts reach, and a fourth would only come back at a higher cost.

A state that can never again be part of a cheapest path is let go, and edits that all
states agree on are settled at once and their rows let go.  So a task, to which Spark
hands conversations sorted, holds the rows that are still undecided, an edit letter for
each row, and a digest for each distinct row of one conversation; its turns are rows of
the result, never one value.

Null roles and texts are one space.  Rows with a null turn come first; rows of equal turn
are ordered by role and text, both in bytes.  Rows that repeat are rows of their own
(the later ones duplicates).  Null conversation ids are one conversation.  A role's
initial decides whether it can be kept, so rows of other roles are reroled or deleted.
Turn numbers that span more than a long leave the largest long of gaps.  Texts of any
length are read whole; an empty table gives an empty result.  Other columns are not read,
so their names clash with nothing.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.shared import partitions

#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = frozenset(".!?")
LEGAL = frozenset({"su", "ua", "au"})
ROLE = {"s": "system", "u": "user", "a": "assistant"}
#: By the last role's initial ('' for none): the role that must follow.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
#: Letters of undecided edits beyond which the states' common ones are looked for.
SETTLE = 64
#: Rows of the result that a task holds.
BATCH = 4096
_LARGEST = 2**63 - 1

Layer = dict[str, tuple[int, str]]


def closed(layer: Layer) -> Layer:
    """The layer with what three inserts reach."""
    for _ in range(3):
        for state, (cost, audit) in list(layer.items()):
            to, one = NEXT[state], (cost + INSERT, audit + "I")
            if to not in layer or one < layer[to]:
                layer[to] = one
    return layer


def pruned(layer: Layer) -> Layer:
    """Without states that a path after an assistant's turn always betters.

    From there, too, only a user's turn can follow; a system turn that could still be kept first costs DELETE to pass over.
    """
    if "a" in layer:
        best = layer["a"][0]
        if "s" in layer and best < layer["s"][0]:
            del layer["s"]
        if "" in layer and best + DELETE < layer[""][0]:
            del layer[""]
    return layer


class Conversation:
    """One conversation, row by row; settled edits as (edit, role, text), role and text null for deleted rows."""

    def __init__(self):
        self.layer: Layer = closed({"": (0, "")})
        self.rows: list[tuple[str, str]] = []  # of edits not settled
        self.audit: list[str] = []
        self.state, self.digest, self.first = "", hashlib.sha256(), True
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.most = self.initial = None
        self.seen: set[bytes] = set()

    def add(self, turn: int | None, role: str, text: str) -> Iterator[tuple[str, str | None, str | None]]:
        if turn is not None and turn != self.most:
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        data = role.encode("utf-8", "surrogatepass")
        name = hashlib.sha256(len(data).to_bytes(8, "little") + data + text.encode("utf-8", "surrogatepass")).digest()
        told = text.rstrip(BLANKS)
        blank, duplicate = not told, name in self.seen
        truncated = not blank and not duplicate and told[-1] not in ENDS
        self.seen.add(name)
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        after: Layer = {state: (cost + DELETE, audit + "D") for state, (cost, audit) in self.layer.items()}
        if not blank and not duplicate:
            for state, (cost, audit) in self.layer.items():
                cost += TRUNCATED * truncated
                edits = [(NEXT[state], (cost + REROLE, audit + "R"))]
                if initial == NEXT[state] or (initial == "s" and not state):
                    edits.append((initial, (cost, audit + "K")))
                for to, one in edits:
                    if to not in after or one < after[to]:
                        after[to] = one
        self.layer = pruned(closed(after))
        self.rows.append((role, text))
        if min(len(audit) for _, audit in self.layer.values()) > SETTLE:
            agreed = len(os.path.commonprefix([audit for _, audit in self.layer.values()]))
            yield from self._settle(next(iter(self.layer.values()))[1][:agreed])
            self.layer = {state: (cost, audit[agreed:]) for state, (cost, audit) in self.layer.items()}

    def _settle(self, edits: str) -> Iterator[tuple[str, str | None, str | None]]:
        used = 0
        for edit in edits:
            role = text = None
            if edit == "I":
                role, text = ROLE[NEXT[self.state]], ""
            else:
                own_role, own_text = self.rows[used]
                used += 1
                if edit != "D":
                    role, text = own_role if edit == "K" else ROLE[NEXT[self.state]], own_text
            if role is not None:
                self.state = role[:1]
                self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.first = False
            yield edit, role, text
        del self.rows[:used]
        self.audit.append(edits)

    def finish(self) -> Iterator[tuple[str, str | None, str | None]]:
        """The edits of the cheapest way to a whole conversation, as far as they are not settled."""
        self.cost, edits = min(self.layer[state] for state in ("", "a") if state in self.layer)
        yield from self._settle(edits)

    def summary(self) -> tuple:
        gaps = 0 if self.most is None else min(self.most - self.least + 1 - self.turns, _LARGEST)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and here of rows with planted faults, by crc32(`conv_id:turn`) modulo 20.

    0: not here; 1: no text; 2: no marks that end sentences; 3: twice; 4: a user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    rows = turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), (fault != 0).alias("here"), F.when(fault == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "here", F.explode(F.array_repeat("here", F.col("times"))).alias("copy")).drop("copy")


def _repaired(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, here_col: str | None, steps: bool, schema: T.StructType) -> DataFrame:
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    here: Column = F.coalesce(F.col(f"`{here_col}`"), F.lit(False)) if here_col else F.lit(True)
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"), here.alias("here"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        kinds = [f.type for f in pa.schema([(f.name, _arrow(f.dataType)) for f in schema])]
        out: list[tuple] = []
        talk: Conversation | None = None
        conv, place = None, 0

        def made() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)
            out.clear()
            return batch

        def told(edits):
            """Keeps the steps, if asked for."""
            nonlocal place
            for edit in edits:
                if steps:
                    out.append((conv, place, *edit))
                    place += 1

        def ended():
            told(talk.finish())
            if not steps:
                out.append((conv, *talk.summary()))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for key, turn, role, text, present in zip(*columns, strict=True):
                if talk is None or key != conv:
                    if talk is not None:
                        ended()
                    conv, place, talk = key, 0, Conversation()
                if present:
                    told(talk.add(turn, role, text))
                if len(out) >= BATCH:
                    yield made()
        if talk is not None:
            ended()
        yield made()

    return dealt.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here_col: str | None = None) -> DataFrame:
    """Per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit (edits' initials) and repaired_sha256.

    The digest is of the repaired turns' `role:text`, joined by newlines.  Rows whose here_col is not true only say that the conversation exists.
    """
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return _repaired(turns, conv_col, turn_col, role_col, text_col, here_col, False, schema)


def repaired_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", here_col: str | None = None) -> DataFrame:
    """Every edit in order: conversation, place, edit (K, R, D or I), and the repaired turn's role and text, null where a row was deleted."""
    schema = T.StructType([T.StructField(conv_col, turns.schema[conv_col].dataType), T.StructField("place", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])
    return _repaired(turns, conv_col, turn_col, role_col, text_col, here_col, True, schema)
