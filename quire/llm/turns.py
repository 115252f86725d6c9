"""Conversation structure repair by scalar big-integer weights (free style: one shuffle, streamed).

A repaired conversation has the role initials ``(s?(ua)+)?``.  Its rows are edited in
order: Keep, Rerole (to user or assistant), Delete, and Insert (an empty user or
assistant turn, anywhere).  The states of that expression make a DAG with one layer per
row; an edge is what happens to one row, at most one Insert before it.

**Weights.**  The weight of a path is one integer.  Its high digits hold the cost.  Its low
digits have a fixed width and place: two letter digits a row (``DIGIT`` bits each, D < I < K < R
as in ASCII, 0 for no letter), the letters first and zeros behind them, and zeros in the
places of rows that are still to come.  No row's letters (D, IK, IR, K, R) begin another's, so
comparing digits compares audits, and an ordinary integer minimum decides cost and
ties alike.

**Streaming.**  Rows come sorted by conversation and turn.  Once all states that can still win
agree on the edits of the first rows, those edits are final: the rows leave, and their
digits leave the weights.  A state whose cost is more than ``SLACK`` above the least cannot
win any more (the best state imitates any end of another one for that much).  So memory
follows the undecided rows, not the conversation; it grows with them only where a
conversation leaves the choice open for long (its rows are all to be deleted, say).

Defined cases: null role or text is one space; an empty role has no initial and cannot be kept; rows of one turn are ordered by role, then text;
a null turn comes first and is no turn for ``gaps``; a null conv_id is a conversation of its own;
empty and blank texts are blank rows; repeated rows are duplicates; a conversation without
rows (all ``gone``) gives zeros, an empty audit and the hash of the empty text; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values (costs, states, white space of the contract) ----
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Inserts that end a conversation in each state.
CLOSING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"

LETTERS = ("", "D", "I", "K", "R")
DIGIT = 3
FIELD = 2 * DIGIT
#: Rows whose digits have a place at first; more places are made when they are full.
ROOM = 32
SLACK = 7
#: Rows of output handed on at once.
BATCH = 5000


def field(letters: str) -> int:
    """Digits of a row: its letters first, then zeros."""
    return sum(LETTERS.index(x) << FIELD - DIGIT * (k + 1) for k, x in enumerate(letters))


def letters(value: int) -> str:
    return "".join(LETTERS[value >> FIELD - DIGIT * (k + 1) & (1 << DIGIT) - 1] for k in range(2))


def _edges(initial: str, fault: str) -> list[tuple[int, int, int, int]]:
    """(from, to, cost, digits) of everything that can happen to a row."""
    out = [(s, s, DELETE, field("D")) for s in range(4)]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        for letter, cost, becomes in [("K", 0, initial), ("R", REROLE, "u"), ("R", REROLE, "a")]:
            for s in range(4):
                if (s, becomes) in NEXT:
                    out.append((s, NEXT[s, becomes], cost + extra, field(letter)))
                for put in "ua":
                    if (s, put) in NEXT and (NEXT[s, put], becomes) in NEXT:
                        out.append((s, NEXT[NEXT[s, put], becomes], cost + extra + INSERT, field("I" + letter)))
    return out


_EDGES = {(i, f): _edges(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "duplicate", "truncated")}


def fault_of(text: str, seen: bool) -> str:
    """A row's first fault: blank, duplicate, truncated, or none."""
    t = text.rstrip(SPACE)
    return "blank" if not t else "duplicate" if seen else "" if t[-1] in ".!?" else "truncated"


class Repair:
    """The cheapest edits of one conversation, row by row.  ``done`` gets (letter, role, text) of every
    edit once it is final; role and text are None for a deleted row."""

    def __init__(self, done: Callable[[str, str | None, str | None], None]):
        self.done = done
        self.weight: list[int | None] = [0, None, None, None]
        self.width = ROOM * FIELD            # bits of the low digits
        self.rows: list[tuple[str, str]] = []
        self.cost, self.state = 0, EMPTY     # of the edits that are final

    def push(self, role: str, text: str, fault: str) -> None:
        if FIELD * (len(self.rows) + 2) > self.width:
            self.weight = [w if w is None else w << self.width for w in self.weight]
            self.width *= 2
        self.rows.append((role, text))
        initial = role[:1] if role[:1] in "sua" else ""
        at, best = self.width - FIELD * len(self.rows), [None] * 4
        for s, t, cost, digits in _EDGES[initial, fault]:
            w = self.weight[s]
            if w is not None:
                w += (cost << self.width) + (digits << at)
                if best[t] is None or w < best[t]:
                    best[t] = w
        limit = (min(w for w in best if w is not None) >> self.width) + SLACK
        self.weight = [w if w is not None and w >> self.width <= limit else None for w in best]
        if len(self.rows) % ROOM == 0:
            self._settle()

    def _settle(self) -> None:
        """Hand on the first rows whose edits are the same in every state."""
        alive = [w for w in self.weight if w is not None]
        low = (1 << self.width) - 1
        differ = 0
        for w in alive[1:]:
            differ |= (w ^ alive[0]) & low
        n = min(len(self.rows), (self.width - differ.bit_length()) // FIELD)
        if n:
            self._emit(alive[0] & low, n)
            least = min(alive) >> self.width
            self.cost += least
            self.weight = [w if w is None else (w >> self.width) - least << self.width | (w << FIELD * n & low) for w in self.weight]

    def _emit(self, digits: int, n: int) -> None:
        for k in range(n):
            self._apply(letters(digits >> self.width - FIELD * (k + 1) & (1 << FIELD) - 1), *self.rows[k])
        del self.rows[:n]

    def _apply(self, edits: str, role: str | None = None, text: str | None = None) -> None:
        for e in edits:
            if e == "D":
                self.done(e, None, None)
                continue
            becomes = role if e == "K" else "assistant" if self.state == USER else "user"
            self.state = NEXT[self.state, becomes[0]]
            self.done(e, becomes, "" if e == "I" else text)

    def finish(self) -> int:
        """Settle the rest; the cost of all edits."""
        at = self.width - FIELD * (len(self.rows) + 1)
        best = min(w + (len(CLOSING[s]) * INSERT << self.width) + (field(CLOSING[s]) << at)
                   for s, w in enumerate(self.weight) if w is not None)
        n = len(self.rows)
        closing = letters(best >> at & (1 << FIELD) - 1)
        self._emit(best & (1 << self.width) - 1, n)
        self._apply(closing)
        return self.cost + (best >> self.width)


class _Report:
    """Counts of one conversation's rows, its edits and the hash of the repaired text."""

    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.first = conv, [], hashlib.sha256(), True
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.before, self.turns, self.least, self.most = 0, None, 0, None, None
        self.repair = Repair(self.edit)

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        self.audit.append(letter)
        if role is not None:
            self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
            self.first = False

    def row(self, turn, role: str, text: str, seen: bool) -> None:
        fault = fault_of(text, seen)
        if fault:
            self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.most:      # turns come in order
            self.turns += 1
            self.least, self.most = (turn if self.least is None else self.least), turn
        self.repair.push(role, text, fault)

    def finish(self) -> Iterator[tuple]:
        cost = self.repair.finish()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        yield (self.conv, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.sha.hexdigest())


class _Rows(_Report):
    """The rows of a repaired conversation."""

    def __init__(self, conv):
        super().__init__(conv)
        self.out, self.position = [], 0

    def edit(self, letter: str, role: str | None, text: str | None) -> None:
        if role is not None:
            self.out.append((self.conv, self.position, letter, role, text))
            self.position += 1

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def finish(self) -> Iterator[tuple]:
        self.repair.finish()
        yield from self.drain()


def _streamed(kind: type, schema: pa.Schema):
    """Rows sorted by conversation and turn -> what ``kind`` makes of each conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, out = None, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        for b in batches:
            for conv, turn, role, text, gone, seen in zip(*(c.to_pylist() for c in b.columns)):
                if current is None or current.conv != conv:
                    if current is not None:
                        out += current.finish()
                    current = kind(conv)
                if not gone:
                    current.row(turn, role, text, seen)
                    if kind is _Rows and current.out:
                        out += current.drain()
                if len(out) >= BATCH:
                    yield batch()
                    out = []
        if current is not None:
            out += current.finish()
        if out:
            yield batch()
    return run


def _sorted(rows: DataFrame, gone: Column) -> DataFrame:
    """(conv_id, turn, role, text, gone, seen) by conversation, in order; ``seen``: role and text
    stood in an earlier row.  One shuffle; both orders are made inside its partitions."""
    d = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
                    F.coalesce(gone, F.lit(False)).alias("gone")).repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    return d.withColumn("seen", F.row_number().over(same) > 1).sortWithinPartitions(
        "conv_id", F.asc_nulls_first("turn"), "role", "text", "seen")


def _run(rows: DataFrame, gone: Column | None, kind: type, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    conv = rows.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(conv)), *[(n, t) for n, t, _ in columns]])
    ddl = ", ".join([f"conv_id {conv.simpleString()}", *[f"{n} {t}" for n, _, t in columns]])
    return _sorted(rows, F.lit(False) if gone is None else gone).mapInArrow(_streamed(kind, schema), ddl)


def repair_report(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, cost, audit and the repaired text's hash.

    ``rows`` has conv_id, turn, role and text; rows where ``gone`` holds count for nothing
    but their conversation's presence."""
    long = [(n, pa.int64(), "long") for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _run(rows, gone, _Report, [*long, ("audit", pa.string(), "string"), ("repaired_sha256", pa.string(), "string")])


def repaired(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The repaired conversations: (conv_id, position, edit, role, text)."""
    return _run(rows, gone, _Rows, [("position", pa.int64(), "long"), *[(n, pa.string(), "string") for n in ("edit", "role", "text")]])


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with faults put in by the remainder of crc32('conv_id:turn') modulo 20: 0 drops the
    row (``gone``), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes its role user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    times = F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", "turn", "role", "text", k.alias("_k")).select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        (F.col("_k") == 0).alias("gone"), times.alias("copy"))
