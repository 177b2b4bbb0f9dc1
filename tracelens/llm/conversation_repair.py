"""Repair of conversations' structure by error-correcting Earley parsing.

The grammar says which roles may follow one another: a system turn or none, then pairs of user and assistant, or nothing at all.
Error productions with a price let a turn be deleted, given another role, or put in. Chart items (rule, dot, origin) keep the
least (cost, audit), where the audit has one letter for each edit: Keep, Rerole, Delete, Insert. The rules recurse on the left, so
that every item starts at the first turn and a set of the chart has a fixed number of items: parsing takes linear time.

Spark deals out the rows by conversation, sorts them (spilling where it must) and marks their faults; a task streams through them.
What all live items agree on is decided and leaves the task every SLICE_BYTES of text, so a conversation of any length needs no
more memory than that, apart from edits that stay open (as where no turn at all has a role of the grammar). Items that another one beats whatever follows are dropped for it (`BEATEN`).
A conversation's rows meet in one task, but as a stream: the order of its turns and the hash over them are sequential.

Cases: null role and text read as one space; null turns come first, and turns that are equal go by role and text. A null conv_id
is a conversation of its own. Repeated rows are duplicates. A text of white space is blank. Roles other than system, user and
assistant are in no rule, so such a turn is deleted or gets another role. Other columns are ignored, whatever their names. An
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Left side, right side. Small letters stand for a turn of that initial, * for a deleted one.
RULES = (
    ("Goal", ("Empty",)),
    ("Goal", ("Pairs",)),
    ("Empty", ()),
    ("Empty", ("Empty", "*")),
    ("System", ("Empty", "s")),
    ("System", ("System", "*")),
    ("User", ("Empty", "u")),
    ("User", ("System", "u")),
    ("User", ("Pairs", "u")),
    ("User", ("User", "*")),
    ("Pairs", ("User", "a")),
    ("Pairs", ("Pairs", "*")),
)
RULES_OF = {lhs: tuple(i for i, r in enumerate(RULES) if r[0] == lhs) for lhs, _ in RULES}
#: What a parse that stands at the second can lack, at most, against one that stands at the first: the turns to put in or to delete.
BEATEN = {
    ("Pairs", "Empty"): DELETE,
    ("User", "Empty"): INSERT + DELETE,
    ("System", "Empty"): 2 * INSERT,
    ("Pairs", "System"): 0,
    ("Empty", "System"): 0,
    ("User", "System"): INSERT,
    ("Empty", "Pairs"): 0,
    ("User", "Pairs"): INSERT,
    ("System", "Pairs"): 2 * INSERT,
    ("Pairs", "User"): INSERT,
    ("Empty", "User"): INSERT,
    ("System", "User"): INSERT,
}
NAMES = {"u": "user", "a": "assistant"}
FINE, BLANK, CUT_OFF, DUPLICATE = range(4)  # a repeat sorts behind the row that it repeats
SPACE = " \t\n\x0b\x0c\r"
TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = "conv_id long, part int, turns array<struct<role:string,text:string>>, audit string, " + ", ".join(f"{c} long" for c in COUNTS)


def symbol(role: str, fault: int) -> str:
    """What the parser sees of a turn: its role's initial, a capital if it is cut off; o for other roles, x for what must go."""
    if fault in (BLANK, DUPLICATE):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == CUT_OFF else initial


@lru_cache(256)
def reads(terminal: str, seen: str) -> tuple[tuple[int, str], ...]:
    """The prices and letters at which a terminal can read a turn."""
    if terminal == "*":
        return ((DELETE, "D"),)
    if seen == "x":
        return ()
    more = TRUNCATED if seen.isupper() else 0
    keep = ((more, "K"),) if seen.lower() == terminal else ()
    return keep + (((REROLE + more, "R"),) if terminal in NAMES and not keep else ())


class Chart:
    """The sets of the chart that live items start in, and the latest one."""

    def __init__(self):
        self.at, self.sets = 0, {}
        self._close({(r, 0, 0): (0, "") for r in RULES_OF["Goal"]})

    def _close(self, here: dict) -> None:
        """Predicts, completes and inserts until no item of the set gets better."""
        self.sets[self.at] = here
        todo = list(here)

        def put(item, value):
            if item not in here or value < here[item]:
                here[item] = value
                todo.append(item)

        while todo:
            item = todo.pop()
            (rule, dot, origin), (cost, audit) = item, here[item]
            lhs, rhs = RULES[rule]
            if dot == len(rhs):
                for (r, d, o), (c, a) in list(self.sets[origin].items()):
                    if d < len(RULES[r][1]) and RULES[r][1][d] == lhs:
                        put((r, d + 1, o), (c + cost, a + audit))
            elif (after := rhs[dot]) in RULES_OF:
                for r in RULES_OF[after]:
                    put((r, 0, self.at), (0, ""))
                    if (r, len(RULES[r][1]), self.at) in here:
                        c, a = here[r, len(RULES[r][1]), self.at]
                        put((rule, dot + 1, origin), (cost + c, audit + a))
            elif after in NAMES:
                put((rule, dot + 1, origin), (cost + INSERT, audit + "I"))
        done = {RULES[r][0]: v[0] for (r, d, o), v in sorted(here.items(), key=lambda x: -x[1][0]) if d == len(RULES[r][1])}
        beaten = {b for (a, b), more in BEATEN.items() if a in done and b in done and done[a] + more < done[b]}
        for r, d, o in list(here):
            if self.at and ((d and RULES[r][1][0] in beaten and d < len(RULES[r][1])) or (d == len(RULES[r][1]) and RULES[r][0] in beaten)):
                del here[r, d, o]
        live = {o for _, _, o in here}
        self.sets = {k: v for k, v in self.sets.items() if k in live or k == self.at}

    def read(self, seen: str) -> None:
        """One more turn."""
        old, new = self.sets[self.at], {}
        for (rule, dot, origin), (cost, audit) in old.items():
            rhs = RULES[rule][1]
            if dot < len(rhs) and rhs[dot] not in RULES_OF:
                for price, letter in reads(rhs[dot], seen):
                    value = (cost + price, audit + letter)
                    item = (rule, dot + 1, origin)
                    if item not in new or value < new[item]:
                        new[item] = value
        self.at += 1
        self._close(new)

    def decided(self) -> str:
        """The letters that all live items begin with; they are taken off."""
        here = self.sets[self.at]
        same = os.path.commonprefix([a for _, a in here.values()]) if self.at else ""
        if same:
            self.sets[self.at] = {k: (c, a[len(same) :]) for k, (c, a) in here.items()}
        return same

    def best(self) -> tuple[int, str]:
        return min(v for (r, d, o), v in self.sets[self.at].items() if RULES[r][0] == "Goal" and d == 1 and o == 0)


@lru_cache(1 << 14)
def parse(symbols: str) -> tuple[int, str]:
    """Least cost, and of the cheapest edits' letters the first in ASCII order."""
    chart = Chart()
    for s in symbols:
        chart.read(s)
    return chart.best()


class Conversation:
    """Reads a conversation's turns in order; `settle` gives the repaired turns that are decided."""

    def __init__(self, conv_id):
        self.conv_id, self.part, self.next = conv_id, 0, "u"
        self.held: list[tuple[str, str]] = []
        self.symbols, self.chart, self.limit = "", None, SLICE_BYTES
        self.turns, self.before = [], None
        self.bytes = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0

    def add(self, turn, role: str, text: str, fault: int) -> None:
        self.held.append((role, text))
        self.symbols += symbol(role, fault)
        self.bytes += len(text)
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == CUT_OFF
        self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn]
                self.distinct = 1
            elif turn != self.turns[1]:
                self.turns[1] = turn
                self.distinct += 1

    def _apply(self, audit: str) -> list[dict]:
        out, used = [], 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else self.held[used]
            used += letter != "I"
            if letter == "D":
                continue
            if letter in "RI":
                role = NAMES[self.next]
            out.append({"role": role, "text": text})
            self.next = {"s": "u", "u": "a", "a": "u"}[role[:1]]
        del self.held[:used]
        return out

    def settle(self, last: bool) -> dict | None:
        """A row of the result: the turns decided so far, or with last those left and the counts."""
        if last and self.chart is None:
            cost, audit = parse(self.symbols) if len(self.symbols) <= 64 else self._chart().best()
        else:
            chart = self._chart()
            cost, audit = chart.best() if last else (None, chart.decided())
        row = {"conv_id": self.conv_id, "part": self.part, "turns": self._apply(audit), "audit": audit}
        self.part, self.bytes = self.part + 1, sum(len(t) for _, t in self.held)
        self.limit = SLICE_BYTES + 2 * self.bytes  # edits that stay open are not asked for at every turn
        if last:
            gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
            row |= dict(zip(COUNTS, (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost), strict=True))
        return row

    def _chart(self) -> Chart:
        self.chart = self.chart or Chart()
        for s in self.symbols:
            self.chart.read(s)
        self.symbols = ""
        return self.chart


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and here: whether the row is left. The damage that the query op11 fixes, by crc32 of the row's ids;
    dropped rows stay as rows that aren't here, so that their conversations do."""
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    here = kind != 0
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = own.select("conv_id", "turn", here.alias("here"), F.when(here, F.when(kind == 4, "user").otherwise(F.col("role"))).alias("role"), F.when(here, text).alias("text"), (kind == 3).alias("twice"))
    copies = F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", "here", "role", "text", F.explode(copies)).drop("col")


def faults(rows: DataFrame) -> DataFrame:
    """The rows of `damage`, dealt out by conversation and in order, with the first fault of each."""
    turn = F.col("turn").asc_nulls_first()
    core = F.rtrim("text", F.lit(SPACE))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(turn)) > 1
    fault = F.when(~F.col("here"), F.lit(FINE)).when(core == "", BLANK).when(F.col("again"), DUPLICATE).when(~F.substring(core, -1, 1).isin(".", "!", "?"), CUT_OFF).otherwise(FINE)
    out = rows.repartition("conv_id").withColumn("again", again).select("conv_id", "turn", "here", "role", "text", fault.alias("fault"))
    return out.sortWithinPartitions("conv_id", turn, "role", "text", "fault")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations, from rows of conv_id, turn, role, text and, if some are only there for their conversation's sake,
    here. One row for a conversation, or several parts of a long one, next to one another; the last part has the counts, and cost
    and audit as said above. The other parts have nulls there and their own letters of the audit."""
    if "here" not in rows.columns:
        rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lit(True).alias("here"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    names = ["conv_id", "part", "turns", "audit", *COUNTS]
    types = [pa.int64(), pa.int32(), pa.list_(TURN), pa.string(), *[pa.int64()] * len(COUNTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held = None, [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in out], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for piece in slices(batch, "text"):
                for conv, turn, here, role, text, fault in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if now is None or conv != now.conv_id:
                        if now:
                            out.append(now.settle(True))
                        now = Conversation(conv)
                    if here:
                        now.add(turn, role, text, fault)
                        held += len(text)
                        if now.bytes > now.limit or len(now.symbols) > 1 << 16:
                            out.append(now.settle(False))
                    if held > SLICE_BYTES and out:
                        yield batch_of()
                        out, held = [], 0
        if now:
            out.append(now.settle(True))
        if out:
            yield batch_of()

    return faults(rows).mapInArrow(run, SCHEMA)


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation of `repair`: the counts, the whole audit, and the hash of its `role:text` lines."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, audit, first = hashlib.sha256(), [], True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                audit.append(r["audit"])
                for t in r["turns"]:
                    said.update((("" if first else "\n") + f"{t['role']}:{t['text']}").encode("utf-8", "surrogatepass"))
                    first = False
                if r["cost"] is not None:
                    out.append({"conv_id": r["conv_id"], **{c: r[c] for c in COUNTS}, "audit": "".join(audit), "repaired_sha256": said.hexdigest()})
                    said, audit, first = hashlib.sha256(), [], True
            names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], pa.int64() if n in ("conv_id", *COUNTS) else pa.string()) for n in names], names)

    return repaired.mapInArrow(lines, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
