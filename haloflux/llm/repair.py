"""Repair of the turn structure of conversations by lightest derivations.

A sound conversation has role initials ``(s?(ua)+)?`` and neither blank nor repeated rows.  The edits
keep, rerole or delete a row or insert an empty one; the cheapest sequence wins, among equally cheap
ones the least in ASCII order of the edits' initials.

Edits are deductions of a weighted hypergraph: from "the first i rows are edited, the last role
was q" and "row i is sound" follows "the first i + 1 rows are edited, ...".  Values are (cost, initials
so far), every rule is superior (its result is greater than each antecedent), so an agenda
that always pops the least value finalises each item with its lightest derivation and ends as soon
as the goal is popped.

A conversation goes through its task as a stream in order of turns, however long it is: rows are
taken in segments, and what a segment hands on is, for each of four possible last roles, its
cost, its edits as far as these differ, and the running hash of its repaired text.  Only the audit
itself, one byte an edit, grows with the conversation, and that is in the result.

Rows are ordered by turn, nulls first, then role, then text.  A null role or text is one space; rows
with a null conv_id are one conversation; exact repeats are duplicates; rows marked ``gone`` only
make their conversation appear; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haloflux.llm.scratch import arrow_settings

SPACES = " \t\n\x0b\x0c\r"
ENDINGS = (".", "!", "?")
#: Rows edited at once; longer conversations are taken in several segments.
SEGMENT = 256
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, REROLE, INSERT, UNFINISHED = 3, 2, 2, 1
#: Last role of what is repaired so far, and the roles that may follow it.
START = ""
FOLLOWS = {START: "su", "s": "u", "u": "a", "a": "u"}
COMPLETE = (START, "a")
LEGAL = ("su", "ua", "au")
ROLES = {"u": "user", "a": "assistant"}

Value = tuple[int, str]
Item = tuple
#: Antecedents, consequent, and the value of the consequent by the values of the antecedents.
Deduction = tuple[tuple[Item, ...], Item, Callable[..., Value]]


def lightest(axioms: dict[Item, Value], deductions: Callable[[Item], Iterable[Deduction]], goals: set[Item]) -> tuple[dict[Item, Value], dict[Item, Item]]:
    """Knuth's agenda: final values of the items popped until all goals are, and the first antecedent of each (none: an axiom).

    ``deductions(item)`` lists those with ``item`` among the antecedents; one fires when the last of
    its antecedents becomes final.
    """
    agenda = [(value, item, ()) for item, value in axioms.items()]
    heapq.heapify(agenda)
    final: dict[Item, Value] = {}
    back: dict[Item, Item] = {}
    open_goals = set(goals)
    while agenda and open_goals:
        value, item, source = heapq.heappop(agenda)
        if item in final:
            continue
        final[item] = value
        back[item] = source
        open_goals.discard(item)
        for antecedents, consequent, weigh in deductions(item):
            if consequent not in final and all(a in final for a in antecedents):
                heapq.heappush(agenda, (weigh(*(final[a] for a in antecedents)), consequent, antecedents[0]))
    return final, back


def _adding(cost: int, initial: str) -> Callable[..., Value]:
    return lambda prefix, *facts: (prefix[0] + cost, prefix[1] + initial)


_KEEP = {SOUND: _adding(0, "K"), TRUNCATED: _adding(UNFINISHED, "K")}
_REROLE = {SOUND: _adding(REROLE, "R"), TRUNCATED: _adding(REROLE + UNFINISHED, "R")}
_DELETE, _INSERT, _DONE = _adding(DELETE, "D"), _adding(INSERT, "I"), _adding(0, "")
#: Item that stands for a whole repaired conversation.
GOAL = ("~goal", 0)


def _edits(rows: list[tuple[int, str]], last: bool) -> Callable[[Item], Iterator[Deduction]]:
    """Deductions over rows (fault, role initial); an item is (role before, rows edited) or ('~row', row)."""

    def over(state: str, k: int) -> Iterator[Deduction]:
        fault, initial = rows[k]
        both = ((state, k), ("~row", k))
        yield both, (state, k + 1), _DELETE
        if fault in _KEEP:
            wanted = FOLLOWS[state]
            if initial and initial in wanted:
                yield both, (initial, k + 1), _KEEP[fault]
            yield both, (wanted[-1], k + 1), _REROLE[fault]

    def deductions(item: Item) -> Iterator[Deduction]:
        state, k = item
        if state == "~row":
            for before in FOLLOWS:
                yield from over(before, k)
        elif item != GOAL:
            if k < len(rows):
                yield from over(state, k)
            elif last and state in COMPLETE:
                yield (item,), GOAL, _DONE
            yield (item,), (FOLLOWS[state][-1], k), _INSERT

    return deductions


class Written:
    """Running hash of repaired rows and, if asked for, the rows."""

    def __init__(self, keep: bool):
        self.hash, self.empty, self.turns = hashlib.sha256(), True, [] if keep else None

    def copy(self) -> Written:
        other = Written.__new__(Written)
        other.hash, other.empty = self.hash.copy(), self.empty
        other.turns = None if self.turns is None else list(self.turns)
        return other

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.empty = False
        if self.turns is not None:
            self.turns.append({"role": role, "text": text})


class Repair:
    """One conversation, fed row by row in order."""

    def __init__(self, keep_turns: bool = False):
        self.rows: list[tuple[int, str, str]] = []
        self.settled: list[str] = []
        self.ways: dict[str, tuple[int, str, Written]] = {START: (0, "", Written(keep_turns))}
        self.faults = [0, 0, 0, 0]
        self.illegal = self.gaps = 0
        self.before = self.first = self.turn = None

    def row(self, turn: int | None, role: str, text: str, fault: int) -> None:
        initial = role[:1]
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        if turn is not None:
            if self.first is None:
                self.first = turn
            elif turn != self.turn:
                self.gaps += turn - self.turn - 1
            self.turn = turn
        self.rows.append((fault, role, text))
        if len(self.rows) > SEGMENT:
            self._edit(self.rows[:SEGMENT], last=False)
            self.rows = self.rows[SEGMENT:]

    def finish(self) -> tuple[int, str, Written]:
        """Cost, audit and repaired rows."""
        self._edit(self.rows, last=True)
        ((cost, audit, out),) = self.ways.values()
        return cost, "".join(self.settled) + audit, out

    def _edit(self, rows: list[tuple[int, str, str]], last: bool) -> None:
        n = len(rows)
        axioms: dict[Item, Value] = {("~row", k): (0, "") for k in range(n)}
        axioms |= {(state, 0): (cost, audit) for state, (cost, audit, _) in self.ways.items()}
        ends = {GOAL} if last else {(state, n) for state in FOLLOWS}
        final, back = lightest(axioms, _edits([(f, r[:1]) for f, r, _ in rows], last), ends)
        ways = {}
        for end in ends & final.keys():
            path = [end]
            while back[path[-1]]:
                path.append(back[path[-1]])
            path = [item for item in reversed(path) if item != GOAL]
            out = self.ways[path[0][0]][2].copy()
            cost, audit = final[end]
            edits = audit[len(final[path[0]][1]) :]
            for edit, (_, k), (state, _) in zip(edits, path, path[1:], strict=False):
                if edit == "I":
                    out.add(ROLES[state], "")
                elif edit != "D":
                    out.add(rows[k][1] if edit == "K" else ROLES[state], rows[k][2])
            ways[end[0]] = (cost, audit, out)
        # what all ways have in common is settled; comparisons need only the rest
        least, most = min(a for _, a, _ in ways.values()), max(a for _, a, _ in ways.values())
        same = next((k for k, (a, b) in enumerate(zip(least, most, strict=False)) if a != b), min(len(least), len(most)))
        self.settled.append(least[:same])
        self.ways = {state: (cost, audit[same:], out) for state, (cost, audit, out) in ways.items()}


def faults(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with their first fault, each conversation in order in one partition."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    dealt = turns.select("conv_id", "turn", "role", "text", "gone", F.sha2("text", 256).alias("same")).repartition("conv_id")
    # a window over more keys than the rows are dealt by needs no further shuffle
    seen = Window.partitionBy("conv_id", "gone", "role", "same").orderBy(F.asc_nulls_first("turn"))
    fault: Column = (
        F.when(trimmed == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(trimmed, F.lit(1)).isin(*ENDINGS), TRUNCATED).otherwise(SOUND)
    )
    found = dealt.withColumn("nth", F.row_number().over(seen)).withColumn("fault", fault)
    return found.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "nth").select("conv_id", "turn", "role", "text", "gone", "fault")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
ROWS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.large_string()), ("repaired_sha256", pa.string())])
TURNS = pa.field("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.large_string())])))


def repaired(turns: DataFrame, keep_turns: bool = False) -> DataFrame:
    """One row per conversation: counts of faults, cost and initials of the edits, hash of the repaired text and,
    with ``keep_turns``, the repaired rows.

    ``turns`` has conv_id, turn, role, text and, where some rows are to be left out, ``gone``.
    """
    arrow_settings(turns.sparkSession)
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(gone, F.lit(False)).alias("gone"),
    )
    schema = ROWS.append(TURNS) if keep_turns else ROWS

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def close(conv_id: int | None, repair: Repair) -> None:
            cost, audit, out = repair.finish()
            counts = (repair.gaps, *repair.faults[1:], repair.illegal, cost)
            done.append((conv_id, *counts, audit, out.hash.hexdigest()) + ((out.turns,) if keep_turns else ()))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return made

        at = repair = None
        for some in batches:
            for conv_id, turn, role, text, missing, fault in zip(*(c.to_pylist() for c in some.columns), strict=True):
                if repair is None or conv_id != at:
                    if repair is not None:
                        close(at, repair)
                    at, repair = conv_id, Repair(keep_turns)
                if not missing:
                    repair.row(turn, role, text, fault)
            if len(done) >= 1000:
                yield batch()
        if repair is not None:
            close(at, repair)
        if done:
            yield batch()

    fields = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return faults(rows).mapInArrow(stream, fields + (", repaired array<struct<role: string, text: string>>" if keep_turns else ""))
