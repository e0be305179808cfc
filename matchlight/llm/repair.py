"""Conversation structure: faults of damaged turns, and their cheapest repair by generalised LR parsing.

Role initials of a sound conversation are ``(s?(ua)+)?``, which the grammar below
derives. Its LR(0) automaton is built here; a repair is a parse whose input rows may be
kept, given another role, deleted, or preceded by inserted rows, each at a price. Stacks
share their lower parts (a graph of nodes), and equal stacks keep only the least
(cost, audit), so the frontier is a handful of nodes whatever the length.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The role grammar: a conversation is empty, or turns (user, assistant) with a system row before them or not.
GRAMMAR = (("C", ()), ("C", ("T",)), ("C", ("s", "T")), ("T", ("u", "a")), ("T", ("T", "u", "a")))
# Prices of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NAMES = {"u": "user", "a": "assistant"}
#: Rows between two writings-out of the audit's settled beginning.
SETTLE = 64


def automaton() -> tuple[list[dict[str, int]], list[list[tuple[str, int]]]]:
    """LR(0) states of ``GRAMMAR``: moves by symbol, and reductions ``(symbol, number of symbols)``."""

    def closed(items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        items, grown = set(items), True
        while grown:
            wanted = {GRAMMAR[r][1][at] for r, at in items if at < len(GRAMMAR[r][1])}
            new = {(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left in wanted} - items
            items, grown = items | new, bool(new)
        return frozenset(items)

    states = [closed({(r, 0) for r, (left, _) in enumerate(GRAMMAR) if left == "C"})]
    moves: list[dict[str, int]] = []
    for state in states:  # grows meanwhile
        out: dict[str, set] = {}
        for r, at in state:
            if at < len(GRAMMAR[r][1]):
                out.setdefault(GRAMMAR[r][1][at], set()).add((r, at + 1))
        move = {}
        for symbol, items in out.items():
            target = closed(items)
            if target not in states:
                states.append(target)
            move[symbol] = states.index(target)
        moves.append(move)
    ends = [[(GRAMMAR[r][0], len(GRAMMAR[r][1])) for r, at in sorted(s) if at == len(GRAMMAR[r][1])] for s in states]
    return moves, ends


class Node:
    """A stack: a state on another stack. Equal stacks are one node."""

    __slots__ = ("state", "below", "over")

    def __init__(self, state: int, below: Node | None):
        self.state, self.below, self.over = state, below, {}

    def push(self, state: int) -> Node:
        if state not in self.over:
            self.over[state] = Node(state, self)
        return self.over[state]


class Repair:
    """The cheapest repair of rows given one by one."""

    def __init__(self) -> None:
        self.moves, self.ends = automaton()
        self.settled: list[str] = []
        self.rows = 0
        self.least = {Node(0, None): (0, "")}
        self._inserted()

    def _shifted(self, node: Node, symbol: str) -> Iterator[Node]:
        """All stacks after reading ``symbol``: reductions leave the sentence form open, so both the stack and its reduced form stay."""
        todo, seen = [node], set()
        while todo:
            one = todo.pop()
            if one in seen:
                continue
            seen.add(one)
            if symbol in self.moves[one.state]:
                yield one.push(self.moves[one.state][symbol])
            for left, size in self.ends[one.state]:
                low = one
                for _ in range(size):
                    low = low.below
                if left in self.moves[low.state]:
                    todo.append(low.push(self.moves[low.state][left]))

    @staticmethod
    def _keep(found: dict[Node, tuple[int, str]], node: Node, way: tuple[int, str]) -> bool:
        if node in found and found[node] <= way:
            return False
        found[node] = way
        return True

    def _inserted(self) -> None:
        """Rows inserted before the next one."""
        todo = list(self.least)
        while todo:
            node = todo.pop()
            cost, audit = self.least[node]
            for symbol in NAMES:
                todo += [over for over in self._shifted(node, symbol) if self._keep(self.least, over, (cost + INSERT, audit + "I"))]

    def add(self, initial: str, must_go: bool, truncated: bool) -> None:
        after: dict[Node, tuple[int, str]] = {}
        more = TRUNCATED * truncated
        for node, (cost, audit) in self.least.items():
            self._keep(after, node, (cost + DELETE, audit + "D"))
            if must_go:
                continue
            for symbol in (*NAMES, initial):
                for over in self._shifted(node, symbol):
                    self._keep(after, over, (cost + more + REROLE, audit + "R") if symbol != initial else (cost + more + KEEP, audit + "K"))
        self.least = after
        self._inserted()
        self.rows += 1
        if self.rows % SETTLE == 0:  # ties are decided by what follows the common beginning
            common = os.path.commonprefix([a for _, a in self.least.values()])
            self.settled.append(common)
            self.least = {n: (c, a[len(common) :]) for n, (c, a) in self.least.items()}

    def _accepts(self, node: Node) -> bool:
        """Whether some chain of reductions ends with the whole conversation."""
        for left, size in self.ends[node.state]:
            low = node
            for _ in range(size):
                low = low.below
            if left == "C" and low.below is None or left in self.moves[low.state] and self._accepts(low.push(self.moves[low.state][left])):
                return True
        return False

    def best(self) -> tuple[int, str]:
        cost, audit = min(way for node, way in self.least.items() if self._accepts(node))
        return cost, "".join(self.settled) + audit


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[str]:
    """``role:text`` of the rows that ``audit`` leaves: an inserted or re-roled one takes the role that its place asks for."""
    source, place = iter(rows), 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(source)
        if edit == "D":
            continue
        if edit != "K":
            role = NAMES["ua"[place % 2]]
        place += not (place == 0 and role[:1] == "s")
        yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, dropped, duplicate)`` in which nulls of role and text are one space.

    crc32 of ``conv_id:turn`` mod 20 says what befalls a row: 0 drops it (it stays
    here, marked), 1 empties its text, 2 takes its ``[.!?]``, 3 doubles it, 4 makes it
    the user's. ``duplicate`` marks a row whose role and text stand in an earlier row.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), mark.alias("mark"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("mark") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, F.lit("")).when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("mark") == 0).alias("dropped"), F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    said = Window.partitionBy("conv_id", "dropped", "role", F.sha2("text", 256)).orderBy("turn", "copy")
    return rows.select("conv_id", "turn", "role", "text", "dropped", (F.row_number().over(said) > 1).alias("duplicate"))


SPACE = " \t\n\v\f\r"
FIELDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Conversation:
    """Counts and repair of one conversation, its rows given in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.first, self.last, self.turns = conv_id, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before, self.repair, self.rows = None, Repair(), []

    def add(self, turn: int | None, role: str, text: str, duplicate: bool) -> None:
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        said = text.rstrip(SPACE)
        blank, truncated = not said, bool(said) and not duplicate and said[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.repair.add(initial, blank or duplicate, truncated)
        self.rows.append((role, text))

    def result(self) -> tuple:
        cost, audit = self.repair.best()
        digest = hashlib.sha256()
        for k, line in enumerate(repaired(self.rows, audit)):
            digest.update(("\n" * (k > 0) + line).encode())
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


def _parsed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Results of conversations whose rows follow each other."""
    now, done = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "duplicate")]
        for conv_id, turn, role, text, dropped, duplicate in zip(*columns, strict=True):
            if now is None or now.conv_id != conv_id:
                done += [now.result()] if now else []
                now = Conversation(conv_id)
            if not dropped:
                now.add(turn, role, text, duplicate)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema) if done else pa.RecordBatch.from_pylist([], schema)
        done = []
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.result(), schema, strict=True)], schema=schema)


def report(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations(conv_id, turn, role, text)``: faults, cost, audit and digest of its repair.

    Null role and text are one space, as are null ids and turns under the damage's
    crc32; rows of a null ``conv_id`` are one conversation. Order is by turn, nulls
    first, equal turns by role, then text, so repeated rows are duplicates of the
    first. A conversation all of whose rows are dropped has zeros, an empty audit and
    the digest of an empty text. An empty table gives none; other columns are ignored.

    Duplicates are marked by a window over role and text, so a long conversation's rows
    are spread there. The repair and its digest run through a conversation in order: one
    task streams it, holding its rows once and the audit.
    """
    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in FIELDS.split(", "))])
    rows = damaged(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "duplicate")
    return rows.mapInArrow(lambda batches: _parsed(batches, schema), FIELDS)
