"""Repair of the turn structure of conversations.

The cheapest edits that turn a conversation's role initials into ``(s?(ua)+)?``: a row is kept, given the role
user or assistant, or deleted, and empty rows are inserted.  A Viterbi pass over four states (nothing yet, after
the system row, after a user row, after an assistant row) keeps one survivor a state in a tree of backpointers.
Branches without survivors are freed by reference counts, and once all survivors share an ancestor the edits up
to it are final and leave the tree; of equally cheap ways into a state the complete unresolved suffixes decide by
their letters.

A conversation may be of any length: rows are numbered in their order and cut into blocks of ``BLOCK`` rows.  Each
block is condensed to its cheapest way between every pair of states, one task walks over the condensed blocks of a
conversation (with the same tree), and the blocks are edited knowing the states that they begin and end in.
The project keeps no conversations, so the operator is general.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from barlens.llm.common import in_order
from barlens.session import stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows condensed together.
BLOCK = 4096
#: Blank is what consists of these alone.
SPACE = " \t\n\x0b\x0c\r"
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: Rows to insert to get from one state to another, where that can be part of a cheapest way.
_INSERTS = {p: {p: 0} for p in range(4)}
for _p, _q, _n in ((EMPTY, USER, 1), (EMPTY, ASSISTANT, 2), (SYSTEM, USER, 1), (SYSTEM, ASSISTANT, 2), (USER, ASSISTANT, 1), (ASSISTANT, USER, 1)):
    _INSERTS[_p][_q] = _n
#: A survivor is given up when another state's is cheaper by more than it could ever lose: (other, state) -> that much.
_BEHIND = {(EMPTY, SYSTEM): 0, (EMPTY, USER): INSERT, (EMPTY, ASSISTANT): 0, (ASSISTANT, EMPTY): DELETE, (USER, EMPTY): DELETE + INSERT, (ASSISTANT, SYSTEM): 0, (USER, SYSTEM): INSERT, (USER, ASSISTANT): INSERT, (ASSISTANT, USER): INSERT}
#: The empty rows that end a conversation in each state.
_TAIL = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Options = dict[int, list[tuple[int, int, str]]]


def row_options(kind: str) -> Options:
    """state -> [(next state, cost, letters)] of a row: ``d`` must be deleted; else its role's initial (``o``: any
    other), a capital if it is truncated."""
    extra, initial = (TRUNCATED if kind.isupper() else 0), kind.lower()
    out: Options = {}
    for p, reach in _INSERTS.items():
        best: dict[int, tuple[int, str]] = {}
        for at, n in reach.items():
            ways = [(at, DELETE, "D")]
            if initial != "d":
                follow = ASSISTANT if at == USER else USER
                ways.append((follow, REROLE + extra, "R"))
                if initial == ("a" if at == USER else "u"):
                    ways.append((follow, extra, "K"))
                if initial == "s" and at == EMPTY:
                    ways.append((SYSTEM, extra, "K"))
            for q, cost, letter in ways:
                way = (INSERT * n + cost, "I" * n + letter)
                best[q] = min(best.get(q, way), way)
        out[p] = [(q, *way) for q, way in sorted(best.items())]
    return out


ROW_OPTIONS = {kind: row_options(kind) for kind in "dsuaoSUAO"}


class Node:
    """A step of the tree: the letters it adds, the state it leads to, and how many nodes and survivors stand on it."""

    __slots__ = ("before", "letters", "refs", "state")

    def __init__(self, before: Node | None, letters: str, state: int):
        self.before, self.letters, self.state, self.refs = before, letters, state, 0
        if before is not None:
            before.refs += 1


class Survivors:
    """The cheapest way into each state, and of equally cheap ones the one least by its letters.

    Of two ways neither's letters are the beginning of the other's, since both end with a row's letter and hold as
    many of these.  So once two unresolved suffixes differ their order is settled for good, and ``rank``, the
    survivors' places in that order, carries the comparison of the complete suffixes from step to step.
    """

    #: Least number of steps between looks for a common ancestor.
    LOOK = 32

    def __init__(self, start: int):
        self.root = Node(None, "", start)
        self.root.refs = 1
        self.ends: dict[int, tuple[int, Node]] = {start: (0, self.root)}
        self.rank = {start: 0}
        self.steps = self.held = 0

    def step(self, options: Options) -> None:
        found: dict[int, tuple[int, int, str, Node]] = {}
        for p, (paid, node) in self.ends.items():
            for q, cost, letters in options[p]:
                way = (paid + cost, self.rank[p], letters, node)
                if q not in found or way[:3] < found[q][:3]:
                    found[q] = way
        behind = {q for (other, q), most in _BEHIND.items() if q in found and other in found and found[q][0] > found[other][0] + most}
        old = [node for _, node in self.ends.values()]
        kept = sorted((rank, letters, q) for q, (_, rank, letters, _) in found.items() if q not in behind)
        self.rank = {q: k for k, (_, _, q) in enumerate(kept)}
        self.ends = {}
        for _, letters, q in kept:
            cost, _, _, node = found[q]
            new = Node(node, letters, q)
            new.refs += 1
            self.ends[q] = (cost, new)
        for node in old:
            self._release(node)
        self.steps += 1

    @staticmethod
    def _release(node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs:
                return
            before, node.before = node.before, None
            node = before

    def settled(self, whole: bool = False) -> list[tuple[str, int]]:
        """(letters, state) of the steps that all survivors share and that have not been given before."""
        if not whole and self.steps < max(self.LOOK, self.held):
            return []
        self.steps, chain = 0, []
        node = next(iter(self.ends.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.before
        out = []
        for node in reversed(chain):
            if self.root.refs > 1:
                break
            node.before, self.root = None, node
            out.append((node.letters, node.state))
        self.held = len(chain) - len(out)
        return out

    def close(self, exit_: int) -> tuple[int, list[tuple[str, int]]]:
        """Keep one survivor alone: its cost and the steps not given before."""
        cost, node = self.ends[exit_]
        for q, (_, other) in self.ends.items():
            if q != exit_:
                self._release(other)
        self.ends = {exit_: (cost, node)}
        return cost, self.settled(whole=True)


def best_end(survivors: Survivors) -> int:
    """The state in which a conversation ends most cheaply, empty rows at its end included."""
    return min(survivors.ends, key=lambda q: (survivors.ends[q][0] + INSERT * len(_TAIL[q]), survivors.rank[q]))


def _condense(kinds: str, start: int) -> dict[int, tuple[int, str]]:
    walk, done = Survivors(start), []
    for kind in kinds:
        walk.step(ROW_OPTIONS[kind])
        done += [letters for letters, _ in walk.settled()]
    out = {}
    for q, (cost, node) in walk.ends.items():
        rest = []
        while node is not walk.root:
            rest.append(node.letters)
            node = node.before
        out[q] = (cost, "".join([*done, *reversed(rest)]))
    return out


#: Answers for runs of at most ``SHORT`` rows, which repeat; a task forgets them all when it holds so many.
SHORT, MOST_KEPT = 32, 1 << 16
_kept: dict[tuple, object] = {}


def _remembered(run: Callable, kinds: str, *states: int) -> object:
    if len(kinds) > SHORT:
        return run(kinds, *states)
    key = (len(states), kinds, *states)
    if key not in _kept:
        if len(_kept) >= MOST_KEPT:
            _kept.clear()
        _kept[key] = run(kinds, *states)
    return _kept[key]


def condensed(kinds: str, start: int) -> dict[int, tuple[int, str]]:
    """exit state -> (cost, letters) of the rows from a state."""
    return _remembered(_condense, kinds, start)


def edited(kinds: str, start: int, exit_: int) -> list[str]:
    """The letters of each row on the way between two states."""
    walk, out = Survivors(start), []
    for kind in kinds:
        walk.step(ROW_OPTIONS[kind])
        out += [letters for letters, _ in walk.settled()]
    return out + [letters for letters, _ in walk.close(exit_)[1]]


def _pieces(conversations: list) -> Iterator[tuple[int, int]]:
    """(from, to) of the rows of one conversation in a block."""
    start = 0
    for k in range(1, len(conversations) + 1):
        if k == len(conversations) or conversations[k] != conversations[start]:
            yield start, k
            start = k


def _condense_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("position")
    ids, kinds = rows["conv_id"].to_pylist(), "".join(rows["kind"].to_pylist())
    firsts, costs, ranks = [], [], []
    for a, b in _pieces(ids):
        cost, rank = [-1] * 16, [0] * 16
        for p in range(4):
            ways = condensed(kinds[a:b], p)
            for k, (_, q, total) in enumerate(sorted((letters, q, total) for q, (total, letters) in ways.items())):
                cost[4 * p + q], rank[4 * p + q] = total, k
        firsts.append(a)
        costs.append(cost)
        ranks.append(rank)
    out = rows.select(["conv_id", "block"]).take(firsts)
    return out.append_column("costs", pa.array(costs, pa.list_(pa.int64()))).append_column("ranks", pa.array(ranks, pa.list_(pa.int32())))


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States in which each conversation enters and leaves its blocks; blocks come in order, conversation by conversation."""
    schema = walk = last = None
    ids, blocks, entry = [], [], EMPTY  # blocks whose states are still open
    out: list[tuple] = []

    def give(done: list[tuple[str, int]], end: bool) -> None:
        nonlocal entry
        for k, (_, state) in enumerate(done):
            out.append((ids[k], blocks[k], entry, state, end and k == len(done) - 1))
            entry = state
        del ids[: len(done)], blocks[: len(done)]

    def finish() -> None:
        nonlocal entry
        if walk is not None and blocks:
            give(walk.close(best_end(walk))[1], True)
        entry = EMPTY

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        arrays = [pa.array(columns[0], schema), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.bool_())]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "block", "entry", "exit", "ends"])

    for rows in batches:
        schema = rows.schema.field("conv_id").type
        for conversation, block, costs, ranks in zip(*(rows[c].to_pylist() for c in ("conv_id", "block", "costs", "ranks")), strict=True):
            if walk is None or conversation != last:
                finish()
                walk, last = Survivors(EMPTY), conversation
            else:
                give(walk.settled(), False)
            ids.append(conversation)
            blocks.append(block)
            walk.step({p: [(q, costs[4 * p + q], chr(48 + ranks[4 * p + q])) for q in range(4) if costs[4 * p + q] >= 0] for p in range(4)})
        if out:
            yield batch()
    finish()
    if out:
        yield batch()


def _edit_block(rows: pa.Table, states: pa.Table) -> pa.Table:
    rows = rows.sort_by("position")
    ids, kinds = rows["conv_id"].to_pylist(), "".join(rows["kind"].to_pylist())
    ways = {s["conv_id"]: s for s in states.to_pylist()}
    edits, roles = [], []
    for a, b in _pieces(ids):
        way = ways[ids[a]]
        state, piece = way["entry"], kinds[a:b]
        letters = list(_remembered(edited, piece, state, way["exit"]))
        if way["ends"]:
            letters[-1] += _TAIL[way["exit"]]
        for kind, row in zip(piece, letters, strict=True):
            given = ""
            for letter in row:
                if letter == "D":
                    continue
                if letter == "K" and kind in "sS" and state == EMPTY:
                    state, role = SYSTEM, "s"
                else:
                    state, role = (ASSISTANT, "a") if state == USER else (USER, "u")
                given += role
            edits.append(row)
            roles.append(given)
    out = rows.select(["position"])
    return out.append_column("edits", pa.array(edits, pa.string())).append_column("roles", pa.array(roles, pa.string()))


def _fields(conv_type: DataType, rest: str) -> StructType:
    schema = StructType().add("conv_id", conv_type)
    for field in StructType.fromDDL(rest).fields:
        schema.add(field)
    return schema


def repair_conversations(turns: DataFrame) -> DataFrame:
    """Every row of ``turns`` (conv_id, turn, role, text) with its first fault and its edits.

    Rows of a conversation go by turn (nulls first), equal turns by role and then by a hash of the text; a null
    role or text counts as one space.  Result, one row per row: conv_id, position (number of the row over all
    conversations, rising within one), turn, role, text, fault (``blank``: nothing but white space; ``duplicate``:
    role and text seen earlier in the conversation; ``truncated``: the last visible character is none of ``.!?``;
    or null), edits (letters: an ``I`` for every row inserted before this one, then ``K`` kept, ``R`` another
    role, or ``D`` deleted; a conversation's last row also has the ``I`` of rows inserted after it), roles (an
    initial for every letter but ``D``: the roles after the repair).

    Blank and duplicate rows are always deleted.  Costs: another role 3, deletion 4, insertion 3, a truncated row
    that stays 3.  Of all cheapest edits those whose letters come first are taken.  Rows without conv_id are one
    conversation.  Repeated rows are duplicates; other columns are ignored; an empty table gives no rows.
    """
    conv_type = turns.schema["conv_id"].dataType
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = in_order(rows.withColumn("tie", F.xxhash64("text")), ["conv_id", "turn", "role", "tie"], "conversation-rows", "position")
    visible = F.rtrim("text", F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    marks = rows.select(
        "position", "conv_id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("content"),
        (F.length(visible) == 0).alias("blank"), (~F.right(visible, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"))
    firsts = marks.filter(~F.col("blank")).groupBy("conv_id", "content").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("truncated"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(F.col("fault").isNotNull(), F.upper("initial")).otherwise(F.col("initial"))
    kinds = marks.join(firsts, "position", "left").withColumn("fault", fault)
    kinds = kinds.select("position", "conv_id", "fault", kind.alias("kind"), F.expr(f"position div {BLOCK}").alias("block"))
    kinds = stored(kinds, "conversation-kinds")
    steps = kinds.select("position", "conv_id", "kind", "block")
    pieces = steps.groupBy("block").applyInArrow(_condense_block, _fields(conv_type, "block bigint, costs array<bigint>, ranks array<int>"))
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    states = stored(pieces.mapInArrow(_walk, _fields(conv_type, "block bigint, entry int, exit int, ends boolean")), "conversation-states")
    edits = steps.groupBy("block").cogroup(states.groupBy("block")).applyInArrow(_edit_block, "position bigint, edits string, roles string")
    edits = kinds.select("position", "fault").join(edits, "position")
    return rows.drop("tie").join(edits, "position").select("conv_id", "position", "turn", "role", "text", "fault", "edits", "roles")


_ROLE = {"s": "system", "u": "user", "a": "assistant"}
_FIGURES, _TEXTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), ("audit", "repaired_sha256")


class Digest:
    """Figures of one conversation, row by row."""

    def __init__(self, conversation: object):
        self.conversation, self.faults = conversation, {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.initial = None
        self.turns = self.illegal = self.cost = self.written = 0
        self.audit: list[str] = []
        self.sha = hashlib.sha256()

    def add(self, turn: int | None, role: str, text: str, fault: str | None, edits: str, roles: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        self.audit.append(edits)
        given = iter(roles)
        for letter in edits:
            self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[letter]
            if letter == "D":
                continue
            to = next(given)
            if letter != "I" and fault == "truncated":
                self.cost += TRUNCATED
            self.sha.update((("\n" if self.written else "") + f"{role if letter == 'K' else _ROLE[to]}:{'' if letter == 'I' else text}").encode())
            self.written += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conversation, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: Digest | None = None
    fields = None
    for rows in batches:
        if fields is None:
            fields = [pa.field("conv_id", rows.schema.field("conv_id").type), *[pa.field(f, pa.int64()) for f in _FIGURES], *[pa.field(f, pa.string()) for f in _TEXTS]]
        done = []
        for conversation, *values in zip(*(rows[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "edits", "roles")), strict=True):
            if open_ is None or open_.conversation != conversation:
                if open_ is not None:
                    done.append(open_.row())
                open_ = Digest(conversation)
            open_.add(*values)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), fields, strict=True)], schema=pa.schema(fields))
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(open_.row(), fields, strict=True)], schema=pa.schema(fields))


def conversation_report(repaired: DataFrame) -> DataFrame:
    """Per conversation of ``repair_conversations``: conv_id, gaps (missing numbers between the first and last turn,
    rows without a turn ignored), rows by first fault (blank, duplicate, truncated), illegal (neighbouring rows
    whose role initials are not su, ua or au), cost, audit (all edit letters), repaired_sha256 (of the repaired
    ``role:text`` lines).  Rows stream through in their order; only the letters of a conversation are held."""
    conv_type = repaired.schema["conv_id"].dataType
    rows = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.select("conv_id", "turn", "role", "text", "fault", "edits", "roles").mapInArrow(_digests, _fields(conv_type, ", ".join([*[f"{c} bigint" for c in _FIGURES], *[f"{c} string" for c in _TEXTS]])))
