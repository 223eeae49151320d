"""Chat formatting with minimum-cost role repair.

The legal orders of turns are an automaton: an optional system turn first, then user and assistant in turn, the assistant last.
A conversation is repaired by the cheapest mix of keeping a turn, giving it another role, merging it into the turn before it and
inserting empty turns; Costs has the price of each; a known role is
changed only where no merge or insertion helps.  Turns are cut into blocks by turn number (and turns without a number by the first
bytes of role and text), and blocks into parts of at most BLOCK rows as they stream by.  A part's effect is a matrix of least
costs between automaton states, and such matrices multiply (minimum of sums), so parts of one long conversation are
priced by different tasks, chained through their small matrices, and traced back by different tasks again; no task holds
more than a part, however many rows share a turn number.

Every row has the piece of rendered text that it adds; the pieces in order are the formatted conversation, so no task or row
holds a whole one.

Defined results: null text counts as empty; null or unknown roles are roles that must be changed; turns are in order of turn
(nulls last, these by the first two bytes of role and of text), then role, then text, then row; repeated rows are turns of their own, which merge; an empty table gives an
empty result; null conversation ids are one conversation; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from boundwell.llm.runtime import cut

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Turn numbers of a block, and rows of a part of it.
BLOCK = 512
FAR = 1 << 40
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Costs:
    relabel: int = 10
    merge: int = 2
    insert: int = 3


#: Least ways, as inserted roles, from one state to a state in which a message of that role may follow.
def _gap(state: int, role: int) -> tuple[int, ...] | None:
    """Roles of the empty messages that must stand between state and a message of role; None if none can help."""
    if role == SYSTEM:
        return () if state == START else None
    if role == USER:
        return (ASSISTANT,) if state == USER else ()
    return () if state == USER else (USER,)


def steps(role: str | None, costs: Costs) -> list[tuple[int, int, int, str]]:
    """Ways to take a turn: (state before, state after, cost, action), cheapest and plainest first for equal ends."""
    own = ROLES.index(role) + 1 if role in ROLES else 0
    out = []
    for before in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            change = 0 if to == own else costs.relabel
            if (gap := _gap(before, to)) is not None:
                out.append((before, to, change + costs.insert * len(gap), "keep" if to == own else "relabel"))
            if before == to:
                out.append((before, to, change + costs.merge, "merge" if to == own else "relabel+merge"))
    return out


def ending(state: int, costs: Costs) -> tuple[int, tuple[int, ...]]:
    """Cost and inserted roles that make a conversation in this state end with the assistant."""
    gap = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
    return costs.insert * len(gap), gap


def price(roles: list[str | None], costs: Costs, known: dict | None = None) -> list[list[int]]:
    """The block's matrix: least cost from each state before it to each after it."""
    known = {} if known is None else known
    matrix = [[0 if a == b else FAR for b in range(4)] for a in range(4)]
    for role in roles:
        ways = known.setdefault(role, steps(role, costs))
        nxt = [[FAR] * 4 for _ in range(4)]
        for before, after, cost, _ in ways:
            for a in range(4):
                nxt[a][after] = min(nxt[a][after], matrix[a][before] + cost)
        matrix = nxt
    return matrix


def trace(roles: list[str | None], first: int, last: int, costs: Costs) -> list[tuple[str, int, tuple[int, ...]]]:
    """The cheapest way from state first to state last: (action, role taken, inserted roles before it) of each turn.

    Of equally cheap ways the one whose last differing turn comes first in steps() order is taken.
    """
    best, back, known = [0 if s == first else FAR for s in range(4)], [], {}
    for role in roles:
        ways = known.setdefault(role, steps(role, costs))
        nxt, came = [FAR] * 4, [None] * 4
        for before, after, cost, action in ways:
            if best[before] + cost < nxt[after]:
                nxt[after], came[after] = best[before] + cost, (before, action)
        best = nxt
        back.append(came)
    out, state = [], last
    for came in reversed(back):
        before, action = came[state]
        out.append((action, state, () if action.endswith("merge") else _gap(before, state)))
        state = before
    return out[::-1]


def chain(blocks: list[tuple[int, list[int]]], costs: Costs) -> list[tuple[int, int, int, int]]:
    """(block, state before, state after, cost of the conversation) for the (block, matrix) of a conversation in order."""
    best, came = [0, FAR, FAR, FAR], []
    for _, m in blocks:
        ways = [min((best[a] + m[4 * a + b], a) for a in range(4)) for b in range(4)]
        came.append([a for _, a in ways])
        best = [cost for cost, _ in ways]
    total, state = min((best[s] + ending(s, costs)[0], s) for s in range(4))
    out = []
    for (block, _), back in zip(reversed(blocks), reversed(came), strict=True):
        out.append((block, back[state], state, total))
        state = back[state]
    return out[::-1]


def _message(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role - 1]}\n{text}"


def render(action: str, role: int, gap: tuple[int, ...], text: str, first: bool, tail: tuple[int, ...] | None) -> str:
    """The text that one turn adds. tail: the roles inserted after the last turn, None for other turns."""
    end = "<|im_end|>\n"
    piece = "\n" + text if action.endswith("merge") else ("" if first else end) + "".join(_message(r) + end for r in gap) + _message(role, text)
    return piece if tail is None else piece + end + "".join(_message(r) + end for r in tail)


def _parts(frames: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (conv, block), which stand together in a task, in parts of at most `most`: ((conv, block, part), rows)."""
    key, part, rows = None, 0, []
    for batch in frames:
        for row in batch.to_pylist():
            own = (row["conv"], row["block"])
            if rows and (own != key or len(rows) == most):
                yield (*key, part), rows
                part, rows = part + 1, []
            if own != key:
                key, part = own, 0
            rows.append(row)
    if rows:
        yield (*key, part), rows


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """One row per turn: conv_id, turn, block, place (in the block), action, role, inserted_before, inserted_after, piece; and the conversation's cost."""
    role = F.lower(F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit(""))))
    for alias, name in ALIASES.items():
        role = F.when(role == alias, name).otherwise(role)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Turns without a number, in blocks after all others: the first two bytes of role and of text as a number.
    front = lambda c: F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 4), 4, "0"), 16, 10).cast("long")
    loose = F.lit(1 << 62) + front(role) * 65536 + front(text)
    base = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.floor(F.col(turn_col).cast("long") / block), loose).cast("long").alias("block"),
        role.alias("role"),
        text.alias("text"),
    )
    order = ("conv", "block", F.col("turn").asc_nulls_last(), "role", "text")
    dealt = base.repartition("conv", "block").sortWithinPartitions(*order)
    conv_type = base.schema["conv"].dataType.simpleString()
    conv_arrow = to_arrow_type(base.schema["conv"].dataType)

    def priced(batches):
        kind = pa.schema([("conv", conv_arrow), ("block", pa.int64()), ("part", pa.int64()), ("matrix", pa.list_(pa.int64()))])
        for (conv, blk, part), rows in _parts(batches, block):
            matrix = price([r["role"] for r in rows], costs)
            yield pa.RecordBatch.from_pylist([{"conv": conv, "block": blk, "part": part, "matrix": [x for line in matrix for x in line]}], schema=kind)

    matrices = cut(dealt.select("conv", "block", "role").mapInArrow(priced, f"conv {conv_type}, block long, part long, matrix array<long>"))

    # How each part is entered and left on the cheapest way, from a conversation's matrices in order: a row of numbers for each.
    names = ("conv", "block", "part", "entered", "left", "cost", "first", "last")
    kinds = (conv_arrow, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_())

    def chained(batches):
        conv, held, out = None, [], []

        def close() -> None:
            for ((block_, part), entered, left, cost), i in zip(chain(held, costs), range(len(held)), strict=True):
                out.append((conv, block_, part, entered, left, cost, i == 0, i == len(held) - 1))

        def table():
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], list(names))

        for batch in batches:
            for c, blk, part, matrix in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and c != conv:
                    close()
                    held = []
                conv = c
                held.append(((blk, part), matrix))
            if len(out) > 10_000:
                yield table()
                out = []
        if held:
            close()
        yield table()

    in_order = matrices.repartition("conv").sortWithinPartitions("conv", "block", "part")
    ends = in_order.mapInArrow(chained, f"conv {conv_type}, block long, part long, entered int, left int, cost long, first boolean, last boolean")
    # A block's rows meet its parts' ways, a row for each block of at most BLOCK rows and one for each further part of it, in its order: ways first.
    ways = ends.select("conv", "block", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.struct("part", "entered", "left", "cost", "first", "last").alias("way"))
    both = base.withColumn("way", F.lit(None).cast(ways.schema["way"].dataType)).unionByName(ways)
    ready = both.repartition("conv", "block").sortWithinPartitions("conv", "block", F.col("way").isNull(), "way.part", *order[2:])

    shown = ("conv_id", "turn", "block", "place", "action", "role", "inserted_before", "inserted_after", "cost", "piece")
    types = (conv_arrow, pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string())

    def written(batches):
        def told(batches, known):
            """The turns, while the ways of the current block are kept: six numbers for each of its parts."""
            for batch in batches:
                way = batch.column("way")
                turns_ = batch.filter(way.is_null())
                for c, k, w in zip(*(batch.column(n).filter(way.is_valid()).to_pylist() for n in ("conv", "block", "way")), strict=True):
                    known[c, k, w["part"]] = w
                yield turns_

        known: dict = {}
        for key, rows in _parts(told(batches, known), block):
            way = known.pop(key)
            steps_ = trace([r["role"] for r in rows], way["entered"], way["left"], costs)
            out = []
            for i, (r, (action, to, gap)) in enumerate(zip(rows, steps_, strict=True)):
                tail = ending(way["left"], costs)[1] if way["last"] and i == len(rows) - 1 else None
                piece = render(action, to, gap, r["text"], way["first"] and i == 0, tail)
                out.append((key[0], r["turn"], key[1], key[2] * block + i, action, ROLES[to - 1], len(gap), len(tail or ()), way["cost"], piece))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], list(shown))

    return ready.mapInArrow(written, f"conv_id {conv_type}, turn long, block long, place int, action string, role string, inserted_before int, inserted_after int, cost long, piece string")
