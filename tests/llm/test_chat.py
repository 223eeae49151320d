import itertools

import pytest

from boundwell.llm import chat as C

TURN = "conv_id long, turn long, role string, text string"
COSTS = C.Costs()


def cheapest(roles):
    """Least cost by trying all ways with Dijkstra-like enumeration of single edits."""
    best = {C.START: 0}
    for role in roles:
        own = C.ROLES.index(role) + 1 if role in C.ROLES else 0
        after = {}
        for state, cost in best.items():
            # Insert up to three empty messages, then take the turn as a message or merge it.
            for n in range(4):
                for extra in itertools.product((1, 2, 3), repeat=n):
                    s = state
                    for x in extra:
                        if not legal(s, x):
                            break
                        s = x
                    else:
                        for to in (1, 2, 3):
                            change = 0 if to == own else COSTS.relabel
                            if legal(s, to):
                                after[to] = min(after.get(to, 99999), cost + n * COSTS.insert + change)
                            if s == to:
                                after[to] = min(after.get(to, 99999), cost + n * COSTS.insert + change + COSTS.merge)
        best = after
    return min(cost + C.ending(s, COSTS)[0] for s, cost in best.items())


def legal(state, role):
    return {C.SYSTEM: state == C.START, C.USER: state != C.USER, C.ASSISTANT: state == C.USER}[role]


@pytest.mark.parametrize("n", range(5))
def test_cost_is_least_over_all_repairs(n):
    for roles in itertools.product(("system", "user", "assistant", "?"), repeat=n):
        matrix = C.price(list(roles), COSTS)
        got = min(matrix[C.START][s] + C.ending(s, COSTS)[0] for s in range(4))
        assert got == cheapest(roles), roles


def test_trace_is_legal_and_costs_what_it_says():
    for roles in itertools.product(("system", "user", "assistant", None), repeat=4):
        matrix = C.price(list(roles), COSTS)
        total, last = min((matrix[C.START][s] + C.ending(s, COSTS)[0], s) for s in range(4))
        cost, state = 0, C.START
        for role, (action, to, gap) in zip(roles, C.trace(list(roles), C.START, last, COSTS), strict=True):
            for x in gap:
                assert legal(state, x)
                state = x
            cost += COSTS.insert * len(gap) + COSTS.relabel * ("relabel" in action) + COSTS.merge * action.endswith("merge")
            assert ("relabel" in action) == (role is None or C.ROLES[to - 1] != role)
            assert state == to if action.endswith("merge") else legal(state, to)
            state = to
        assert cost + C.ending(state, COSTS)[0] == total


def rendered(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.block, r.place)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.piece
    return out


@pytest.mark.parametrize("block", [512, 2])
def test_rendering_does_not_depend_on_blocks(spark, block):
    rows = [(1, 0, "user", "hi"), (1, 1, "user", "there"), (1, 2, "Assistant ", "yo"), (2, 0, "assistant", "a"), (2, 1, "user", "b"), (3, 5, None, None), (4, 0, "system", "s"), (5, 0, "human", "q"), (5, 1, "gpt", "r"), (5, 2, "user", "t"), (None, 1, "user", "n")]
    rows += [(6, i, ("user", "assistant")[i % 2], str(i)) for i in range(50)] + [(7, None, "user", "x"), (7, 0, "assistant", "w"), (8, 0, "user", "twice"), (8, 0, "user", "twice")]
    turns = spark.createDataFrame([(*r, 1, "e") for r in rows], TURN + ", block int, piece string")
    got = C.format_chats(turns, block=block).collect()
    assert len(got) == len(rows)
    text = rendered(got)
    m = lambda role, t: f"<|im_start|>{role}\n{t}<|im_end|>\n"
    assert text[1] == m("user", "hi\nthere") + m("assistant", "yo")
    assert text[2] == m("user", "") + m("assistant", "a") + m("user", "b") + m("assistant", "")
    assert text[4] == m("system", "s") + m("user", "") + m("assistant", "")
    assert text[5] == m("user", "q") + m("assistant", "r") + m("user", "t") + m("assistant", "")
    assert text[6] == "".join(m(("user", "assistant")[i % 2], str(i)) for i in range(50))
    assert text[8] == m("user", "twice\ntwice") + m("assistant", "")
    assert text[None] == m("user", "n") + m("assistant", "")
    assert {r.conv_id: r.cost for r in got}[1] == COSTS.merge
    assert C.format_chats(turns.limit(0)).count() == 0


def test_rows_of_one_turn_number_and_of_none_come_in_parts(spark):
    """More rows than a part has share a number, or have none: no part is larger, and the result is that of one block."""
    rows = [(1, 5, ("user", "assistant")[i % 2], f"t{i}") for i in range(100)] + [(1, None, ("user", "assistant", None)[i % 3], "same" if i % 2 else f"u{i}") for i in range(90)] + [(1, 7, "user", "z")]
    turns = spark.createDataFrame(rows, TURN)
    got = C.format_chats(turns, block=16).collect()
    whole = C.format_chats(turns, block=1000).collect()
    assert len(got) == len(rows) and rendered(got) == rendered(whole)
    assert {r.cost for r in got} == {r.cost for r in whole}
    parts = list(C._parts(iter([C.pa.RecordBatch.from_pylist([{"conv": 1, "block": 0, "x": i} for i in range(40)])]), 16))
    assert [(k, len(r)) for k, r in parts] == [((1, 0, 0), 16), ((1, 0, 1), 16), ((1, 0, 2), 8)]
