"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn followed by one or more pairs of a user and
an assistant turn.  For every conversation dynamic programming over this automaton picks
the cheapest way to make its turns legal:

* keep a turn (free) or give it another role (``RELABEL``; a role that is none of the
  three has to be given one),
* merge a turn into the one before it (``MERGE``), if both then have the same role,
* insert an empty turn before it, or at the end (``INSERT`` each).

States are the role of the last turn so far (or none).  A stretch of turns is a small matrix
of cheapest costs from state to state, and stretches combine like a product of matrices, so
a conversation of any length is cut into blocks: blocks are summed up on their own, their
matrices (one row per 1,024 turns) tell each block the state it starts and ends in, and
blocks then choose and render on their own.  Every turn gives one row with its rendered
piece; a conversation is the concatenation of its pieces in order.

Turns go in the order of ``turn`` (nulls last), then role and text; repeated turns are turns
of their own.  Null texts are empty; roles are compared without case and outer white space;
a null role is an unknown role; turns of a null conversation id form one conversation.  Of
equally cheap repairs the first in the order user, assistant, system is taken, from the end
backwards.  An empty table gives no rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foretally.llm.common import map_groups, numbered_in_order
from foretally.session import durable

BLOCK = 1024
RELABEL, MERGE, INSERT = 3, 1, 2
NEVER = 1 << 40

ROLES = ("user", "assistant", "system")
START = 3  # no turn yet; the other states are the last turn's role
STATES = 4

# empty turns that have to be inserted to get from a state to a turn of a role
BETWEEN = {
    (START, 0): (), (START, 1): (0,), (START, 2): (),
    (0, 0): (1,), (0, 1): (), (1, 0): (), (1, 1): (0,), (2, 0): (), (2, 1): (0,),
}
ENDING = {START: (), 0: (1,), 1: (), 2: (0, 1)}

# an open chat format: a header, the text, an end mark
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"
JOINT = "\n\n"  # between merged texts

PLANNED = "conv string, block long, costs array<long>"
REPAIRED = ("conv string, position long, new_role string, action string, inserted string, closing string, cost long, piece string")


def step_costs() -> np.ndarray:
    """[role found (3: unknown), state before, role given] -> cost of the cheapest way, merge included."""
    out = np.full((4, STATES, 3), NEVER, np.int64)
    for found in range(4):
        for state in range(STATES):
            for given in range(3):
                ways = [MERGE] if state == given else []
                if (state, given) in BETWEEN:
                    ways.append(INSERT * len(BETWEEN[state, given]))
                if ways:
                    out[found, state, given] = min(ways) + (0 if found == given else RELABEL)
    return out


STEP = step_costs()


def is_merge(state: int, given: int) -> bool:
    return state == given and MERGE <= INSERT * len(BETWEEN.get((state, given), (0,) * (MERGE + 1)))


def role_number(role) -> int:
    name = role.strip().lower() if isinstance(role, str) else ""
    return ROLES.index(name) if name in ROLES else 3


def block_costs(found: list[int]) -> np.ndarray:
    """Cheapest cost from each state before the block to each state after it."""
    at = np.where(np.eye(STATES, dtype=bool), 0, NEVER)
    for role in found:
        after = np.full_like(at, NEVER)
        after[:, :3] = (at[:, :, None] + STEP[role][None]).min(axis=1)
        at = np.minimum(after, NEVER)
    return at


def choose(found: list[int], first: int, last: int) -> list[int]:
    """States along the cheapest way through a block from ``first`` to ``last``."""
    best = [[0 if s == first else NEVER for s in range(STATES)]]
    steps = STEP.tolist()
    for role in found:
        before = best[-1]
        best.append([min(before[s] + steps[role][s][g] for s in range(STATES)) for g in range(3)] + [NEVER])
    way = [last]
    for i in range(len(found) - 1, -1, -1):
        given = way[-1]
        way.append(next(s for s in range(STATES) if best[i][s] + steps[found[i]][s][given] == best[i + 1][given]))
    return way[::-1]


def chain(matrices: list[np.ndarray]) -> list[int]:
    """States at the edges of a conversation's blocks on its cheapest way."""
    ahead = [np.array([INSERT * len(ENDING[s]) for s in range(STATES)], np.int64)]
    for m in reversed(matrices):  # cheapest cost from each state to the end
        ahead.append((m + ahead[-1][None]).min(axis=1))
    ahead.reverse()
    states = [START]
    for m, rest in zip(matrices, ahead[1:]):
        states.append(int(np.argmin(m[states[-1]] + rest)))
    return states


def render(found: list[int], texts: list[str], states: list[int], final: bool) -> list[tuple]:
    """(role, action, inserted roles, closing roles, cost, piece) of each turn.  A piece opens
    with the end mark of the turn before unless it is merged into it."""
    out = []
    for i, (role, text) in enumerate(zip(found, texts)):
        before, given = states[i], states[i + 1]
        merged = is_merge(before, given)
        put = () if merged else BETWEEN[before, given]
        ending = ENDING[given] if final and i == len(found) - 1 else ()
        cost = (MERGE if merged else INSERT * len(put)) + (0 if role == given else RELABEL) + INSERT * len(ending)
        piece = JOINT + text if merged else (
            ("" if before == START else CLOSE) + "".join(OPEN.format(ROLES[r]) + CLOSE for r in put) + OPEN.format(ROLES[given]) + text)
        if final and i == len(found) - 1:
            piece += CLOSE + "".join(OPEN.format(ROLES[r]) + CLOSE for r in ending)
        action = ("merge" if merged else "keep") if role == given else ("relabel and merge" if merged else "relabel")
        out.append((ROLES[given], action, ",".join(ROLES[r] for r in put), ",".join(ROLES[r] for r in ending), cost, piece))
    return out


def repair(turns: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id``, ``position``, ``turn``, ``role``, ``new_role``, ``action``,
    ``inserted`` (roles of empty turns before it), ``closing`` (of those after the last turn),
    ``cost`` and ``piece``."""
    kind = dict(turns.dtypes)["conv_id"]
    plain = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn"), F.col("role").cast("string").alias("role"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").isNull().alias("late"))
    placed = durable(numbered_in_order(plain, ["conv"], ["late", "turn", "role", "text"], "position")
                     .withColumn("block", F.floor(F.col("position") / BLOCK)))

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [(conv, block, block_costs([role_number(r) for r in part["role"]]).ravel())
                for (conv, block), part in frame.groupby(["conv", "block"], sort=False, dropna=False)]
        return pd.DataFrame(rows, columns=["conv", "block", "costs"])

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, part in frame.groupby("conv", sort=False, dropna=False):
            states = chain([np.asarray(c, np.int64).reshape(STATES, STATES) for c in part["costs"]])
            parts.append(pd.DataFrame({"conv": part["conv"], "block": part["block"], "first": states[:-1], "last": states[1:],
                                       "final": [False] * (len(part) - 1) + [True]}))
        return pd.concat(parts, ignore_index=True)

    def rendered(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, part in frame.groupby(["conv", "block"], sort=False, dropna=False):
            found = [role_number(r) for r in part["role"]]
            states = choose(found, int(part["first"].iloc[0]), int(part["last"].iloc[0]))
            made = render(found, part["text"].tolist(), states, bool(part["final"].iloc[0]))
            rows += [(c, p, *m) for c, p, m in zip(part["conv"], part["position"], made)]
        return pd.DataFrame(rows, columns=["conv", "position", "new_role", "action", "inserted", "closing", "cost", "piece"])

    matrices = map_groups(placed.select("conv", "block", "position", "role"), ["conv", "block"], ["position"], summed, PLANNED)
    edges = durable(map_groups(matrices, ["conv"], ["block"], chained, "conv string, block long, first int, last int, final boolean")
                    .withColumnsRenamed({"conv": "c", "block": "b"}))
    full = placed.join(edges, placed["conv"].eqNullSafe(edges["c"]) & (placed["block"] == edges["b"])).drop("c", "b")
    wanted = full.select("conv", "block", "position", "role", "text", "first", "last", "final")
    fixed = map_groups(wanted, ["conv", "block"], ["position"], rendered, REPAIRED)
    mine = placed.select(F.col("conv").alias("c"), F.col("position").alias("p"), "turn", "role")
    joined = fixed.join(mine, fixed["conv"].eqNullSafe(mine["c"]) & (fixed["position"] == mine["p"]))
    return joined.select(F.col("conv").cast(kind).alias("conv_id"), "position", "turn", "role", "new_role", "action", "inserted", "closing", "cost", "piece")
