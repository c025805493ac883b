"""Chat formatting: the cheapest repair of a conversation to legal turns, then its rendering.

Legal conversations are those of an automaton: an optional system turn, then user and assistant in turn,
the assistant last. Each input turn gets a role; against the automaton it may be merged with the turn
before it, relabelled, or preceded by inserted empty turns, each at a cost. Which repair is
cheapest is a shortest path, that is, a product of min-plus matrices over the automaton's states. A
conversation is cut into stretches of turns; each gives one small matrix, these are combined in
order, and with the states at its ends known each stretch is traced back by itself. So neither a
conversation nor its rendering need fit in one task.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prunecluster.llm.batches import map_rows
from prunecluster.storage import RunTables

#: Roles, which are also the states after a turn; before the first turn the state is START.
ROLES = ("system", "user", "assistant")
SYSTEM, USER, ASSISTANT, START = range(4)
MERGE, RELABEL, UNKNOWN_LABEL, INSERT = 1, 3, 2, 2
NEVER = 1 << 40
#: Turns of a stretch at most, by rank; a power of two below 2^33, so that no stretch lies in two sorted ranges.
STRETCH = 1024
TURN_OPEN, TURN_CLOSE = "<|{role}|>\n", "<|end|>\n"


def insertions() -> dict[tuple[int, int], tuple[int, ...] | None]:
    """Empty turns needed between a state and the next role; None for a merge. Absent: impossible."""
    return {
        (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
        (SYSTEM, SYSTEM): None, (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
        (USER, USER): None, (USER, ASSISTANT): (),
        (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): None,
    }


#: Empty turns that end a conversation legally.
ENDINGS = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), START: ()}


def step(role: str | None) -> np.ndarray:
    """Costs of one turn: from each state (row) to each state (column)."""
    cost = np.full((4, 4), NEVER, np.int64)
    for (before, label), empty in insertions().items():
        own = 0 if role == ROLES[label] else RELABEL if role in ROLES else UNKNOWN_LABEL
        cost[before, label] = own + (MERGE if empty is None else INSERT * len(empty))
    return cost


STEPS = {role: step(role) for role in (*ROLES, None)}


def escaped(text: str) -> str:
    """A text in which nothing reads as a mark: "<|" gets a backslash between, and one more where there are some."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def of_role(role: str | None) -> str | None:
    role = (role or "").strip().lower()
    return role if role in ROLES else None


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Min-plus product; associative."""
    return np.minimum((first[:, :, None] + second[None]).min(axis=1), NEVER)


NEUTRAL = np.where(np.eye(4, dtype=bool), 0, NEVER)


def trace(roles: list[str | None], start: int, end: int) -> list[int]:
    """States after each turn on the cheapest way from ``start`` to ``end``; the lower state wins ties."""
    cost, back = np.where(np.arange(4) == start, 0, NEVER), []
    for role in roles:
        ways = cost[:, None] + STEPS[role]
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), NEVER)
    states, state = [], end
    for choice in reversed(back):
        states.append(state)
        state = int(choice[state])
    return states[::-1]


def _ordered(conversations: DataFrame, run: RunTables) -> DataFrame:
    """Turns with their place in the order of (conversation, turn, role, text) and the stretch that it lies in.

    Turns are sorted by ranges. A place has the range in its upper bits and the row within it in the lower 33, so
    a stretch holds STRETCH turns at most, however many share a number, a role or a text.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("tie", F.monotonically_increasing_id())  # equal rows go to several ranges too
    sorted_turns = turns.orderBy("conv_id", "turn", "role", "text", "tie").drop("tie")
    stored = run.write(sorted_turns.withColumn("place", F.monotonically_increasing_id()), "turns")
    return stored.withColumn("stretch", F.floor(F.col("place") / STRETCH))


def _stretches(batches, names):
    """((conv_id, stretch), rows) of each stretch in sorted batches, one at a time."""
    own, rows = None, []
    for batch in batches:
        for values in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "stretch", *names))):
            if own != values[:2]:
                if own is not None:
                    yield own, rows
                own, rows = values[:2], []
            rows.append(values[2:])
    if own is not None:
        yield own, rows


def _ends(conversations: DataFrame) -> DataFrame:
    """(conv_id, stretch, enters, leaves, last, cost) of each stretch: its states on the cheapest way."""
    def matrices(batches):
        for (conv, stretch), rows in _stretches(batches, ("role",)):
            total = NEUTRAL
            for (role,) in rows:
                total = chain(total, STEPS[of_role(role)])
            yield conv, stretch, total.ravel().tolist()

    def states(batches):
        def of_conversation(conv, stretches, held):
            # 16 numbers for each stretch; the ways back take four bytes.
            cost, ways = np.where(np.arange(4) == START, 0, NEVER), bytearray()
            for matrix in np.frombuffer(held, np.int64).reshape(-1, 4, 4):
                reach = cost[:, None] + matrix
                ways += reach.argmin(axis=0).astype(np.uint8).tobytes()
                cost = np.minimum(reach.min(axis=0), NEVER)
            final = cost + [INSERT * len(ENDINGS[s]) for s in range(4)]
            state = int(final.argmin())
            least, n = int(final[state]), len(stretches)
            for i in range(n - 1, -1, -1):
                enters = ways[4 * i + state]
                yield conv, stretches[i], enters, state, i == n - 1, least
                state = enters

        own, stretches, held = None, array("q"), array("q")
        for batch in batches:
            for conv, stretch, matrix in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "stretch", "matrix"))):
                if held and conv != own:
                    yield from of_conversation(own, stretches, held)
                    stretches, held = array("q"), array("q")
                own = conv
                stretches.append(stretch)
                held.extend(matrix)
        if held:
            yield from of_conversation(own, stretches, held)

    roles = conversations.select("conv_id", "stretch", "place", "role")
    by_stretch = map_rows(
        roles.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place").select("conv_id", "stretch", "role"),
        matrices, "conv_id long, stretch long, matrix array<long>",
    )
    return map_rows(
        by_stretch.repartition("conv_id").sortWithinPartitions("conv_id", "stretch"), states,
        "conv_id long, stretch long, enters int, leaves int, last boolean, cost long",
    )


def repair_chats(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action, inserted, rendered, cost.

    ``rendered`` is the turn's share of the conversation's text: the shares in order of (turn, role, text)
    are the whole. ``action`` is keep, merge or relabel (relabel+merge for both); ``inserted`` counts empty
    turns put in before the turn or, for the last one, behind it; ``cost`` is that of the whole conversation,
    the least that any legal sequence has. A role that is null or unknown takes a label for less
    than a known one. A null text is empty; marks that stand in a text are escaped, so that they make no turns. A null turn comes first, and a null conv_id is the id of
    one conversation. Rows that repeat are turns of their own. An empty table gives no rows.
    Other columns are not read.
    """
    run = RunTables(conversations.sparkSession)
    turns = _ordered(conversations, run)
    ends = run.write(_ends(turns), "ends").withColumnsRenamed({"conv_id": "c", "stretch": "s"})
    joined = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")
    table, names = insertions(), ("turn", "role", "text", "enters", "leaves", "last", "cost")

    def empty(roles):
        return "".join(TURN_OPEN.format(role=ROLES[r]) + TURN_CLOSE for r in roles)

    def make(batches):
        for (conv, _), rows in _stretches(batches, names):
            before, leaves, last, cost = rows[0][3:]
            states = trace([of_role(r[1]) for r in rows], before, leaves)
            for i, (turn, role, text, *_rest) in enumerate(rows):
                state = states[i]
                put = table[before, state]
                merged = put is None
                # Text stands between an opening and a closing; a merge opens no turn of its own.
                text = escaped(text or "")
                shown = "\n" + text if merged else (
                    ("" if before == START else TURN_CLOSE) + empty(put) + TURN_OPEN.format(role=ROLES[state]) + text
                )
                inserted = len(put or ())
                if last and i == len(rows) - 1:
                    shown += TURN_CLOSE + empty(ENDINGS[state])
                    inserted += len(ENDINGS[state])
                action = "+".join(
                    [*["relabel"] * (of_role(role) != ROLES[state]), *["merge"] * merged]
                ) or "keep"
                yield conv, turn, role, ROLES[state], action, inserted, shown, cost
                before = state

    dealt = joined.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
    return map_rows(
        dealt, make,
        "conv_id long, turn long, role string, new_role string, action string, inserted int, rendered string, cost long",
        weigh=lambda row: len(row[6]),
    )
