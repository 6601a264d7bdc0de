"""Minimum-cost role repair of conversations, and their rendering.

Legal conversations are those of a small automaton: an optional system turn first, then user and assistant in turn, the
assistant last. Each given turn is kept, merged into the turn before it, or relabelled, and empty turns may be put in
between; dynamic programming finds the cheapest repair. A stretch of turns acts on the automaton as a matrix of least costs
between states, and matrices compose; so a very long conversation is solved in segments: their matrices first, then the
states between segments, then each segment by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import stage

ROLES = ("system", "user", "assistant")
START = 3
#: Legal successors of each state; a state is the role of the last turn, or START.
NEXT = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, UNKNOWN, INSERT = 1, 3, 1, 2
#: Turns in a segment.
SEGMENT = 4096
INF = 10**9


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The empty turns that lead from a state to where the role t may follow; absent if there is no way."""
    out = {}
    for s in NEXT:
        for t in range(3):
            if t in NEXT[s]:
                out[s, t] = ()
            elif via := [m for m in NEXT[s] if t in NEXT[m]]:
                out[s, t] = (via[-1],)
    return out


INSERTS = _paths()


def moves(s: int, role: int | None) -> list[tuple[int, int, str, tuple[int, ...], bool]]:
    """(cost, next state, how, inserted roles, relabelled) for a turn with this role (None: not a known role) in state s."""
    out = []
    for t in range(3):
        change = 0 if t == role else UNKNOWN if role is None else RELABEL
        if s == t:
            out.append((change + MERGE, t, "merge", (), t != role))
        if (s, t) in INSERTS:
            put = INSERTS[s, t]
            out.append((change + INSERT * len(put), t, "insert" if put else "keep", put, t != role))
    return sorted(out, key=lambda m: (m[0], m[4], ("keep", "merge", "insert").index(m[2]), m[1]))


MOVES = {(s, r): moves(s, r) for s in NEXT for r in (0, 1, 2, None)}
#: Closing turns from each state.
CLOSE = {START: (), 0: (1, 2), 1: (2,), 2: ()}


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    return ROLES.index(name) if name in ROLES else None


def matrix(roles: list[int | None]) -> list[int]:
    """Least costs from each of the four states to each, as 16 numbers in rows."""
    rows = []
    for s in range(4):
        cost = {s: 0}
        for r in roles:
            new: dict[int, int] = {}
            for a, c in cost.items():
                for m in MOVES[a, r]:
                    new[m[1]] = min(new.get(m[1], INF), c + m[0])
            cost = new
        rows += [cost.get(t, INF) for t in range(4)]
    return rows


def between(mats: list[list[int]]) -> tuple[list[int], int]:
    """States before each segment and after the last, on a cheapest way, and its cost with the closing turns."""
    cost, back = {START: 0}, []
    for m in mats:
        new: dict[int, tuple[int, int]] = {}
        for a, c in sorted(cost.items()):
            for t in range(4):
                if m[4 * a + t] < INF and c + m[4 * a + t] < new.get(t, (INF,))[0]:
                    new[t] = (c + m[4 * a + t], a)
        back.append({t: a for t, (_, a) in new.items()})
        cost = {t: c for t, (c, _) in new.items()}
    total = {t: c + INSERT * len(CLOSE[t]) for t, c in cost.items()}
    at = min(total, key=lambda t: (total[t], t))
    states = [at]
    for b in reversed(back):
        states.append(b[states[-1]])
    return states[::-1], total[at]


def _forward(roles: list[int | None], first: int) -> tuple[dict[int, int], list[dict]]:
    """Least cost of each state after the turns, and for each turn and state the cheapest (cost, previous state, move)."""
    cost, back = {first: 0}, []
    for r in roles:
        new: dict[int, tuple[int, int, tuple]] = {}
        for a, c in sorted(cost.items()):
            for m in MOVES[a, r]:
                if c + m[0] < new.get(m[1], (INF,))[0]:
                    new[m[1]] = (c + m[0], a, m)
        back.append(new)
        cost = {t: v[0] for t, v in new.items()}
    return cost, back


def solve(roles: list[int | None], first: int = START, last: int | None = None) -> tuple[list[tuple], int]:
    """The move of each turn on a cheapest way from state first to state last, or to the state that is cheapest to close; and that state."""
    cost, back = _forward(roles, first)
    if last is None:
        last = min(cost, key=lambda t: (cost[t] + INSERT * len(CLOSE[t]), t))
    out, at = [], last
    for b in reversed(back):
        _, prev, m = b[at]
        out.append(m)
        at = prev
    return out[::-1], last


def header(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


def escaped(text: str | None) -> str:
    """The text in which nothing reads as a role's header."""
    return (text or "").replace("<|", "<\\|")


def render(turns: list[tuple], texts: list[str | None]) -> str:
    """A segment's text: each turn under its role's header, merged turns after an empty line."""
    out = []
    for (_, to, how, put, _), text in zip(turns, texts):
        out += [header(p) + "\n" for p in put]
        out.append(("\n" if how == "merge" else header(to)) + escaped(text) + "\n")
    return "".join(out)


def piece(roles: list[int | None], texts: list[str | None], first: int = START, last: int | None = None, ends: bool = True) -> tuple:
    """(turns, cost, merges, relabels, inserts, text) of a stretch of turns from state first to state last (None: the cheapest end)."""
    moved, last = solve(roles, first, last)
    close = CLOSE[last] if ends else ()
    counts = (len(moved), sum(m[0] for m in moved) + INSERT * len(close), sum(m[2] == "merge" for m in moved), sum(m[4] for m in moved), sum(len(m[3]) for m in moved) + len(close))
    return *counts, render(moved, texts) + "".join(header(p) + "\n" for p in close)


SUMS = ("turns", "cost", "merges", "relabels", "inserts")
#: Result rows of a worker's batch.
ROWS = 512


def repair(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row for each conversation: conv_id, turns, cost, merges, relabels, inserts, rendered.

    Turns are taken in order of turn (nulls first), then role, then the text's hash, then text; repeated rows are turns of their
    own. Roles are read without case and surrounding blanks; others, and null, take any role at a smaller cost. Null texts
    count as empty, texts of any length are rendered whole, and what reads like a role's header in them is escaped. Ids may
    be of any type that has an order; null ids form one conversation. Of repairs that cost the same, one is chosen by fixed
    rules. An empty table gives an empty result; other columns are ignored, whatever their names.

    Rows are sorted by ranges, so a conversation of any size is dealt to several tasks, whatever its turn numbers. One that
    lies whole within a task and a segment is solved there; the few at a task's ends and the very long ones are solved by segments.
    """
    rows = conversations.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"))
    kind = rows.schema["c"].dataType.simpleString()
    order = ["c", "t", "r", "h", "x"]
    # equal rows may be told apart in any way
    ranged = rows.withColumn("h", F.xxhash64("x")).withColumn("any", F.monotonically_increasing_id()).repartitionByRange("c", "t", "r", "h", "any")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, of_type = TaskContext.get().partitionId(), [], None

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            types = [of_type, pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 5, pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["c", "task", "k", "done", "m", "roles", "texts", *SUMS, "rendered"])

        def put(c, k: int, whole: bool, roles: list, texts: list) -> None:
            numbers = [role_number(r) for r in roles]
            if whole:
                out.append((c, task, k, True, None, None, None, *piece(numbers, texts)))
            else:
                out.append((c, task, k, False, matrix(numbers), roles, texts, *[None] * 6))

        held, first = None, True  # the open segment (c, k, roles, texts), and whether its conversation is the task's first
        for b in batches:
            of_type = b.schema.field(0).type
            for c, r, x in zip(*(b.column(i).to_pylist() for i in range(3))):
                if held is None or held[0] != c:
                    if held is not None:
                        put(held[0], held[1], held[1] == 0 and not first, held[2], held[3])
                        first = False
                    held = (c, 0, [], [])
                elif len(held[2]) >= segment:
                    put(held[0], held[1], False, held[2], held[3])
                    held = (c, held[1] + 1, [], [])
                held[2].append(r)
                held[3].append(x)
                if len(out) >= ROWS:
                    yield flush()
        if held is not None:
            put(held[0], held[1], False, held[2], held[3])  # the next task may go on
        if out:
            yield flush()

    def to_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, at, first, last, ends = [], [], [], [], []
            for i, parts in enumerate(b.column(1).to_pylist()):
                states, _ = between([p["m"] for p in parts])
                of += [i] * len(parts)
                at += [(p["task"], p["k"]) for p in parts]
                first += states[:-1]
                last += states[1:]
                ends += [False] * (len(parts) - 1) + [True]
            tasks, ks = zip(*at) if at else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(tasks, pa.int32()), pa.array(ks, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(ends, pa.bool_())], names=["sc", "s_task", "sk", "first", "last", "ends"])

    def to_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [piece([role_number(r) for r in roles], texts, first, last, ends) for roles, texts, first, last, ends in zip(*(c.to_pylist() for c in b.columns[3:]))]
            cols = [pa.array(c, pa.int64()) for c in list(zip(*got))[:5]] + [pa.array([g[5] for g in got], pa.string())] if got else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["c", "task", "k", *SUMS, "piece"])

    longs = ", ".join(f"{n} long" for n in SUMS)
    cols = f"c {kind}, task int, k long, done boolean, m array<int>, roles array<string>, texts array<string>, {longs}, rendered string"
    parts = stage(ranged.sortWithinPartitions(*order).select("c", "r", "x").mapInArrow(cut, cols), "chat-parts")
    whole = parts.where("done").select("c", *SUMS, "rendered")
    rest = parts.where("not done").select("c", "task", "k", "m", "roles", "texts")
    # a segment's matrix is 16 numbers for `segment` turns
    per_conv = rest.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("task", "k", "m"))).alias("parts"))
    states = stage(per_conv.mapInArrow(to_states, f"sc {kind}, s_task int, sk long, first int, last int, ends boolean"), "chat-states")
    joined = rest.join(states, rest.c.eqNullSafe(states.sc) & (rest.task == states.s_task) & (rest.k == states.sk)).select("c", "task", "k", "roles", "texts", "first", "last", "ends")
    pieces = joined.mapInArrow(to_pieces, f"c {kind}, task int, k long, {longs}, piece string")
    text_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "k", "piece"))), lambda p: p["piece"]), "")
    joint = pieces.groupBy("c").agg(*[F.sum(n).alias(n) for n in SUMS], text_of.alias("rendered"))
    return whole.union(joint).withColumnRenamed("c", conv_id)
