"""Chat formatting by minimum-cost role repair.

A legal conversation has at most one system turn, first, then user and assistant turns that alternate, a user's first.
Dynamic programming over that automaton chooses for each turn to keep it, to give it another role, to merge it with
the turn before of the same role, or to put an empty turn before it; the cheapest sequence of such repairs is rendered.

Rows are sorted by conversation and turn over range partitions, so a conversation of any length is cut where a partition
ends. A partition's first and last conversations give the costs from each state to each (a matrix). Matrices compose, so those of a
conversation that is cut are multiplied up a tree of FAN to a node, its root chooses the states at its two ends, and the
states at the cuts are chosen on the way down; they join their partitions, which repair their turns between them. Nothing of that meets on the driver, and no task holds
more than FAN matrices of a conversation. A row of the result is a turn with its piece of the rendering: the pieces of a
conversation, put end to end in order of `seq`, are the rendered sequence, so no row grows with a conversation.

Partitions are as many as the input's size asks for, so that each holds some PART_BYTES of text, or a row more.

Nulls and the like: a null turn number comes first, equal numbers are ordered by a hash of role and text. Null or unknown roles
must be given one of the three. A null text is empty. A row with a null conversation id is a conversation of its own.
Rows that repeat are turns like others, and are merged. A conversation of system turns alone gets an empty user turn
at its end. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ROLES = ("system", "user", "assistant")
#: Names that mean one of the roles.
SAME = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 1
OPEN, CLOSE, GLUE = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
#: States: what the turn before is: nothing, or one of the roles.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_BETWEEN = {(START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (USER, USER): ASSISTANT, (ASSISTANT, ASSISTANT): USER}
_FAR = 1 << 40
#: Bytes of a partition, about; a turn counts as TURN_BYTES more than its text.
PART_BYTES, TURN_BYTES = 16 << 20, 200
#: Parts of a conversation that are chosen between in one task.
FAN = 256


def role_state(role: str | None) -> int:
    """The state that a role leads to; START for one that is none of the three."""
    name = (role or "").strip().lower()
    name = SAME.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else START


def _moves(role: int) -> list[list[tuple[int, int, bool, int]]]:
    """Of each state: (next state, cost, whether it merges, role of the empty turn before or START) of a turn of this role."""
    out = []
    for state in range(4):
        moves = []
        for to in (SYSTEM, USER, ASSISTANT):
            cost = 0 if to == role else NAME if role == START else RELABEL
            if to in _AFTER[state]:
                moves.append((to, cost, False, START))
            if to == state:
                moves.append((to, cost + MERGE, True, START))
            if (state, to) in _BETWEEN:
                moves.append((to, cost + INSERT, False, _BETWEEN[state, to]))
        out.append(sorted(moves, key=lambda m: m[1]))
    return out


MOVES = [_moves(r) for r in range(4)]
#: What it costs to end in a state: a conversation ends with a user's or an assistant's turn.
END = [INSERT, INSERT, 0, 0]


def costs(roles: list[int], begin: list[int]) -> tuple[list[int], list[list]]:
    """(least cost of each state after the turns, the moves into each state after each turn), from the costs of the states before."""
    best, trail = begin, []
    for role in roles:
        new, by = [_FAR] * 4, [None] * 4
        for state in range(4):
            if best[state] < _FAR:
                for move in MOVES[role][state]:
                    c = best[state] + move[1]
                    if c < new[move[0]]:
                        new[move[0]], by[move[0]] = c, (state, move)
        best = new
        trail.append(by)
    return best, trail


def matrix(roles: list[int]) -> list[int]:
    """The least costs from each state (rows) to each, over the turns."""
    return [c for s in range(4) for c in costs(roles, [0 if x == s else _FAR for x in range(4)])[0]]


def repair(roles: list[int], begin: int = START, end: int | None = None) -> tuple[int, list[tuple[int, bool, int]]]:
    """(cost, (state, whether it merges, role of the empty turn before) of each turn) of the cheapest repair, to an end state or the conversation's end."""
    best, trail = costs(roles, [0 if x == begin else _FAR for x in range(4)])
    if end is None:
        end = min(range(4), key=lambda s: best[s] + END[s])
        cost = best[end] + END[end]
    else:
        cost = best[end]
    out, state = [], end
    for by in reversed(trail):
        state_before, (to, _, merges, put) = by[state]
        out.append((to, merges, put))
        state = state_before
    return cost, out[::-1]


def pieces(texts: list[str], done: list[tuple[int, bool, int]], first: bool, last: bool) -> list[str]:
    """The rendering of each turn: what closes the turn before, what opens this one, and its text."""
    out = []
    for i, (text, (to, merges, put)) in enumerate(zip(texts, done, strict=True)):
        head = GLUE if merges else ("" if first and i == 0 else CLOSE) + (OPEN.format(ROLES[put - 1]) + CLOSE if put else "") + OPEN.format(ROLES[to - 1])
        out.append(head + text)
    if last and out:
        out[-1] += CLOSE
        if done[-1][0] == SYSTEM:
            out[-1] += OPEN.format("user") + CLOSE
    return out


def _runs(batch):
    """(first row, end) of each conversation's rows in a sorted batch; a null id is a run a row."""
    ids = batch.column("conv_id").to_pylist()
    cuts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1] or ids[i] is None]
    return ids, list(zip(cuts, [*cuts[1:], len(ids)], strict=True))


def _partitions(batches):
    """The rows of one range partition at a time."""
    held, pid = [], None
    for batch in batches:
        p = batch.column("pid").to_numpy()
        cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and p[a] != pid:
                yield pid, pa.Table.from_batches(held).combine_chunks()
                held = []
            pid = p[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pid, pa.Table.from_batches(held).combine_chunks()


def _edges(batches):
    for pid, part in _partitions(batches):
        ids, runs = _runs(part)
        roles = [role_state(r) for r in part.column("role").to_pylist()]
        ends = [runs[0]] if len(runs) == 1 else [runs[0], runs[-1]]
        ends = [(a, b) for a, b in ends if ids[a] is not None]
        if ends:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid] * len(ends), pa.int64()), "conv": pa.array([str(ids[a]) for a, _ in ends]), "costs": pa.array([matrix(roles[a:b]) for a, b in ends], pa.list_(pa.int64()))})


def product(a: list[int], b: list[int]) -> list[int]:
    """The costs of two parts in a row, from each state to each."""
    return [min(_FAR, *(a[4 * s + u] + b[4 * u + t] for u in range(4))) for s in range(4) for t in range(4)]


def between(parts: list[list[int]], before: int, after: int | None) -> list[tuple[int, int]]:
    """(state before, state after) of each of the parts in a row, at the least cost from `before` to `after`; None: to the best end."""
    best, back = [0 if s == before else _FAR for s in range(4)], []
    for m in parts:
        froms = [min(range(4), key=lambda s, t=t, best=best, m=m: best[s] + m[4 * s + t]) for t in range(4)]
        best = [best[froms[t]] + m[4 * froms[t] + t] for t in range(4)]
        back.append(froms)
    state = min(range(4), key=lambda s: best[s] + END[s]) if after is None else after
    out = []
    for froms in reversed(back):
        out.append((froms[state], state))
        state = froms[state]
    return out[::-1]


CUT = "pid long, conv string, before int, after int, first boolean, last boolean"


def cut_states(edges: DataFrame, partitions: int) -> DataFrame:
    """pid, conv, before, after, first, last of each part of a conversation that lies in several partitions: the states that it begins and ends in, and whether it is the conversation's first or last. edges: pid, conv, costs."""
    several = edges.groupBy("conv").agg(F.count("*").alias("c")).where("c > 1").select("conv")
    levels, width = [stored(edges.join(several, "conv", "left_semi"), "chat-cut")], partitions
    while width > FAN:
        up = levels[-1].groupBy("conv", F.floor(F.col("pid") / FAN).alias("b")).applyInPandas(_up, "pid long, conv string, costs array<long>")
        levels.append(stored(up, "chat-tree"))
        width = -(-width // FAN)
    chosen = levels[-1].groupBy("conv").applyInPandas(lambda rows: _down(rows, START, None, True, True), CUT)
    for level in reversed(levels[:-1]):
        chosen = level.groupBy("conv", F.floor(F.col("pid") / FAN).cast("long").alias("b")).cogroup(chosen.groupBy("conv", F.col("pid").alias("b"))).applyInPandas(_each, CUT)
    return chosen


def _up(key, rows):
    rows = rows.sort_values("pid")
    whole = None
    for m in rows["costs"]:
        whole = list(m) if whole is None else product(whole, list(m))
    return pd.DataFrame({"pid": [key[1]], "conv": [key[0]], "costs": [whole]})


def _down(rows, before, after, first, last):
    rows = rows.sort_values("pid")
    states = between([list(m) for m in rows["costs"]], before, after)
    n = len(rows)
    return pd.DataFrame({"pid": rows["pid"], "conv": rows["conv"], "before": [s[0] for s in states], "after": [s[1] for s in states], "first": [first and i == 0 for i in range(n)], "last": [last and i == n - 1 for i in range(n)]})


def _each(rows, parent):
    p = parent.iloc[0]
    return _down(rows, int(p["before"]), int(p["after"]), bool(p["first"]), bool(p["last"]))


def _repaired():
    def repaired(batches):
        for _, mixed in _partitions(batches):
            told = mixed.filter(pc.is_valid(mixed.column("cut"))).column("cut").to_pylist()
            cuts = {c["conv"]: (c["before"], None if c["last"] else c["after"], c["first"], c["last"]) for c in told}
            part = mixed.filter(pc.is_null(mixed.column("cut"))).combine_chunks()
            ids, runs = _runs(part)
            roles = [role_state(r) for r in part.column("role").to_pylist()]
            texts = [t or "" for t in part.column("text").to_pylist()]
            role, action, put, text = [], [], [], []
            for a, b in runs:
                before, after, first, last = cuts.get(str(ids[a]), (START, None, True, True)) if ids[a] is not None else (START, None, True, True)
                _, done = repair(roles[a:b], before, after)
                for was, (to, merges, empty) in zip(roles[a:b], done, strict=True):
                    role.append(ROLES[to - 1])
                    action.append(("merge" if merges else "keep") if to == was else "relabel and merge" if merges else "relabel")
                    put.append(ROLES[empty - 1] if empty else None)
                text += pieces(texts[a:b], done, first, last)
            columns = [part.column(c).combine_chunks() for c in ("conv_id", "seq", "turn")]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(role), pa.array(action), pa.array(put, pa.string()), pa.array(text)], ["conv_id", "seq", "turn", "role", "action", "empty_before", "piece"])

    return repaired


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """conv_id, seq, turn, role, action, empty_before, piece of each row of turns."""
    spark = turns.sparkSession
    id_kind, turn_kind = (turns.schema[c].dataType.simpleString() for c in (id_col, turn_col))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"h": F.xxhash64(F.coalesce("role", F.lit("\0")), F.coalesce("text", F.lit("\0"))), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "h", "row"]
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TURN_BYTES)).first()[0] or 0
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = stored(placed.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().cast("long").alias("pid")), "chat-sorted")
    # a range partition is read again as a whole, in order
    parts = placed.repartition(n, "pid").sortWithinPartitions("pid", "seq")
    edges = stored(parts.mapInArrow(_edges, "pid long, conv string, costs array<long>"), "chat-edges")  # two a partition at most
    cut = F.struct("conv", "before", "after", "first", "last")
    told = cut_states(edges, n).select("pid", cut.alias("cut"))
    parts = placed.unionByName(told, allowMissingColumns=True).repartition(n, "pid").sortWithinPartitions("pid", F.asc_nulls_first("seq"))
    form = f"conv_id {id_kind}, seq long, turn {turn_kind}, role string, action string, empty_before string, piece string"
    return parts.mapInArrow(_repaired(), form)
