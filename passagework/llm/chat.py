"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn comes first and user and assistant
turns then alternate, from a user turn to an assistant turn.  Turns that do not fit
are merged with the turn before, relabelled, or preceded by empty turns; dynamic
programming over the automaton finds the cheapest repair, which is then rendered.

The cost of a stretch of turns is a small matrix, from the state before it to the
state after it, and stretches combine by (min, +) products.  Long conversations are
dealt in stretches by turn number: their matrices are combined per conversation to
find the state at each border, and every stretch is then repaired by itself.  Only
roles travel for the matrices, texts only once.

Defined results: null text is an empty turn; a null or unknown role can only be
relabelled, at a lower cost.  Turns are ordered by turn, then role, then text, nulls
last, so ties and repeated rows fall into a fixed order; rows without a turn number
come last.  Of equally cheap repairs one is taken the same way in every run; another
stretch length may take another of them.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: States: before the first turn, then after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
_LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, INSERT, RELABEL, NAME = 1.0, 1.5, 2.0, 0.5
STRETCH = 1024
TAGS = "<|{}|>\n"
END = "<|end|>\n"


def _bridges() -> dict[tuple[int, int], tuple[float, tuple[int, ...], bool]]:
    """(cost, empty turns put in, whether merged) of the cheapest way from a state to a turn of a role."""
    out = {}
    for s in range(4):
        for o in (SYSTEM, USER, ASSISTANT):
            ways = [(MERGE, (), True)] if s == o else []
            front = [(s, ())]
            for _ in range(4):
                for state, path in front:
                    if (state, o) in _LEGAL:
                        ways.append((INSERT * len(path), path, False))
                front = [(y, (*path, y)) for state, path in front for x, y in sorted(_LEGAL) if x == state]
            out[s, o] = min(ways, key=lambda w: (w[0], w[1])) if ways else (np.inf, (), False)
    return out


_BRIDGES = _bridges()
_STEP = np.array([[_BRIDGES[s, o][0] for o in (SYSTEM, USER, ASSISTANT)] for s in range(4)])


def _label_costs(role: str | None) -> np.ndarray:
    if role not in ROLES:
        return np.full(3, NAME)
    return np.array([0.0 if r == role else RELABEL for r in ROLES])


_BY_ROLE = {r: _STEP + _label_costs(r) for r in (*ROLES, None)}


def _finish() -> np.ndarray:
    """Cost of ending after each state: what it takes to reach an assistant turn by empty turns."""
    return np.array([0.0 if s == ASSISTANT else min(_BRIDGES[s, ASSISTANT][0] + INSERT, np.inf) for s in range(4)])


FINISH = _finish()


def advance(cost: np.ndarray, role: str | None) -> np.ndarray:
    """Costs of the states after one more turn; cost may have several rows."""
    step = _BY_ROLE.get(role, _BY_ROLE[None])
    after = (cost[..., :, None] + step).min(axis=-2)
    return np.concatenate((np.full((*after.shape[:-1], 1), np.inf), after), axis=-1)


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    m = np.where(np.eye(4) > 0, 0.0, np.inf)
    for r in roles:
        m = advance(m, r)
    return m


def repair(roles: list[str | None], before: int, after: int) -> list[tuple[int, tuple[int, ...], bool]]:
    """(role, empty turns put in, merged) of each turn on the cheapest way between two states."""
    costs = [np.where(np.arange(4) == before, 0.0, np.inf)]
    for r in roles:
        costs.append(advance(costs[-1], r))
    out, state = [], after
    for t in range(len(roles) - 1, -1, -1):
        step = _BY_ROLE.get(roles[t], _BY_ROLE[None])[:, state - 1]
        was = int((costs[t] + step).argmin())
        _, path, merged = _BRIDGES[was, state]
        out.append((state, path, merged))
        state = was
    return out[::-1]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Columns of each group of a partition sorted by the keys, whole though batches may cut it."""
    last: tuple | None = None
    held: dict[str, list] = {}
    for b in batches:
        columns = b.to_pydict()
        key = list(zip(*(columns[k] for k in keys), strict=True))
        edges = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)] if key else []
        for a, z in pairwise(edges):
            part = {c: v[a:z] for c, v in columns.items()}
            if held and key[a] == last:
                for c, v in part.items():
                    held[c] += v
                continue
            if held:
                yield last, held
            held, last = part, key[a]
    if held:
        yield last, held


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _role(x: str | None) -> str | None:
    return x if x in ROLES else None


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((*name, matrix([_role(r) for r in g["role"]]).ravel().tolist()) for name, g in _groups(batches, ["conv_id", "stretch"]))
    return _batched(rows, pa.schema({"conv_id": pa.int64(), "stretch": pa.int64(), "m": pa.list_(pa.float64())}))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (conv,), g in _groups(batches, ["conv_id"]):
        ms = [np.array(m).reshape(4, 4) for m in g["m"]]
        cost = [np.where(np.arange(4) == START, 0.0, np.inf)]
        for m in ms:
            cost.append((cost[-1][:, None] + m).min(axis=0))
        state = int((cost[-1] + FINISH).argmin())
        for t in range(len(ms) - 1, -1, -1):
            was = int((cost[t] + ms[t][:, state]).argmin())
            yield conv, g["stretch"][t], was, state, t == len(ms) - 1
            state = was


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States before and after each stretch on the cheapest way through a conversation."""
    return _batched(_ways(batches), pa.schema({"conv_id": pa.int64(), "stretch": pa.int64(), "before": pa.int32(), "after": pa.int32(), "last": pa.bool_()}))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for (conv, _), g in _groups(batches, ["conv_id", "stretch"]):
        rows, state = [], g["before"][0]
        steps = repair([_role(r) for r in g["role"]], state, g["after"][0])
        for turn, role, text, (new, path, merged) in zip(g["turn"], g["role"], g["text"], steps, strict=True):
            out = []
            for p in path:
                out.append((END if state != START else "") + TAGS.format(ROLES[p - 1]))
                state = p
            body = text or ""
            out.append(f"\n{body}" if merged else (END if state != START else "") + TAGS.format(ROLES[new - 1]) + body)
            action = "+".join([*["insert"] * bool(path), *["merge"] * merged, *["relabel"] * (role != ROLES[new - 1])]) or "keep"
            rows.append((conv, turn, role, action, ROLES[new - 1], "".join(out)))
            state = new
        if g["last"][0]:
            tail = END
            if state != ASSISTANT:
                for p in (*_BRIDGES[state, ASSISTANT][1], ASSISTANT):
                    tail += TAGS.format(ROLES[p - 1]) + END
                rows[-1] = (*rows[-1][:3], "+".join([rows[-1][3], "complete"]), *rows[-1][4:])
            rows[-1] = (*rows[-1][:5], rows[-1][5] + tail)
        yield from rows


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = {c: pa.string() for c in ("role", "action", "new_role", "rendered")}
    return _batched(_pieces(batches), pa.schema({"conv_id": pa.int64(), "turn": pa.int64(), **text}))


def format_chats(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, turn, role, action, new_role, rendered), one row per turn of conversations.

    The rendered pieces of a conversation, in order, make up its repaired text.
    action joins keep, insert, merge, relabel and, on a last turn that needed empty
    turns after it, complete.  stretch: turn numbers in one stretch.
    """
    number = F.coalesce(F.floor(F.col("turn") / stretch), F.lit((1 << 62))).cast("long")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("stretch", number)
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last()]
    # texts break ties by a digest, which sorts alike wherever it is computed
    tie = F.xxhash64("text")
    small = rows.select("conv_id", "stretch", "turn", "role", tie.alias("tie"))
    stretches = small.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *order, "tie").select("conv_id", "stretch", "role")
    matrices = stretches.mapInArrow(_matrices, "conv_id long, stretch long, m array<double>")
    borders = matrices.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(_borders, "conv_id long, stretch long, before int, after int, last boolean")
    both = rows.join(borders.withColumnRenamed("conv_id", "c").withColumnRenamed("stretch", "s"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")
    both = both.withColumn("tie", tie).repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *order, "tie").drop("tie")
    return both.mapInArrow(_rendered, "conv_id long, turn long, role string, action string, new_role string, rendered string")


def op2_chat(turns: DataFrame) -> DataFrame:
    """One row per turn of conversations, repaired and rendered."""
    return format_chats(turns)
