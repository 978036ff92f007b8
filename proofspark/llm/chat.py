"""Chat formatting: role repair of least cost by dynamic programming over an automaton of legal turns, then rendering.

States are the role of the last message. A turn is emitted as a message of its own role, of another role (a relabel), or
merged into the last message; empty messages may be inserted before it, and at the end until an assistant has spoken.
Costs of a turn depend on its role only, so a stretch of turns is a small min-plus matrix. Conversations are cut into
blocks; only those of several blocks have their matrices chained, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from proofspark.llm.common import maybe_in
from proofspark.session import written

STATES = ("start", "system", "user", "assistant", "tool")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
ALIASES = {"human": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "function": "tool", "developer": "system"}
LAST = "assistant"
MERGE, RELABEL, INSERT, NEVER = 1, 3, 2, 1 << 20
#: Turns and characters a block.
TURNS, CHARS = 1024, 1 << 22
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n\n"

N = len(STATES)
BLOCKS = "conv_id bigint, part int, block int, turns array<bigint>, roles array<int>, texts array<string>, matrix array<bigint>"
FRAGMENTS = "conv_id bigint, part int, block int, position int, turn bigint, action string, role string, rendered string"


def role_number(role: Column) -> Column:
    """Number of the state that a role names: trimmed, in lower case, by another usual name; 0 for an unknown or null one."""
    name = F.lower(F.trim(role))
    for given, meant in ALIASES.items():
        name = F.when(name == given, meant).otherwise(name)
    return F.coalesce(*[F.when(name == s, F.lit(k)) for k, s in enumerate(STATES) if k], F.lit(0))


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """Shortest legal ways between states, the end included; of equal ones the first by state."""
    out = {}
    for p in range(N):
        ways, seen = [(STATES.index(s),) for s in LEGAL[STATES[p]]], set()
        while ways:
            way = ways.pop(0)
            if way[-1] not in seen:
                seen.add(way[-1])
                out[p, way[-1]] = way
                ways += [way + (STATES.index(s),) for s in LEGAL[STATES[way[-1]]]]
    return out


PATHS = _paths()


def step_cost(p: int, q: int, role: int) -> tuple[int, bool]:
    """Least cost of a turn of ``role`` between states, and whether it is a merge."""
    wrong = RELABEL * (role != q)
    merge = MERGE + wrong if p == q and q else NEVER
    emit = INSERT * (len(PATHS[p, q]) - 1) + wrong if (p, q) in PATHS else NEVER
    return (merge, True) if merge < emit else (emit, False)


STEPS = np.array([[[step_cost(p, q, r)[0] for q in range(N)] for p in range(N)] for r in range(N)], np.int64)
ENDS = np.array([0 if STATES[p] == LAST else INSERT * len(PATHS[p, STATES.index(LAST)]) for p in range(N)], np.int64)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(1), NEVER * 1000)


def transfer(roles: list[int]) -> np.ndarray:
    """Least cost of the turns between each pair of states."""
    out = STEPS[roles[0]]
    for r in roles[1:]:
        out = chain(out, STEPS[r])
    return out


@lru_cache(maxsize=50_000)
def best_states(roles: tuple[int, ...], entry: int, leaves: int | None) -> tuple[int, ...]:
    """State after each turn on the cheapest way from ``entry`` to ``leaves``, or to the end; ties to the first state."""
    cost, back = np.full(N, NEVER, np.int64), []
    cost[entry] = 0
    for r in roles:
        ways = cost[:, None] + STEPS[r]
        back.append(ways.argmin(0))
        cost = ways.min(0)
    q = int((cost + ENDS).argmin()) if leaves is None else leaves
    out = []
    for b in reversed(back):
        out.append(q)
        q = int(b[q])
    return tuple(reversed(out))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number, conv, held, size = TaskContext.get().partitionId(), 0, None, [], 0
    known: dict[tuple[int, ...], list[int]] = {}

    def row():
        roles = tuple(h[1] for h in held)
        if roles not in known:
            if len(known) > 20_000:
                known.clear()
            known[roles] = transfer(list(roles)).ravel().tolist()
        return {"conv_id": conv, "part": part, "block": number, "turns": [h[0] for h in held], "roles": list(roles), "texts": [h[2] for h in held], "matrix": known[roles]}

    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.int32())),
                        ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64()))])
    for b in batches:
        rows = []
        for conv_id, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if held and (conv_id != conv or len(held) >= TURNS or size > CHARS):
                rows.append(row())
                number, held, size = number + 1, [], 0
            conv = conv_id
            held.append((turn, role, text))
            size += len(text or "")
        yield pa.RecordBatch.from_pylist(rows, schema=schema)
    yield pa.RecordBatch.from_pylist([row()] if held else [], schema=schema)


def _chained(table):
    """Entry and exit states of the blocks of one conversation, and its last block."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
    matrices = [np.array(r["matrix"]).reshape(N, N) for r in rows]
    cost, entering = np.full(N, NEVER, np.int64), []
    cost[0] = 0
    for m in matrices:
        entering.append(cost)
        cost = (cost[:, None] + m).min(0)
    q, states = int((cost + ENDS).argmin()), []
    for before, m in zip(reversed(entering), reversed(matrices)):
        p = int((before + m[:, q]).argmin())
        states.append((p, q))
        q = p
    states.reverse()
    return pa.table({"part": pa.array([r["part"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int32()),
                     "rank": pa.array(range(len(rows)), pa.int32()), "entry": pa.array([s[0] for s in states], pa.int32()),
                     "leaves": pa.array([s[1] for s in states], pa.int32()), "last": pa.array([k + 1 == len(rows) for k in range(len(rows))])})


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in FRAGMENTS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    for b in batches:
        for r in b.to_pylist():
            single = r["entry"] is None
            p, last = 0 if single else r["entry"], single or r["last"]
            states = best_states(tuple(r["roles"]), p, None if single else r["leaves"])
            out = []

            def message(state: int, turn, action: str, text: str | None) -> None:
                opening = ("" if p == 0 and not out and (single or r["rank"] == 0) else CLOSE) + OPEN.format(STATES[state])
                out.append([turn, action, STATES[state], opening + (text or "")])

            for q, role, turn, text in zip(states, r["roles"], r["turns"], r["texts"]):
                if step_cost(p, q, role)[1]:
                    out.append([turn, "merge" if role == q else "relabel and merge", STATES[q], JOIN + (text or "")])
                else:
                    for s in PATHS[p, q][:-1]:
                        message(s, None, "insert", "")
                    message(q, turn, "keep" if role == q else "relabel", text)
                p = q
            if last:
                for s in PATHS[p, STATES.index(LAST)] if STATES[p] != LAST else ():
                    message(s, None, "insert", "")
                out[-1][3] += CLOSE
            rank = 0 if single else r["rank"]
            columns = [[r["conv_id"]] * len(out), [r["part"]] * len(out), [rank] * len(out), range(len(out)), *([x[k] for x in out] for k in range(4))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, block, position, turn, action, role, rendered): the fragments of each repaired conversation, in order of (block, position).

    One fragment a turn, and one for each inserted message (turn null); joined, they are the rendered conversation.
    Turns are taken by number, null ones first, equal ones by role and text; repeated rows are turns of their own. Null
    texts are empty, unknown and null roles are relabelled, a null conv_id is a conversation. Other columns are ignored.
    """
    rows = turns.select("conv_id", "turn", role_number(F.col("role")).alias("number"), "text", F.xxhash64("role", "text").alias("h"))
    # ranges are cut inside long conversations too, so none has to fit into a task
    order = ["conv_id", "turn", "h", "number"]
    blocks = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "number", "text").mapInArrow(_blocks, BLOCKS), "chat-blocks")
    several = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv_id")
    joined = blocks.select("conv_id", "part", "block", "matrix").alias("x").join(several.alias("y"), F.col("x.conv_id").eqNullSafe(F.col("y.conv_id")), "left_semi")
    states = written(joined.groupBy("conv_id").applyInArrow(_chained, "part int, block int, rank int, entry int, leaves int, last boolean"), "chat-states")
    marked = maybe_in(blocks, F.xxhash64("part", "block"), states.select(F.xxhash64("part", "block").alias("h")))
    kept = ["conv_id", "part", "block", "turns", "roles", "texts"]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("rank", "int"), ("entry", "int"), ("leaves", "int"), ("last", "boolean"))]
    alone = marked.where("not _maybe").select(*kept, *empty)
    met = marked.where("_maybe").join(states, ["part", "block"], "left").select(*kept, "rank", "entry", "leaves", "last")
    return alone.union(met).mapInArrow(_fragments, FRAGMENTS).drop("part")


def transcripts(fragments: DataFrame) -> DataFrame:
    """(conv_id, rendered) of conversations that fit into a value."""
    parts = F.sort_array(F.collect_list(F.struct("block", "position", "rendered")))
    return fragments.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x.rendered), "").alias("rendered"))
