"""Chat formatting with role repair of least cost.

Legal conversations are: an optional system turn first, then user and assistant turns by turns,
ending with an assistant turn. A dynamic programme over this automaton chooses for each turn to keep
its role, to relabel it, or to merge it into the message before, and where to insert empty messages;
the repaired sequence is then rendered, with the markers that texts may hold escaped.

A conversation is cut into parts by turn number, and where many rows share turn numbers, by their rank. Parts of a conversation that has several first give
their 4 x 4 matrix of least costs between states, from roles alone; the matrices are chained to fix
the states at part ends, and then every part is repaired and rendered on its own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, hold, ranked, rekeyed

ROLES = ("", "system", "user", "assistant")  # by state; state 0 is the start
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
MERGE, RELABEL, NAME, INSERT = 1, 2, 1, 3  # NAME: the price of naming an unknown role
PART = 1024
_INF = float("inf")


def _insertions() -> tuple:
    """By state: tuple of (state reached, roles inserted), shortest first; the state itself first."""
    out = []
    for s in range(4):
        seen, row = {s}, [(s, ())]
        for at, path in row:
            for t in NEXT[at]:
                if t not in seen:
                    seen.add(t)
                    row.append((t, (*path, t)))
        # Round trips back to the start of the walk, which change nothing, aren't listed.
        out.append(tuple(row))
    return tuple(out)


PATHS = _insertions()


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else 0


def _moves() -> list[list[list[tuple]]]:
    """moves[role][state]: (cost, next state, roles inserted, merged) in order of preference."""
    table = []
    for role in range(4):
        rows = []
        for s in range(4):
            moves = []
            for at, path in PATHS[s]:
                for t in NEXT[at]:
                    cost = INSERT * len(path) + (0 if t == role else RELABEL if role else NAME)
                    moves.append((cost, t, path, False))
            if s != START:
                moves.append((MERGE + (0 if role == s else RELABEL if role else NAME), s, (), True))
            rows.append(sorted(moves, key=lambda m: (m[0], not m[3], len(m[2]), m[1])))
        table.append(rows)
    return table


MOVES = _moves()


def costs(roles: list[str | None], start: int) -> list[float]:
    """Least cost of going through the turns from a state, by end state."""
    now = [_INF] * 4
    now[start] = 0
    for name in roles:
        new = [_INF] * 4
        for s, c in enumerate(now):
            if c < _INF:
                for cost, t, _, _ in MOVES[_role(name)][s]:
                    new[t] = min(new[t], c + cost)
        now = new
    return now


def ending(state: int) -> tuple:
    """Roles to insert after the last turn."""
    return next(path for t, path in PATHS[state] if t == ASSISTANT)


def repair(roles: list[str | None], start: int = START, end: int | None = None) -> tuple[float, int, list[tuple]]:
    """(cost, end state, moves), one move for each turn. Without ``end``, the cost includes the ending's insertions."""
    now, back = {start: 0}, []
    for name in roles:
        new, via = {}, {}
        for s in sorted(now):
            for move in MOVES[_role(name)][s]:
                if (c := now[s] + move[0]) < new.get(move[1], _INF):
                    new[move[1]], via[move[1]] = c, (s, move)
        now = new
        back.append(via)
    total = {s: c + (INSERT * len(ending(s)) if end is None else 0) for s, c in now.items()}
    state = min(total, key=lambda s: (total[s], s)) if end is None else end
    cost, at, moves = total[state], state, []
    for via in reversed(back):
        at, move = via[at]
        moves.append(move)
    return cost, state, moves[::-1]


def escaped(text: str | None) -> str:
    """A text without markers: each ``<|`` in it is written ``<||``, which no marker begins with. Null is empty."""
    return (text or "").replace("<|", "<||")


def unescaped(text: str) -> str:
    return text.replace("<||", "<|")


def parsed(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of the messages of a rendered conversation; merged texts are one, with an empty line between."""
    out = []
    for part in rendered.split("<|end|>\n")[:-1]:
        role, _, text = part.removeprefix("<|").partition("|>\n")
        out.append((role, unescaped(text)))
    return out


def render(turns: list[tuple], moves: list[tuple], opened: bool, last: bool, state: int) -> tuple[str, int]:
    """(text, messages) of the turns (role, text). opened: a message from the part before is still open."""
    out, messages = [], 0

    def open_(role):
        nonlocal opened, messages
        out.append(("<|end|>\n" if opened else "") + f"<|{ROLES[role]}|>\n")
        opened, messages = True, messages + 1

    for (_, text), (_, t, path, merged) in zip(turns, moves):
        for role in path:
            open_(role)
        if merged:
            out.append("\n\n")
        else:
            open_(t)
        out.append(escaped(text))
    if last:
        for role in ending(state):
            open_(role)
        out.append("<|end|>\n" if opened else "")
    return "".join(out), messages


def _matrices(batches):
    for b in batches:
        m = [[c if c < _INF else -1.0 for s in range(4) for c in costs([x["role"] for x in turns for _ in range(x["n"])], s)] for turns in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(m, pa.list_(pa.float64()))], ["conv_id", "seg", "sub", "m"])


def chain(matrices: list[list[float]]) -> list[tuple[int, int]]:
    """(state before, state after) of each part, for the least total cost."""
    now, back = {START: 0.0}, []
    for m in matrices:
        new, via = {}, {}
        for s, c in sorted(now.items()):
            for t in range(4):
                if m[4 * s + t] >= 0 and c + m[4 * s + t] < new.get(t, _INF):
                    new[t], via[t] = c + m[4 * s + t], s
        now = new
        back.append(via)
    at = min(now, key=lambda s: (now[s] + INSERT * len(ending(s)), s))
    out = []
    for via in reversed(back):
        out.append((via[at], at))
        at = via[at]
    return out[::-1]


def _chained(batches):
    for b in batches:
        rows = [(conv, x["seg"], x["sub"], *ends, i, i == len(parts) - 1) for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, (x, ends) in enumerate(zip(parts, chain([p["m"] for p in parts])))]
        types = [b.schema.field(0).type, *[pa.int64()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], ["c", "s", "ss", "before", "after", "part", "last"])


_OUT = "part long, n_turns long, n_messages long, merges long, relabels long, insertions long, cost long, rendered string"


def _repaired(batches):
    names = [x.split()[0] for x in _OUT.split(", ")]
    for b in batches:
        rows = []
        for turns, before, after, part, last in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
            turns = [(x["role"], x["text"]) for x in turns for _ in range(x["n"])]
            alone = last is None
            cost, state, moves = repair([r for r, _ in turns], before or START, None if alone else after)
            if last:
                cost += INSERT * len(ending(state))
            text, messages = render(turns, moves, bool(before), alone or last, state)
            inserted = sum(len(m[2]) for m in moves) + (len(ending(state)) if alone or last else 0)
            relabels = sum(_role(r) != m[1] for (r, _), m in zip(turns, moves))
            rows.append((part or 0, len(turns), messages, sum(m[3] for m in moves), relabels, inserted, cost, text))
        types = [pa.int64()] * 7 + [pa.string()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types))], ["conv_id", *names])


def _cut(turns: DataFrame, part: int) -> DataFrame:
    """(conv_id, seg, sub, turn, h, i, role, text, n): n equal turns a row, in parts (seg, sub) of twice ``part`` turns or so.

    seg is a range of turn numbers. Where its rows are many more than its numbers, equal turns are
    counted together, at most ``part`` in a row, and sub numbers ranges of their rank by (turn, h), h
    being a hash of role and text.
    """
    lost = F.lit(1 << 40)
    cut = turns.select("conv_id", F.when(F.col("turn").isNull(), lost).otherwise(F.floor(F.col("turn") / part)).cast("long").alias("seg"), F.coalesce(F.col("turn"), F.lit(0)).cast("long").alias("turn"), F.xxhash64("role", "text").alias("h"), "role", "text")
    many = hold(cut.groupBy("conv_id", "seg").count().where(F.col("count") > 4 * part).select(F.col("conv_id").alias("c"), rekeyed(F.col("seg")).alias("s")))
    single = lambda x: x.select("conv_id", "seg", F.lit(0).cast("long").alias("sub"), "turn", "h", F.lit(0).cast("long").alias("i"), "role", "text", F.lit(1).cast("long").alias("n"))
    if many.isEmpty():
        return single(cut)
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))
    like = cut.join(many, same, "left_semi").groupBy("conv_id", "seg", "turn", "h", "role", "text").agg(F.count("*").alias("copies"))
    pieces = like.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / part))))
    pieces = pieces.withColumn("n", F.least(F.lit(part).cast("long"), F.col("copies") - F.col("i") * part)).drop("copies")
    # Buckets rise with turn and h, which is signed.
    bucket = F.when(F.col("seg") == lost, 0).otherwise(F.col("turn") - F.col("seg") * part) * 65536 + F.shiftright("h", 48) + 32768
    placed = ranked(pieces, ["conv_id", "seg"], ["turn", "h", "role", "text", "i"], F.col("n"), bucket)
    placed = placed.select("conv_id", "seg", F.floor(F.col("before") / part).alias("sub"), "turn", "h", "i", "role", "text", "n")
    return single(cut.join(many, same, "left_anti")).unionByName(placed)


def repaired(turns: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, n_messages, merges, relabels, insertions, cost, rendered).

    One row for each conversation; one that goes over ``part`` turn numbers, or has many more turns than numbers, has
    one for each part, whose texts joined in order of part are its rendering. turns needs conv_id,
    turn, role and text. Turns are ordered by turn, then by a hash of role and text; rows without a turn number come last.
    Unknown and null roles are named at a price, null texts are empty, repeated rows are turns of
    their own, a null conv_id is a conversation, an empty table gives no rows. Markers in texts are
    escaped (see ``escaped``), so a rendering has only the messages that it was given.
    """
    bounded_batches(turns.sparkSession)
    cut = _cut(turns, part)
    slim = cut.groupBy("conv_id", "seg", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "i", "role", "n"))).alias("turns"))
    place = F.struct("seg", "sub")
    spans = cut.groupBy("conv_id").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select(F.col("conv_id").alias("c"))
    several = slim.join(spans, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    key = turns.select("conv_id").schema[0].dataType.simpleString()
    matrices = several.mapInArrow(_matrices, f"conv_id {key}, seg long, sub long, m array<double>")
    ends = matrices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "sub", "m"))).alias("parts")).mapInArrow(_chained, f"c {key}, s long, ss long, before long, after long, part long, last boolean")
    parts = cut.groupBy("conv_id", "seg", "sub").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "i", "role", "text", "n"))).alias("turns"))
    known = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s")) & (F.col("sub") == F.col("ss")), "left").select("conv_id", "turns", "before", "after", "part", "last")
    return known.mapInArrow(_repaired, f"conv_id {key}, {_OUT}")
