"""Least-cost repair of conversations to the grammar (s?(ua)+)? over the initials of their roles.

Costs are layers in the manner of Wu and Manber: for each turn and each cost there is a set of the grammar's states from which the
rest can be repaired for no more than that. Four states are four bits, and since no two states of a turn lie further than 12 apart,
16 layers from the turn's first non-empty one on are all: one word of 64 bits, that a step over a turn shifts by an edit's cost.
The first layer of the first turn that holds the start state is the cost. The audit is read off the words from there: the least
letter whose next state is in the layer that is left. A state and a letter give the next state, so the audit decides the text.

Rows are range-partitioned by conversation and turn, so that a large conversation lies in many partitions. A conversation inside one
partition is repaired there. Of others a partition gives its stretch: a byte a row, and the least costs between states over
it. These are composed over the stretches of a conversation, which are no more than there are partitions; then each stretch is repaired from each
of the four states, and the states are composed the same way. Texts stay in chunks of bounded size; only the digest, which is that of the
whole repaired conversation, reads a conversation's chunks one after the other.

Defined cases: a null role or text counts as one space, in the damage a null id or turn too; rows of one turn go by role, then by a hash
of the text; repeated rows are copies of one; a null conv_id is a conversation of its own; an empty role has no initial and can't be kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, released, stored

SPACES = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8  # states: before all, after s, after u, after a
STATES = (START, SYSTEM, USER, ASSISTANT)
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs; a truncated row that stays costs its own beside them
#: The state after a user or assistant message that a rerole or an insertion makes.
MADE = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The states that a message with this initial may follow, and the one after it.
KEPT = {"s": (START, SYSTEM), "u": (START | SYSTEM | ASSISTANT, USER), "a": (USER, ASSISTANT), "": (0, 0)}
INITIALS = "sua"
LEGAL = {"su", "ua", "au"}
GOES, CUT = 1, 2  # faults of a row: must be deleted, truncated
NAMES = {USER: "user", ASSISTANT: "assistant"}

LAYERS = 16
ALL = (1 << 4 * LAYERS) - 1
ONES = ALL // 15
AT_END = (0, 10, 5, 0)  # what each state needs where nothing follows
FAR = 1 << 60
#: Rows and characters of a chunk, about; a single text may be longer.
CHUNK_ROWS, CHUNK_CHARS = 512, 1 << 18


def code(initial: str, fault: int) -> int:
    return (INITIALS.find(initial) if initial else -1) % 4 * 3 + fault


def _before(step: int, w: int) -> int:
    """The layers before a row of this code, from those after it."""
    after_user, after_assistant = (w >> 2) & ONES, (w >> 3) & ONES
    out = w << 4 * DELETE
    fault = step % 3
    if fault != GOES:
        extra = TRUNCATED if fault == CUT else 0
        out |= (after_user * (START | SYSTEM | ASSISTANT) | after_assistant * USER) << 4 * (REROLE + extra)
        if step < 3:
            out |= ((w >> 1) & ONES) << 4 * extra
        elif step < 6:
            out |= after_user * (START | SYSTEM | ASSISTANT) << 4 * extra
        elif step < 9:
            out |= after_assistant * USER << 4 * extra
    return out


def _inserted(w: int) -> int:
    """With insertions before the row: two at most are of use."""
    for _ in range(2):
        w |= (((w >> 2) & ONES) * (START | SYSTEM | ASSISTANT) | ((w >> 3) & ONES) * USER) << 4 * INSERT & ALL
    return w


def from_costs(costs: Iterable[int]) -> tuple[int, int]:
    """(base, layers) of the least costs of the four states."""
    costs = list(costs)
    base = min(costs)
    w = 0
    for state, c in zip(STATES, costs, strict=True):
        if c - base < LAYERS:
            w |= (ONES << 4 * (c - base)) * state & ALL
    return base, w


def to_costs(base: int, w: int) -> list[int]:
    return [base + next(k for k in range(LAYERS + 1) if k == LAYERS or w >> 4 * k & state) for state in STATES]


def layers(codes: bytes, end: tuple[int, int]) -> list[tuple[int, int]]:
    """(base, layers) before each row and at the end."""
    out = [end]
    base, w = end
    for step in reversed(codes):
        w = _inserted(_before(step, w) & ALL)
        empty = 0
        while not w & 15:
            w = w >> 4 | 15 << 4 * (LAYERS - 1)
            empty += 1
        base += empty
        out.append((base, w))
    out.reverse()
    return out


def _holds(at: tuple[int, int], state: int, cost: int) -> bool:
    k = cost - at[0]
    return k >= LAYERS or (k >= 0 and bool(at[1] >> 4 * k & state))


def trace(codes: bytes, held: list[tuple[int, int]], state: int, last: bool) -> tuple[str, int]:
    """The least audit from a state on, and the state after it; last: nothing follows."""
    cost = to_costs(*held[0])[STATES.index(state)]
    out, i, n = [], 0, len(codes)
    while i < n:
        step = codes[i]
        fault, made = step % 3, MADE[state]
        extra = TRUNCATED if fault == CUT else 0
        may, kept = KEPT[INITIALS[step // 3] if step < 9 else ""]
        if _holds(held[i + 1], state, cost - DELETE):
            letter, cost, i = "D", cost - DELETE, i + 1
        elif _holds(held[i], made, cost - INSERT):
            letter, state, cost = "I", made, cost - INSERT
        elif fault != GOES and may & state and _holds(held[i + 1], kept, cost - extra):
            letter, state, cost, i = "K", kept, cost - extra, i + 1
        else:
            letter, state, cost, i = "R", made, cost - extra - REROLE, i + 1
        out.append(letter)
    while last and cost:
        out.append("I")
        state, cost = MADE[state], cost - INSERT
    return "".join(out), state


def repaired(rows: Iterable[tuple[str, str]], audit: str, state: int) -> list[str]:
    """The messages "role:text" that an audit from a state makes of rows (role, text)."""
    out, left = [], iter(rows)
    for letter in audit:
        if letter == "I":
            state = MADE[state]
            out.append(NAMES[state] + ":")
            continue
        role, text = next(left)
        if letter == "R":
            state = MADE[state]
            out.append(f"{NAMES[state]}:{text}")
        elif letter == "K":
            state = KEPT[role[:1]][1]
            out.append(f"{role}:{text}")
    return out


def transfer(codes: bytes) -> list[int]:
    """The least cost from each state before the rows to each after them, by rows of a matrix; insertions stand before rows."""
    m = [[0 if s == t else FAR for t in range(4)] for s in range(4)]
    for step in reversed(codes):
        fault = step % 3
        extra = TRUNCATED if fault == CUT else 0
        may, kept = KEPT[INITIALS[step // 3] if step < 9 else ""]
        before = []
        for s, state in enumerate(STATES):
            row = [c + DELETE for c in m[s]]
            if fault != GOES:
                row = [min(c, d + extra + REROLE) for c, d in zip(row, m[STATES.index(MADE[state])], strict=True)]
                if may & state:
                    row = [min(c, d + extra) for c, d in zip(row, m[STATES.index(kept)], strict=True)]
            before.append(row)
        for _ in range(2):
            before = [[min(c, d + INSERT) for c, d in zip(row, before[STATES.index(MADE[state])], strict=True)] for row, state in zip(before, STATES, strict=True)]
        m = before
    return [min(c, FAR) for row in m for c in row]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: 5 of 20 rows dropped, emptied, without ends of sentences, twice, or the user's."""
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(h == 4, "user").otherwise(role).alias("role"),
        F.when(h == 1, "").when(h == 2, F.translate(text, ".!?", "")).when(h != 0, text).otherwise("").alias("text"),
        F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


#: The columns beside conv_id of whole conversations' results, of chunks and of stretches: their types in Spark and Arrow.
_OWN = {name: ("int", pa.int32()) for name in ("part", "seq")}
_OWN |= {name: ("string", pa.string()) for name in ("kind", "audit", "repaired_sha256", "first", "last")}
_OWN |= {name: ("long", pa.int64()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "low", "high", "turns")}
_OWN |= {"roles": ("array<string>", pa.list_(pa.string())), "texts": ("array<string>", pa.list_(pa.string())), "codes": ("binary", pa.binary()), "sizes": ("array<int>", pa.list_(pa.int32())), "costs": ("array<long>", pa.list_(pa.int64()))}
#: Characters of texts in a record batch, about.
_BATCH = 4 << 20


class _Stretch:
    """The rows of one conversation in one partition, as they come."""

    def __init__(self, key: object) -> None:
        self.key = key
        self.codes, self.sizes = bytearray(), []
        self.roles: list[str | None] = []
        self.texts: list[str | None] = []
        self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, later: bool) -> Iterator[dict]:
        """Takes a row and its copies; gives chunks that are full."""
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        body, initial = text.rstrip(SPACES), role[:1]
        for copy in range(copies):
            if not body:
                fault, self.blank = GOES, self.blank + 1
            elif later or copy:
                fault, self.duplicate = GOES, self.duplicate + 1
            elif body[-1] not in ".!?":
                fault, self.truncated = CUT, self.truncated + 1
            else:
                fault = 0
            if self.last is None:
                self.first = initial
            else:
                self.illegal += self.last + initial not in LEGAL
            self.last = initial
            self.codes.append(code(initial, fault))
            self.roles.append(role)
            self.texts.append(None if fault == GOES else text)
            self.chars += 0 if fault == GOES else len(text)
            if len(self.roles) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS:
                yield self.chunk()

    def chunk(self) -> dict:
        out = {"kind": "chunk", "seq": len(self.sizes), "roles": self.roles, "texts": self.texts}
        self.sizes.append(len(self.roles))
        self.roles, self.texts, self.chars = [], [], 0
        return out

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal}

    def whole(self) -> dict:
        """The result of a conversation that lies here as a whole, in one chunk."""
        codes = bytes(self.codes)
        held = layers(codes, from_costs(AT_END))
        audit, _ = trace(codes, held, START, True)
        text = "\n".join(repaired(zip(self.roles, self.texts, strict=True), audit, START))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"kind": "whole", "gaps": gaps, "cost": to_costs(*held[0])[0], "audit": audit, "repaired_sha256": _digest(text)} | self.counts()

    def ended(self) -> Iterator[dict]:
        """What is left of a stretch of a conversation that may lie elsewhere too."""
        if self.roles:
            yield self.chunk()
        yield {"kind": "stretch", "codes": bytes(self.codes), "sizes": self.sizes, "costs": transfer(bytes(self.codes)), "first": self.first, "last": self.last, "low": self.low, "high": self.high, "turns": self.turns} | self.counts()


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _by_conversation(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterable[dict]]]:
    """Rows in order of conversation and turn to what their stretches give. The first and the last of a partition may lie in others too."""
    now, inner = None, False
    for rows in batches:
        for key, *row in zip(*[c.to_pylist() for c in rows.columns], strict=True):
            if now is None or now.key != key:
                if now is not None:
                    yield now.key, [now.whole()] if inner and not now.sizes else now.ended()
                    inner = True
                now = _Stretch(key)
            yield key, now.add(*row)
    if now is not None:
        yield now.key, now.ended()


@released
def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, kinds = TaskContext.get().partitionId(), []

    def seen() -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds[:] = [b.schema.field(0).type]
            yield b

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", kinds[0]), *((name, kind) for name, (_, kind) in _OWN.items())]))

    out: list[dict] = []
    weight = 0
    for key, made in _by_conversation(seen()):
        for r in made:
            out.append(r | {"conv_id": key, "part": part})
            weight += 500 + sum(len(t or "") for t in r.get("texts") or ()) + len(r.get("audit") or "") + len(r.get("codes") or "")
            if weight > _BATCH:
                yield batch()
                out, weight = [], 0
    if out:
        yield batch()


def _seen_before(rows: DataFrame) -> DataFrame:
    """rows with `later`: role and text stood in an earlier turn. Identical rows of a turn become one with their copies."""
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    rows = rows.withColumn("digest", F.when(F.col("copies") > 0, F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")))))
    real = rows.where("copies > 0").select("conv_id", "digest", place.alias("place"))
    by_turn = real.groupBy("conv_id", "digest", "place").agg(F.count("*").alias("rows"))
    repeats = by_turn.groupBy("conv_id", "digest").agg(F.min("place").alias("from"), F.count("*").alias("turns"), F.max("rows").alias("rows")).where("turns > 1 or rows > 1")
    repeats = stored(repeats.select(F.col("conv_id").alias("of"), F.col("digest").alias("same"), "from", "rows"), "repeats")
    out = rows.join(bounded(repeats), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    out = out.select("conv_id", "turn", "role", "text", "copies", F.coalesce(place > F.col("from"), F.lit(False)).alias("later"), F.coalesce("rows", F.lit(1)).alias("rows"))
    if repeats.where("rows > 1").limit(1).count():
        columns = ["conv_id", "turn", "role", "text", "later"]
        many = out.where("rows > 1").groupBy(*columns).agg(F.sum("copies").alias("copies")).select(*columns, "copies")
        out = out.where("rows = 1").select(*columns, "copies").unionByName(many)
    return out.select("conv_id", "turn", "role", "text", "copies", "later")


def _over_stretches(pdf: pd.DataFrame) -> pd.DataFrame:
    """One conversation's stretches: the least costs after each, and the conversation's counts beside each."""
    pdf = pdf.sort_values("part")
    ends, costs = [], list(AT_END)
    for m in reversed(pdf["costs"].tolist()):
        ends.append(costs)
        costs = [min(int(m[4 * s + t]) + costs[t] for t in range(4)) for s in range(4)]
    full = pdf[pdf["first"].notna()]
    illegal = int(full["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(full["last"][:-1], full["first"][1:], strict=True))
    timed = pdf[pdf["turns"] > 0]
    turns = int(timed["turns"].sum()) - sum(a == b for a, b in zip(timed["high"][:-1], timed["low"][1:], strict=True))
    gaps = int(timed["high"].max()) - int(timed["low"].min()) + 1 - turns if len(timed) else 0
    out = pdf[["conv_id", "part"]].copy()
    out["ends"] = ends[::-1]
    out["final"] = [False] * (len(pdf) - 1) + [True]
    out["gaps"], out["illegal"], out["cost"] = gaps, illegal, costs[0]
    for name in ("blank", "duplicate", "truncated"):
        out[name] = int(pdf[name].sum())
    return out


def _from_each_state(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch (conv_id, part, codes, sizes, ends, final) repaired from each state: a row a chunk, with the states after the stretch."""
    for batch in batches:
        for key, part, codes, sizes, ends, final in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            cuts = [0, *accumulate(sizes)]
            after = [ends]
            for a, b in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True):
                after.append(to_costs(*layers(codes[a:b], from_costs(after[-1]))[0]))
            after.reverse()
            states, rows = list(STATES), []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                held = layers(codes[a:b], from_costs(after[i + 1]))
                done = {s: trace(codes[a:b], held, s, final and i == len(sizes) - 1) for s in set(states)}
                rows.append((i, [done[s][0] for s in states], list(states)))
                states = [done[s][1] for s in states]
            if not sizes:
                held = layers(b"", from_costs(ends))
                done = {s: trace(b"", held, s, final) for s in states}
                rows.append((-1, [done[s][0] for s in states], list(states)))
                states = [done[s][1] for s in states]
            seq, audits, starts = zip(*rows, strict=True)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * n, batch.column(0).type), pa.array([part] * n, pa.int32()), pa.array(seq, pa.int32()), pa.array(audits, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array([states] * n, pa.list_(pa.int32()))],
                ["conv_id", "part", "seq", "audits", "starts", "exits"],
            )


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state (0 to 3) in which each of a conversation's stretches begins."""
    pdf = pdf.sort_values("part")
    states, state = [], START
    for exits in pdf["exits"]:
        states.append(STATES.index(state))
        state = int(exits[STATES.index(state)])
    out = pdf[["conv_id", "part"]].copy()
    out["entry"] = states
    return out


@released
def _chunk_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (conv_id, part, seq, audit, start, roles, texts) with their messages as one text."""
    for batch in batches:
        audit, start, roles, texts = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
        made = [repaired(zip(r or [], t or [], strict=True), a, s) for a, s, r, t in zip(audit, start, roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(["\n".join(m) if m else None for m in made], pa.string())], ["conv_id", "part", "seq", "audit", "messages"])


@released
def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (conv_id, part, seq, audit, messages) in order to a row for each conversation; texts pass through."""
    keys, audit, digest, begun, kind = [], [], hashlib.sha256(), False, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], ["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for key, letters, messages in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
            if keys and key != keys[0]:
                yield done()
                audit, digest, begun = [], hashlib.sha256(), False
            keys = [key]
            audit.append(letters)
            if messages is not None:
                digest.update(b"\n" * begun + messages.encode("utf-8", "surrogatepass"))
                begun = True
    if keys:
        yield done()


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of rows (conv_id, turn, role, text, copies): its faults, cost, audit and the repaired text's digest."""
    key = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.xxhash64("text")]
    ranged = _seen_before(rows).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    own = stored(ranged.mapInArrow(_stretches, f"conv_id {key}, " + ", ".join(f"{name} {kind}" for name, (kind, _) in _OWN.items())), "conversations")
    whole = own.where("kind = 'whole'").select(*RESULT)

    stretches = own.where("kind = 'stretch'")
    totals = "gaps long, illegal long, cost long, blank long, duplicate long, truncated long"
    light = stretches.select("conv_id", "part", "costs", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")
    ends = stored(light.groupBy("conv_id").applyInPandas(_over_stretches, f"conv_id {key}, part int, ends array<long>, final boolean, {totals}"), "ends")
    same = lambda other: F.col("conv_id").eqNullSafe(other["of"]) & (F.col("part") == other["in_part"])
    renamed = lambda df, *rest: df.select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"), *rest)
    near_ends = bounded(renamed(ends, "ends", "final"))
    made = stretches.select("conv_id", "part", "codes", "sizes").join(near_ends, same(near_ends)).select("conv_id", "part", "codes", "sizes", "ends", "final")
    made = stored(made.mapInArrow(_from_each_state, f"conv_id {key}, part int, seq int, audits array<string>, starts array<int>, exits array<int>"), "repairs")
    exits = made.groupBy("conv_id", "part").agg(F.first("exits").alias("exits"))
    entries = bounded(renamed(stored(exits.groupBy("conv_id").applyInPandas(_entries, f"conv_id {key}, part int, entry int"), "entries"), "entry"))
    chosen = made.join(entries, same(entries)).select("conv_id", "part", "seq", F.get("audits", "entry").alias("audit"), F.get("starts", "entry").alias("start"))

    chunks = own.where("kind = 'chunk'").select(F.col("conv_id").alias("of"), F.col("part").alias("in_part"), F.col("seq").alias("at"), "roles", "texts")
    texts = chosen.join(chunks, same(chunks) & (F.col("seq") == F.col("at")), "left").select("conv_id", "part", "seq", "audit", "start", "roles", "texts")
    texts = texts.mapInArrow(_chunk_texts, f"conv_id {key}, part int, seq int, audit string, messages string")
    joined = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_joined, f"conv_id {key}, audit string, repaired_sha256 string")
    sums = ends.where("final").select(F.col("conv_id").alias("of"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.unionByName(joined.join(sums, F.col("conv_id").eqNullSafe(sums["of"])).select(*RESULT))


def damage_and_repair(rows: DataFrame) -> DataFrame:
    return repair(damaged(rows))
