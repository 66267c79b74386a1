"""Repaired conversations against a search over all edits, whole and in many stretches, and odd rows."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from quire.llm import conversations, queries

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
RESULT = conversations.RESULT


def brute(rows):
    """rows (turn, role, text) in order: the result's columns."""
    seen, faults, codes = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+", "", text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        codes.append(fault)
        if fault:
            faults[fault] += 1
    n = len(rows)
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        options = {s: [] for s in range(4)}
        for s in range(4):
            if i == n:
                if s in (0, 3):
                    options[s].append((0, "", ()))
                continue
            _, role, text = rows[i]

            def then(cost, letter, t, made, i=i):
                return (cost + best[i + 1][t][0], letter + best[i + 1][t][1], made + best[i + 1][t][2])

            options[s].append(then(2, "D", s, ()))
            if codes[i] in (None, "truncated"):
                extra = 5 if codes[i] else 0
                if role[:1] in NEXT[s]:
                    options[s].append(then(extra, "K", NEXT[s][role[:1]], (f"{role}:{text}",)))
                for r in ("user", "assistant"):
                    if r[0] in NEXT[s]:
                        options[s].append(then(extra + 1, "R", NEXT[s][r[0]], (f"{r}:{text}",)))
        for _ in range(4):
            for s in range(4):
                for r in ("user", "assistant"):
                    if r[0] in NEXT[s]:
                        options[s] += [(c + 5, "I" + a, (f"{r}:", *m)) for c, a, m in options[NEXT[s][r[0]]] if not a.startswith("III")]
                options[s] = sorted(set(options[s]))[:1]
        for s in range(4):
            best[i][s] = options[s][0] if options[s] else (10**9, "", ())
    cost, audit, made = best[0][0]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())


def damaged(rows):
    """All rows (conv_id, turn, role, text) to the rows of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        of = out.setdefault(conv, [])
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        of += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for k, v in out.items()}


def results(df):
    return {r["conv_id"]: tuple(r[c] for c in RESULT[1:]) for r in df.collect()}


def test_layers_are_the_least_edits():
    """All conversations of four rows or fewer of a few kinds, and longer ones at random."""
    kinds = [("system", "S."), ("user", "U."), ("assistant", "A."), ("user", "cut"), ("assistant", " "), ("tool", "T.")]
    rng = random.Random(4)
    cases = [c for n in range(4) for c in product(kinds, repeat=n)] + [tuple(rng.choice(kinds) for _ in range(rng.randint(4, 30))) for _ in range(300)]
    for case in cases:
        stretch = conversations._Stretch(1)
        rows = [(i, role, text.replace(".", f"{i}.") if rng.random() < 0.9 else text) for i, (role, text) in enumerate(case)]
        seen = set()
        for turn, role, text in rows:
            assert not list(stretch.add(turn, role, text, 1, (role, text) in seen))
            seen.add((role, text))
        got = stretch.whole()
        assert tuple(got[c] for c in RESULT[1:]) == brute(rows), rows


def test_states_lie_close_together():
    """The 16 layers suffice: costs of states differ by 12 at most, also where single costs are composed."""
    rng = random.Random(2)
    for _ in range(300):
        codes = bytes(rng.randrange(12) for _ in range(rng.randint(1, 40)))
        held = conversations.layers(codes, conversations.from_costs(conversations.AT_END))
        costs = conversations.to_costs(*held[0])
        assert max(costs) - min(costs) <= 12
        m = conversations.transfer(codes)
        assert costs == [min(m[4 * s + t] + conversations.AT_END[t] for t in range(4)) for s in range(4)]


def test_query_is_as_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {k: brute(v) for k, v in damaged(rows).items()}
    assert results(queries.queries()["op11_conversation_repair"](spark, sf)) == want


@pytest.mark.parametrize("chunk", [3, 512])
def test_a_conversation_over_many_partitions(spark, monkeypatch, chunk):
    """Half of the rows are of one conversation."""
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", ""]
    words = [f"{w}{e}" for w in ("yes", "no", "well", "  ", "so be it") for e in (".", "!", "", " ?\n")] + [f"text {i}." for i in range(200)]
    rows = [(1 if i % 2 else rng.randrange(2, 40), i + 3 * (i // 50), rng.choice(roles), rng.choice(words)) for i in range(900)]
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = {k: brute(v) for k, v in damaged(rows).items()}
    assert results(conversations.damage_and_repair(df)) == want


def test_odd_rows(spark):
    long = "word " * 60_000 + "end."
    rows = [(None, 3, "user", "Without an id?"), (None, 4, "assistant", "Yes."), (2, None, "user", "No turn."), (2, 0, None, "No role."), (2, 5, "assistant", None), (3, None, "user", None)]
    rows += [(4, t, "user" if t % 2 else "assistant", long + str(t) + ".") for t in range(1, 9)]
    rows += [(5, t, "user", "The same.") for t in range(9)] + [(6, t, "", "No role's name.") for t in range(4)]
    df = spark.createDataFrame([(*r, 7, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part int, kind string, copies int")
    want = {k: brute(v) for k, v in damaged(rows).items()}
    assert results(conversations.damage_and_repair(df)) == want
    assert results(conversations.damage_and_repair(df.unionByName(df.where("conv_id = 5")))) == {**want, 5: brute(damaged(rows + [r for r in rows if r[0] == 5])[5])}
    assert conversations.damage_and_repair(df.limit(0)).count() == 0
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    alone = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string")
    assert results(conversations.damage_and_repair(alone)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
