"""Spelling variants against plain Python: all pairs by brute force, tiles split to the last, odd rows."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest

from quire.llm import queries, spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def are_near(x, y):
    """Exactly one code point inserted, deleted or replaced."""
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def counted(rows, damage=31):
    c = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def brute(c):
    near = {w: set() for w in c}
    for x, y in combinations(c, 2):
        if abs(len(x) - len(y)) < 2 and are_near(x, y):
            near[x].add(y)
            near[y].add(x)
    form = {w: min(ns, key=lambda x: (-c[x], x)) for w, ns in near.items() if ns}
    form = {w: f for w, f in form.items() if c[f] >= 10 * c[w]}
    out = set()
    for w in c:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c[w], len(near[w]), c[form[w]] if w in form else None))
    return out


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefgh"])
def test_trie_pairs_are_all_pairs(letters):
    rng = random.Random(5)
    for _ in range(20):
        shorter = rng.choice([0, 1, 2, 3, 5])
        items = list({(rng.randrange(3), "".join(rng.choice(letters) for _ in range(shorter + rng.randint(0, 1)))) for _ in range(80)})
        rng.shuffle(items)
        u, v = spelling.trie_pairs([t for t, _ in items], [w.encode("latin-1") for _, w in items], shorter)
        got = sorted(tuple(sorted((items[i], items[j]))) for i, j in zip(u.tolist(), v.tolist(), strict=True))
        assert got == sorted(tuple(sorted((x, y))) for x, y in combinations(items, 2) if x[0] == y[0] and are_near(x[1], y[1]) and min(len(x[1]), len(y[1])) == shorter)


def test_query_is_as_brute_force(spark, sf):
    rows = queries.queries()["op13_spelling_variants"](spark, sf).select(*COLUMNS).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert {tuple(r) for r in rows} == brute(counted(docs))
    assert len(rows) == len(set(rows))


def test_tiles_that_are_split_lose_nothing(spark):
    rng = random.Random(8)
    words = {"antidis" + "".join(rng.choice("aeio") for _ in range(rng.randint(0, 6))) for _ in range(700)} | {"".join(rng.choice("ab") for _ in range(9)) for _ in range(300)}
    c = {w: rng.choice([2, 3, 5, 40, 60, 900]) for w in words}
    table = spark.createDataFrame(list(c.items()), "word string, n long")
    for most in (4, 100_000):
        assert {tuple(r) for r in spelling.variants(table, most=most).select(*COLUMNS).collect()} == brute(c)


def test_chains_ties_and_odd_rows(spark):
    def texts(words):
        return [(i, w) for i, w in enumerate(words)]

    rows = texts(["colourful"] * 2 + ["COLORFUL and"] * 30 + ["colorfull"] * 400 + ["Ähnlichkeit"] * 3 + ["ähnlichkeit"] * 3 + ["mistakes mistaken"] * 50 + ["mistakex"] * 5)
    long = "abcdefghij" * 2_000
    rows += [(None, "nobodyknows nobodyknows"), (7, None), (8, ""), (9, long), (9, long), (9, long[:-1] + "x"), (9, long[:-1] + "x")]
    docs = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], "doc_id long, text string, word string, n long, key string")
    got = {r["word"]: r for r in spelling.spelling_variants(docs).collect()}
    assert {tuple(r[c] for c in COLUMNS) for r in got.values()} == brute(counted(rows, None))
    assert (got["colourful"]["form"], got["colourful"]["root"]) == ("colorful", "colorfull")
    assert got["mistakex"]["form"] == "mistaken"  # as frequent as "mistakes"
    assert got[long]["n_near"] == 1
    assert {tuple(r[c] for c in COLUMNS) for r in spelling.spelling_variants(docs, damage=31).collect()} == brute(counted(rows))
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
