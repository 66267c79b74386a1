"""The similarity join against all pairs by brute force, also where leaders find little, tiles are cut and rows are odd."""

import random
from itertools import combinations

import numpy as np
import pytest

from quire.llm import jaccard_join


def shingles(text, n=5):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, percent=80, n=5):
    sets = [shingles(t, n) for _, t in rows]
    over = list(range(len(rows)))

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    for i, j in {p for m in by.values() for p in combinations([i for i in m if rows[i][0] is not None], 2)}:
        k = len(sets[i] & sets[j])
        if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
            over[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = d if least.get(top(i)) is None else min(least[top(i)], d if d is not None else least[top(i)])
    return sorted(((d, len(s), None if d is None else least[top(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def families(rng, n, size):
    """Texts that come from one another by some changed words, near the threshold."""
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 60, 200]))]
        for _ in range(size):
            new = list(rng.choice(out[-3:]) if out and rng.random() < 0.3 else base)
            for _ in range(rng.randint(0, max(1, len(new) // 30))):
                new[rng.randrange(len(new))] = rng.choice(vocabulary)
            out.append(new if rng.random() < 0.8 else new[: max(1, int(len(new) * rng.uniform(0.75, 1)))])
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_bounds_and_intersections_hold():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 3000, dtype="u8")
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(60)]
    bits = [jaccard_join.bitmap(s).tobytes() for s in sets]
    assert len(set(map(len, bits))) > 1
    for i, j in combinations(range(60), 2):
        k = len(np.intersect1d(sets[i], sets[j]))
        assert jaccard_join.shared(sets[i], sets[j]) == k
        least = min(len(bits[i]), len(bits[j]))
        a, b = (jaccard_join.folded(bits[x], least).view("u8") for x in (i, j))
        assert jaccard_join.overlap_bound(a, b, len(sets[i]), len(sets[j])) >= k


@pytest.mark.parametrize(("leaders", "part", "block", "most"), [(3, 1024, 128, 8), (1, 5, 3, 8), (1, 1024, 128, 0)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, leaders, part, block, most):
    """Also with one leader, with tiles cut into parts of a few sets, and with sets dealt out for any pair."""
    monkeypatch.setattr(jaccard_join, "MOST_PAIRS", most)
    monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
    monkeypatch.setattr(jaccard_join, "PART_SETS", part)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = families(random.Random(3), 14, 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(jaccard_join.similar(df)) == brute(rows)


def test_another_threshold_and_shingle(spark):
    rows = families(random.Random(6), 6, 20)
    df = spark.createDataFrame([(t, d) for d, t in rows], "body string, key long")
    assert result(jaccard_join.similar(df, words=3, percent=60, id_col="key", text_col="body")) == brute(rows, 60, 3)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 7000}" for i in range(60_000))
    rows = [(1, "A b c d e f g h i j k l m n o p q r s t u v"), (2, "a B c d e f g h i j k l m n o p q r s t u v"), (3, None), (4, ""), (5, "one two"), (6, "One  two"), (7, "two one"), (None, "one two")]
    rows += [(8, long), (9, long + " x"), (10, "é É " * 4), (11, "É é " * 4), (12, "\n \t"), (13, "x" * 100_000), (14, "x" * 100_000)]
    rows += [(20, "p q r s t u"), (20, "p q r s t u"), (20, "another text of this id altogether"), (21, "another text of this id altogether")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n long, digest string, label string")
    assert result(jaccard_join.similar(df)) == brute(rows)
    assert jaccard_join.similar(df.limit(0)).count() == 0
