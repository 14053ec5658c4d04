import random
from itertools import combinations

import numpy as np
import regex

from lexmill.llm import neardup as N

WORDS = [f"w{i}" for i in range(400)]


def brute(rows, size, share, least):
    sets = {}
    for i, title, text in rows:
        words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
        if text is None or len(words) < least:
            continue
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (title or "").lower()) + words
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])}


def corpus(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(100, 200))]
        for k in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 8, 15])):
                j = rng.randrange(len(w))
                w[j : j + rng.choice([0, 1])] = [rng.choice(WORDS)]
            n += 1
            rows.append((n, rng.choice([None, "Title", "title"]), " ".join(w) if k else " ".join(w).upper()))
    return [*rows, (n + 1, None, None), (n + 2, "t", ""), (n + 3, None, "short text")]


def pairs(spark, rows, size=3, similarity=(7, 10), least=110):
    df = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, title string, text string, rep int")
    out = N.expand(*N.near_duplicates(df, size, similarity, least)).collect()
    assert len(out) == len(set(out))
    return {(r["id_a"], r["id_b"]) for r in out}


def test_against_all_pairs(spark):
    rows = corpus(1)
    want = brute(rows, 3, 0.7, 110)
    assert want and pairs(spark, rows) == want


def test_crowded_keys_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    rng = random.Random(5)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(12):
        w = list(base)
        for _ in range(4):
            w[rng.randrange(150)] = f"x{i}"
        rows.append((i, None, " ".join(w)))
    rows += [(100 + i, None, " ".join(base)) for i in range(5)]
    assert pairs(spark, rows) == brute(rows, 3, 0.7, 110)


def test_crowds_keep_pairs_that_share_one_segment(spark, monkeypatch):
    """Pairs at about 0.7 that meet in one table only, whose key there is hot; more chunks than one."""
    monkeypatch.setattr(N, "HOT", 8)
    rng = np.random.default_rng(7)
    n = 3 * N.CHUNK // 4
    symbols = rng.integers(0, 2**63, (2 * n, N.SYMBOLS), dtype=np.uint64)
    symbols[:, : N.WIDTH] = symbols[0, : N.WIDTH]
    for i in range(n):
        for s in range(1, N.SEGMENTS):
            at = s * N.WIDTH + rng.choice(N.WIDTH, N.WIDTH - 2, replace=False)
            symbols[n + i, at] = symbols[i, at]
    rows = [(i, x, k) for i, (x, k) in enumerate(zip((symbols & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16).tolist(), N.table_keys(symbols).view(np.int64).tolist()))]
    reps = spark.createDataFrame(rows, "rep bigint, symbols array<smallint>, keys array<bigint>")
    got = N.candidate_pairs(reps).collect()
    assert len(got) == n and {(r["a"], r["b"]) for r in got} == {(i, n + i) for i in range(n)}


def test_pairs_of_few_differing_symbols_always_meet():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, (40, N.SYMBOLS), dtype=np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(N.SYMBOLS, 2 * N.SEGMENTS - 1, replace=False)] += np.uint64(1)
    x, y = N.table_keys(a), N.table_keys(b)
    assert (x == y).any(axis=1).all()


def test_repeated_rows_and_empty(spark):
    text = " ".join(WORDS[:130])
    assert pairs(spark, [(1, None, text), (1, None, text), (2, None, text)]) == {(1, 2)}
    assert pairs(spark, []) == set()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, k) for k in range(300, 340)]
    pairs = spark.createDataFrame(chain + star + [(1, 900), (5, 900)], "a bigint, b bigint")
    got = {r["rep"]: r["group"] for r in N.components(pairs).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7} | {k: 7 for k in range(300, 340)} | {1: 1, 5: 1, 900: 1}
