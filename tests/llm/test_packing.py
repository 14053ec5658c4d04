import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexmill.llm import packing as P


def check(items, out, capacity):
    got = defaultdict(list)
    load = Counter()
    for r in out:
        got[r["id"]].append((r["part_no"], r["first"], r["size"]))
        load[r["container"]] += r["size"]
    assert not load or max(load.values()) <= capacity
    for i, n in items:
        parts = sorted(got[i])
        want = [(1, 0, 0)] if not n else [(k + 1, k * capacity, min(capacity, n - k * capacity)) for k in range(-(-n // capacity))]
        assert parts == want
    assert sorted(got) == sorted(i for i, _ in items)
    return load


@pytest.mark.parametrize("kind", ["mixed", "equal", "small", "few", "none"])
def test_pack(spark, kind, monkeypatch):
    monkeypatch.setattr(P, "SALTED", 50)
    rng = random.Random(3)
    sizes = {
        "mixed": [rng.choice([rng.randrange(0, 60), rng.randrange(60, 600), rng.randrange(0, 2500)]) for _ in range(600)],
        "equal": [300] * 400, "small": [rng.randrange(1, 20) for _ in range(500)], "few": [512, 1, None, 0], "none": [],
    }[kind]
    items = list(enumerate(sizes))
    out = P.pack(spark.createDataFrame(items, "id bigint, n bigint"), 512).collect()
    load = check(items, out, 512)
    if kind in ("mixed", "small"):
        total = sum(n or 0 for n in sizes)
        assert len(load) <= total / 512 * 1.06 + 1
    if kind == "equal":
        assert len(load) == 400


@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=12))
def test_configurations_use_everything_once(counts):
    used = Counter()
    for fill, times in P.configurations(counts, 100):
        assert sum(s * k for s, k in fill.items()) <= 100 and times > 0
        for s, k in fill.items():
            used[s] += k * times
    assert used == Counter(counts)


@given(st.dictionaries(st.integers(0, 50), st.integers(1, 9), max_size=8), st.dictionaries(st.integers(1, 12), st.integers(1, 40), max_size=6))
def test_best_fit_places_every_rank_once(rooms, sizes):
    moves, new = P.best_fit({r: n for r, n in rooms.items() if r}, sizes, 50)
    ranks, load = defaultdict(list), Counter()
    for size, first, n, kind, place in moves:
        ranks[size] += range(first, first + n)
        for k in range(n):
            load[kind, place + k] += size
            assert place + k < (new if kind == 51 else rooms[kind])
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in sizes.items()}
    assert all(v <= (50 if kind == 51 else kind) for (kind, _), v in load.items())


def test_groups_hold_alike_many():
    rounded = P.group_sizes({s: 10 for s in range(1, 101)}, 10)
    assert len(set(rounded.values())) == 10 and all(r >= s for s, r in rounded.items())


def test_check_tells_faults(spark):
    items = spark.createDataFrame([(1, 5), (2, 3), (3, 12), (4, None)], "id bigint, n bigint")
    good = P.checked(P.pack(items, 10), items, 10).first().asDict()
    assert (good["n_items"], good["overfull"], good["misplaced"], good["split_that_fit"], good["units"]) == (4, 0, 0, 0, 20)
    bad = spark.createDataFrame([(1, 1, 0, 4, 7), (1, 2, 4, 1, 8), (2, 1, 0, 3, 7), (3, 1, 0, 12, 7)], "id bigint, part_no int, first bigint, size int, container bigint")
    got = P.checked(bad, items, 10).first()
    assert (got["overfull"], got["split_that_fit"], got["misplaced"], got["most"]) == (1, 1, 1, 19)
