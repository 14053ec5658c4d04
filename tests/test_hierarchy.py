import random

import pytest

from lexmill.operators import hierarchy as H

SCHEMA = "id bigint, scope int, parent_id bigint, parent_number string, number string"


def brute(edges):
    out = {}
    kids = {}
    for n, p in edges.items():
        path, x = [n], p
        while x is not None and x not in path:
            path.append(x)
            x = edges[x]
        if x is None:
            path.reverse()
            out[n] = [path[0], len(path) - 1, 0, "/".join(map(str, path)), "tree"]
            for a in path[:-1]:
                kids[a] = kids.get(a, 0) + 1
        else:
            out[n] = [-1, -1, -1, "", "cycle" if x == n else "below_cycle"]
    for a, k in kids.items():
        out[a][2] = k
    return {n: tuple(v) for n, v in out.items()}


def got(df):
    return {r["node"]: (r["root"], r["depth"], r["n_descendants"], r["path"], r["state"]) for r in df.collect()}


@pytest.mark.parametrize("block", [0, 2, 12])
def test_random_forests(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK", block)
    rng = random.Random(7)
    edges = {1: None}
    for n in range(2, 200):
        edges[n] = rng.choice([None, n - 1, n - 1, n - 1, rng.randrange(1, n)])
    edges |= {300: 301, 301: 302, 302: 300, 303: 300, 304: 303, 305: 305, 306: 305}
    # A loop over blocks far apart, what hangs on it, and a chain that leaves its block and comes back.
    edges |= {10_000: 90_001, 90_001: 50_000, 50_000: 10_000, 90_002: 10_000, 10_001: 90_002, 50_001: 10_001, 70_000: 305}
    edges |= {20_000: None, 60_000: 20_000, 20_001: 60_000, 60_001: 20_001, 20_002: 60_001, 20_003: 20_002}
    df = spark.createDataFrame(list(edges.items()), "node bigint, parent bigint")
    want = brute(edges)
    assert got(H.hierarchy(df)) == want
    pairs = {(r["ancestor"], r["node"], r["distance"]) for r in H.ancestor_pairs(df).collect()}
    assert pairs == {(int(a), n, len(p) - 1 - i) for n, v in want.items() if v[4] == "tree" for p in [v[3].split("/")] for i, a in enumerate(p[:-1])}


def test_long_chain(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 3)
    edges = {0: None} | {n: n - 1 for n in range(1, 400)}
    assert got(H.hierarchy(spark.createDataFrame(list(edges.items()), "node bigint, parent bigint"))) == brute(edges)


def test_parents_by_id_or_number(spark):
    rows = [
        (1, 1, None, None, "A 1"), (2, 1, 1, "zzz", "2"), (3, 1, 999, "a1", "3"), (4, 2, None, "A 1", "4"), (5, 1, None, " A  1", "5"), (5, 1, None, " A  1", "5"),
        (6, None, None, "A1", "6"), (7, 1, None, None, None), (None, 1, 1, "A1", "8"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["node"]: r["parent"] for r in H.resolve_parents(df).collect()}
    assert out == {1: None, 2: 1, 3: 1, 4: None, 5: 1, 6: None, 7: None}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.hierarchy(H.resolve_parents(df)).count() == 0
    assert H.ancestor_pairs(H.resolve_parents(df)).count() == 0


def test_extra_columns_do_not_matter(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 1, None, None, "1"), (2, 1, None, "1", "2")], SCHEMA)
    for c in ("wanted", "by_id", "by_number", "node", "parent", "up", "path", "above", "stretch", "s"):
        df = df.withColumn(c, F.lit("x"))
    assert got(H.hierarchy(H.resolve_parents(df))) == {1: (1, 0, 1, "1", "tree"), 2: (1, 1, 0, "1/2", "tree")}


def test_many_children_of_one_node(spark):
    edges = {0: None} | {n: 0 for n in range(1, 3000)}
    df = spark.createDataFrame(list(edges.items()), "node bigint, parent bigint")
    assert got(H.hierarchy(df)) == brute(edges)
