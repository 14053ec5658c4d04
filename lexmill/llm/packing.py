"""Filling containers of fixed capacity with items of varying length, by linear grouping.

Sizes are whole numbers up to the capacity, so a histogram of them has at most ``capacity`` rows however many items there are. The plan is made
on histograms alone; the items follow it by their rank:

1. items over the capacity are split into full parts and a rest; a full part is a container of its own;
2. large items are put into groups of equal cardinality by size, and every size is rounded up to the largest of its group;
3. with few sizes left, the configuration that fills a container of the largest size best is found by dynamic programming and used as often as the counts allow,
   again and again: a greedy choice of configurations, not the best set of them; many groups keep the loss by rounding small;
4. actual items take the places of their group, which leaves rounding room; the containers' room is counted exactly;
5. small items are placed best fit, largest first, into what room is left, again on histograms: of rooms and of small sizes.

Ranks are taken within (size, salt), and the salts' offsets come from their counts, so no size however common is sorted in one task.

Defined results: null and empty texts are items of no size in container 0; every row is an item, repeated ones too; ties are broken by id; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import local_table, materialise

#: Items up to this share of the capacity are small.
SMALL = 8
GROUPS = 512
#: Rows that one salt of a size should hold.
SALTED = 200_000
#: Rows of a plan that are broadcast, some MB; plans have a few rows for each size and room, whatever the items.
PLANNED = 200_000


def group_sizes(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Of each large size the rounded size, in ``groups`` groups of equal cardinality (a size is never divided)."""
    total, seen, of, top, at = sum(counts.values()), 0, {}, {}, 0
    for size in sorted(counts, reverse=True):
        at = min(groups - 1, seen * groups // max(1, total))
        of[size] = at
        top.setdefault(at, size)
        seen += counts[size]
    return {size: top[g] for size, g in of.items()}


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(places of each rounded size, number of containers) until no item is left."""
    left, plan = dict(counts), []
    while left:
        first = max(left)
        fill = {first: 1}
        room = capacity - first
        sizes = sorted((s for s in left if s <= room), reverse=True)
        if sizes:
            # best[r]: the size last added to reach a load of r, 0 for none; loads only grow, one size after the other.
            best, used = np.zeros(room + 1, dtype=np.int64), np.zeros(room + 1, dtype=np.int64)
            reach = np.zeros(room + 1, dtype=bool)
            reach[0] = True
            for s in sizes:
                used[:] = 0
                most = min(left[s] - fill.get(s, 0), room // s)
                for k in range(1, most + 1):
                    # Loads reached with k of this size, from loads reached without it.
                    fresh = np.flatnonzero(reach[: room + 1 - s] & ~reach[s:] & (used[: room + 1 - s] == k - 1)) + s
                    if not len(fresh):
                        break
                    reach[fresh], best[fresh], used[fresh] = True, s, k
                if reach[room]:
                    break
            load = int(np.flatnonzero(reach)[-1])
            while load:
                s = int(best[load])
                fill[s] = fill.get(s, 0) + 1
                load -= s
        times = min(left[s] // k for s, k in fill.items())
        if times < 1:  # a load reached twice through one size may ask for more than there is
            fill, times = {first: 1}, left[first]
        plan.append((fill, times))
        for s, k in fill.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
    return plan


def best_fit(rooms: dict[int, int], sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves (size, first rank, number, class, first rank in class) and the number of new containers.

    Class is a room of ``rooms``, whose containers are ranked from 0, or capacity + 1 for new containers.
    """
    blocks: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # room now: (class, first rank, number)
    for room, n in rooms.items():
        blocks[room].append((room, 0, n))
    moves, new = [], 0
    for size in sorted(sizes, reverse=True):
        rank, count = 0, sizes[size]
        fitting = sorted((r for r in blocks if r >= size and blocks[r]), reverse=True)
        while count:
            if not fitting:
                n = -(-count // (capacity // size))
                blocks[capacity].append((capacity + 1, new, n))
                new += n
                fitting = [capacity]
            room = fitting[-1]
            kind, start, n = blocks[room].pop()
            k = min(n, count)
            if n > k:
                blocks[room].append((kind, start + k, n - k))
            moves.append((size, rank, k, kind, start))
            blocks[room - size].append((kind, start, k))
            rank, count = rank + k, count - k
            if not blocks[room]:
                fitting.pop()
            if room - size >= size and room - size not in fitting:
                fitting.append(room - size)
                fitting.sort(reverse=True)
    return moves, new


def _ranked(rows: DataFrame, key: str, order: list[str], total: int) -> DataFrame:
    """``rows`` with rank, from 0 within each value of ``key``."""
    salts = max(1, -(-total // SALTED))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    counts = rows.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order)) - 1
    # Both sides are spread by size and salt, as the ranks need them anyway; the salts grow with the data, so nothing is broadcast.
    return rows.withColumn("_within", within).join(counts, [key, "_salt"]).withColumn("rank", (F.col("_within") + F.col("_before")).cast("long")).drop("_salt", "_before", "_within")


def _bounded(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` to be broadcast if they are as few as the plan's bounds say, else to be joined as they are."""
    return F.broadcast(rows) if n <= PLANNED else rows


def _histogram(rows: DataFrame, key: str) -> dict[int, int]:
    """At most capacity + 1 rows reach the driver."""
    return {r[key]: r["n"] for r in rows.groupBy(key).agg(F.count("*").alias("n")).collect()}


def pack(items: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """(id, part_no, first, size, container) of rows (id, n): the part of the item from its unit ``first`` on."""
    spark = items.sparkSession
    parts = items.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n")).withColumn("part_no", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int"))))
    parts = parts.select("id", "part_no", ((F.col("part_no") - 1) * capacity).cast("long").alias("first"), F.least(F.col("n") - (F.col("part_no") - 1) * capacity, F.lit(capacity)).cast("int").alias("size"))
    parts = materialise(parts)
    counts = _histogram(parts, "size")
    total = sum(counts.values())
    small = {s: n for s, n in counts.items() if 0 < s <= capacity // SMALL}
    large = {s: n for s, n in counts.items() if s > capacity // SMALL}
    rounded = group_sizes(large, groups)
    of_group: dict[int, int] = defaultdict(int)
    for s, n in large.items():
        of_group[rounded[s]] += n
    places, taken, start = [], defaultdict(int), 0
    for fill, times in configurations(of_group, capacity):
        for g, k in fill.items():
            places.append((g, taken[g], k * times, start, times))
            taken[g] += k * times
        start += times
    sizes = local_table(spark, sorted(rounded.items()), size=pa.int32(), grp=pa.int32())
    plan = local_table(spark, places, grp=pa.int32(), _from=pa.int64(), _number=pa.int64(), _start=pa.int64(), _times=pa.int64())
    # Both are made from the histogram: at most one row a size, and a few for each group and configuration.
    put = _ranked(parts.join(_bounded(sizes, len(rounded)), "size"), "grp", ["id", "part_no"], total)
    put = put.join(_bounded(plan, len(places)), "grp").where("rank >= _from AND rank < _from + _number")
    put = materialise(put.select("id", "part_no", "first", "size", (F.col("_start") + (F.col("rank") - F.col("_from")) % F.col("_times")).alias("container")))
    load = materialise(put.groupBy("container").agg((F.lit(capacity) - F.sum("size")).cast("int").alias("room")))
    moves, new = best_fit({r: n for r, n in _histogram(load, "room").items() if r}, small, capacity)
    steps = local_table(spark, moves, size=pa.int32(), _from=pa.int64(), _number=pa.int64(), room=pa.int32(), _first=pa.int64())
    fill = _ranked(parts.where((F.col("size") > 0) & (F.col("size") <= capacity // SMALL)), "size", ["id", "part_no"], total)
    fill = fill.join(_bounded(steps, len(moves)), "size").where("rank >= _from AND rank < _from + _number").withColumn("place", F.col("_first") + F.col("rank") - F.col("_from"))
    opened = spark.range(start, start + new).select(F.col("id").alias("container"), F.lit(capacity + 1).alias("room"), (F.col("id") - start).alias("place"))
    found = _ranked(load.where("room > 0"), "room", ["container"], total).select("container", "room", F.col("rank").alias("place")).unionByName(opened)
    fill = fill.select("id", "part_no", "first", "size", "room", "place").join(found, ["room", "place"])
    columns = ["id", "part_no", "first", "size", "container"]
    none = parts.where("size = 0").withColumn("container", F.lit(0).cast("long"))
    return put.select(columns).unionByName(fill.select(columns)).unionByName(none.select(columns))


def checked(assigned: DataFrame, items: DataFrame, capacity: int) -> DataFrame:
    """One row of facts about an assignment of items (id, n): sizes, containers against the least possible number, and what would be faults."""
    loads = assigned.where("size > 0").groupBy("container").agg(F.sum("size").alias("load"))
    load = loads.agg(F.count("*").alias("n_containers"), F.max("load").alias("most"), F.count_if(F.col("load") > capacity).alias("overfull"), F.coalesce(F.sum("load"), F.lit(0)).alias("units"))
    parts = assigned.groupBy("id").agg(F.count("*").alias("parts"), F.sum("size").alias("placed"))
    faults = items.select("id", F.coalesce("n", F.lit(0)).alias("n")).join(parts, "id", "full_outer").agg(
        F.count("*").alias("n_items"),
        F.count_if(~F.col("n").eqNullSafe(F.col("placed"))).alias("misplaced"),
        F.count_if((F.col("n") <= capacity) & (F.col("parts") > 1)).alias("split_that_fit"),
    )
    one = load.crossJoin(faults)  # one row each
    return one.select("n_items", "n_containers", F.ceil(F.col("units") / capacity).alias("least_containers"), "units", "most", "overfull", "misplaced", "split_that_fit")
