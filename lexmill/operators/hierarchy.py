"""Parent-child rows to full hierarchies.

``resolve_parents`` finds each node's parent; ``hierarchy`` gives path, depth, root, number of descendants and state; ``ancestor_pairs`` every
node with each of its ancestors.

Nodes are dealt into partitions by blocks of neighbouring ids. Within a partition every node is followed up to the first ancestor that lies
elsewhere, its gate, or to its root; as parents mostly stand near their children, few nodes are gates of others. Frontier joins then run over the
gates alone, starting from those whose root is known. Round k joins the gates not yet reached with their ancestor 2^k gates up: if
that has been reached, the gate's path is the ancestor's path and its own stretch. So a round reaches a band of levels, and trees that cross d gates
take log2(d) rounds. The first empty band ends the search; nodes that no root reaches lead into loops. On gates, the image of the
parent map taken 2^k times shrinks to the loops themselves, and the stretches between gates on a loop are on it too. One last join puts the
gates' paths before the stretches of all other nodes.

Descendants are counted within partitions as they are followed; every gate adds those that come through it to all on its path. Where ids
say nothing about kinship, most parents are gates and the rounds run over all of them, which is slower but gives the same rows.

Rounds write their state to the shared folder. A partition holds its blocks' ids and parents only (16 bytes a node) and their stretches. Hot gates sit on
the many side of joins whose other side is unique, which adaptive execution splits.

Defined results: exact duplicates of a node count once, of differing rows with one id the smallest; a null id is no node; a
parent that names nothing makes a root; a node that is its own parent is a loop; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise, materialise_counted

ABSENT = -1
#: Neighbouring ids in one block, as a power of two.
BLOCK = 12
#: Ids of stretches in one batch handed on.
BATCH = 1 << 20


def resolve_parents(rows: DataFrame) -> DataFrame:
    """(node, parent) of rows (id, scope, parent_id, parent_number, number).

    The parent is the row whose id is parent_id, else the row of the same scope whose number equals parent_number ignoring case and
    spaces (of several the lowest id), else null.
    """
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"[ \t\r\n]+", ""))
    nodes = rows.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("scope", "parent_id", "parent_number", "number")).alias("s")).select(
        "id", "s.scope", "s.parent_id", squeeze("s.parent_number").alias("wanted"), squeeze("s.number").alias("number")
    )
    nodes = materialise(nodes)
    ids = nodes.select(F.col("id").alias("by_id"))
    numbers = nodes.where("number IS NOT NULL AND scope IS NOT NULL").groupBy("scope", F.col("number").alias("wanted")).agg(F.min("id").alias("by_number"))
    # Rows without a key stay out of the joins: as nulls they would all meet in one task.
    by_id = nodes.where("parent_id IS NOT NULL").join(ids, F.col("parent_id") == F.col("by_id"), "left")
    by_id = materialise(by_id.select("id", "scope", "wanted", "by_id"))
    direct = by_id.where("by_id IS NOT NULL").select(F.col("id").alias("node"), F.col("by_id").alias("parent"))
    open_ = by_id.where("by_id IS NULL").drop("by_id").unionByName(nodes.where("parent_id IS NULL").select("id", "scope", "wanted"))
    keyed = F.col("scope").isNotNull() & F.col("wanted").isNotNull()
    named = open_.where(keyed).join(numbers, ["scope", "wanted"], "left").select(F.col("id").alias("node"), F.col("by_number").alias("parent"))
    roots = open_.where(~keyed).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"))
    return direct.unionByName(named).unionByName(roots)


_FOLLOWED = "node bigint, gate bigint, stretch array<bigint>, below bigint, state string"


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the nodes (node, parent) of a partition: their gate, the stretch below it, their descendants here, and a loop's state."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    node = rows.column(0).to_numpy()
    has = ~np.asarray(rows.column(1).is_null())
    parent = rows.column(1).fill_null(0).to_numpy()
    order = np.argsort(node, kind="stable")
    node, has, parent = node[order], has[order], parent[order]
    n = len(node)
    at = np.minimum(np.searchsorted(node, parent), n - 1)
    here = has & (node[at] == parent)
    top = ~here  # the uppermost here: a root, or below a gate
    up = np.where(here, at, np.arange(n))
    end = up
    for _ in range(max(1, int(n).bit_length())):
        end = end[end]
    ends = top[end]
    loop = np.zeros(n, dtype=bool)
    loop[end[~ends]] = True
    gate = np.where(ends & has[end] & top[end], parent[end], 0)
    gated = ends & has[end]
    depth = np.zeros(n, dtype=np.int64)
    active = np.flatnonzero(ends & here)
    cursor = up[active]
    while len(active):
        depth[active] += 1
        more = here[cursor]
        active, cursor = active[more], up[cursor[more]]
    below = np.zeros(n, dtype=np.int64)
    deepest = np.argsort(-depth, kind="stable")
    deepest = deepest[(ends & here)[deepest]]
    cuts = np.flatnonzero(np.diff(depth[deepest])) + 1
    for level in np.split(deepest, cuts):
        np.add.at(below, up[level], below[level] + 1)
    state = np.where(ends, None, np.where(loop, "cycle", "below_cycle"))
    sizes = np.where(ends, depth + 1, 0)
    start = 0
    total = np.cumsum(sizes)
    while start < n:
        taken = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, taken + BATCH, side="right")))
        part = np.arange(start, min(stop, n))
        offsets = np.concatenate([[0], np.cumsum(sizes[part])])
        flat = np.empty(int(offsets[-1]), dtype=np.int64)
        active = np.flatnonzero(sizes[part])
        place, cursor = offsets[active + 1] - 1, part[active]
        while len(cursor):
            flat[place] = node[cursor]
            more = here[cursor]
            place, cursor = place[more] - 1, up[cursor[more]]
        yield pa.record_batch(
            [
                pa.array(node[part]), pa.array(gate[part], pa.int64(), mask=~gated[part]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                pa.array(below[part]), pa.array(state[part], pa.string()),
            ],
            ["node", "gate", "stretch", "below", "state"],
        )
        start = int(part[-1]) + 1


def _reach(gates: DataFrame, max_rounds: int) -> tuple[list[DataFrame], DataFrame]:
    """(bands (node, path), rows (node, up) never reached) of gates (node, gate, stretch, state)."""
    reached = [gates.where("state IS NULL AND gate IS NULL").select("node", F.col("stretch").alias("path"))]
    # up: the ancestor 2^k gates up; stretch: the nodes from just below it to the node itself. Local loops have no way up.
    open_ = gates.where("state IS NOT NULL OR gate IS NOT NULL").select("node", F.col("gate").alias("up"), "stretch")
    for _ in range(max_rounds):
        known = reached[0]
        for part in reached[1:]:
            known = known.unionByName(part)
        step = open_.join(known.select(F.col("node").alias("up"), F.col("path").alias("above")), "up", "left")
        step, n = materialise_counted(step, reached=F.count("above"), all=F.count(F.lit(1)))
        reached.append(step.where("above IS NOT NULL").select("node", F.concat("above", "stretch").alias("path")))
        left = step.where("above IS NULL").select("node", "up", "stretch")
        if not n["reached"] or n["reached"] == n["all"]:
            return reached, left
        # The ancestor of a gate left over is no root, so it has a pointer of its own in this step.
        further = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("stretch").alias("before"))
        open_ = materialise(left.join(further, "up", "left").select("node", F.col("next").alias("up"), F.concat("before", "stretch").alias("stretch")))
    raise RuntimeError("more levels than rounds")


def _on_loops(unreached: DataFrame, gates: DataFrame, max_rounds: int) -> DataFrame:
    """(node) of the unreached gates that lie on a loop over several partitions: those in every image of the parent map."""
    jump = gates.where("state IS NULL").join(unreached.select("node"), "node", "left_semi").select("node", F.col("gate").alias("up"))
    inside = jump.select(F.col("node").alias("up"))
    jump, n = materialise_counted(jump.join(inside, "up", "left_semi").select("node", "up"), all=F.count(F.lit(1)))
    image = jump.select(F.col("up").alias("node")).distinct()
    size = image.count() if n["all"] else 0
    for _ in range(max_rounds if size else 0):
        jump = materialise(jump.join(jump.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        image = jump.select(F.col("up").alias("node")).distinct()
        before, size = size, image.count()
        if size == before:
            break
    return image


def _paths(edges: DataFrame, max_rounds: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(followed rows, reached gates (gate, above), their counts (node, more), nodes on loops over several partitions)."""
    followed = edges.select(F.col("node").cast("long"), F.col("parent").cast("long")).repartition(F.shiftright("node", BLOCK)).mapInArrow(_follow, _FOLLOWED)
    followed, n = materialise_counted(followed, gated=F.count("gate"))
    entries = materialise(followed.where("gate IS NOT NULL").groupBy("gate").agg(F.count("*").alias("n")))
    if not n["gated"]:
        nothing = followed.where("false")
        return followed, nothing.select("gate", F.col("stretch").alias("above")), nothing.select("node", F.col("below").alias("more")), nothing.select("node")
    gates = materialise(followed.join(entries.select(F.col("gate").alias("node")), "node", "left_semi"))
    reached, left = _reach(gates, max_rounds)
    known = reached[0]
    for part in reached[1:]:
        known = known.unionByName(part)
    known = materialise(known.select(F.col("node").alias("gate"), F.col("path").alias("above")))
    more = known.join(entries, "gate").select(F.explode("above").alias("node"), "n").groupBy("node").agg(F.sum("n").alias("more"))
    circling = _on_loops(left, gates, max_rounds)
    looped = gates.join(circling, "node", "left_semi").select(F.explode("stretch").alias("node"))
    return followed, known, more, looped.distinct()


def hierarchy(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root, depth, n_descendants, path, state) of unique rows (node, parent).

    depth, root and n_descendants are -1 and path '' for nodes on loops (cycle) or leading into one (below_cycle).
    """
    followed, known, more, looped = _paths(edges, max_rounds)
    tree = followed.where("state IS NULL").join(known, "gate", "left").where("gate IS NULL OR above IS NOT NULL").join(more, "node", "left")
    whole = F.when(F.col("gate").isNull(), F.col("stretch")).otherwise(F.concat("above", "stretch"))
    tree = tree.select("node", whole.alias("path"), (F.col("below") + F.coalesce("more", F.lit(0))).alias("n")).select(
        "node",
        F.element_at("path", 1).alias("root"),
        (F.size("path") - 1).cast("long").alias("depth"),
        F.col("n").cast("long").alias("n_descendants"),
        F.array_join(F.col("path").cast("array<string>"), "/").alias("path"),
        F.lit("tree").alias("state"),
    )
    lost = followed.where("state IS NOT NULL").select("node", "state")
    open_ = followed.where("state IS NULL AND gate IS NOT NULL").select("node", "gate").join(known.select("gate"), "gate", "left_anti")
    open_ = open_.join(looped.withColumn("_in", F.lit(True)), "node", "left").select("node", F.when(F.col("_in"), "cycle").otherwise("below_cycle").alias("state"))
    absent = F.lit(ABSENT).cast("long")
    return tree.unionByName(lost.unionByName(open_).select("node", absent.alias("root"), absent.alias("depth"), absent.alias("n_descendants"), F.lit("").alias("path"), "state"))


def ancestor_pairs(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(ancestor, node, distance) of every node that a root reaches and each of its ancestors; so of every node all its descendants."""
    followed, known, _, _ = _paths(edges, max_rounds)
    tree = followed.where("state IS NULL").join(known, "gate", "left").where("gate IS NULL OR above IS NOT NULL")
    path = F.when(F.col("gate").isNull(), F.col("stretch")).otherwise(F.concat("above", "stretch"))
    pairs = tree.select("node", F.size(path).alias("_n"), F.posexplode(path).alias("_at", "ancestor")).where("_at < _n - 1")
    return pairs.select("ancestor", "node", (F.col("_n") - 1 - F.col("_at")).cast("long").alias("distance"))
