"""Near-duplicate records by multi-index hashing.

A record's fingerprint has SEGMENTS * WIDTH symbols, the minima of as many hash orders over its set of word shingles; two records
agree in a symbol with the probability of their Jaccard similarity, so the Hamming distance of fingerprints follows it. Multi-index hashing
with one table a segment: the ball of radius one in a segment is the segment with any one symbol left out, so each record has
WIDTH keys in each table and two records meet in a table if at most one symbol of that segment differs. Pairs whose fingerprints differ in at
most 2 * SEGMENTS - 1 symbols therefore always meet, and at a similarity of 0.7 pairs beyond that miss all tables with a probability
of about (1 - 0.53) ** 12, 1 in 8,000. Complete distances are verified on the fingerprints, then similarity exactly on the sets.

Records with equal sets form a class first and only its lowest id is indexed, so any number of copies costs one row there. Keys of one
record alone are dropped before anything is joined. Keys with more than ``HOT`` records are not joined as they are: their records are dealt
into chunks of about ``CHUNK`` and fingerprints are compared chunk against chunk, every pair once a key, so a crowd loses no pair
that any other key would give; only pairs that agree in ``AGREE`` symbols leave the worker. This is quadratic in the size of a crowd.
Texts travel once, and only those of candidates are read again.

Defined results: null text or fewer than ``min_words`` words: no record; a null title is empty; a pair comes once, lower id first; all pairs within
a class are pairs of similarity one; equal rows of one id count once; an empty table gives an empty result; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise, materialise_counted, spread

SEGMENTS, WIDTH, HOT, CHUNK = 12, 5, 64, 1024
SYMBOLS = SEGMENTS * WIDTH
#: Symbols that must agree in complete fingerprints: at 0.7, 42 of 60 are expected and 3.5 the deviation; fewer than 22 come in less than 1 of 10**7.
AGREE = 22
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_C = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MARK = _rng.integers(1, 2**63, (SEGMENTS, WIDTH), dtype=np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the word shingles of texts; words are looked up once a worker."""

    def __init__(self, size: int, min_words: int):
        import regex
        import xxhash

        self.size, self.min_words, self.words = size, min_words, regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
        self.hash, self.known = xxhash.xxh64_intdigest, {}

    def _ids(self, words: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[w] for w in words]
        except KeyError:
            if len(known) > 1_000_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.hash(w)
            return [known[w] for w in words]

    def sets(self, titles: list[str | None], texts: list[str]) -> tuple[list[int], list[np.ndarray]]:
        """Positions of the records that count, and for each its sorted distinct shingle hashes."""
        places, out = [], []
        for i, (title, text) in enumerate(zip(titles, texts)):
            body = self.words(text.lower())
            if len(body) < self.min_words:
                continue
            w = np.array(self._ids(self.words(title.lower()) + body if title else body), dtype=np.uint64)
            n = len(w) - self.size + 1
            if n < 1:
                continue
            h = np.zeros(n, dtype=np.uint64)
            for k in range(self.size):
                h += w[k : n + k] * _C[k]
            places.append(i)
            out.append(np.unique(_mix(h)))
        return places, out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """Symbols (records, SYMBOLS) of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint64)
    for j in range(SYMBOLS):
        x = flat * _A[j] + _B[j]
        out[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
    return out


def table_keys(symbols: np.ndarray) -> np.ndarray:
    """Keys (records, SEGMENTS * WIDTH): of each segment, the segment without each one of its symbols."""
    mixed = _mix(symbols + _B).reshape(len(symbols), SEGMENTS, WIDTH)
    rest = mixed.sum(axis=2, keepdims=True, dtype=np.uint64) - mixed
    return _mix(rest + _MARK).reshape(len(symbols), -1)


def _index(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingler = Shingler(size, min_words)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            places, sets = shingler.sets(part.column(1).to_pylist(), part.column(2).to_pylist())
            if not sets:
                continue
            symbols = fingerprints(sets)
            as_list = lambda x, kind: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), kind))
            yield pa.record_batch(
                [
                    part.column(0).take(pa.array(places)),
                    pa.array([np.int64(np.uint64(xxhash.xxh64_intdigest(s.tobytes()))) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    as_list((symbols & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16), pa.int16()),
                    as_list(table_keys(symbols).view(np.int64), pa.int64()),
                ],
                ["id", "set_key", "n", "symbols", "keys"],
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int, min_words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(size, min_words)
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            places, sets = shingler.sets(part.column(1).to_pylist(), part.column(2).to_pylist())
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.record_batch([part.column(0).take(pa.array(places, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))], ["id", "shingles"])


def _matrix(rows: pa.Table) -> np.ndarray:
    return rows.column("symbols").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, SYMBOLS)


def _compare(rows: pa.Table) -> pa.Table:
    """(a, b) of the rows (lo, hi, chunk, rep, symbols) of one pair of chunks: the pairs across it that agree enough."""
    low, high = rows["lo"][0].as_py(), rows["hi"][0].as_py()
    sides = [rows.filter(pa.compute.equal(rows["chunk"], c)) for c in (low, high)]
    ids = [x.column("rep").to_numpy() for x in sides]
    left, right = (np.ascontiguousarray(_matrix(x).T) for x in sides)
    out_a, out_b = [], []
    for at in range(0, len(ids[0]), 256):
        same = np.zeros((min(256, len(ids[0]) - at), len(ids[1])), dtype=np.uint8)
        for x, y in zip(left, right):
            same += x[at : at + 256, None] == y[None, :]
        i, j = np.nonzero(same >= AGREE)
        x, y = ids[0][at + i], ids[1][j]
        keep = x < y if low == high else x != y
        out_a.append(np.minimum(x, y)[keep])
        out_b.append(np.maximum(x, y)[keep])
    empty = np.empty(0, np.int64)
    return pa.table([pa.array(np.concatenate([empty, *out_a])), pa.array(np.concatenate([empty, *out_b]))], ["a", "b"])


def _crowded_pairs(hot: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b) of rows (key, rep, n), n the records under the key: all pairs under one key that agree in AGREE symbols."""
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = hot.select("key", "rep", chunks.alias("chunks"), F.pmod(F.xxhash64("rep"), chunks).cast("int").alias("chunk"))
    met = dealt.select("key", "rep", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    met = met.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "rep").join(reps.select("rep", "symbols"), "rep")
    return met.select("key", "lo", "hi", "chunk", "rep", "symbols").groupBy("key", "lo", "hi").applyInArrow(_compare, "a bigint, b bigint")


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """Distinct (a, b) of records (rep, symbols, keys) that meet in a table; of those that meet in a crowd, the ones that agree in AGREE symbols."""
    keyed = reps.select(F.explode("keys").alias("key"), "rep").withColumn("n", F.count("*").over(Window.partitionBy("key")))
    counted = materialise(keyed.where("n > 1"))
    few = counted.where(F.col("n") <= HOT).select("key", "rep")
    pairs = few.select("key", F.col("rep").alias("a")).join(few.select("key", F.col("rep").alias("b")), "key").where("a < b").select("a", "b")
    hot = counted.where(F.col("n") > HOT)
    if hot.limit(1).count():
        pairs = pairs.unionByName(_crowded_pairs(hot, reps))
    return pairs.distinct()


def _agreeing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def near_duplicates(records: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), min_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of rows (id, title, text): members (id, rep) of every record, pairs (a, b) of classes at least as similar as asked."""
    # The shortest text of so many words has a character and a space for each.
    records = records.where("text IS NOT NULL AND id IS NOT NULL").where(F.length("text") >= max(1, 2 * min_words - 1)).select(F.col("id").cast("long").alias("id"), "title", "text")
    work = partial(_index, size=size, min_words=min_words)
    index = materialise(spread(records).mapInArrow(work, "id bigint, set_key bigint, n int, symbols array<smallint>, keys array<bigint>"))
    classes = index.groupBy("set_key", "n").agg(F.min("id").alias("rep"))
    members = materialise(index.select("id", "set_key", "n").join(classes, ["set_key", "n"]).select("id", "rep").distinct())
    reps = index.join(members.where("id = rep").select("rep"), F.col("id") == F.col("rep")).select("rep", "n", "symbols", "keys").dropDuplicates(["rep"])
    reps = materialise(reps)
    pairs = candidate_pairs(reps.select("rep", "symbols", "keys"))
    marks = reps.select("rep", "symbols")
    pairs = pairs.join(marks.select(F.col("rep").alias("a"), F.col("symbols").alias("sa")), "a").join(marks.select(F.col("rep").alias("b"), F.col("symbols").alias("sb")), "b")
    pairs = materialise(pairs.where(_agreeing(F.col("sa"), F.col("sb")) >= AGREE).select("a", "b"))
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = records.join(wanted, "id", "left_semi").mapInArrow(partial(_sets, size=size, min_words=min_words), "id bigint, shingles array<bigint>").dropDuplicates(["id"])
    sets = materialise(sets)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    near = both.withColumn("common", common).where(F.col("common") * similarity[1] >= (F.size("x") + F.size("y") - F.col("common")) * similarity[0])
    return members, near.select("a", "b")


def expand(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs of records: within classes, and across pairs of classes."""
    m = lambda id_, rep: members.select(F.col("id").alias(id_), F.col("rep").alias(rep))
    within = m("x", "rep").join(m("y", "rep"), "rep").where("x < y").select("x", "y")
    across = pairs.join(m("x", "a"), "a").join(m("y", "b"), "b").select("x", "y")
    return within.unionByName(across).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(rep, group): the least record of all that are connected by rows (a, b), for every record in them.

    Each round every record takes the least label of its neighbours and then the label of that label, so chains shorten by more than half; what is
    known is written to the shared folder and nothing is collected.
    """
    edges = materialise(pairs.select("a", "b").union(pairs.select("b", "a")))
    labels = edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("group"))
    for _ in range(max_rounds):
        labels = materialise(labels)
        near = edges.join(labels.select(F.col("rep").alias("b"), "group"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("group").alias("near"))
        step = labels.join(near, "rep").select("rep", F.col("group").alias("before"), F.least("group", "near").alias("group"))
        step = step.join(labels.select(F.col("rep").alias("group"), F.col("group").alias("further")), "group").select("rep", "before", F.least("group", "further").alias("group"))
        step, n = materialise_counted(step, changed=F.count_if(F.col("group") < F.col("before")))
        labels = step.select("rep", "group")
        if not n["changed"]:
            return labels
    raise RuntimeError("longer chains than rounds")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, group_id, n_links) of every record: its class of equal sets, the group that links connect, and with how many records it is a pair."""
    sizes = members.groupBy("rep").agg(F.count("*").alias("n"))
    both = materialise(pairs.union(pairs.select("b", "a")).toDF("rep", "other"))
    links = both.join(sizes.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("linked"))
    classes = sizes.join(links, "rep", "left").join(components(pairs), "rep", "left")
    classes = classes.select("rep", F.coalesce("group", "rep").alias("group_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"))
    return members.join(classes, "rep").select("id", F.col("rep").alias("class_id"), "group_id", "n_links")
