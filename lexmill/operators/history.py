"""History of changing attributes from collected states, and its maintenance by rebuilding affected chains.

Input rows: entity, id, text, source_kind, effective_from, effective_to, created_at. A chain is the list of versions of one
entity; its periods never overlap.

* rows with null text are no states; rows with null entity belong to no chain and are left out;
* of rows with equal effective_from (null is one value before all days) the latest created_at, then the highest id, holds;
* a state ends at the next start, or at its own effective_to where that is earlier and lies after its own start;
* adjoining states of equal source_kind (nulls equal) and equal text (whitespace runs as one space, trimmed) are one version.

The state of one entity and day is picked by a partial aggregate before anything is sorted, so a chain holds at most one row
per calendar day however often an entity was collected: no group that windows see is unbounded.

``HistoryStore`` keeps the chains and the log of raw changes in the shared folder, both in buckets of entities. An update reads the log and the
chains of the buckets it touches, rebuilds the chains of its entities from all their changes, writes these buckets beside the old ones and swaps
them in by one new manifest. Files of other buckets are neither read nor written; without the manifest nothing has changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.session import files_of, shared_dir

CHAIN = ["entity", "valid_from", "valid_to", "source_kind", "text_key", "id"]
#: Bytes of raw rows that one bucket should hold, and the limits of the number of buckets.
BUCKET_BYTES, BUCKETS = 128 << 20, (8, 16384)


def changes(raw: DataFrame) -> DataFrame:
    """The raw changes as a log: one narrow row per state; text_key identifies the text after whitespace is levelled."""
    level = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    return raw.where("text IS NOT NULL AND entity IS NOT NULL").select(
        "entity", "id", "effective_from", "effective_to", "source_kind", F.unhex(F.md5(level)).alias("text_key"), "created_at"
    )


def build_chains(log: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """All chains of a log of ``changes``. ``by`` may name a bucket of the entity first, so that one shuffle serves all steps and a write by bucket."""
    picked = log.groupBy(*by, "effective_from").agg(
        F.max(F.struct("created_at", "id", "effective_to", "source_kind", "text_key")).alias("s")
    ).select(*by, "effective_from", "s.id", "s.effective_to", "s.source_kind", "s.text_key")
    if len(by) > 1:
        picked = picked.repartition(by[0])
    w = Window.partitionBy(*by).orderBy(F.col("effective_from").asc_nulls_first())
    own = F.when(F.col("effective_from").isNull() | (F.col("effective_to") > F.col("effective_from")), F.col("effective_to"))
    states = picked.withColumn("valid_to", F.least(F.lead("effective_from").over(w), own))
    adjoins = (
        (F.lag("valid_to").over(w) == F.col("effective_from"))
        & F.lag("source_kind").over(w).eqNullSafe(F.col("source_kind"))
        & (F.lag("text_key").over(w) == F.col("text_key"))
    )
    states = states.withColumn("_v", F.sum(F.when(F.coalesce(adjoins, F.lit(False)), 0).otherwise(1)).over(w))
    # Every period of a version but its last ends where the next begins; the last row holds the version's end.
    last = Window.partitionBy(*by, "_v").orderBy(F.col("effective_from").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    states = states.withColumn("_to", F.last("valid_to").over(last)).withColumn("_n", F.lag("_v").over(w))
    return states.where("_n IS NULL OR _n <> _v").select(*by, F.col("effective_from").alias("valid_from"), F.col("_to").alias("valid_to"), "source_kind", "text_key", "id")


def rebuild_affected(history: DataFrame, log: DataFrame, updates: DataFrame, by: tuple[str, ...] = ("entity",)) -> DataFrame:
    """The history after ``updates``: touched chains are rebuilt from their whole raw changes, all others stay as they are.

    history: chains as from ``build_chains``; log: the raw changes so far, without the updates; updates: late, corrected or new
    changes. Only changes of touched entities are read into the rebuild.
    """
    touched = updates.select("entity").distinct()
    raw = log.join(touched, "entity", "left_semi").unionByName(updates)
    kept = history.join(touched, "entity", "left_anti")
    columns = [*dict.fromkeys([*by, *CHAIN])]
    return kept.select(columns).unionByName(build_chains(raw, by).select(columns))


class HistoryStore:
    """Chains and log of one history under a folder of the shared file system.

    A generation is what one load or update wrote, in folders ``bucket=k``. The manifest of the highest number says which generation holds each bucket's
    chains and which ones make up the log. Manifests appear by renaming a finished file, so a reader sees the old state or the new one; two updates
    at once want the same number, and the second fails. ``vacuum`` removes what no manifest names.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = files_of(spark, self.root)

    def _manifest(self) -> dict:
        names = self.files.names(f"{self.root}/manifests")
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json"))
        return json.loads(self.files.read(f"{self.root}/manifests/{numbers[-1]}.json")) if numbers else {"number": 0, "buckets": 0, "chains": {}, "log": []}

    def _commit(self, manifest: dict) -> None:
        self.files.publish(f"{self.root}/manifests/{manifest['number']}.json", json.dumps(manifest).encode())

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/generations/{name}")
        return name

    def _read(self, name: str, buckets: list[int] | None, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/generations/{name}")
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def _bucketed(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("entity"), F.lit(n)).cast("int"))

    def load(self, log: DataFrame, buckets: int) -> None:
        """The first load: ``log`` are rows of ``changes``."""
        self._types(log)
        if self._manifest()["number"]:
            raise RuntimeError("the history has been loaded before")
        logged = self._write(self._bucketed(log, buckets).repartition("bucket"))
        chains = self._write(build_chains(self._read(logged, None, self.log_schema), ("bucket", "entity")))
        self._commit({"number": 1, "buckets": buckets, "chains": {chains: None}, "log": [logged], "types": self.types})

    def _types(self, log: DataFrame) -> None:
        kinds = dict(log.dtypes)
        self.types = {c: kinds[c] for c in ("entity", "id", "effective_from", "effective_to", "source_kind", "text_key", "created_at")}
        self._schemas()

    def _schemas(self) -> None:
        t = self.types
        self.log_schema = ", ".join(f"{c} {k}" for c, k in t.items()) + ", bucket int"
        self.chain_schema = f"entity {t['entity']}, valid_from {t['effective_from']}, valid_to {t['effective_from']}, source_kind {t['source_kind']}, text_key {t['text_key']}, id {t['id']}, bucket int"

    def apply(self, updates: DataFrame) -> list[int]:
        """Rebuilds the chains that ``updates`` (rows of ``changes``) touch, and returns the buckets replaced."""
        before = self._manifest()
        self.types = before["types"]
        self._schemas()
        logged = self._write(self._bucketed(updates, before["buckets"]).repartition("bucket"))
        fresh = self._read(logged, None, self.log_schema)
        touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())  # no more than there are buckets
        if not touched:
            return []
        log = self._union([self._read(g, touched, self.log_schema) for g in before["log"]])
        chains = self._union([self._read(g, touched if b is None else sorted(set(b) & set(touched)), self.chain_schema) for g, b in before["chains"].items()])
        name = self._write(rebuild_affected(chains, log, fresh, ("bucket", "entity")))
        left = {g: sorted(set(range(before["buckets"]) if b is None else b) - set(touched)) for g, b in before["chains"].items()}
        after = {g: b for g, b in left.items() if b} | {name: touched}
        self._commit(before | {"number": before["number"] + 1, "chains": after, "log": [*before["log"], logged]})
        return touched

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def chains(self) -> DataFrame:
        """The chains as the newest manifest has them."""
        now = self._manifest()
        self.types = now["types"]
        self._schemas()
        return self._union([self._read(g, b, self.chain_schema) for g, b in now["chains"].items()]).select(CHAIN)

    def vacuum(self) -> list[str]:
        """Removes generations that the newest manifest does not name, and older manifests; returns the generations removed."""
        now = self._manifest()
        for n in self.files.names(f"{self.root}/manifests"):
            if n != f"{now['number']}.json":
                self.files.remove(f"{self.root}/manifests/{n}")
        gone = sorted(set(self.files.names(f"{self.root}/generations")) - set(now["chains"]) - set(now["log"]))
        for g in gone:
            self.files.remove(f"{self.root}/generations/{g}")
        return gone


def bucket_count(raw: DataFrame) -> int:
    """Buckets for a history of rows of this size, from the plan's statistics."""
    size = int(str(raw._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(BUCKETS[0], 1 << max(0, size // BUCKET_BYTES).bit_length()), BUCKETS[1])


def full_history(raw: DataFrame, loaded_until: str) -> DataFrame:
    """History of all rows of ``raw``, kept in a store of its own: a first load of what was written before ``loaded_until``, then the rest as an update.

    Rows with unknown created_at belong to the first load. The result does not depend on the day.
    """
    log = changes(raw)
    late = F.coalesce(F.col("created_at") >= F.lit(loaded_until).cast("timestamp"), F.lit(False))
    store = HistoryStore(raw.sparkSession, f"{shared_dir(raw.sparkSession).rstrip('/')}/lexmill/history-{uuid.uuid4().hex}")
    store.load(log.where(~late), bucket_count(raw))
    store.apply(log.where(late))
    store.vacuum()
    return store.chains()
