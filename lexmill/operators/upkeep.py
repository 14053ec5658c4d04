"""Maintenance of the catalogue's tables as rows before and after, and look-ups whose keys are not plain columns.

Every function returns the rows that a write would put in place or the action each row gets; a caller replaces the table or applies the actions. Matches
on one of several keys are equi joins in turn, never one join with OR.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.catalogue import number_key, unique_provisions


def letters(c: str) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def upsert_documents(held: DataFrame, found: DataFrame) -> DataFrame:
    """(source_url, action, id): what each found document does: ``seen`` at its address, ``same`` as a held one under another address, or ``insert``.

    Documents are the same if regulator, date, number (none is a value) and the letters and digits of their titles agree; of several held ones the oldest id
    counts. Without a title nothing but the address tells.
    """
    key = ["regulator_code", "date_issued", "_number", "_title"]
    keyed = lambda d: d.withColumn("_number", F.coalesce("number", F.lit(""))).withColumn("_title", letters("title"))
    by_url = held.where("source_url IS NOT NULL").groupBy("source_url").agg(F.min("id").alias("by_url"))
    by_key = keyed(held).where("_title <> ''").groupBy(*key).agg(F.min("id").alias("by_key"))
    rows = keyed(found).select("source_url", *key).distinct().join(by_url, "source_url", "left")
    left, right = rows.alias("f"), by_key.alias("h")
    rows = left.join(right, [F.col(f"f.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key], "left").select("f.source_url", "by_url", "by_key")
    action = F.when(F.col("by_url").isNotNull(), "seen").when(F.col("by_key").isNotNull(), "same").otherwise("insert")
    return rows.select("source_url", action.alias("action"), F.coalesce("by_url", "by_key").alias("id")).distinct()


def insert_new(held: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows whose key is not held, each key once; nulls in a key are one value."""
    h, n = held.select(*key).distinct().alias("h"), incoming.dropDuplicates(key).alias("n")
    return n.join(h, [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in key], "left_anti")


def increment(held: DataFrame, incoming: DataFrame, key: list[str], n: str) -> DataFrame:
    """Counts of both by key."""
    return held.select(*key, n).unionByName(incoming.select(*key, n)).groupBy(*key).agg(F.sum(n).alias(n))


def touch(held: DataFrame, visits: DataFrame, key: str, at: str, minutes: int = 30) -> DataFrame:
    """(key, at) after visits (key, at): a time is moved on only if the newest visit is more than ``minutes`` later, so most visits write nothing."""
    newest = visits.groupBy(key).agg(F.max(at).alias("_new"))
    moved = F.col(at).isNull() | (F.col("_new") > F.col(at) + F.expr(f"INTERVAL {minutes} MINUTES"))
    return held.join(newest, key, "full_outer").select(key, F.when(moved & F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col(at)).alias(at))


def compacted(pdf_text: DataFrame, document: DataFrame) -> DataFrame:
    """Attachments with the text left out where the document has the same; found by length and hash, so no text is shuffled."""
    sums = document.where("extracted_text IS NOT NULL").select(F.col("id").alias("document_id"), F.length("extracted_text").alias("_n"), F.sha2("extracted_text", 256).alias("_h"), F.lit(True).alias("_same"))
    rows = pdf_text.withColumn("_n", F.length("text")).withColumn("_h", F.sha2("text", 256)).join(sums, ["document_id", "_n", "_h"], "left")
    return rows.withColumn("text", F.when(F.col("_same"), F.lit(None)).otherwise(F.col("text"))).drop("_n", "_h", "_same")


def closed_runs(runs: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Runs (.., started_at, finished_at, ok, error): one that has not ended for ``hours`` is closed as failed."""
    stale = F.col("finished_at").isNull() & (F.col("started_at") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumns({"ok": F.when(stale, F.lit(False)).otherwise(F.col("ok")), "error": F.when(stale, F.lit("no end recorded")).otherwise(F.col("error")), "finished_at": F.when(stale, now).otherwise(F.col("finished_at"))})


def pressure(usage: DataFrame) -> DataFrame:
    """One row: the greatest share of a budget that is used, of usages that can be freed; 0 without any."""
    return usage.agg(F.coalesce(F.max(F.when(F.col("deletable"), F.col("used") / F.col("budget"))), F.lit(0.0)).alias("pressure"))


def numbered(wanted: DataFrame, provision: DataFrame) -> DataFrame:
    """(document_id, instrument_id, number, provision_id) of wanted rows (document_id, instrument_id, number): the provision of that number, or of it with a part or count
    in brackets, or with hyphens left out; of several the first in reading order."""
    p = unique_provisions(provision).where("number IS NOT NULL").select("instrument_id", F.col("id").alias("provision_id"), "sort_key", number_key("number").alias("n"))
    forms = F.array_distinct(F.array("n", F.regexp_extract("n", r"^(.*?)\(.*$", 1), F.replace("n", F.lit("-"), F.lit(""))))
    by = p.select("instrument_id", "provision_id", "sort_key", F.explode(forms).alias("key")).where("key <> ''")
    rows = wanted.withColumn("key", number_key("number")).join(by, ["instrument_id", "key"])
    w = Window.partitionBy("document_id", "instrument_id", "number").orderBy(F.col("sort_key").asc_nulls_last(), "provision_id")
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("document_id", "instrument_id", "number", "provision_id")


#: Titles that one automaton holds; more are searched in turns.
AUTOMATON = 100_000


def _hold(batches: Iterator[pa.RecordBatch], phrases: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    automaton = ahocorasick.Automaton()
    ids: dict[str, list[int]] = {}
    for i, phrase in phrases:
        ids.setdefault(phrase, []).append(i)
    for phrase, who in ids.items():
        automaton.add_word(phrase, who)
    automaton.make_automaton()
    for batch in batches:
        docs, found = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hits = {i for _, who in automaton.iter(text.lower()) for i in who} if ids else set()
            docs += [doc] * len(hits)
            found += sorted(hits)
        yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["id", "phrase_id"])


def holding(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase_id) of rows (id, text) and phrases (phrase_id, phrase): which texts hold which phrase, case aside, by one pass of an automaton and no join.

    Phrases are titles of a curated catalogue; they are brought to the workers ``AUTOMATON`` at a time.
    """
    rows = sorted((r["phrase_id"], r["phrase"].lower()) for r in phrases.where("phrase <> ''").select("phrase_id", "phrase").toLocalIterator())
    source = texts.where("text IS NOT NULL").select(F.col("id").cast("long"), "text")
    parts = [source.mapInArrow(partial(_hold, phrases=rows[k : k + AUTOMATON]), "id bigint, phrase_id bigint") for k in range(0, max(1, len(rows)), AUTOMATON)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def csv_line(*columns: str) -> Column:
    """Fields joined by commas; one is quoted if it holds a quote, comma or line end."""
    quoted = lambda c: F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *(quoted(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns))


def claimed(rows: DataFrame, slug: str, order: list[Column]) -> DataFrame:
    """The first row of each slug."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(slug).orderBy(*order))).where("_rn = 1").drop("_rn")


def slugify(c: str, size: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def matched_titles(named: DataFrame, instrument: DataFrame) -> DataFrame:
    """(name, instrument_id) of rows (name): the instrument of the same letters and digits, else, for what is left, of the same without a closing year."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    bare = lambda c: F.regexp_replace(c, r" (?:1[89]|20)\d\d$", "")
    held = instrument.select(F.col("id").alias("instrument_id"), key("title").alias("k"))
    exact = held.groupBy("k").agg(F.min("instrument_id").alias("instrument_id"))
    loose = held.groupBy(bare("k").alias("k")).agg(F.min("instrument_id").alias("loose_id"))
    rows = named.select("name").distinct().withColumn("k", key("name")).join(exact, "k", "left")
    return rows.withColumn("k", bare("k")).join(loose, "k", "left").select("name", F.coalesce("instrument_id", "loose_id").alias("instrument_id")).where("instrument_id IS NOT NULL")
