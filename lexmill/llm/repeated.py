"""Lines that a source repeats in its documents, by PrefixSpan over line identifiers, and their removal.

A line's identifier is a hash of its letters and marks after lower-casing. Level one of PrefixSpan counts, within a source, the
documents that hold each identifier, and projects every document on its frequent lines; level k extends each frequent sequence by a frequent
line that follows it in its documents (the projected database is where its matches end) and counts documents again. A sequence is frequent
with enough distinct documents. Two forms are mined:

* runs, sequences of lines that follow each other in the projected documents: a notice of k lines has k * (k + 1) / 2 of them, and level k + 1
  joins the matches of level k with themselves one line on, so only extensions whose both parts are frequent are counted. ``repeated_lines`` deletes what
  the matches of all levels cover. A part of a frequent sequence is frequent, so longer runs cover no line that the single ones do not;
* all sequences, whatever stands between their lines, for ``frequent_sequences``: a notice of k lines has 2 ** k - 1 of these.

Counting explodes the distinct identifiers of a document and aggregates partially, so a source or line with a third of all
rows is summed on the map side. Only ids, positions and hashes are shuffled, texts never are.

Defined results: documents with null text or null source are left out of all counts; an empty text is a document without countable
lines; lines with fewer than ``min_chars`` letters and marks never count; a document that repeats a line counts once, and each of its
occurrences is reported; a repeated row counts as a document of its own but gives no row twice; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import materialise, materialise_counted

MIN_CHARS, MIN_DOCS, MIN_SHARE = 12, 5, (1, 20)


def line_ids(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(document_id, source, keys) of rows (document_id, source, text): the identifier of each line, null for one that never counts."""
    letters = lambda line: F.regexp_replace(F.lower(line), r"[^\p{L}\p{M}]+", "")
    keys = F.transform(F.transform(F.split("text", "\n"), letters), lambda k: F.when(F.length(k) >= min_chars, F.xxhash64(k)))
    return documents.where("text IS NOT NULL AND source IS NOT NULL").select("document_id", "source", keys.alias("keys"))


def _supported(counts: DataFrame, documents: DataFrame, min_docs: int, min_share: tuple[int, int]) -> DataFrame:
    """Those of (source, ..., n_docs) with enough documents, absolutely and as a share of the source's."""
    totals = documents.groupBy("source").agg(F.count("*").alias("total"))
    enough = (F.col("n_docs") >= min_docs) & (F.col("n_docs") * min_share[1] >= F.col("total") * min_share[0])
    return counts.join(totals, "source").where(enough)


def frequent_lines(ids: DataFrame, min_docs: int = MIN_DOCS, min_share: tuple[int, int] = MIN_SHARE) -> DataFrame:
    """(source, key, n_docs, total): the sequences of length one."""
    each = ids.select("source", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
    return _supported(each.groupBy("source", "key").agg(F.count("*").alias("n_docs")), ids, min_docs, min_share)


def occurrences(ids: DataFrame, frequent: DataFrame) -> DataFrame:
    """(document_id, source, line_no, key) of every frequent line; lines are counted from 1."""
    lines = ids.select("document_id", "source", F.posexplode("keys").alias("_n", "key")).where("key IS NOT NULL")
    found = lines.join(frequent.select("source", "key"), ["source", "key"])
    return found.select("document_id", "source", (F.col("_n") + 1).cast("long").alias("line_no"), "key").distinct()


def frequent_runs(ids: DataFrame, min_docs: int = MIN_DOCS, min_share: tuple[int, int] = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """(runs (source, sequence, n_docs, total), matches (document_id, source, at, keys, lines)) of all lengths.

    ``at`` counts the frequent lines of a document; a run of the lines at .. at + k - 1 has k keys and k line numbers.
    """
    single = frequent_lines(ids, min_docs, min_share)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("line_no"))  # as many rows as a text has lines
    level = occurrences(ids, single).select("document_id", "source", place.alias("at"), F.array("key").alias("keys"), F.array("line_no").alias("lines"))
    level = materialise(level)
    runs = single.select("source", F.array("key").alias("sequence"), "n_docs", "total")
    matches = level
    while True:
        ahead = level.select("document_id", (F.col("at") - 1).alias("at"), F.element_at("keys", -1).alias("_key"), F.element_at("lines", -1).alias("_line"))
        longer = level.join(ahead, ["document_id", "at"]).select("document_id", "source", "at", F.concat("keys", F.array("_key")).alias("keys"), F.concat("lines", F.array("_line")).alias("lines"))
        longer = materialise(longer)
        counts = longer.select("document_id", "source", F.col("keys").alias("sequence")).distinct().groupBy("source", "sequence").agg(F.count("*").alias("n_docs"))
        found, n = materialise_counted(_supported(counts, ids, min_docs, min_share).select("source", "sequence", "n_docs", "total"), n=F.count(F.lit(1)))
        if not n["n"]:
            return runs, matches
        runs = runs.unionByName(found)
        level = materialise(longer.join(found.select("source", F.col("sequence").alias("keys")), ["source", "keys"], "left_semi"))
        matches = matches.unionByName(level.select(*matches.columns))


def repeated_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, min_share: tuple[int, int] = MIN_SHARE) -> DataFrame:
    """(document_id, source, line_no) of the lines to delete from rows (document_id, source, text) of unique document_id: all that frequent runs cover."""
    _, matches = frequent_runs(materialise(line_ids(documents, min_chars)), min_docs, min_share)
    return matches.select("document_id", "source", F.explode("lines").alias("line_no")).distinct()


def frequent_sequences(documents: DataFrame, max_length: int | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, min_share: tuple[int, int] = MIN_SHARE) -> DataFrame:
    """(source, sequence, n_docs, total): all frequent sequences, or those of up to ``max_length`` lines.

    A level without frequent sequences is the last. From the third line on only pairs of last and next line that are frequent themselves are tried.
    """
    ids = materialise(line_ids(documents, min_chars))
    level = frequent_lines(ids, min_docs, min_share).withColumn("sequence", F.array("key"))
    found = level.select("source", "sequence", "n_docs", "total")
    places = materialise(occurrences(ids, level))
    front = places.groupBy("document_id", "source", F.array("key").alias("sequence")).agg(F.min("line_no").alias("end"))
    length, pairs = 1, None
    while max_length is None or length < max_length:
        longer = front.join(places.select("document_id", "line_no", "key"), "document_id").where("line_no > end")
        if pairs is not None:
            longer = longer.withColumn("last", F.element_at("sequence", -1)).join(pairs, ["source", "last", "key"], "left_semi")
        longer = longer.groupBy("document_id", "source", F.concat("sequence", F.array("key")).alias("sequence")).agg(F.min("line_no").alias("end"))
        longer = materialise(longer)
        level, n = materialise_counted(_supported(longer.groupBy("source", "sequence").agg(F.count("*").alias("n_docs")), ids, min_docs, min_share), n=F.count(F.lit(1)))
        if not n["n"]:
            break
        length += 1
        if pairs is None:
            pairs = level.select("source", F.element_at("sequence", 1).alias("last"), F.element_at("sequence", 2).alias("key"))
        found = found.unionByName(level.select("source", "sequence", "n_docs", "total"))
        front = longer.join(level.select("source", "sequence"), ["source", "sequence"], "left_semi")
    return found


def without_lines(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``documents`` with the found lines cut out of text; other rows and columns stay as they are."""
    name = "_cut"
    while name in documents.columns:
        name += "_"
    cut = found.groupBy("document_id").agg(F.collect_set("line_no").alias(name))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(name, (i + 1).cast("long")))
    return documents.join(cut, "document_id", "left").withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop(name)
