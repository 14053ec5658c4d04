"""Look-ups, page search, merge previews and maintenance over the catalogue's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.catalogue import number_key, unique_provisions

PAGE = 2000


def pages(pdf_text: DataFrame, size: int = PAGE) -> DataFrame:
    """(attachment_id, document_id, page_no, text): texts in pages of a fixed size."""
    rows = pdf_text.where("length(text) > 0").select("attachment_id", "document_id", "text")
    rows = rows.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.ceil(F.length("text") / size).cast("int"))))
    return rows.withColumn("text", F.substring("text", (F.col("page_no") - 1) * size + 1, F.lit(size)))


def search_pages(pages_: DataFrame, words: list[str], number: str | None) -> DataFrame:
    """Pages with all words, or with a heading of the number: rank 0.9 for a page that opens with it, 0.25 for one that has it."""
    text = F.lower("text")
    hits = sum((F.contains(text, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    heading = F.col("text").rlike(rf"(?:^|[^0-9A-Za-z]){number}\.([^0-9]|$)") if number else F.lit(False)
    opens = F.substring("text", 1, 200).rlike(rf"(?:^|[^0-9A-Za-z]){number}\.([^0-9]|$)") if number else F.lit(False)
    rank = F.when(hits == len(words), F.lit(1.0)).otherwise(F.lit(0.0)) + F.when(opens, 0.9).when(heading, 0.25).otherwise(0.0)
    return pages_.withColumn("opens", opens).withColumn("rank", rank).where("rank > 0")


def find_instruments(instrument: DataFrame, provision: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """Instruments whose slug, code or title has the words: all of them 10 a word and 5 if it has provisions, else one a word."""
    hay = F.lower(F.concat_ws(" ", "slug", "short_code", "title"))
    hits = sum((F.contains(hay, F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    held = provision.select(F.col("instrument_id").alias("id")).distinct().withColumn("_held", F.lit(5))
    rows = instrument.withColumn("hits", hits).where("hits > 0").join(held, "id", "left")
    score = F.when(F.col("hits") == len(words), F.col("hits") * 10 + F.coalesce("_held", F.lit(0))).otherwise(F.col("hits"))
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(limit)


def resolve_lookup(instrument: DataFrame, provision: DataFrame, words: list[str], kind: str | None) -> DataFrame:
    """Scored instruments and whether one of them is decisive: the only one, or strictly best with a score above 0.

    A word in slug, code or title gives 4, the whole phrase 10 and a tenth of its length, the kind 1.
    """
    hay = F.lower(F.concat_ws(" ", "slug", "short_code", "title"))
    phrase = " ".join(words).lower()
    score = sum((F.when(F.contains(hay, F.lit(w.lower())), 4.0).otherwise(0.0) for w in words), F.lit(0.0))
    score = score + F.when(F.contains(hay, F.lit(phrase)), 10.0 + len(phrase) / 10).otherwise(0.0) + F.when(F.col("kind") == kind, 1.0).otherwise(0.0)
    size = unique_provisions(provision).groupBy(F.col("instrument_id").alias("id")).agg(F.count("*").alias("size"))
    rows = instrument.withColumn("score", score).where("score > 0").join(size, "id", "left").fillna(0, ["size"])
    top = rows.orderBy(F.col("score").desc(), F.col("size").desc(), "id").limit(10)
    second = F.lead("score").over(Window.orderBy(F.col("score").desc(), F.col("size").desc(), "id"))
    first = F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("size").desc(), "id")) == 1
    return top.withColumn("decisive", first & (second.isNull() | (F.col("score") > second)))


_SUBSTITUTION = r"(?i)In (?:section|rule|regulation|paragraph) (\d+[A-Z]?)[^“]{0,40}for the words “([^”]+)”, the words “([^”]+)” shall be substituted"


def mechanical_merges(document: DataFrame, provision: DataFrame, current: DataFrame, links: DataFrame) -> DataFrame:
    """Quoted substitutions of documents against current texts of the provisions they may mean: applicable if the old words occur exactly once.

    links: (document_id, instrument_id); current: (provision_id, text).
    """
    found = document.where("extracted_text IS NOT NULL").select(
        F.col("id").alias("document_id"),
        F.explode(F.arrays_zip(*(F.regexp_extract_all("extracted_text", F.lit(_SUBSTITUTION), i).alias(n) for i, n in ((1, "number"), (2, "old"), (3, "new"))))).alias("s"),
    ).select("document_id", "s.*").distinct()
    target = unique_provisions(provision).select("instrument_id", F.col("id").alias("provision_id"), number_key("number").alias("number"))
    scoped = found.withColumn("number", F.upper("number")).join(links, "document_id", "left").join(target, ["instrument_id", "number"], "left").join(current, "provision_id", "left")
    times = (F.length("text") - F.length(F.replace("text", F.col("old")))) / F.length("old")
    state = F.when(F.col("provision_id").isNull(), "no_provision").when(F.col("text").isNull(), "no_text").when(times == 0, "not_found").when(times == 1, "applicable").otherwise("ambiguous")
    return scoped.withColumn("state", state)


def full_texts(document: DataFrame, pdf_text: DataFrame) -> DataFrame:
    """(id, n_parts, n_chars): body and those attachment texts that are neither empty, repeated nor part of the body."""
    body = document.select("id", F.coalesce("extracted_text", F.lit("")).alias("body"))
    parts = pdf_text.where("length(text) > 0").select(F.col("document_id").alias("id"), "text").distinct().join(body, "id").where(~F.contains("body", F.col("text")))
    sums = parts.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("text") + 2).alias("chars"))
    rows = body.join(sums, "id", "left")
    return rows.select("id", ((F.col("body") != "").cast("long") + F.coalesce("n", F.lit(0))).alias("n_parts"), (F.length("body") + F.coalesce("chars", F.lit(0))).cast("long").alias("n_chars"))


def quality_gate(current: DataFrame, share: float = 0.25, short: int = 40, least: int = 3) -> DataFrame:
    """(instrument_id, n, short, action) of current texts without chapters: serve the PDF if more than a quarter is short, fail if too few."""
    rows = current.where("level IS NULL OR lower(level) <> 'chapter'").groupBy("instrument_id").agg(F.count("*").alias("n"), F.count_if(F.length("text") < short).alias("short"))
    return rows.withColumn("action", F.when(F.col("n") < least, "too_few").when(F.col("short") > F.col("n") * share, "serve_pdf").otherwise("serve_text"))


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """A cascading delete: rows whose key is not among those gone."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def enqueue(queue: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Wanted jobs that are not queued or running yet, each once."""
    open_ = queue.where(F.col("state").isin("queued", "running", "rescued")).select(key).distinct()
    return wanted.join(open_, key, "left_anti").dropDuplicates([key])


def route(path: str) -> Column:
    """The kind of page an address is."""
    p = F.col(path)
    patterns = (("pdf", r"(?i)\.pdf(\?|$)"), ("circular", r"(?i)/circulars?(/|$)"), ("notification", r"(?i)/notifications?(/|$)"), ("order", r"(?i)/orders?(/|$)"), ("query", r"\?"))
    out = F.when(p.isNull(), F.lit("none"))
    for name, pattern in patterns:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("page")


def number_filter(typed: str, number: str, heading: str) -> tuple[Column, Column]:
    """(matches, order) of a fuzzy section filter: digits match numbers alone, other text numbers or headings; the exact number first, then the shortest."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s.()\-]", ""))
    t = bare(F.lit(typed))
    in_number = F.contains(bare(F.col(number)), t)
    matches = in_number if typed.strip()[:1].isdigit() else in_number | F.contains(F.lower(heading), F.lower(F.lit(typed)))
    return matches, F.struct((bare(F.col(number)) != t).alias("other"), F.length(number).alias("len"))
