"""Registered queries that read texts: search, provisions, differences, citations, tags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import search as S
from lexmill.operators import catalogue as C
from lexmill.operators import documents as D
from lexmill.operators import reading as R
from lexmill.session import maintained
from lexmill.tables import table


def _texts(spark, d):
    return table(spark, d, "document").where("extracted_text IS NOT NULL").select("id", F.col("extracted_text").alias("text"))


def _by_lexeme(index):
    return index.repartitionByRange("lexeme").sortWithinPartitions("lexeme", "doc")


def _document_index(spark, d):
    """Postings of titles and texts of documents, kept sorted by lexeme: a search reads the row groups of its lexemes only."""
    doc = table(spark, d, "document")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "extracted_text")
    build = lambda rows: _by_lexeme(S.postings(rows.select(F.col("id").alias("doc"), text.alias("text"))))
    held = maintained(doc, "document-postings", build)
    return build(doc) if held is None else held


def _provision_index(spark, d):
    """Postings of the texts in force."""
    pv = table(spark, d, "provision_version")
    build = lambda rows: _by_lexeme(S.postings(C.as_on(C.versions(rows, True), None).select(F.col("provision_id").alias("doc"), "text")))
    held = maintained(pv, "provision-postings", build)
    return build(pv) if held is None else held


def _page_index(spark, d):
    """Postings of pages; the doc is the attachment's id times 100,000 and the page's number."""
    pdf = table(spark, d, "pdf_text")
    build = lambda rows: _by_lexeme(S.postings(R.pages(rows).select((F.col("attachment_id") * 100_000 + F.col("page_no")).alias("doc"), "text")))
    held = maintained(pdf, "page-postings", build)
    return build(pdf) if held is None else held


def fts_postings(spark, d):
    """How many documents hold each lexeme, and how often."""
    return _document_index(spark, d).groupBy("lexeme").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("occurrences"))


QUERY, NUMBER, LIMIT = 'registered "competent authority" or settlement -exempt', "12", 50


def fts_search(spark, d):
    """Documents by number first, then by rank; a document comes once."""
    return D.found_documents(table(spark, d, "document"), S.search(_document_index(spark, d), QUERY), NUMBER).select("id", "tier", "rank")


def search_all(spark, d):
    """The whole search: the best provisions in force, of instruments that are not served as files alone, and the documents, each with its place."""
    p, i, doc = table(spark, d, "provision"), table(spark, d, "instrument"), table(spark, d, "document")
    first = D.found_provisions(p, i, S.search(_provision_index(spark, d), QUERY), LIMIT)
    second = D.found_documents(doc, S.search(_document_index(spark, d), QUERY), NUMBER, LIMIT)
    columns = ["kind", "place", "id", "rank"]
    return first.withColumn("kind", F.lit("provision")).select(columns).unionByName(second.withColumn("kind", F.lit("document")).select(columns))


def search_within(spark, d):
    """The search inside each instrument: its provisions, the ten best."""
    p, i = table(spark, d, "provision"), table(spark, d, "instrument")
    return D.found_provisions(p, i, S.search(_provision_index(spark, d), QUERY), 10, by="instrument_id").select("instrument_id", "place", "id", "rank")


def fts_pages(spark, d):
    """The twelve best pages: by rank, then title, then page."""
    hits = S.search(_page_index(spark, d), "registered authority")
    rows = hits.select(F.floor(F.col("doc") / 100_000).alias("attachment_id"), (F.col("doc") % 100_000).cast("int").alias("page_no"), "rank")
    pdf, doc = table(spark, d, "pdf_text").select("attachment_id", "document_id"), table(spark, d, "document").select(F.col("id").alias("document_id"), "title")
    rows = rows.join(pdf, "attachment_id").join(doc, "document_id", "left")
    return rows.orderBy(F.col("rank").desc(), "title", "page_no", "attachment_id").limit(12).select("attachment_id", "page_no", "rank")


def page_map(spark, d):
    rows = table(spark, d, "pdf_text").where("text IS NOT NULL").select(F.col("attachment_id").alias("id"), F.lit("auto").alias("style"), "text")
    return D.page_map(rows)


def headline(spark, d):
    """The best stretch of the 50 first hits."""
    query = "registered authority"
    texts = _texts(spark, d)
    top = S.search(_document_index(spark, d), query).orderBy(F.col("rank").desc(), "doc").limit(50)
    shown = texts.join(top.select(F.col("doc").alias("id")), "id", "left_semi")
    mark = F.udf(lambda t: S.headline(t, query), "string", useArrow=True)
    return shown.select("id", mark("text").alias("headline"))


def provisions(spark, d):
    rows = table(spark, d, "document").where("extracted_text IS NOT NULL")
    style = F.when(F.col("doc_type") == "master_direction", "master_direction").when(F.col("regulator_code") == "SEBI", "sebi").otherwise("auto")
    out = D.provisions(rows.select("id", style.alias("style"), F.col("extracted_text").alias("text")))
    return out.select("id", "place", "number", "level", "parent_number", "chapter", F.length("text").alias("n_chars"), F.size("footnotes").alias("n_footnotes"))


def rule_tags(spark, d):
    rows = table(spark, d, "document").select("id", "title", "doc_type", F.col("extracted_text").alias("text"))
    return D.tags(rows).select("id", "is_amending", "relation", F.size("effects").alias("n_effects"))


def crossref_links(spark, d):
    return D.cited(_texts(spark, d)).groupBy("kind", "number").agg(F.count("*").alias("n"), F.countDistinct("id").alias("documents"))


def _pairs(spark, d):
    chains = C.versions(table(spark, d, "provision_version"), True)
    w = Window.partitionBy("provision_id").orderBy(F.col("valid_from").asc_nulls_first())
    return chains.select(F.col("version_id").alias("id"), F.lag("text").over(w).alias("before"), F.col("text").alias("after")).where("before IS NOT NULL")


def diff_words(spark, d):
    return D.differences(_pairs(spark, d)).groupBy("id").agg(F.count_if(F.col("kind") == "del").alias("deletions"), F.count_if(F.col("kind") == "ins").alias("insertions"), F.count("*").alias("runs"))


def version_similarity(spark, d):
    return D.similarities(_pairs(spark, d))


QUERIES = {f.__name__: f for f in (fts_postings, fts_search, search_all, search_within, fts_pages, page_map, headline, provisions, rule_tags, crossref_links, diff_words, version_similarity)}
