"""Registered queries of the read API, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import catalogue as C
from lexmill.tables import table

#: Fixed days, so that results do not depend on the clock.
TODAY, AS_ON = "2024-06-30", "2015-01-01"

#: The periods of every provision, as SQL.
HISTORY = r"""
s AS (SELECT provision_id, id, effective_from AS f, effective_to AS t, source_kind AS k, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS x,
        row_number() OVER (PARTITION BY provision_id, effective_from ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST) AS rn
      FROM provision_version WHERE text IS NOT NULL AND provision_id IS NOT NULL),
o AS (SELECT *, lead(f) OVER (PARTITION BY provision_id ORDER BY f NULLS FIRST) AS nx, CASE WHEN f IS NULL OR t > f THEN t END AS own FROM s WHERE rn = 1),
e AS (SELECT *, CASE WHEN nx IS NULL THEN own WHEN own IS NULL OR nx < own THEN nx ELSE own END AS e FROM o),
m AS (SELECT *, CASE WHEN lag(e) OVER w = f AND lag(k) OVER w IS NOT DISTINCT FROM k AND lag(x) OVER w = x THEN 0 ELSE 1 END AS n FROM e WINDOW w AS (PARTITION BY provision_id ORDER BY f NULLS FIRST)),
g AS (SELECT *, sum(n) OVER (PARTITION BY provision_id ORDER BY f NULLS FIRST) AS v FROM m),
hist AS (SELECT DISTINCT provision_id, first_value(f) OVER w AS valid_from, last_value(e) OVER w AS valid_to, first_value(k) OVER w AS source_kind, first_value(id) OVER w AS version_id
         FROM g WINDOW w AS (PARTITION BY provision_id, v ORDER BY f NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
p AS (SELECT DISTINCT * FROM provision),
now AS (SELECT * FROM hist WHERE valid_to IS NULL),
body AS (SELECT DISTINCT id AS version_id, text FROM provision_version)"""
_KEY = "upper(replace(number, ' ', ''))"


def _t(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


def _day(c: str):
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))


def recent_topk_per_group(spark, d):
    document, pv, p, i = _t(spark, d, "document", "provision_version", "provision", "instrument")
    top = C.recent_by_group(document).select("id", "regulator_code", "title", "date_issued", "rn")
    rows = top.join(C.affected(document, pv, p, i), top.id == F.col("document_id"), "left")
    return rows.select("regulator_code", F.col("rn").cast("int").alias("rn"), "id", "title", _day("date_issued").alias("date_issued"), F.coalesce("affects", F.lit("")).alias("affects"))


def list_instruments(spark, d):
    return C.list_instruments(*_t(spark, d, "instrument", "regulator", "provision"))


def list_provisions(spark, d):
    p, pv = _t(spark, d, "provision", "provision_version")
    return C.list_provisions(p, C.versions(pv), AS_ON).select("provision_id", "instrument_id", "number", "version_id", _day("valid_from").alias("valid_from"), "n_versions", "n_machine")


def list_provision_index(spark, d):
    p, pv = _t(spark, d, "provision", "provision_version")
    return C.list_provisions(p, C.versions(pv), None).select("provision_id", "instrument_id", "number", "heading", "level", "n_versions")


def get_provision(spark, d):
    p, pv = _t(spark, d, "provision", "provision_version")
    return C.provision_at(p, C.versions(pv), AS_ON).select("instrument_id", "id", "version_id", _day("valid_from").alias("valid_from"))


def provision_version_dates(spark, d):
    (pv,) = _t(spark, d, "provision_version")
    return C.versions(pv).groupBy("provision_id").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(_day("valid_from")))).alias("days"))


def find_provisions_by_number(spark, d):
    return C.find_by_number(*_t(spark, d, "provision", "instrument", "regulator"), "1.9")


def counts_by_group(spark, d):
    return C.counts_by_regulator(*_t(spark, d, "regulator", "document"), TODAY)


def instrument_overview(spark, d):
    i, p, pv = _t(spark, d, "instrument", "provision", "provision_version")
    return C.instrument_overview(i, p, C.versions(pv), pv)


def instrument_amendments(spark, d):
    document, pv, p, i = _t(spark, d, "document", "provision_version", "provision", "instrument")
    owner = C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id")
    made = pv.where("created_by_document_id IS NOT NULL").join(owner, "provision_id").groupBy("instrument_id", F.col("created_by_document_id").alias("id")).agg(F.min("source_kind").alias("relation"), F.countDistinct("provision_id").alias("provisions"))
    return made.join(document.select("id", "doc_type", "date_issued"), "id").select("instrument_id", "id", "relation", "provisions", "doc_type", _day("date_issued").alias("date_issued"))


def instrument_chapters(spark, d):
    (p,) = _t(spark, d, "provision")
    return C.unique_provisions(p).where("lower(level) = 'chapter'").select("instrument_id", "id", "number", "heading")


def instrument_opening_provisions(spark, d):
    from pyspark.sql import Window

    (p,) = _t(spark, d, "provision")
    w = Window.partitionBy("instrument_id").orderBy(F.col("sort_key").asc_nulls_last(), "id")
    rows = C.unique_provisions(p).where("level IS NULL OR lower(level) <> 'chapter'").withColumn("rn", F.row_number().over(w)).where("rn <= 12")
    return rows.select("instrument_id", F.col("rn").cast("int").alias("rn"), "id", "number")


def instrument_index(spark, d):
    i, p, pv = _t(spark, d, "instrument", "provision", "provision_version")
    owner = C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id")
    n = owner.join(C.as_on(C.versions(pv), None), "provision_id", "left").groupBy("instrument_id").agg(F.count("*").alias("provisions"), F.count("version_id").alias("with_text"))
    return i.select(F.col("id").alias("instrument_id"), "title").join(n, "instrument_id", "left").fillna(0, ["provisions", "with_text"])


def provision_documents(spark, d):
    return C.linked_documents(*_t(spark, d, "document", "provision_version", "provision"))


def provision_history(spark, d):
    pv, document, pdf = _t(spark, d, "provision_version", "document", "pdf_text")
    rows = C.versions(pv).join(pv.select(F.col("id").alias("version_id"), F.col("created_by_document_id").alias("document_id")).dropDuplicates(["version_id"]), "version_id")
    rows = rows.join(document.select(F.col("id").alias("document_id"), "number"), "document_id", "left").join(C.best_file(pdf).select("document_id", "attachment_id"), "document_id", "left")
    return rows.select("provision_id", "version_id", _day("valid_from").alias("valid_from"), _day("valid_to").alias("valid_to"), "document_id", "number", "attachment_id")


def version_pairs(spark, d):
    (pv,) = _t(spark, d, "provision_version")
    return C.history_pairs(C.versions(pv)).withColumn("version_no", F.col("version_no").cast("int"))


def versions_as_on(spark, d):
    (pv,) = _t(spark, d, "provision_version")
    return C.as_on(C.versions(pv), AS_ON).select("provision_id", "version_id", "source_kind")


def current_versions(spark, d):
    (pv,) = _t(spark, d, "provision_version")
    return C.as_on(C.versions(pv, True), None).select("provision_id", "version_id", F.length("text").alias("n_chars"))


def documents_page(spark, d):
    document, pdf, pv, p, i = _t(spark, d, "document", "pdf_text", "provision_version", "provision", "instrument")
    rows = C.page(C.filter_documents(document, words="circular", since="2010-01-01"), 2, 40).select("id", "title", "date_issued", "regulator_code")
    rows = rows.join(C.best_file(pdf), rows.id == F.col("document_id"), "left").drop("document_id").join(C.affected(document, pv, p, i).withColumnRenamed("document_id", "_d"), F.col("id") == F.col("_d"), "left")
    return rows.select("id", "title", _day("date_issued").alias("date_issued"), "regulator_code", "filename", F.coalesce("affects", F.lit("")).alias("affects"))


def best_file_per_document(spark, d):
    return C.best_file(table(spark, d, "pdf_text"))


def get_document(spark, d):
    document, pdf, pv = _t(spark, d, "document", "pdf_text", "provision_version")
    files = pdf.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("files"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    made = pv.groupBy(F.col("created_by_document_id").alias("id")).agg(F.countDistinct("provision_id").alias("provisions"))
    return document.select("id", "title", F.length("extracted_text").alias("n_chars")).join(files, "id", "left").join(made, "id", "left").fillna(0, ["files", "pages", "provisions"])


def home_stats(spark, d):
    document, p, pv, i, r = _t(spark, d, "document", "provision", "provision_version", "instrument", "regulator")
    one = document.agg(F.count("*").alias("documents"), F.count_if("is_amending").alias("amending"), F.count_if(F.col("is_amending").isNull()).alias("untagged"), F.max("date_issued").alias("newest"))
    parts = [p.agg(F.countDistinct("id").alias("provisions")), pv.agg(F.countDistinct("id").alias("states")), i.agg(F.count("*").alias("instruments"), F.count_if("pdf_only").alias("pdf_only")), r.agg(F.count("*").alias("regulators"))]
    for part in parts:  # each of one row
        one = one.crossJoin(part)
    return one.withColumn("newest", _day("newest"))


def _current_with_place(spark, d):
    p, pv = _t(spark, d, "provision", "provision_version")
    return C.as_on(C.versions(pv, True), None).join(C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id", "level", "number"), "provision_id")


def quality_flags(spark, d):
    return C.quality_flags(_current_with_place(spark, d))


def quality_by_flag(spark, d):
    return quality_flags(spark, d).groupBy("flag", "instrument_id").agg(F.count("*").alias("n"))


def last_revised(spark, d):
    """When the listings were last read and when the newest document came, over the whole site."""
    (doc,) = _t(spark, d, "document")
    return doc.agg(F.unix_micros(F.max("last_seen_at")).alias("checked_us"), F.unix_micros(F.max("first_seen_at")).alias("added_us"))


def carry_forward(spark, d):
    return C.chapters_carried(table(spark, d, "provision"))


def neighbours(spark, d):
    return C.neighbours(table(spark, d, "provision")).withColumn("place", F.col("place").cast("int"))


def reading_window(spark, d):
    return C.around(table(spark, d, "provision"), "1.9").withColumn("place", F.col("place").cast("int"))


def numbered_again(spark, d):
    return C.numbered_again(table(spark, d, "provision"))


def natural_number_order(spark, d):
    return C.natural_order(table(spark, d, "provision")).withColumn("place", F.col("place").cast("int"))


def sitemap(spark, d):
    p, i, pv = _t(spark, d, "provision", "instrument", "provision_version")
    return C.sitemap(p, i, C.versions(pv, True))


def suggest(spark, d):
    p, i, document = _t(spark, d, "provision", "instrument", "document")
    return C.suggestions("1", p, i, document)


def map_counts(spark, d):
    """Numbers mapped to a parent's, dropped or new: the status of each pair over a nullable table."""
    (p,) = _t(spark, d, "provision")
    status = F.when(F.col("parent_number").isNull(), "new").when(F.col("parent_id").isNull(), "no counterpart").otherwise("mapped")
    return C.unique_provisions(p).groupBy("instrument_id", status.alias("status")).agg(F.count("*").alias("n"))


def same_document_key(spark, d):
    """Documents known under several addresses: same regulator, date, number and letters of the title; the oldest id stands for all."""
    (doc,) = _t(spark, d, "document")
    key = F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "")
    rows = doc.groupBy("regulator_code", "date_issued", F.coalesce("number", F.lit("")).alias("n"), key.alias("k")).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return rows.select("id", "copies", F.col("n").alias("number"))


def cutoff_filter(spark, d):
    """What is kept of each kind and year: base texts and master directions whatever their age, others from 2014 on."""
    (doc,) = _t(spark, d, "document")
    base = (F.col("doc_type") == "master_direction") | F.col("title").rlike("(?i)regulations|rules") & ~F.col("title").rlike("(?i)amend")
    cut = F.when(F.coalesce(base, F.lit(False)), False).when(F.col("date_issued").isNull(), False).otherwise(F.col("date_issued") < F.lit("2014-01-01").cast("date"))
    return doc.groupBy("doc_type", cut.alias("before_cutoff")).agg(F.count("*").alias("n"))


def null_logic(spark, d):
    (doc,) = _t(spark, d, "document")
    a = F.col("is_amending")
    return doc.groupBy("doc_type").agg(F.count_if(a.eqNullSafe(True)).alias("is_true"), F.count_if(~a.eqNullSafe(True)).alias("is_not_true"), F.count_if(a.eqNullSafe(False)).alias("is_false"), F.count_if(a.isNull()).alias("untagged"))


def definitions(spark, d):
    """Definitions of quoted terms: the term and its verb, per provision."""
    rows = _current_with_place(spark, d).select("provision_id", F.explode(F.regexp_extract_all("text", F.lit("[“\"]([A-Za-z][A-Za-z -]{2,60})[”\"] (?:means|includes)"), 1)).alias("term"))
    return rows.withColumn("term", F.lower("term")).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("provision_id").alias("provisions"))


def search_definitions(spark, d):
    """Provisions that define a term, the quoted form first, with a snippet."""
    term = "deposit"
    quoted = rf"(?i)[“\"][^”\"]*{term}[^”\"]*[”\"][^.;]{{0,90}}(means|includes)"
    rows = _current_with_place(spark, d).where(F.ilike("text", F.lit(f"%{term}%")))
    rows = rows.withColumn("quoted", F.col("text").rlike(quoted)).where("quoted")
    at = F.greatest(F.instr(F.lower("text"), F.lit(term)) - 60, F.lit(1))
    return rows.select("provision_id", F.substring("text", at, F.lit(420)).alias("snippet"))


def compaction_report(spark, d):
    """Attachment texts equal to their document's: rows and bytes that could go."""
    pdf, doc = _t(spark, d, "pdf_text", "document")
    same = pdf.where("text IS NOT NULL").select("document_id", "text").join(doc.where("extracted_text IS NOT NULL").select(F.col("id").alias("document_id"), "extracted_text"), "document_id")
    equal = F.col("text") == F.col("extracted_text")
    return same.agg(F.count_if(equal).alias("rows"), F.coalesce(F.sum(F.when(equal, F.octet_length("text"))), F.lit(0)).cast("long").alias("bytes"), F.count("*").alias("pairs"))


def stale_first(spark, d):
    """Instruments never checked or not for a week, the longest first."""
    (i,) = _t(spark, d, "instrument")
    rows = i.where(F.col("official_updated_as_on").isNull() | (F.col("official_updated_as_on") < F.date_sub(F.lit(TODAY).cast("date"), 7)))
    return rows.orderBy(F.col("official_updated_as_on").asc_nulls_first(), "id").limit(25).select("id", "slug", _day("official_updated_as_on").alias("checked"))


def documents_export(spark, d):
    """Rows of the CSV export, capped at 1,000."""
    doc, pdf = _t(spark, d, "document", "pdf_text")
    rows = C.page(doc, 1, 1000).join(C.best_file(pdf).select(F.col("document_id").alias("_d"), "filename"), F.col("id") == F.col("_d"), "left")
    page = F.coalesce("reader_url", "source_url", F.lit(""))
    return rows.select("id", "regulator_code", "doc_type", "number", "title", _day("date_issued").alias("date_issued"), _day("date_effective").alias("date_effective"), page.alias("official_page"), "filename")


def feed_entries(spark, d):
    """The 60 newest documents as feed entries with stable ids."""
    doc, pv, p, i = _t(spark, d, "document", "provision_version", "provision", "instrument")
    rows = C.page(doc, 1, 60).join(C.affected(doc, pv, p, i), F.col("id") == F.col("document_id"), "left")
    xml = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    href = F.replace(xml(F.coalesce("reader_url", "source_url")), F.lit('"'), F.lit("&quot;"))
    entry = F.concat(
        F.lit("<entry><id>tag:document:"), F.col("id").cast("string"), F.lit("</id><title>"), xml(F.col("title")), F.lit("</title><author><name>"), xml(F.col("regulator_code")), F.lit('</name></author><link href="'), href,
        F.lit('"/><updated>'), _day("date_issued"), F.lit("</updated><summary>"), xml(F.col("affects")), F.lit("</summary></entry>"),
    )
    return rows.select("id", entry.alias("entry"))


def source_links(spark, d):
    """Where a reader is sent: the reader page, else the source, else the regulator's site, else nowhere."""
    doc, r = _t(spark, d, "document", "regulator")
    rows = doc.join(r.select(F.col("code").alias("regulator_code"), "website"), "regulator_code", "left")
    direct = F.when(~F.coalesce(F.col("source_url").rlike(r"(?i)\.(json|xml|pdf)(\?|$)|/api/"), F.lit(False)), F.col("source_url"))
    return rows.select("id", F.coalesce("reader_url", direct, "website", F.lit("")).alias("href"), F.when(F.col("reader_url").isNotNull(), "reader").when(direct.isNotNull(), "source").when(F.col("website").isNotNull(), "listing").otherwise("none").alias("label"))


def _bare(*names: str) -> dict:
    return {n: globals()[n] for n in names}


QUERIES = _bare(
    "recent_topk_per_group", "list_instruments", "list_provisions", "list_provision_index", "get_provision", "provision_version_dates", "find_provisions_by_number", "counts_by_group",
    "instrument_overview", "instrument_amendments", "instrument_chapters", "instrument_opening_provisions", "instrument_index", "provision_documents", "provision_history", "version_pairs", "versions_as_on",
    "current_versions", "documents_page", "best_file_per_document", "get_document", "home_stats", "quality_flags", "quality_by_flag", "last_revised", "carry_forward", "neighbours", "reading_window",
    "numbered_again", "natural_number_order", "sitemap", "suggest", "map_counts", "same_document_key", "cutoff_filter", "null_logic", "definitions", "search_definitions", "compaction_report", "stale_first",
    "documents_export", "feed_entries", "source_links",
)

_AFFECTED = """affected AS (SELECT document_id, string_agg(slug, ', ' ORDER BY slug) AS affects FROM (
  SELECT DISTINCT v.created_by_document_id AS document_id, i.slug FROM provision_version v JOIN (SELECT DISTINCT id, instrument_id FROM provision) q ON q.id = v.provision_id JOIN instrument i ON i.id = q.instrument_id WHERE v.created_by_document_id IS NOT NULL) GROUP BY 1)"""
_BEST = """best AS (SELECT * FROM (SELECT document_id, attachment_id, filename, page_count, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(lower(filename) LIKE '%.pdf', false) DESC,
  coalesce(ocr_used, false), page_count DESC NULLS LAST, attachment_id) AS rn FROM pdf_text WHERE document_id IS NOT NULL) WHERE rn = 1)"""
_D = "coalesce(strftime({0}, '%Y-%m-%d'), '')"
_date = _D.format
_NOCH = "(level IS NULL OR lower(level) <> 'chapter')"
_CURRENT = f"WITH {HISTORY}, cur AS (SELECT now.provision_id, now.version_id, body.text, p.instrument_id, p.level, p.number FROM now JOIN body USING (version_id) JOIN p ON p.id = now.provision_id)"
_FLAGS = _CURRENT + r""", t AS (SELECT *, trim(text) AS t FROM cur WHERE text IS NOT NULL AND (level IS NULL OR lower(level) <> 'chapter')),
k AS (SELECT *, count(*) OVER (PARTITION BY instrument_id, md5(text)) AS c FROM t WHERE NOT regexp_matches(t, '(?i)\[?\s*(deleted|omitted|blank|repealed|reserved|\*{3,})\s*\]?\s*$')),
flags AS (SELECT provision_id, instrument_id, 'table_row' AS flag FROM k WHERE contains(t, '|') AND length(t) < 200
UNION ALL SELECT provision_id, instrument_id, 'heading_only' FROM k WHERE length(t) < 90 AND NOT contains(t, '|') AND NOT regexp_matches(t, '[,;:]')
UNION ALL SELECT provision_id, instrument_id, 'footnote' FROM k WHERE regexp_matches(t, '(?i)^\s*(\d+[A-Za-z]?\.?\s*)?(Ins\.|Inserted by|Subs\.|Substituted by|Omitted by|Vide|Prior to its)([^a-z]|$)')
UNION ALL SELECT provision_id, instrument_id, 'duplicate_text' FROM k WHERE c > 1)"""

SQL = {
    "recent_topk_per_group": f"""WITH {_AFFECTED}, r AS (SELECT *, row_number() OVER (PARTITION BY regulator_code ORDER BY date_issued DESC NULLS LAST, id DESC) AS rn FROM document WHERE regulator_code IS NOT NULL)
      SELECT regulator_code, rn::INT AS rn, id, title, {_date('date_issued')} AS date_issued, coalesce(affects, '') AS affects FROM r LEFT JOIN affected ON document_id = id WHERE rn <= 6""",
    "list_instruments": """SELECT i.id, i.slug, i.short_code, i.title, i.kind, r.code AS regulator, coalesce(n.c, 0) AS provisions, coalesce(n.l, 0) AS levels FROM instrument i JOIN regulator r ON r.id = i.regulator_id
      LEFT JOIN (SELECT instrument_id, count(*) AS c, count(DISTINCT level) AS l FROM (SELECT DISTINCT * FROM provision) GROUP BY 1) n ON n.instrument_id = i.id""",
    "list_provisions": f"""WITH {HISTORY}, c AS (SELECT provision_id, count(*) AS n, count(*) FILTER (WHERE source_kind = 'machine_merged') AS k FROM hist GROUP BY 1),
      a AS (SELECT * FROM hist WHERE (valid_from IS NULL OR valid_from <= DATE '{AS_ON}') AND (valid_to IS NULL OR valid_to > DATE '{AS_ON}'))
      SELECT p.id AS provision_id, instrument_id, number, version_id, {_date('valid_from')} AS valid_from, coalesce(n, 0) AS n_versions, coalesce(k, 0) AS n_machine FROM p LEFT JOIN a ON a.provision_id = p.id LEFT JOIN c ON c.provision_id = p.id""",
    "list_provision_index": f"""WITH {HISTORY}, c AS (SELECT provision_id, count(*) AS n FROM hist GROUP BY 1)
      SELECT p.id AS provision_id, instrument_id, number, heading, level, coalesce(n, 0) AS n_versions FROM p LEFT JOIN now ON now.provision_id = p.id LEFT JOIN c ON c.provision_id = p.id""",
    "get_provision": f"""WITH {HISTORY}, a AS (SELECT * FROM hist WHERE (valid_from IS NULL OR valid_from <= DATE '{AS_ON}') AND (valid_to IS NULL OR valid_to > DATE '{AS_ON}')),
      r AS (SELECT p.*, version_id, valid_from, row_number() OVER (PARTITION BY instrument_id, {_KEY} ORDER BY version_id DESC NULLS LAST, p.id) AS rn FROM p LEFT JOIN a ON a.provision_id = p.id)
      SELECT instrument_id, id, version_id, {_date('valid_from')} AS valid_from FROM r WHERE rn = 1""",
    "provision_version_dates": f"WITH {HISTORY} SELECT provision_id, count(*) AS n, string_agg({_date('valid_from')}, ',' ORDER BY {_date('valid_from')}) AS days FROM hist GROUP BY 1",
    "find_provisions_by_number": f"""SELECT p.id, slug, number, heading, code FROM (SELECT DISTINCT * FROM provision) p JOIN instrument i ON i.id = instrument_id JOIN regulator r ON r.id = regulator_id
      WHERE {_KEY} = '1.9' AND {_NOCH} AND pdf_only IS NOT TRUE ORDER BY code, title, p.id LIMIT 80""",
    "counts_by_group": f"""SELECT r.code, r.name, count(d.id) AS documents, count(*) FILTER (WHERE date_issued BETWEEN DATE '{TODAY}' - 30 AND DATE '{TODAY}') AS last_30_days,
      count(*) FILTER (WHERE date_issued BETWEEN DATE '{TODAY}' - 90 AND DATE '{TODAY}') AS last_90_days, count(*) FILTER (WHERE is_amending IS TRUE) AS amending, {_date('max(date_issued)')} AS newest
      FROM regulator r LEFT JOIN document d ON d.regulator_code = r.code GROUP BY 1, 2""",
    "instrument_overview": f"""WITH {HISTORY}, a AS (SELECT instrument_id, count(*) AS provisions, count(*) FILTER (WHERE lower(level) = 'chapter') AS chapters, count(heading) AS headed, count(pdf_page) AS paged, max(pdf_page) AS last_page,
        count(*) FILTER (WHERE parent_id IS NULL AND parent_number IS NULL) AS tops FROM p GROUP BY 1),
      b AS (SELECT instrument_id, count(*) AS versions, count(*) FILTER (WHERE valid_to IS NULL) AS current, count(*) FILTER (WHERE source_kind = 'machine_merged') AS machine, max(valid_from) AS newest FROM hist JOIN p ON p.id = provision_id GROUP BY 1),
      c AS (SELECT instrument_id, count(DISTINCT created_by_document_id) AS documents FROM provision_version v JOIN p ON p.id = v.provision_id GROUP BY 1)
      SELECT i.id AS instrument_id, slug, coalesce(provisions, 0) AS provisions, coalesce(chapters, 0) AS chapters, coalesce(headed, 0) AS headed, coalesce(paged, 0) AS paged, coalesce(last_page, 0) AS last_page, coalesce(tops, 0) AS tops,
        coalesce(versions, 0) AS versions, coalesce(current, 0) AS current, coalesce(machine, 0) AS machine, coalesce(documents, 0) AS documents, {_date('newest')} AS newest
      FROM instrument i LEFT JOIN a ON a.instrument_id = i.id LEFT JOIN b ON b.instrument_id = i.id LEFT JOIN c ON c.instrument_id = i.id""",
    "instrument_amendments": f"""SELECT instrument_id, d.id, min(source_kind) AS relation, count(DISTINCT provision_id) AS provisions, doc_type, {_date('date_issued')} AS date_issued
      FROM provision_version v JOIN (SELECT DISTINCT id AS pid, instrument_id FROM provision) q ON pid = provision_id JOIN document d ON d.id = created_by_document_id GROUP BY instrument_id, d.id, doc_type, date_issued""",
    "instrument_chapters": "SELECT DISTINCT instrument_id, id, number, heading FROM provision WHERE lower(level) = 'chapter'",
    "instrument_opening_provisions": f"SELECT instrument_id, rn::INT AS rn, id, number FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY sort_key NULLS LAST, id) AS rn FROM (SELECT DISTINCT * FROM provision) WHERE {_NOCH}) WHERE rn <= 12",
    "instrument_index": f"""WITH {HISTORY} SELECT i.id AS instrument_id, i.title, count(p.id) AS provisions, count(version_id) AS with_text FROM instrument i LEFT JOIN p ON p.instrument_id = i.id LEFT JOIN now ON now.provision_id = p.id GROUP BY 1, 2""",
    "provision_documents": f"""WITH p AS (SELECT DISTINCT * FROM provision), u AS (SELECT d.id, v.provision_id, 'made' AS link FROM document d JOIN provision_version v ON v.created_by_document_id = d.id
      UNION ALL SELECT c.id, p.id, 'named' FROM (SELECT id, upper(unnest(regexp_extract_all(title, '(?i)\\b(?:section|rule|regulation|paragraph)\\s+(\\d+[A-Za-z]?)', 1))) AS n FROM document) c JOIN p ON {_KEY} = c.n
        WHERE EXISTS (SELECT 1 FROM provision_version v JOIN p q ON q.id = v.provision_id WHERE v.created_by_document_id = c.id AND q.instrument_id = p.instrument_id))
      SELECT id, provision_id, min(link) AS link FROM u WHERE provision_id IS NOT NULL GROUP BY 1, 2""",
    "provision_history": f"""WITH {HISTORY}, {_BEST}, made AS (SELECT DISTINCT id AS version_id, created_by_document_id AS document_id FROM provision_version)
      SELECT provision_id, version_id, {_date('valid_from')} AS valid_from, {_date('valid_to')} AS valid_to, made.document_id, d.number, attachment_id FROM hist JOIN made USING (version_id) LEFT JOIN document d ON d.id = made.document_id LEFT JOIN best ON best.document_id = made.document_id""",
    "version_pairs": f"""WITH {HISTORY} SELECT provision_id, row_number() OVER w::INT AS version_no, version_id, lag(version_id) OVER w AS before_id, (valid_from - lag(valid_to) OVER w)::INT AS gap_days, source_kind FROM hist
      WINDOW w AS (PARTITION BY provision_id ORDER BY valid_from NULLS FIRST)""".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
    "versions_as_on": f"WITH {HISTORY} SELECT provision_id, version_id, source_kind FROM hist WHERE (valid_from IS NULL OR valid_from <= DATE '{AS_ON}') AND (valid_to IS NULL OR valid_to > DATE '{AS_ON}')",
    "current_versions": f"WITH {HISTORY} SELECT provision_id, version_id, length(text)::INT AS n_chars FROM now JOIN body USING (version_id)",
    "documents_page": f"""WITH {_AFFECTED}, {_BEST} SELECT d.id, title, {_date('date_issued')} AS date_issued, regulator_code, filename, coalesce(affects, '') AS affects FROM
      (SELECT * FROM document WHERE contains(lower(title), 'circular') AND date_issued >= DATE '2010-01-01' ORDER BY date_issued DESC NULLS LAST, id DESC LIMIT 40 OFFSET 40) d LEFT JOIN best ON best.document_id = d.id LEFT JOIN affected a ON a.document_id = d.id""",
    "best_file_per_document": f"WITH {_BEST} SELECT document_id, attachment_id, filename, page_count FROM best",
    "get_document": """SELECT d.id, title, length(extracted_text)::INT AS n_chars, coalesce(f, 0) AS files, coalesce(p, 0)::BIGINT AS pages, coalesce(n, 0) AS provisions FROM document d
      LEFT JOIN (SELECT document_id, count(*) AS f, sum(page_count) AS p FROM pdf_text GROUP BY 1) a ON a.document_id = d.id LEFT JOIN (SELECT created_by_document_id AS c, count(DISTINCT provision_id) AS n FROM provision_version GROUP BY 1) b ON b.c = d.id""",
    "home_stats": f"""SELECT (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM document WHERE is_amending) AS amending, (SELECT count(*) FROM document WHERE is_amending IS NULL) AS untagged, (SELECT {_date('max(date_issued)')} FROM document) AS newest,
      (SELECT count(DISTINCT id) FROM provision) AS provisions, (SELECT count(DISTINCT id) FROM provision_version) AS states, (SELECT count(*) FROM instrument) AS instruments, (SELECT count(*) FROM instrument WHERE pdf_only) AS pdf_only, (SELECT count(*) FROM regulator) AS regulators""",
    "quality_flags": _FLAGS + " SELECT * FROM flags",
    "quality_by_flag": _FLAGS + " SELECT flag, instrument_id, count(*) AS n FROM flags GROUP BY 1, 2",
    "last_revised": "SELECT epoch_us(max(last_seen_at)) AS checked_us, epoch_us(max(first_seen_at)) AS added_us FROM document",
    "carry_forward": """SELECT id, instrument_id, number, last_value(CASE WHEN lower(level) = 'chapter' THEN number END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY sort_key NULLS LAST, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter FROM (SELECT DISTINCT * FROM provision)""",
    "neighbours": f"""SELECT id, instrument_id, lag(id) OVER w AS before_id, lead(id) OVER w AS after_id, (row_number() OVER w)::INT AS place FROM (SELECT DISTINCT * FROM provision) WHERE {_NOCH} WINDOW w AS (PARTITION BY instrument_id ORDER BY sort_key NULLS LAST, id)""",
    "reading_window": f"""WITH n AS (SELECT id, instrument_id, number, row_number() OVER (PARTITION BY instrument_id ORDER BY sort_key NULLS LAST, id) AS place FROM (SELECT DISTINCT * FROM provision) WHERE {_NOCH}),
      a AS (SELECT instrument_id, min(place) AS mid FROM n WHERE {_KEY} = '1.9' GROUP BY 1) SELECT n.instrument_id, id, place::INT AS place FROM n JOIN a USING (instrument_id) WHERE place >= mid - 20 AND place < mid + 40""",
    "numbered_again": r"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, number ORDER BY sort_key NULLS LAST, id) AS n FROM (SELECT DISTINCT * FROM provision))
      SELECT id, instrument_id, CASE WHEN n > 1 THEN number || ' (' || n || ')' ELSE number END AS label FROM c""",
    "natural_number_order": r"""SELECT id, instrument_id, (row_number() OVER (PARTITION BY instrument_id ORDER BY TRY_CAST(nullif(regexp_extract(number, '^\s*(\d{1,9})', 1), '') AS INT) NULLS LAST, upper(regexp_extract(number, '^\s*\d{1,9}\s*([A-Za-z]*)', 1)), id))::INT AS place FROM (SELECT DISTINCT * FROM provision)""",
    "sitemap": f"""WITH {HISTORY}, u AS (SELECT '/browse/' || slug || '/' || url_encode(number) AS path, greatest(valid_from, official_updated_as_on) AS d FROM now JOIN body USING (version_id) JOIN p ON p.id = provision_id JOIN instrument i ON i.id = instrument_id WHERE length(text) > 200
      UNION ALL SELECT '/browse/' || slug, official_updated_as_on FROM instrument) SELECT path, {_date('max(d)')} AS last_modified FROM u GROUP BY 1""".replace("url_encode(number)", "replace(url_encode(number), '%20', '+')"),
    "suggest": """WITH q AS (SELECT DISTINCT p.*, coalesce(i.short_code, '') AS code FROM provision p LEFT JOIN instrument i ON i.id = p.instrument_id),
      a AS (SELECT 1 AS grp, (lower(number) = '1')::INT AS exact, length(number) AS len, number AS text, id FROM q WHERE starts_with(lower(number), '1') ORDER BY exact DESC, len, code, id LIMIT 14),
      b AS (SELECT 2, 0, length(heading) AS len, heading, id FROM q WHERE contains(lower(heading), '1') ORDER BY len, code, id LIMIT 12),
      c AS (SELECT 3, coalesce(lower(short_code) = '1', false)::INT AS exact, length(title) AS len, title, id FROM instrument WHERE contains(lower(title), '1') OR contains(lower(short_code), '1') ORDER BY exact DESC, len, id LIMIT 10),
      e AS (SELECT 4, (lower(number) = '1')::INT AS exact, 0, number, id FROM document WHERE contains(lower(number), '1') ORDER BY exact DESC, date_issued DESC NULLS LAST, id LIMIT 12)
      SELECT grp::INT AS grp, exact::INT AS exact, len::INT AS len, text, id::BIGINT AS id FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e) ORDER BY grp, exact DESC, len, text, id LIMIT 12""",
    "map_counts": "SELECT instrument_id, CASE WHEN parent_number IS NULL THEN 'new' WHEN parent_id IS NULL THEN 'no counterpart' ELSE 'mapped' END AS status, count(*) AS n FROM (SELECT DISTINCT * FROM provision) GROUP BY 1, 2",
    "same_document_key": "SELECT min(id) AS id, count(*) AS copies, coalesce(number, '') AS number FROM document GROUP BY regulator_code, date_issued, coalesce(number, ''), regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')",
    "cutoff_filter": """SELECT doc_type, CASE WHEN coalesce(doc_type = 'master_direction' OR (regexp_matches(title, '(?i)regulations|rules') AND NOT regexp_matches(title, '(?i)amend')), false) THEN false WHEN date_issued IS NULL THEN false ELSE date_issued < DATE '2014-01-01' END AS before_cutoff, count(*) AS n FROM document GROUP BY 1, 2""",
    "null_logic": "SELECT doc_type, count(*) FILTER (WHERE is_amending IS TRUE) AS is_true, count(*) FILTER (WHERE is_amending IS NOT TRUE) AS is_not_true, count(*) FILTER (WHERE is_amending IS FALSE) AS is_false, count(*) FILTER (WHERE is_amending IS NULL) AS untagged FROM document GROUP BY 1",
    "definitions": _CURRENT + r""", t AS (SELECT provision_id, lower(unnest(regexp_extract_all(text, '[“"]([A-Za-z][A-Za-z -]{2,60})[”"] (?:means|includes)', 1))) AS term FROM cur) SELECT term, count(*) AS n, count(DISTINCT provision_id) AS provisions FROM t GROUP BY 1""",
    "search_definitions": _CURRENT + r""" SELECT provision_id, substring(text, greatest(instr(lower(text), 'deposit') - 60, 1), 420) AS snippet FROM cur WHERE text ILIKE '%deposit%' AND regexp_matches(text, '(?i)[“"][^”"]*deposit[^”"]*[”"][^.;]{0,90}(means|includes)')""",
    "compaction_report": "SELECT count(*) FILTER (WHERE text = extracted_text) AS rows, coalesce(sum(strlen(text)) FILTER (WHERE text = extracted_text), 0)::BIGINT AS bytes, count(*) AS pairs FROM pdf_text JOIN document ON document.id = document_id WHERE text IS NOT NULL AND extracted_text IS NOT NULL",
    "stale_first": f"SELECT id, slug, {_date('official_updated_as_on')} AS checked FROM instrument WHERE official_updated_as_on IS NULL OR official_updated_as_on < DATE '{TODAY}' - 7 ORDER BY official_updated_as_on NULLS FIRST, id LIMIT 25",
    "documents_export": f"""WITH {_BEST} SELECT id, regulator_code, doc_type, number, title, {_date('date_issued')} AS date_issued, {_date('date_effective')} AS date_effective, coalesce(reader_url, source_url, '') AS official_page, filename FROM
      (SELECT * FROM document ORDER BY document.date_issued DESC NULLS LAST, id DESC LIMIT 1000) LEFT JOIN best ON document_id = id""",
    "feed_entries": f"""WITH {_AFFECTED} SELECT id, '<entry><id>tag:document:' || id || '</id><title>' || replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title><author><name>' || replace(replace(replace(coalesce(regulator_code, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name></author><link href="' ||
      replace(replace(replace(replace(coalesce(coalesce(reader_url, source_url), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '"/><updated>' || {_date('date_issued')} || '</updated><summary>' || replace(replace(replace(coalesce(affects, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</summary></entry>' AS entry FROM
      (SELECT * FROM document ORDER BY date_issued DESC NULLS LAST, id DESC LIMIT 60) LEFT JOIN affected ON document_id = id""",
    "source_links": r"""WITH j AS (SELECT d.id, reader_url, website, CASE WHEN NOT coalesce(regexp_matches(source_url, '(?i)\.(json|xml|pdf)(\?|$)|/api/'), false) THEN source_url END AS direct FROM document d LEFT JOIN regulator r ON r.code = d.regulator_code)
      SELECT id, coalesce(reader_url, direct, website, '') AS href, CASE WHEN reader_url IS NOT NULL THEN 'reader' WHEN direct IS NOT NULL THEN 'source' WHEN website IS NOT NULL THEN 'listing' ELSE 'none' END AS label FROM j""",
}
