"""Registered queries of look-ups, pages, merges and maintenance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import catalogue as C
from lexmill.operators import incremental as I
from lexmill.operators import reading as R
from lexmill.plans.catalogue import _BEST, _CURRENT, HISTORY, _current_with_place, _date, _day, _t
from lexmill.tables import table

_SUB = R._SUBSTITUTION


def _links(spark, d):
    pv, p = _t(spark, d, "provision_version", "provision")
    owner = C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id")
    return pv.where("created_by_document_id IS NOT NULL").select(F.col("created_by_document_id").alias("document_id"), "provision_id").join(owner, "provision_id").select("document_id", "instrument_id").distinct()


def provision_text(spark, d):
    (i,) = _t(spark, d, "instrument")
    rows = _current_with_place(spark, d).join(i.select(F.col("id").alias("instrument_id"), "slug"), "instrument_id")
    return rows.select("slug", "provision_id", "version_id", F.md5("text").alias("text_md5"))


def instrument_documents(spark, d):
    """The newest 5 documents of each instrument with their best file."""
    doc, pdf = _t(spark, d, "document", "pdf_text")
    rows = _links(spark, d).join(doc.select(F.col("id").alias("document_id"), "title", "date_issued"), "document_id")
    top = I.keep_newest(rows, ["instrument_id"], C.newest("date_issued", "document_id"), 5)
    return top.join(C.best_file(pdf).select("document_id", "attachment_id"), "document_id", "left").select("instrument_id", "document_id", "title", "attachment_id")


def documents_same_tag(spark, d):
    """Documents with one link that meets both conditions, instrument kind and machine source; two separate conditions would give more."""
    doc, pv, p, i = _t(spark, d, "document", "provision_version", "provision", "instrument")
    owner = C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id").join(i.where("kind = 'act'").select(F.col("id").alias("instrument_id")), "instrument_id")
    good = pv.where("source_kind = 'machine_merged'").select(F.col("created_by_document_id").alias("id"), "provision_id").join(owner, "provision_id", "left_semi")
    return doc.join(good, "id", "left_semi").select("id", "doc_type")


def find_instruments(spark, d):
    i, p = _t(spark, d, "instrument", "provision")
    return R.find_instruments(i, p, ["rules", "tax"]).select("id", "slug", F.col("score").cast("int").alias("score"))


def resolve_lookup(spark, d):
    i, p = _t(spark, d, "instrument", "provision")
    return R.resolve_lookup(i, p, ["tax", "rules"], "rules").select("id", "score", "size", "decisive")


def recent_effects(spark, d):
    (pv,) = _t(spark, d, "provision_version")
    rows = pv.where("created_by_document_id IS NOT NULL").dropDuplicates(["id"]).orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(50)
    return rows.select("id", "provision_id", "created_by_document_id", "source_kind")


def _source_runs(spark, d):
    return table(spark, d, "document").where("first_seen_at IS NOT NULL AND source_adapter IS NOT NULL").groupBy(F.col("source_adapter").alias("source"), F.date_format("first_seen_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("found"), F.count_if(F.col("extracted_text").isNull()).alias("without_text"))


def source_runs(spark, d):
    return I.keep_newest(_source_runs(spark, d), ["source"], [F.col("month").desc()], 10)


def source_gaps(spark, d):
    """Months between two runs of a source, where more than two."""
    w = Window.partitionBy("source").orderBy("month")
    rows = _source_runs(spark, d).withColumn("before", F.lag("month").over(w)).where("before IS NOT NULL")
    n = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    return rows.withColumn("gap", n("month") - n("before")).where("gap > 2").select("source", "before", "month", "gap")


def job_stats(spark, d):
    return table(spark, d, "document").groupBy("source_adapter", "tag_status").agg(F.count("*").alias("n"), F.max("id").alias("newest_id"))


def map_entries(spark, d):
    """Pairs of old and new numbers that a query matches, in legal order."""
    (p,) = _t(spark, d, "provision")
    rows = C.unique_provisions(p).where("parent_number IS NOT NULL").where(F.contains("number", F.lit("12")) | F.contains("parent_number", F.lit("12")) | F.ilike("heading", F.lit("%tax%")))
    return rows.orderBy("instrument_id", F.col("sort_key").asc_nulls_last(), "id").limit(300).select("id", F.col("parent_number").alias("old_number"), F.col("number").alias("new_number"))


def search_log(spark, d):
    """What is kept of a log of searches: the query only where nothing was found, and a key of it without case and space runs."""
    e = table(spark, d, "events")
    missed = F.coalesce(F.col("value") <= 50, F.lit(True))
    key = F.substring(F.trim(F.regexp_replace(F.lower("props"), r"\s+", " ")), 1, 200)
    rows = e.select(F.when(missed, F.col("props")).alias("query"), F.when(missed, key).alias("query_key"), (~missed).alias("found"))
    return rows.groupBy("query_key", "found").agg(F.count("*").alias("n"), F.min("query").alias("query"))


def search_instrument_pages(spark, d):
    rows = R.search_pages(R.pages(table(spark, d, "pdf_text")), ["authority", "registered"], "2")
    return rows.orderBy(F.col("opens").desc(), F.when(F.col("opens"), F.col("page_no")).asc_nulls_last(), F.col("rank").desc(), "page_no", "attachment_id").limit(100).select("attachment_id", "page_no", "opens", F.round("rank", 2).alias("rank"))


def search_all_pages(spark, d):
    rows = R.search_pages(R.pages(table(spark, d, "pdf_text")), ["authority", "registered", "deposit"], None)
    titles = table(spark, d, "document").select(F.col("id").alias("document_id"), "title")
    return rows.join(titles, "document_id").orderBy("title", "page_no", "attachment_id").limit(12).select("document_id", "attachment_id", "page_no")


def mechanical_merges(spark, d):
    doc, p = _t(spark, d, "document", "provision")
    current = _current_with_place(spark, d).select("provision_id", "text")
    return R.mechanical_merges(doc, p, current, _links(spark, d)).groupBy("state").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def full_texts(spark, d):
    return R.full_texts(*_t(spark, d, "document", "pdf_text"))


def quality_gate(spark, d):
    return R.quality_gate(_current_with_place(spark, d))


def pdf_only_cascade(spark, d):
    """What is left of provisions and states once instruments served as PDF alone lose theirs."""
    p, pv, i = _t(spark, d, "provision", "provision_version", "instrument")
    gone = i.where("pdf_only").select(F.col("id").alias("instrument_id"))
    kept = R.without(C.unique_provisions(p), gone, "instrument_id")
    states = pv.join(kept.select(F.col("id").alias("provision_id")), "provision_id", "left_semi")
    left = kept.groupBy("instrument_id").agg(F.count("*").alias("provisions"))
    by = states.join(kept.select(F.col("id").alias("provision_id"), "instrument_id"), "provision_id").groupBy("instrument_id").agg(F.count("*").alias("states"))
    return left.join(by, "instrument_id", "left").fillna(0, ["states"])


def prune_before_cutoff(spark, d):
    """Documents issued before the cutoff that made no version, and how many attachments go with them."""
    doc, pdf, pv = _t(spark, d, "document", "pdf_text", "provision_version")
    old = doc.where(F.col("date_issued") < F.lit("2014-01-01").cast("date")).join(pv.select(F.col("created_by_document_id").alias("id")), "id", "left_anti")
    files = pdf.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("files"))
    return old.join(files, "id", "left").select("id", "doc_type", F.coalesce("files", F.lit(0)).alias("files"))


def enqueue_missing_text(spark, d):
    """Scanned attachments without text become jobs unless one for the document is open."""
    doc, pdf = _t(spark, d, "document", "pdf_text")
    queue = doc.select(F.col("id").alias("document_id"), F.when(F.col("tag_status") == "pending", "queued").otherwise("done").alias("state"))
    return R.enqueue(queue, pdf.where("text IS NULL").select("document_id"), "document_id")


def reading_backlog(spark, d):
    """The shortest attachments first."""
    rows = table(spark, d, "pdf_text").where("text IS NULL OR ocr_used IS NULL").orderBy(F.col("page_count").asc_nulls_last(), "attachment_id").limit(100)
    return rows.select("attachment_id", "page_count")


def browse_order(spark, d):
    """Instruments in a fixed order of kinds, then by size, then title."""
    i, p = _t(spark, d, "instrument", "provision")
    kinds = F.array(*map(F.lit, ("act", "rules", "regulations", "master_direction", "scheme", "other")))
    n = C.unique_provisions(p).groupBy(F.col("instrument_id").alias("id")).agg(F.count("*").alias("n"))
    rows = i.join(n, "id", "left").fillna(0, ["n"])
    place = F.nullif(F.array_position(kinds, F.col("kind")), F.lit(0))
    w = Window.partitionBy("regulator_id").orderBy(place.asc_nulls_last(), F.col("n").desc(), "title", "id")
    return rows.select("regulator_id", "id", "kind", "n", F.row_number().over(w).cast("int").alias("place"))


def route_classifier(spark, d):
    rows = table(spark, d, "document").select(R.route("source_url").alias("route"), F.try_parse_url("source_url", F.lit("HOST")).alias("host"))
    return rows.groupBy("route", "host").agg(F.count("*").alias("n"))


def section_filter(spark, d):
    """The 20 best provisions of each instrument for what a reader typed."""
    matches, order = R.number_filter("1.1", "number", "heading")
    rows = C.unique_provisions(table(spark, d, "provision")).where(matches)
    w = Window.partitionBy("instrument_id").orderBy(order, "id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("instrument_id", "id", F.col("rn").cast("int").alias("rn"))


QUERIES = {
    f.__name__: f
    for f in (
        provision_text, instrument_documents, documents_same_tag, find_instruments, resolve_lookup, recent_effects, source_runs, source_gaps, job_stats, map_entries, search_log, search_instrument_pages, search_all_pages, mechanical_merges,
        full_texts, quality_gate, pdf_only_cascade, prune_before_cutoff, enqueue_missing_text, reading_backlog, browse_order, route_classifier, section_filter,
    )
}

_P = "(SELECT DISTINCT * FROM provision)"
_KEY = "upper(replace({0}number, ' ', ''))"
_LINKS = f"links AS (SELECT DISTINCT created_by_document_id AS document_id, q.instrument_id FROM provision_version v JOIN {_P} q ON q.id = v.provision_id WHERE created_by_document_id IS NOT NULL)"
_RUNS = "runs AS (SELECT source_adapter AS source, strftime(first_seen_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS found, count(*) FILTER (WHERE extracted_text IS NULL) AS without_text FROM document WHERE first_seen_at IS NOT NULL AND source_adapter IS NOT NULL GROUP BY 1, 2)"
_PAGES = "pages AS (SELECT attachment_id, document_id, page_no, substring(text, (page_no - 1) * 2000 + 1, 2000) AS text FROM (SELECT *, unnest(range(1, (length(text) + 1999) // 2000 + 1)) AS page_no FROM pdf_text WHERE length(text) > 0))"
_HAY = "lower(concat_ws(' ', slug, short_code, title))"
_HEAD = r"'(?:^|[^0-9A-Za-z])2\.([^0-9]|$)'"
SQL = {
    "provision_text": _CURRENT + " SELECT slug, provision_id, version_id, md5(text) AS text_md5 FROM cur JOIN instrument i ON i.id = instrument_id",
    "instrument_documents": f"""WITH {_LINKS}, {_BEST}, r AS (SELECT l.instrument_id, d.id AS document_id, title, row_number() OVER (PARTITION BY l.instrument_id ORDER BY date_issued DESC NULLS LAST, d.id DESC) AS rn FROM links l JOIN document d ON d.id = l.document_id)
      SELECT instrument_id, r.document_id, title, attachment_id FROM r LEFT JOIN best USING (document_id) WHERE r.rn <= 5""",
    "documents_same_tag": f"SELECT id, doc_type FROM document d WHERE EXISTS (SELECT 1 FROM provision_version v JOIN {_P} p ON p.id = v.provision_id JOIN instrument i ON i.id = p.instrument_id WHERE v.created_by_document_id = d.id AND v.source_kind = 'machine_merged' AND i.kind = 'act')",
    "find_instruments": f"""SELECT id, slug, score::INT AS score FROM (SELECT id, slug, CASE WHEN hits = 2 THEN 20 + CASE WHEN id IN (SELECT instrument_id FROM provision) THEN 5 ELSE 0 END ELSE hits END AS score FROM
      (SELECT *, contains({_HAY}, 'rules')::INT + contains({_HAY}, 'tax')::INT AS hits FROM instrument) WHERE hits > 0) ORDER BY score DESC, id LIMIT 20""",
    "resolve_lookup": f"""WITH s AS (SELECT i.id, CASE WHEN contains({_HAY}, 'tax') THEN 4.0 ELSE 0 END + CASE WHEN contains({_HAY}, 'rules') THEN 4.0 ELSE 0 END + CASE WHEN contains({_HAY}, 'tax rules') THEN 10.9 ELSE 0 END + CASE WHEN kind = 'rules' THEN 1.0 ELSE 0 END AS score,
        (SELECT count(DISTINCT p.id) FROM provision p WHERE p.instrument_id = i.id) AS size FROM instrument i), t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, size DESC, id LIMIT 10)
      SELECT id, score::DOUBLE AS score, size, row_number() OVER w = 1 AND (lead(score) OVER w IS NULL OR score > lead(score) OVER w) AS decisive FROM t WINDOW w AS (ORDER BY score DESC, size DESC, id)""",
    "recent_effects": "SELECT id, provision_id, created_by_document_id, source_kind FROM (SELECT DISTINCT * FROM provision_version) WHERE created_by_document_id IS NOT NULL ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50",
    "source_runs": f"WITH {_RUNS} SELECT source, month, found, without_text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY month DESC) AS rn FROM runs) WHERE rn <= 10",
    "source_gaps": f"WITH {_RUNS}, l AS (SELECT source, lag(month) OVER (PARTITION BY source ORDER BY month) AS before, month FROM runs) SELECT *, gap::INT AS gap FROM (SELECT source, before, month, substring(month, 1, 4)::INT * 12 + substring(month, 6, 2)::INT - substring(before, 1, 4)::INT * 12 - substring(before, 6, 2)::INT AS gap FROM l) WHERE gap > 2".replace("SELECT *, gap::INT AS gap", "SELECT source, before, month, gap::INT AS gap"),
    "job_stats": "SELECT source_adapter, tag_status, count(*) AS n, max(id) AS newest_id FROM document GROUP BY 1, 2",
    "map_entries": f"SELECT id, parent_number AS old_number, number AS new_number FROM {_P} WHERE parent_number IS NOT NULL AND (contains(number, '12') OR contains(parent_number, '12') OR heading ILIKE '%tax%') ORDER BY instrument_id, sort_key NULLS LAST, id LIMIT 300",
    "search_log": r"""WITH r AS (SELECT *, coalesce(value <= 50, true) AS missed, substring(trim(regexp_replace(lower(props), '\s+', ' ', 'g')), 1, 200) AS k FROM events) SELECT CASE WHEN missed THEN k END AS query_key, NOT missed AS found, count(*) AS n, min(CASE WHEN missed THEN props END) AS query FROM r GROUP BY 1, 2""",
    "search_instrument_pages": f"""WITH {_PAGES}, r AS (SELECT *, regexp_matches(substring(text, 1, 200), {_HEAD}) AS opens, CASE WHEN contains(lower(text), 'authority') AND contains(lower(text), 'registered') THEN 1.0 ELSE 0.0 END
        + CASE WHEN regexp_matches(substring(text, 1, 200), {_HEAD}) THEN 0.9 WHEN regexp_matches(text, {_HEAD}) THEN 0.25 ELSE 0.0 END AS rank FROM pages)
      SELECT attachment_id, page_no::INT AS page_no, opens, rank::DOUBLE AS rank FROM (SELECT * FROM r WHERE rank > 0 ORDER BY opens DESC, CASE WHEN opens THEN page_no END NULLS LAST, rank DESC, page_no, attachment_id LIMIT 100)""",
    "search_all_pages": f"""WITH {_PAGES} SELECT document_id, attachment_id, page_no::INT AS page_no FROM (SELECT p.*, title FROM pages p JOIN document d ON d.id = document_id WHERE contains(lower(text), 'authority') AND contains(lower(text), 'registered') AND contains(lower(text), 'deposit')
      ORDER BY title NULLS FIRST, page_no, attachment_id LIMIT 12)""",
    "mechanical_merges": f"""WITH {HISTORY}, {_LINKS}, cur AS (SELECT provision_id, text FROM now JOIN body USING (version_id)),
      f AS (SELECT DISTINCT id AS document_id, upper(unnest(regexp_extract_all(extracted_text, '{_SUB}', 1))) AS number, unnest(regexp_extract_all(extracted_text, '{_SUB}', 2)) AS old, unnest(regexp_extract_all(extracted_text, '{_SUB}', 3)) AS new FROM document WHERE extracted_text IS NOT NULL),
      j AS (SELECT f.*, p.id AS provision_id, cur.text, (length(cur.text) - length(replace(cur.text, old, ''))) / length(old) AS times FROM f LEFT JOIN links l ON l.document_id = f.document_id LEFT JOIN p ON p.instrument_id = l.instrument_id AND upper(replace(p.number, ' ', '')) = f.number LEFT JOIN cur ON cur.provision_id = p.id)
      SELECT CASE WHEN provision_id IS NULL THEN 'no_provision' WHEN text IS NULL THEN 'no_text' WHEN times = 0 THEN 'not_found' WHEN times = 1 THEN 'applicable' ELSE 'ambiguous' END AS state, count(*) AS n, count(DISTINCT document_id) AS documents FROM j GROUP BY 1""",
    "full_texts": """WITH b AS (SELECT id, coalesce(extracted_text, '') AS body FROM document), s AS (SELECT b.id, count(*) AS n, sum(length(text) + 2) AS c FROM (SELECT DISTINCT document_id, text FROM pdf_text WHERE length(text) > 0) t JOIN b ON b.id = t.document_id WHERE NOT contains(body, text) GROUP BY 1)
      SELECT b.id, ((body <> '')::BIGINT + coalesce(n, 0))::BIGINT AS n_parts, (length(body) + coalesce(c, 0))::BIGINT AS n_chars FROM b LEFT JOIN s USING (id)""",
    "quality_gate": _CURRENT + """, q AS (SELECT instrument_id, count(*) AS n, count(*) FILTER (WHERE length(text) < 40) AS short FROM cur WHERE level IS NULL OR lower(level) <> 'chapter' GROUP BY 1) SELECT *, CASE WHEN n < 3 THEN 'too_few' WHEN short > n * 0.25 THEN 'serve_pdf' ELSE 'serve_text' END AS action FROM q""",
    "pdf_only_cascade": f"""WITH k AS (SELECT * FROM {_P} WHERE instrument_id NOT IN (SELECT id FROM instrument WHERE pdf_only)), s AS (SELECT k.instrument_id, count(*) AS states FROM provision_version v JOIN k ON k.id = v.provision_id GROUP BY 1)
      SELECT k.instrument_id, count(*) AS provisions, coalesce(any_value(states), 0) AS states FROM k LEFT JOIN s USING (instrument_id) GROUP BY 1""",
    "prune_before_cutoff": "SELECT id, doc_type, (SELECT count(*) FROM pdf_text WHERE document_id = d.id) AS files FROM document d WHERE date_issued < DATE '2014-01-01' AND NOT EXISTS (SELECT 1 FROM provision_version v WHERE v.created_by_document_id = d.id)",
    "enqueue_missing_text": "SELECT DISTINCT document_id FROM pdf_text WHERE text IS NULL AND document_id NOT IN (SELECT id FROM document WHERE tag_status = 'pending')",
    "reading_backlog": "SELECT attachment_id, page_count FROM pdf_text WHERE text IS NULL OR ocr_used IS NULL ORDER BY page_count NULLS LAST, attachment_id LIMIT 100",
    "browse_order": f"""WITH n AS (SELECT instrument_id AS id, count(*) AS n FROM {_P} GROUP BY 1) SELECT regulator_id, id, kind, n, (row_number() OVER (PARTITION BY regulator_id ORDER BY list_position(['act', 'rules', 'regulations', 'master_direction', 'scheme', 'other'], kind) NULLS LAST, n DESC, title NULLS FIRST, id))::INT AS place
      FROM (SELECT i.*, coalesce(n.n, 0) AS n FROM instrument i LEFT JOIN n USING (id))""",
    "route_classifier": r"""SELECT CASE WHEN source_url IS NULL THEN 'none' WHEN regexp_matches(source_url, '(?i)\.pdf(\?|$)') THEN 'pdf' WHEN regexp_matches(source_url, '(?i)/circulars?(/|$)') THEN 'circular' WHEN regexp_matches(source_url, '(?i)/notifications?(/|$)') THEN 'notification'
      WHEN regexp_matches(source_url, '(?i)/orders?(/|$)') THEN 'order' WHEN contains(source_url, '?') THEN 'query' ELSE 'page' END AS route, nullif(regexp_extract(source_url, '^[a-z]+://([^/?#:]+)', 1), '') AS host, count(*) AS n FROM document GROUP BY 1, 2""",
    "section_filter": rf"""WITH b AS (SELECT *, lower(regexp_replace(number, '[\s.()\-]', '', 'g')) AS k FROM {_P}) SELECT instrument_id, id, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY k <> '11', length(number), id) AS rn FROM b WHERE contains(k, '11')) WHERE rn <= 20""",
}
