"""Registered queries of maintenance and look-ups by other keys, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import catalogue as C
from lexmill.operators import incremental as I
from lexmill.operators import reading as R
from lexmill.operators import upkeep as U
from lexmill.plans.catalogue import _CURRENT, HISTORY, _current_with_place, _t
from lexmill.plans.reading import _LINKS, _SUB, _links
from lexmill.tables import table

SPLIT = "2024-01-01"


def _before(c: str):
    return F.coalesce(F.col(c) < I.instant(SPLIT), F.lit(False))


def document_upsert(spark, d):
    """Documents seen before 2024 as held, those seen later as found."""
    (doc,) = _t(spark, d, "document")
    return U.upsert_documents(doc.where(_before("first_seen_at")), doc.where(~_before("first_seen_at")))


def _tags(pv, p):
    owner = C.unique_provisions(p).select(F.col("id").alias("provision_id"), "instrument_id")
    rows = pv.where("created_by_document_id IS NOT NULL").join(owner, "provision_id")
    relation = F.when(F.col("source_kind") == "official", "amends").otherwise("clarifies")
    return rows.select(F.col("created_by_document_id").alias("document_id"), "instrument_id", F.when(F.col("effective_from").isNotNull(), F.col("provision_id")).alias("provision_id"), relation.alias("relation"), "created_at")


def tags_inserted(spark, d):
    """Tags with null provisions among their keys: only those not held yet are inserted."""
    tags = _tags(*_t(spark, d, "provision_version", "provision"))
    key = ["document_id", "instrument_id", "provision_id", "relation"]
    return U.insert_new(tags.where(_before("created_at")), tags.where(~_before("created_at")), key).select(*key)


def page_views_incremented(spark, d):
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("path"), (F.hour("ts") < 12).alias("morning"))
    part = lambda morning: e.where(F.col("morning") == morning).groupBy("day", "path").agg(F.count("*").alias("views"))
    return U.increment(part(True), part(False), ["day", "path"], "views")


def last_seen_touched(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    held = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("ts").alias("seen"))
    out = U.touch(held, e.where("event_type = 'view'").withColumnRenamed("ts", "seen"), "user_id", "seen", 60 * 24)
    return out.select("user_id", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen"))


def compacted(spark, d):
    out = U.compacted(*_t(spark, d, "pdf_text", "document"))
    return out.select("attachment_id", "document_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def forgotten(spark, d):
    """The log with old texts erased; its rows stay."""
    old = F.col("ts") < F.lit("2024-06-01").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", "user_id", F.when(~old, F.col("props")).alias("props"))


def closed_runs(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("started_at"), F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("finished_at"))
    runs = e.withColumns({"ok": F.when(F.col("finished_at").isNotNull(), F.lit(True)), "error": F.lit(None).cast("string")})
    out = U.closed_runs(runs, F.lit("2024-03-01").cast("timestamp_ntz"))
    return out.groupBy("ok", "error").agg(F.count("*").alias("n"), F.count("finished_at").alias("ended"))


def pressure(spark, d):
    doc, pdf, pv = _t(spark, d, "document", "pdf_text", "provision_version")
    one = lambda rows, c, budget, deletable: rows.agg(F.sum(F.octet_length(c)).alias("used")).select("used", F.lit(budget).alias("budget"), F.lit(deletable).alias("deletable"))
    usage = one(doc, "extracted_text", 50_000_000, True).union(one(pdf, "text", 20_000_000, True)).union(one(pv, "text", 1_000, False))
    return U.pressure(usage).select(F.round("pressure", 9).alias("pressure"))


def number_lookups(spark, d):
    """The provision that each number in a document's title means, in the instruments that the document is about."""
    doc, p = _t(spark, d, "document", "provision")
    cited = doc.select(F.col("id").alias("document_id"), F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(\d+(?:\.\d+)*[A-Z]?)"), 1))).alias("number"))
    return U.numbered(cited.join(_links(spark, d), "document_id"), p)


def titles_in_texts(spark, d):
    doc, i = _t(spark, d, "document", "instrument")
    return U.holding(doc.select("id", F.col("extracted_text").alias("text")), i.select(F.col("id").cast("long").alias("phrase_id"), F.col("title").alias("phrase"))).withColumnRenamed("phrase_id", "instrument_id")


def watched_instruments(spark, d):
    """Things watched are provisions or instruments; the instrument of either is the key of the join."""
    p, i = _t(spark, d, "provision", "instrument")
    u = C.unique_provisions(p)
    watch = u.select((F.col("id") % 97).alias("reader"), F.when(F.col("id") % 3 == 0, F.col("instrument_id")).alias("w_instrument"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("w_provision"))
    owner = u.select(F.col("id").alias("w_provision"), "instrument_id")
    keyed = watch.join(owner, "w_provision", "left").withColumn("id", F.coalesce("w_instrument", "instrument_id")).select("reader", "id", "w_provision")
    return keyed.join(i.select("id", "slug"), "id").groupBy("reader", "slug").agg(F.count("*").alias("n"), F.count("w_provision").alias("provisions"))


def defined_terms(spark, d):
    """The eight terms that a prefix suggests: fewest words, then most often defined, then shortest."""
    rows = _current_with_place(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[“\"]([A-Za-z][A-Za-z -]{2,60})[”\"] (?:means|includes)"), 1)).alias("term"))
    rows = rows.select(F.lower("term").alias("term")).where(F.startswith("term", F.lit("c"))).groupBy("term").agg(F.count("*").alias("n"))
    return rows.orderBy(F.size(F.split("term", " ")), F.col("n").desc(), F.length("term"), "term").limit(8)


def last_amendment(spark, d):
    """The newest document that changed a provision, not one that only names it."""
    doc, pv = _t(spark, d, "document", "provision_version")
    rows = pv.where("source_kind = 'machine_merged' AND text IS NOT NULL AND provision_id IS NOT NULL").select("provision_id", F.col("created_by_document_id").alias("id")).distinct().join(doc.select("id", "date_issued"), "id")
    w = Window.partitionBy("provision_id").orderBy(*C.newest("date_issued", "id"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("provision_id", F.col("id").alias("document_id"))


def section_map(spark, d):
    """Old and new numbers as lines of a CSV with their status; dashes are no number."""
    (p,) = _t(spark, d, "provision")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, "^[-–—]+$", "")), F.lit(""))
    rows = C.unique_provisions(p).select("id", clean("parent_number").alias("old"), clean("number").alias("new"), "heading").where("old IS NOT NULL OR new IS NOT NULL")
    status = F.when(F.col("new").isNull(), "no counterpart").when(F.col("old").isNull(), "new").otherwise("mapped")
    return rows.withColumn("status", status).select("id", U.csv_line("old", "new", "heading", "status").alias("line"))


def feeds_united(spark, d):
    """Three feeds of documents as one, an address once, the first feed first."""
    doc = table(spark, d, "document").where("source_url IS NOT NULL").select("id", "doc_type", "source_url")
    feed = lambda kind, rank: doc.where(F.col("doc_type") == kind).withColumn("rank", F.lit(rank))
    rows = feed("circular", 1).unionByName(feed("notification", 2)).unionByName(doc.where("doc_type = 'circular'").withColumn("rank", F.lit(3)))
    return U.claimed(rows, "source_url", [F.col("rank"), F.col("id")]).select("id", "rank")


def listed_only(spark, d):
    """Documents of a current listing that an older one lacks; the first to claim a slug keeps it."""
    doc = table(spark, d, "document").where("title IS NOT NULL")
    now, old = doc.where(~_before("first_seen_at")), doc.where(_before("first_seen_at"))
    new = now.join(old.select("source_url"), "source_url", "left_anti").withColumn("slug", U.slugify("title"))
    return U.claimed(new, "slug", C.newest("date_issued", "id")).select("id", "slug")


def titles_matched(spark, d):
    i, doc = _t(spark, d, "instrument", "document")
    named = i.select(F.upper(F.replace("title", F.lit(","), F.lit(" -"))).alias("name")).union(i.select(F.regexp_replace("title", r",? *\d{4}$", "").alias("name"))).union(doc.select(F.col("title").alias("name"))).where("name IS NOT NULL")
    return U.matched_titles(named, i)


def merged_texts(spark, d):
    """The current texts that quoted substitutions give where the old words stand exactly once, with what surrounds them."""
    doc, p = _t(spark, d, "document", "provision")
    current = _current_with_place(spark, d).select("provision_id", "text")
    rows = R.mechanical_merges(doc, p, current, _links(spark, d)).where("state = 'applicable'")
    at = F.instr("text", F.col("old"))
    text = F.concat(F.substring("text", 1, at - 1), F.col("new"), F.substring("text", at + F.length("old"), F.length("text")))
    return rows.select("document_id", "provision_id", F.md5(text).alias("merged_md5"), F.substring("text", F.greatest(at - 70, F.lit(1)), F.least(at - 1, F.lit(70)) + F.length("old") + 70).alias("context")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        document_upsert, tags_inserted, page_views_incremented, last_seen_touched, compacted, forgotten, closed_runs, pressure, number_lookups, titles_in_texts, watched_instruments, defined_terms, last_amendment, section_map,
        feeds_united, listed_only, titles_matched, merged_texts,
    )
}

_OLD = f"coalesce({{0}} < TIMESTAMPTZ '{SPLIT} 00:00:00+00', false)".format
_LETTERS = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')".format
_SLUG = "substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)"
_N = "upper(replace({0}, ' ', ''))".format
_K = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))".format
_B = "regexp_replace({0}, ' (1[89]|20)\\d\\d$', '')".format
_CSV = """CASE WHEN regexp_matches(coalesce({0}, ''), '[",\\n]') THEN '"' || replace({0}, '"', '""') || '"' ELSE coalesce({0}, '') END""".format
SQL = {
    "document_upsert": f"""WITH h AS (SELECT * FROM document WHERE {_OLD('first_seen_at')}), f AS (SELECT DISTINCT source_url, regulator_code AS r, date_issued AS d, coalesce(number, '') AS n, {_LETTERS('title')} AS t FROM document WHERE NOT {_OLD('first_seen_at')}),
      m AS (SELECT source_url, (SELECT min(id) FROM h WHERE h.source_url = f.source_url) AS u,
        (SELECT min(id) FROM h WHERE regulator_code IS NOT DISTINCT FROM r AND date_issued IS NOT DISTINCT FROM d AND coalesce(number, '') = n AND {_LETTERS('title')} = t AND t <> '') AS k FROM f)
      SELECT DISTINCT source_url, CASE WHEN u IS NOT NULL THEN 'seen' WHEN k IS NOT NULL THEN 'same' ELSE 'insert' END AS action, coalesce(u, k) AS id FROM m""",
    "tags_inserted": f"""WITH t AS (SELECT v.created_by_document_id AS document_id, p.instrument_id, CASE WHEN effective_from IS NOT NULL THEN v.provision_id END AS provision_id, CASE WHEN source_kind = 'official' THEN 'amends' ELSE 'clarifies' END AS relation, {_OLD('v.created_at')} AS old
        FROM provision_version v JOIN (SELECT DISTINCT id, instrument_id FROM provision) p ON p.id = v.provision_id WHERE v.created_by_document_id IS NOT NULL)
      SELECT document_id, instrument_id, provision_id, relation FROM t WHERE NOT old EXCEPT SELECT document_id, instrument_id, provision_id, relation FROM t WHERE old""",
    "page_views_incremented": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS path, count(*)::BIGINT AS views FROM events GROUP BY 1, 2",
    "last_seen_touched": """WITH h AS (SELECT user_id, max(ts) AS s FROM events WHERE event_type = 'click' GROUP BY 1), v AS (SELECT user_id, max(ts) AS n FROM events WHERE event_type = 'view' GROUP BY 1)
      SELECT user_id, strftime(CASE WHEN n IS NOT NULL AND (s IS NULL OR n > s + INTERVAL 1440 MINUTES) THEN n ELSE s END, '%Y-%m-%d %H:%M:%S') AS seen FROM h FULL JOIN v USING (user_id)""",
    "compacted": """WITH j AS (SELECT a.attachment_id, a.document_id, CASE WHEN EXISTS (SELECT 1 FROM document d WHERE d.id = a.document_id AND d.extracted_text = a.text) THEN NULL ELSE a.text END AS t FROM pdf_text a)
      SELECT attachment_id, document_id, length(t)::INT AS n_chars, md5(t) AS text_md5 FROM j""",
    "forgotten": "SELECT event_id, user_id, CASE WHEN ts < TIMESTAMP '2024-06-01' THEN NULL ELSE props END AS props FROM events",
    "closed_runs": """WITH r AS (SELECT user_id, ts::DATE AS day, min(ts) AS s, max(CASE WHEN event_type = 'purchase' THEN ts END) AS f FROM events GROUP BY 1, 2), c AS (SELECT *, f IS NULL AND s < TIMESTAMP '2024-03-01' - INTERVAL 6 HOURS AS stale FROM r)
      SELECT CASE WHEN stale THEN false WHEN f IS NOT NULL THEN true END AS ok, CASE WHEN stale THEN 'no end recorded' END AS error, count(*) AS n, count(CASE WHEN stale THEN TIMESTAMP '2024-03-01' ELSE f END) AS ended FROM c GROUP BY 1, 2""",
    "pressure": "SELECT round(greatest((SELECT coalesce(sum(strlen(extracted_text)), 0) FROM document) / 50000000, (SELECT coalesce(sum(strlen(text)), 0) FROM pdf_text) / 20000000), 9) AS pressure",
    "number_lookups": f"""WITH {_LINKS}, c AS (SELECT DISTINCT document_id, instrument_id, number FROM (SELECT id AS document_id, unnest(regexp_extract_all(title, '(\\d+(?:\\.\\d+)*[A-Z]?)', 1)) AS number FROM document) JOIN links USING (document_id)),
      q AS (SELECT DISTINCT id, instrument_id, sort_key, {_N('number')} AS n FROM provision WHERE number IS NOT NULL),
      r AS (SELECT c.*, q.id AS provision_id, row_number() OVER (PARTITION BY document_id, c.instrument_id, c.number ORDER BY sort_key NULLS LAST, q.id) AS rn FROM c JOIN q ON q.instrument_id = c.instrument_id AND (n = {_N('c.number')} OR starts_with(n, {_N('c.number')} || '(') OR replace(n, '-', '') = {_N('c.number')}))
      SELECT document_id, instrument_id, number, provision_id FROM r WHERE rn = 1""",
    "titles_in_texts": "SELECT d.id, i.id::BIGINT AS instrument_id FROM document d JOIN instrument i ON i.title <> '' AND contains(lower(d.extracted_text), lower(i.title))",
    "watched_instruments": """WITH u AS (SELECT DISTINCT id, instrument_id FROM provision), w AS (SELECT id % 97 AS reader, CASE WHEN id % 3 = 0 THEN instrument_id END AS wi, CASE WHEN id % 3 <> 0 THEN id END AS wp FROM u)
      SELECT reader, slug, count(*) AS n, count(wp) AS provisions FROM w LEFT JOIN u ON u.id = wp JOIN instrument i ON i.id = coalesce(wi, u.instrument_id) GROUP BY 1, 2""",
    "defined_terms": _CURRENT + r""", t AS (SELECT lower(unnest(regexp_extract_all(text, '[“"]([A-Za-z][A-Za-z -]{2,60})[”"] (?:means|includes)', 1))) AS term FROM cur)
      SELECT term, count(*) AS n FROM t WHERE starts_with(term, 'c') GROUP BY 1 ORDER BY len(string_split(term, ' ')), n DESC, length(term), term LIMIT 8""",
    "last_amendment": """SELECT provision_id, document_id FROM (SELECT v.provision_id, d.id AS document_id, row_number() OVER (PARTITION BY v.provision_id ORDER BY date_issued DESC NULLS LAST, d.id DESC) AS rn FROM (SELECT DISTINCT provision_id, created_by_document_id FROM provision_version
      WHERE source_kind = 'machine_merged' AND text IS NOT NULL AND provision_id IS NOT NULL) v JOIN document d ON d.id = created_by_document_id) WHERE rn = 1""",
    "section_map": f"""WITH m AS (SELECT DISTINCT id, nullif(trim(regexp_replace(parent_number, '^[-–—]+$', '')), '') AS o, nullif(trim(regexp_replace(number, '^[-–—]+$', '')), '') AS n, heading AS h FROM provision)
      SELECT id, {_CSV('o')} || ',' || {_CSV('n')} || ',' || {_CSV('h')} || ',' || CASE WHEN n IS NULL THEN 'no counterpart' WHEN o IS NULL THEN 'new' ELSE 'mapped' END AS line FROM m WHERE o IS NOT NULL OR n IS NOT NULL""",
    "feeds_united": "SELECT id, CASE doc_type WHEN 'circular' THEN 1 ELSE 2 END AS rank FROM document WHERE source_url IS NOT NULL AND doc_type IN ('circular', 'notification')",
    "listed_only": f"""WITH n AS (SELECT *, {_SLUG} AS slug FROM document d WHERE title IS NOT NULL AND NOT {_OLD('first_seen_at')} AND NOT EXISTS (SELECT 1 FROM document o WHERE o.title IS NOT NULL AND {_OLD('o.first_seen_at')} AND o.source_url = d.source_url))
      SELECT id, slug FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY date_issued DESC NULLS LAST, id DESC) AS rn FROM n) WHERE rn = 1""",
    "titles_matched": rf"""WITH n AS (SELECT upper(replace(title, ',', ' -')) AS name FROM instrument UNION SELECT regexp_replace(title, ',? *\d{{4}}$', '') FROM instrument UNION SELECT title FROM document), h AS (SELECT id, {_K('title')} AS k FROM instrument),
      m AS (SELECT name, (SELECT min(id) FROM h WHERE k = {_K('name')}) AS a, (SELECT min(id) FROM h WHERE {_B('k')} = {_B(_K('name'))}) AS b FROM n WHERE name IS NOT NULL)
      SELECT name, coalesce(a, b) AS instrument_id FROM m WHERE coalesce(a, b) IS NOT NULL""",
    "merged_texts": f"""WITH {HISTORY}, {_LINKS}, cur AS (SELECT provision_id, text FROM now JOIN body USING (version_id)),
      f AS (SELECT DISTINCT id AS document_id, upper(unnest(regexp_extract_all(extracted_text, '{_SUB}', 1))) AS number, unnest(regexp_extract_all(extracted_text, '{_SUB}', 2)) AS old, unnest(regexp_extract_all(extracted_text, '{_SUB}', 3)) AS new FROM document WHERE extracted_text IS NOT NULL)
      SELECT DISTINCT f.document_id, cur.provision_id, md5(replace(cur.text, old, new)) AS merged_md5, substring(cur.text, greatest(instr(cur.text, old) - 70, 1), least(instr(cur.text, old) - 1, 70) + length(old) + 70) AS context
      FROM f JOIN links l ON l.document_id = f.document_id JOIN p ON p.instrument_id = l.instrument_id AND upper(replace(p.number, ' ', '')) = f.number JOIN cur ON cur.provision_id = p.id WHERE length(cur.text) - length(replace(cur.text, old, '')) = length(old)""",
}
