"""Registered queries of windows, health, logs, retention and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import catalogue as C
from lexmill.operators import incremental as I
from lexmill.plans.catalogue import HISTORY, _AFFECTED, _BEST, _date, _day, _t
from lexmill.tables import table

SINCE, CUTOFF = "2024-01-01", "2024-04-01"


def digest_window(spark, d):
    doc, pdf, pv, p, i = _t(spark, d, "document", "pdf_text", "provision_version", "provision", "instrument")
    rows = I.window(doc, "first_seen_at", SINCE, CUTOFF).select("id", "title", "regulator_code")
    rows = rows.join(C.best_file(pdf).select(F.col("document_id").alias("id"), "attachment_id"), "id", "left").join(C.affected(doc, pv, p, i).select(F.col("document_id").alias("id"), "affects"), "id", "left")
    return rows.select("id", "title", "regulator_code", "attachment_id", F.coalesce("affects", F.lit("")).alias("affects"))


def arrivals(spark, d):
    doc = table(spark, d, "document").withColumn("key", F.concat_ws("/", "regulator_code", "doc_type", "source_adapter"))
    out = I.arrivals(doc, "key", "first_seen_at", SINCE, CUTOFF)
    return out.select("key", "n", F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"))


def digest_grouping(spark, d):
    rows = I.window(table(spark, d, "document"), "first_seen_at", SINCE, CUTOFF).where("regulator_code IS NOT NULL").select("id", "regulator_code")
    return I.digest(rows, "regulator_code", [F.col("id").desc()]).select("id", "regulator_code", "place", "n_group", "left_out")




def listing_median(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return e.groupBy("event_type").agg(F.percentile("n", F.lit(0.5)).alias("median"), F.count("*").alias("samples"), F.max("n").alias("peak"))


def collapse_reason(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("source"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    out = I.collapse(e, "source", "day", "n", least=1, days=5)
    return out.select("source", _day("day").alias("day"), "n", "median", "samples", "previous", "collapsed")


def empty_discovery(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("n"))
    return I.empty_after_peak(e, "user_id", "day", "n").select("user_id", _day("day").alias("day"), "peak")


def search_volume(spark, d):
    """Events by local day of India, in all and by kind."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("Asia/Kolkata"), F.col("ts"))
    return table(spark, d, "events").groupBy(_to_day(local).alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("found"), F.count_if(F.col("value").isNull() | (F.col("value") <= 50)).alias("missed"))


def _to_day(c):
    return F.date_format(c, "yyyy-MM-dd")


def page_views_by_path(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("path")).agg(F.count("*").alias("views"))


def page_views_by_slug(spark, d):
    slug = F.get_json_object("props", "$.k")
    return table(spark, d, "events").groupBy(F.coalesce(slug, F.lit("")).alias("slug")).agg(F.count("*").alias("views"))


def page_views_daily(spark, d):
    return table(spark, d, "events").groupBy(_to_day(F.col("ts")).alias("day"), F.col("event_type").alias("path")).agg(F.count("*").alias("views"))


def json_payload(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).cast("long").alias("total"), F.max(k).alias("most"))


def rate_limit(spark, d):
    """Users with more than LIMIT events in one minute; the events of these tables are few, so the limit here is 1."""
    out = I.over_limit(table(spark, d, "events"), "user_id", "ts", limit=1)
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("minute"), "n")


def retention_candidates(spark, d):
    doc = table(spark, d, "document").select("id", "regulator_code", "date_issued", "is_amending", "doc_type")
    rows = I.retention_candidates(doc, "regulator_code", C.newest("date_issued", "id"), 200, F.col("is_amending") | (F.col("doc_type") == "master_direction"))
    return rows.select("id", "regulator_code")


def keep_newest_n(spark, d):
    rows = I.keep_newest(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 2)
    return rows.select("user_id", "event_id")


def forget_old(spark, d):
    """Text of old log rows is erased, the row stays."""
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("rows"), F.count(F.when(F.col("ts") >= F.lit("2024-06-01").cast("timestamp_ntz"), F.col("props"))).alias("kept_text"))


def refresh_actions(spark, d):
    """The states of 2010 as held, the current ones as incoming."""
    pv = table(spark, d, "provision_version")
    chains = C.versions(pv, True)
    held = C.as_on(chains, "2010-01-01").select("provision_id", F.col("text").alias("held_text"), "valid_from", "source_kind")
    incoming = C.as_on(chains, None).select("provision_id", F.col("text").alias("new_text"))
    return I.refresh_actions(held, incoming, "2010-01-01").groupBy("action", "verdict").agg(F.count("*").alias("n"))


def upsert_titles(spark, d):
    """Regulators' first documents as held, the newest as incoming: new titles win, a null number does not overwrite."""
    doc = table(spark, d, "document").where("regulator_code IS NOT NULL")
    one = lambda order: I.keep_newest(doc, ["regulator_code"], order, 1).select("regulator_code", "title", "number", F.lit(1).alias("_in"))
    return I.upsert(one([F.col("id")]), one([F.col("id").desc()]), ["regulator_code"], ["number"]).select("regulator_code", "title", "number")


def _jobs(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "click", "start").when(F.col("event_type") == "view", "fail").otherwise("queue")
    return e.select((F.col("user_id") % 500).alias("job_id"), kind.alias("event"), "ts")


def job_states(spark, d):
    return I.job_states(_jobs(spark, d)).groupBy("state").agg(F.count("*").alias("n"), F.sum("attempts").cast("long").alias("attempts"))


def follow_hits(spark, d):
    doc, pv, p = _t(spark, d, "document", "provision_version", "provision")
    u = C.unique_provisions(p)
    follows = u.where("level = 'section'").select((F.col("id") % 97).alias("follower"), F.col("id").alias("provision_id"), F.col("instrument_id").alias("scope"), F.trim(F.regexp_extract("number", r"(\d+[A-Za-z]?)\s*$", 1)).alias("number")).where("number <> ''")
    links = pv.where("created_by_document_id IS NOT NULL").select(F.col("created_by_document_id").alias("document_id"), "provision_id").distinct()
    scope = links.join(u.select(F.col("id").alias("provision_id"), F.col("instrument_id").alias("scope")), "provision_id").select("document_id", "scope").distinct()
    documents = doc.select(F.col("id").alias("document_id"), "title").join(scope, "document_id")
    return I.followed(documents, follows, links)


def since_last_visit(spark, d):
    """For each reader the 20 newest documents first seen after their last visit, one row a document."""
    doc, i, r = _t(spark, d, "document", "instrument", "regulator")
    readers = r.select("id", "code").withColumn("last_visit", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, id * 7)"))
    rows = doc.join(readers.select(F.col("id").alias("reader"), F.col("code").alias("regulator_code"), "last_visit"), "regulator_code").where("first_seen_at > last_visit")
    w = Window.partitionBy("reader").orderBy(F.col("first_seen_at").desc(), F.col("id").desc())
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("reader", "id", F.col("rn").cast("int").alias("rn"))


def listing_rows(spark, d):
    """Both JSON listings as one list of documents: number, title, kind, address."""
    cbic, mca = _t(spark, d, "cbic_notifications_central_tax_2025", "mca_notifications_listing")
    a = cbic.select(F.lit("cbic").alias("source"), F.col("id").cast("string").alias("key"), F.concat(F.lit("Notification No. "), F.col("notificationNo")).alias("number"), F.col("notificationName").alias("title"), F.lit("notification").alias("doc_type"), F.when(F.lower("docFilePath").endswith(".pdf"), F.replace(F.col("docFilePath"), F.lit("\\"), F.lit("/"))).alias("path"))
    title = F.when(F.startswith("shortDescription", F.concat("docName", F.lit("-"))), F.substring("shortDescription", F.length("docName") + 2, F.lit(10_000))).otherwise(F.col("shortDescription"))
    kind = F.when(F.upper("docName").rlike(r"^G\.?S\.?R"), "gsr").otherwise("notification")
    b = mca.select(F.lit("mca").alias("source"), F.col("docIdentifier").alias("key"), F.col("docName").alias("number"), title.alias("title"), kind.alias("doc_type"), F.base64(F.col("link").cast("binary")).alias("path"))
    return a.unionByName(b).distinct()


def chapter_runs(spark, d):
    """Lines of a document that repeat the line before are dropped; the rest counted."""
    doc = table(spark, d, "document").where("extracted_text IS NOT NULL").select("id", F.posexplode(F.split("extracted_text", "\n")).alias("n", "line"))
    w = Window.partitionBy("id").orderBy("n")
    return doc.withColumn("same", F.lag("line").over(w).eqNullSafe(F.col("line"))).where("NOT same").groupBy("id").agg(F.count("*").alias("lines"))


def best_page(spark, d):
    """Of each text in chunks of 2,000 characters the one with most distinct words of a query, the earliest of several."""
    doc = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.lower("text").alias("t"))
    pages = doc.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 2000).cast("int"))).alias("page")).where("length(t) > 0").withColumn("t", F.substring("t", F.col("page") * 2000 + 1, F.lit(2000)))
    hits = sum((F.contains("t", F.lit(w)).cast("int") for w in ("deposit", "registered", "authority", "circular")), F.lit(0))
    best = pages.withColumn("hits", hits).groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("page")).alias("p"))).alias("b"))
    return best.select("doc_id", (-F.col("b.p")).alias("page"), F.col("b.hits").alias("hits")).where("hits > 0")


def _bare(*names: str) -> dict:
    return {n: globals()[n] for n in names}


QUERIES = _bare(
    "digest_window", "arrivals", "digest_grouping", "listing_median", "collapse_reason", "empty_discovery", "search_volume", "page_views_by_path", "page_views_by_slug", "page_views_daily", "json_payload", "rate_limit",
    "retention_candidates", "keep_newest_n", "forget_old", "refresh_actions", "upsert_titles", "job_states", "follow_hits", "since_last_visit", "listing_rows", "chapter_runs", "best_page",
)

_W = f"first_seen_at >= TIMESTAMPTZ '{SINCE} 00:00:00+00' AND first_seen_at < TIMESTAMPTZ '{CUTOFF} 00:00:00+00'"
_STATE = """CASE WHEN last = 'done' THEN 'done' WHEN last = 'fail' AND failures >= 3 THEN 'failed' WHEN last = 'fail' THEN 'queued' WHEN last = 'start' AND last_ts < ending - INTERVAL 30 MINUTES THEN 'rescued' WHEN last = 'start' THEN 'running' ELSE 'queued' END"""
SQL = {
    "digest_window": f"WITH {_AFFECTED}, {_BEST} SELECT id, title, regulator_code, attachment_id, coalesce(affects, '') AS affects FROM document d LEFT JOIN best ON best.document_id = id LEFT JOIN affected a ON a.document_id = id WHERE {_W}",
    "arrivals": f"""WITH k AS (SELECT *, concat_ws('/', regulator_code, doc_type, source_adapter) AS key FROM document) SELECT key, count(*) AS n, epoch_us(min(first_seen_at)) AS first_us, epoch_us(max(first_seen_at)) AS last_us FROM k
      WHERE {_W} AND key NOT IN (SELECT key FROM k WHERE first_seen_at < TIMESTAMPTZ '{SINCE} 00:00:00+00') GROUP BY 1""",
    "digest_grouping": f"""WITH r AS (SELECT id, regulator_code, count(*) OVER (PARTITION BY regulator_code) AS n_group FROM document WHERE {_W} AND regulator_code IS NOT NULL),
      q AS (SELECT *, row_number() OVER (ORDER BY n_group DESC, regulator_code, id DESC) AS place FROM r) SELECT id, regulator_code, place::BIGINT AS place, n_group, n_group - count(*) OVER (PARTITION BY regulator_code) AS left_out FROM q WHERE place <= 50""",
    "listing_median": "SELECT event_type, quantile_cont(n, 0.5)::DOUBLE AS median, count(*) AS samples, max(n) AS peak FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1",
    "collapse_reason": """WITH r AS (SELECT user_id AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)::DOUBLE AS median,
        count(n) OVER (PARTITION BY source ORDER BY day RANGE BETWEEN INTERVAL 5 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS samples, lag(n) OVER (PARTITION BY source ORDER BY day) AS previous FROM r)
      SELECT source, strftime(day, '%Y-%m-%d') AS day, n, median, samples, previous, coalesce(dayofyear(day) > 5 AND samples >= 4 AND median >= 1 AND n < median * 0.4 AND previous < median * 0.4, false) AS collapsed FROM w""",
    "empty_discovery": """WITH r AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (WHERE event_type = 'purchase') AS n FROM events GROUP BY 1, 2),
      w AS (SELECT *, max(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS peak FROM r) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, peak FROM w WHERE n = 0 AND peak > 0""",
    "search_volume": "SELECT strftime(ts + INTERVAL '5 hours 30 minutes', '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE value > 50) AS found, count(*) FILTER (WHERE value IS NULL OR value <= 50) AS missed FROM events GROUP BY 1",
    "page_views_by_path": "SELECT event_type AS path, count(*) AS views FROM events GROUP BY 1",
    "page_views_by_slug": "SELECT coalesce(json_extract_string(props, '$.k'), '') AS slug, count(*) AS views FROM events GROUP BY 1",
    "page_views_daily": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS path, count(*) AS views FROM events GROUP BY 1, 2",
    "json_payload": "SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, max(k) AS most FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY 1",
    "rate_limit": "SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "retention_candidates": "SELECT id, regulator_code FROM (SELECT *, row_number() OVER (PARTITION BY regulator_code ORDER BY date_issued DESC NULLS LAST, id DESC) AS rn FROM document) WHERE rn > 200 AND NOT coalesce(is_amending OR doc_type = 'master_direction', false)",
    "keep_newest_n": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 2",
    "forget_old": "SELECT event_type, count(*) AS rows, count(CASE WHEN ts >= TIMESTAMP '2024-06-01' THEN props END) AS kept_text FROM events GROUP BY 1",
    "refresh_actions": f"""WITH {HISTORY}, tx AS (SELECT hist.*, text FROM hist JOIN body USING (version_id)), norm AS (SELECT *, lower(trim(regexp_replace(regexp_replace(text, '[“”‘’"'']', '', 'g'), '\\s+', ' ', 'g'))) AS nt FROM tx),
      held AS (SELECT * FROM norm WHERE (valid_from IS NULL OR valid_from <= DATE '2010-01-01') AND (valid_to IS NULL OR valid_to > DATE '2010-01-01'))
      SELECT CASE WHEN h.source_kind IS NULL AND h.text IS NULL THEN 'insert' WHEN h.nt = n.nt THEN 'unchanged' WHEN h.source_kind = 'official' AND h.valid_from = DATE '2010-01-01' THEN 'refresh' ELSE 'new_version' END AS action, CASE WHEN h.source_kind = 'machine_merged' THEN CASE WHEN h.nt = n.nt THEN 'matches_official' ELSE 'differs_from_official' END END AS verdict, count(*) AS n
      FROM (SELECT * FROM norm WHERE valid_to IS NULL) n LEFT JOIN held h USING (provision_id) GROUP BY 1, 2""",
    "upsert_titles": "SELECT n.regulator_code, n.title, coalesce(n.number, h.number) AS number FROM (SELECT * FROM document WHERE id IN (SELECT max(id) FROM document GROUP BY regulator_code)) n JOIN (SELECT * FROM document WHERE id IN (SELECT min(id) FROM document GROUP BY regulator_code)) h ON h.regulator_code = n.regulator_code",
    "job_states": f"""WITH e AS (SELECT user_id % 500 AS job_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'start' WHEN 'view' THEN 'fail' ELSE 'queue' END AS event, ts FROM events),
      j AS (SELECT job_id, last(event ORDER BY ts, event) AS last, max(ts) AS last_ts, count(*) FILTER (WHERE event = 'start') AS attempts, count(*) FILTER (WHERE event = 'fail') AS failures, (SELECT max(ts) FROM e) AS ending FROM e GROUP BY 1)
      SELECT {_STATE} AS state, count(*) AS n, sum(attempts)::BIGINT AS attempts FROM j GROUP BY 1""",
    "follow_hits": r"""WITH p AS (SELECT DISTINCT * FROM provision), f AS (SELECT id % 97 AS follower, id AS provision_id, instrument_id AS scope, trim(regexp_extract(number, '(\d+[A-Za-z]?)\s*$', 1)) AS number FROM p WHERE level = 'section'),
      l AS (SELECT DISTINCT created_by_document_id AS document_id, provision_id FROM provision_version WHERE created_by_document_id IS NOT NULL), s AS (SELECT DISTINCT document_id, instrument_id AS scope FROM l JOIN p ON p.id = provision_id)
      SELECT follower, document_id FROM l JOIN f USING (provision_id) WHERE number <> '' UNION
      SELECT follower, d.id FROM document d JOIN s ON s.document_id = d.id JOIN f USING (scope) WHERE f.number <> '' AND regexp_matches(title, '(?i)(^|[^0-9a-z])(section|sections|sec|rule|rules|regulation|regulations)\s*\.?\s*' || f.number || '([^0-9a-z]|$)')""",
    "since_last_visit": """SELECT reader, id, rn::INT AS rn FROM (SELECT r.id AS reader, d.id, row_number() OVER (PARTITION BY r.id ORDER BY first_seen_at DESC, d.id DESC) AS rn FROM document d JOIN regulator r ON r.code = regulator_code
      WHERE epoch_us(first_seen_at) > epoch_us(TIMESTAMP '2024-01-01') + r.id::BIGINT * 7 * 86400000000) WHERE rn <= 20""",
    "listing_rows": r"""SELECT 'cbic' AS source, id::VARCHAR AS key, 'Notification No. ' || notificationNo AS number, notificationName AS title, 'notification' AS doc_type, CASE WHEN lower(docFilePath) LIKE '%.pdf' THEN replace(docFilePath, '\', '/') END AS path FROM cbic_notifications_central_tax_2025
      UNION SELECT 'mca', docIdentifier, docName, CASE WHEN starts_with(shortDescription, docName || '-') THEN substring(shortDescription, length(docName) + 2) ELSE shortDescription END, CASE WHEN regexp_matches(upper(docName), '^G\.?S\.?R') THEN 'gsr' ELSE 'notification' END, to_base64(encode(link)) FROM mca_notifications_listing""",
    "chapter_runs": """WITH s AS (SELECT id, string_split(extracted_text, chr(10)) AS l FROM document WHERE extracted_text IS NOT NULL), x AS (SELECT id, unnest(l) AS line, unnest(range(len(l))) AS n FROM s), y AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) IS NOT DISTINCT FROM line AS same FROM x)
      SELECT id, count(*) AS lines FROM y WHERE NOT same GROUP BY 1""",
    "best_page": """WITH t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE length(text) > 0), g AS (SELECT doc_id, page, substring(t, page * 2000 + 1, 2000) AS t FROM (SELECT doc_id, t, unnest(range((length(t) - 1) // 2000 + 1)) AS page FROM t)),
      h AS (SELECT doc_id, page, contains(t, 'deposit')::INT + contains(t, 'registered')::INT + contains(t, 'authority')::INT + contains(t, 'circular')::INT AS hits FROM g)
      SELECT doc_id, page::INT AS page, hits::INT AS hits FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, page) AS rn FROM h) WHERE rn = 1 AND hits > 0""",
}
