"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import neardup, packing, quality, repeated, scanned, splitting, tokens
from lexmill.session import materialise
from lexmill.tables import table


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document").select(F.col("id").alias("document_id"), F.col("regulator_code").alias("source"), F.col("extracted_text").alias("text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated.repeated_lines(_by_source(spark, sf_dir)).select("document_id", "line_no")


def p1_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated.frequent_sequences(_by_source(spark, sf_dir))
    return found.select("source", F.array_join(F.transform("sequence", lambda x: x.cast("string")), "/").alias("sequence"), "n_docs", "total")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _by_source(spark, sf_dir)
    return repeated.without_lines(documents, repeated.repeated_lines(documents)).select("document_id", "text")


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scanned items, clean texts) of pdf_text and document."""
    pdf = table(spark, sf_dir, "pdf_text").select("attachment_id", "document_id", F.coalesce("ocr_used", F.lit(False)).alias("ocr"), "text")
    document = table(spark, sf_dir, "document").select("id", "title", F.col("extracted_text").alias("text"))
    moved = pdf.where("ocr AND text IS NULL").select(F.col("document_id").alias("id")).distinct()
    titles = document.select(F.col("id").alias("document_id"), "title")
    of_pdf = pdf.where("ocr AND text IS NOT NULL").join(titles, "document_id", "left").select(F.lit("pdf_text").alias("item_table"), F.col("attachment_id").alias("item_id"), "title", "text")
    of_document = document.where("text IS NOT NULL").join(moved, "id", "left_semi").select(F.lit("document").alias("item_table"), F.col("id").alias("item_id"), "title", "text")
    clean = document.where("text IS NOT NULL").join(moved, "id", "left_anti").select("text").unionByName(pdf.where("NOT ocr AND text IS NOT NULL").select("text"))
    return of_pdf.unionByName(of_document), clean


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.noise(*_scans(spark, sf_dir))


def p4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(*_scans(spark, sf_dir)).select("item_table", "item_id", F.posexplode("paragraphs").alias("n", "text")).select("item_table", "item_id", (F.col("n") + 1).cast("long").alias("paragraph_no"), "text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "document").select("id", "title", F.col("extracted_text").alias("text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.expand(*neardup.near_duplicates(_records(spark, sf_dir), size=3, similarity=(7, 10), min_words=120))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that counts, with its class, its group and its number of pairs."""
    return neardup.groups(*neardup.near_duplicates(_records(spark, sf_dir), size=3, similarity=(7, 10), min_words=120))


def _long_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = table(spark, sf_dir, "document").select(F.lit("document").alias("item_table"), F.col("id").alias("item_id"), F.col("extracted_text").alias("text"))
    version = table(spark, sf_dir, "provision_version").select(F.lit("provision_version").alias("item_table"), F.col("id").alias("item_id"), "text")
    return document.unionByName(version)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_long_items(spark, sf_dir)).select("item_table", "item_id", "boundary").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.piece_rows(splitting.split_oversized(_long_items(spark, sf_dir))).distinct()


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.decode_ids(tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")).select(F.col("id").alias("doc_id"), "text")


def p8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_offsets(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "starts", "ends")


def p9_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = materialise(tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.pack(sizes, 2048).select(F.col("id").alias("doc_id"), "part_no", F.col("first").alias("first_token"), F.col("size").alias("n_tokens"), F.col("container").alias("container_id"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assignment measured: no container over 2,048, no text split that fits, all tokens placed."""
    sizes = materialise(tokens.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return packing.checked(materialise(packing.pack(sizes, 2048)), sizes, 2048)


def _common(spark: SparkSession, sf_dir: str) -> frozenset[str]:
    """The table of function words does not grow."""
    return frozenset(r["word"].lower() for r in table(spark, sf_dir, "common_word").where("word IS NOT NULL").collect())


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.statistics(table(spark, sf_dir, "documents"), "doc_id", "text", _common(spark, sf_dir))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = quality.text_kinds(materialise(_statistics(spark, sf_dir)))
    return kinds.where("kind <> 'prose'").select(F.col("id").alias("doc_id"), "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each text, shares to six digits."""
    rows = _statistics(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), "n_words", *(F.round(c, 6).alias(c) for c in quality.PLAIN[1:]))


def p10_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was learnt of each labelling function."""
    return quality.accuracies(materialise(_statistics(spark, sf_dir)))


_P1 = r"""
WITH docs AS (SELECT id, regulator_code AS r, extracted_text AS t FROM document WHERE extracted_text IS NOT NULL AND regulator_code IS NOT NULL),
split AS (SELECT id, r, string_split(t, chr(10)) AS l FROM docs),
lines AS (SELECT id, r, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS line_no FROM split),
keyed AS (SELECT id, r, line_no, regexp_replace(lower(line), '[^\p{L}\p{M}]+', '', 'g') AS k FROM lines),
counted AS (SELECT r, k, count(DISTINCT id) AS n FROM keyed WHERE length(k) >= 12 GROUP BY r, k),
total AS (SELECT r, count(*) AS n FROM docs GROUP BY r)
SELECT keyed.id AS document_id, keyed.line_no FROM keyed JOIN counted USING (r, k) JOIN total ON total.r = keyed.r WHERE counted.n >= 5 AND counted.n * 20 >= total.n
"""

_P6 = r"""
WITH items AS (
  SELECT 'document' AS item_table, id AS item_id, extracted_text AS text FROM document WHERE length(extracted_text) > 2000
  UNION SELECT 'provision_version', id, text FROM provision_version WHERE length(text) > 2000),
cuts AS (
  SELECT item_table, item_id,
    regexp_replace(text, '\n[ \t\r\n]*\n', chr(1), 'g') AS paragraphs,
    regexp_replace(regexp_replace(text, '\n[ \t\r\n]*\n', chr(1), 'g'), '\n', chr(1), 'g') AS lines,
    regexp_replace(regexp_replace(regexp_replace(text, '([.?!;।])[ \t\r\n]+', '\1' || chr(1), 'g'), '\n[ \t\r\n]*\n', chr(1), 'g'), '\n', chr(1), 'g') AS sentences,
    regexp_replace(text, '[ \t\r\n]+', chr(1), 'g') AS words
  FROM items),
most AS (
  SELECT item_table, item_id,
    list_max(list_transform(string_split(paragraphs, chr(1)), lambda x: length(x))) AS p, list_max(list_transform(string_split(lines, chr(1)), lambda x: length(x))) AS l,
    list_max(list_transform(string_split(sentences, chr(1)), lambda x: length(x))) AS s, list_max(list_transform(string_split(words, chr(1)), lambda x: length(x))) AS w
  FROM cuts)
SELECT item_table, item_id,
  CASE WHEN p <= 2000 THEN 'paragraph' WHEN l <= 2000 THEN 'line' WHEN s <= 2000 THEN 'sentence' WHEN w <= 2000 THEN 'space' ELSE 'none' END AS boundary
FROM most
"""


#: Every pair of texts that share a shingle is counted, so this is for tables of some thousand documents.
_P7 = r"""
WITH d AS (SELECT id, regexp_extract_all(lower(extracted_text), '[\p{L}\p{M}\p{N}]+') AS b, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{M}\p{N}]+') AS t FROM document WHERE extracted_text IS NOT NULL),
w AS (SELECT id, list_concat(t, b) AS w FROM d WHERE len(b) >= 120),
s AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM c JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c * 10 >= 7 * (x.n + y.n - c)
"""


_P7_GROUPS = (
    "WITH RECURSIVE" + _P7.lstrip().removeprefix("WITH").replace("SELECT id_a, id_b FROM c JOIN", ", pairs AS (SELECT id_a, id_b, c = x.n AND c = y.n AS same FROM c JOIN").rstrip()
    + """), both_ AS (SELECT id_a AS a, id_b AS b, same FROM pairs UNION ALL SELECT id_b, id_a, same FROM pairs),
r AS (SELECT id, id AS g FROM n UNION SELECT b, r.g FROM r JOIN both_ ON both_.a = r.id)
SELECT n.id, least(n.id, coalesce((SELECT min(b) FROM both_ WHERE a = n.id AND same), n.id)) AS class_id, (SELECT min(g) FROM r WHERE r.id = n.id) AS group_id, (SELECT count(*) FROM both_ WHERE a = n.id) AS n_links FROM n"""
)

_P10 = r"""
WITH c AS (SELECT list(DISTINCT lower(word)) AS c FROM common_word WHERE word IS NOT NULL),
t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
x AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[ \t\r\n]+'), lambda w: w <> '') AS w, regexp_extract_all(t, '[\p{L}\p{M}]+') AS l,
        list_filter(list_transform(string_split(t, chr(10)), lambda s: trim(s, chr(32) || chr(9) || chr(13))), lambda s: s <> '') AS s FROM t),
n AS (SELECT doc_id, w, l, s, len(w) AS n, list_sum(list_transform(w, lambda a: length(a)))::BIGINT AS dense, coalesce(list_sum(list_transform(l, lambda a: length(a))), 0)::BIGINT AS letters,
        length(regexp_replace(t, '[^\p{Nd}]+', '', 'g')) AS digits, len(list_filter(l, lambda a: list_contains(c, a))) AS known, len(list_filter(s, lambda a: right(a, 1) IN ('.', '?', '!', ':', ';', '।'))) AS ended FROM x, c)
SELECT doc_id, n AS n_words, CASE WHEN n > 0 THEN round(dense::DOUBLE / n, 6) END AS mean_word_length, CASE WHEN n > 0 THEN round((dense - letters - digits)::DOUBLE / dense, 6) END AS symbol_share,
  CASE WHEN n > 0 THEN round(ended::DOUBLE / len(s), 6) END AS punctuated_lines, CASE WHEN n > 0 THEN CASE WHEN len(l) > 0 THEN round(known::DOUBLE / len(l), 6) ELSE 0.0 END END AS common_share,
  CASE WHEN n > 0 THEN round(digits::DOUBLE / dense, 6) END AS digit_share, CASE WHEN n > 0 THEN round(len(list_distinct(w))::DOUBLE / n, 6) END AS distinct_share, CASE WHEN n > 0 THEN round(n::DOUBLE / len(s), 6) END AS words_a_line
FROM n
"""


def queries() -> dict:
    return {"p1_found": p1_found, "p1_sequences": p1_sequences, "p1_clean": p1_clean, "p4_found": p4_found, "p4_paragraphs": p4_paragraphs, "p7_found": p7_found, "p7_groups": p7_groups, "p6_found": p6_found, "p6_pieces": p6_pieces, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p8_offsets": p8_offsets, "p9_assigned": p9_assigned, "p9_check": p9_check, "p10_found": p10_found, "p10_statistics": p10_statistics, "p10_accuracies": p10_accuracies}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p6_found": _P6, "p7_found": _P7, "p7_groups": _P7_GROUPS, "p10_statistics": _P10}
