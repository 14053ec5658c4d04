"""Queries of the general data problems: timestamps, histories, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import hierarchy as H
from lexmill.operators import history as V
from lexmill.operators import timestamps as T
from lexmill.plans.catalogue import HISTORY
from lexmill.tables import table


def _feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cbic = T.feed_rows(table(spark, sf_dir, "cbic_notifications_central_tax_2025"), "cbic", "id", {"notificationDt": None, "createdDt": "nodeZone"}, False, F.col("orderId"))
    mca = T.feed_rows(table(spark, sf_dir, "mca_notifications_listing"), "mca", "docIdentifier", {"UploadDate": "uploadZone", "notificationdate": None}, True, F.regexp_extract("docIdentifier", r"(\d{1,18})$", 1).try_cast("long"))
    return cbic.unionByName(mca)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.normalise_timestamps(_feeds(spark, sf_dir))


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset history chosen for rows that state no zone, with its violations."""
    return T.estimate_zones(T._with_instants(_feeds(spark, sf_dir)))


def _collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "provision_version").select(F.col("provision_id").alias("entity"), "id", "text", "source_kind", "effective_from", "effective_to", "created_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = V.full_history(_collected(spark, sf_dir), "2024-01-01")
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    return chains.select(F.col("entity").alias("provision_id"), day("valid_from").alias("valid_from"), day("valid_to").alias("valid_to"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "provision").select("id", F.col("instrument_id").alias("scope"), "parent_id", "parent_number", "number")
    return H.resolve_parents(rows)


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every provision of a tree with each of its descendants."""
    return H.ancestor_pairs(_edges(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = H.hierarchy(_edges(spark, sf_dir))
    return tree.select(F.col("node").alias("provision_id"), F.col("root").alias("root_id"), "depth", "n_descendants", "path", "state")


QUERIES = {"p2_found": p2_found, "p2_zones": p2_zones, "p3_found": p3_found, "p5_found": p5_found, "p5_descendants": p5_descendants}

#: The parents, and the paths from the roots down, as SQL.
_DOWN = r"""
WITH RECURSIVE q AS (SELECT DISTINCT id, instrument_id AS s, parent_id, lower(regexp_replace(parent_number, '[ \t\r\n]+', '', 'g')) AS w, lower(regexp_replace(number, '[ \t\r\n]+', '', 'g')) AS n FROM provision WHERE id IS NOT NULL),
numbers AS (SELECT s, n, min(id) AS id FROM q WHERE s IS NOT NULL AND n IS NOT NULL GROUP BY 1, 2),
e AS (SELECT q.id, CASE WHEN b.id IS NOT NULL THEN b.id ELSE m.id END AS parent FROM q LEFT JOIN q b ON b.id = q.parent_id LEFT JOIN numbers m ON m.s = q.s AND m.n = q.w),
down AS (SELECT id, [id] AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.id, list_append(down.path, e.id) FROM down JOIN e ON e.parent = down.id),
"""

SQL = {
    "p3_found": f"WITH {HISTORY} SELECT provision_id, coalesce(strftime(valid_from, '%Y-%m-%d'), '') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d'), '') AS valid_to FROM hist",
    "p5_found": _DOWN + r"""up AS (SELECT id AS start, parent AS cur FROM e WHERE id NOT IN (SELECT id FROM down) UNION SELECT start, parent FROM up JOIN e ON e.id = up.cur),
pairs AS (SELECT unnest(path[:-2]) AS id FROM down), below AS (SELECT id, count(*) AS n FROM pairs GROUP BY 1)
SELECT down.id AS provision_id, path[1] AS root_id, len(path) - 1 AS depth, coalesce(n, 0) AS n_descendants, array_to_string(path, '/') AS path, 'tree' AS state FROM down LEFT JOIN below USING (id)
UNION ALL SELECT start, -1, -1, -1, '', CASE WHEN bool_or(start = cur) THEN 'cycle' ELSE 'below_cycle' END FROM up GROUP BY start""",
    "p5_descendants": _DOWN.rstrip().rstrip(",") + " SELECT path[i] AS ancestor, id AS node, len(path) - i AS distance FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM down)",
}
