"""Sinks: CSV files, feed entries, JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ("id", "regulator_code", "doc_type", "number", "title", "date_issued", "date_effective", "official_page", "filename")


def csv(rows: DataFrame, path: str, columns: tuple[str, ...] = DOCUMENT_COLUMNS) -> None:
    """Quoted only where a value needs it, quotes doubled."""
    rows.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def answers(rows: DataFrame, clip: int = 80) -> DataFrame:
    """Suggestion rows as JSON, long texts clipped."""
    text = F.when(F.length("text") > clip, F.concat(F.substring("text", 1, clip), F.lit("…"))).otherwise(F.col("text"))
    return rows.select(F.to_json(F.struct("grp", "exact", text.alias("text"), "id")).alias("value"))
