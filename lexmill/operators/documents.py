"""Text functions over tables: each runs once a row over Arrow batches and returns structs that are exploded and joined as relations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import markup as M
from lexmill.functions import pagemap as P
from lexmill.functions import texts as T
from lexmill.operators.catalogue import unique_provisions
from lexmill.session import spread


def _apply(batches: Iterator[pa.RecordBatch], f: Callable, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(1, batch.num_columns)))
        yield pa.record_batch([batch.column(0), pa.array([f(*r) for r in rows], kind)], ["id", "x"])


def _each(rows: DataFrame, f: Callable, kind: pa.DataType, ddl: str) -> DataFrame:
    """(id, x) of rows (id, *arguments of f)."""
    return spread(rows).mapInArrow(partial(_apply, f=f, kind=kind), f"id bigint, x {ddl}")


def _split(style: str | None, text: str | None) -> list[dict]:
    return T.split_provisions(text, style or "auto") if text else []


_PROVISION = pa.list_(pa.struct([*((n, pa.string()) for n in ("number", "heading", "text", "level", "parent_number", "chapter")), ("footnotes", pa.list_(pa.string()))]))


def provisions(rows: DataFrame) -> DataFrame:
    """(id, place, number, heading, text, level, parent_number, chapter, footnotes) of rows (id, style, text); a null style is auto."""
    names = ("number", "heading", "text", "level", "parent_number", "chapter")
    out = _each(rows.select("id", "style", "text"), _split, _PROVISION, "array<struct<" + ",".join(f"{n}:string" for n in names) + ",footnotes:array<string>>>")
    return out.select("id", F.posexplode("x").alias("place", "p")).select("id", "place", "p.*")


def _diff(a: str | None, b: str | None) -> list[tuple[str, str]]:
    return [{"kind": k, "text": t} for k, t in T.diff_words(a or "", b or "")]


def differences(pairs: DataFrame) -> DataFrame:
    """(id, place, kind, text) runs of rows (id, before, after)."""
    out = _each(pairs, _diff, pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])), "array<struct<kind:string,text:string>>")
    return out.select("id", F.posexplode("x").alias("place", "r")).select("id", "place", "r.*")


def _ratio(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else round(T.similarity(a, b), 6)


def similarities(pairs: DataFrame) -> DataFrame:
    """(id, similarity) of rows (id, before, after)."""
    return _each(pairs, _ratio, pa.float64(), "double").withColumnRenamed("x", "similarity")


def _cite(text: str | None) -> list[dict]:
    return T.citations(text) if text else []


def cited(rows: DataFrame) -> DataFrame:
    """(id, kind, number, start, end) of rows (id, text)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    out = _each(rows, _cite, kind, "array<struct<kind:string,number:string,start:int,end:int>>")
    return out.select("id", F.explode("x").alias("c")).select("id", "c.*")


def _tag(title: str | None, doc_type: str | None, text: str | None) -> dict:
    return T.tag_document(title or "", doc_type or "", text or "")


def tags(rows: DataFrame) -> DataFrame:
    """(id, is_amending, relation, effects) of rows (id, title, doc_type, text)."""
    effect = pa.struct([("kind", pa.string()), ("number", pa.string()), ("change", pa.string())])
    kind = pa.struct([("is_amending", pa.bool_()), ("relation", pa.string()), ("effects", pa.list_(effect))])
    return _each(rows, _tag, kind, "struct<is_amending:boolean,relation:string,effects:array<struct<kind:string,number:string,change:string>>>").select("id", "x.*")


def _html(html: str | None) -> str | None:
    return None if html is None else T.html_to_text(html)


def texts_of_html(rows: DataFrame) -> DataFrame:
    """(id, text) of rows (id, html)."""
    return _each(rows, _html, pa.string(), "string").withColumnRenamed("x", "text")


def _clean(html: str | None) -> str | None:
    return None if html is None else M.clean_html(html)


def cleaned_html(rows: DataFrame) -> DataFrame:
    """(id, html) of rows (id, html): the markup that is safe to show."""
    return _each(rows, _clean, pa.string(), "string").withColumnRenamed("x", "html")


#: Lines of a page of a text that has lost its page ends; form feeds are page ends.
PAGE_LINES = 45


def _place(style: str | None, text: str | None) -> list[dict]:
    if not text:
        return []
    lines = text.split("\n")
    pages = text.split("\f") if "\f" in text else ["\n".join(lines[k : k + PAGE_LINES]) for k in range(0, len(lines), PAGE_LINES)]
    parts = T.split_provisions(text.replace("\f", "\n"), style or "auto")
    found = P.find_pages(pages, [(p["number"], p["heading"], p["level"]) for p in parts])
    return [{"number": p["number"], "level": p["level"], "page": n} for p, n in zip(parts, found)]


def page_map(rows: DataFrame) -> DataFrame:
    """(id, place, number, level, page) of rows (id, style, text): the page on which each provision of a paged text begins, null where none is sure."""
    kind = pa.list_(pa.struct([("number", pa.string()), ("level", pa.string()), ("page", pa.int32())]))
    out = _each(rows.select("id", "style", "text"), _place, kind, "array<struct<number:string,level:string,page:int>>")
    return out.select("id", F.posexplode("x").alias("place", "p")).select("id", "place", "p.*")


def found_provisions(provision: DataFrame, instrument: DataFrame, hits: DataFrame, limit: int, by: str | None = None) -> DataFrame:
    """(instrument_id, id, rank, place) of hits (doc, rank) among provisions: the ``limit`` best, in all or of each value of ``by``, without instruments served as files alone."""
    served = instrument.where(~F.col("pdf_only").eqNullSafe(True)).select(F.col("id").alias("instrument_id"))
    rows = hits.withColumnRenamed("doc", "id").join(unique_provisions(provision).select("id", "instrument_id"), "id").join(served, "instrument_id", "left_semi")
    order = [F.col("rank").desc(), F.col("id")]
    if by is None:
        rows = rows.orderBy(*order).limit(limit)  # so that only these are ranked in one task
    w = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    return rows.withColumn("place", F.row_number().over(w.orderBy(*order))).where(F.col("place") <= limit).select("instrument_id", "id", "rank", "place")


#: Ranks of a document found by its number, in full or in part, and how many of these are shown.
EXACT, PARTLY, NUMBERED = 100.0, 50.0, 20


def found_documents(document: DataFrame, hits: DataFrame, number: str, limit: int | None = None) -> DataFrame:
    """(id, tier, rank, place) of documents: first those whose number holds ``number``, the newest ``NUMBERED``, then hits (doc, rank) that are not among them; the
    ``limit`` best of both, or all hits."""
    newest = F.col("date_issued").desc_nulls_last()
    exact = F.when(F.lower("number") == number.lower(), EXACT).otherwise(PARTLY)
    most = NUMBERED if limit is None else min(limit, NUMBERED)
    named = document.where(F.contains(F.lower("number"), F.lit(number.lower()))).withColumn("rank", exact).orderBy(F.col("rank").desc(), newest, F.col("id").desc()).limit(most)
    named = named.select("id", F.lit(1).alias("tier"), "rank", "date_issued")
    other = hits.withColumnRenamed("doc", "id").join(named.select("id"), "id", "left_anti").join(document.select("id", "date_issued"), "id")
    if limit is not None:
        other = other.orderBy(F.col("rank").desc(), newest, F.col("id").desc()).limit(limit)
    rows = named.unionByName(other.select("id", F.lit(2).alias("tier"), "rank", "date_issued"))
    if limit is None:
        return rows.select("id", "tier", "rank")
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", F.col("rank").desc(), newest, F.col("id").desc()))
    return rows.withColumn("place", place).select("id", "tier", "rank", "place")
