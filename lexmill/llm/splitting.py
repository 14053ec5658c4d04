"""Splitting oversized texts at natural boundaries.

A text over the limit is cut by a hierarchy of separators: section, paragraph, line, sentence, space, character. Each level splits only
what the level above left too long, and the deepest level a text needs is its boundary. The units are packed greedily into pieces of at most ``limit``
characters; a piece begins with up to ``overlap`` characters of the end of the one before: from a sentence start if there is one, else from a
word start, else from a character. Only a next unit that leaves less room makes the overlap shorter. A section starts with a heading (a chapter, a number, a line in
capitals) after an empty line, so its boundaries are boundaries of paragraphs and the boundary given is ``paragraph``.

Pieces are [start, end) ranges of the text, so ``text[start:end]`` of all pieces, overlaps once, is the text again: every
character lies in a piece and none is changed. Separators belong to the unit before them and may be cut where they would
push a piece over the limit. Where characters are cut apart, marks stay with the letter before them.

Defined results: null and empty texts, and texts of at most ``limit`` characters, are no items here; texts of any length are read
whole; equal rows give equal pieces; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import spread

_W = r"[ \t\r\n]"
_PARAGRAPH = rf"\n{_W}*\n"
_HEADING = r"(?=(?:CHAPTER|PART|SCHEDULE|ANNEX\w*|APPENDIX|Chapter|Part|Schedule|Annex\w*|Appendix)\b|#{1,6} |\d{1,3}(?:\.\d{1,3})*[A-Z]{0,2}[.)] |[A-Z][A-Z ,&-]{6,80}(?:\n|$))"
#: Of each level: the boundary it stands for, and the pattern of all its boundaries and of those before it.
KINDS = (
    ("paragraph", re.compile(_PARAGRAPH + _HEADING)),
    ("paragraph", re.compile(_PARAGRAPH)),
    ("line", re.compile(rf"{_PARAGRAPH}|\n")),
    ("sentence", re.compile(rf"{_PARAGRAPH}|\n|(?<=[.?!;।]){_W}+")),
    ("space", re.compile(rf"{_W}+")),
)
NONE = len(KINDS)


def _characters(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    while end - start > size:
        cut = start + size
        while cut > start + 1 and unicodedata.category(text[cut])[0] == "M":
            cut -= 1
        if cut == start + 1:
            cut = start + size
        yield start, cut
        start = cut
    if end > start:
        yield start, end


def units(text: str, start: int, end: int, limit: int, overlap: int, level: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, level) of ranges of at most ``limit`` characters that make up text[start:end], each cut at the highest level that does."""
    if end - start <= limit:
        if end > start:
            yield start, end, level
        return
    if level == NONE:
        for a, b in _characters(text, start, end, max(1, min(overlap or limit, limit - overlap))):
            yield a, b, NONE
        return
    pattern, at = KINDS[level][1], start
    for m in pattern.finditer(text, start, end):
        body, stop = m.span()
        if stop - at <= limit:
            yield at, stop, level
        else:
            if body - at > limit:
                yield from units(text, at, body, limit, overlap, level + 1)
            elif body > at:
                yield at, body, level
            for a, b in _characters(text, body, stop, limit):
                yield a, b, level
        at = stop
    if end - at > limit:
        yield from units(text, at, end, limit, overlap, level + 1)
    elif end > at:
        yield at, end, level


def split(text: str, limit: int = 2000, overlap: int = 200) -> tuple[str, list[tuple[int, int]]]:
    """(boundary, pieces) of a text over the limit: the kind of its deepest level, and ranges of which consecutive ones share up to ``overlap`` characters."""
    pieces: list[tuple[int, int]] = []
    start = end = deepest = 0
    for a, b, level in units(text, 0, len(text), limit, overlap):
        deepest = max(deepest, level)
        if b - start > limit and end > start:
            pieces.append((start, end))
            start = _resume(text, max(start + 1, end - min(overlap, limit - (b - a))), end)
        end = b
    if end > start:
        pieces.append((start, end))
    return KINDS[deepest][0] if deepest < NONE else "none", pieces


def _resume(text: str, low: int, end: int) -> int:
    """Where the next piece starts in [low, end]: the first sentence start, else the first word start, else ``low``."""
    if low >= end:
        return end
    for _, pattern in KINDS[3:]:
        for m in pattern.finditer(text, low - 1, end):
            if low <= m.end() < end:
                return m.end()
    while low < end and unicodedata.category(text[low])[0] == "M":
        low += 1
    return low


def _batches(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables, ids, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        found = [split(t, limit, overlap) for t in texts]
        kinds = [k for k, _ in found]
        pieces = pa.array([[{"start": a, "end": b} for a, b in p] for _, p in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.record_batch([tables, ids, pa.array(kinds, pa.string()), pieces], ["item_table", "item_id", "boundary", "pieces"])


def split_oversized(items: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """(item_table, item_id, boundary, pieces) of items (item_table, item_id, text) longer than ``limit`` characters."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than the limit")
    long = items.where(F.length("text") > limit).select("item_table", F.col("item_id").cast("long").alias("item_id"), "text")
    return spread(long).mapInArrow(partial(_batches, limit=limit, overlap=overlap), "item_table string, item_id bigint, boundary string, pieces array<struct<start:bigint,end:bigint>>")


def piece_rows(split_items: DataFrame) -> DataFrame:
    """(item_table, item_id, piece_no, start, end, boundary): one row a piece, counted from 1."""
    return split_items.select("item_table", "item_id", "boundary", F.posexplode("pieces").alias("_n", "_p")).select(
        "item_table", "item_id", (F.col("_n") + 1).cast("long").alias("piece_no"), F.col("_p.start").alias("start"), F.col("_p.end").alias("end"), "boundary"
    )
