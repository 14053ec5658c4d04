"""Full-text search: analysis of texts to postings, a query language, matching, rank and headline.

Postings (doc, lexeme, positions) are a dataset: analysed once, stored bucketed or partitioned by lexeme. A search reads only the postings of
its lexemes, brings them together by document and decides there; texts are read again only for the documents shown. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.stemming import stem
from lexmill.session import spread

#: Words that are not indexed.
STOP = frozenset(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down during each few for from further had has have having he her here hers "
    "herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves".split()
)
_TOKEN = re.compile(r"[^\W_]+(?:[.'’-][^\W_]+)*")
#: Positions after which rows are handed on, so that long texts do not add up in a worker.
FLUSH = 1_000_000


def lexemes(text: str) -> list[tuple[str, int]]:
    """(lexeme, position) of a text; stop words take a position but are not indexed."""
    out = []
    for at, m in enumerate(_TOKEN.finditer(text.lower()), 1):
        for part in re.split("[.'’-]", m.group()):
            if part and part not in STOP:
                out.append((stem(part), at))
    return out


class _Analyser:
    """Lexemes with the parts of each token looked up once."""

    def __init__(self):
        self.parts: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str) -> dict[str, list[int]]:
        found: dict[str, list[int]] = {}
        parts = self.parts
        for at, token in enumerate(_TOKEN.findall(text.lower()), 1):
            known = parts.get(token)
            if known is None:
                if len(parts) > 500_000:
                    parts.clear()
                known = parts[token] = tuple(x for x, _ in lexemes(token))
            for x in known:
                found.setdefault(x, []).append(at)
        return found


def parse(query: str) -> list[list[tuple[bool, list[str]]]]:
    """Alternatives of conjunctions of (wanted, phrase); words are conjoined, `or` divides, quotes make phrases, a dash negates."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for negative, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not negative and not quoted:
            alternatives.append([])
            continue
        phrase = [x for x, _ in lexemes(quoted or word)]
        if phrase:
            alternatives[-1].append((not negative, phrase))
    return [a for a in alternatives if a]


def _postings(ids: list[int], words: list[str], places: list[list[int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(places, pa.list_(pa.int32()))], ["doc", "lexeme", "positions"])


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    analyse = _Analyser()
    for batch in batches:
        ids, words, places, held = [], [], [], 0
        for doc, text in zip(batch.column(0), batch.column(1)):
            found = analyse(text.as_py() or "")
            ids += [doc.as_py()] * len(found)
            words += found
            places += found.values()
            held += sum(map(len, found.values()))
            if held >= FLUSH:
                yield _postings(ids, words, places)
                ids, words, places, held = [], [], [], 0
        yield _postings(ids, words, places)


def postings(texts: DataFrame) -> DataFrame:
    """(doc, lexeme, positions) of rows (doc, text)."""
    return spread(texts.select(F.col("doc").cast("long"), "text")).mapInArrow(_analyse, "doc bigint, lexeme string, positions array<int>")


def _followed(positions: Column, by: int):
    return lambda start: F.array_contains(positions, start + by)


def search(index: DataFrame, query: str) -> DataFrame:
    """(doc, rank) of the documents that match.

    Rank follows the published formula of the default weights: for a lexeme at its k-th occurrence, w / k**2, summed and scaled by
    1.64493406685, over the number of lexemes.
    """
    alternatives = parse(query)
    if not alternatives:
        return index.select("doc", F.lit(0.0).alias("rank")).limit(0)
    wanted = sorted({x for a in alternatives for _, p in a for x in p})
    rows = index.where(F.col("lexeme").isin(wanted))
    by_doc = rows.groupBy("doc").agg(*(F.flatten(F.collect_list(F.when(F.col("lexeme") == x, F.col("positions")))).alias(f"x{i}") for i, x in enumerate(wanted)))
    of = {x: F.col(f"x{i}") for i, x in enumerate(wanted)}

    def holds(phrase: list[str]):
        starts = of[phrase[0]]
        for k, x in enumerate(phrase[1:], 1):
            starts = F.filter(starts, _followed(of[x], k))
        return F.size(starts) > 0

    def both(terms):
        out = F.lit(True)
        for good, phrase in terms:
            out = out & (holds(phrase) if good else ~holds(phrase))
        return out

    match = F.lit(False)
    for a in alternatives:
        match = match | both(a)
    positive = sorted({x for a in alternatives for good, p in a if good for x in p})
    each = [F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(of[x]), F.lit(1))), F.lit(0.0), lambda s, k: s + F.lit(1.0) / (k * k)) * F.when(F.size(of[x]) > 0, 0.1).otherwise(0.0) for x in positive]
    rank = (sum(each[1:], each[0]) / 1.64493406685 / len(positive)) if each else F.lit(0.0)
    return by_doc.where(match).select("doc", F.round(rank, 6).alias("rank"))


def headline(text: str, query: str, words: int = 30) -> str:
    """The stretch of the text with most of the query's lexemes, these in <b>; the first of several."""
    good = {x for a in parse(query) for wanted, p in a if wanted for x in p}
    known: dict[str, bool] = {}
    tokens = [(m.start(), m.end(), known[w] if (w := m.group().lower()) in known else known.setdefault(w, stem(w) in good)) for m in _TOKEN.finditer(text)]
    if not tokens:
        return text[:200]
    before = [0, *accumulate(t[2] for t in tokens)]
    best = max(range(len(tokens)), key=lambda i: before[min(i + words, len(tokens))] - before[i])
    chosen = tokens[best : best + words]
    out, at = [], chosen[0][0]
    for a, b, hit in chosen:
        out += [text[at:a], f"<b>{text[a:b]}</b>" if hit else text[a:b]]
        at = b
    return "".join(out)
