"""Noise in text from scanned pages: page furniture, words hyphenated across lines, misrecognised characters; and its repair.

A lexicon of the clean texts' words with their frequencies is the measure of what is a word. Within an item, page numbers, running headers and footers
are told by their form, by repetition and by lines that break off where the next word would have fitted. A line that ends in a mark
is a break if the word without the mark is more frequent than the word with it. A word of a scan that the lexicon lacks is looked up in a
symmetric-delete index: it and the lexicon's words are folded over single confusable characters and lose up to two characters, but keep ``KEPT``; short words
are read back through the confusion pairs instead. Words that meet are compared by an edit distance in which the confusion pairs of recognition are cheap
and one other edit (a letter lost, added, changed or swapped) is dear. The repair is the candidate with the least sum of distance and surprise: how rarely clean texts have it
beside the same neighbours, and at all. A word that only a plain edit explains is misread where clean texts have the repair beside both neighbours.
``noise`` tells what is wrong where, ``repaired`` gives continuous paragraphs.

The lexicon is a distributed table; a word in it is known, whatever its rank, and has no repair. Only its ``COMMON`` most frequent words are sent
to the workers, as a filter that spares lookups; all other words are looked up by joins on distinct words under the same rules, so no result
depends on the size of that filter.

Defined results: null texts and texts of unscanned items have no cases; an empty text has none; lines are counted from 1 between LF; CR counts as
white space; a line of furniture is neither break nor misread; equal rows give equal results; an empty lexicon repairs nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialise, materialise_counted, spread

COMMON = 50_000
#: Words seen less often in clean texts are looked up in the index; a repair must be this frequent.
RARE, FREQUENT = 2, 5
#: Characters that a key of the index keeps at least; up to which length words are read back; from which length on only both ends are indexed, and how much of them.
KEPT, SHORT, LONG, ENDS = 3, 5, 40, 20
#: Costs of a confusion pair and of any other edit, and the limit of a word. Plain edits are tried from so many letters on, for repairs this frequent.
PAIR, PLAIN, LIMIT = 0.25, 0.78, 0.8
PLAIN_LENGTH, PLAIN_FREQUENT = 6, 20
MARKS = "-­¬‐"
#: What recognition reads, and what was printed.
CONFUSED = (
    ("c", "e"), ("f", "t"), ("f", "e"), ("0", "o"), ("o", "0"), ("ri", "n"), ("5", "s"), ("@", "a"), ("cl", "d"), ("1", "l"), ("1", "i"), ("ii", "u"), ("!", "i"), ("!", "l"),
    ("b", "h"), ("rn", "m"), ("9", "g"), ("m", "in"), ("m", "rn"), ("vv", "w"), ("l", "i"), ("i", "l"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("h", "li"), ("d", "cl"), ("$", "s"), ("z", "2"), ("8", "b"),
    ("6", "b"), ("nn", "m"), ("n", "ri"), ("w", "vv"), ("u", "ii"), ("e", "c"), ("h", "b"), ("t", "f"), ("|", "l"), ("|", "i"), ("q", "g"),
)
_FOLD = str.maketrans({"0": "o", "5": "s", "$": "s", "@": "a", "1": "i", "!": "i", "|": "i", "l": "i", "9": "g", "q": "g", "c": "e", "f": "t", "b": "h", "8": "h", "6": "h", "z": "2"})
_PUNCT = ".,;:()[]{}“”\"‘’'?…–—₹/ "
#: Digits that stand apart or together; a single one next to a letter may be a misread letter.
_DIGITS = re.compile(r"(?<![^\W\d_])\d+(?![^\W\d_])|\d{2,}").sub
_N = r"(?:\d{1,4}|[0-9oOlIzZ]{1,4}|[ivxlcdm]{1,7})"
_PAGE = re.compile(
    rf"^(?:[-–—*~\[(<|. ]*{_N}[-–—*~\])>|  ]*|[-–—\[( ]*(?:p[a@][g9][ec]|pg|p)\.?\s*(?:no\.?)?\s*{_N}(?:\s*(?:of|0f|/)\s*{_N})?[-–—\]) ]*|{_N}\s*\|?\s*p\s*[a@]\s*[g9]\s*[ec]|{_N}\s*(?:of|/)\s*{_N}|\S.{{0,90}}\S[ \t]{{2,}}{_N}|{_N}[ \t]{{2,}}\S.{{0,90}})$",
    re.I,
)
_MIXED = re.compile(r"^(?=.*\d)(?=.*(?:[oz]|[li]\d))[\dozli]{2,}$", re.I)
#: A number of three digits or more with one letter in it that may be a misread digit; as many are provisions, clean texts decide.
_LETTERED = re.compile(r"^(?=(?:\D?\d){3})\d*[sbgli]\d*$", re.I)


def word(raw: str) -> str:
    """A word as the lexicon has it: lower case, without punctuation around it and possessive ending, digit runs as one 0 (single digits in words stay)."""
    w = raw.lower().strip(_PUNCT)
    if w.endswith("/-"):
        w = w[:-2]
    if w.endswith(("'s", "’s")):
        w = w[:-2]
    return _DIGITS("0", w) if not w.isalpha() else w


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            raw.update(text.split())
        words: Counter[str] = Counter()
        for r, n in raw.items():
            if w := word(r):
                words[w] += n
                if _LETTERED.match(bare := r.strip(_PUNCT)):
                    words[bare.lower()] += n
        yield pa.record_batch([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])


def lexicon(clean: DataFrame) -> DataFrame:
    """(word, n) of clean rows (text): words seen at least RARE times."""
    counts = spread(clean.where("text IS NOT NULL").select("text")).mapInArrow(_count, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE)


def _key(line: str) -> str:
    return "".join(c for c in line.lower().translate(_FOLD) if c.isalpha())


def _titled(line: str) -> bool:
    words = [w for w in re.split(r"\W+", line) if w[:1].isalpha()]
    return sum(w[0].isupper() for w in words) >= 0.45 * len(words) > 0


def furniture(lines: list[str], title: str | None = None) -> set[int]:
    """Positions of running headers, running footers and page numbers among the stripped lines of an item.

    Running text is filled: a line ends a sentence or leaves no room for the next word. A header does neither, stands at the
    edge of a page, between blank lines or inside a sentence, and comes again, whole or cut short.
    """
    full = [i for i, s in enumerate(lines) if s]
    pages = {i for i in full if _PAGE.match(lines[i])}
    text = [i for i in full if i not in pages]
    if not text:
        return pages
    lengths = sorted(len(lines[i]) for i in text)
    width = lengths[int((len(lengths) - 1) * 0.93)]
    keys = {i: _key(lines[i]) for i in text}
    same: dict[str, list[int]] = {}
    for i in text:
        if len(keys[i]) >= 10:
            same.setdefault(keys[i][:10], []).append(i)
    named = _key(title or "")
    facts = {}
    for p, i in enumerate(full):
        if i in pages:
            continue
        line = lines[i]
        before = full[p - 1] if p else None
        after = full[p + 1] if p + 1 < len(full) else None
        edge = before is None or after is None or before in pages or after in pages
        said = next((lines[k] for k in reversed(full[:p]) if k not in pages), "")
        follows = next((lines[k] for k in full[p + 1 :] if k not in pages), "")
        open_ = bool(said) and said[-1] not in ".;:"
        fits = bool(follows) and after not in pages and len(line) + 1 + len(follows.split()[0]) <= width
        cut = line[-1] not in ".;:" and (fits or len(line) > width + 2)
        gap_before, gap_after = before is not None and before < i - 1, after is not None and after > i + 1 and after not in pages
        inside = open_ and follows[:1].islower()
        facts[i] = edge, cut, gap_before, gap_after, open_, inside, before in pages
    found = set(pages)
    for i in text:
        line, key = lines[i], keys[i]
        edge, cut, gap_before, gap_after, open_, inside, heads = facts[i]
        if line.endswith("…"):
            found.add(i)
            continue
        if len(key) < 8 or line[0].islower() or line[-1] in ";:-­¬‐" or "|" in line or line[-1] == "," and not _titled(line):
            continue
        alike = [j for j in same.get(key[:10], ()) if keys[j].startswith(key) or key.startswith(keys[j])]
        upper = line.upper() == line
        apart = edge or gap_before or gap_after or open_
        if len(key) >= 10 and named and (named.startswith(key[:40]) or key.startswith(named[:40])) and (apart or cut or len(alike) > 1):
            found.add(i)
        elif len(alike) > 1 and (upper or line[-1] != "." and any(facts[j][1] or facts[j][5] or facts[j][2] and facts[j][3] and _titled(line) for j in alike) or all(facts[j][0] for j in alike) and line[-1] != "."):
            found.add(i)
        elif line[-1] == "." and not upper:
            continue
        elif len(line) >= 15 and (cut or upper) and apart:
            found.add(i)
        elif heads and gap_after or _titled(line) and ((edge or gap_before) and inside or (gap_before or edge or open_) and gap_after):
            found.add(i)
    return found


_ROWS = pa.schema(
    [("item_table", pa.string()), ("item_id", pa.int64()), ("line_no", pa.int64()), ("next_no", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("word", pa.string()), ("alt", pa.string()), ("cut", pa.int32()), ("before", pa.string()), ("after", pa.string())]
)
_ROLES = "item_table string, item_id bigint, line_no bigint, next_no bigint, place int, role string, word string, alt string, cut int, before string, after string"


def split_word(line: str, follows: str) -> tuple[str, str] | None:
    """The two parts of a word that a mark at the line's end divides, or None."""
    words = line.split()
    last = words[-1].rstrip(".") if words else ""
    if len(last) < 2 or last[-1] not in MARKS or not last[-2].isalpha() or not follows:
        return None
    after = follows.split()[0]
    return (last[:-1].lstrip(_PUNCT), after.rstrip(_PUNCT)) if after[0].isalnum() or after[0] in "@!$" else None


def _read(batches: Iterator[pa.RecordBatch], common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows of role furniture, word (not common), mixed (the same, a misread unless it is known), break and kept (certain), and end (a line end with a mark to decide).

    Words that are not common are less frequent than all that are.

    place counts the words of a line from 0; before and after are the words next to a word.
    """
    for batch in batches:
        rows = []
        for table, item, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = [s.strip() for s in text.split("\n")]
            out = furniture(lines, title)
            rows += [(table, item, i + 1, None, None, "furniture", None, None, None, None, None) for i in sorted(out)]
            run = [i for i, s in enumerate(lines) if s and i not in out]
            skip: set[int] = set()
            for p, i in enumerate(run):
                words = lines[i].split()
                stop = len(words)
                parts = split_word(lines[i], lines[run[p + 1]]) if p + 1 < len(run) else None
                if parts:
                    joined, kept = word("".join(parts)), word("-".join(parts))
                    stop -= 1
                    skip.add(run[p + 1])
                    a, b = common.get(joined, 0), common.get(kept, 0)
                    role = "break" if a > b else "end" if not b else "kept"
                    rows.append((table, item, i + 1, run[p + 1] + 1, stop, role, *((joined, kept, len(parts[0])) if role == "end" else (None, None, None)), None, None))
                for k in range(int(i in skip), stop):
                    w = word(words[k])
                    if _LETTERED.match(bare := words[k].strip(_PUNCT)) and not _MIXED.match(bare):
                        if bare.lower() not in common:
                            rows.append((table, item, i + 1, None, k, "mixed", bare.lower(), None, None, None, None))
                    elif w and w not in common:
                        if _MIXED.match(words[k].strip(_PUNCT)):
                            rows.append((table, item, i + 1, None, k, "mixed", w, None, None, None, None))
                        else:
                            rows.append((table, item, i + 1, None, k, "word", w, None, None, word(words[k - 1]) if k else "", word(words[k + 1]) if k + 1 < len(words) else ""))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROWS)] if rows else [pa.array([], f.type) for f in _ROWS], schema=_ROWS)


def _forms(f: str) -> set[str]:
    """A folded word, and it with up to two characters left out where ``KEPT`` stay."""
    forms = {f}
    if len(f) > KEPT:
        once = {f[:i] + f[i + 1 :] for i in range(len(f))}
        forms |= once
        if len(f) > KEPT + 1:
            forms |= {x[:i] + x[i + 1 :] for x in once for i in range(len(x))}
    return forms


def _deletes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, gone): the keys of each word. Of up to three confusions one half of a long word has at most one, so its ends are keys enough."""
    for batch in batches:
        words, gone = [], []
        for w in batch.column(0).to_pylist():
            f = w.translate(_FOLD)
            forms = _forms(f) if len(f) <= LONG else {"<" + x for x in _forms(f[:ENDS])} | {x + ">" for x in _forms(f[-ENDS:])}
            words += [w] * len(forms)
            gone += forms
        yield pa.record_batch([pa.array(words, pa.string()), pa.array(gone, pa.string())], ["word", "gone"])


_PAIRS: dict[str, list[str]] = {}
for _seen, _true in CONFUSED:
    _PAIRS.setdefault(_seen, []).append(_true)


def readings(seen: str) -> set[str]:
    """What a short word may have been before up to three confusions."""
    out, fresh = {seen}, {seen}
    for _ in range(int(LIMIT / PAIR)):
        fresh = {x[:i] + t + x[i + n :] for x in fresh for i in range(len(x)) for n in (1, 2) if i + n <= len(x) for t in _PAIRS.get(x[i : i + n], ())} - out
        out |= fresh
    return out - {seen}


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(w, r) for w in batch.column(0).to_pylist() for r in readings(w)]
        yield pa.record_batch([pa.array([w for w, _ in pairs], pa.string()), pa.array([r for _, r in pairs], pa.string())], ["word", "repair"])


def distance(seen: str, true: str, limit: float = LIMIT) -> tuple[float, int, int] | None:
    """(cost, first, end) of reading ``true`` as ``seen``, with the span of ``seen`` that differs; None beyond the limit.

    Only places that can be reached within the limit are followed, so the work grows with the length, not its square. A plain edit is for words
    of letters, neither first nor among the last two: there it more often makes another word of the same stem.
    """
    plain = len(seen) >= PLAIN_LENGTH and seen.isalpha() and true.isalpha()
    rows: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(seen) + 1)]
    rows[0][0] = (0.0, len(seen), 0)
    for i, row in enumerate(rows):
        at = min(row, default=None)
        while at is not None:
            j, here = at, row[at]
            steps = []
            if i < len(seen) and j < len(true) and seen[i] == true[j]:
                steps.append((1, 1, 0.0))
            for n in (1, 2):
                if i + n <= len(seen):
                    steps += [(n, len(t), PAIR) for t in _PAIRS.get(seen[i : i + n], ()) if true.startswith(t, j)]
            if plain and not here[0] and 0 < i < len(seen) - 2 and j < len(true) - 2:
                steps += [(1, 1, PLAIN), (1, 0, PLAIN), (0, 1, PLAIN)]
                if seen[i] == true[j + 1] and seen[i + 1] == true[j]:
                    steps.append((2, 2, PLAIN))
            for a, b, c in steps:
                cost, old = here[0] + c, rows[i + a].get(j + b)
                if cost <= limit and (old is None or old[0] > cost):
                    rows[i + a][j + b] = (cost, min(here[1], i) if c else here[1], max(here[2], i + max(a, 1)) if c else here[2])
            at = min((x for x in row if x > j), default=None)
    return rows[-1].get(len(true))


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for w, c, n in zip(*(x.to_pylist() for x in batch.columns)):
            if (d := distance(w, c)) and d[0] > 0 and (d[0] < PLAIN or n >= PLAIN_FREQUENT):
                out.append((w, c, n, *d))
        names = ("word", "repair", "n", "cost", "first", "end")
        kinds = (pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names)


def candidates(words: DataFrame, lex: DataFrame) -> DataFrame:
    """(word, repair, n, cost, first, end) of distinct rows (word): the repairs at the least distance and those one confusion farther."""
    known = lex.where((F.col("n") >= FREQUENT) & F.col("word").rlike(r"\p{L}"))
    asked = words.where(F.length("word") >= 2).select("word")
    left = asked.mapInArrow(_deletes, "word string, gone string")
    right = known.select("word").mapInArrow(_deletes, "word string, gone string").withColumnRenamed("word", "repair")
    short = asked.where(F.length("word") <= SHORT).mapInArrow(_read_back, "word string, repair string")
    pairs = left.join(right, "gone").where("word <> repair").select("word", "repair").unionByName(short).distinct()
    scored = pairs.join(known.withColumnRenamed("word", "repair"), "repair").select("word", "repair", "n").mapInArrow(_score, "word string, repair string, n bigint, cost double, first int, end int")
    scored = materialise(scored)
    least = scored.groupBy("word").agg(F.min("cost").alias("least"))
    near = (F.col("cost") == F.col("least")) | (F.col("cost") < PLAIN) & (F.col("cost") <= F.col("least") + PAIR)
    return scored.join(least, "word").where(near).select("word", "repair", "n", "cost", "first", "end")


def most_frequent(found: DataFrame) -> DataFrame:
    """Of each word the nearest candidate that confusions explain, of several the most frequent, then the first."""
    best = found.where(F.col("cost") < PLAIN).groupBy("word").agg(F.min(F.struct("cost", (-F.col("n")).alias("n"), "repair", "first", "end")).alias("b"))
    return best.select("word", "b.repair", "b.first", "b.end")


#: Bits of the filter over asked pairs of words: about 16 a pair, from 128 kB to 16 MB whatever the data.
_BITS = (1 << 20, 1 << 27)
_PAIR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


class _Ids:
    """64-bit hashes of words, looked up once a worker."""

    def __init__(self):
        import xxhash

        self.hash, self.known = xxhash.xxh64_intdigest, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        return np.array([known[w] if w in known else known.setdefault(w, self.hash(w)) for w in words], dtype=np.uint64)


def _slots(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    h = left * _PAIR[0] + right * _PAIR[1]
    return ((h ^ (h >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


def _slot_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    ids = _Ids()
    for batch in batches:
        left, right = (ids(c.to_pylist()) for c in batch.columns)
        yield pa.record_batch([pa.array(np.unique(_slots(left, right, size)) if len(left) else [], pa.int64())], ["slot"])


def _count_pairs(batches: Iterator[pa.RecordBatch], bits: bytes, size: int) -> Iterator[pa.RecordBatch]:
    ids, field, words = _Ids(), np.unpackbits(np.frombuffer(bits, dtype=np.uint8), bitorder="little"), {}
    for batch in batches:
        found: Counter[tuple[str, str]] = Counter()
        for text in batch.column(0).to_pylist():
            raw = text.split()
            if len(words) > 1_000_000:
                words.clear()
            row = [words[r] if r in words else words.setdefault(r, word(r)) for r in raw]
            if len(row) > 1:
                h = ids(row)
                for k in np.flatnonzero(field[_slots(h[:-1], h[1:], size)]):
                    found[row[k], row[k + 1]] += 1
        yield pa.record_batch([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.string()), pa.array(found.values(), pa.int64())], ["left", "right", "n"])


def pair_counts(asked: DataFrame, clean: DataFrame) -> DataFrame:
    """(left, right, n): how often the asked pairs (left, right) of neighbouring words stand in clean rows (text).

    A bit field of bounded size lets the workers pass over pairs nobody asks for; the join decides.
    """
    asked, n = materialise_counted(asked.select("left", "right").distinct(), n=F.count(F.lit(1)))
    size = min(max(1 << (16 * max(1, n["n"])).bit_length(), _BITS[0]), _BITS[1])
    slots = asked.mapInArrow(partial(_slot_rows, size=size), "slot bigint")
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("m"))
    field = bytearray(size // 8 + 8192)
    for r in maps.collect():  # at most 2 ** 27 bits
        # Buckets are counted from 1; bucket b holds the numbers from (b - 1) * 32768 + 1 on, and 0 stands in bucket 0.
        start = (r["b"] - 1) * 4096
        if r["b"] >= 1:
            field[start : start + 4096] = r["m"]
    # Bit k of the field stands for slot k + 1; slot 0 shares the bit of slot 1's place below.
    shifted = np.concatenate([[1], np.unpackbits(np.frombuffer(bytes(field), dtype=np.uint8), bitorder="little")])[: size + 8]
    bits = np.packbits(shifted, bitorder="little").tobytes()
    counted = spread(clean.where("text IS NOT NULL").select("text")).mapInArrow(partial(_count_pairs, bits=bits, size=size), "left string, right string, n bigint")
    return counted.join(asked, ["left", "right"], "left_semi").groupBy("left", "right").agg(F.sum("n").alias("n"))


def in_context(occurrences: DataFrame, found: DataFrame, clean: DataFrame) -> DataFrame:
    """(*occurrence, repair, first, end): of rows (.., word, before, after) the repair that fits the word and its neighbours best.

    Words with one candidate by confusions keep it. Of several the one with the least sum wins: four times its distance, less the logarithm of how
    often clean texts have it beside the same neighbours, less a tenth of the logarithm of how often they have it. A plain edit must be seen beside both neighbours.
    """
    several = found.groupBy("word").agg(F.count("*").alias("c"), F.min("cost").alias("least")).where((F.col("c") > 1) | (F.col("least") >= PLAIN))
    tied, n = materialise_counted(found.join(several.select("word"), "word", "left_semi"), n=F.count(F.lit(1)))
    keys = occurrences.columns
    one_only = found.join(several.select("word"), "word", "left_anti")
    plain = occurrences.join(most_frequent(one_only), "word").select(*keys, "repair", "first", "end")
    if not n["n"]:
        return plain
    open_ = materialise(occurrences.join(tied, "word"))
    asked = open_.select(F.col("before").alias("left"), F.col("repair").alias("right")).union(open_.select("repair", "after")).where("left <> '' AND right <> ''")
    pairs = materialise(pair_counts(asked, clean))
    one = pairs.select(F.col("left").alias("before"), F.col("right").alias("repair"), F.col("n").alias("n1"))
    two = pairs.select(F.col("left").alias("repair"), F.col("right").alias("after"), F.col("n").alias("n2"))
    scored = open_.join(one, ["before", "repair"], "left").join(two, ["repair", "after"], "left")
    beside = (F.col("before") != "") & (F.col("after") != "") & F.col("n1").isNotNull() & F.col("n2").isNotNull()
    scored = scored.where((F.col("cost") < PLAIN) | beside)
    seen = F.coalesce("n1", F.lit(0)) + F.coalesce("n2", F.lit(0))
    sum_ = F.col("cost") * 4 - F.log1p(seen) - F.log(F.col("n")) * 0.1
    best = scored.groupBy(*keys).agg(F.min(F.struct(F.round(sum_, 9).alias("s"), (-F.col("n")).alias("n"), "repair", "first", "end")).alias("b"))
    return plain.unionByName(best.select(*keys, "b.repair", "b.first", "b.end"))


def _study(items: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, words, ends): what the items' lines hold, repaired words, and decided line ends."""
    lex = materialise(lexicon(clean))
    # At most COMMON words; a frequency that the limit divides is left out.
    most = lex.orderBy(F.col("n").desc(), "word").limit(COMMON).collect()
    common = {r["word"]: r["n"] for r in most if len(most) < COMMON or r["n"] > most[-1]["n"]}
    rows = items.where("text IS NOT NULL").select("item_table", F.col("item_id").cast("long").alias("item_id"), "title", "text")
    rows = materialise(rows.mapInArrow(partial(_read, common=common), _ROLES))
    asked = rows.where("word IS NOT NULL").select("word").union(rows.where("alt IS NOT NULL").select("alt")).distinct()
    asked = materialise(asked.join(lex, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")))
    found = materialise(candidates(asked.where("n = 0").select("word"), lex))
    mixed = rows.where("role = 'mixed'").join(asked.where("n = 0").select("word"), "word", "left_semi").withColumn("role", F.lit("misread"))
    rows = rows.where("role <> 'mixed'").unionByName(mixed.select(*rows.columns))
    words = in_context(rows.where("role = 'word'").select("item_table", "item_id", "line_no", "place", "word", "before", "after"), found, clean)
    facts = materialise(asked.join(most_frequent(found), "word", "left"))
    of = lambda c, p: facts.select(F.col("word").alias(c), *(F.col(x).alias(p + x) for x in ("n", "repair", "first", "end")))
    ends = rows.where("role = 'end'").join(of("word", "w_"), "word").join(of("alt", "a_"), "alt")
    # The word with the mark wins if it is known and the joined one is not more frequent, or if only it has a repair.
    kept = (F.col("a_n") > 0) & (F.col("a_n") >= F.col("w_n")) | (F.col("w_n") == 0) & F.col("w_repair").isNull() & F.col("a_repair").isNotNull()
    return rows, words, ends.withColumn("kept", kept)


def noise(items: DataFrame, clean: DataFrame) -> DataFrame:
    """(item_table, item_id, line_no, kind) of scanned rows (item_table, item_id, title, text), measured by clean rows (text)."""
    rows, words, ends = _study(items, clean)
    keys = ["item_table", "item_id"]
    misread = words.select(*keys, "line_no", F.lit("misread").alias("kind"))
    breaks = ends.where("NOT kept").select(*keys, "line_no", F.lit("break").alias("kind"))
    # A misread of a split word belongs to the line, or lines, that hold its characters; the joined word has no mark, the other has one.
    bad = ends.select(*keys, "line_no", "next_no", F.when(F.col("kept"), F.col("a_first")).otherwise(F.col("w_first")).alias("first"), F.when(F.col("kept"), F.col("a_end") - 1).otherwise(F.col("w_end")).alias("end"), "cut").where("first IS NOT NULL")
    split = bad.where("first < cut").select(*keys, "line_no", F.lit("misread").alias("kind")).unionByName(bad.where("end > cut").select(*keys, F.col("next_no").alias("line_no"), F.lit("misread").alias("kind")))
    sure = rows.where("role IN ('furniture', 'break', 'misread')").select(*keys, "line_no", F.col("role").alias("kind"))
    return sure.unionByName(misread).unionByName(breaks).unionByName(split).distinct()


def restore(raw: str, repair: str) -> str:
    """``repair`` in place of the word within ``raw``: its punctuation, case, ending and digits stay."""
    core = raw.strip(_PUNCT)
    if not core:
        return raw
    at = raw.index(core)
    ending = core[-2:] if core.lower().endswith(("'s", "’s")) else ""
    body = core[: len(core) - len(ending)]
    runs = re.findall(r"\d{2,}|(?<![^\W\d_])\d+(?![^\W\d_])", body)
    if repair.count("0") == len(runs):
        parts = repair.split("0")
        repair = "".join(x for pair in zip(parts, [*runs, ""]) for x in pair)
    letters = [c for c in body if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        repair = repair.upper()
    elif repair[:1].isalpha() and (body[:1].isupper() or not body[:1].isalpha() and raw is not core and not body[1:2].islower()):
        repair = repair[:1].upper() + repair[1:]
    elif any(c.isupper() for c in body[1:]) and "-" in body and repair.count("-") == body.count("-"):
        repair = "-".join(r[:1].upper() + r[1:] if b[:1].isupper() else r for r, b in zip(repair.split("-"), body.split("-")))
    return raw[:at] + repair + ending + raw[at + len(core) :]


def rebuild(text: str, fixes: list[tuple]) -> list[str]:
    """Continuous paragraphs of a text from its fixes (line_no, place, role, repair)."""
    lines = [s.strip() for s in text.split("\n")]
    drop, words, ends = set(), {}, {}
    for line, place, role, repair in fixes:
        if role == "furniture":
            drop.add(line - 1)
        elif role in ("break", "kept"):
            ends[line - 1] = (role, repair)
        else:
            words[line - 1, place] = repair
    paragraphs: list[list[str]] = [[]]
    blank, glue = False, None
    for i, line in enumerate(lines):
        if i in drop:
            continue
        if not line:
            blank = True
            continue
        tokens = [restore(w, words[i, k]) if words.get((i, k)) else w for k, w in enumerate(line.split())]
        here = paragraphs[-1]
        # A paragraph goes on over a gap, or a page, as long as its sentence is open.
        if here and blank and glue is None and here[-1][-1:] in ".;:":
            paragraphs.append(here := [])
        blank = False
        if glue is not None:
            role, repair = glue
            head = here.pop()
            mark = head.rstrip(".")[:-1] if head.rstrip(".")[-1:] in MARKS else head
            whole = mark + ("" if role == "break" else "-") + tokens[0]
            here.append(restore(whole, repair) if repair else whole)
            tokens = tokens[1:]
        here += tokens
        glue = ends.get(i)
    return [" ".join(p) for p in paragraphs if p]


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fixes = [[(f["line_no"], f["place"], f["role"], f["repair"]) for f in x or ()] for x in batch.column(3).to_pylist()]
        out = [rebuild(t, f) for t, f in zip(batch.column(2).to_pylist(), fixes)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], ["item_table", "item_id", "paragraphs"])


def repaired(items: DataFrame, clean: DataFrame) -> DataFrame:
    """(item_table, item_id, paragraphs) of scanned rows (item_table, item_id, title, text): their text as continuous paragraphs."""
    rows, words, ends = _study(items, clean)
    columns = ["item_table", "item_id", "line_no", "place", "role", "repair"]
    none = F.lit(None).cast("string")
    fixes = rows.where("role IN ('furniture', 'break', 'kept')").withColumn("repair", none).select(columns)
    fixes = fixes.unionByName(words.withColumn("role", F.lit("word")).select(columns))
    ends = ends.withColumn("role", F.when(F.col("kept"), "kept").otherwise("break")).withColumn("repair", F.when(F.col("kept"), F.col("a_repair")).otherwise(F.col("w_repair")))
    fixes = fixes.unionByName(ends.select(columns))
    # As many fixes as an item has lines and words: no more than its text.
    by_item = fixes.groupBy("item_table", "item_id").agg(F.collect_list(F.struct("line_no", "place", "role", "repair")).alias("fixes"))
    texts = items.where("text IS NOT NULL").select("item_table", F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_table", "item_id"])
    return texts.join(by_item, ["item_table", "item_id"], "left").mapInArrow(_rebuild, "item_table string, item_id bigint, paragraphs array<string>")
