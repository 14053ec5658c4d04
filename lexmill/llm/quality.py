"""Per-document text statistics, and text types from noisy labelling functions.

``statistics`` computes the statistics of each text. Thresholds on them are labelling functions: each votes for one kind or abstains; one more votes for the
kind that most characters' lines look like. Which kind a document is and how often each function casts each vote on each kind are learnt together
by expectation-maximisation on the functions' agreements; hand labels are not used. The vote patterns of all documents are counted first: with twelve
thresholds and one function of five values there are at most 5 * 2 ** 12 patterns, whatever the corpus, so the iterations run over that table on the driver
and the posterior of each pattern is joined back. ``accuracies`` tells what was learnt of each function.

Words are what lies between space, tab, CR and LF; letters, marks and digits are Unicode L, M and Nd; everything else in a word is a symbol.

Defined results: null, empty and blank texts have no words, null shares and no kind; texts of any length are read whole; equal rows
give equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import local_table, spread

KINDS = ("prose", "list", "table", "junk")
_STATS = (
    ("n_words", pa.int64()), ("mean_word_length", pa.float64()), ("symbol_share", pa.float64()), ("punctuated_lines", pa.float64()), ("common_share", pa.float64()),
    ("digit_share", pa.float64()), ("distinct_share", pa.float64()), ("words_a_line", pa.float64()),
    ("cell_share", pa.float64()), ("mark_share", pa.float64()), ("leader_share", pa.float64()), ("strung", pa.float64()), ("odd_share", pa.float64()),
    ("prose_share", pa.float64()), ("list_share", pa.float64()), ("table_share", pa.float64()), ("junk_share", pa.float64()),
)
#: Statistics that are measures of the text alone; those after them are shares of characters by the look of their lines.
PLAIN = tuple(n for n, _ in _STATS[:8])
_BLANK = " \t\r\n"
_SCHEMA = "id bigint, " + ", ".join(f"{n} {'bigint' if t == pa.int64() else 'double'}" for n, t in _STATS)


class Reader:
    """Statistics of texts; common is a set of lower-case function words."""

    def __init__(self, common: frozenset[str]):
        import regex

        self.common = common
        self.letters = regex.compile(r"[\p{L}\p{M}]+").findall
        self.item = regex.compile(r"^(?:[-*•–◦▪·]|\(?(?:[0-9]{1,3}|[ivxlcdm]{1,6}|[a-z])[.)])\s", regex.I).match
        self.gaps = regex.compile(r"\S(?: {2,}|\t+)(?=\S)").findall
        self.digits = re.compile(r"\d").findall  # Unicode Nd
        self.words = re.compile(r"[^ \t\r\n]+").findall
        #: What str.split takes for white space beside space, tab, CR and LF.
        self.other_space = re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        #: The replacement character, private use, noncharacters and controls.
        self.odd = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ue000-\uf8ff\ufdd0-\ufdef\ufff0-\uffff]").findall

    @staticmethod
    def leader(s: str) -> bool:
        """Whether a line of lower case ends in dots that lead to a page number; read from its end, so that long rows of dots cost no more."""
        head = s.rstrip("0123456789ivxl")
        bare = head.rstrip()
        return bare.endswith("....") or bare.endswith(". . . .") and head[len(bare) : len(bare) + 1] == " "

    def line(self, s: str, low: list[str], known: int, letters: int, words: list[str], digits: int, gaps: int) -> str:
        """The kind of a stripped line that is not empty."""
        n, dense = len(s), sum(map(len, words))
        share = known / len(low) if low else 0.0
        if s.count("�") > 0.08 * n:
            return "junk"
        if not letters and not digits:
            return "table" if "--" in s and ("|" in s or "+" in s) else "junk"
        symbols = dense - letters - digits
        if self.leader(s):
            return "list" if letters > 3 else "junk"
        if s.count("|") >= 2 and "||" not in s:
            return "table"
        if gaps >= 2 and len(words) <= 3 * (gaps + 1) and share < 0.15:
            return "table"
        if s.count(",") >= 2 and len(words) <= 3 and (digits or s.count(",") >= 3):
            return "table"
        if digits > 0.6 * dense and len(words) >= 3:
            return "table"
        if max(map(len, words)) > 40 and n > 60 and share < 0.15:
            return "junk"
        if symbols > 0.25 * dense and n > 15:
            return "junk"
        if len(words) >= 10 and len(set(words)) < 0.2 * len(words):
            return "junk"
        strung = s.count(",") + s.count(";") + s.count("•") + s.count("،") + s.count("/")
        if len(words) >= 6 and strung >= 0.5 * len(words) and share < 0.12:
            return "list"
        if self.item(s) and (share < 0.2 and len(words) <= 12 or len(words) <= 5):
            return "list"
        if share >= 0.12 and (len(words) > 4 or s[-1] in ".।?!"):
            return "prose"
        if len(words) <= 8:
            return "prose" if s[-1] in ".।?!:" and share >= 0.12 else "list"
        if len(words) >= 12 and share < 0.05:
            return "junk"
        return "prose" if share >= 0.08 else "list"

    def cells(self, s: str, words: list[str], commas: int, gaps: int, plain: int) -> bool:
        """Whether a line is cut by bars, tabs, wide gaps or commas into cells of few words, or rules such lines off."""
        if not plain:
            return "--" in s and ("|" in s or "+" in s)
        bars = s.count("|") if "||" not in s else 0
        return bars >= 2 or gaps >= 2 and len(words) <= 3 * (gaps + 1) or commas >= 2 and commas >= len(words) and len(s) <= 40 * (commas + 1)

    def text(self, text: str | None) -> list | None:
        """The statistics in the order of _STATS, or None for a text without any."""
        if not text or not text.strip(_BLANK):
            return None
        weights = dict.fromkeys(KINDS, 0)
        n_words = length = known_all = digits_all = letters_all = dense_all = ended = lines = cells = marks = leaders = strung = 0
        distinct: set[str] = set()
        common, text = self.common, text.lower()
        split = self.words if self.other_space(text) else str.split
        for line in text.split("\n"):
            s = line.strip(_BLANK)
            if not s:
                continue
            words, low = split(s), self.letters(s)
            letters = sum(map(len, low))
            known = sum(w in common for w in low)
            dense = sum(map(len, words))
            digits = 0 if letters == dense else sum(map(s.count, "0123456789")) if s.isascii() else len(self.digits(s))
            gaps = len(self.gaps(s)) if "\t" in s or "  " in s else 0
            weights[self.line(s, low, known, letters, words, digits, gaps)] += dense
            n_words += len(words)
            length += letters
            known_all += known
            digits_all += digits
            letters_all += len(low)
            dense_all += dense
            distinct.update(words)
            ended += s[-1] in ".?!:;।"
            lines += 1
            commas = s.count(",")
            if self.cells(s, words, commas, gaps, letters + digits):
                cells += dense
            if self.leader(s):
                leaders += dense
            elif self.item(s):
                marks += dense
            strung += commas + s.count(";") + s.count("•") + s.count("/")
        total = max(1, sum(weights.values()))
        odd = len(self.odd(text))
        return [
            n_words, dense_all / n_words, (dense_all - length - digits_all) / dense_all, ended / lines, known_all / letters_all if letters_all else 0.0,
            digits_all / dense_all, len(distinct) / n_words, n_words / lines, cells / dense_all, marks / dense_all, leaders / dense_all, strung / n_words, odd / dense_all,
            *(weights[k] / total for k in KINDS),
        ]


def _read(batches: Iterator[pa.RecordBatch], common: frozenset[str]) -> Iterator[pa.RecordBatch]:
    reader = Reader(common)
    for batch in batches:
        rows = [reader.text(t) or [0, *[None] * (len(_STATS) - 1)] for t in batch.column(1).to_pylist()]
        columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_STATS)]
        yield pa.record_batch([batch.column(0), *columns], ["id", *(n for n, _ in _STATS)])


def statistics(texts: DataFrame, id_col: str, text_col: str, common: frozenset[str]) -> DataFrame:
    """(id, *statistics) of every row."""
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(partial(_read, common=common), _SCHEMA)


#: Labelling functions: the kind voted for, and when.
VOTES = (
    ("table", "cell_share > 0.5 AND common_share < 0.25"),
    ("table", "digit_share > 0.4"),
    ("list", "mark_share > 0.5 AND common_share < 0.15"),
    ("list", "leader_share > 0.5"),
    ("list", "strung > 0.4 AND common_share < 0.12 AND cell_share < 0.5"),
    ("list", "words_a_line <= 5 AND digit_share < 0.1 AND symbol_share < 0.15 AND common_share < 0.2"),
    ("junk", "symbol_share > 0.3 AND cell_share < 0.5 AND mark_share < 0.5 AND leader_share < 0.5"),
    ("junk", "mean_word_length > 25 OR distinct_share < 0.05 AND n_words > 10"),
    ("junk", "odd_share > 0.03"),
    ("junk", "common_share < 0.05 AND words_a_line > 8 AND strung < 0.4 AND cell_share < 0.5"),
    ("prose", "common_share > 0.2"),
    ("prose", "punctuated_lines > 0.5 AND words_a_line > 8 AND common_share > 0.12"),
)
#: The function of five values: the kind of most characters by the look of their lines, or none.
LOOK = "CASE WHEN prose_share > 0.5 THEN 1 WHEN list_share > 0.5 THEN 2 WHEN table_share > 0.5 THEN 3 WHEN junk_share > 0.5 THEN 4 ELSE 0 END"
#: How often a function is taken to fire before anything is learnt, on its own kind and on others, and the kinds' shares.
FIRES, MISFIRES, SHARES = 0.6, 0.05, (0.7, 0.1, 0.1, 0.1)
#: Documents that the values before learning weigh as much as.
PRIOR = 20.0


def learn(patterns: list[tuple[int, int]], rounds: int = 60) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, how often each threshold fires on each kind, how often each look is given to each kind) from (pattern, documents).

    A pattern has a bit for each threshold and the look above them.
    """
    n = len(VOTES)
    keys, counts = np.array([p for p, _ in patterns], dtype=np.int64), np.array([c for _, c in patterns], dtype=float)
    bits = (keys[:, None] >> np.arange(n)) & 1
    looks = np.eye(len(KINDS) + 1)[keys >> n]
    own = np.array([[k == kind for kind in KINDS] for k, _ in VOTES])
    before = np.where(own, FIRES, MISFIRES)
    looked_before = np.vstack([np.full(len(KINDS), 0.1), np.full((len(KINDS), len(KINDS)), 0.05) + 0.7 * np.eye(len(KINDS))])
    fires, looked, shares = before, looked_before, np.array(SHARES)

    def posterior() -> np.ndarray:
        log = bits @ np.log(fires) + (1 - bits) @ np.log(1 - fires) + looks @ np.log(looked) + np.log(shares)
        p = np.exp(log - log.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for _ in range(rounds):
        weight = posterior() * counts[:, None]
        mass = weight.sum(axis=0)
        # The prior keeps the meaning of a kind that is rare or missing.
        fires = ((bits.T @ weight + PRIOR * before) / (mass + PRIOR)).clip(1e-4, 1 - 1e-4)
        looked = (looks.T @ weight + PRIOR * looked_before) / (mass + PRIOR)
        shares = (mass + PRIOR * np.array(SHARES)) / (mass.sum() + PRIOR)
    return dict(zip(keys.tolist(), posterior())), fires, looked


def _voted(stats: DataFrame) -> DataFrame:
    fired = sum((F.when(F.expr(when), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, when) in enumerate(VOTES)), F.lit(0))
    return stats.where("n_words > 0").select("id", *(n for n, _ in _STATS)).withColumn("pattern", fired + F.expr(LOOK) * (1 << len(VOTES)))


def _patterns(voted: DataFrame) -> list[tuple[int, int]]:
    """At most 5 * 2 ** 12 rows."""
    return sorted((r["pattern"], r["n"]) for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect())


def text_kinds(stats: DataFrame) -> DataFrame:
    """(id, kind, probability) of statistics of texts that are not blank."""
    voted = _voted(stats)
    rows = [(i, KINDS[int(p.argmax())], float(p.max())) for i, p in learn(_patterns(voted))[0].items()]
    kinds = local_table(stats.sparkSession, rows, pattern=pa.int32(), kind=pa.string(), probability=pa.float64())
    return voted.join(F.broadcast(kinds), "pattern").select("id", "kind", "probability")


def accuracies(stats: DataFrame) -> DataFrame:
    """(function, kind, n_fired, fires_on_kind, fires_on_others, precision, majority_agrees): what was learnt of each function on all documents.

    precision is the share of the function's votes that the posterior agrees with; majority_agrees the share of them where the plain majority of all votes does.
    """
    patterns = _patterns(_voted(stats))
    posterior, fires, looked = learn(patterns)
    n = len(VOTES)

    def votes(p: int) -> list[int]:
        cast = [KINDS.index(k) for i, (k, _) in enumerate(VOTES) if p >> i & 1]
        return cast + [(p >> n) - 1] * (p >> n > 0)

    major = {p: max(range(len(KINDS)), key=lambda k: votes(p).count(k)) for p, _ in patterns}
    names = [(f"{k}: {when}", KINDS.index(k), (lambda p, i=i: p >> i & 1), fires[i]) for i, (k, when) in enumerate(VOTES)]
    names += [(f"look: {kind}_share > 0.5", k, (lambda p, k=k: p >> n == k + 1), looked[k + 1]) for k, kind in enumerate(KINDS)]
    rows = []
    for name, k, fired, rate in names:
        hits = [(p, c) for p, c in patterns if fired(p)]
        total = sum(c for _, c in hits)
        share = lambda f: float(sum(c * f(p) for p, c in hits) / total) if total else None
        others = float(np.mean([rate[j] for j in range(len(KINDS)) if j != k]))
        rows.append((name, KINDS[k], int(total), round(float(rate[k]), 4), round(others, 4), share(lambda p: float(posterior[p][k])), share(lambda p: float(major[p] == k))))
    kinds = dict(function=pa.string(), kind=pa.string(), n_fired=pa.int64(), fires_on_kind=pa.float64(), fires_on_others=pa.float64(), precision=pa.float64(), majority_agrees=pa.float64())
    return local_table(stats.sparkSession, rows, **kinds)
