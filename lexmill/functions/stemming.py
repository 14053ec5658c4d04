"""The English (Porter2) stemmer, from its published description."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the algorithm.
_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_KEEP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_VOWEL, _REGION = re.compile("[aeiouy]"), re.compile("[aeiouy][^aeiouy]")


def _regions(w: str) -> tuple[int, int]:
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            one = len(start)
            break
    else:
        m = _REGION.search(w)
        one = m.end() if m else len(w)
    m = _REGION.search(w, one)
    return one, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.match("^[aeiouy][^aeiouy]$", w))


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    w = re.sub("(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    one, two = _regions(w)
    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL.search(w[:-2]):
        w = w[:-1]
    if w in _KEEP_AFTER_1A:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= one:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                rest = w[: -len(end)]
                if _VOWEL.search(rest):
                    if rest.endswith(("at", "bl", "iz")):
                        w = rest + "e"
                    elif rest.endswith(_DOUBLES):
                        w = rest[:-1]
                    elif _short_end(rest) and len(rest) <= one:
                        w = rest + "e"
                    else:
                        w = rest
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= one:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and w[-4:-3] == "l" and len(w) - 3 >= one:
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= one and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= one:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= two:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= two:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= two and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= two or len(w) - 1 >= one and not _short_end(w[:-1]):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= two:
        w = w[:-1]
    return w.lower()
