"""On which page of a printed text each numbered provision begins.

A text's pages are read once: the numbers that stand as headings at the start of a line and the page's levelled words. Provisions look themselves up there,
so the work is one pass over the pages and one over the provisions. Pages of a list of contents are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict

#: How a list of contents is headed, and the words that label a number or begin a note about an amendment.
CONTENTS = ("ARRANGEMENT OF SECTIONS", "ARRANGEMENT OF RULES", "ARRANGEMENT OF REGULATIONS", "ARRANGEMENT OF CLAUSES", "ARRANGEMENT OF PARAGRAPHS", "TABLE OF CONTENTS")
LABELS = ("Section", "Regulation", "Rule", "Para", "Paragraph", "Clause", "Chapter", "Part")
NOTES = ("Ins", "Inserted", "Subs", "Substituted", "Omitted", "Deleted", "Amended", "Modified", "Renumbered", "Replaced", "Updated", "Added", "Prior to", "Vide", "w.e.f.", "Notified", "Effective")
#: Width of a line of prose, longest list of contents, share of such pages beyond which none is believed, cost of a page behind, usable heading.
PROSE, LONGEST, BELIEVED, BEHIND, HEADING = 88, 15, 0.4, 3, 12

_CONTENTS = re.compile("|".join(map(re.escape, CONTENTS)) + r"|^[ \t]*(?:CONTENTS|INDEX)[ \t]*$", re.I | re.M)
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d{1,4}\s*$|\S\s{3,}\d{1,4}\s*$")
_ALONE = re.compile(r"\s*\d{1,3}[A-Z]{0,3}\.?\s*$")
_START = re.compile(rf"\s*(?:\d{{1,3}}\s*\[\s*)?(?:(?i:{'|'.join(LABELS)})\s+)?(\d+[A-Z]{{0,3}}(?:\.\d+)*|[A-Z]\.\d+(?:\.\d+)?)\s*[.):-]")
_NOTE = re.compile(rf"\s*(?:{'|'.join(map(re.escape, NOTES))})(?![A-Za-z])", re.I)
_LEVEL = str.maketrans({" ": " ", "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"'})


def levelled(text: str) -> str:
    return " ".join(text.translate(_LEVEL).lower().split())


def lists_contents(page: str) -> bool:
    """Whether a page looks like part of a list of contents: leaders or numbers at its lines' ends, or, on a page without prose, numbers alone on their lines."""
    lines = [x.rstrip() for x in page.split("\n")]
    body = [x for x in lines if len(x.strip()) > 3]
    if len(body) < 5:
        return False
    if sum(bool(_LEADER.search(x)) for x in body) >= max(4, 0.4 * len(body)):
        return True
    narrow = all(len(x.strip()) < PROSE for x in lines)
    return narrow and sum(bool(_ALONE.match(x)) for x in lines) >= max(4, 0.3 * len(body))


def contents_pages(pages: list[str]) -> set[int]:
    """Places of the pages that list contents: those that look so, and those that follow such a heading until prose begins."""
    found, since = set(), None
    for n, page in enumerate(pages):
        if _CONTENTS.search(page):
            since = n
        elif since is not None and (n - since > LONGEST - 1 or any(len(x.strip()) >= PROSE for x in page.split("\n"))):
            since = None
        if since is not None or lists_contents(page):
            found.add(n)
    return found if len(found) <= BELIEVED * len(pages) else set()


def find_pages(pages: list[str], provisions: list[tuple[str, str | None, str]]) -> list[int | None]:
    """The page, counted from 1, of each provision (number, heading, level) in order; None where nothing sure is found.

    A page with both the number as a heading and the provision's own heading wins, else the one with the heading that is nearest to where reading stands. A
    heading that no page has tells that the text is another one: no page. Without a usable heading the first page with the number counts.
    """
    skip = contents_pages(pages)
    read = [n for n in range(len(pages)) if n not in skip]
    words = {n: levelled(pages[n]) for n in read}
    starts: dict[str, list[int]] = defaultdict(list)
    lines: dict[int, list[str]] = {}
    for n in read:
        lines[n] = [levelled(x) for x in pages[n].split("\n")]
        for line in pages[n].split("\n"):
            m = _START.match(line)
            if m and not _NOTE.match(line[m.end() :]) and (not starts[m[1].upper()] or starts[m[1].upper()][-1] != n):
                starts[m[1].upper()].append(n)
    out: list[int | None] = []
    at = 0
    for number, heading, level in provisions:
        if level == "chapter":
            wanted = levelled(number)
            places = [n for n in read if any(x.startswith(wanted) for x in lines[n])] if wanted else []
        else:
            places = starts.get(number.strip().upper(), [])
        head = levelled(heading or "")[:60]
        page = None
        if len(head) > HEADING:
            named = [n for n in read if head in words[n]]
            both = set(named).intersection(places)
            if both:
                page = min(both)
            elif named:
                page = min(named, key=lambda n: n - at if n >= at else BEHIND * (at - n) + 1)
        elif places:
            page = places[0]
        out.append(None if page is None else page + 1)
        at = at if page is None else max(at, page)
    return out
