"""Markup of official texts made safe: what structures a text stays, what belongs to a page goes."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

#: Tags that stay, tags that go with all they hold, attributes that stay; other tags go and what they hold stays.
KEPT = (
    "p", "br", "b", "strong", "i", "em", "u", "sup", "sub", "span", "div", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "col", "colgroup",
    "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "a",
)
DROPPED = ("script", "style", "noscript", "iframe", "object", "embed", "form", "input", "button", "svg", "meta", "link")
ATTRIBUTES = ("colspan", "rowspan", "align", "valign", "start", "type", "href", "id")
_VOID = ("br", "hr", "col", "input", "meta", "link", "embed", "img")


class _Cleaner(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.open, self.hidden = (base or "").rstrip("/"), [], [], []

    def handle_starttag(self, tag, attrs):
        if self.hidden or tag in DROPPED:
            if tag not in _VOID:
                self.hidden.append(tag)
            return
        kept = {k: v or "" for k, v in attrs if k in ATTRIBUTES} if tag in KEPT else None
        if tag == "a":
            href = kept.get("href", "")
            href = self.base + href if self.base and href.startswith("/") else href
            kept = {"href": href, "target": "_blank", "rel": "noreferrer"} if href.lower().startswith(("http://", "https://")) else None
        if kept is not None:
            self.out.append("<" + " ".join([tag, *(f'{k}="{escape(v)}"' for k, v in kept.items())]) + ("/>" if tag in _VOID else ">"))
        if tag not in _VOID:
            self.open.append((tag, kept is not None))

    def handle_endtag(self, tag):
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[len(self.hidden) - 1 - self.hidden[::-1].index(tag) :]
            return
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            last, written = self.open.pop()
            if written:
                self.out.append(f"</{last}>")
            if last == tag:
                return

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(escape(data, quote=False))

    def finish(self) -> str:
        self.close()
        self.out += [f"</{t}>" for t, written in reversed(self.open) if written]
        return "".join(self.out)


def clean_html(html: str | None, base: str | None = None) -> str:
    """The markup with the tags and attributes that stay, closed where it was left open; links only to http and https, '/..' under ``base``."""
    if not html or "<" not in html:
        return ""
    cleaner = _Cleaner(base)
    cleaner.feed(html)
    text = cleaner.finish().replace(" ", " ")
    text = re.sub(r"(?:\s*<br/>\s*){3,}", "<br/><br/>", text)
    return re.sub(r"<p>\s*</p>", "", text).strip()
