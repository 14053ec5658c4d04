"""Listings and documents from files: JSON feeds under a stated schema, HTML tables, page files."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CBIC = "id bigint, contentId bigint, createdDt string, orderId bigint, notificationNo string, notificationName string, notificationCategory string, notificationDt string, docFilePath string, docFileName string"
MCA = "docIdentifier string, UploadDate string, docId string, link string, shortDescription string, notificationdate string, docGroup string, docName string, status string"
_ROWS = "array<struct<date:string,title:string,url:string>>"


def json_listing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row an object of JSON arrays in files; what does not fit the schema is null, no schema is inferred."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


class _Table(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell = {"text": "", "url": None}
            self.rows[-1].append(self.cell)
        elif tag == "a" and self.cell is not None:
            self.cell["url"] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


_DATE = re.compile(r"^\s*(?:\d{4}|\d{1,2}[-/. ]\w{3,9}[-/., ]+\d{4}|[A-Z][a-z]{2,8} \d{1,2}, \d{4})\s*$")


def listing_rows(html: str) -> list[dict]:
    """Linked rows of the tables of a page; a row of one date cell dates those after it, until the next one."""
    reader = _Table()
    reader.feed(html)
    out, day = [], None
    for row in reader.rows:
        texts = [" ".join(c["text"].split()) for c in row]
        if row and _DATE.match(texts[0]):
            day = texts[0]
        for c, t in zip(row, texts):
            if c["url"] and t:
                out.append({"date": day, "title": t, "url": c["url"]})
                break
    return out


def html_listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, date, title, url) of HTML listings; the first row of an address holds."""
    read = F.udf(listing_rows, _ROWS, useArrow=True)
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = pages.select("file", F.posexplode(read("value")).alias("place", "r")).select("file", "place", "r.*")
    first = rows.groupBy("url").agg(F.min(F.struct("file", "place", "date", "title")).alias("f"))
    return first.select("f.file", "f.date", "f.title", "url")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, page_no, text) of page files {"pages": [...]}; a file that cannot be read has no pages."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "pages array<string>").alias("p"))
    return rows.select("file", F.posexplode("p.pages").alias("n", "text")).select("file", (F.col("n") + 1).alias("page_no"), "text")


def unwrap(envelope: str) -> bytes | None:
    """The document inside a JSON envelope with base64 data; None for anything that is not one."""
    import base64
    import binascii

    try:
        return base64.b64decode(json.loads(envelope)["data"], validate=True)
    except (ValueError, KeyError, TypeError, binascii.Error):
        return None


def walled(first_pages: str, n_pages) -> object:
    """Whether what was fetched is a check for robots and no document: at most two pages that say so early on."""
    return (F.col(n_pages) <= 2) & F.substring(first_pages, 1, 2000).rlike("(?i)are you a robot|captcha|access denied|request blocked")
