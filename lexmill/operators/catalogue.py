"""The read API over instruments, provisions, their versions and the documents that changed them.

Every function takes the tables it reads as DataFrames and returns one; optional scopes are filters built into the plan. Text columns are
joined last and only where asked for. Every order that a limit follows ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.history import build_chains, changes
from lexmill.session import maintained, materialise


def newest(*c: str) -> list[Column]:
    """Newest first, unknown dates last, then by the other columns descending."""
    return [F.col(c[0]).desc_nulls_last(), *(F.col(x).desc() for x in c[1:])]


def unique_provisions(provision: DataFrame) -> DataFrame:
    """One row a provision, from the maintained table where there is one."""
    held = maintained(provision, "provisions", lambda rows: rows.dropDuplicates(["id"]))
    return provision.dropDuplicates(["id"]) if held is None else held


def versions(provision_version: DataFrame, with_text: bool = False) -> DataFrame:
    """(provision_id, valid_from, valid_to, source_kind, version_id[, text]): the periods of each provision, from the maintained table where there is one."""
    columns = ["provision_id", "valid_from", "valid_to", "source_kind", "version_id", *(["text"] if with_text else [])]
    held = maintained(provision_version, "versions", _build_versions)
    return (_build_versions(provision_version, with_text) if held is None else held).select(columns)


def _build_versions(provision_version: DataFrame, with_text: bool = True) -> DataFrame:
    raw = provision_version.select(F.col("provision_id").alias("entity"), "id", "text", "source_kind", "effective_from", "effective_to", "created_at")
    chains = build_chains(changes(raw)).select(F.col("entity").alias("provision_id"), "valid_from", "valid_to", "source_kind", F.col("id").alias("version_id"))
    if with_text:
        chains = chains.join(provision_version.select(F.col("id").alias("version_id"), "text").dropDuplicates(["version_id"]), "version_id")
    return chains


def as_on(chains: DataFrame, day: str | None) -> DataFrame:
    """Versions in force on a day; without a day the current ones. An unknown start counts as always."""
    if day is None:
        return chains.where("valid_to IS NULL")
    d = F.lit(day).cast("date")
    return chains.where((F.col("valid_from").isNull() | (F.col("valid_from") <= d)) & (F.col("valid_to").isNull() | (F.col("valid_to") > d)))


def number_key(c: Column | str) -> Column:
    """Numbers compare without case and spaces."""
    return F.upper(F.replace(F.col(c) if isinstance(c, str) else c, F.lit(" "), F.lit("")))


def list_instruments(instrument: DataFrame, regulator: DataFrame, provision: DataFrame) -> DataFrame:
    n = unique_provisions(provision).groupBy(F.col("instrument_id").alias("id")).agg(F.count("*").alias("provisions"), F.countDistinct("level").alias("levels"))
    r = regulator.select(F.col("id").alias("regulator_id"), F.col("code").alias("regulator"))
    return instrument.join(r, "regulator_id").join(n, "id", "left").select("id", "slug", "short_code", "title", "kind", "regulator", F.coalesce("provisions", F.lit(0)).alias("provisions"), F.coalesce("levels", F.lit(0)).alias("levels"))


def list_provisions(provision: DataFrame, chains: DataFrame, day: str | None, instrument_id: int | None = None) -> DataFrame:
    """Provisions with the version in force on ``day`` (null if none) and how many versions they ever had, by source."""
    p = unique_provisions(provision)
    if instrument_id is not None:
        p = p.where(F.col("instrument_id") == instrument_id)
    counts = chains.groupBy("provision_id").agg(F.count("*").alias("n_versions"), F.count_if(F.col("source_kind") == "machine_merged").alias("n_machine"))
    now = as_on(chains, day).select("provision_id", "version_id", "valid_from")
    p = p.select(F.col("id").alias("provision_id"), "instrument_id", "number", "heading", "level", "sort_key")
    return p.join(now, "provision_id", "left").join(counts, "provision_id", "left").fillna(0, ["n_versions", "n_machine"])


def provision_at(provision: DataFrame, chains: DataFrame, day: str, number: str | None = None) -> DataFrame:
    """In each instrument the provision of a number, or of every number, as it stood on a day; of several the newest version's."""
    p = unique_provisions(provision).withColumn("_key", number_key("number"))
    if number is not None:
        p = p.where(F.col("_key") == number_key(F.lit(number)))
    w = Window.partitionBy("instrument_id", "_key").orderBy(F.col("version_id").desc_nulls_last(), F.col("id"))
    found = p.join(as_on(chains, day).select(F.col("provision_id").alias("id"), "version_id", "valid_from"), "id", "left")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("instrument_id", "id", "number", "version_id", "valid_from")


def find_by_number(provision: DataFrame, instrument: DataFrame, regulator: DataFrame, number: str, limit: int = 80) -> DataFrame:
    p = unique_provisions(provision).where(number_key("number") == number_key(F.lit(number))).where("level IS NULL OR lower(level) <> 'chapter'")
    i = instrument.where(~F.col("pdf_only").eqNullSafe(True)).select(F.col("id").alias("instrument_id"), "slug", "title", "regulator_id")
    r = regulator.select(F.col("id").alias("regulator_id"), "code")
    return p.join(i, "instrument_id").join(r, "regulator_id").orderBy("code", "title", "id").limit(limit).select("id", "slug", "number", "heading", "code")


def recent_by_group(document: DataFrame, k: int = 6) -> DataFrame:
    """The k newest documents of each regulator."""
    w = Window.partitionBy("regulator_code").orderBy(*newest("date_issued", "id"))
    return document.where("regulator_code IS NOT NULL").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def affected(document: DataFrame, provision_version: DataFrame, provision: DataFrame, instrument: DataFrame) -> DataFrame:
    """(document_id, affects): the instruments whose versions a document made, as one ordered list."""
    made = provision_version.where("created_by_document_id IS NOT NULL AND provision_id IS NOT NULL").select(F.col("created_by_document_id").alias("document_id"), "provision_id").distinct()
    p = unique_provisions(provision).select(F.col("id").alias("provision_id"), "instrument_id")
    i = instrument.select(F.col("id").alias("instrument_id"), "slug")
    pairs = made.join(p, "provision_id").join(i, "instrument_id").select("document_id", "slug").distinct()
    return pairs.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("slug")), ", ").alias("affects"), F.count("*").alias("n_instruments"))


def best_file(pdf_text: DataFrame) -> DataFrame:
    """One attachment a document: a PDF first, then not scanned, then most pages, then lowest id."""
    is_pdf = F.coalesce(F.lower("filename").endswith(".pdf"), F.lit(False))
    w = Window.partitionBy("document_id").orderBy(is_pdf.desc(), F.coalesce("ocr_used", F.lit(False)).asc(), F.col("page_count").desc_nulls_last(), F.col("attachment_id"))
    return pdf_text.where("document_id IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("document_id", "attachment_id", "filename", "page_count")


def filter_documents(document: DataFrame, regulators: list[str] | None = None, doc_type: str | None = None, words: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """A conjunction of the given scopes; user text is matched literally, its wildcards escaped."""
    out = document
    if regulators:
        out = out.where(F.col("regulator_code").isin(regulators))
    if doc_type:
        out = out.where(F.col("doc_type") == doc_type)
    if words:
        out = out.where(F.contains(F.lower("title"), F.lower(F.lit(words))))
    if since:
        out = out.where(F.col("date_issued") >= F.lit(since).cast("date"))
    if until:
        out = out.where(F.col("date_issued") < F.lit(until).cast("date"))
    return out


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    return rows.orderBy(*newest("date_issued", "id")).offset((number - 1) * size).limit(size)


def counts_by_regulator(regulator: DataFrame, document: DataFrame, today: str) -> DataFrame:
    d = F.lit(today).cast("date")
    n = document.groupBy(F.col("regulator_code").alias("code")).agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("date_issued").between(F.date_sub(d, 30), d)).alias("last_30_days"),
        F.count_if(F.col("date_issued").between(F.date_sub(d, 90), d)).alias("last_90_days"),
        F.count_if(F.col("is_amending").eqNullSafe(True)).alias("amending"),
        F.max("date_issued").alias("newest"),
    )
    joined = regulator.select("code", "name").join(n, "code", "left")
    return joined.fillna(0, ["documents", "last_30_days", "last_90_days", "amending"]).withColumn("newest", F.coalesce(F.date_format("newest", "yyyy-MM-dd"), F.lit("")))


def instrument_overview(instrument: DataFrame, provision: DataFrame, chains: DataFrame, provision_version: DataFrame) -> DataFrame:
    """Eleven measures of each instrument in one pass over provisions and one over versions."""
    p = unique_provisions(provision)
    of_p = p.groupBy("instrument_id").agg(
        F.count("*").alias("provisions"), F.count_if(F.lower("level") == "chapter").alias("chapters"), F.count("heading").alias("headed"),
        F.count("pdf_page").alias("paged"), F.max("pdf_page").alias("last_page"), F.count_if(F.col("parent_id").isNull() & F.col("parent_number").isNull()).alias("tops"),
    )
    owner = p.select(F.col("id").alias("provision_id"), "instrument_id")
    of_v = chains.join(owner, "provision_id").groupBy("instrument_id").agg(
        F.count("*").alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("source_kind") == "machine_merged").alias("machine"), F.max("valid_from").alias("newest")
    )
    made = provision_version.where("created_by_document_id IS NOT NULL").join(owner, "provision_id").groupBy("instrument_id").agg(F.countDistinct("created_by_document_id").alias("documents"))
    out = instrument.select(F.col("id").alias("instrument_id"), "slug").join(of_p, "instrument_id", "left").join(of_v, "instrument_id", "left").join(made, "instrument_id", "left")
    numbers = ["provisions", "chapters", "headed", "paged", "last_page", "tops", "versions", "current", "machine", "documents"]
    return out.fillna(0, numbers).withColumn("newest", F.coalesce(F.date_format("newest", "yyyy-MM-dd"), F.lit("")))


def history_pairs(chains: DataFrame) -> DataFrame:
    """Each version with the one before it, and by how many days they are apart."""
    w = Window.partitionBy("provision_id").orderBy(F.col("valid_from").asc_nulls_first())
    out = chains.withColumn("before_id", F.lag("version_id").over(w)).withColumn("gap_days", F.datediff("valid_from", F.lag("valid_to").over(w))).withColumn("version_no", F.row_number().over(w))
    return out.select("provision_id", "version_no", "version_id", "before_id", "gap_days", "source_kind")


#: Texts that stand for a provision that is gone, and how amendment notes begin.
GONE = ("deleted", "omitted", "blank", "repealed", "reserved")
NOTES = ("Ins.", "Inserted by", "Subs.", "Substituted by", "Omitted by", "Vide", "Prior to its")
_DELETED = rf"(?i)\[?\s*(?:{'|'.join(GONE)}|\*{{3,}})\s*\]?\s*$"
_FOOTNOTE = r"(?i)^\s*(?:\d+[a-z]?\.?\s*)?(?:" + "|".join(n.replace(".", r"\.") for n in NOTES) + r")(?:[^a-z]|$)"


def quality_flags(current: DataFrame) -> DataFrame:
    """(provision_id, flag) of current versions (provision_id, instrument_id, level, text); a text may have several flags."""
    rows = current.where("text IS NOT NULL AND (level IS NULL OR lower(level) <> 'chapter')").withColumn("t", F.trim("text")).where(~F.col("t").rlike(_DELETED))
    twice = F.count("*").over(Window.partitionBy("instrument_id", F.md5("text"))) > 1
    piped = F.contains("t", F.lit("|"))
    flags = {
        "table_row": piped & (F.length("t") < 200),
        "heading_only": (F.length("t") < 90) & ~piped & ~F.col("t").rlike("[,;:]"),
        "footnote": F.col("t").rlike(_FOOTNOTE),
        "duplicate_text": F.col("_twice"),
    }
    rows = rows.withColumn("_twice", twice)
    named = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())))
    return rows.select("provision_id", "instrument_id", F.explode(named).alias("flag"))


def in_ranges(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with _range: consecutive stretches of (group, order) of about equal size, so a group with a third of all rows has a third of the ranges."""
    return materialise(rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("_range", F.spark_partition_id()))


def placed(ranged: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """Rows of ``in_ranges`` with place, from 1 in each group: the place in the range and the sizes of the group's ranges before it."""
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    sizes = sizes.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order))
    rows = ranged.withColumn("_within", within).join(sizes, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.withColumn("place", (F.col("_within") + F.col("_before")).cast("long")).drop("_within", "_before", "_g", "_r", "_range")


def _reading() -> list[Column]:
    return [F.col("sort_key").asc_nulls_last(), F.col("id").asc()]


def chapters_carried(provision: DataFrame) -> DataFrame:
    """Each provision with the chapter heading last seen before it in its instrument's order: in its range, else the last one of the ranges before."""
    p = in_ranges(unique_provisions(provision).select("id", "instrument_id", "number", "level", "sort_key"), "instrument_id", _reading())
    own = F.when(F.lower("level") == "chapter", F.col("number"))
    p = p.withColumn("_own", own)
    w = Window.partitionBy("instrument_id", "_range").orderBy(*_reading()).rowsBetween(Window.unboundedPreceding, 0)
    last = p.withColumn("_last", F.last("_own", ignorenulls=True).over(w)).withColumn("_at", F.row_number().over(Window.partitionBy("instrument_id", "_range").orderBy(*_reading())))
    ends = last.groupBy("instrument_id", "_range").agg(F.max_by("_last", "_at").alias("_end"))
    carried = F.last("_end", ignorenulls=True).over(Window.partitionBy("instrument_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ends = ends.select(F.col("instrument_id").alias("_g"), F.col("_range").alias("_r"), carried.alias("_carried"))
    rows = last.join(ends, F.col("instrument_id").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return rows.select("id", "instrument_id", "number", F.coalesce("_last", "_carried").alias("chapter"))


def neighbours(provision: DataFrame) -> DataFrame:
    """Previous and next provision in reading order, chapters left out: those of the places before and after."""
    rows = unique_provisions(provision).where("level IS NULL OR lower(level) <> 'chapter'").select("id", "instrument_id", "sort_key")
    p = materialise(placed(in_ranges(rows, "instrument_id", _reading()), "instrument_id", _reading()).select("id", "instrument_id", "place"))
    at = lambda by, name: p.select(F.col("instrument_id").alias(f"_g{name}"), (F.col("place") + by).alias(f"_p{name}"), F.col("id").alias(name))
    for by, name in ((1, "before_id"), (-1, "after_id")):
        p = p.join(at(by, name), F.col("instrument_id").eqNullSafe(F.col(f"_g{name}")) & (F.col("place") == F.col(f"_p{name}")), "left").drop(f"_g{name}", f"_p{name}")
    return p.select("id", "instrument_id", "before_id", "after_id", "place")


def around(provision: DataFrame, number: str, window: int = 60) -> DataFrame:
    """The reading window around a number in each instrument: a third of it before."""
    p = neighbours(provision)
    at = unique_provisions(provision).where(number_key("number") == number_key(F.lit(number))).select("id").join(p.select("id", "instrument_id", "place"), "id").groupBy("instrument_id").agg(F.min("place").alias("at"))
    return p.join(at, "instrument_id").where((F.col("place") >= F.col("at") - window // 3) & (F.col("place") < F.col("at") - window // 3 + window)).select("instrument_id", "id", "place")


def numbered_again(provision: DataFrame) -> DataFrame:
    """Labels that stay unique: the second use of a whole number in an instrument becomes 'n (2)'; what has no number has no label."""
    w = Window.partitionBy("instrument_id", "number").orderBy(F.col("sort_key").asc_nulls_last(), "id")
    label = F.when(F.col("_n") > 1, F.concat("number", F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(F.col("number"))
    p = unique_provisions(provision).withColumn("_n", F.row_number().over(w))
    return p.select("id", "instrument_id", label.alias("label"))


def natural_order(provision: DataFrame) -> DataFrame:
    """Places in legal number order within an instrument: 80 < 80A < 80AA, what has no number last."""
    n = F.when(F.col("number").rlike(r"^\s*\d{1,9}"), F.regexp_extract("number", r"^\s*(\d{1,9})", 1).cast("int"))
    suffix = F.upper(F.regexp_extract("number", r"^\s*\d{1,9}\s*([A-Za-z]*)", 1))
    rows = unique_provisions(provision).select("id", "instrument_id", n.alias("_n1"), suffix.alias("_n2"))
    order = [F.col("_n1").asc_nulls_last(), F.col("_n2").asc_nulls_first(), F.col("id").asc()]
    return placed(in_ranges(rows, "instrument_id", order), "instrument_id", order).select("id", "instrument_id", "place")


def sitemap(provision: DataFrame, instrument: DataFrame, chains: DataFrame) -> DataFrame:
    """Pages worth listing with the later of their dates: current versions of more than 200 characters, and the instruments."""
    p = unique_provisions(provision).select(F.col("id").alias("provision_id"), "instrument_id", "number")
    i = instrument.select(F.col("id").alias("instrument_id"), "slug", F.col("official_updated_as_on").alias("updated"))
    long = as_on(chains, None).where(F.length("text") > 200).join(p, "provision_id").join(i, "instrument_id")
    pages = long.select(F.concat_ws("/", F.lit(""), F.lit("browse"), "slug", F.url_encode("number")).alias("path"), F.greatest("valid_from", "updated").alias("d"))
    roots = i.select(F.concat_ws("/", F.lit(""), F.lit("browse"), "slug").alias("path"), F.col("updated").alias("d"))
    return pages.unionByName(roots).groupBy("path").agg(F.coalesce(F.date_format(F.max("d"), "yyyy-MM-dd"), F.lit("")).alias("last_modified"))


def linked_documents(document: DataFrame, provision_version: DataFrame, provision: DataFrame) -> DataFrame:
    """Documents linked to a provision by having made a version of it, or by naming its number in their title where they are about its instrument: a union of two equi joins, not an OR."""
    p = unique_provisions(provision).select(F.col("id").alias("provision_id"), "instrument_id", number_key("number").alias("n"))
    made = provision_version.where("created_by_document_id IS NOT NULL").select(F.col("created_by_document_id").alias("id"), "provision_id").distinct()
    first = document.select("id").join(made, "id").select("id", "provision_id", F.lit("made").alias("link"))
    about = made.join(p.select("provision_id", "instrument_id"), "provision_id").select("id", "instrument_id").distinct()
    cited = document.select("id", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(r"(?i)\b(?:section|rule|regulation|paragraph)\s+(\d+[A-Za-z]?)"), 1))).alias("n"))
    second = cited.withColumn("n", F.upper("n")).join(about, "id").join(p, ["instrument_id", "n"]).select("id", "provision_id", F.lit("named").alias("link"))
    return first.unionByName(second).groupBy("id", "provision_id").agg(F.min("link").alias("link"))


def suggestions(raw: str, provision: DataFrame, instrument: DataFrame, document: DataFrame, limit: int = 12) -> DataFrame:
    """Type-ahead: four branches, each with its own order and cap, then one order over all."""
    q = F.lower(F.lit(raw))
    p = unique_provisions(provision).join(instrument.select(F.col("id").alias("instrument_id"), F.col("short_code").alias("code")), "instrument_id", "left").withColumn("code", F.coalesce("code", F.lit("")))

    def branch(rows: DataFrame, grp: int, exact: Column, size: Column, text: str, order: list, cap: int) -> DataFrame:
        rows = rows.withColumn("_exact", F.coalesce(exact, F.lit(False)).cast("int")).withColumn("_len", size)
        return rows.orderBy(*order, "id").limit(cap).select(F.lit(grp).alias("grp"), F.col("_exact").alias("exact"), F.col("_len").cast("int").alias("len"), F.col(text).alias("text"), F.col("id").cast("long").alias("id"))

    one = branch(p.where(F.startswith(F.lower("number"), q)), 1, F.lower("number") == q, F.length("number"), "number", [F.col("_exact").desc(), "_len", "code"], 14)
    two = branch(p.where(F.contains(F.lower("heading"), q)), 2, F.lit(False), F.length("heading"), "heading", ["_len", "code"], 12)
    three = branch(instrument.where(F.contains(F.lower("title"), q) | F.contains(F.lower("short_code"), q)), 3, F.lower("short_code") == q, F.length("title"), "title", [F.col("_exact").desc(), "_len"], 10)
    four = branch(document.where(F.contains(F.lower("number"), q)), 4, F.lower("number") == q, F.lit(0), "number", [F.col("_exact").desc(), F.col("date_issued").desc_nulls_last()], 12)
    return one.unionByName(two).unionByName(three).unionByName(four).orderBy("grp", F.col("exact").desc(), "len", "text", "id").limit(limit)
