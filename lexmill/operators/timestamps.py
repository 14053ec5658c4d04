"""Mixed timestamp strings to one instant.

Parsing, conversion and the choice of a zone are column expressions and equi joins; no Python runs over rows.

``normalise_timestamps`` takes rows (feed, row_key, field, value, zone, month_first) and returns the distinct instants:

* a zone or offset in the value holds; letters are those in use in the row's zone;
* a value without one follows the row's zone; rows that state no zone get one by ``estimate_zones``, which lays candidate offset histories over
  the zoneless values of a feed and field in the order of the feed and keeps the one with the fewest violations;
* a wall time that occurs twice is the earlier one, a skipped one takes the offset before the change;
* a date alone is its midnight; all-digit values count seconds, from twelve digits on milliseconds; digits finer than a
  microsecond are cut off.

Defined results: null, blank, unreadable and impossible values give no row; an unknown zone name counts as no zone; equal
rows give one row; an empty input gives an empty result. Columns beside the named ones are ignored. ``seq`` (the place in the feed) and ``seen_us`` (when
the row was taken in) may be there or not, and null.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import local_table, materialise

DEFAULT_ZONE = "Asia/Kolkata"
#: Offset histories tried for rows that state no zone.
CANDIDATE_ZONES = ("Asia/Kolkata", "UTC", "Europe/London", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "Asia/Singapore")
#: Places along a feed at which its offset history may change, what a change costs in violations, how many fewer violations
#: another zone than the default must have, and how long before it was taken in a value may lie.
SLOTS, CHANGE, LEAD, LAG_US = 256, 4, 3, 400 * 86_400_000_000

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH_NAME = r"^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
_TIME = r"(?:[T,\s]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?:\s*([AaPp])\.?[Mm]\.?)?)?"
_ZONE = r"\s*(Z|z|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5})?\s*(?:\[([^\]]+)\])?"
_DATE = (
    r"(?:(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"  # 1-3 year first
    r"|(\d{1,2})([-/.])(\d{1,2})[-/.](\d{4})"  # 4-7 numeric, year last
    r"|(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})[-\s]([A-Za-z]{3,9})\.?,?[-\s]\s*(\d{4}))"  # 8-10 named month
)
_CALENDAR = f"^{_DATE}{_TIME}{_ZONE}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*(Z|z|[+-]\d{2}(?::?\d{2})?|[A-Za-z]{2,5})?\s*(?:\[([^\]]+)\])?$"
_SEP = "\x01"


@lru_cache(maxsize=1)
def zone_letters() -> tuple[tuple[str, str, int], ...]:
    """(zone, letters, offset in minutes) of the letters in use since 2000, from the time zone database."""
    found = {}
    for name in available_timezones():
        zone = ZoneInfo(name)
        for year in range(2000, 2038):
            for month in (1, 4, 7, 10):
                at = datetime(year, month, 15, tzinfo=timezone.utc).astimezone(zone)
                letters = at.tzname()
                if letters and letters.isalpha():
                    found[name, letters.upper()] = int(at.utcoffset().total_seconds() // 60)
    return tuple(sorted((*key, minutes) for key, minutes in found.items()))


_PARTS = ("y1", "m1", "d1", "a", "sep", "b", "y2", "d3", "mon", "y3", "h", "mi", "s", "frac", "half", "zone", "region")
_OF_CALENDAR = _SEP.join(f"${i}" for i in range(1, 18))
_OF_COMPACT = _SEP.join(["$1", "$2", "$3", *[""] * 7, "$4", "$5", "$6", "$7", "", "$8", "$9"])


def _fields(value: Column) -> Column:
    """The value's parts in the order of _PARTS, '' for a part that is not there; null for a value of no known form."""
    one = F.when(value.rlike(_COMPACT), F.regexp_replace(value, _COMPACT, _OF_COMPACT)).when(value.rlike(_CALENDAR), F.regexp_replace(value, _CALENDAR, _OF_CALENDAR))
    return F.split(one, _SEP)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; plain columns would be spelled out again wherever filters are pushed to."""
    return F.transform(F.array(value), use)[0]


def _number(s: Column) -> Column:
    """Null for what is no number; the check comes first, as a failed try_cast costs an exception inside."""
    return F.when(s.rlike("^[0-9]{1,9}$"), s.cast("int"))


def _wall(p: Column, n: Column, first_is_month: Column) -> Column:
    """Microseconds of the wall clock, null if the day or time does not exist."""
    of = _PARTS.index
    a, b = F.when(first_is_month, n[of("b")]).otherwise(n[of("a")]), F.when(first_is_month, n[of("a")]).otherwise(n[of("b")])
    name = F.lower(p[of("mon")])
    named = F.when(name.rlike(_MONTH_NAME), ((F.instr(F.lit("".join(_MONTHS)), F.substring(name, 1, 3)) + 2) / 3).cast("int"))
    year = F.lpad(F.coalesce(n[of("y1")], n[of("y2")], n[of("y3")]).cast("string"), 4, "0")
    month, day = F.coalesce(n[of("m1")], b, named).cast("string"), F.coalesce(n[of("d1")], a, n[of("d3")]).cast("string")
    days = F.unix_date(F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date")).cast("long")
    half = F.lower(p[of("half")])

    def seconds(t: Column) -> Column:
        hour = F.when(half == "", F.when(t["h"] < 24, t["h"])).when(t["h"].between(1, 12), t["h"] % 12 + F.when(half == "p", 12).otherwise(0))
        return F.when((t["mi"] < 60) & (t["s"] < 60), hour * 3600 + t["mi"] * 60 + t["s"])

    time = _let(F.struct(*(F.coalesce(n[of(k)], F.lit(0)).alias(k) for k in ("h", "mi", "s"))), seconds)
    micros = F.coalesce(_number(F.when(p[of("frac")] != "", F.rpad(F.substring(p[of("frac")], 1, 6), 6, "0"))), F.lit(0))
    return (days * 86400 + time) * F.lit(1_000_000).cast("long") + micros


def _read(p: Column, n: Column, first_is_month: Column) -> Column:
    mark = F.upper(p[_PARTS.index("zone")])
    region = F.nullif(p[_PARTS.index("region")], F.lit(""))

    def rest(m: Column) -> Column:
        hours, minutes = _number(m[2]), F.coalesce(_number(m[3]), F.lit(0))
        known = F.when((hours <= 18) & (minutes < 60), (hours * 60 + minutes) * F.when(m[1] == "-", -1).otherwise(1))
        offset = F.when(m[0].isin("Z", "UTC", "GMT", "UT"), F.lit(0)).when(m[1] != "", known)
        letters = F.when((m[1] == "") & (m[0] != "") & ~m[0].isin("Z", "UTC", "GMT", "UT"), m[0])
        unit = F.when(p[_PARTS.index("h")] == "", 86_400_000_000).when(p[_PARTS.index("s")] == "", 60_000_000).otherwise(1_000_000).cast("long")
        return F.struct(_wall(p, n, first_is_month).alias("local_us"), offset.alias("offset_min"), letters.alias("letters"), region.alias("region"), unit.alias("unit_us"))

    number = r"([+-])(\d{1,2})(?::?(\d{2}))?$"
    return _let(F.array(mark, *(F.regexp_extract(mark, number, g) for g in (1, 2, 3))), rest)


def parse(rows: DataFrame) -> DataFrame:
    """Adds local_us (wall clock in microseconds), offset_min, letters, region and unit_us (how exact it is) to rows with value and month_first.

    local_us is null for values that name no moment. offset_min is set where the value itself gives an offset, and for
    all-digit values.
    """

    def read(v: Column) -> Column:
        digits = F.when(v.rlike(r"^[0-9]{1,18}$"), v.cast("long"))
        micros = F.when(digits < 100_000_000_000, digits * 1_000_000).when(digits < 10**15, digits * 1000)
        none = F.lit(None).cast("string")
        counted = F.struct(micros.alias("local_us"), F.lit(0).alias("offset_min"), none.alias("letters"), none.alias("region"), F.lit(1_000_000).cast("long").alias("unit_us"))
        named = _let(_fields(v), lambda p: _let(F.transform(p, _number), lambda n: _read(p, n, (p[_PARTS.index("sep")] == "/") & F.col("month_first"))))
        return F.when(digits.isNotNull(), counted).otherwise(named)

    return rows.withColumn("_x", _let(F.regexp_replace("value", r"^[ \t\r\n]+|[ \t\r\n]+$", ""), read)).select("*", "_x.*").drop("_x")


def to_epoch(local_us: Column, zone: Column) -> Column:
    """Instant of a wall time in a named zone: of two the earlier one, a skipped one with the offset before the change."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def _with_instants(rows: DataFrame) -> DataFrame:
    """Parsed rows with ``stated_us`` where the value itself fixes the instant, and ``declared``, the row's known zone."""
    spark = rows.sparkSession
    letters = local_table(spark, list(zone_letters()), _zone=pa.string(), _letters=pa.string(), _minutes=pa.int32())
    zones = local_table(spark, [(z,) for z in sorted(available_timezones())], _known=pa.string())
    # Listings repeat themselves: equal readings of a record go on once.
    # The written table also keeps later filters from being spelled out down into the parsing expressions.
    rows = materialise(parse(feed_columns(rows)).select("feed", "row_key", "field", "zone", "local_us", "offset_min", "letters", "region", "unit_us", "seq", "seen_us").distinct()).where("local_us IS NOT NULL")
    # Both tables come from the time zone database: about 600 zones and 1,000 pairs, whatever the data.
    rows = rows.join(F.broadcast(zones), rows["zone"] == zones["_known"], "left").withColumnRenamed("_known", "declared")
    regions = zones.withColumnRenamed("_known", "_region")
    rows = rows.join(F.broadcast(regions), rows["region"] == regions["_region"], "left")
    rows = rows.join(F.broadcast(letters), (F.coalesce(rows["declared"], F.lit(DEFAULT_ZONE)) == letters["_zone"]) & (rows["letters"] == letters["_letters"]), "left")
    minutes = F.coalesce(F.col("offset_min"), F.col("_minutes"))
    stated = F.when(minutes.isNotNull(), F.col("local_us") - minutes * F.lit(60_000_000).cast("long"))
    stated = F.coalesce(stated, F.when(F.col("letters").isNull() & F.col("_region").isNotNull(), to_epoch(F.col("local_us"), F.col("_region"))))
    readable = F.col("local_us").isNotNull() & (F.col("letters").isNull() | stated.isNotNull())
    return rows.withColumn("stated_us", stated).where(readable).select("feed", "row_key", "field", "local_us", "unit_us", "stated_us", "declared", "seq", "seen_us")


def _evidence(parsed: DataFrame) -> DataFrame:
    """(feed, field, seq, local_us, bounds) of zoneless values that can be tested: the ranges [lo, hi] of instants in one of which the value must begin.

    A record that states the same field with a zone elsewhere bounds it by that instant, as exactly as both are written; a row that says when it was taken in
    bounds it by that time and ``LAG_US`` before.
    """
    loose = parsed.where("stated_us IS NULL AND declared IS NULL").select("feed", "row_key", "field", "seq", "local_us", "unit_us", "seen_us").distinct()
    anchors = parsed.where("stated_us IS NOT NULL").select("feed", "row_key", "field", F.col("stated_us").alias("at"), F.col("unit_us").alias("exact")).distinct()
    again = loose.join(anchors, ["feed", "row_key", "field"]).groupBy("feed", "row_key", "field", "seq", "local_us", "unit_us").agg(
        F.collect_set(F.struct((F.col("at") - F.col("unit_us") + 1).alias("lo"), (F.col("at") + F.col("exact") - 1).alias("hi"))).alias("bounds")
    )  # as many as a record has readings
    taken = loose.where("seen_us IS NOT NULL").withColumn("bounds", F.array(F.struct((F.col("seen_us") - LAG_US).alias("lo"), F.col("seen_us").alias("hi"))))
    columns = ["feed", "field", "seq", "local_us", "bounds"]
    return again.select(columns).unionByName(taken.select(columns))


def _pieces(tested: dict[tuple[int, str], tuple[int, int]], order: list[str]) -> list[tuple[int, str]]:
    """(first slot, zone) of the history with the least violations and changes, from (slot, zone): (values, violations); earlier zones win ties."""
    slots = sorted({s for s, _ in tested})
    wrong = {z: [tested.get((s, z), (0, 0))[1] for s in slots] for z in order}
    # The default is followed throughout unless another zone is ahead of it by more than chance.
    cost = {z: (0 if z == order[0] else LEAD) for z in order}
    back: list[dict[str, str]] = []
    for k in range(len(slots)):
        best = min(order, key=lambda z: cost[z])
        before = {z: z if cost[z] <= cost[best] + CHANGE else best for z in order}
        cost = {z: min(cost[z], cost[best] + CHANGE) + wrong[z][k] for z in order}
        back.append(before)
    zone, path = min(order, key=lambda z: cost[z]), []
    for k in range(len(slots) - 1, -1, -1):
        path.append((slots[k], zone))
        zone = back[k][zone]
    path.reverse()
    return [(s if i else 0, z) for i, (s, z) in enumerate(path) if not i or z != path[i - 1][1]]


_HISTORY = dict(
    feed=pa.string(), field=pa.string(), from_seq=pa.int64(), to_seq=pa.int64(), zone=pa.string(), n_tested=pa.int64(), violations=pa.int64(), next_zone=pa.string(), next_violations=pa.int64()
)


def estimate_zones(parsed: DataFrame, candidates: Iterable[str] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE) -> DataFrame:
    """(feed, field, from_seq, to_seq, zone, n_tested, violations, next_zone, next_violations): the offset history of rows that state no zone.

    Along each feed and field the tested values are counted by slot of ``seq`` and candidate, and so are those that the candidate puts outside all their bounds. The
    history is the path through the slots with the least violations, where a change of zone costs ``CHANGE`` and leaving the default ``LEAD`` of them.
    next_zone is the best other zone over the same stretch. Streams without any tested value are not listed and follow the default.
    """
    spark = parsed.sparkSession
    order = [default, *(c for c in candidates if c != default)]
    known = _evidence(parsed).withColumn("seq", F.coalesce("seq", F.lit(0)))
    ends = known.groupBy("feed", "field").agg(F.min("seq").alias("_low"), F.max("seq").alias("_high"))  # one row a stream
    slot = F.floor((F.col("seq") - F.col("_low")) * SLOTS / (F.col("_high") - F.col("_low") + 1)).cast("int")
    tried = known.join(F.broadcast(ends), ["feed", "field"]).withColumn("slot", slot)
    tried = tried.withColumn("_try", F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(z).alias("zone")) for i, z in enumerate(order)))))
    tried = tried.withColumn("_at", to_epoch(F.col("local_us"), F.col("_try.zone")))
    miss = ~F.exists("bounds", lambda b: (F.col("_at") >= b["lo"]) & (F.col("_at") <= b["hi"]))
    votes = tried.groupBy("feed", "field", "_low", "_high", "slot", F.col("_try.zone").alias("zone")).agg(F.count("*").alias("n"), F.count_if(miss).alias("violations"))
    streams: dict[tuple, dict[tuple[int, str], tuple[int, int]]] = {}
    for r in votes.collect():  # at most SLOTS * candidates rows a stream
        streams.setdefault((r["feed"], r["field"], r["_low"], r["_high"]), {})[r["slot"], r["zone"]] = (r["n"], r["violations"])
    rows = []
    for (feed, field, low, high), tested in sorted(streams.items()):
        pieces = _pieces(tested, order)
        for i, (first, zone) in enumerate(pieces):
            last = pieces[i + 1][0] if i + 1 < len(pieces) else SLOTS
            total = {z: [sum(v[k] for (s, y), v in tested.items() if y == z and first <= s < last) for k in (0, 1)] for z in order}
            other = min((z for z in order if z != zone), key=lambda z: total[z][1], default=None)
            at = lambda s: low + -(-s * (high - low + 1) // SLOTS)  # noqa: E731, B023
            rows.append((feed, field, at(first) if i else None, at(last) if last < SLOTS else None, zone, *total[zone], other, total[other][1] if other else None))
    return local_table(spark, rows, **_HISTORY)


def normalise_timestamps(rows: DataFrame, candidates: Iterable[str] = CANDIDATE_ZONES, default: str = DEFAULT_ZONE) -> DataFrame:
    """Distinct (feed, row_key, field, epoch_us) of rows (feed, row_key, field, value, zone, month_first[, seq, seen_us])."""
    parsed = _with_instants(rows)
    chosen = estimate_zones(parsed, candidates, default).select(F.col("feed").alias("_feed"), F.col("field").alias("_field"), "from_seq", "to_seq", F.col("zone").alias("_chosen"))
    seq = F.coalesce("seq", F.lit(0))
    within = (F.col("from_seq").isNull() | (seq >= F.col("from_seq"))) & (F.col("to_seq").isNull() | (seq < F.col("to_seq")))
    # A few rows for each feed and field.
    zoned = parsed.join(F.broadcast(chosen), (F.col("feed") == F.col("_feed")) & (F.col("field") == F.col("_field")) & within, "left")
    epoch = F.coalesce(F.col("stated_us"), to_epoch(F.col("local_us"), F.coalesce(F.col("declared"), F.col("_chosen"), F.lit(default))))
    return zoned.select("feed", "row_key", "field", epoch.alias("epoch_us")).distinct()


def feed_columns(rows: DataFrame) -> DataFrame:
    """The columns that are read, of rows that have a value and a key; optional ones are null where they are not there."""
    of = lambda c: (F.col(c) if c in rows.columns else F.lit(None)).cast("long").alias(c)
    return rows.select("feed", "row_key", "field", "value", "zone", F.coalesce("month_first", F.lit(False)).alias("month_first"), of("seq"), of("seen_us")).where("value IS NOT NULL AND row_key IS NOT NULL")


def feed_rows(df: DataFrame, feed: str, key: str, fields: dict[str, str | None], month_first: bool, seq: Column | None = None) -> DataFrame:
    """The operator's input from a listing: fields names the value columns and, for each, its zone column; seq is the place in the feed."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), (F.col(z) if z else F.lit(None)).cast("string").alias("zone")) for f, z in fields.items()]
    return df.select(F.lit(feed).alias("feed"), F.col(key).cast("string").alias("row_key"), (F.lit(None) if seq is None else seq).cast("long").alias("seq"), F.explode(F.array(*parts)).alias("_x")).select(
        "feed", "row_key", "_x.*", F.lit(month_first).alias("month_first"), "seq"
    )
