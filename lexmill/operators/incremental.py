"""Windows of news, follow matches, run health, retention, merges and the job log.

What the scheduled batch keeps as state is here a parameter: the watermark and the cutoff of a window, the day that counts as today. Two adjoining
windows together give what one over both gives. Nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.catalogue import in_ranges, placed


def instant(day: str) -> Column:
    """Midnight UTC of a day, whatever the session's zone."""
    return F.lit(f"{day}T00:00:00Z").cast("timestamp")


def window(rows: DataFrame, at: str, since: str, cutoff: str) -> DataFrame:
    """Rows of [since, cutoff)."""
    return rows.where((F.col(at) >= instant(since)) & (F.col(at) < instant(cutoff)))


def arrivals(rows: DataFrame, key: str, at: str, since: str, cutoff: str) -> DataFrame:
    """Keys first seen in the window, with how often and when."""
    before = rows.where(F.col(at) < instant(since)).select(key).distinct()
    return window(rows, at, since, cutoff).join(before, key, "left_anti").where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def digest(rows: DataFrame, group: str, order: list[Column], budget: int = 50) -> DataFrame:
    """The rows shown: groups by size, then name, ``budget`` rows in all; every row tells how many of its group are left out."""
    sized = rows.withColumn("n_group", F.count("*").over(Window.partitionBy(group)))
    # Groups are ranked on their own short table; then a row's place is its group's offset and its place within.
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("_n").desc(), group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    placed = sized.withColumn("_in", within).join(ahead, group).withColumn("place", F.col("_before") + F.col("_in")).where(F.col("place") <= budget)
    shown = F.count("*").over(Window.partitionBy(group))
    return placed.withColumn("left_out", F.col("n_group") - shown).drop("_in", "_before")


#: Fixed values of the collapse rule: share of the median, earlier runs needed, least median, days looked back.
COLLAPSE_SHARE, COLLAPSE_SAMPLES, COLLAPSE_MEDIAN, COLLAPSE_DAYS = 0.4, 4, 10, 30


def collapse(runs: DataFrame, source: str, day: str, found: str, ok: str | None = None, least: int = COLLAPSE_MEDIAN, days: int = COLLAPSE_DAYS) -> DataFrame:
    """Runs that found far less than their source usually does: under a share of the median of the days before, as did the last successful run.

    Only successful runs with a count are measured by (all, where ``ok`` names no column). No alarm without a run before, in the first ``days`` days of a year, with
    too few earlier runs, or with a median under ``least``. A run counts for later ones as it was recorded; alarms do not feed back.
    """
    good = F.when(F.col(ok), F.col(found)) if ok else F.col(found)
    number = F.unix_date(day)
    past = Window.partitionBy(source).orderBy(number).rangeBetween(-days, -1)
    before = Window.partitionBy(source).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    rows = runs.withColumn("median", F.percentile(good, F.lit(0.5)).over(past)).withColumn("samples", F.count(good).over(past)).withColumn("previous", F.last(good, ignorenulls=True).over(before))
    floor = F.col("median") * COLLAPSE_SHARE
    down = (F.dayofyear(day) > days) & (F.col("samples") >= COLLAPSE_SAMPLES) & (F.col("median") >= least) & (F.col(found) < floor) & (F.col("previous") < floor)
    return rows.withColumn("collapsed", F.coalesce(down, F.lit(False)))


def empty_after_peak(runs: DataFrame, source: str, day: str, found: str, days: int = 30) -> DataFrame:
    """Runs that found nothing though some run of the ``days`` days before did."""
    number = F.datediff(day, F.lit("1970-01-01").cast("date"))
    peak = F.max(found).over(Window.partitionBy(source).orderBy(number).rangeBetween(-days, -1))
    return runs.withColumn("peak", peak).where((F.col(found) == 0) & (F.col("peak") > 0))


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def retention_candidates(rows: DataFrame, by: str, order: list[Column], n: int, protected: Column, used: float = 1.0, armed: float = 0.7) -> DataFrame:
    """Rows past the newest ``n`` of their group that nothing protects; none while less than ``armed`` of the budget is used. Groups of any size are placed range by range."""
    found = placed(in_ranges(rows, by, order), by, order).where((F.col("place") > n) & ~F.coalesce(protected, F.lit(False))).drop("place")
    return found if used >= armed else found.limit(0)


def upsert(held: DataFrame, incoming: DataFrame, key: list[str], keep_old: list[str]) -> DataFrame:
    """``held`` after ``incoming``: a new value wins, but null does not overwrite the columns of ``keep_old``."""
    both = held.alias("h").join(incoming.alias("n"), [F.col(f"h.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key], "full_outer")
    there = F.col("n._in").isNotNull()
    columns = []
    for c in (x for x in held.columns if x != "_in"):
        old, new = F.col(f"h.{c}"), F.col(f"n.{c}")
        columns.append((F.coalesce(new, old) if c in keep_old or c in key else F.when(there, new).otherwise(old)).alias(c))
    return both.select(*columns)


#: Fixed value: from this similarity on, a machine's text agrees with the official one.
AGREES = 0.97


def refresh_actions(held: DataFrame, incoming: DataFrame, updated_on: str, similarity: str | None = None) -> DataFrame:
    """What an official text does to the version held: insert, unchanged, refresh (same day, official) or new_version; and what it says of a machine's text.

    held: (provision_id, held_text, valid_from, source_kind); incoming: (provision_id, new_text[, similarity of both texts]). Texts are compared without case, quotes
    and white space runs. verdict is matches_official or differs_from_official where the held version is a machine's, else null.
    """
    norm = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "[“”‘’\"']", ""), r"\s+", " ")))
    day = F.lit(updated_on).cast("date")
    rows = incoming.join(held, "provision_id", "left")
    same = norm("held_text") == norm("new_text")
    action = (
        F.when(F.col("source_kind").isNull() & F.col("held_text").isNull(), "insert")
        .when(same, "unchanged")
        .when((F.col("source_kind") == "official") & (F.col("valid_from") == day), "refresh")
        .otherwise("new_version")
    )
    near = same if similarity is None else same | (F.col(similarity) >= AGREES)
    verdict = F.when(F.col("source_kind") == "machine_merged", F.when(near, "matches_official").otherwise("differs_from_official"))
    return rows.select("provision_id", action.alias("action"), verdict.alias("verdict"))


def job_states(events: DataFrame, most: int = 3, stale_minutes: int = 30) -> DataFrame:
    """The state of each job from its log (job_id, event, ts): a failed job is queued again until its third attempt, a run without an
    end for half an hour before the log's end is queued again."""
    last = F.max_by("event", F.struct("ts", "event"))
    jobs = events.groupBy("job_id").agg(last.alias("last"), F.max("ts").alias("last_ts"), F.count_if(F.col("event") == "start").alias("attempts"), F.count_if(F.col("event") == "fail").alias("failures"))
    end = events.agg(F.max("ts").alias("_end"))  # one row
    rows = jobs.crossJoin(F.broadcast(end))
    stale = (F.col("last") == "start") & (F.col("last_ts") < F.col("_end") - F.expr(f"INTERVAL {stale_minutes} MINUTES"))
    state = (
        F.when(F.col("last") == "done", "done").when((F.col("last") == "fail") & (F.col("failures") >= most), "failed").when(F.col("last") == "fail", "queued")
        .when(stale, "rescued").when(F.col("last") == "start", "running").otherwise("queued")
    )
    return rows.select("job_id", state.alias("state"), "attempts", "failures")


#: Fixed value: requests a minute.
LIMIT = 20


def over_limit(events: DataFrame, key: str, at: str, limit: int = LIMIT, span: str = "60 seconds") -> DataFrame:
    """(key, w, n): the spans in which a key has more events than the limit."""
    return events.groupBy(key, F.window(at, span).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit)


_CITING = r"(^|[^0-9a-z])(?:section|sections|sec|rule|rules|regulation|regulations)\s*\.?\s*"


def followed(documents: DataFrame, follows: DataFrame, links: DataFrame) -> DataFrame:
    """(follower, document_id) of documents in the union of: a link to the followed provision, and a title that names the followed number.

    A title names a number if it stands after a word of citation and no letter or digit follows. The number's first run of letters and digits
    must then be the run after that word, so these runs, taken out of titles once, are the key of an equi join with the scope; the
    whole pattern, made from a column with its metacharacters escaped, is the residual. Numbers that start otherwise join on the scope.
    """
    by_link = links.join(follows, "provision_id").select("follower", "document_id")
    number = F.regexp_replace(F.lower("number"), r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    wanted = follows.select("follower", "scope", F.regexp_extract(F.lower("number"), "^[0-9a-z]*", 0).alias("run"), F.concat(F.lit(_CITING), number, F.lit("([^0-9a-z]|$)")).alias("_p")).distinct()
    titles = documents.select("document_id", "scope", F.lower("title").alias("title"))
    runs = titles.withColumn("run", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit(_CITING + "([0-9a-z]+)"), 2))))
    named = runs.join(wanted.where("run <> ''"), ["scope", "run"]).where(F.rlike("title", F.col("_p")))
    other = titles.join(wanted.where("run = ''").drop("run"), "scope").where(F.rlike("title", F.col("_p")))
    return by_link.union(named.select("follower", "document_id")).union(other.select("follower", "document_id")).distinct()
