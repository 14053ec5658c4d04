from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lexmill.operators import incremental as I
from lexmill.sources import listings as L
from lexmill.sources import sinks
from lexmill.streaming import news


def test_windows_adjoin(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, at timestamp")
    ids = lambda a, b: {r["id"] for r in I.window(df, "at", a, b).collect()}
    assert ids("2024-01-01", "2024-01-02") | ids("2024-01-02", "2024-01-03") == ids("2024-01-01", "2024-01-03")


def test_collapse_boundary(spark):
    rows = [("a", datetime(2024, 6, d).date(), n) for d, n in enumerate([100, 100, 100, 100, 100, 100, 39, 39, 40], 1)]
    df = spark.createDataFrame(rows, "s string, day date, n bigint")
    out = [r["collapsed"] for r in I.collapse(df, "s", "day", "n").orderBy("day").collect()]
    assert out == [False] * 7 + [True, False]


def test_collapse_cases(spark):
    """Cases: no run before, failed runs, a null before, a single dip, too few runs, a small median, the new year."""
    day = lambda n: (datetime(2024, 1, 1) + timedelta(days=n)).date()
    last = {
        "dip": ([100] * 5 + [5], False), "cliff": ([1283] * 5 + [5, 5], True), "null": ([100] * 5 + [None, 5], False), "null_after": ([100] * 5 + [5, None, 5], True),
        "floor": ([100] * 5 + [40, 40], False), "few": ([100, 100, 1, 1], False), "small": ([9] * 5 + [1, 1], False), "alone": ([1], False),
    }
    rows = [(s, day(199 + i), n, True) for s, (found, _) in last.items() for i, n in enumerate(found)]
    rows += [("failed", day(199 + i), n, ok) for i, (n, ok) in enumerate([(100, True)] * 5 + [(5, False), (5, True)])]
    rows += [("january", day(20 + i), n, True) for i, n in enumerate([100] * 5 + [1] * 6)]
    df = spark.createDataFrame(rows, "s string, day date, n bigint, ok boolean")
    got = {}
    for r in I.collapse(df, "s", "day", "n", "ok").orderBy("s", "day").collect():
        got.setdefault(r["s"], []).append(r["collapsed"])
    assert {s: x[-1] for s, x in got.items()} == {s: want for s, (_, want) in last.items()} | {"failed": False, "january": True}
    assert got["january"] == [False] * 10 + [True]  # the 31st of January is the first day that counts


def test_stale_jobs_are_rescued_in_the_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    parts = [[(1, "start", at(0)), (2, "start", at(1)), (2, "done", at(5))], [(3, "start", at(40))], [(4, "queue", at(41))]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "job_id bigint, event string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("job_id bigint, event string, ts timestamp").parquet(str(tmp_path / "in"))
        out = news.job_states(stream).writeStream.foreachBatch(lambda b, n, i=i: b.write.mode("overwrite").parquet(str(tmp_path / f"out-{i}-{n}")))
        out.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    states = {}
    for p in sorted(tmp_path.glob("out-*"), key=lambda p: [int(x) for x in p.name.split("-")[1:]]):
        states |= {r["job_id"]: r["state"] for r in spark.read.parquet(str(p)).collect()}
    whole = spark.createDataFrame([r for p in parts for r in p], "job_id bigint, event string, ts timestamp")
    assert states == {r["job_id"]: r["state"] for r in I.job_states(whole).collect()} == {1: "rescued", 2: "done", 3: "running", 4: "queued"}


def test_jobs_batch_and_stream_agree(spark, tmp_path):
    log = [(1, "start", 1), (1, "fail", 2), (1, "start", 3), (1, "done", 4), (2, "start", 1), (2, "fail", 2), (2, "start", 3), (2, "fail", 4), (2, "start", 5), (2, "fail", 6), (3, "queue", 6)]
    df = spark.createDataFrame([(j, e, datetime(2024, 1, 1, 0, m)) for j, e, m in log], "job_id bigint, event string, ts timestamp")
    batch = {r["job_id"]: r["state"] for r in I.job_states(df).collect()}
    assert batch == {1: "done", 2: "failed", 3: "queued"}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = news.job_states(stream).writeStream.format("memory").queryName("jobs").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r["job_id"]: r["state"] for r in spark.table("jobs").collect()} == batch


def test_digest_stream_is_idempotent(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        news.run_digest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()


def test_daily_counts_stream(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = news.daily_counts(stream).writeStream.format("memory").queryName("days").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("views")).first()[0] == src.count()


def test_upsert_keeps_old_where_new_is_null(spark):
    held = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, title string, heading string").withColumn("_in", F.lit(1))
    new = spark.createDataFrame([(2, "c", None), (3, "d", "z")], "k int, title string, heading string").withColumn("_in", F.lit(1))
    out = {tuple(r) for r in I.upsert(held, new, ["k"], ["heading"]).collect()}
    assert out == {(1, "a", "x"), (2, "c", "y"), (3, "d", "z")}


def test_listings_and_sinks(spark, tmp_path):
    page = "<table><tr><td>Jan 02, 2024</td></tr><tr><td><a href='/a'>First</a></td></tr><tr><td><a href='/a'>Again</a></td></tr><tr><td>Jan 03, 2024</td></tr><tr><td><a href='/b'>Second, \"quoted\"</a></td></tr></table>"
    (tmp_path / "l.html").write_text(page)
    rows = L.html_listing(spark, str(tmp_path / "l.html"))
    assert {(r["date"], r["title"], r["url"]) for r in rows.collect()} == {("Jan 02, 2024", "First", "/a"), ("Jan 03, 2024", 'Second, "quoted"', "/b")}
    (tmp_path / "m.json").write_text('[{"docIdentifier": "D1", "docName": "G.S.R. 1"}, {"docIdentifier": 5}]')
    assert L.json_listing(spark, str(tmp_path / "m.json"), L.MCA).count() == 2
    (tmp_path / "p.json").write_text('{"pages": ["one", "two"]}')
    assert [r["page_no"] for r in L.pages(spark, str(tmp_path / "p.json")).collect()] == [1, 2]
    assert L.unwrap('{"data": "JVBERg=="}') == b"%PDF" and L.unwrap("x") is None
    sinks.csv(rows, str(tmp_path / "csv"), ("date", "title", "url"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["title"] for r in back.collect()} == {"First", 'Second, "quoted"'}
