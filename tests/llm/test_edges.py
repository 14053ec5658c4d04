"""Very long texts, columns whose names the operators use themselves, ties and repeated rows."""

from pyspark.sql import functions as F

from lexmill.llm import neardup, packing, quality, repeated, scanned

CLASHING = ["key", "keys", "n", "_n", "_p", "rep", "symbols", "kind", "pattern", "rank", "place", "word", "x", "_cut", "size", "n_docs", "total", "pieces", "title_"]


def clash(df):
    for c in CLASHING:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1))
    return df


def test_repeated_lines(spark):
    rows = [(i, "s", "shared line of the site\n" * 3 + f"own line {chr(97 + i)} of it") for i in range(6)] + [(9, "s", "another long line here\n" * 60_000)]
    df = clash(spark.createDataFrame(rows, "document_id bigint, source string, text string"))
    found = repeated.repeated_lines(df)
    assert found.groupBy("document_id").count().where("count = 3").count() == 6 and found.count() == 18
    clean = repeated.without_lines(df, found)
    assert clean.columns == df.columns and clean.where("document_id = 9").first()["text"] == rows[-1][2]


def test_near_duplicates(spark):
    long = " ".join(f"w{i % 9973}x{i % 31}" for i in range(120_000))
    rows = [(1, None, long), (2, "t", long + " more"), (2, "t", long + " more"), (3, None, "a b c d e f g h")]
    df = clash(spark.createDataFrame(rows, "id bigint, title string, text string"))
    out = neardup.expand(*neardup.near_duplicates(df)).collect()
    assert [(r["id_a"], r["id_b"]) for r in out] == [(1, 2)]


def test_text_types(spark):
    rows = [(1, "The bank of the port shall be in the act. " * 30_000), (2, "a | 12 | 3\n" * 30_000), (3, "?" * 300_000), (3, "?" * 300_000)]
    df = clash(spark.createDataFrame(rows, "id bigint, text string"))
    stats = quality.statistics(df, "id", "text", frozenset("the of be in shall".split()))
    kinds = sorted((r["id"], r["kind"]) for r in quality.text_kinds(clash(stats)).collect())
    assert kinds == [(1, "prose"), (2, "table"), (3, "junk"), (3, "junk")]


def test_scans(spark):
    text = "\n".join(["The authority shall furnish the notice to the de-", "partment in the rnonth."] * 4000)
    items = clash(spark.createDataFrame([("t", 1, None, text)], "item_table string, item_id bigint, title string, text string"))
    clean = clash(spark.createDataFrame([("The authority shall furnish the notice to the department in the month. " * 40,)], "text string"))
    out = scanned.noise(items, clean).groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in out} == {"break": 4000, "misread": 4000}


def test_packing(spark):
    df = clash(spark.createDataFrame([(1, 5000), (1, 5000), (2, 7), (3, 7)], "id bigint, n bigint"))
    out = packing.pack(df, 2048).collect()
    assert sorted((r["id"], r["part_no"], r["size"]) for r in out) == [(1, 1, 2048), (1, 1, 2048), (1, 2, 2048), (1, 2, 2048), (1, 3, 904), (1, 3, 904), (2, 1, 7), (3, 1, 7)]
