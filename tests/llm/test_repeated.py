import random
from collections import Counter, defaultdict

import regex

from lexmill.llm import repeated as R

SCHEMA = "document_id bigint, source string, text string, line_no int"


def key(line):
    return "".join(regex.findall(r"[\p{L}\p{M}]", line.lower()))


def brute(rows):
    held, total = defaultdict(set), Counter()
    for i, s, t in rows:
        if s is not None and t is not None:
            total[s] += 1
            for line in t.split("\n"):
                if len(key(line)) >= 12:
                    held[s, key(line)].add(i)
    good = {k for k, d in held.items() if len(d) >= 5 and len(d) * 20 >= total[k[0]]}
    return {(i, n) for i, s, t in rows if s is not None and t is not None for n, line in enumerate(t.split("\n"), 1) if (s, key(line)) in good}


def test_against_counting(spark):
    rng = random.Random(4)
    lines = ["All rights reserved here", "ALL RIGHTS - reserved, here!", "short", "सर्वाधिकार सुरक्षित हैं सब", "Printed on 1/2/2020", "share this page with friends\r"]
    rows = []
    for i in range(160):
        body = [rng.choice([*lines, *(f"a unique sentence number {chr(97 + i % 26)}{'x' * i}" for _ in range(4))]) for _ in range(rng.randrange(0, 9))]
        rows.append((i, rng.choice(["a", "a", "b", None]), "\n".join(body)))
    rows += [(1000, "a", None), (1001, None, "All rights reserved here"), (1002, "c", "")]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = R.repeated_lines(df).select("document_id", "line_no").collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows) != set()


def test_sequences_and_removal(spark):
    rows = [(i, "s", f"first shared line here\nbody number {chr(97 + i)} of text\nsecond shared line here") for i in range(8)] + [(9, "s", "second shared line here\nfirst shared line here")]
    df = spark.createDataFrame(rows, "document_id bigint, source string, text string")
    seqs = R.frequent_sequences(df).collect()
    assert Counter(len(r["sequence"]) for r in seqs) == {1: 2, 2: 1}
    assert {r["n_docs"] for r in seqs if len(r["sequence"]) == 2} == {8}
    clean = R.without_lines(df, R.repeated_lines(df)).collect()
    assert {r["text"] for r in clean} == {f"body number {chr(97 + i)} of text" for i in range(8)} | {""}


def test_sequences_of_any_length(spark):
    notice = "\n".join(f"line {w} of the legal notice" for w in ("one", "two", "three", "four", "five"))
    df = spark.createDataFrame([(i, "s", notice) for i in range(8)], "document_id bigint, source string, text string")
    assert Counter(len(r["sequence"]) for r in R.frequent_sequences(df).collect()) == {1: 5, 2: 10, 3: 10, 4: 5, 5: 1}
    assert R.frequent_sequences(df.limit(0)).count() == 0


def test_empty(spark):
    assert R.repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_of_a_long_notice(spark):
    notice = [f"notice line number {c * 12}" for c in "abcdefghijklmnopqrst"]
    rows = [(d, "s", "\n".join([f"body of the text {d * 'x'} and more", *notice[: 20 if d < 8 else 3], "other words " + d * "y"])) for d in range(10)]
    df = spark.createDataFrame(rows, "document_id bigint, source string, text string")
    runs, matches = R.frequent_runs(R.line_ids(df))
    assert runs.count() == 20 * 21 // 2
    longest = {r["n_docs"] for r in runs.collect() if len(r["sequence"]) == 20}
    assert longest == {8}
    got = {(r["document_id"], r["line_no"]) for r in R.repeated_lines(df).collect()}
    assert got == {(d, i + 2) for d in range(10) for i in range(20 if d < 8 else 3)}
