import random

from lexmill.llm import quality as Q

COMMON = frozenset("the of a and to in is be shall by for on it with as was under".split())
NOUNS = "registrar deposit authority licence notice charge bank vessel".split()


def make(kind, rng):
    n = lambda: rng.choice(NOUNS)
    if kind == "prose":
        return "\n".join(f"The {n()} of the {n()} shall be paid to the {n()} by the {n()}, and it is for the {n()} to hold." for _ in range(rng.randrange(2, 6)))
    if kind == "table":
        return "\n".join(f"{n()} | {rng.randrange(9999)} | {rng.random():.2f}" for _ in range(8))
    if kind == "list":
        return "\n".join(rng.choice([f"- {n()} {n()}", f"{n()} {n()}"]) for _ in range(9))
    return rng.choice(["".join(rng.choice("$#@~^%z q;") for _ in range(300)), "=_" * 100, f"{n()} " * 80, "\n".join(f"if(x{i}>{i}){{return y[{i}];}}" for i in range(9))])


def test_kinds(spark):
    rng = random.Random(1)
    truth = {i: rng.choice(["prose"] * 6 + ["table", "list", "junk"]) for i in range(300)}
    rows = [(i, make(k, rng), "x") for i, k in truth.items()] + [(900, None, "x"), (901, "", "x"), (902, " \n\t", "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, kind string")
    stats = Q.statistics(df, "id", "text", COMMON)
    got = {r["id"]: r["kind"] for r in Q.text_kinds(stats).collect()}
    assert set(got) == set(truth)
    assert sum(got[i] == k for i, k in truth.items()) >= 0.97 * len(truth)
    blank = stats.where("id >= 900").collect()
    assert all(r["n_words"] == 0 and r["common_share"] is None for r in blank)


def test_statistics_of_a_text(spark):
    df = spark.createDataFrame([(1, "The cat is 12.\nno end")], "id bigint, text string")
    r = Q.statistics(df, "id", "text", COMMON).first()
    assert r["n_words"] == 6 and r["punctuated_lines"] == 0.5 and r["common_share"] == 2 / 5
    assert abs(r["mean_word_length"] - 16 / 6) < 1e-9 and abs(r["digit_share"] - 2 / 16) < 1e-9


def test_major_part_decides():
    reader = Q.Reader(COMMON)
    names = [n for n, _ in Q._STATS]
    mixed = "The deposit of the bank shall be paid to the authority by the registrar.\n" + "vessel | 12 | 3\n" * 20
    row = dict(zip(names, reader.text(mixed)))
    assert row["table_share"] > 0.5 > row["prose_share"] > 0


def test_empty(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    assert Q.text_kinds(Q.statistics(df, "id", "text", COMMON)).count() == 0


def test_digits_of_other_scripts_are_digits(spark):
    df = spark.createDataFrame([(1, "संख्या १२३४५६७८९०१२"), (2, "number 123456789012")], "id bigint, text string")
    out = {r["id"]: r for r in Q.statistics(df, "id", "text", COMMON).collect()}
    assert out[1]["symbol_share"] == out[2]["symbol_share"] == 0 and out[1]["digit_share"] == out[2]["digit_share"] == 12 / 18


def test_only_space_tab_cr_and_lf_part_words(spark):
    df = spark.createDataFrame([(1, "one\xa0word here\tand\r\nmore")], "id bigint, text string")
    assert Q.statistics(df, "id", "text", COMMON).first()["n_words"] == 3


def test_what_is_learnt_of_the_functions(spark):
    rng = random.Random(2)
    rows = [(i, make(rng.choice(["prose"] * 6 + ["table", "list", "junk"]), rng)) for i in range(300)]
    out = Q.accuracies(Q.statistics(spark.createDataFrame(rows, "id bigint, text string"), "id", "text", COMMON)).collect()
    assert len(out) == len(Q.VOTES) + len(Q.KINDS)
    assert all(r["fires_on_kind"] > r["fires_on_others"] for r in out)
    assert all(0 <= r["precision"] <= 1 for r in out if r["n_fired"])


def test_a_wrong_function_loses_its_weight():
    """Three functions agree, a fourth votes for the other kind at random: learning finds that it says nothing."""
    rng = random.Random(5)
    n, counts = len(Q.VOTES), {}
    table = [i for i, (k, _) in enumerate(Q.VOTES) if k == "table"]
    prose = [i for i, (k, _) in enumerate(Q.VOTES) if k == "prose"]
    junk = next(i for i, (k, _) in enumerate(Q.VOTES) if k == "junk")
    for _ in range(4000):
        mine, look = (table, 3) if rng.random() < 0.3 else (prose, 1)
        p = sum(1 << i for i in mine if rng.random() < 0.9) | (1 << junk if rng.random() < 0.5 else 0) | look << n
        counts[p] = counts.get(p, 0) + 1
    posterior, fires, _ = Q.learn(sorted(counts.items()))
    assert abs(fires[junk][0] - 0.5) < 0.05 and abs(fires[junk][2] - 0.5) < 0.05
    assert all(p.argmax() == (2 if pattern >> n == 3 else 0) for pattern, p in posterior.items())
