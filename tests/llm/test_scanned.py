import pytest

from lexmill.llm import scanned as S

CLEAN = ["The authority shall approve the arrangement and furnish the standard notice to the department in the month."] * 30 + ["A sub-standard form under rule 12A, section 5(3) dated 15-Jan-2018."] * 30


@pytest.fixture(scope="module")
def found(spark):
    text = "\n".join(
        [
            "Page 1 of 2",  # 1 furniture
            "The autbority shall approve the arrange-",  # 2 misread, break
            "ment and furnish the 5tandard notice to",  # 3 misread
            "the department in the month. A sub-",  # 4 the mark is spelling
            "standard form under rule 12A, section",  # 5
            "5(3) dated 15-Jari-2018. The depart\xad",  # 6 misread (Jari), break
            "- 2 -",  # 7 furniture
            "",  # 8
            "mcnt shall approve the notice in Z018",  # 9 misread twice
        ]
    )
    rows = [("pdf_text", 1, "x", text, 0), ("pdf_text", 1, "x", text, 0), ("document", 2, None, None, 0), ("document", 3, None, "", 0)]
    items = spark.createDataFrame(rows, "item_table string, item_id bigint, title string, text string, kind int")
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    out = S.noise(items, clean).collect()
    assert len(out) == len(set(out)) and {r["item_id"] for r in out} == {1}
    return {(r["line_no"], r["kind"]) for r in out}


def test_kinds(found):
    assert {n for n, k in found if k == "furniture"} == {1, 7}
    assert {n for n, k in found if k == "break"} == {2, 6}
    assert {n for n, k in found if k == "misread"} == {2, 3, 6, 9}


def test_distance_follows_confusions():
    assert S.distance("forrn", "form") == (0.25, 3, 5)
    assert S.distance("5hall", "shall") == (0.25, 0, 1)
    assert S.distance("bank", "tank") is None
    for seen in ("sectoin", "secion", "secttion", "secxion"):
        assert S.distance(seen, "section")[0] == S.PLAIN
    assert S.distance("sectio", "section") is None and S.distance("sections", "section") is None and S.distance("sedtoin", "section") is None
    assert S.distance("c" * 5000 + "rn", "e" + "c" * 4999 + "m")[0] == 0.5
    assert S.distance("adeqiiafe", "adequate")[0] == 0.5
    assert S.distance("same", "same")[0] == 0.0


def test_words():
    assert S.word("“Notice’s") == "notice" and S.word("9,600/-.") == "0,0" and S.word("5hall") == "5hall" and S.word("15-Jan-2018.") == "0-jan-0"


def test_running_header():
    body = ["The authority shall approve the arrangement and", "furnish the standard notice to the department in", "the month. The authority shall approve the notice"]
    lines = ["Rules of the Port, 2010", *body, "— 1 —", "Rules of the Port, 20 …", *body[1:], "and furnish it.", "— 2 —"]
    assert S.furniture(lines) == {0, 4, 5, len(lines) - 1}
    assert S.furniture([]) == set() and S.furniture(["", ""]) == set()


def test_empty(spark):
    items = spark.createDataFrame([], "item_table string, item_id bigint, title string, text string")
    assert S.noise(items, spark.createDataFrame([], "text string")).count() == 0


def test_neighbours_pick_between_repairs(spark):
    clean = spark.createDataFrame([("he was out on bail today and the ball game was long",)] * 9 + [("a ball a ball a ball",)] * 9, "text string")
    items = spark.createDataFrame([("t", 1, None, "he was out on ba1l today.\nand the ba1l game was long")], "item_table string, item_id bigint, title string, text string")
    out = {(r["line_no"], r["place"]): r["repair"] for r in S._study(items, clean)[1].collect()}
    assert out == {(1, 4): "bail", (2, 2): "ball"}


def test_restore_keeps_what_surrounds_the_word():
    assert S.restore("“5hall”,", "shall") == "“shall”,"
    assert S.restore("LIMITFD.", "limited") == "LIMITED."
    assert S.restore("15-Jari-2018.", "0-jan-0") == "15-Jan-2018."
    assert S.restore("Tbe", "the") == "The" and S.restore("commlttee's", "committee") == "committee's"
    assert S.restore("...", "x") == "..."


def test_paragraphs(spark):
    text = "The autbority shall approve the arrange-\n\n- 1 -\n\nment and furnish the sub-\nstandard notice.\n\nThe department shall approve."
    items = spark.createDataFrame([("pdf_text", 1, None, text), ("pdf_text", 2, None, None), ("pdf_text", 3, None, "")], "item_table string, item_id bigint, title string, text string")
    clean = spark.createDataFrame([(t,) for t in CLEAN], "text string")
    out = {r["item_id"]: r["paragraphs"] for r in S.repaired(items, clean).collect()}
    assert out == {1: ["The authority shall approve the arrangement and furnish the sub-standard notice.", "The department shall approve."], 3: []}


def test_no_result_depends_on_the_filter(spark, monkeypatch):
    """A known word with a far more frequent neighbour, a known mixed word, and a tie of both spellings of a split word."""
    clean = spark.createDataFrame([("he was out on bail again",)] * 40 + [("the ball is in rule 2o of a subway and a sub-way",)] * 2, "text string")
    text = "the ball was out again in rule 2o of a sub-\nway and he was out on baii again\nin rule 3z"
    items = spark.createDataFrame([("t", 1, None, text)], "item_table string, item_id bigint, title string, text string")
    want = {(2, "misread"), (3, "misread")}
    for common in (S.COMMON, 12, 3, 1):
        monkeypatch.setattr(S, "COMMON", common)
        assert {(r["line_no"], r["kind"]) for r in S.noise(items, clean).collect()} == want, common


def test_lettered_numbers_are_measured_by_clean_texts(spark):
    clean = spark.createDataFrame([("tax under section 194S or 115B is due in 2018",)] * 3, "text string")
    text = "tax under section 194S or 115B\nis due in 201S or 201l\nor 20b8 or 201i\nor 12B is due"
    items = spark.createDataFrame([("t", 1, None, text)], "item_table string, item_id bigint, title string, text string")
    assert {(r["line_no"], r["kind"]) for r in S.noise(items, clean).collect()} == {(2, "misread"), (3, "misread")}


def test_plain_edits_need_both_neighbours(spark):
    clean = spark.createDataFrame([("under this section of the act",)] * 30, "text string")
    text = "\n".join(["under this sectoin of the act", "under this secion of the act", "under this section of the act", "a sectoin under"])
    items = spark.createDataFrame([("t", 1, None, text)], "item_table string, item_id bigint, title string, text string")
    assert {(r["line_no"], r["kind"]) for r in S.noise(items, clean).collect()} == {(1, "misread"), (2, "misread")}


def test_short_and_long_words_find_their_repairs(spark):
    long = "administrationandenforcementofregulationsgenerally"
    clean = spark.createDataFrame([(f"you may ask me for {long} today",)] * 9, "text string")
    text = f"you rnay ask rne\nfor {long.replace('m', 'rn')} today\nfor {'x' * 3000} today"
    items = spark.createDataFrame([("t", 1, None, text)], "item_table string, item_id bigint, title string, text string")
    out = {(r["line_no"], r["word"], r["repair"]) for r in S._study(items, clean)[1].collect()}
    assert out == {(1, "rnay", "may"), (1, "rne", "me"), (2, long.replace("m", "rn"), long)}
    assert all(min(map(len, S._forms("x" * n))) >= min(n, S.KEPT) for n in range(1, 9))


def test_nearness_is_weighed_with_context(spark):
    """One confusion makes it 'tame', two make it 'time'; the neighbours are those of 'time'."""
    clean = spark.createDataFrame([("at the time of the sale and",)] * 40 + [("not so tame",)] * 9, "text string")
    items = spark.createDataFrame([("t", 1, None, "at the t@rne of the sale")], "item_table string, item_id bigint, title string, text string")
    assert {r["repair"] for r in S._study(items, clean)[1].collect()} <= {"tame", "time"}


def test_planted_noise(spark):
    """Pages of known text with headers, page numbers, broken words and misread letters: what is found against what was planted."""
    import random

    rng = random.Random(11)
    vocabulary = [a + b for a in ("regula", "compli", "autho", "depart", "licen", "registra", "inspec", "certifi") for b in ("tion", "ment", "rity", "sing", "cate", "ance", "tor", "bly")]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(9))
    clean = [sentence() + "." for _ in range(900)]
    pairs = [("m", "rn"), ("l", "1"), ("o", "0"), ("e", "c"), ("n", "ri"), ("s", "5")]
    rows, truth = [], set()
    for item in range(12):
        lines = []
        for page in range(1, 4):
            lines.append(("Gazette of the Registrar of Inspections", "furniture"))
            for _ in range(12):
                words = sentence().split()
                kind = rng.choice(["", "", "misread", "break"])
                if kind == "misread":
                    k = rng.randrange(len(words))
                    a, b = rng.choice([p for p in pairs if p[0] in words[k]] or [("", "")])
                    words[k] = words[k].replace(a, b, 1) if a else words[k]
                    kind = "misread" if a else ""
                line = " ".join(words)
                lines.append((line[:-3] + "-", "break") if kind == "break" else (line, kind))
                if kind == "break":
                    lines.append((line[-3:] + " " + sentence(), ""))
            lines.append((f"- {page} -", "furniture"))
        rows.append(("t", item, None, "\n".join(x for x, _ in lines)))
        truth |= {(item, i, k) for i, (_, k) in enumerate(lines, 1) if k}
    items = spark.createDataFrame(rows, "item_table string, item_id bigint, title string, text string")
    got = {(r["item_id"], r["line_no"], r["kind"]) for r in S.noise(items, spark.createDataFrame([(t,) for t in clean], "text string")).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
