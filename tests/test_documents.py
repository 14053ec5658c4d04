"""Page places, safe markup, and search over provisions and documents, with exact rows."""

from datetime import date

from lexmill.functions import markup as M
from lexmill.functions import pagemap as P
from lexmill.functions import search as S
from lexmill.operators import documents as D
from lexmill.operators import upkeep as U

WIDE = "This line is as wide as prose in a printed text of law is, so that nobody takes the page for a list."


def page(*lines):
    return "\n".join([*lines, WIDE, WIDE])


def test_contents_are_left_out():
    leaders = "\n".join(f"{n}. Heading of a section ........ {n + 3}" for n in range(1, 9))
    alone = "\n".join(x for n in range(1, 9) for x in (f"{n}.", "Short heading here"))
    headed = "ARRANGEMENT OF SECTIONS\n" + alone
    assert P.lists_contents(leaders) and P.lists_contents(alone) and not P.lists_contents(page("1. Text"))
    assert P.contents_pages([headed, alone, *[page("1. Text")] * 6]) == {0, 1}
    assert P.contents_pages([leaders, leaders, page("x")]) == set()  # too many to be believed
    pages = [headed, *[page(f"{n}. Short heading here") for n in range(1, 6)]]
    assert P.find_pages(pages, [(str(n), None, "section") for n in range(1, 6)]) == [2, 3, 4, 5, 6]


def test_headings_decide():
    pages = [page("under regulation 19 shall be"), page("148[17. Corporate governance of the entity"), page("5 Inserted by an Act", "Regulation 19. Board of directors of the bank"), page("17. Another list", "19 shall be")]
    want = [("17", "Corporate governance of the entity", "section"), ("19", "Board of directors of the bank", "section"), ("19", None, "section"), ("5", None, "section"), ("17", "A heading that no page has", "section"), ("99", None, "section")]
    assert P.find_pages(pages, want) == [2, 3, 3, None, None, None]
    near = [page("Lending in foreign exchange")] + [page("x")] * 3 + [page("20. y", "Lending in foreign exchange")]
    assert P.find_pages(near, [("20", None, "section"), ("21", "Lending in foreign exchange", "section")]) == [5, 5]
    assert P.find_pages([], [("1", None, "section")]) == [None]


def test_markup_is_made_safe():
    html = '<div class="x" onclick="y()"><script>bad()</script><p style="z">One <font>two</font> <b>three</p><a href="javascript:x">four</a> <a href="/act" id="q">five</a><table><tr><td colspan="2">6 &lt; 7</td></tr></table><p> </p>'
    out = M.clean_html(html, "https://law.example/")
    assert out == '<div><p>One two <b>three</b></p>four <a href="https://law.example/act" target="_blank" rel="noreferrer">five</a><table><tr><td colspan="2">6 &lt; 7</td></tr></table></div>'
    assert M.clean_html("no markup") == "" and M.clean_html(None) == "" and M.clean_html("<svg><p>x</p></svg>") == ""
    assert M.clean_html("a<br><br/><br>\n<br>b") == "a<br/><br/>b"


def test_rows_of_pages_and_markup(spark):
    rows = spark.createDataFrame([(1, "auto", page("1. First section of the act") + "\f" + page("2. Second section of the act")), (2, None, None), (3, "auto", "")], "id bigint, style string, text string")
    assert {(r["number"], r["page"]) for r in D.page_map(rows).collect()} == {("1", 1), ("2", 2)}
    html = spark.createDataFrame([(1, "<p onclick='x'>a</p>"), (2, None)], "id bigint, html string")
    assert {r["id"]: r["html"] for r in D.cleaned_html(html).collect()} == {1: "<p>a</p>", 2: None}


def test_search_over_provisions_and_documents(spark):
    texts = spark.createDataFrame([(1, "tax credit tax credit"), (2, "a credit"), (3, "credit of tax"), (4, "tax credit on files")], "doc bigint, text string")
    hits = S.search(S.postings(texts), "tax credit")
    provision = spark.createDataFrame([(1, 10, None), (2, 10, None), (3, 10, None), (4, 11, None), (1, 10, None)], "id bigint, instrument_id int, number string")
    instrument = spark.createDataFrame([(10, False), (11, True)], "id int, pdf_only boolean")
    assert [(r["id"], r["place"]) for r in D.found_provisions(provision, instrument, hits, 5).orderBy("place").collect()] == [(1, 1), (3, 2)]
    assert [(r["instrument_id"], r["id"]) for r in D.found_provisions(provision, instrument, hits, 1, by="instrument_id").collect()] == [(10, 1)]
    document = spark.createDataFrame([(1, "357", date(2020, 1, 1)), (2, "G.S.R. 357(E)", date(2021, 1, 1)), (3, "9", None), (4, None, date(2019, 1, 1))], "id bigint, number string, date_issued date")
    got = D.found_documents(document, hits, "357", 10).orderBy("place").collect()
    assert [(r["id"], r["tier"]) for r in got] == [(1, 1), (2, 1), (4, 2), (3, 2)] and [r["rank"] for r in got[:2]] == [100.0, 50.0]
    assert D.found_documents(document, hits, "357", 1).count() == 2  # one by number, one by text


def test_texts_that_hold_titles(spark, monkeypatch):
    monkeypatch.setattr(U, "AUTOMATON", 2)
    texts = spark.createDataFrame([(1, "under the ABC Act, 1999 and the Def Rules"), (2, None), (3, "")], "id bigint, text string")
    phrases = spark.createDataFrame([(1, "ABC Act, 1999"), (2, "abc act, 1999"), (3, "DEF rules"), (4, ""), (5, None), (6, "Ghi")], "phrase_id bigint, phrase string")
    assert {tuple(r) for r in U.holding(texts, phrases).collect()} == {(1, 1), (1, 2), (1, 3)}
    assert U.holding(texts, phrases.limit(0)).count() == 0


def test_places_over_ranges(spark):
    """A group over many ranges is placed, carried forward and linked as if it were sorted in one task."""
    from lexmill.operators import catalogue as C

    rows = [(i, 1 if i % 3 else 2, f"Ch. {i}" if i % 17 == 0 else str(i), "chapter" if i % 17 == 0 else "section", None if i % 11 == 0 else i // 4) for i in range(400)] + [(900, None, "x", "section", 1)]
    df = spark.createDataFrame(rows, "id bigint, instrument_id int, number string, level string, sort_key int")
    want, carried, links = {}, {}, {}
    for g in (1, 2, None):
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[4] is None, r[4] or 0, r[0]))
        chapter, text = None, [r[0] for r in mine if r[3] != "chapter"]
        for k, r in enumerate(mine):
            chapter = r[2] if r[3] == "chapter" else chapter
            want[r[0]], carried[r[0]] = k + 1, chapter
        links |= {x: (text[k - 1] if k else None, text[k + 1] if k + 1 < len(text) else None, k + 1) for k, x in enumerate(text)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be joined
    try:
        ranged = C.in_ranges(df, "instrument_id", C._reading())
        assert ranged.select("_range").distinct().count() > 2
        assert {r["id"]: r["place"] for r in C.placed(ranged, "instrument_id", C._reading()).collect()} == want
        assert {r["id"]: r["chapter"] for r in C.chapters_carried(df).collect()} == carried
        assert {r["id"]: (r["before_id"], r["after_id"], r["place"]) for r in C.neighbours(df).collect()} == links
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
