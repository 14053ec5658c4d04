from hypothesis import given
from hypothesis import strategies as st

from lexmill.llm import splitting as S

texts = st.text("ab. ।\n\r\t", max_size=120)


@given(texts, st.integers(5, 20), st.integers(0, 4))
def test_pieces_cover_the_text(text, limit, overlap):
    _, pieces = S.split(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        assert a < c <= b < d and b - c <= overlap
    assert all(0 < b - a <= limit for a, b in pieces)


@given(texts, st.integers(5, 20), st.integers(1, 4))
def test_pieces_overlap_where_there_is_room(text, limit, overlap):
    found = list(S.units(text, 0, len(text), limit, overlap))
    _, pieces = S.split(text, limit, overlap)
    starts = {a: b - a for a, b, _ in found}
    for (a, b), (c, d) in zip(pieces, pieces[1:]):
        room = min(overlap, limit - starts[b], b - a - 1)
        # A word start in the room leaves less; without one the whole room is shared.
        assert b - c == room or c > 0 and text[c - 1] in " \t\r\n" or room <= 0


@given(texts, st.integers(3, 12), st.integers(0, 2))
def test_boundary_is_the_first_that_suffices(text, limit, overlap):
    if len(text) <= limit:
        return
    fits = [k for k, p in S.KINDS[1:] if max(map(len, p.split(text))) <= limit]
    assert S.split(text, limit, overlap)[0] == (fits[0] if fits else "none")


def test_cuts_at_paragraphs_before_lines():
    text = "a" * 900 + "\n\n" + "b" * 900 + "\n" + "c" * 900
    assert S.split(text, 2000, 0) == ("paragraph", [(0, 902), (902, 2703)])


def test_cuts_at_sections_before_paragraphs():
    part = "\n\n".join(["w" * 300] * 3)
    text = f"1. One {part}\n\n2. Two {part}\n\nCHAPTER III\n{part}"
    kind, pieces = S.split(text, 1000, 0)
    assert kind == "paragraph" and [text[a : a + 7] for a, _ in pieces] == ["1. One ", "2. Two ", "CHAPTER"]


def test_characters_overlap_in_full():
    for text in ("a" * 5000, "अ" * 5000, "कि" * 2500):
        kind, pieces = S.split(text)
        assert kind == "none" and len(pieces) == 3
        assert all(199 <= b - c <= 200 for (_, b), (c, _) in zip(pieces, pieces[1:]))
        assert all(text[a] != "ि" for a, _ in pieces)


def test_sentences_that_fill_a_piece_share_what_fits():
    text = " ".join(["w" * 1989 + "."] * 3)
    _, pieces = S.split(text)
    assert [b - a for a, b in pieces] == [2000, 2000, 1999] or all(b - c <= 10 for (_, b), (c, _) in zip(pieces, pieces[1:]))
    short = " ".join(["word"] * 2000)
    _, pieces = S.split(short)
    assert all(b - c >= 190 for (_, b), (c, _) in zip(pieces, pieces[1:]))


def test_rows(spark):
    rows = [("t", 1, "x" * 2001, 0), ("t", 1, "x" * 2001, 0), ("t", 2, "x" * 2000, 0), ("t", 3, None, 0), ("t", 4, "", 0), ("t", 5, "word " * 200_000, 0)]
    df = spark.createDataFrame(rows, "item_table string, item_id bigint, text string, boundary int")
    out = {(r["item_id"], r["boundary"]) for r in S.split_oversized(df).collect()}
    assert out == {(1, "none"), (5, "space")}
    pieces = S.piece_rows(S.split_oversized(df.where("item_id = 5"))).orderBy("piece_no").collect()
    assert pieces[0]["start"] == 0 and pieces[-1]["end"] == 1_000_000 and all(r["end"] - r["start"] <= 2000 for r in pieces)
    assert S.split_oversized(df.limit(0)).count() == 0
