import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import tokens as T

texts = st.lists(st.one_of(st.text(max_size=40), st.text("a1 .,\n\t\r  '’सं🙂<|>", max_size=60)), max_size=8)


@pytest.fixture(scope="module")
def plain():
    return T._load(T.TOKENIZER)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_same_as_the_library(plain, batch):
    got = T.Encoder().encode(batch)
    assert got == [e.ids for e in plain.encode_batch(batch, add_special_tokens=False)]
    assert [T.decode(i) for i in got] == batch


def test_special_strings_are_text(plain):
    text = "a <|endoftext|> b"
    ids = T.Encoder().encode([text])[0]
    assert 50256 not in ids and T.decode(ids) == text


def test_offsets_cover_characters():
    text = "naïve सं🙂 x"
    ids = T.Encoder().encode([text])[0]
    spans = T.offsets(text, ids)
    assert len(spans) == len(ids) and spans[0][0] == 0 and spans[-1][1] == len(text)
    assert {c for a, b in spans for c in range(a, b)} == set(range(len(text)))


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(T, "CACHE", 10)
    e = T.Encoder()
    for i in range(20):
        e.encode([f"w{i} v{i} u{i} t{i}"])
    assert len(e.later) < 20


def test_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "two  words", 0), (3, "two  words", 0), (4, "long " * 50_000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = T.encode(df, "doc_id", "text").collect()
    assert len(out) == 5 and all(r["ids"] == [] for r in out if r["id"] < 3)
    assert T.decode(next(r["ids"] for r in out if r["id"] == 4)) == "long " * 50_000
    assert {r["id"]: r["n"] for r in T.count_tokens(df, "doc_id", "text").collect()} == {r["id"]: len(r["ids"]) for r in out}
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


def test_decoding_and_offsets_over_tables(spark):
    rows = [(1, "naïve सं🙂 x"), (2, ""), (3, "two  words"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    encoded = T.encode(df, "doc_id", "text")
    assert {r["id"]: r["text"] for r in T.decode_ids(encoded).collect()} == {i: t or "" for i, t in rows}
    ids = {r["id"]: r["ids"] for r in encoded.collect()}
    assert {r["id"]: list(zip(r["starts"], r["ends"])) for r in T.token_offsets(df, "doc_id", "text").collect()} == {i: T.offsets(t or "", ids[i]) for i, t in rows}


def test_every_white_space_at_a_cut():
    """A text may be cut before a space only if no white space, of any kind, stands on either side in a way that the pre-tokenizer joins."""
    encoder = T.Encoder()
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace() or c in (0x180E, 0x200B, 0x1C, 0x1F)]
    texts = [f"one{a} {b}two" for a in ["", *spaces] for b in ["", *spaces]] + [f"a {s} b" for s in spaces] + [f"{s} a" for s in spaces]
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    assert [T.decode(i) for i in want] == texts
