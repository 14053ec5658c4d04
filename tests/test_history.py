from datetime import date, datetime
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexmill.operators import history as V

SCHEMA = "entity bigint, id bigint, text string, source_kind string, effective_from date, effective_to date, created_at timestamp"


def day(n):
    return None if n is None else date(2020, 1, n)


def brute(rows):
    """Versions of the rows by following the rules one by one."""
    out = []
    for e in sorted({r[0] for r in rows if r[0] is not None}):
        states = {}
        for r in rows:
            if r[0] == e and r[2] is not None:
                key = (r[6] is not None, r[6] or datetime.min, r[1])
                if r[4] not in states or key > states[r[4]][0]:
                    states[r[4]] = (key, r)
        chain = [states[k][1] for k in sorted(states, key=lambda d: (d is not None, d or date.min))]
        versions = []
        for i, r in enumerate(chain):
            end = chain[i + 1][4] if i + 1 < len(chain) else None
            own = r[5] if r[5] and (r[4] is None or r[5] > r[4]) else None
            end = min(x for x in (end, own) if x) if end or own else None
            text = " ".join(r[2].split())
            if versions and versions[-1][1] is not None and versions[-1][1] == r[4] and versions[-1][2:] == (r[3], text):
                versions[-1] = (versions[-1][0], end, r[3], text)
            else:
                versions.append((r[4], end, r[3], text))
        out += [(e, a, b) for a, b, *_ in versions]
    return sorted(out, key=str)


rows = st.lists(
    st.tuples(
        st.sampled_from([1, 2, None]), st.integers(1, 9), st.sampled_from(["a b", "a  b\n", "c", "", None]), st.sampled_from(["official", "machine", None]),
        st.sampled_from([None, 1, 2, 3, 4]).map(day), st.sampled_from([None, 1, 2, 3, 5]).map(day), st.sampled_from([None, datetime(2020, 1, 1), datetime(2020, 1, 2)]),
    ),
    max_size=14, unique_by=lambda r: (r[1], r[6]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_against_rules(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    log, late = V.changes(df), V.F.coalesce(V.F.col("created_at") >= "2020-01-02", V.F.lit(False))
    base = log.where(~late)
    out = V.rebuild_affected(V.build_chains(base), base, log.where(late))
    assert sorted([(r["entity"], r["valid_from"], r["valid_to"]) for r in out.collect()], key=str) == brute(data)


def test_history_does_not_depend_on_the_day_of_the_first_load(spark):
    data = [(e, i, f"t{i % 3}", "official", day(1 + i % 4), day(5) if i % 5 == 0 else None, datetime(2020, 1, 1 + i % 3)) for i in range(12) for e in (1, 2, 3)]
    df = spark.createDataFrame(data, SCHEMA)
    for until in ("2020-01-02", "1990-01-01"):
        got = [(r["entity"], r["valid_from"], r["valid_to"]) for r in V.full_history(df, until).collect()]
        assert sorted(got, key=str) == brute(data)


def test_update_touches_only_its_chains(spark):
    base = spark.createDataFrame([(1, 1, "x", "o", day(1), None, None), (2, 2, "y", "o", day(1), None, None)], SCHEMA)
    late = spark.createDataFrame([(2, 3, "z", "o", day(3), None, None)], SCHEMA)
    log = V.changes(base)
    marked = V.build_chains(log).withColumn("id", V.F.col("id") + 100)  # a rebuilt chain loses the mark
    out = V.rebuild_affected(marked, log, V.changes(late)).collect()
    assert {(r["entity"], r["id"], r["valid_to"]) for r in out} == {(1, 101, None), (2, 2, day(3)), (2, 3, None)}


def test_empty(spark):
    assert V.full_history(spark.createDataFrame([], SCHEMA), "2020-01-01").count() == 0


def test_extra_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    rows = [(1, i, "word " * 100_000 + str(i // 2), "o", day(i), None, None) for i in range(1, 6)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("text_key", "valid_from", "valid_to", "s", "_v", "_to", "_n"):
        df = df.withColumn(c, F.lit(1))
    out = [(r["valid_from"], r["valid_to"]) for r in V.full_history(df, "2020-01-01").orderBy("valid_from").collect()]
    assert out == [(day(1), day(2)), (day(2), day(4)), (day(4), None)]


def files(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("bucket=*/*.parquet")}


def chain_rows(df):
    return sorted((r["entity"], str(r["valid_from"]), str(r["valid_to"]), r["source_kind"], bytes(r["text_key"]), r["id"]) for r in df.collect())


def store_rows(n, day, text, first=0):
    return [(e, first + e, f"{text} {e}", "official", date.fromisoformat(day), None, datetime.fromisoformat(f"{day}T00:00:00")) for e in range(n)]


def test_store_replaces_touched_buckets_only(spark, tmp_path):
    raw = spark.createDataFrame(store_rows(300, "2020-01-01", "old"), SCHEMA)
    late = spark.createDataFrame(store_rows(3, "2019-06-01", "late", 1000), SCHEMA)
    store = V.HistoryStore(spark, str(tmp_path / "h"))
    store.load(V.changes(raw), 64)
    before = files(tmp_path)
    touched = store.apply(V.changes(late))
    assert 1 <= len(touched) <= 3
    assert before <= files(tmp_path)
    assert chain_rows(store.chains()) == chain_rows(V.build_chains(V.changes(raw.unionByName(late))))
    # What was written lies in the touched buckets, in the log and in the chains.
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in files(tmp_path) - before} == set(touched)
    held = store._manifest()["chains"]
    assert sorted(k for b in held.values() for k in b) == list(range(64))
    assert store.apply(V.changes(late.limit(0))) == []
    store.vacuum()
    assert chain_rows(store.chains()) == chain_rows(V.build_chains(V.changes(raw.unionByName(late))))


def test_a_crash_before_the_swap_leaves_the_old_chains(spark, tmp_path, monkeypatch):
    raw = spark.createDataFrame(store_rows(40, "2020-01-01", "old"), SCHEMA)
    late = spark.createDataFrame(store_rows(5, "2021-06-01", "late", 1000), SCHEMA)
    store = V.HistoryStore(spark, str(tmp_path / "h"))
    store.load(V.changes(raw), 8)
    before = chain_rows(store.chains())

    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(V.HistoryStore, "_commit", crash)
        with pytest.raises(OSError):
            store.apply(V.changes(late))
    assert chain_rows(store.chains()) == before
    assert len(store.vacuum()) == 2 and chain_rows(store.chains()) == before
    store.apply(V.changes(late))
    assert chain_rows(store.chains()) == chain_rows(V.build_chains(V.changes(raw.unionByName(late))))
    # A second writer that read the same manifest does not overwrite the first one's.
    with pytest.raises(FileExistsError):
        store._commit(store._manifest())
