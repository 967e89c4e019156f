"""Versioned tables: interrupted and concurrent writers, readers on old versions, retention, lookups, merges."""

import datetime

import pytest
from pyspark.sql import functions as F

from modq.operators import sample_table, store
from modq.sources import versions

NEW = "profile string, text string, label int, category string"


def at():
    return F.lit(datetime.datetime(2026, 4, 3, 10)).cast("timestamp_ntz")


@pytest.fixture
def table(spark, tmp_path):
    t = sample_table.sample_table(spark, f"file://{tmp_path}/samples")
    rows = [("a", f"text {i}", int(i % 3 == 0), None) for i in range(12)] + [("b", "one", 1, "c"), ("b", "two", 0, None)]
    sample_table.append_new(t, spark.createDataFrame(rows, NEW), now=at())
    return t


def ids(df):
    return sorted((r["profile"], r["id"]) for r in df.collect())


def test_append_goes_on_and_replays_add_nothing(spark, table):
    more = spark.createDataFrame([("b", "three", 7, None), ("c", "x", 0, None)], NEW)
    first = sample_table.append_new(table, more, "stream", 0, at())
    assert ids(table.read()) == [("a", i) for i in range(1, 13)] + [("b", 1), ("b", 2), ("b", 3), ("c", 1)]
    again = sample_table.append_new(table, more, "stream", 0, at())
    assert again == first and len(table.read().collect()) == 16
    assert table.version(1).rows() == {"a": 12, "b": 2} and first.rows() == {"a": 12, "b": 3, "c": 1}
    assert table.read(profiles=["c"]).columns == spark.createDataFrame([], store.SCHEMA).columns and ids(table.read(profiles=["c"])) == [("c", 1)]


def test_retention_rewrites_only_what_it_must(spark, table):
    limits = spark.createDataFrame([("a", 4), ("b", 100)], "profile string, most int")
    old = table.current()
    b_part = [e for e in old.entries if e["profile"] == "b"]
    new = sample_table.retain(table, limits)
    kept, before = table.read(new), table.read(old)
    want = ids(store.retain_balanced(before.where("profile = 'a'"), 4)[0])
    assert ids(kept.where("profile = 'a'")) == want and [e for e in new.entries if e["profile"] == "b"] == b_part
    assert len(before.collect()) == 14  # the old version is still whole
    assert ids(sample_table.pointers(table)) == sorted(want + [("b", 1), ("b", 2)])
    assert sample_table.retain(table, limits) == new
    table.vacuum()
    assert ids(table.read()) == sorted(want + [("b", 1), ("b", 2)]) and table.numbers() == [new.number]


def test_interrupted_rewrite_changes_nothing(spark, table, monkeypatch):
    def die(self, version):
        raise RuntimeError("the writer died")

    before = ids(table.read())
    monkeypatch.setattr(versions.VersionedTable, "publish", die)
    with pytest.raises(RuntimeError):
        sample_table.retain(table, spark.createDataFrame([("a", 4)], "profile string, most int"))
    monkeypatch.undo()
    assert ids(table.read()) == before and table.numbers() == [1]
    table.vacuum()
    assert ids(table.read()) == before


def test_two_writers(spark, table):
    """One that was overtaken makes its change again: ids go on from the other's, no row is lost."""
    other = sample_table.sample_table(spark.newSession(), table.path)
    calls = []
    segment = table._segment

    def slow(rows):
        out = segment(rows)
        calls.append(1)
        if len(calls) == 1:  # the other is faster
            sample_table.append_new(other, other.spark.createDataFrame([("a", "theirs", 0, None)], NEW), now=at())
        return out

    table._segment = slow
    sample_table.append_new(table, spark.createDataFrame([("a", "ours", 1, None)], NEW), now=at())
    assert len(calls) == 2 and table.numbers() == [1, 2, 3]
    assert {r["id"]: r["text"] for r in table.read().where("id > 12").collect()} == {13: "theirs", 14: "ours"}
    table.compact()
    assert len(table.read().collect()) == 16 and len({e["segment"] for e in table.current().entries}) == 1


def test_lookup_reads_pointers(spark, table):
    sample_table.append_new(table, spark.createDataFrame([("a", "text 3", 0, "new")], NEW), now=at())
    asked = spark.createDataFrame([(1, "a", "text 3"), (2, "b", "text 3"), (3, "a", "unknown"), (4, None, "one")], "id long, profile string, text string")
    got = sample_table.lookup(table, asked)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, store.lookup_by_text(asked, table.read()).collect()), key=str)
    assert {r["id"]: r["hit_id"] for r in got.collect()} == {1: 13, 2: None, 3: None, 4: None}


def test_counts_are_merged(spark, tmp_path):
    t = sample_table.counts_table(spark, f"file://{tmp_path}/counts")
    put = lambda rows, n: sample_table.upsert_counts(t, spark.createDataFrame(rows, sample_table.COUNTS), "counts", n)
    put([("a", 0, 3), ("a", 1, 1), ("b", 0, 2), (None, 1, 4)], 0)
    old = t.current()
    put([("a", 1, 5), (None, 1, 6)], 1)
    put([("a", 1, 999)], 1)  # a replay
    assert sorted(map(tuple, t.read().collect()), key=str) == sorted([("a", 0, 3), ("a", 1, 5), ("b", 0, 2), (None, 1, 6)], key=str)
    assert [e for e in t.current().entries if e["profile"] == "b"] == [e for e in old.entries if e["profile"] == "b"]
