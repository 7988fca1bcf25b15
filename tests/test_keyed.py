"""The table changed bucket by bucket."""

import pytest
from pyspark.sql import types as T

from momentloom.sinks.keyed import KeyedTable

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])


def make(spark, tmp_path, buckets=8):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["id"], buckets)


def put(spark, table, rows, **kw):
    return table.merge(spark.createDataFrame(rows, "id bigint, name string, n bigint, v bigint, gone boolean"), version="v", **kw)


def read(table, number=None):
    return sorted(tuple(r) for r in table.read(number).collect())


def test_merge_puts_rows_over_rows(spark, tmp_path):
    t = make(spark, tmp_path)
    assert read(t) == []
    put(spark, t, [(i, "a", i, 1, None) for i in range(20)] + [(3, "old", 0, 0, None)])
    put(spark, t, [(3, "b", 5, 2, None), (50, "new", 1, 1, None), (3, "c", 6, 9, None)])
    want = {i: (i, "a", i) for i in range(20)} | {3: (3, "c", 6), 50: (50, "new", 1)}
    assert read(t) == sorted(want.values()) and read(t, 1) == sorted((i, "a", i) for i in range(20))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    t = make(spark, tmp_path)
    first = put(spark, t, [(i, "a", i, 1, None) for i in range(100)])
    second = put(spark, t, [(7, "b", 0, 1, None)])
    changed = [b for b in second["files"] if second["files"][b] != first["files"].get(b)]
    assert len(first["files"]) == 8 and len(changed) == 1


def test_a_batch_counts_once(spark, tmp_path):
    t = make(spark, tmp_path)
    put(spark, t, [(1, "a", 1, 1, None)], batch=4)
    again = put(spark, t, [(1, "b", 2, 2, None)], batch=4)
    assert read(t) == [(1, "a", 1)] and again["number"] == 1 and again["batches"] == [4]


def test_rows_that_are_gone(spark, tmp_path):
    t = make(spark, tmp_path)
    put(spark, t, [(1, "a", 1, 1, False), (2, "b", 1, 1, None)], gone="gone")
    put(spark, t, [(1, None, None, 2, True), (3, None, None, 1, True)], gone="gone")
    assert read(t) == [(2, "b", 1)]
    put(spark, t, [(2, None, None, 2, True)], gone="gone")
    assert read(t) == []
    put(spark, t, [(2, "back", 1, 3, False)], gone="gone")
    assert read(t) == [(2, "back", 1)]


def test_a_merge_that_stops_before_the_swap_changes_nothing(spark, tmp_path, monkeypatch):
    t = make(spark, tmp_path)
    put(spark, t, [(1, "a", 1, 1, None)])
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda self, v: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            put(spark, t, [(1, "b", 2, 2, None)], batch=0)
    assert read(t) == [(1, "a", 1)]
    put(spark, t, [(1, "b", 2, 2, None)], batch=0)
    assert read(t) == [(1, "b", 2)]
    assert t.vacuum(1) >= 2 and read(t) == [(1, "b", 2)]


def test_the_second_of_two_writers_gets_an_error(spark, tmp_path, monkeypatch):
    a, b = make(spark, tmp_path), make(spark, tmp_path)
    stale = b.version()
    put(spark, a, [(1, "a", 1, 1, None)])
    monkeypatch.setattr(b, "version", lambda number=None: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        put(spark, b, [(1, "b", 1, 1, None)])
    assert read(a) == [(1, "a", 1)]
