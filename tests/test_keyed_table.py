"""Upserts into a bucketed table: what changes, what stays, what a reader sees."""

import pytest

from lakeops.sources import keyed_table as K
from lakeops.sources.listing import list_files

DDL = "k bigint, p string, v string"


def files(spark, root):
    return {r.file_path for r in list_files(spark, f"{root}/data").collect()}


def test_unchanged_buckets_keep_their_files(spark, tmp_path, rows):
    root = str(tmp_path)
    stored = spark.range(200).selectExpr("id as k", "if(id % 9 = 0, null, 'p') as p", "'old' as v")
    K.create(stored, root, ["k", "p"], buckets=8)
    before, first = files(spark, root), K.current(spark, root)
    assert len(first.folders) == 8 and rows(K.read(spark, root)) == rows(stored)
    # one row changes, one is new, one is stored already, one key comes twice
    sent = spark.createDataFrame([(9, None, "new"), (9, None, "aaa"), (500, None, "new"), (1, "p", "old")], DDL)
    changed = K.upsert(spark, root, sent)
    now = K.current(spark, root)
    assert 1 <= len(changed) <= 2 and now.number == 1
    assert {b for b in first.folders if first.folders[b] != now.folders[b]} == set(changed)
    assert before <= files(spark, root)
    want = [(k, p, "new" if k == 9 else v) for k, p, v in map(tuple, stored.collect())] + [(500, None, "new")]
    assert rows(K.read(spark, root)) == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))
    assert K.upsert(spark, root, sent) == [] and K.current(spark, root).number == 1


def test_diff_reads_only_the_buckets_asked_for(spark, tmp_path, rows):
    root = str(tmp_path)
    K.create(spark.range(100).selectExpr("id as k", "'p' as p", "'old' as v"), root, ["k"], buckets=4)
    sent = spark.createDataFrame([(5, "p", "old"), (5, "q", "old"), (None, "p", "x")], DDL)
    got = K.diff(spark, root, sent)
    assert rows(got, "k", "p", "action") == [(5, "p", "NOOP"), (5, "q", "UPDATE"), (None, "p", "CREATE")]
    scanned = {line for line in got.inputFiles() if "/data/" in line}
    assert len({f.split("_bucket=")[1].split("/")[0] for f in scanned}) <= 2


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, rows, monkeypatch):
    root = str(tmp_path)
    K.create(spark.createDataFrame([(1, None, "a")], DDL), root, ["k"], buckets=4)

    def dies(*_):
        raise RuntimeError("lost")

    sent = spark.createDataFrame([(1, "p", "b"), (2, None, "c")], DDL)
    with monkeypatch.context() as m:
        m.setattr(K, "_publish", dies)
        with pytest.raises(RuntimeError):
            K.upsert(spark, root, sent)
    assert rows(K.read(spark, root)) == [(1, None, "a")]
    K.upsert(spark, root, sent)
    assert rows(K.read(spark, root)) == [(1, "p", "b"), (2, None, "c")]


def test_empty_table_and_keys_only(spark, tmp_path, rows):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    K.create(spark.createDataFrame([], DDL), a, ["k"], buckets=4)
    assert rows(K.read(spark, a)) == [] and K.upsert(spark, a, spark.createDataFrame([], DDL)) == []
    K.upsert(spark, a, spark.createDataFrame([(1, None, None)], DDL))
    assert rows(K.read(spark, a)) == [(1, None, None)]
    keys = spark.createDataFrame([(1,), (2,)], "k bigint")
    K.create(keys, b, ["k"], buckets=2)
    assert K.upsert(spark, b, keys) == [] and len(K.upsert(spark, b, spark.createDataFrame([(3,), (3,)], "k bigint"))) == 1
    assert rows(K.read(spark, b)) == [(1,), (2,), (3,)]
