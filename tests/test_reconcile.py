"""Checksum tree and drift by file."""

import pytest
from pyspark.sql import functions as F

from lakeops.operators import drift
from lakeops.operators import quality as Q


def pair(spark, n, changed):
    left = spark.range(n).selectExpr("id * 3 - 50 as k", "cast(id % 7 as double) as v", "cast(id as string) as s")
    right = left.withColumn("v", F.when(F.col("k").isin(changed), F.col("v") + 0.5).otherwise(F.col("v")))
    return left, right


def test_tree_ends_where_tables_differ(spark, rows):
    left, right = pair(spark, 5000, [-50, 10])
    right = right.where("k <> 9997").union(spark.createDataFrame([(20_000, 1.0, "x"), (None, 1.0, "y")], "k bigint, v double, s string"))
    got = {r.k: (r.rows_left, r.rows_right, r.row_delta) for r in Q.reconcile_rows(left, right, "k", ["v"], fanout=8, leaf=10).collect()}
    assert got == {-50: (1, 1, 0), 10: (1, 1, 0), 9997: (1, 0, -1), 20_000: (0, 1, 1), None: (0, 1, 1)}
    whole = Q.reconcile_tables(left, right, ["k"], ["v"]).where("not matches")
    assert rows(Q.reconcile_rows(left, right, "k", ["v"], fanout=8, leaf=10)) == rows(whole)


def test_last_level_reads_in_proportion_to_the_differences(spark):
    left, right = pair(spark, 20_000, [1000 * 3 - 50, 15_000 * 3 - 50])
    ranges = Q.differing_ranges(left, right, "k", fanout=16, leaf=100)
    assert left.where(Q._within(F.col("k"), ranges)).count() <= 100
    assert len(ranges) == 2 and all(any(a <= k <= b for a, b in ranges) for k in (2950, 44_950))
    assert Q.differing_ranges(left, left, "k") == [] and Q.reconcile_rows(left, left, "k", ["v"]).count() == 0
    assert Q.differing_ranges(left.limit(0), left.limit(0), "k") == []
    one = spark.createDataFrame([(5, 1.0, "a")], left.schema)
    assert Q.differing_ranges(one, one.withColumn("v", F.lit(2.0)), "k") == [(5, 5)]


def test_many_differences_end_the_tree_early(spark, monkeypatch, rows):
    monkeypatch.setattr(Q, "RANGES", 5)
    left, right = pair(spark, 600, [3 * k - 50 for k in range(0, 600, 2)])
    assert Q.reconcile_rows(left, right, "k", ["v"], fanout=8, leaf=1).count() == 300
    monkeypatch.setattr(Q, "RANGES", 4096)
    assert Q.reconcile_rows(left, right, "k", ["v"], fanout=8, leaf=1).count() == 300


def test_drift_names_the_file(spark, tmp_path):
    path = str(tmp_path / "t")
    contract = Q.Contract("t", (Q.ColumnRule("a", "bigint"), Q.ColumnRule("b", "decimal(10,2)"), Q.ColumnRule("at", "timestamp")))
    good = spark.sql("select 1L as a, cast(2 as decimal(12,3)) as b, timestamp '2024-01-01' as at")
    bad = spark.sql("select '1' as a, timestamp '2024-01-01' as at, array(1) as more from range(3)")
    good.coalesce(1).write.parquet(path)
    known = {r.file_path for r in drift.file_schemas(spark, path).collect()}
    bad.coalesce(1).write.mode("append").parquet(path)
    (tmp_path / "t" / "note.txt").write_text("no footer")
    got = drift.drift_by_file(spark, path, contract)
    kinds = {(r.column_name, r.kind, r.expected, r.actual, r.rows) for r in got.collect()}
    assert kinds == {("a", "type drift", "bigint", "string", 3), ("b", "missing column", "decimal(10,2)", None, 3),
                     ("more", "unknown column", None, "array<int>", 3), (None, "unreadable file", None, None, None)}
    assert not known & {r.file_path for r in got.collect()}
    summary = {r.column_name: (r.files, r.rows) for r in drift.drift_summary(got).collect()}
    assert summary["a"] == (1, 3) and summary[None] == (1, None)
    assert drift.drift_by_file(spark, path, contract).where("file_path like '%note.txt'").count() == 1


def test_listing_of_stores_that_tasks_cannot_reach_is_an_error_here(spark):
    with pytest.raises(Exception):
        drift.file_schemas(spark, "nowhere://x/y").collect()
