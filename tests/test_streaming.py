"""Streams: open windows, rows that came too late, and restarts."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lakeops.streaming import jobs

DAY = dt.datetime(2024, 1, 1)


def calls(spark, minutes):
    return spark.createDataFrame([(t, DAY + dt.timedelta(minutes=m)) for t, m in minutes], "tenant string, call_ts timestamp")


def batch_rates(df):
    counted = df.groupBy(F.window("call_ts", "1 hour", "5 minutes"), "tenant").agg(F.count(F.lit(1)).alias("calls"))
    return counted.select("window.start", "window.end", "tenant", "calls")


def test_open_and_published_windows_equal_the_batch_over_restarts(spark, tmp_path, rows):
    src, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    seen = None
    # arrivals in order; each run starts from the checkpoint of the one before
    for minutes in ([("a", 1), ("a", 2), ("b", 50)], [("a", 55), ("b", 130)], [(None, 300), ("b", 301)]):
        part = calls(spark, minutes)
        part.write.mode("append").parquet(src)
        seen = part if seen is None else seen.union(part)
        jobs.run_available(jobs.call_rate(jobs.file_stream(spark, src, part.schema), "10 minutes"), out, state)
        got = jobs.all_call_rates(spark, out, state)
        assert rows(got.drop("final")) == rows(batch_rates(seen))
        mark = max(m for _, m in minutes) - 10
        assert {r.window_end <= DAY + dt.timedelta(minutes=mark) for r in got.where("final").collect()} == {True}
        assert {r.window_end > DAY + dt.timedelta(minutes=mark) for r in got.where("not final").collect()} == {True}


def test_open_days_keep_their_counts_apart(spark, tmp_path, rows):
    src, out, state = (str(tmp_path / k) for k in ("in", "out", "state"))
    runs = spark.createDataFrame(
        [(1, "Completed", DAY), (1, "Failed", DAY), (1, None, DAY), (2, "Succeeded", DAY + dt.timedelta(days=3)), (2, "Failed", DAY + dt.timedelta(days=3))],
        "item_id int, status string, start_time timestamp")
    runs.write.parquet(src)
    jobs.run_available(jobs.run_health(jobs.file_stream(spark, src, runs.schema), "2 hours"), out, state)
    got = rows(jobs.all_run_health(spark, out, state), "item_id", "runs", "success_count", "failure_count", "final")
    assert got == [(1, 3, 1, 1, True), (2, 2, 1, 1, False)]


def test_late_rows_are_counted_batch_by_batch(spark, tmp_path, rows):
    src, out, state, progress = (str(tmp_path / k) for k in ("in", "out", "state", "progress"))
    for part in ([(1, 600)], [(2, 10), (3, 20), (4, 590)], [(5, 601), (6, 30), (5, 601)]):
        df = spark.createDataFrame([(k, DAY + dt.timedelta(minutes=m)) for k, m in part], "job_instance_id int, start_time timestamp")
        df.coalesce(1).write.mode("append").parquet(src)
        jobs.run_available(jobs.ingest_runs(jobs.file_stream(spark, src, df.schema), "2 hours"), out, state, progress)
    assert rows(spark.read.schema("job_instance_id int").parquet(out)) == [(1,), (4,), (5,)]
    log = spark.read.parquet(progress)
    assert log.where("input_rows > 0").count() == 3 and log.agg(F.sum("dropped_rows"), F.sum("input_rows")).first() == (3, 7)
    assert log.select("query_id").distinct().count() == 1 and log.count() == log.select("batch_id").distinct().count()


def test_ingest_repeats_a_batch_that_was_not_committed(spark, tmp_path, rows, monkeypatch):
    src, target, state = (str(tmp_path / k) for k in ("in", "out", "state"))

    def arrive(lo, hi):
        df = spark.range(lo, hi)
        df.repartition(3).write.mode("append").parquet(src)
        return jobs.file_stream(spark, src, df.schema, max_files=1)

    def read():
        return [r.id for r in jobs.read_ingested_files(spark, target, "id bigint").orderBy("id").collect()]

    jobs.ingest_files(arrive(0, 10), target, state)
    assert read() == list(range(10))
    # the run dies after a batch wrote its data and before it is committed
    parquet = type(spark.range(1).write).parquet

    def dies(self, path, *args, **kwargs):
        parquet(self, path, *args, **kwargs)
        if path.endswith("=4"):
            raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1).write), "parquet", dies)
        with pytest.raises(StreamingQueryException):
            jobs.ingest_files(arrive(10, 30), target, state)
    written = read()
    assert len(written) == len(set(written)) and len(written) < 30
    jobs.ingest_files(arrive(30, 31), target, state)
    assert read() == list(range(31))
    jobs.ingest_files(jobs.file_stream(spark, src, "id bigint"), target, state)
    assert read() == list(range(31))
