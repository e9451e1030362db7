"""Readers, writers and resumable jobs."""

import datetime as dt

import pytest

from lakeops.operators import normalize as N
from lakeops.session import cut_lineage, scratch_path, shared_root, small_frame
from lakeops.sources import readers, sinks


def test_shared_folder_is_the_configured_one(spark):
    root = shared_root(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert configured is None or root == configured
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_scratch_is_released(spark):
    import os

    from lakeops.session import release_scratch, scratch_mark

    mark = scratch_mark(spark)
    kept, gone = cut_lineage(spark.range(3)), None
    between = scratch_mark(spark)
    gone = cut_lineage(spark.range(5))
    [file] = {os.path.dirname(f).removeprefix("file:").replace("//", "/") for f in gone.inputFiles()}
    assert between == mark + 1 and os.path.isdir(file)
    assert release_scratch(spark, since=between) == 1 and not os.path.exists(file) and kept.count() == 3


def test_cut_lineage_keeps_rows_and_schema(spark):
    df = spark.createDataFrame([(1, [1.5], {"a": "b"})], "i int, v array<double>, m map<string,string>")
    out = cut_lineage(df)
    assert out.schema == df.schema and out.collect() == df.collect()
    assert "FileScan" in out._jdf.queryExecution().executedPlan().toString()


def test_small_frame_runs_without_python(spark):
    df = small_frame(spark, [("a", None), ("b", 2)], "k string, n int")
    assert [tuple(r) for r in df.collect()] == [("a", None), ("b", 2)]
    assert "LocalTableScan" in df._jdf.queryExecution().executedPlan().toString()


def test_pages(spark, tmp_path, rows):
    (tmp_path / "p1.json").write_text('{"value": [{"id": 1, "n": "a"}, {"id": 2}], "continuationToken": "t"}\n{"domains": [{"id": 3, "n": "c"}]}\n')
    (tmp_path / "p2.json").write_text('{"value": [{"id": 1, "n": "a"}]}\n{"value": []}\n{}\n')
    df = readers.read_paged_json(spark, str(tmp_path), "id bigint, n string", "id", ("domains", "value"))
    assert rows(df) == [(1, "a"), (2, None), (3, "c")]


def test_pushed_query_options():
    one = readers.jdbc_options("jdbc:x", "select 1")
    assert one["query"] == "select 1" and "dbtable" not in one
    many = readers.jdbc_options("jdbc:x", "select * from t", ("id", 0, 100, 8), user="u")
    assert many["dbtable"] == "(select * from t) pushed" and many["numPartitions"] == "8" and many["user"] == "u" and "query" not in many


def test_remote_top_n_text():
    from lakeops.operators.diagnostics import top_n_remote_sql as sql
    args = ("t", ["a", "b"], "a > 1", "a DESC", 5)
    assert sql(*args, dialect="tsql") == "SELECT TOP 5 a, b FROM t WHERE a > 1 ORDER BY a DESC"
    assert sql(*args, dialect="fetch").endswith("FETCH FIRST 5 ROWS ONLY") and sql(*args).endswith("LIMIT 5")


def test_no_source_at_all(spark, tmp_path):
    bad = [("x", lambda: spark.read.parquet(f"{tmp_path}/x")), ("y", lambda: spark.range(1).select("nope"))]
    with pytest.raises(ValueError, match="x: .*\n.*y: "):
        readers.read_first_available(bad)
    with pytest.raises(ValueError):
        readers.read_tolerant(spark, dict(bad))


def test_export(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2), {"k": 1})], "i int, t timestamp, m map<string,int>")
    path = sinks.write_csv_export(df, str(tmp_path), "r", ["m", "t", "gone"], dt.datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("/r_20240506_070809")
    [r] = spark.read.option("header", True).option("escape", '"').csv(path).collect()
    assert r.asDict() == {"m": '{"k":1}', "t": "2024-01-02T00:00:00.000000"}


def test_ingest_resumes_repeats_and_rescans(spark, tmp_path, rows):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")

    def load(pairs, force=False):
        sinks.ingest_resumable(spark.createDataFrame(pairs, "id int, cap string"), target, state, "cap", force)
        return rows(sinks.read_ingested(spark, target))

    assert load([(1, "a"), (2, "a")]) == [(1, "a"), (2, "a")]
    # done partitions are skipped even if their source changed; new ones are added
    assert load([(9, "a"), (3, "b")]) == [(1, "a"), (2, "a"), (3, "b")]
    # a crash before the marks: the same partition again replaces itself
    spark.read.parquet(state).where("cap <> 'b'").coalesce(1).write.parquet(state + "2")
    sinks.ingest_resumable(spark.createDataFrame([(3, "b")], "id int, cap string"), target, state + "2", "cap")
    assert rows(sinks.read_ingested(spark, target)) == [(1, "a"), (2, "a"), (3, "b")]
    assert load([(9, "a"), (3, "b")], force=True) == [(3, "b"), (9, "a")]
    # rows without a partition key are neither lost nor marked twice
    assert load([(7, None)]) == load([(7, None)]) == [(3, "b"), (7, None), (9, "a")]
    assert load([(5, "c")], force=True) == [(5, "c")] and rows(spark.read.parquet(state)) == [("c",)]


def test_failure_reason_shapes(spark):
    raw = [("a", '{"message": "boom", "errorCode": "X"}'), ("b", "plain"), ("c", None), ("d", '{"errorCode": "X"}')]
    df = spark.createDataFrame(raw, "id string, failureReason string").selectExpr(
        "1 as item_id", "'n' as item_name", "'t' as item_type", "id", "failureReason", "'2024-01-01T00:00:00Z' as startTimeUtc", "cast(null as string) as endTimeUtc")
    got = {r.job_instance_id: (r.failure_reason, r.status, r.duration_seconds) for r in N.normalize_runs(df).collect()}
    assert got == {"a": ("boom", "Unknown", None), "b": ("plain", "Unknown", None), "c": ("", "Unknown", None), "d": ("", "Unknown", None)}


def test_spark_apps_zero_idle_is_full_use(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "n", "totalDuration": 10, "totalIdleTime": 0}\n{"appName": "m", "duration": "10", "idleTime": 5}\n')
    df = spark.read.schema("name string, appName string, totalDuration double, duration double, totalIdleTime double, idleTime double").json(str(tmp_path))
    got = {r.notebook_name: (r.total_duration_sec, r.spark_efficiency_pct) for r in N.normalize_spark_apps(df).collect()}
    assert got == {"n": (10.0, 100.0), "m": (None, None)}


def test_pages_keep_rows_without_id_and_one_version(spark, tmp_path, rows):
    (tmp_path / "p.json").write_text('{"value": [{"id": 1, "n": "a"}, {"id": null, "n": "x"}, {"id": null, "n": "y"}]}\n{"value": [{"id": 1, "n": "b"}]}\n')
    got = readers.read_paged_json(spark, str(tmp_path / "p.json"), "id bigint, n string", "id")
    assert rows(got) == [(1, "b"), (None, "x"), (None, "y")]


def test_ingest_tells_empty_and_null_keys_apart(spark, tmp_path, rows):
    target, state = str(tmp_path / "t"), str(tmp_path / "s")
    first = spark.createDataFrame([(1, ""), (2, "b")], "id int, k string")
    sinks.ingest_resumable(first, target, state, "k")
    sinks.ingest_resumable(first.union(spark.createDataFrame([(3, None)], "id int, k string")), target, state, "k")
    assert rows(sinks.read_ingested(spark, target)) == [(1, ""), (2, "b"), (3, None)]


def test_listing_over_tasks(spark, tmp_path, rows):
    import os

    names = ["a.txt", "b/c.parquet", "b/d e/f.json", "b/k=v/_part=1/g.csv", "_hidden/x", ".h", "b/_SUCCESS"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    (tmp_path / "empty" / "inner").mkdir(parents=True)
    (tmp_path / "loop").symlink_to(tmp_path, target_is_directory=True)
    got = {r.file_path: r for r in readers.read_file_listing(spark, str(tmp_path)).collect()}
    seen = {n for n in names if not n.startswith(("_", ".")) and "_SUCCESS" not in n}
    assert set(got) == {f"file:{tmp_path}/{n}" for n in seen | {"loop"}}
    for n in seen:
        r = got[f"file:{tmp_path}/{n}"]
        assert r.size_bytes == len(n) and abs(r.modified.replace(tzinfo=dt.UTC).timestamp() - os.path.getmtime(tmp_path / n)) < 1e-3
    from lakeops.sources.listing import list_files
    assert list_files(spark, f"file://{tmp_path}", hidden=True).count() == len(names) + 1
    assert readers.read_file_listing(spark, f"{tmp_path}/empty").count() == 0
    with pytest.raises(Exception, match="No such file"):
        readers.read_file_listing(spark, f"{tmp_path}/gone")
