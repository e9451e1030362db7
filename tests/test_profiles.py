"""Profiles stored per file: merged results, and what a second run reads."""

from lakeops.operators import profiles as P

DDL = "k bigint, x double, s string, a array<int>, t timestamp"


def as_rows(df):
    cols = ["column_name", "ordinal", "row_count", "null_count", "distinct_count", "min_length", "max_length", "min_value", "max_value", "null_pct", "table_name"]
    return sorted(tuple(r) for r in df.select(cols).collect())


def part(spark, lo, hi):
    return spark.range(lo, hi).selectExpr(
        "id as k", "if(id % 5 = 0, null, id % 3 / 7.0) as x", "if(id % 4 = 0, null, repeat(cast(id % 6 as string), cast(id % 6 as int) * 30)) as s",
        "if(id % 3 = 0, null, array(cast(id % 2 as int), 1)) as a", "timestamp_micros(id * 1500000) as t").selectExpr(*[f"cast({d.split(' ')[0]} as {d.split(' ')[1]}) as {d.split(' ')[0]}" for d in DDL.split(", ")])


def test_stored_profile_reads_new_files_only(spark, tmp_path, monkeypatch):
    path, store = str(tmp_path / "t"), str(tmp_path / "store")
    schema = part(spark, 0, 1).schema
    part(spark, 0, 40).coalesce(1).write.parquet(path)
    assert P.refresh(spark, path, store, schema) == 1 and P.refresh(spark, path, store, schema) == 0
    part(spark, 30, 90).repartition(2).write.mode("append").parquet(path)
    part(spark, 0, 0).coalesce(1).write.mode("append").parquet(path)  # a file without rows is marked too
    assert P.refresh(spark, path, store, schema) >= 2 and P.refresh(spark, path, store, schema) == 0
    whole = spark.read.schema(schema).parquet(path)
    assert as_rows(P.stored_profile(spark, "t", path, store, schema)) == as_rows(P.column_profile("t", whole))
    # a run that died before its mark is repeated without counting twice
    marks = spark.read.parquet(f"{store}/files").collect()
    spark.createDataFrame(marks[:1], spark.read.parquet(f"{store}/files").schema).write.mode("overwrite").parquet(f"{store}/files-kept")
    (tmp_path / "store" / "files").rename(tmp_path / "store" / "files-old")
    (tmp_path / "store" / "files-kept").rename(tmp_path / "store" / "files")
    assert P.refresh(spark, path, store, schema) == len(marks) - 1
    assert as_rows(P.stored_profile(spark, "t", path, store, schema)) == as_rows(P.column_profile("t", whole))
    # files that went away no longer count
    whole.limit(0).write.mode("overwrite").parquet(path)
    part(spark, 3, 4).coalesce(1).write.mode("append").parquet(path)
    P.refresh(spark, path, store, schema)
    assert as_rows(P.stored_profile(spark, "t", path, store, schema)) == as_rows(P.column_profile("t", part(spark, 3, 4)))


def test_profile_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(0.0, "é" * 100, [1]), (-0.0, "é" * 99 + "f", [1]), (nan, None, None), (inf, "", []), (1e300, "x", [2, 3])], "x double, s string, a array<int>")
    got = {r.column_name: r for r in P.column_profile("t", df).collect()}
    assert got["x"].distinct_count == 4 and got["x"].min_value == "0.000000" and got["x"].max_value == "NaN"
    assert (got["s"].distinct_count, got["s"].min_length, got["s"].max_length, got["s"].null_count) == (4, 0, 100, 1)
    assert (got["a"].distinct_count, got["a"].min_length, got["a"].max_length, got["a"].min_value) == (3, 0, 2, None)


def test_lengths_and_keys_of_numbers_equal_those_of_their_texts(spark):
    inf, nan = float("inf"), float("nan")
    reals = [0.0, -0.0, -1e-9, 5e-7, -0.25, 9.9999995, -123.5, 1e12, 9.9e30, -3e31, 7e31, 1e300, -1e33, inf, -inf, nan, None]
    wholes = [0, -1, 9, -10, 99, 10**18, -(2**63), 2**63 - 1, None]
    for kind in ("double", "float"):
        check_columns(spark, [[r] for r in reals], kind)
        check_columns(spark, [[reals[k], reals[k - 1]] for k in range(len(reals))], kind)
    check_columns(spark, [[w] for w in wholes], "bigint")
    check_columns(spark, [[wholes[k], wholes[k - 1]] for k in range(len(wholes))], "bigint")


def check_columns(spark, columns, kind):
    names = [f"c{k}" for k in range(len(columns))]
    read = "double" if kind == "float" else kind
    df = spark.createDataFrame(list(zip(*columns, strict=True)), ", ".join(f"{c} {read}" for c in names)).selectExpr(*[f"cast({c} as {kind}) as {c}" for c in names])
    shown = df.select([P.value_text(df[c], df.schema[c].dataType).alias(c) for c in names]).collect()
    exact = df.selectExpr(*[f"count(distinct {c}) as {c}" for c in names]).first()
    for got in P.column_profile("t", df).collect():
        lengths = [len(r[got.column_name]) for r in shown if r[got.column_name] is not None]
        assert (got.min_length, got.max_length) == (min(lengths, default=None), max(lengths, default=None)), columns[got.ordinal - 1]
        assert got.distinct_count == exact[got.column_name]


def test_lengths_of_instants(spark):
    for text in ["2024-01-01 00:00:00", "2024-01-01 00:00:00.5", "1969-12-31 23:59:59.000001", "0001-01-01 00:00:00.25", "9999-12-31 23:59:59.99", "+12345-01-01 00:00:00.123", "2024-01-01 10:00:00.012340"]:
        df = spark.sql(f"select timestamp '{text}' as t")
        shown = df.selectExpr("cast(t as string) as s").first().s
        got = P.column_profile("t", df).first()
        assert (got.min_length, got.max_length, got.min_value) == (len(shown), len(shown), shown)


def test_number_lengths_take_no_text_per_row(spark):
    df = spark.sql("select cast(id as double) as x, id as k, timestamp_micros(id) as t from range(9)")
    plan = df.agg(*P.partial_stats(df.schema))._jdf.queryExecution().executedPlan().toString()
    # what tasks aggregate row by row casts plain numbers to text nowhere
    partial = [e for e in plan.split("partial_")[1:] if "length(" in e.split(", partial_")[0]]
    assert all("CASE WHEN" in e for e in partial)
    keys = P.value_keys(df)
    assert keys.columns == ["ordinal", "whole", "real", "text"] and keys.where("text is not null").count() == 0
