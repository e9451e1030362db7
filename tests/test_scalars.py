"""Scalar rules on edge values."""

import datetime as dt

import pytest

from pyspark.sql import functions as F

from lakeops.functions import scalars as S


def values(spark, kind, inputs, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_format_bytes(spark):
    n = [0, 1023, 1024, 1536, 1024 ** 2, 1024 ** 3, 1024 ** 4 * 5000, None]
    assert values(spark, "long", n, lambda c: S.format_bytes(c, "A")) == [
        "0 B", "1,023 B", "1 KB", "2 KB", "1 MB", "1.00 GB", "4.88 PB", None]
    assert values(spark, "long", n, lambda c: S.format_bytes(c, "B")) == [
        "0 B", "1,023 B", "1 KB", "2 KB", "1.00 MB", "1.00 GB", "5,000.00 TB", None]


def test_parse_utc(spark):
    t = dt.datetime(2024, 1, 2, 3, 4, 5)
    got = values(spark, "string", ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05", "2024-01-02T05:04:05+02:00",
                                   "2024-01-02T03:04:05.1234567Z", "no", "", None], S.parse_utc)
    assert got == [t, t, t, t.replace(microsecond=123456), None, None, None]


def test_iso_duration(spark):
    assert values(spark, "string", ["P7D", "P30DT1H", "PT1H", "", "7D", None], S.iso_duration_days) == [7, 30, None, None, None, None]


def test_extension_and_paths(spark):
    p = ["a/b.PARQUET", "x.tar.gz", "plain", "dir.v1/file", ""]
    assert values(spark, "string", p, S.file_extension) == ["parquet", "gz", "unknown", "v1/file", "unknown"]
    assert values(spark, "string", ["f", "a/f", "a/b/c/f"], S.parent_dirs) == [[""], ["", "a"], ["", "a", "a/b", "a/b/c"]]
    assert values(spark, "string", ["a/b/c/f"], lambda c: S.parent_dirs(c, 1)) == [["", "a"]]
    assert values(spark, "string", ["id1/x/y", "other/x", "id1", None], lambda c: S.relative_path(c, F.lit("id1"))) == ["x/y", "other/x", "", ""]


def test_provider(spark):
    t = ["vendor.compute/machines/ext", "plain", None]
    assert values(spark, "string", t, S.provider) == ["vendor.compute", "plain", None]
    assert values(spark, "string", t, S.provider_type) == ["machines/ext", "plain", None]


def test_host(spark):
    assert values(spark, "string", ["jdbc:vendor://h.example.net;database=x", "https://a.example.com/p?q", "bare"], S.endpoint_host) == [
        "h.example.net", "a.example.com", "bare"]


def test_revenue_tier_is_right_closed(spark):
    r = [0, -1, None, 1, 50_000_000, 50_000_001, 500_000_000, 5_000_000_000, 5_000_000_001]
    assert values(spark, "long", r, S.revenue_tier) == [None, None, None, "SMB", "SMB", "MidMarket", "MidMarket", "Enterprise", "Strategic"]


def test_quarters(spark):
    d = [dt.date(2024, 1, 1), dt.date(2024, 12, 31), dt.date(2024, 5, 31)]
    assert values(spark, "date", d, S.quarter_label) == ["2024Q1", "2024Q4", "2024Q2"]
    assert values(spark, "date", d, S.last_quarter) == ["2023Q4", "2024Q3", "2024Q1"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 4), (1, 0), (None, 4)], "a int, b int").select(S.pct("a", "b").alias("p"), S.safe_ratio("a", "b").alias("r"))
    assert [tuple(x) for x in df.collect()] == [(25.0, 0.25), (0.0, None), (None, None)]


def test_lookups(spark):
    assert values(spark, "string", ["Low", "High", "odd", None], S.migration_wave) == [1, 3, 3, 3]
    assert values(spark, "string", ["Critical", "Info", "?", None], S.severity_rank) == [0, 3, 99, 99]
    assert values(spark, "string", [" VARCHAR ", "Money", "geometry", None], S.normalize_data_type) == ["Text", "Number", "geometry", "Text"]


def test_tags(spark):
    assert values(spark, "map<string,string>", [{"a": "1", "b": "2"}, {}, None, {"a": None}], S.flatten_tags) == ["a=1; b=2", "", "", "a="]


def test_env_names(spark):
    df = spark.createDataFrame([("Sales", "dev", False), ("Sales", "prod", True), ("a-dev", "dev", False)], "n string, e string, p boolean")
    out = df.select(S.env_domain_name("n", "e", "p").alias("f"), "e", "p", "n").withColumn("b", S.env_base_name("f", "e", "p")).collect()
    assert [(r.f, r.b) for r in out] == [("Sales-dev", "Sales"), ("Sales", "Sales"), ("a-dev-dev", "a-dev")]


def test_replacements_run_in_order(spark):
    assert values(spark, "string", ["a.c"], lambda c: S.env_find_replace(c, [("a.c", "b"), ("b", "z")])) == ["z"]


@pytest.mark.parametrize("n, out", [(3, "abc..."), (6, "abcdef"), (9, "abcdef")])
def test_truncate(spark, n, out):
    assert values(spark, "string", ["abcdef"], lambda c: S.truncate_text(c, n)) == [out]


def test_containment_ignores_case_and_missing_text(spark):
    assert values(spark, "string", ["VIRTUALNETWORK", "OnPrem", None], lambda c: S.contains_ignore_case(c, "VirtualNetwork")) == [True, False, False]
