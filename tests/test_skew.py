"""Order statistics and ranks against brute force, with a hot key and ties."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakeops.operators import skew

T0 = dt.datetime(2024, 1, 1)


def history(seed, n=3000):
    """A third of all rows on one key; bursts of equal times; equal, negative and missing values."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.34 else f"k{rnd.randrange(40)}"
        t = T0 + dt.timedelta(seconds=rnd.choice([0, 0, 59, 60, rnd.randrange(7200)]), microseconds=rnd.choice([0, 1, 999999]))
        v = rnd.choice([None, 0.0, 5.0, 5.0, -3.25, round(rnd.uniform(0, 1e5), 2)])
        out.append((key, i, t, v))
    return out


@pytest.fixture(params=[1, 2])
def data(request, spark):
    rows = history(request.param)
    return rows, spark.createDataFrame(rows, "k string, id int, t timestamp, v double").repartition(7)


def test_quantiles(data):
    rows, df = data
    got = {r.k: (r.a, r.b, r.c, r.d) for r in skew.exact_quantiles(df, ["k"], "v", {"a": 0, "b": 0.5, "c": 0.95, "d": 1}).collect()}
    groups = {}
    for k, _, _, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k] == pytest.approx(tuple(np.quantile(vs, [0, 0.5, 0.95, 1])), rel=1e-12)


def test_quantiles_without_keys(data):
    rows, df = data
    got = skew.exact_quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in got] == [statistics.median(v for *_, v in rows if v is not None)]


def test_bands_follow_the_order(spark):
    values = sorted([0.0, 1e-9, 0.5, 1, 2, 1e3, 1e9, 1e300, -0.5, -2.0, -1e12])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    bands = [r.b for r in df.orderBy("v").select(skew.value_band(df["v"]).alias("b")).collect()]
    assert bands == sorted(bands)


def test_rank_over_ranges(data):
    rows, df = data
    got = {r.id: r.n for r in skew.ranked_by_range(df, ["k"], ["t", "id"], "n").collect()}
    want, count = {}, {}
    for k, i, _, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        count[k] = want[i] = count.get(k, 0) + 1
    assert got == want



def test_half_means_of_one_instant(spark, monkeypatch):
    rows = [("hot", i, T0, float(i % 13)) for i in range(6001)] + [("a", 1, T0, 4.0)]
    parts, cut = [], skew.cut_lineage

    def spy(df, tag):
        out = cut(df, tag)
        if tag == "ranged":
            parts.extend(r["count"] for r in out.where("k = 'hot'").groupBy("_part").count().collect())
        return out

    monkeypatch.setattr(skew, "cut_lineage", spy)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k string, id int, t timestamp, v double").repartition(7)
        got = {r.k: (r.first_half_mean, r.second_half_mean) for r in skew.half_means(df, ["k"], "t", "id", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(parts) > 1 and max(parts) < 4000 and sum(parts) == 6001
    hot = [v for *_, v in rows[:6001]]
    assert got["hot"] == pytest.approx((statistics.mean(hot[:3000]), statistics.mean(hot[3000:]))) and got["a"] == (None, 4.0)


def test_half_means(data):
    rows, df = data
    got = {r.k: r for r in skew.half_means(df.where("v is not null"), ["k"], "t", "id", "v").collect()}
    groups = {}
    for k, i, t, v in rows:
        if v is not None:
            groups.setdefault(k, []).append((t, i, v))
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        vs.sort()
        mid = len(vs) // 2
        for part, mean in ((vs[:mid], got[k].first_half_mean), (vs[mid:], got[k].second_half_mean)):
            want = sum(v for *_, v in part) / len(part) if part else None
            assert mean == (None if want is None else pytest.approx(want, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("seconds", [0, 1, 60, 3600])
def test_trailing_counts(data, seconds):
    rows, df = data
    got = {r.id: r.n for r in skew.trailing_counts(df, "k", "t", seconds, "n").collect()}
    span = dt.timedelta(seconds=seconds)
    times = {}
    for k, _, t, _ in rows:
        times.setdefault(k, []).append(t)
    assert got == {i: sum(t - span <= u <= t for u in times[k]) for k, i, t, _ in rows}


def test_most_frequent_takes_the_smallest_on_a_tie(spark, rows):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("b", "z"), ("c", None)], "k string, r string")
    assert rows(skew.most_frequent(df, ["k"], "r", "top")) == [("a", "x"), ("b", "z"), ("c", None)]


def test_exact_sum_does_not_depend_on_order(spark):
    vals = [0.1, 1e9, -1e9, 0.2, 3e8, 0.3]
    sums = set()
    for order in (vals, vals[::-1], sorted(vals)):
        df = spark.createDataFrame([(v,) for v in order], "v double").repartition(3)
        sums.add(df.select(skew.exact_sum(df["v"]).alias("s")).first().s)
    assert sums == {300000000.6}


def test_empty_input_keeps_its_columns(spark):
    df = spark.createDataFrame([], "k string, id int, t timestamp, v double")
    assert skew.exact_quantiles(df, ["k"], "v", {"p": 0.5}).columns == ["k", "p"]
    assert skew.half_means(df, ["k"], "t", "id", "v").count() == 0
    assert skew.trailing_counts(df, "k", "t", 60, "n").count() == 0


def test_exact_sum_of_large_and_odd_values(spark):
    rows = [("a", 1.5), ("a", 2e13), ("b", float("nan")), ("b", 1.0), ("c", None), ("d", 1e32), ("e", -3e12), ("e", 0.25)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.s for r in df.groupBy("k").agg(skew.exact_sum(F.col("v")).alias("s")).collect()}
    assert got["a"] == 2e13 + 1.5 and got["b"] != got["b"] and got["c"] is None and got["d"] == float("inf") and got["e"] == -3e12 + 0.25
