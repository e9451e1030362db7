"""Reports over job-run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators.skew import exact_avg, exact_quantiles, exact_sum, half_means, most_frequent, units, wide_sum

ITEM = ["item_id", "item_name", "item_type"]


def _with_item(runs: DataFrame) -> DataFrame:
    """Runs that belong to an item: a NULL in the item key joins no report."""
    return runs.dropna(subset=ITEM)


def _valid(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("duration_seconds") >= 0)


def filter_lookback(runs: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """Runs started within ``days`` before ``as_of``, and runs without a start."""
    start = F.col("start_time")
    return runs.where(start.isNull() | (start >= F.lit(as_of - dt.timedelta(days=days))))


def classify_run_status(runs: DataFrame) -> DataFrame:
    """Both readings of a status: the metrics one counts ``deduped`` as failure, the analysis one does not."""
    return runs.withColumns({
        "metrics_state": S.run_state("status", K.FAILURE_METRICS),
        "analysis_state": S.run_state("status", K.FAILURE_ANALYSIS),
    })


def mean_of_means(value: Column) -> Column:
    """Plain mean of per-item figures, to six digits: the order of addition does not show."""
    return F.round(F.avg(value), 6)


def _facets(runs: DataFrame) -> DataFrame:
    """Everything counted per item from one scan: a run counts under its status (with durations and starts), its invoke
    type and its failure reason. Tasks keep one row per item and value before the shuffle; numbers only, so it hashes."""
    valid = F.when(F.col("duration_seconds") >= 0, F.col("duration_seconds"))
    reason = F.when(F.length("failure_reason") > 0, F.col("failure_reason"))
    seen = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in enumerate((F.col("status"), F.col("invoke_type"), reason))])
    one = runs.select(*ITEM, "start_time", valid.alias("_valid"), F.explode(seen).alias("_f")).where((F.col("_f.kind") == 0) | F.col("_f.value").isNotNull())
    own = F.col("_f.kind") == 0
    one = one.select(*ITEM, "_f.*", *[F.when(own, F.col(c)).alias(c) for c in ("start_time", "_valid")], F.when(own, units(F.col("_valid"))).alias("_u"))
    return one.groupBy(*ITEM, "kind", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.count("_valid").alias("timed"), wide_sum(F.col("_u")).alias("micros"),
        F.min("_valid").alias("shortest"), F.max("_valid").alias("longest"), F.max("start_time").alias("latest")).select(
        "*", *[F.when(F.col("kind") == 0, F.col(c)).alias(new) for c, new in (("value", "status"), ("_n", "n"))])


def _per_status(runs: DataFrame) -> DataFrame:
    """Runs per item and status: numbers only, so it is a hash aggregate that shrinks map-side."""
    valid = F.when(F.col("duration_seconds") >= 0, F.col("duration_seconds"))
    u = units(valid)
    return runs.groupBy(*ITEM, "status").agg(
        F.count(F.lit(1)).alias("n"), F.count(valid).alias("timed"), wide_sum(u).alias("micros"),
        F.min(valid).alias("shortest"), F.max(valid).alias("longest"), F.max("start_time").alias("latest"))


def _last_status() -> Column:
    """Status of the latest start; missing starts come last, equal ones go by status name."""
    return F.max_by("status", F.struct("latest", "status"))


def _counts(runs: DataFrame) -> DataFrame:
    return _count_columns(_per_status(runs))


def _count_columns(parts: DataFrame, *more: Column) -> DataFrame:
    """Counts and durations per item from partial counts that name a status; ``more`` aggregates of the same parts."""
    def runs_in(names) -> Column:
        return F.coalesce(F.sum(F.when(S.status_in("status", names), F.col("n"))), F.lit(0))

    seconds = F.coalesce(F.sum("micros").cast("double") / F.lit(1e6), F.lit(0.0))
    return parts.groupBy(*ITEM).agg(
        F.sum("n").alias("total_runs"),
        runs_in(K.SUCCESS).alias("success_count"),
        runs_in(K.FAILURE_METRICS).alias("failure_count"),
        runs_in(K.IN_PROGRESS).alias("in_progress_count"),
        (F.try_divide(seconds, F.sum("timed").cast("double")) / 60).alias("avg_duration_min"),
        (F.min("shortest") / 60).alias("min_duration_min"),
        (F.max("longest") / 60).alias("max_duration_min"),
        seconds.alias("total_compute_sec"),
        F.max("latest").alias("last_run_time"),
        _last_status().alias("last_status"),
        *more,
    ).withColumns({
        "success_rate_pct": S.pct("success_count", "total_runs"), "total_compute_hrs": F.col("total_compute_sec") / 3600})


def duration_trend(runs: DataFrame) -> DataFrame:
    """Later half against earlier half of each item's runs; needs four timed runs."""
    timed = _valid(_with_item(runs)).where(F.col("start_time").isNotNull())
    halves = half_means(timed, ITEM, "start_time", "job_instance_id", "duration_seconds")
    usable = (F.col("half_rows") >= 4) & (F.col("first_half_mean") > 0)
    change = F.when(
        usable, (F.col("second_half_mean") - F.col("first_half_mean")) / F.col("first_half_mean") * 100)
    return halves.withColumn("trend_change_pct", change).select(
        *ITEM,
        F.when(F.col("trend_change_pct") < -10, "Improving").when(F.col("trend_change_pct") > 10, "Degrading")
        .when(F.col("trend_change_pct").isNotNull(), "Stable").otherwise("N/A").alias("duration_trend"),
        "trend_change_pct",
    )


def top_failure_reason(runs: DataFrame) -> DataFrame:
    """Most frequent non-empty reason per item."""
    failed = _with_item(runs).where(F.length("failure_reason") > 0)
    return most_frequent(failed, ITEM, "failure_reason", "top_failure_reason")


def invoke_distribution(runs: DataFrame) -> DataFrame:
    """Runs per item and invoke type, long form."""
    return _with_item(runs).groupBy(*ITEM, "invoke_type").agg(F.count(F.lit(1)).alias("runs"))


def invoke_map(runs: DataFrame) -> DataFrame:
    """One map per item; its size is the number of invoke types, never of runs."""
    return _as_map(invoke_distribution(runs))


def _as_map(distribution: DataFrame) -> DataFrame:
    entry = F.struct("invoke_type", "runs")
    return distribution.where(F.col("invoke_type").isNotNull()).groupBy(*ITEM).agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("invoke_types"))


def duration_quantiles(runs: DataFrame) -> DataFrame:
    timed = exact_quantiles(_valid(_with_item(runs)), ITEM, "duration_seconds", {"p50": 0.5, "p95": 0.95})
    return timed.select(*ITEM, (F.col("p50") / 60).alias("p50_duration_min"), (F.col("p95") / 60).alias("p95_duration_min"))


def run_metrics(runs: DataFrame) -> DataFrame:
    """One row per item: counts, success rate, durations, last run, trend, top failure, invoke types."""
    base = _with_item(runs)
    invoked, failed = F.col("kind") == 1, F.col("kind") == 2
    entries = F.collect_list(F.when(invoked, F.struct(F.col("value").alias("invoke_type"), F.col("_n").alias("runs"))))
    counts = _count_columns(
        _facets(base), F.map_from_entries(F.array_sort(F.when(F.size(entries) > 0, entries))).alias("invoke_types"),
        F.min_by("value", F.when(failed, F.struct(-F.col("_n"), F.col("value")))).alias("top_failure_reason"))
    return (
        counts
        .join(duration_quantiles(base), ITEM, "left")
        .join(duration_trend(base), ITEM, "left")
        .select(
            *ITEM, "total_runs", "success_count", "failure_count", "in_progress_count", "success_rate_pct",
            "avg_duration_min", "p50_duration_min", "p95_duration_min", "min_duration_min", "max_duration_min",
            "total_compute_hrs", "last_run_time", "last_status",
            F.coalesce("duration_trend", F.lit("N/A")).alias("duration_trend"), "trend_change_pct",
            F.coalesce("top_failure_reason", F.lit("")).alias("top_failure_reason"), "invoke_types",
        )
    )


def round_report(metrics: DataFrame) -> DataFrame:
    """Digits as printed: one decimal for percentages, two for minutes and hours."""
    digits = {c: 1 if c.endswith("_pct") else 2 for c in metrics.columns
              if c.endswith(("_pct", "_min", "_hrs"))}
    return metrics.withColumns({c: F.round(c, d) for c, d in digits.items()})


def last_run(runs: DataFrame) -> DataFrame:
    """Latest start and its status per item."""
    return _per_status(_with_item(runs)).groupBy(*ITEM).agg(
        F.max("latest").alias("last_run_time"), _last_status().alias("last_status"))


def overall_run_summary(runs: DataFrame) -> DataFrame:
    base = _with_item(runs)
    per_item = _counts(base)
    return per_item.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("item_type") == "Notebook").alias("notebooks"),
        F.count_if(F.col("item_type") == "DataPipeline").alias("data_pipelines"),
        F.coalesce(F.sum("total_runs"), F.lit(0)).alias("total_runs"),
        S.pct(F.sum("success_count"), F.sum("total_runs")).alias("success_rate_pct"),
        (F.coalesce(exact_sum(F.col("total_compute_sec")), F.lit(0.0)) / 3600).alias("total_compute_hrs"),
    )


def run_type_summary(runs: DataFrame) -> DataFrame:
    """Totals per item type, with the mean of the items' own mean durations."""
    return _counts(_with_item(runs)).groupBy("item_type").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum("total_runs").alias("total_runs"),
        F.sum("success_count").alias("success_count"),
        F.sum("failure_count").alias("failure_count"),
        S.pct(F.sum("success_count"), F.sum("total_runs")).alias("success_rate_pct"),
        (exact_sum(F.col("total_compute_sec")) / 3600).alias("total_compute_hrs"),
        mean_of_means(F.col("avg_duration_min")).alias("avg_duration_min"),
    )


def _failed(runs: DataFrame) -> DataFrame:
    return runs.where(S.status_in("status", K.FAILURE_ANALYSIS))


def failures_by_item(runs: DataFrame, top: int = 10) -> DataFrame:
    counted = _failed(_with_item(runs)).groupBy(*ITEM).agg(F.count(F.lit(1)).alias("fail_count"))
    return counted.orderBy(F.desc("fail_count"), "item_id").limit(top)


def failure_reasons(runs: DataFrame, top: int = 10) -> DataFrame:
    """Most frequent reasons of failed or cancelled runs."""
    counted = _failed(runs).where(F.length("failure_reason") > 0).groupBy("failure_reason").agg(
        F.count(F.lit(1)).alias("runs"))
    return counted.orderBy(F.desc("runs"), "failure_reason").limit(top)


def recent_failures(runs: DataFrame, top: int = 10) -> DataFrame:
    newest = _failed(runs).where(F.col("start_time").isNotNull()).orderBy(F.desc("start_time"), F.desc("job_instance_id"))
    return newest.limit(top).select(
        "start_time", "item_type", "item_name", "job_instance_id", (F.col("duration_seconds") / 60).alias("duration_min"),
        "failure_reason")


def weekly_trend(runs: DataFrame, top: int = 10) -> DataFrame:
    """Per ISO year and week: runs, mean and P95 minutes of the ``top`` items by completed runs."""
    done = _with_item(runs).where(
        S.status_in("status", K.SUCCESS) & F.col("duration_seconds").isNotNull() & F.col("start_time").isNotNull())
    busiest = done.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_id").limit(top)
    kept = done.join(busiest.select(*ITEM), ITEM, "left_semi").select(
        *ITEM, "duration_seconds",
        F.extract(F.lit("YEAROFWEEK"), "start_time").cast("int").alias("iso_year"),
        F.weekofyear("start_time").alias("iso_week"))
    keys = [*ITEM, "iso_year", "iso_week"]
    stats = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), (exact_avg(F.col("duration_seconds")) / 60).alias("avg_duration_min"))
    tail = exact_quantiles(kept, keys, "duration_seconds", {"p95": 0.95})
    return stats.join(tail, keys).withColumn("p95_duration_min", F.col("p95") / 60).drop("p95")


def invoke_pivot(runs: DataFrame, invoke_types: list[str]) -> DataFrame:
    """Items as rows, the given invoke types as columns, and what is of no given type as ``other``."""
    given = F.coalesce(F.col("invoke_type").isin(invoke_types), F.lit(False))
    return _with_item(runs).groupBy("item_type", "item_name").agg(
        *[F.count_if(F.col("invoke_type") == t).alias(t) for t in invoke_types], F.count_if(~given).alias("other"))


def never_executed(items: DataFrame, runs: DataFrame) -> DataFrame:
    return items.join(runs.select("item_id").distinct(), "item_id", "left_anti")


def executed_items(items: DataFrame, runs: DataFrame) -> DataFrame:
    return items.join(runs.select("item_id").distinct(), "item_id", "left_semi")


def health(runs: DataFrame) -> DataFrame:
    """Success rate and badge per item."""
    return _counts(_with_item(runs)).select(
        *ITEM, "total_runs", "success_rate_pct", S.health_badge("success_rate_pct").alias("health"))


def health_counts(items: DataFrame, runs: DataFrame) -> DataFrame:
    """Items per badge, and items that never ran."""
    badges = health(runs).groupBy("health").agg(F.count(F.lit(1)).alias("items"))
    idle = never_executed(items, runs).agg(F.lit("Never run").alias("health"), F.count(F.lit(1)).alias("items"))
    return badges.unionByName(idle)


def execution_frequency(runs: DataFrame) -> DataFrame:
    """Mean gap between consecutive starts of an item and the pattern it suggests.

    The gaps of an ordered series add up to last minus first, so no sort is needed.
    """
    started = _with_item(runs).where(F.col("start_time").isNotNull())
    span = (F.unix_micros(F.max("start_time")) - F.unix_micros(F.min("start_time"))).cast("double")
    gaps = started.groupBy(*ITEM).agg(
        F.count(F.lit(1)).alias("runs"), span.alias("span"))
    gap = F.col("span") / (F.col("runs") - 1).cast("double") / 1e6
    return gaps.where(F.col("runs") >= 2).withColumn("avg_gap_seconds", gap).select(
        *ITEM, "runs", "avg_gap_seconds", S.frequency_bucket("avg_gap_seconds").alias("frequency"))


def compute_efficiency(runs: DataFrame) -> DataFrame:
    """Notebook report: see :func:`_efficiency`, without its helper columns."""
    return _efficiency(runs).drop("total_sec", "wasted_sec")


def _efficiency(runs: DataFrame) -> DataFrame:
    """Share of notebook compute spent on successful runs, blended with how steady their durations are."""
    keys = ["item_id", "item_name"]
    notebooks = runs.where(F.col("item_type") == "Notebook").dropna(subset=keys)
    sec = F.col("duration_seconds")
    ok, bad = S.status_in("status", K.SUCCESS), S.status_in("status", K.FAILURE_ANALYSIS)
    zero = F.lit(0.0)
    sums = notebooks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(ok).alias("completed_runs"),
        F.count_if(bad).alias("failed_runs"),
        F.coalesce(exact_sum(sec), zero).alias("total_sec"),
        F.coalesce(exact_sum(F.when(ok, sec)), zero).alias("ok_sec"),
        F.coalesce(exact_sum(F.when(bad, sec)), zero).alias("wasted_sec"),
        F.coalesce(exact_avg(sec), zero).alias("avg_sec"),
        F.count(F.when(ok, sec)).alias("ok_n"),
    )
    median = exact_quantiles(notebooks.where(ok), keys, "duration_seconds", {"p50": 0.5})
    mean = F.try_divide("ok_sec", F.col("ok_n").cast("double"))
    steady = F.when((F.col("ok_n") >= 2) & (mean > 0), F.least(F.col("p50") / mean * 100, F.lit(100.0))).otherwise(100.0)
    return sums.join(median, keys, "left").withColumns({
        "compute_efficiency_pct": S.pct("ok_sec", "total_sec"), "consistency_pct": steady,
    }).select(
        *keys, "total_runs", "completed_runs", "failed_runs",
        "total_sec", "wasted_sec",
        (F.col("total_sec") / 60).alias("total_compute_min"),
        (F.col("ok_sec") / 60).alias("successful_compute_min"),
        (F.col("wasted_sec") / 60).alias("wasted_compute_min"),
        (F.col("avg_sec") / 60).alias("avg_duration_min"),
        (F.col("wasted_sec") / 60).alias("idle_estimate_min"),
        "compute_efficiency_pct", "consistency_pct",
        (F.col("compute_efficiency_pct") * 0.7 + F.col("consistency_pct") * 0.3).alias("estimated_efficiency_pct"),
    )


def efficiency_tiers(runs: DataFrame) -> DataFrame:
    est = F.col("estimated_efficiency_pct")
    return _efficiency(runs).agg(
        F.count_if(est >= 90).alias("efficient"),
        F.count_if((est >= 70) & (est < 90)).alias("moderate"),
        F.count_if(est < 70).alias("low"),
        mean_of_means(est).alias("avg_efficiency_pct"),
        (exact_sum(F.col("total_sec")) / 60).alias("total_compute_min"),
        (exact_sum(F.col("wasted_sec")) / 60).alias("wasted_compute_min"),
    )


def least_efficient(runs: DataFrame, n: int = 3) -> DataFrame:
    return compute_efficiency(runs).orderBy("estimated_efficiency_pct", "item_id").limit(n).select(
        "item_id", "item_name", "estimated_efficiency_pct", "wasted_compute_min")


def top_n_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """First ``n`` rows of every group; ``order`` must end in a unique column.

    Spark cuts each task to ``n`` rows per group before the shuffle, so a hot
    group moves at most ``n`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def slowest_per_type(runs: DataFrame, n: int = 3) -> DataFrame:
    per_item = _counts(_with_item(runs)).where(F.col("avg_duration_min").isNotNull())
    return top_n_per_group(per_item, ["item_type"], [F.desc("avg_duration_min"), F.col("item_id")], n).select(
        "item_type", "rank", "item_id", "item_name", "avg_duration_min")


def most_failing_per_type(runs: DataFrame, n: int = 3) -> DataFrame:
    per_item = _counts(_with_item(runs)).where(F.col("failure_count") > 0)
    return top_n_per_group(per_item, ["item_type"], [F.desc("failure_count"), F.col("item_id")], n).select(
        "item_type", "rank", "item_id", "item_name", "failure_count", "success_rate_pct")


def sort_efficiency_report(runs: DataFrame) -> DataFrame:
    """Least successful items first, busier ones first among equals."""
    return _counts(_with_item(runs)).select(
        *ITEM, "total_runs", "success_count", "failure_count", "success_rate_pct", "total_compute_hrs", "last_status",
    ).orderBy("success_rate_pct", F.desc("total_runs"), "item_id")


def recommend_runs(runs: DataFrame) -> DataFrame:
    """One row per item and firing rule: low success, degrading trend, long tail, low efficiency."""
    base = _with_item(runs)
    metrics = _counts(base).join(duration_quantiles(base), ITEM, "left").join(duration_trend(base), ITEM, "left")
    low = F.round("success_rate_pct", 1) < K.WARNING_PCT
    tail = F.col("p95_duration_min") > F.col("avg_duration_min") * 3
    rules = F.filter(F.array(
        F.when(low, F.struct(F.lit("low_success").alias("rule"), F.col("success_rate_pct").alias("measure"))),
        F.when(F.col("duration_trend") == "Degrading",
               F.struct(F.lit("degrading").alias("rule"), F.col("trend_change_pct").alias("measure"))),
        F.when(tail, F.struct(F.lit("long_tail").alias("rule"), F.col("p95_duration_min").alias("measure"))),
    ), lambda r: r.isNotNull())
    fired = metrics.select("item_id", "item_name", F.explode(rules).alias("r")).select(
        "item_id", "item_name", "r.rule", "r.measure")
    idle = compute_efficiency(runs).where(F.col("estimated_efficiency_pct") < 70).select(
        "item_id", "item_name", F.lit("low_efficiency").alias("rule"), F.col("estimated_efficiency_pct").alias("measure"))
    return fired.unionByName(idle)


def spark_app_tiers(apps: DataFrame) -> DataFrame:
    """Applications per efficiency tier; those without a figure are counted apart."""
    eff = F.col("spark_efficiency_pct")
    tier = F.when(eff.isNull(), "no data").when(eff >= 70, "good").when(eff >= 50, "fair").otherwise("poor")
    return apps.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("apps"))
