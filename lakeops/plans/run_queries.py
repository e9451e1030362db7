"""Queries over job-run history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import scalars as S
from lakeops.operators import runs as R
from lakeops.plans.registry import query

AS_OF = dt.datetime(2024, 1, 31)
#: report text of an instant, and its SQL twin
SQL_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts_text(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def with_ts(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: ts_text(c) for c in cols})


SUCCESS = "lower(status) in ('completed', 'succeeded')"
FAILED = "lower(status) in ('failed', 'cancelled')"
FAILED_M = "lower(status) in ('failed', 'cancelled', 'deduped')"
RUNNING = "lower(status) in ('inprogress', 'running', 'notstarted')"
ITEM = "item_id, item_name, item_type"


def dsum(x: str, scale: int = 6) -> str:
    return f"cast(sum(cast({x} as decimal(28,{scale}))) as double)"


def davg(x: str, scale: int = 6) -> str:
    return f"({dsum(x, scale)} / nullif(cast(count({x}) as double), 0))"


def quantile(x: str, p: float) -> str:
    """Linear-interpolated quantile spelled out, so both engines do the same float steps."""
    pos = f"(cast({p} as double) * (len(vs) - 1))"
    at = "vs[cast({}(" + pos + ") as bigint) + 1]"
    frac = f"({pos} - floor({pos}))"
    return (f"list_transform([list_sort(list({x}) filter ({x} is not null))], "
            f"lambda vs: {at.format('floor')} * (1.0 - {frac}) + {at.format('ceil')} * {frac})[1]")


PER_ITEM = f"""
per_item as (
 select {ITEM}, count(*) as total_runs, count(*) filter ({SUCCESS}) as success_count,
  count(*) filter ({FAILED_M}) as failure_count, count(*) filter ({RUNNING}) as in_progress_count,
  case when count(*) > 0 then cast(count(*) filter ({SUCCESS}) as double) / cast(count(*) as double) * 100 else 0.0 end as success_rate_pct,
  {davg('case when duration_seconds >= 0 then duration_seconds end')} / 60 as avg_duration_min,
  {quantile('case when duration_seconds >= 0 then duration_seconds end', 0.5)} / 60 as p50_duration_min,
  {quantile('case when duration_seconds >= 0 then duration_seconds end', 0.95)} / 60 as p95_duration_min,
  min(duration_seconds) filter (duration_seconds >= 0) / 60 as min_duration_min,
  max(duration_seconds) filter (duration_seconds >= 0) / 60 as max_duration_min,
  coalesce({dsum('case when duration_seconds >= 0 then duration_seconds end')}, 0.0) as total_compute_sec,
  coalesce({dsum('case when duration_seconds >= 0 then duration_seconds end')}, 0.0) / 3600 as total_compute_hrs,
  max(start_time) as last_run_time,
  arg_max(status, (start_time, status)) as last_status
 from fx_runs group by all)"""

TREND = f"""
ordered as (
 select {ITEM}, duration_seconds as d,
  row_number() over (partition by item_id order by start_time, job_instance_id) as rn,
  count(*) over (partition by item_id) as n
 from fx_runs where duration_seconds >= 0 and start_time is not null),
halves as (
 select {ITEM}, max(n) as n,
  {davg('case when rn <= floor(n / 2) then d end')} as a, {davg('case when rn > floor(n / 2) then d end')} as b
 from ordered group by all),
trend as (
 select {ITEM}, case when n >= 4 and a > 0 then (b - a) / a * 100 end as trend_change_pct from halves),
labelled as (
 select {ITEM}, case when trend_change_pct < -10 then 'Improving' when trend_change_pct > 10 then 'Degrading'
  when trend_change_pct is not null then 'Stable' else 'N/A' end as duration_trend, trend_change_pct from trend)"""

REASON = f"""
reason as (
 select {ITEM}, arg_min(failure_reason, (-n, failure_reason)) as top_failure_reason
 from (select {ITEM}, failure_reason, count(*) as n from fx_runs where length(failure_reason) > 0 group by all)
 group by all)"""

EFFICIENCY = f"""
sums as (
 select item_id, item_name, count(*) as total_runs, count(*) filter ({SUCCESS}) as completed_runs,
  count(*) filter ({FAILED}) as failed_runs, coalesce({dsum('duration_seconds')}, 0.0) as total_sec,
  coalesce({dsum(f'case when {SUCCESS} then duration_seconds end')}, 0.0) as ok_sec,
  coalesce({dsum(f'case when {FAILED} then duration_seconds end')}, 0.0) as wasted_sec,
  coalesce({davg('duration_seconds')}, 0.0) as avg_sec,
  count(case when {SUCCESS} then duration_seconds end) as ok_n,
  {quantile(f'case when {SUCCESS} then duration_seconds end', 0.5)} as p50
 from fx_runs where item_type = 'Notebook' group by all),
parts as (
 select *, case when total_sec > 0 then ok_sec / total_sec * 100 else 0.0 end as compute_efficiency_pct,
  case when ok_n >= 2 and ok_sec / ok_n > 0 then least(p50 / (ok_sec / ok_n) * 100, 100.0) else 100.0 end as consistency_pct
 from sums),
eff as (
 select item_id, item_name, total_runs, completed_runs, failed_runs, total_sec, wasted_sec, total_sec / 60 as total_compute_min,
  ok_sec / 60 as successful_compute_min, wasted_sec / 60 as wasted_compute_min, avg_sec / 60 as avg_duration_min,
  wasted_sec / 60 as idle_estimate_min, compute_efficiency_pct, consistency_pct,
  compute_efficiency_pct * cast(0.7 as double) + consistency_pct * cast(0.3 as double) as estimated_efficiency_pct from parts)"""


@query("run_metrics", f"""
with {PER_ITEM}, {TREND}, {REASON},
inv as (select item_id, string_agg(invoke_type || '=' || n, '; ' order by invoke_type) as invoke_types
 from (select item_id, invoke_type, count(*) as n from fx_runs group by all) group by all)
select {', '.join('p.' + c for c in ITEM.split(', '))}, total_runs, success_count, failure_count, in_progress_count,
 success_rate_pct, avg_duration_min, p50_duration_min, p95_duration_min, min_duration_min, max_duration_min,
 total_compute_hrs, {SQL_TS.format('last_run_time')} as last_run_time, last_status,
 coalesce(duration_trend, 'N/A') as duration_trend, trend_change_pct,
 coalesce(top_failure_reason, '') as top_failure_reason, invoke_types
from per_item p left join labelled l using (item_id) left join reason r using (item_id) left join inv using (item_id)""")
def _(lake):
    out = R.run_metrics(lake.fx("runs"))
    return with_ts(out, "last_run_time").withColumn("invoke_types", S.flatten_tags("invoke_types"))


@query("filter_lookback", f"""
select item_id, job_instance_id, status, {SQL_TS.format('start_time')} as start_time from fx_runs
where start_time is null or start_time >= timestamp '2024-01-17 00:00:00'""")
def _(lake):
    out = R.filter_lookback(lake.fx("runs"), AS_OF, 14)
    return with_ts(out.select("item_id", "job_instance_id", "status", "start_time"), "start_time")


@query("classify_run_status", f"""
select status, case when {SUCCESS} then 'success' when {FAILED_M} then 'failure' when {RUNNING} then 'in_progress' else 'other' end as metrics_state,
 case when {SUCCESS} then 'success' when {FAILED} then 'failure' when {RUNNING} then 'in_progress' else 'other' end as analysis_state,
 count(*) as runs from fx_runs group by all""")
def _(lake):
    return R.classify_run_status(lake.fx("runs")).groupBy("status", "metrics_state", "analysis_state").agg(
        F.count(F.lit(1)).alias("runs"))


@query("overall_run_summary", f"""
with {PER_ITEM}
select count(*) as items, count(*) filter (item_type = 'Notebook') as notebooks,
 count(*) filter (item_type = 'DataPipeline') as data_pipelines, cast(sum(total_runs) as bigint) as total_runs,
 cast(sum(success_count) as double) / cast(sum(total_runs) as double) * 100 as success_rate_pct,
 {dsum('total_compute_sec')} / 3600 as total_compute_hrs from per_item""")
def _(lake):
    return R.overall_run_summary(lake.fx("runs"))


@query("run_type_summary", f"""
with {PER_ITEM}
select item_type, count(*) as items, cast(sum(total_runs) as bigint) as total_runs, cast(sum(success_count) as bigint) as success_count,
 cast(sum(failure_count) as bigint) as failure_count,
 cast(sum(success_count) as double) / cast(sum(total_runs) as double) * 100 as success_rate_pct,
 {dsum('total_compute_sec')} / 3600 as total_compute_hrs, round(avg(avg_duration_min), 6) as avg_duration_min
from per_item group by item_type""")
def _(lake):
    return R.run_type_summary(lake.fx("runs"))


@query("last_run", f"""
select {ITEM}, {SQL_TS.format('max(start_time)')} as last_run_time,
 arg_max(status, (start_time, status)) as last_status from fx_runs group by {ITEM}""")
def _(lake):
    return with_ts(R.last_run(lake.fx("runs")), "last_run_time")


@query("duration_trend", f"with {TREND} select * from labelled")
def _(lake):
    return R.duration_trend(lake.fx("runs"))


@query("top_failure_reason", f"with {REASON} select * from reason")
def _(lake):
    return R.top_failure_reason(lake.fx("runs"))


@query("invoke_distribution", f"select {ITEM}, invoke_type, count(*) as runs from fx_runs group by all")
def _(lake):
    return R.invoke_distribution(lake.fx("runs"))


@query("failures_by_item", f"""
select {ITEM}, count(*) as fail_count from fx_runs where {FAILED} group by all order by fail_count desc, item_id limit 10""")
def _(lake):
    return R.failures_by_item(lake.fx("runs"))


@query("failure_reasons", f"""
select failure_reason, runs
from (select failure_reason, count(*) as runs from fx_runs where {FAILED} and length(failure_reason) > 0 group by all
 order by runs desc, failure_reason limit 10)""")
def _(lake):
    return R.failure_reasons(lake.fx("runs"))


@query("recent_failures", f"""
select {SQL_TS.format('start_time')} as start_time, item_type, item_name, job_instance_id, duration_seconds / 60 as duration_min,
 failure_reason
from (select * from fx_runs where {FAILED} and start_time is not null order by fx_runs.start_time desc, job_instance_id desc limit 10)""")
def _(lake):
    return with_ts(R.recent_failures(lake.fx("runs")), "start_time")


@query("weekly_trend", f"""
with done as (select * from fx_runs where {SUCCESS} and duration_seconds is not null and start_time is not null),
busiest as (select item_id from done group by item_id order by count(*) desc, item_id limit 10)
select {ITEM}, cast(isoyear(start_time) as int) as iso_year, cast(weekofyear(start_time) as int) as iso_week, count(*) as runs,
 {davg('duration_seconds')} / 60 as avg_duration_min, {quantile('duration_seconds', 0.95)} / 60 as p95_duration_min
from done where item_id in (select item_id from busiest) group by all""")
def _(lake):
    return R.weekly_trend(lake.fx("runs"))


@query("invoke_pivot", """
select item_type, item_name, count(*) filter (invoke_type = 'Manual') as Manual,
 count(*) filter (invoke_type = 'OnDemand') as OnDemand, count(*) filter (invoke_type = 'Scheduled') as Scheduled,
 count(*) filter (invoke_type is null or invoke_type not in ('Manual', 'OnDemand', 'Scheduled')) as other
from fx_runs group by item_type, item_name""")
def _(lake):
    return R.invoke_pivot(lake.fx("runs"), ["Manual", "OnDemand", "Scheduled"])


@query("health_badge", f"""
with {PER_ITEM}
select {ITEM}, total_runs, success_rate_pct, case when round(success_rate_pct, 1) >= 95 then 'Healthy'
 when round(success_rate_pct, 1) >= 80 then 'Warning' else 'Critical' end as health from per_item""")
def _(lake):
    return R.health(lake.fx("runs"))


@query("health_counts", f"""
with {PER_ITEM}
select case when round(success_rate_pct, 1) >= 95 then 'Healthy'
 when round(success_rate_pct, 1) >= 80 then 'Warning' else 'Critical' end as health, count(*) as items from per_item group by all
union all select 'Never run', count(*) from fx_items where item_id not in (select item_id from fx_runs)""")
def _(lake):
    return R.health_counts(lake.fx("items"), lake.fx("runs"))


@query("never_executed", "select item_id, item_name, item_type from fx_items where item_id not in (select item_id from fx_runs)")
def _(lake):
    return R.never_executed(lake.fx("items"), lake.fx("runs")).select("item_id", "item_name", "item_type")


@query("executed_items", "select item_id, item_name, item_type from fx_items where item_id in (select item_id from fx_runs)")
def _(lake):
    return R.executed_items(lake.fx("items"), lake.fx("runs")).select("item_id", "item_name", "item_type")


FREQUENCY = f"""
steps as (select *, epoch_us(start_time) - epoch_us(lag(start_time) over (partition by item_id order by start_time)) as step
 from fx_runs where start_time is not null),
gaps as (
 select {ITEM}, count(*) as runs, cast(sum(step) as double) / cast(count(*) - 1 as double) / 1000000.0 as avg_gap_seconds
 from steps group by all having count(*) >= 2),
freq as (select *, case when avg_gap_seconds <= 3600 then 'sub-hourly' when avg_gap_seconds <= 86400 then 'daily'
 when avg_gap_seconds <= 604800 then 'weekly' else 'infrequent' end as frequency from gaps)"""


@query("execution_frequency", f"with {FREQUENCY} select * from freq")
def _(lake):
    return R.execution_frequency(lake.fx("runs"))


@query("frequency_bucket", f"with {FREQUENCY} select frequency, count(*) as items, cast(sum(runs) as bigint) as runs from freq group by all")
def _(lake):
    return R.execution_frequency(lake.fx("runs")).groupBy("frequency").agg(
        F.count(F.lit(1)).alias("items"), F.sum("runs").alias("runs"))


@query("compute_efficiency", f"with {EFFICIENCY} select * exclude (total_sec, wasted_sec) from eff")
def _(lake):
    return R.compute_efficiency(lake.fx("runs"))


@query("efficiency_tiers", f"""
with {EFFICIENCY}
select count(*) filter (estimated_efficiency_pct >= 90) as efficient,
 count(*) filter (estimated_efficiency_pct >= 70 and estimated_efficiency_pct < 90) as moderate,
 count(*) filter (estimated_efficiency_pct < 70) as low, round(avg(estimated_efficiency_pct), 6) as avg_efficiency_pct,
 {dsum('total_sec')} / 60 as total_compute_min, {dsum('wasted_sec')} / 60 as wasted_compute_min from eff""")
def _(lake):
    return R.efficiency_tiers(lake.fx("runs"))


@query("least_efficient", f"""
with {EFFICIENCY}
select item_id, item_name, estimated_efficiency_pct, wasted_compute_min from eff order by estimated_efficiency_pct, item_id limit 3""")
def _(lake):
    return R.least_efficient(lake.fx("runs"))


@query("top_n_per_group", f"""
with {PER_ITEM},
slow as (select item_type, row_number() over (partition by item_type order by avg_duration_min desc, item_id) as rk, item_id, item_name,
 avg_duration_min as measure from per_item where avg_duration_min is not null),
fails as (select item_type, row_number() over (partition by item_type order by failure_count desc, item_id) as rk, item_id, item_name,
 cast(failure_count as double) as measure from per_item where failure_count > 0)
select 'slowest' as report, item_type, cast(rk as int) as rank, item_id, item_name, measure from slow where rk <= 3
union all select 'most failing', item_type, cast(rk as int), item_id, item_name, measure from fails where rk <= 3""")
def _(lake):
    runs = lake.fx("runs")
    cols = ["item_type", "rank", "item_id", "item_name"]
    slow = R.slowest_per_type(runs).select(F.lit("slowest").alias("report"), *cols, F.col("avg_duration_min").alias("measure"))
    fails = R.most_failing_per_type(runs).select(
        F.lit("most failing").alias("report"), *cols, F.col("failure_count").cast("double").alias("measure"))
    return slow.unionByName(fails)


@query("sort_efficiency_report", f"""
with {PER_ITEM}
select {ITEM}, total_runs, success_count, failure_count, success_rate_pct, total_compute_hrs, last_status from per_item
order by success_rate_pct, total_runs desc, item_id""")
def _(lake):
    return R.sort_efficiency_report(lake.fx("runs"))


@query("recommend_runs", f"""
with {PER_ITEM}, {TREND}, {EFFICIENCY}
select item_id, item_name, 'low_success' as rule, success_rate_pct as measure from per_item where round(success_rate_pct, 1) < 80
union all select item_id, item_name, 'degrading', trend_change_pct from labelled where duration_trend = 'Degrading'
union all select item_id, item_name, 'long_tail', p95_duration_min from per_item where p95_duration_min > avg_duration_min * 3
union all select item_id, item_name, 'low_efficiency', estimated_efficiency_pct from eff where estimated_efficiency_pct < 70""")
def _(lake):
    return R.recommend_runs(lake.fx("runs"))
