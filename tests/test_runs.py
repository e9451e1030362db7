"""Run reports on literal frames: one test per semantic choice."""

import datetime as dt

import pytest

from lakeops.operators import runs as R

T = dt.datetime
RUN = ("item_id string, item_name string, item_type string, job_instance_id long, invoke_type string, status string, "
       "start_time timestamp, duration_seconds double, failure_reason string")


def frame(spark, *rows):
    base = {"item_id": "a", "item_name": "A", "item_type": "Notebook", "invoke_type": "Manual", "status": "Completed",
            "start_time": T(2024, 1, 1), "duration_seconds": 60.0, "failure_reason": ""}
    full = [{**base, "job_instance_id": i, **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in RUN.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], RUN)


def hours(*durations):
    return [{"start_time": T(2024, 1, 1, i), "duration_seconds": d} for i, d in enumerate(durations)]


def test_lookback_keeps_runs_without_a_start(spark):
    df = frame(spark, {"start_time": None}, {"start_time": T(2024, 1, 1)}, {"start_time": T(2024, 1, 20)})
    assert R.filter_lookback(df, T(2024, 1, 31), 14).count() == 2


def test_deduped_fails_in_metrics_only(spark, rows):
    df = frame(spark, {"status": "DEDUPED"}, {"status": None}, {"status": "NotStarted"}, {"status": "succeeded"})
    assert rows(R.classify_run_status(df), "metrics_state", "analysis_state") == [
        ("failure", "other"), ("in_progress", "in_progress"), ("other", "other"), ("success", "success")]
    assert R.failures_by_item(df).count() == 0


def test_durations_count_every_status_but_no_negative(spark):
    r = R.run_metrics(frame(spark, {"status": "Failed", "duration_seconds": 120.0}, {"duration_seconds": -5.0}, {"duration_seconds": None})).first()
    assert (r.avg_duration_min, r.min_duration_min, r.p50_duration_min, r.total_runs) == (2.0, 2.0, 2.0, 3)


def test_zero_durations_stay_zero(spark):
    r = R.run_metrics(frame(spark, {"duration_seconds": 0.0}, {"duration_seconds": 0.0})).first()
    assert (r.avg_duration_min, r.p95_duration_min, r.total_compute_hrs) == (0.0, 0.0, 0.0)


def test_item_without_valid_duration(spark):
    r = R.run_metrics(frame(spark, {"duration_seconds": None})).first()
    assert (r.avg_duration_min, r.p50_duration_min, r.total_compute_hrs, r.duration_trend, r.top_failure_reason) == (None, None, 0.0, "N/A", "")


@pytest.mark.parametrize("durations, label", [
    ((10, 10, 10), "N/A"), ((10, 10, 20, 20), "Degrading"), ((20, 20, 10, 10), "Improving"), ((10, 10, 11, 11), "Stable"),
    ((0, 0, 5, 5), "N/A"), ((10, 20, 20, 20, 20), "Degrading"), ((10, 10, -1, 20, 20), "Degrading"), ((-1, 10, 20, 20), "N/A")])
def test_trend(spark, durations, label):
    df = frame(spark, *hours(*map(float, durations)))
    assert R.run_metrics(df).first().duration_trend == label


def test_trend_orders_equal_starts_by_instance(spark):
    same = [{"start_time": T(2024, 1, 1), "duration_seconds": d} for d in (10.0, 10.0, 30.0, 30.0)]
    assert R.duration_trend(frame(spark, *same)).first().trend_change_pct == 200


def test_last_run_puts_missing_starts_last(spark):
    df = frame(spark, {"start_time": None, "status": "Running"}, {"start_time": T(2024, 1, 1), "status": "Failed"})
    r = R.last_run(df).first()
    assert (r.last_run_time, r.last_status) == (T(2024, 1, 1), "Failed")


def test_top_reason_tie_and_length(spark):
    long = "x" * 150
    df = frame(spark, {"failure_reason": "b"}, {"failure_reason": "a"}, {"item_id": "z", "failure_reason": long}, {"failure_reason": None})
    got = {r.item_id: r.top_failure_reason for r in R.top_failure_reason(df).collect()}
    assert got == {"a": "a", "z": long}
    assert [r.failure_reason for r in R.failure_reasons(df.replace("Completed", "failed", ["status"])).collect()][-1] == long


def test_null_item_keys_join_no_report(spark):
    df = frame(spark, {"item_id": None}, {"item_name": None}, {})
    assert R.run_metrics(df).count() == R.health(df).count() == R.execution_frequency(frame(spark, {"item_id": None}, {"item_id": None})).count() + 1


def test_weeks_of_different_years_stay_apart(spark, rows):
    df = frame(spark, {"start_time": T(2023, 1, 3)}, {"start_time": T(2024, 1, 2)}, {"start_time": T(2021, 1, 1)})
    assert rows(R.weekly_trend(df), "iso_year", "iso_week", "runs") == [(2020, 53, 1), (2023, 1, 1), (2024, 1, 1)]


def test_items_of_one_name_are_not_mixed(spark):
    df = frame(spark, {"item_id": "a"}, {"item_id": "b"}, {"item_id": "b"})
    assert [r.runs for r in R.weekly_trend(df, top=1).collect()] == [2]


def test_frequency(spark):
    def label(*starts):
        return [r.frequency for r in R.execution_frequency(frame(spark, *[{"start_time": s} for s in starts])).collect()]

    assert label(T(2024, 1, 1)) == []
    assert label(T(2024, 1, 1), None) == []
    assert label(T(2024, 1, 1), T(2024, 1, 1, 1)) == ["sub-hourly"]
    assert label(T(2024, 1, 1), T(2024, 1, 1, 1, 0, 1)) == ["daily"]
    assert label(T(2024, 1, 1), T(2024, 1, 8)) == ["weekly"]
    assert label(T(2024, 1, 1), T(2024, 1, 20)) == ["infrequent"]


def test_health_is_judged_at_one_decimal(spark):
    runs = [{} for _ in range(1899)] + [{"status": "Failed"} for _ in range(101)]
    assert R.health(frame(spark, *runs)).first().health == "Healthy"  # 94.95 shows as 95.0


def test_compute_efficiency(spark):
    df = frame(spark, {"duration_seconds": 60.0}, {"duration_seconds": 180.0}, {"status": "Failed", "duration_seconds": 60.0},
               {"status": "Deduped", "duration_seconds": 60.0}, {"item_id": "p", "item_type": "DataPipeline"})
    [r] = R.compute_efficiency(df).collect()
    assert (r.failed_runs, r.wasted_compute_min, r.consistency_pct) == (1, 1.0, 100.0)
    assert r.compute_efficiency_pct == pytest.approx(240 / 360 * 100)
    one = R.compute_efficiency(frame(spark, {"status": "Failed", "duration_seconds": 0.0})).first()
    assert (one.compute_efficiency_pct, one.consistency_pct, one.estimated_efficiency_pct) == (0.0, 100.0, 30.0)


def test_top_n_per_group_moves_few_rows(spark):
    df = R.top_n_per_group(spark.range(1000).selectExpr("id % 2 as g", "id"), ["g"], ["id"], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 6


def test_reports_are_sorted(spark):
    df = frame(spark, {"item_id": "ok"}, {"item_id": "bad", "status": "Failed"}, {"item_id": "busy", "status": "Failed"}, {"item_id": "busy", "status": "Failed"})
    assert [r.item_id for r in R.sort_efficiency_report(df).collect()] == ["busy", "bad", "ok"]
    assert R.round_report(R.run_metrics(df)).columns == R.run_metrics(df).columns


def test_empty_history(spark):
    df = frame(spark).limit(0)
    assert R.run_metrics(df).count() == 0
    s = R.overall_run_summary(df).first()
    assert (s.items, s.total_runs, s.success_rate_pct, s.total_compute_hrs) == (0, 0, 0.0, 0.0)
    assert R.invoke_pivot(df, ["Manual"]).columns == ["item_type", "item_name", "Manual", "other"]
