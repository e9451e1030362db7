"""Warehouse diagnostics: query log, statistics, locks, row groups, schema rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators.runs import top_n_per_group
from lakeops.operators.skew import exact_quantiles
from lakeops.session import cut_lineage


def cold_cache_queries(log: DataFrame, threshold_mb: float = K.COLD_CACHE_MB, top: int = 20) -> DataFrame:
    """Statements reading much from remote storage, the heaviest ``top`` per warehouse."""
    heavy = log.where(F.col("data_scanned_remote_storage_mb") > threshold_mb).withColumn(
        "duration_sec", F.col("duration_ms") / 1000.0)
    order = [F.desc("data_scanned_remote_storage_mb"), F.col("statement_id")]
    return top_n_per_group(heavy, ["warehouse_name"], order, top)


def query_patterns(log: DataFrame) -> DataFrame:
    """Per warehouse and query hash: executions, median and longest run, last start."""
    keys = ["warehouse_name", "query_hash"]
    stats = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("execution_count"), F.max("duration_ms").alias("max_duration_ms"),
        F.max("start_time").alias("last_execution"))
    median = exact_quantiles(log, keys, "duration_ms", {"median_duration_ms": 0.5})
    return stats.join(median, keys, "left").withColumns({
        "median_duration_sec": F.col("median_duration_ms") / 1000.0,
        "max_duration_sec": F.col("max_duration_ms") / 1000.0,
    })


def _told(patterns: DataFrame, log: DataFrame) -> DataFrame:
    """The picked patterns with the text of their newest statement and their median row count, where the log has these.

    Only statements of picked patterns are looked at again; a text is read once per pattern, not carried by all.
    """
    keys = ["warehouse_name", "query_hash"]
    patterns = cut_lineage(patterns, "patterns")  # a few rows per warehouse, found once
    own = log.join(patterns.select(*keys), keys, "left_semi")
    if "query_text" in log.columns:
        newest = own.groupBy(*keys).agg(F.max_by("query_text", F.struct("start_time", "statement_id")).alias("query_text"))
        patterns = patterns.join(newest, keys, "left")
    if "row_count" in log.columns:
        patterns = patterns.join(exact_quantiles(own, keys, "row_count", {"median_row_count": 0.5}), keys, "left")
    return patterns


def long_running_queries(log: DataFrame, threshold_sec: float = K.LONG_QUERY_SECONDS, top: int = 20) -> DataFrame:
    """Slowest patterns per warehouse by median, flagged above the threshold."""
    slow = top_n_per_group(query_patterns(log), ["warehouse_name"], [F.desc("median_duration_ms"), F.col("query_hash")], top)
    return _told(slow, log).withColumn("is_long", F.col("median_duration_sec") > threshold_sec)


def frequent_queries(log: DataFrame, top: int = 20) -> DataFrame:
    """Most executed patterns per warehouse."""
    return _told(top_n_per_group(query_patterns(log), ["warehouse_name"], [F.desc("execution_count"), F.col("query_hash")], top), log)


def top_n_remote_sql(table: str, columns: list[str], where: str, order_by: str, n: int, dialect: str = "ansi") -> str:
    """Subquery text that filters, sorts and cuts at the remote side.

    ``tsql`` writes TOP, ``fetch`` writes FETCH FIRST, ``ansi`` writes LIMIT.
    """
    head = f"TOP {int(n)} " if dialect == "tsql" else ""
    tail = {"tsql": "", "fetch": f" FETCH FIRST {int(n)} ROWS ONLY", "ansi": f" LIMIT {int(n)}"}[dialect]
    return f"SELECT {head}{', '.join(columns)} FROM {table} WHERE {where} ORDER BY {order_by}{tail}"


# -- statistics -------------------------------------------------------------------

def stats_properties(stats: DataFrame, tables: DataFrame) -> DataFrame:
    """Statistics with the properties of their table (one row per schema and table in ``tables``)."""
    return stats.join(tables, ["schema_name", "table_name"])


def with_staleness(stats: DataFrame) -> DataFrame:
    share = F.col("modification_counter") / F.greatest(F.col("row_cnt"), F.lit(1)).cast("double") * 100
    return stats.where(F.col("modification_counter") > 0).withColumn("stale_pct", share).withColumn(
        "very_stale", F.col("stale_pct") > 20)


def stale_statistics(stats: DataFrame) -> DataFrame:
    """Per schema: statistics objects, those with changes since their update, and those over 20 % stale."""
    share = F.col("modification_counter") / F.greatest(F.col("row_cnt"), F.lit(1)).cast("double") * 100
    changed = F.col("modification_counter") > 0
    return stats.groupBy("schema_name").agg(
        F.count(F.lit(1)).alias("total_stats"), F.count_if(changed).alias("with_modifications"),
        F.count_if(changed & (share > 20)).alias("very_stale"),
        F.max(F.when(changed, share)).alias("max_stale_pct"))


def sort_catalog(stats: DataFrame) -> DataFrame:
    """Most modified first, then the one updated longest ago (where that is known), then by schema, table and name."""
    age = ["last_updated"] if "last_updated" in stats.columns else []
    return stats.orderBy(F.desc("modification_counter"), *age, "schema_name", "table_name", "stats_name")


# -- locks ------------------------------------------------------------------------

def lock_summary(locks: DataFrame, tables: DataFrame, object_type: str = "OBJECT") -> DataFrame:
    """Locks per mode, status, session and table; only object locks can name a table.

    Locks are counted per entity before the name lookup, so a much-locked table joins as one row.
    """
    keys = ["resource_type", "request_mode", "request_status", "session_id"]
    entity = F.when(F.col("resource_type") == object_type, F.col("entity_id"))
    counted = locks.groupBy(*keys, entity.alias("entity_id")).agg(F.count(F.lit(1)).alias("_n"))
    named = counted.join(tables.select("entity_id", "table_name"), "entity_id", "left")
    return named.groupBy(*keys, "table_name").agg(F.sum("_n").alias("lock_count"))


def blocked_locks(locks: DataFrame, by: list[str]) -> DataFrame:
    waiting = F.col("request_status") == "WAIT"
    return locks.groupBy(*by).agg(F.count(F.lit(1)).alias("locks"), F.count_if(waiting).alias("blocked"))


# -- row groups and row counts ------------------------------------------------------

TABLE = ["schema_name", "table_name"]


def rowgroup_health(stats: DataFrame, small_rows: int = K.SMALL_GROUP_ROWS) -> DataFrame:
    """Row-group sizes per table, most fragmented first; tables without rows are left out."""
    rows = F.col("row_count")
    return stats.groupBy(*TABLE).agg(
        F.count_distinct("partition_number").alias("partition_count"), F.sum(rows).alias("total_rows"),
        F.count("partition_number").alias("total_row_groups"), F.count_if(rows < small_rows).alias("small_row_groups"),
        (F.sum(rows).cast("double") / F.count(rows).cast("double")).alias("avg_rows_per_group"),
        F.min(rows).alias("min_rows_in_group"), F.max(rows).alias("max_rows_in_group"),
    ).where(F.col("total_rows") > 0).withColumn(
        "small_pct", S.pct("small_row_groups", "total_row_groups")).orderBy(F.desc("small_row_groups"), *TABLE)


def table_row_counts(stats: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows per known table from its heap or clustered partitions (``index_id`` 0 or 1)."""
    totals = stats.where(F.col("index_id").isin(0, 1)).groupBy(*TABLE).agg(F.sum("row_count").alias("row_count"))
    return tables.join(totals, TABLE)


def maintenance_flags(items: DataFrame) -> DataFrame:
    """Display flags from the nested ``config``; warehouses maintain themselves, lakehouses only when configured."""
    cfg = F.col("config")
    # an empty object counts as no configuration
    empty = reduce(lambda a, b: a & b, [cfg[f].isNull() for f in items.schema["config"].dataType.fieldNames()])

    def on(flag: Column) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), "ON").otherwise("OFF")

    def flag(lakehouse: Column) -> Column:
        return F.when(F.col("item_type") == "Warehouse", "ON (Auto)").when(
            F.col("item_type") == "Lakehouse", lakehouse).otherwise("Unknown")

    def part(name: str) -> Column:
        return F.when(empty, "Unknown").otherwise(on(cfg[name]["enabled"]))

    keep = F.coalesce(cfg["unreferencedFileRetention"]["enabled"], F.lit(False)) & (F.col("item_type") == "Lakehouse")
    period = F.coalesce(cfg["unreferencedFileRetention"]["retentionPeriod"], F.lit("P7D"))
    return items.select(
        "item_id", "item_name", "item_type",
        flag(F.when(empty, "OFF").otherwise(on(cfg["enabled"]))).alias("maintenance_enabled"),
        F.when(keep, S.iso_duration_days(period)).alias("retention_period_days"),
        flag(part("vOrderOptimization")).alias("vorder_enabled"),
        flag(part("fileCompaction")).alias("compaction_enabled"))


def table_metrics_report(metrics: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Table row counts with the maintenance settings of their item."""
    settings = maintenance.select("item_id", "maintenance_enabled", "retention_period_days", "vorder_enabled", "compaction_enabled")
    return metrics.join(settings, "item_id", "left").select(
        "item_id", "item_type", "item_name", *TABLE, "row_count", "maintenance_enabled",
        S.retention_label("retention_period_days").alias("retention_days_display"), "vorder_enabled", "compaction_enabled")


def item_summary(report: DataFrame) -> DataFrame:
    """Tables and rows per item, by maintenance state."""
    keys = ["item_type", "item_name", "maintenance_enabled", "retention_days_display"]
    return report.dropna(subset=keys).groupBy(*keys).agg(
        F.count("table_name").alias("table_count"), F.sum("row_count").alias("total_rows"))


# -- recommendations -----------------------------------------------------------------

def one_check(df: DataFrame, area: str, priority: str, measure: Column) -> DataFrame:
    """One row with the count a check found."""
    return df.agg(measure.cast("bigint").alias("findings")).select(
        F.lit(area).alias("area"), F.lit(priority).alias("priority"), "findings")


def union_recommendations(checks: list[DataFrame]) -> DataFrame:
    """Rows of the checks that found something."""
    return reduce(DataFrame.unionByName, checks).where(F.col("findings") > 0)


def prioritize_recommendations(recs: DataFrame) -> DataFrame:
    """Critical, High, Medium, Info, then anything else."""
    return recs.withColumn("severity_rank", S.severity_rank("priority")).orderBy("severity_rank", "area")


def warehouse_checks(log: DataFrame, stats: DataFrame, schema_issues: DataFrame, groups: DataFrame, locks: DataFrame,
                     deleted: DataFrame, cold_mb: float = K.COLD_CACHE_MB, long_sec: float = K.LONG_QUERY_SECONDS,
                     small_rows: int = K.SMALL_GROUP_ROWS) -> list[DataFrame]:
    """The seven checks of the warehouse report, each a one-row aggregate."""
    n = F.count(F.lit(1))
    slow = query_patterns(log).where(F.col("median_duration_sec") > long_sec)
    size = F.coalesce(F.sum("size_bytes"), F.lit(0))
    soft = deleted.agg(n.alias("findings"), size.alias("_bytes")).select(
        F.lit("Soft Delete").alias("area"),
        F.when(F.col("_bytes") > K.GIB, "High").otherwise("Info").alias("priority"), "findings")
    return [
        one_check(log.where(F.col("data_scanned_remote_storage_mb") > cold_mb), "Cold Cache", "Medium", n),
        one_check(slow, "Query Performance", "High", n),
        one_check(stats.where(F.col("modification_counter") > 0), "Statistics", "Medium", n),
        one_check(schema_issues.where(F.col("severity") == "High"), "Data Types", "High", n),
        one_check(rowgroup_health(groups, small_rows).where(F.col("small_row_groups") > 0), "Compaction", "Medium", n),
        one_check(locks.where(F.col("request_status") == "WAIT"), "Locking", "Critical", n),
        soft,
    ]


def recommend_warehouse(checks: list[DataFrame], cold_mb: float = K.COLD_CACHE_MB, long_sec: float = K.LONG_QUERY_SECONDS,
                        string_limit: int = K.STRING_LIMIT) -> DataFrame:
    """Firing checks, most urgent first, with what was measured and the limit that ``findings`` objects exceed."""
    limits = {
        "Cold Cache": ("remote MB of a statement", cold_mb),
        "Query Performance": ("median seconds of a pattern", long_sec),
        "Statistics": ("changed rows of a statistic", 0),
        "Data Types": ("length of a text column", string_limit),
        "Compaction": ("small row groups of a table", 0),
        "Locking": ("waiting requests of a lock", 0),
        "Soft Delete": ("deleted files", 0),
    }
    ranked = prioritize_recommendations(union_recommendations(checks))
    measure = S.lookup("area", {area: what for area, (what, _) in limits.items()})
    limit = S.lookup("area", {area: float(at) for area, (_, at) in limits.items()})
    shown = S.lookup("area", {area: f"{what} above {at:g}" for area, (what, at) in limits.items()})
    return ranked.withColumns({
        "measure": measure, "threshold": limit,
        "recommendation": F.concat_ws(": ", "area", F.concat_ws(" x ", F.col("findings").cast("string"), shown)),
    })
