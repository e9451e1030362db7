"""Warehouse diagnostics, contracts, profiles and schema rules."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import scalars as S
from lakeops.operators import diagnostics as D
from lakeops.operators import drift
from lakeops.operators import profiles as P
from lakeops.operators import quality as Q
from lakeops.plans.lake import SCHEMAS
from lakeops.plans.registry import query
from lakeops.session import scratch_path, small_frame
from lakeops.plans.run_queries import SQL_TS, dsum, quantile, with_ts

PATTERNS = f"""
patterns as (
 select warehouse_name, query_hash, count(*) as execution_count, max(duration_ms) as max_duration_ms, max(start_time) as last_execution,
  {quantile('duration_ms', 0.5)} as median_duration_ms from fx_query_log group by all),
timed as (select *, median_duration_ms / 1000.0::double as median_duration_sec, max_duration_ms / 1000.0::double as max_duration_sec from patterns)"""


@query("cold_cache_queries", f"""
select warehouse_name, query_hash, statement_id, {SQL_TS.format('start_time')} as start_time, data_scanned_remote_storage_mb, duration_ms,
 status, duration_ms / 1000.0::double as duration_sec, cast(rk as int) as rank
from (select *, row_number() over (partition by warehouse_name order by data_scanned_remote_storage_mb desc, statement_id) as rk
 from fx_query_log where data_scanned_remote_storage_mb > 100) where rk <= 20""")
def _(lake):
    return with_ts(D.cold_cache_queries(lake.fx("query_log")), "start_time")


def _pattern_sql(order: str, extra: str = "") -> str:
    told = f"""{PATTERNS.replace('fx_query_log', 'fx_request_history')},
told as (select warehouse_name, query_hash, first(query_text order by start_time desc, statement_id desc) as query_text,
 {quantile('row_count', 0.5)} as median_row_count from fx_request_history group by all)"""
    return f"""
with {told}
select warehouse_name, query_hash, query_text, execution_count, max_duration_ms, {SQL_TS.format('last_execution')} as last_execution,
 median_duration_ms, median_duration_sec, max_duration_sec, median_row_count, cast(rk as int) as rank{extra}
from (select *, row_number() over (partition by warehouse_name order by {order} desc, query_hash) as rk from timed)
join told using (warehouse_name, query_hash) where rk <= 20"""


@query("long_running_queries", _pattern_sql("median_duration_ms", ", median_duration_sec > 30 as is_long"))
def _(lake):
    return with_ts(D.long_running_queries(lake.fx("request_history"), threshold_sec=30), "last_execution")


@query("frequent_queries", _pattern_sql("execution_count"))
def _(lake):
    return with_ts(D.frequent_queries(lake.fx("request_history")), "last_execution")


@query("top_n_remote", """
select query_hash, statement_id, duration_ms from fx_query_log where data_scanned_remote_storage_mb > 100
order by data_scanned_remote_storage_mb desc, statement_id limit 20""")
def _(lake):
    # the subquery text a remote endpoint would get, here run by the session's own catalog
    lake.fx("query_log").createOrReplaceTempView("request_history")
    return lake.spark.sql(D.top_n_remote_sql(
        "request_history", ["query_hash", "statement_id", "duration_ms"], "data_scanned_remote_storage_mb > 100",
        "data_scanned_remote_storage_mb DESC, statement_id", 20))


TABLE_ROWS = "tabs as (select p_type as schema_name, p_brand as table_name, cast(sum(p_size) as bigint) as table_rows, max(p_partkey) as last_key from part group by all)"


def _tables(lake):
    return lake.table("part").groupBy(F.col("p_type").alias("schema_name"), F.col("p_brand").alias("table_name")).agg(
        F.sum("p_size").alias("table_rows"), F.max("p_partkey").alias("last_key"))


@query("stats_properties", f"with {TABLE_ROWS} select * from fx_stats join tabs using (schema_name, table_name)")
def _(lake):
    return D.stats_properties(lake.fx("stats"), _tables(lake))


SHARE = "cast(modification_counter as double) / cast(greatest(row_cnt, 1) as double) * 100"


@query("stale_statistics", f"""
select schema_name, count(*) as total_stats, count(*) filter (modification_counter > 0) as with_modifications,
 count(*) filter (modification_counter > 0 and {SHARE} > 20) as very_stale, max({SHARE}) filter (modification_counter > 0) as max_stale_pct
from fx_stats group by schema_name""")
def _(lake):
    return D.stale_statistics(lake.fx("stats"))


@query("sort_catalog", "select * from fx_stats order by modification_counter desc, last_updated, schema_name, table_name, stats_name")
def _(lake):
    return D.sort_catalog(lake.fx("stats"))


@query("lock_summary", """
select resource_type, request_mode, request_status, session_id, c_name as table_name, count(*) as lock_count
from fx_locks left join customer on entity_id = c_custkey and resource_type = '1-URGENT' group by all""")
def _(lake):
    tables = lake.table("customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("table_name"))
    return D.lock_summary(lake.fx("locks"), tables, object_type="1-URGENT")


@query("blocked_locks", """
select resource_type, count(*) as locks, count(*) filter (request_status = 'WAIT') as blocked from fx_locks group by resource_type""")
def _(lake):
    return D.blocked_locks(lake.fx("locks"), ["resource_type"])


GROUPS = """
health as (
 select schema_name, table_name, count(distinct partition_number) as partition_count, cast(sum(row_count) as bigint) as total_rows,
  count(partition_number) as total_row_groups, count(*) filter (row_count < 100) as small_row_groups,
  cast(sum(row_count) as double) / cast(count(row_count) as double) as avg_rows_per_group, min(row_count) as min_rows_in_group,
  max(row_count) as max_rows_in_group from fx_partition_stats group by all having sum(row_count) > 0)"""


@query("rowgroup_health", f"""
with {GROUPS} select *, cast(small_row_groups as double) / cast(total_row_groups as double) * 100 as small_pct from health""")
def _(lake):
    return D.rowgroup_health(lake.fx("partition_stats"), small_rows=100)


@query("table_row_counts", """
select schema_name, table_name, cast(sum(row_count) as bigint) as row_count from fx_partition_stats
where partition_number % 3 in (0, 1) group by all""")
def _(lake):
    stats = lake.fx("partition_stats").withColumn("index_id", F.col("partition_number") % 3)
    tables = lake.table("lineitem").select(
        F.col("l_returnflag").alias("schema_name"), F.concat("l_returnflag", "l_linestatus").alias("table_name")).distinct()
    return D.table_row_counts(stats, tables)


#: item settings derived from workspaces: every fifth has no configuration
SETTINGS = """
settings as (
 select workspace_id as item_id, workspace_name as item_name,
  case when workspace_id % 3 = 0 then 'Warehouse' when workspace_id % 3 = 1 then 'Lakehouse' else 'KQLDatabase' end as item_type,
  workspace_id as w from fx_workspaces),
maintenance as (
 select item_id, item_name, item_type,
  case item_type when 'Warehouse' then 'ON (Auto)' when 'Lakehouse' then case when w % 5 <> 0 and w % 2 = 0 then 'ON' else 'OFF' end
   else 'Unknown' end as maintenance_enabled,
  cast(case when item_type = 'Lakehouse' and w % 5 <> 0 and w % 2 = 1 then case when w % 7 = 0 then 7 else w % 30 end end as double) as retention_period_days,
  case item_type when 'Warehouse' then 'ON (Auto)' when 'Lakehouse' then case when w % 5 = 0 then 'Unknown' when w % 3 = 1 then 'ON' else 'OFF' end
   else 'Unknown' end as vorder_enabled,
  case item_type when 'Warehouse' then 'ON (Auto)' when 'Lakehouse' then case when w % 5 = 0 then 'Unknown' when w % 4 = 1 then 'ON' else 'OFF' end
   else 'Unknown' end as compaction_enabled from settings)"""


def settings(lake):
    w = F.col("workspace_id")
    cfg = F.struct(
        (w % 2 == 0).alias("enabled"),
        F.struct((w % 3 == 1).alias("enabled")).alias("vOrderOptimization"),
        F.struct((w % 2 == 1).alias("enabled"), F.when(w % 7 != 0, F.concat(F.lit("P"), w % 30, F.lit("D"))).alias("retentionPeriod"))
        .alias("unreferencedFileRetention"),
        F.when(w % 4 != 0, F.struct((w % 4 == 1).alias("enabled"))).alias("fileCompaction"))
    return lake.fx("workspaces").select(
        w.alias("item_id"), F.col("workspace_name").alias("item_name"),
        F.when(w % 3 == 0, "Warehouse").when(w % 3 == 1, "Lakehouse").otherwise("KQLDatabase").alias("item_type"),
        F.when(w % 5 != 0, cfg).alias("config"))


METRICS = """
metrics as (
 select schema_name, concat(table_name, '_', partition_number) as table_name, row_count, item_id, item_name, item_type
 from fx_partition_stats join settings on item_id = partition_number % (select count(*) from supplier)),
report as (
 select item_id, m.item_type, m.item_name, schema_name, table_name, row_count, maintenance_enabled,
  case when retention_period_days is not null then concat(cast(retention_period_days as int), ' days') else 'N/A (Auto-managed)' end as retention_days_display,
  vorder_enabled, compaction_enabled from metrics m left join maintenance using (item_id))"""


def _report(lake):
    items = settings(lake)
    n = lake.table("supplier").agg(F.count(F.lit(1))).scalar()
    metrics = lake.fx("partition_stats").select(
        "schema_name", F.concat_ws("_", "table_name", "partition_number").alias("table_name"), "row_count",
        (F.col("partition_number") % n).cast("bigint").alias("item_id")).join(items.drop("config"), "item_id")
    return D.table_metrics_report(metrics, D.maintenance_flags(items))


@query("table_metrics_report", f"with {SETTINGS}, {METRICS} select * from report")
def _(lake):
    return _report(lake)


@query("item_summary", f"""
with {SETTINGS}, {METRICS}
select item_type, item_name, maintenance_enabled, retention_days_display, count(table_name) as table_count, cast(sum(row_count) as bigint) as total_rows
from report group by item_type, item_name, maintenance_enabled, retention_days_display""")
def _(lake):
    return D.item_summary(_report(lake))


# -- schema and contracts ----------------------------------------------------------

#: tables whose columns are profiled in one go; the stored profiles below cover all
PROFILED = ("customer", "documents", "part")
#: how a warehouse would declare their columns
DECLARED = {
    "customer": "c_custkey decimal(18,0), c_name varchar(25), c_nationkey decimal(10,0), c_acctbal decimal(15,2), c_mktsegment char(10)",
    "documents": "doc_id decimal(18,0), text varchar(65535), lang varchar(8), source varchar(64), n_chars decimal(18,0)",
    "part": "p_partkey decimal(18,0), p_name varchar(55), p_brand char(10), p_type varchar(25), p_size decimal(10,0), p_retailprice decimal(18,2)",
}


def profile_sql(tables) -> str:
    parts = []
    for t in tables:
        for i, (c, kind) in enumerate((d.split(" ", 1) for d in SCHEMAS[t].split(", ")), 1):
            shown = f"cast({c} as decimal(38,6))" if kind == "double" else c
            text = f"cast({shown} as varchar)"
            length, least, most = f"length({text})", f"cast(min({shown}) as varchar)", f"cast(max({shown}) as varchar)"
            if kind.startswith("array"):
                length, least, most = f"len({c})", "cast(null as varchar)", "cast(null as varchar)"
            parts.append(f"""
select '{t}' as table_name, '{c}' as column_name, cast({i} as int) as ordinal, count(*) as row_count, count(*) - count({c}) as null_count,
 count(distinct {c}) as distinct_count, cast(min({length}) as int) as min_length, cast(max({length}) as int) as max_length,
 {least} as min_value, {most} as max_value,
 cast(count(*) - count({c}) as double) / cast(count(*) as double) * 100 as null_pct from {t}""")
    return " union all ".join(parts)


def _profile(lake, tables):
    return P.union_all([P.column_profile(t, lake.table(t)) for t in tables])


@query("column_profile", profile_sql(["customer", "documents"]))
def _(lake):
    return _profile(lake, ["customer", "documents"])


@query("column_profile_stored", profile_sql(SCHEMAS))
def _(lake):
    store, spark = scratch_path(lake.spark, "profiles"), lake.spark

    def one(t):
        path, schema = f"{lake.root}/{t}.parquet", T.StructType.fromDDL(SCHEMAS[t])
        # the second run finds every file profiled
        if P.refresh(spark, path, f"{store}/{t}", schema) and P.refresh(spark, path, f"{store}/{t}", schema):
            raise RuntimeError(f"files of {t} were profiled twice")
        return P.stored_profile(spark, t, path, f"{store}/{t}", schema)

    with ThreadPoolExecutor(4) as side_by_side:  # tables do not wait for each other's small jobs
        return P.union_all(list(side_by_side.map(one, SCHEMAS)))


_DECLARED_SQL = ", ".join(
    f"('{c}', '{kind.partition('(')[0]}', {kind.startswith('decimal(18,0)')})" for ddl in DECLARED.values() for c, kind in (d.split(" ", 1) for d in ddl.split(", ")))
#: column frame of the audit: columns whose values repeat stand for nullable ones
AUDIT = f"""
cols as (
 select table_name, column_name, data_type, wide_whole, max_length, distinct_count < row_count as is_nullable
 from ({profile_sql(PROFILED)}) join (values {_DECLARED_SQL}) as declared(column_name, data_type, wide_whole) using (column_name)),
issues as (
 select table_name, column_name, 'oversized string' as issue, 'High' as severity from cols where data_type = 'varchar' and max_length > 4000
 union all select table_name, column_name, 'decimal(18,0)', 'Medium' from cols where wide_whole
 union all select table_name, column_name, 'long fixed-length text', 'Medium' from cols where data_type = 'char' and max_length > 8
 union all select table_name, '(multiple)', 'mostly nullable', 'Medium' from cols group by table_name
  having cast(count(*) filter (is_nullable) as double) / count(*) * 100 > 60)"""


def _issues(lake):
    declared = small_frame(
        lake.spark, [r for t, ddl in DECLARED.items() for r in Q.declared_columns(t, T.StructType.fromDDL(ddl))], Q.DECLARED_COLUMNS)
    cols = _profile(lake, PROFILED).select("table_name", "column_name", "max_length", (F.col("distinct_count") < F.col("row_count")).alias("is_nullable"))
    return Q.schema_audit(cols.join(declared, ["table_name", "column_name"]), ["table_name"], char_limit=8, nullable_pct=60)


@query("schema_audit", f"with {AUDIT} select * from issues")
def _(lake):
    return _issues(lake)


CHECKS = f"""
{PATTERNS}, {AUDIT}, {GROUPS},
checks as (
 select 'Cold Cache' as area, 'Medium' as priority, count(*) as findings from fx_query_log where data_scanned_remote_storage_mb > 100
 union all select 'Query Performance', 'High', count(*) from timed where median_duration_sec > 30
 union all select 'Statistics', 'Medium', count(*) from fx_stats where modification_counter > 0
 union all select 'Data Types', 'High', count(*) from issues where severity = 'High'
 union all select 'Compaction', 'Medium', count(*) from health where small_row_groups > 0
 union all select 'Locking', 'Critical', count(*) from fx_locks where request_status = 'WAIT'
 union all select 'Soft Delete', case when sum(size_bytes) > 1073741824 then 'High' else 'Info' end, count(*) from fx_files where is_deleted)"""
RANK = "cast(case priority when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 when 'Info' then 3 else 99 end as int)"


def _checks(lake):
    return D.warehouse_checks(
        lake.fx("query_log"), lake.fx("stats"), _issues(lake), lake.fx("partition_stats"), lake.fx("locks"),
        lake.fx("files").where("is_deleted"), long_sec=30, small_rows=100)


@query("union_recommendations", f"with {CHECKS} select * from checks where findings > 0")
def _(lake):
    return D.union_recommendations(_checks(lake))


@query("prioritize_recommendations", f"with {CHECKS} select *, {RANK} as severity_rank from checks where findings > 0")
def _(lake):
    return D.prioritize_recommendations(D.union_recommendations(_checks(lake)))


@query("recommend_warehouse", f"""
with {CHECKS}, limits(area, measure, threshold) as (values
 ('Cold Cache', 'remote MB of a statement', 100), ('Query Performance', 'median seconds of a pattern', 30),
 ('Statistics', 'changed rows of a statistic', 0), ('Data Types', 'length of a text column', 4000),
 ('Compaction', 'small row groups of a table', 0), ('Locking', 'waiting requests of a lock', 0), ('Soft Delete', 'deleted files', 0))
select checks.*, {RANK} as severity_rank, measure, cast(threshold as double) as threshold,
 concat(checks.area, ': ', findings, ' x ', measure, ' above ', threshold) as recommendation
from checks join limits using (area) where findings > 0""")
def _(lake):
    return D.recommend_warehouse(_checks(lake), long_sec=30)


@query("severity_rank", f"select event_type, count(*) as n, {RANK} as severity_rank from (select event_type, case event_type when 'error' then 'Critical' when 'click' then 'Info' else event_type end as priority from events) group by all")
def _(lake):
    p = F.when(F.col("event_type") == "error", "Critical").when(F.col("event_type") == "click", "Info").otherwise(F.col("event_type"))
    return lake.table("events").groupBy("event_type", S.severity_rank(p).alias("severity_rank")).agg(F.count(F.lit(1)).alias("n"))


CATALOGUED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
              "pages", "benchmark", "labels", "conversations")


@query("column_catalog", f"""
select c.table_name, column_name, cast(ordinal_position as int) as ordinal, table_rows,
 case data_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double' when 'VARCHAR' then 'string'
  when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' else data_type end as data_type
from information_schema.columns c join ({' union all '.join(f"select '{t}' as table_name, count(*) as table_rows from {t}" for t in CATALOGUED)}) r
on c.table_name = r.table_name""")
def _(lake):
    return Q.column_catalog(lake.spark, {t: lake.raw(t) for t in CATALOGUED})


#: what the orders table promises; the deliberate misses make the checks fire
CONTRACT = Q.Contract(
    table="fact_orders",
    columns=(
        Q.ColumnRule("o_orderkey", "bigint", nullable=False, pk=True),
        Q.ColumnRule("o_custkey", "bigint", nullable=False, fk=("customer", "c_custkey")),
        Q.ColumnRule("o_totalprice", "decimal(18,2)", nullable=False, range=(0, 400000)),
        Q.ColumnRule("o_orderdate", "timestamp", nullable=False),
        Q.ColumnRule("parent_order", "bigint", nullable=False),
        Q.ColumnRule("o_channel", "string"),
    ),
    row_count_min=1000, completeness_pct=99.5, freshness_hours=6, freshness_column="o_orderdate",
    unique=(("o_custkey", "o_orderdate"),))


def _orders(lake, own_schema=False):
    """Orders with a sometimes missing parent; with ``own_schema`` as the files declare them."""
    k = F.col("o_orderkey")
    orders = lake.raw("orders") if own_schema else lake.table("orders")
    return orders.withColumn("parent_order", F.when(k % 9 != 0, F.floor(k / 9).cast("bigint")))


ORDERS = "o as (select *, case when o_orderkey % 9 <> 0 then cast(floor(o_orderkey / 9) as bigint) end as parent_order from orders)"


@query("contract_schema_drift", f"""
with {ORDERS}
select 'o_channel' as column_name, 'missing column' as kind, 'string' as expected, cast(null as varchar) as actual
union all select 'o_totalprice', 'type drift', 'decimal(18,2)', 'double'
union all select 'parent_order', 'nullability drift', 'NOT NULL', concat(count(*), ' NULLs') from o where parent_order is null having count(*) > 0""")
def _(lake):
    return Q.contract_schema_drift(_orders(lake, own_schema=True), CONTRACT)


@query("contract_drift_by_file", """
select 'o_totalprice' as column_name, 'type drift' as kind, 'double' as expected, 'string' as actual, count(*) as rows from orders where o_orderkey % 3 = 1
union all select 'o_orderpriority', 'missing column', 'string', null, count(*) from orders where o_orderkey % 3 = 2
union all select 'o_channel', 'unknown column', null, 'string', count(*) from orders where o_orderkey % 3 = 2""")
def _(lake):
    path, orders = scratch_path(lake.spark, "drifting"), lake.table("orders")
    # three writers of one table: the second sends amounts as text, the third renames a column
    orders.where("o_orderkey % 3 = 0").write.parquet(path)
    orders.where("o_orderkey % 3 = 1").withColumn("o_totalprice", F.col("o_totalprice").cast("string")).write.mode("append").parquet(path)
    orders.where("o_orderkey % 3 = 2").withColumnRenamed("o_orderpriority", "o_channel").write.mode("append").parquet(path)
    declared = Q.Contract("orders", tuple(Q.ColumnRule(f.name, f.dataType.simpleString()) for f in orders.schema.fields))
    return drift.drift_summary(drift.drift_by_file(lake.spark, path, declared)).drop("files", "example")


_VALUE = Q.Contract(CONTRACT.table, tuple(c for c in CONTRACT.columns if c.name != "o_channel"), CONTRACT.row_count_min,
                    CONTRACT.completeness_pct, CONTRACT.freshness_hours, CONTRACT.freshness_column, CONTRACT.unique)
_complete = " union all ".join(
    f"""select 'completeness:{c}', case when count({c})::double / count(*)::double * 100 < 99.5 then count(*) - count({c}) else 0 end,
 count({c})::double / count(*)::double * 100 from o""" for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "parent_order"))


def _unique_sql(cols: str) -> str:
    return (f"select 'unique:{cols.replace(' ', '')}', cast(coalesce(sum(n - 1), 0) as bigint), count(*)::double "
            f"from (select {cols}, count(*) as n from o group by {cols})")


VALUE_CHECKS = f"""
{ORDERS},
raw(check_name, violations, measure) as (
 select 'row_count_min', greatest(1000 - count(*), 0), count(*)::double from o
 union all {_complete}
 union all select 'range:o_totalprice', count(*), count(*)::double from o where o_totalprice < 0 or o_totalprice > 400000
 union all select 'freshness', cast((epoch_us(timestamp '2001-08-01 00:00:00') - epoch_us(max(o_orderdate))) / 3.6e9::double > 6 as bigint),
  (epoch_us(timestamp '2001-08-01 00:00:00') - epoch_us(max(o_orderdate))) / 3.6e9::double from o
 union all {_unique_sql('o_orderkey')}
 union all {_unique_sql('o_custkey, o_orderdate')}
 union all select 'fk:o_custkey', count(*), count(distinct o_custkey)::double from o where o_custkey is not null
  and o_custkey not in (select c_custkey from customer)),
value_checks as (select *, violations = 0 as passed from raw)"""


def _value_checks(lake):
    return Q.contract_value_checks(_orders(lake), _VALUE, {"customer": lake.table("customer")},
                                   F.lit(dt.datetime(2001, 8, 1)))


@query("contract_value_checks", f"with {VALUE_CHECKS} select * from value_checks")
def _(lake):
    return _value_checks(lake)


@query("health_control_score", f"""
with {VALUE_CHECKS},
scored as (select string_split(check_name, ':')[1] as kind, count(*) as checks, sum(passed::int)::double / count(*)::double as score
 from value_checks group by all)
select *, case when score >= 0.8 then 'healthy' when score >= 0.6 then 'fair' else 'critical' end as status from scored""")
def _(lake):
    return Q.health_control_score(_value_checks(lake).withColumn("kind", F.substring_index("check_name", ":", 1)), ["kind"])


@query("apply_type_policy", """
select l_orderkey, l_linenumber, amount, ship_day, cast(null as varchar) as reasons from (
 select l_orderkey, l_linenumber, cast(cast(l_extendedprice as decimal(18,2)) as double) as amount, strftime(l_shipdate, '%Y-%m-%d') as ship_day
 from lineitem where l_linenumber <> 3 and l_orderkey % 10 <> 0)
union all
select l_orderkey, l_linenumber, cast(null as double), cast(null as varchar),
 concat_ws(', ', case when l_linenumber = 3 then 'type:amount' end, case when l_orderkey % 10 = 0 then 'null key:order_ref' end)
from lineitem where l_linenumber = 3 or l_orderkey % 10 = 0""")
def _(lake):
    # every bronze value arrives as text; line 3 carries a bad amount, every tenth order no reference
    bronze = lake.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 3, "n/a").otherwise(F.col("l_extendedprice").cast("string")).alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"),
        F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey").cast("string")).alias("order_ref"))
    silver, quarantine = Q.apply_type_policy(bronze, {"amount": "decimal(18,2)", "ship_day": "date", "order_ref": "bigint"}, ["order_ref"])
    ok = silver.select("l_orderkey", "l_linenumber", F.col("amount").cast("double").alias("amount"),
                       F.col("ship_day").cast("string").alias("ship_day"), F.lit(None).cast("string").alias("reasons"))
    bad = quarantine.select("l_orderkey", "l_linenumber", F.lit(None).cast("double").alias("amount"),
                            F.lit(None).cast("string").alias("ship_day"), "reasons")
    return ok.unionByName(bad)


@query("dictionary_gap", """
select file_id, 'remaining_days' as missing_attribute from fx_files where remaining_days is null
union all select file_id, 'extension' from fx_files where not contains(file_path, '.')""")
def _(lake):
    files = lake.fx("files").withColumn("extension", F.nullif(S.file_extension("file_path"), F.lit("unknown")))
    return Q.dictionary_gap(files, "file_id", ["file_path", "remaining_days", "extension"])


@query("cde_coverage", f"""
with dict as ({profile_sql(['customer', 'part'])}),
bound(element, dataset, column_name, real) as (values ('Customer Id', 'Customer', 'CCustKey', 'c_custkey'), ('Customer Id', 'Part', 'PPartKey', 'p_partkey'),
 ('Account Balance', 'Customer', 'CAcctBal', 'c_acctbal'), ('Fax Number', 'Customer', 'CFax', 'c_fax'))
select element, dataset, b.column_name, null_pct is not null as covered, null_pct
from bound b left join dict d on lower(b.dataset) = d.table_name and b.real = d.column_name""")
def _(lake):
    bound = [("Customer Id", [("Customer", "CCustKey"), ("Part", "PPartKey")]), ("Account Balance", [("Customer", "CAcctBal")]),
             ("Fax Number", [("Customer", "CFax")])]
    rows = [(e, [{"dataset": d, "column_name": c} for d, c in cols]) for e, cols in bound]
    elements = small_frame(lake.spark, rows, "element string, columns array<struct<dataset: string, column_name: string>>")
    return Q.cde_coverage(elements, _profile(lake, ["customer", "part"]), normalize_names=True)


@query("reconcile_tables", f"""
with side as (select l_returnflag, count(*) as n, {dsum('l_quantity', 4)} as q from lineitem group by all),
 other as (select l_returnflag, count(*) as n, {dsum('l_quantity', 4)} as q from lineitem where l_returnflag <> 'N' and not (l_returnflag = 'R' and l_linenumber = 7) group by all)
select l_returnflag, coalesce(a.n, 0) as rows_left, coalesce(b.n, 0) as rows_right, coalesce(a.q, 0.0) as l_quantity_left,
 coalesce(b.q, 0.0) as l_quantity_right, coalesce(b.n, 0) - coalesce(a.n, 0) as row_delta, coalesce(a.n = b.n and a.q = b.q, false) as matches
from side a full join other b using (l_returnflag)""")
def _(lake):
    left = lake.table("lineitem")
    copy = left.where((F.col("l_returnflag") != "N") & ~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7)))
    return Q.reconcile_tables(left, copy, ["l_returnflag"], ["l_quantity"])


@query("reconcile_rows", f"""
with other as (select * replace (case when l_orderkey % 997 = 5 then l_quantity + 1 else l_quantity end as l_quantity) from lineitem where l_orderkey % 1501 <> 7
 union all select * from lineitem where l_orderkey % 1999 = 11),
side as (select l_orderkey, count(*) as n, {dsum('l_quantity', 4)} as q from lineitem group by all),
twin as (select l_orderkey, count(*) as n, {dsum('l_quantity', 4)} as q from other group by all)
select l_orderkey, coalesce(a.n, 0) as rows_left, coalesce(b.n, 0) as rows_right, coalesce(a.q, 0.0) as l_quantity_left,
 coalesce(b.q, 0.0) as l_quantity_right, coalesce(b.n, 0) - coalesce(a.n, 0) as row_delta, false as matches
from side a full join twin b using (l_orderkey) where a.n is distinct from b.n or a.q is distinct from b.q""")
def _(lake):
    left, k = lake.table("lineitem"), F.col("l_orderkey")
    # a copy that lost some orders, changed others and repeated a few
    copy = left.where(k % 1501 != 7).withColumn("l_quantity", F.when(k % 997 == 5, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))).unionByName(
        left.where(k % 1999 == 11))
    return Q.reconcile_rows(left, copy, "l_orderkey", ["l_quantity"], leaf=4096)
