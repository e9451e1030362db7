"""Round trips through sources, sinks, nested JSON and streams.

Each query writes a derived table below the session's shared folder, runs the
operator on what was written, and must return the table's own rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeops.functions import scalars as S
from lakeops.operators import inventory as I
from lakeops.operators import normalize as N
from lakeops.operators import runs as R
from lakeops.operators import sales as G
from lakeops.plans.diagnostics_queries import SETTINGS, settings
from lakeops.operators.diagnostics import maintenance_flags
from lakeops.plans.governance_queries import STORED, accounts_pair
from lakeops.plans.inventory_queries import MOVABILITY, MOVABLE
from lakeops.plans.registry import query
from lakeops.plans.sales_queries import BOOKED, OPEN, TIER
from lakeops.plans.run_queries import FAILED_M, PER_ITEM, SQL_TS, SUCCESS, dsum, ts_text, with_ts
from lakeops.session import scratch_path
from lakeops.sources import keyed_table, readers, sinks
from lakeops.streaming import jobs


def _landed(df, tag: str, fmt: str = "json") -> str:
    path = scratch_path(df.sparkSession, tag)
    df.write.format(fmt).save(path)
    return path


@query("read_paged_json", "select item_id, item_name, workspace_id, item_type from fx_items")
def _(lake):
    items = lake.fx("items")
    # pages of at most 100 elements, under either container name, with every page landed twice
    pages = items.groupBy(F.floor(F.col("item_id") / 100).alias("page")).agg(F.collect_list(F.struct(*items.columns)).alias("v"))
    named = pages.select(F.when(F.col("page") % 2 == 0, F.col("v")).alias("value"), F.when(F.col("page") % 2 == 1, F.col("v")).alias("itemEntities"))
    path = _landed(named.unionAll(named), "pages")
    return readers.read_paged_json(lake.spark, path, "item_id bigint, item_name string, workspace_id bigint, item_type string",
                                   "item_id", ("value", "itemEntities"))


PARTS = "select schema_name, table_name, cast(partition_number as bigint) as partition_number, row_count from fx_partition_stats"


@query("read_first_available", f"select *, 'third' as source from ({PARTS})")
def _(lake):
    spark, path = lake.spark, _landed(lake.fx("partition_stats"), "third", "parquet")
    df, name = readers.read_first_available([
        ("first", lambda: spark.read.parquet(path + "-absent")),
        ("second", lambda: spark.read.parquet(path).select("created_date")),
        ("third", lambda: spark.read.parquet(path))])
    return df.withColumns({"source": F.lit(name), "partition_number": F.col("partition_number").cast("bigint")})


@query("read_tolerant", """
select case item_type when 'Report' then 'reports' when 'Notebook' then 'notebooks' else 'others' end as name, cast(null as varchar) as error,
 count(*) over (partition by case item_type when 'Report' then 'reports' when 'Notebook' then 'notebooks' else 'others' end) as rows, cast(item_id as varchar) as item_id from fx_items
union all select 'lost', 'PATH_NOT_FOUND', 0, null""")
def _(lake):
    items, spark = lake.fx("items"), lake.spark
    absent = scratch_path(spark, "absent")
    named = F.coalesce(F.col("item_type").isin("Report", "Notebook"), F.lit(False))
    data, status = readers.read_tolerant(spark, {
        "reports": lambda: items.where(F.col("item_type") == "Report"), "lost": lambda: spark.read.parquet(absent),
        "notebooks": lambda: items.where(F.col("item_type") == "Notebook"), "others": lambda: items.where(~named)})
    return status.join(data.select(F.col("source").alias("name"), F.col("item_id").cast("string").alias("item_id")), "name", "left")


@query("union_tagged", """
select statement_id, case warehouse_name when 'wh_0' then null else duration_ms end as duration_ms, warehouse_name as warehouse from fx_query_log""")
def _(lake):
    log = lake.fx("query_log")
    frames = {w: log.where(F.col("warehouse_name") == w).select("statement_id", "duration_ms") for w in (f"wh_{k}" for k in range(5))}
    frames["wh_0"] = frames["wh_0"].drop("duration_ms")
    return readers.union_tagged(frames, "warehouse")


@query("read_file_listing", "select distinct 'parquet' as ext, o_orderstatus, o_orderpriority, year(o_orderdate) as year, true as filled from orders")
def _(lake):
    root, parts = scratch_path(lake.spark, "by-folder"), ["o_orderstatus", "o_orderpriority", "year"]
    lake.table("orders").withColumn("year", F.year("o_orderdate")).write.partitionBy(*parts).parquet(root)
    files = readers.read_file_listing(lake.spark, root)
    named = [F.regexp_extract("file_path", f"/{c}=([^/]*)/", 1).alias(c) for c in parts]
    return files.groupBy(S.file_extension("file_path").alias("ext"), *named).agg((F.sum("size_bytes") > 0).alias("filled")).withColumn("year", F.col("year").cast("bigint"))


@query("read_csv_table", "select account_id, account_name, industry, country, annual_revenue_usd from fx_accounts")
def _(lake):
    path = scratch_path(lake.spark, "accounts")
    lake.fx("accounts").write.option("header", True).csv(path)
    return readers.read_csv_table(lake.spark, path, "account_id bigint, account_name string, industry string, country string, annual_revenue_usd double")


@query("write_table_overwrite", f"""
with {BOOKED}
select 'fact_pipeline_by_stage' as gold_table, stage as key, count(opportunity_id) as n, {dsum('amount', 4)} as amount from fx_opportunities
where {OPEN} group by stage
union all select 'fact_revenue_by_quarter', quarter, count(*), {dsum('amount', 4)} from fx_fact_sales group by quarter
union all select 'dim_account', revenue_tier, count(*), {dsum('annual_revenue_usd', 2)} from (select *, {TIER} as revenue_tier from fx_accounts) group by revenue_tier
union all select 'dim_sales_rep', segment, count(*), cast(sum(date_diff('day', cast(hire_date as date), date '2001-08-01')) as double) from fx_reps group by segment
union all select 'fact_rep_performance', q.quarter, count(*), {dsum('coalesce(booked, 0.0)', 4)} from fx_fact_quota q left join booked b on q.rep_id = b.rep_id and q.quarter = b.quarter group by q.quarter
union all select 'fact_account_pipeline', country, count(distinct a.account_id), {dsum(f'case when {OPEN} then amount else 0.0 end', 4)}
from fx_accounts a left join fx_opportunities o on a.account_id = o.account_id group by country
union all select 'fact_lead_funnel', source, count(lead_id), cast(count(*) filter (lead_score >= 70) as double) from fx_leads group by source""")
def _(lake):
    silver = {"accounts": lake.fx("accounts"), "sales_reps": lake.fx("reps"), "opportunities": lake.fx("opportunities"),
              "leads": lake.fx("leads"), "fact_quota": lake.fx("fact_quota"), "fact_sales": lake.fx("fact_sales")}
    base = scratch_path(lake.spark, "gold")
    for name, df in G.build_gold(silver, as_of=dt.date(2001, 8, 1)).items():
        for _again in range(2):  # the second write replaces the first
            sinks.write_table_overwrite(df, f"{base}/{name}")
    one = F.count(F.lit(1))

    def money(c, scale=4):
        return F.sum(F.col(c).cast(f"decimal(28,{scale})")).cast("double")

    # every table is read back: rows and a total per value of one of its columns
    read_back = {"fact_pipeline_by_stage": ("stage", F.sum("open_opps"), money("total_amount")),
                 "fact_revenue_by_quarter": ("quarter", F.sum("deals_won"), money("revenue_usd")),
                 "dim_account": ("revenue_tier", one, money("annual_revenue_usd", 2)),
                 "dim_sales_rep": ("segment", one, F.sum(F.round(F.col("tenure_years") * 365.25)).cast("double")),
                 "fact_rep_performance": ("quarter", one, money("actual")),
                 "fact_account_pipeline": ("country", one, money("open_pipeline")),
                 "fact_lead_funnel": ("source", F.sum("total_leads"), F.sum("qualified").cast("double"))}
    return readers.union_tagged({
        name: lake.spark.read.parquet(f"{base}/{name}").groupBy(F.col(key).alias("key")).agg(n.alias("n"), amount.alias("amount"))
        for name, (key, n, amount) in read_back.items()}, "gold_table")


@query("write_csv_export", """
select cast(job_instance_id as varchar) as job_instance_id, item_name, status, strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') as start_time from fx_runs""")
def _(lake):
    base = scratch_path(lake.spark, "export")
    path = sinks.write_csv_export(lake.fx("runs"), base, "runs", ["job_instance_id", "item_name", "owner", "status", "start_time"],
                                  dt.datetime(2024, 1, 31, 12))
    return lake.spark.read.option("header", True).csv(path)


@query("project_existing", "select item_name as \"Name\", status as \"Last Status\" from fx_runs")
def _(lake):
    return sinks.project_existing(lake.fx("runs"), {"item_name": "Name", "owner": "Owner", "status": "Last Status"})


@query("ingest_resumable", "select p_partkey as item_id, p_name as item_name, p_partkey % 25 as capacity_id from part")
def _(lake):
    items = lake.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), (F.col("p_partkey") % 25).alias("capacity_id"))
    target, state = scratch_path(lake.spark, "items"), scratch_path(lake.spark, "items-done")
    # a first run that stopped after some capacities, a second that resumes, a third with nothing to do
    sinks.ingest_resumable(items.where(F.col("capacity_id") < 10), target, state, "capacity_id")
    sinks.ingest_resumable(items, target, state, "capacity_id")
    sinks.ingest_resumable(items, target, state, "capacity_id")
    return sinks.read_ingested(lake.spark, target)


@query("merge_apply", f"with {STORED} select account_id, cast(parent as double) as parent, name, industry from desired")
def _(lake):
    stored, desired = accounts_pair(lake)
    root = scratch_path(lake.spark, "merge")
    keyed_table.create(stored, root, ["account_id", "parent"], buckets=16)
    # only what changes is sent: new accounts and every third one; the rest stays untouched
    part = desired.where((F.col("account_id") % 5 == 0) | (F.col("account_id") % 3 == 0))
    for _again in range(2):  # the second upsert finds nothing to do
        keyed_table.upsert(lake.spark, root, part)
    return keyed_table.read(lake.spark, root)


# -- nested records ------------------------------------------------------------------

def _end(start="start_time", seconds="duration_seconds"):
    return F.timestamp_micros(F.unix_micros(start) + F.round(F.col(seconds) * 1e6).cast("bigint"))


def iso(c, zone: str = ""):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(zone))


RAW_RUN = ("item_id bigint, item_name string, item_type string, id string, jobType string, invokeType string, status string, "
           "startTimeUtc string, endTimeUtc string, failureReason string, rootActivityId string")


def _raw_runs(lake):
    """Run records as the API sends them: the reason is an object for even ids, text for odd ones."""
    r = lake.fx("runs")
    even = F.col("job_instance_id") % 2 == 0
    base = r.select("item_id", "item_name", "item_type", F.col("job_instance_id").cast("string").alias("id"),
                    F.when(F.col("job_instance_id") % 7 != 0, F.col("invoke_type")).alias("invokeType"), "status",
                    F.when(even, iso("start_time", "Z")).otherwise(iso("start_time")).alias("startTimeUtc"),
                    iso(_end(), "Z").alias("endTimeUtc"), "failure_reason", even.alias("even"))
    objects = base.where("even").withColumn("failureReason", F.struct(F.col("failure_reason").alias("message"), F.lit(1).alias("errorCode")))
    texts = base.where("not even").withColumn("failureReason", F.nullif("failure_reason", F.lit("")))
    spark = lake.spark
    a, b = _landed(objects.drop("even", "failure_reason"), "runs-a"), _landed(texts.drop("even", "failure_reason"), "runs-b")
    return spark.read.schema(RAW_RUN).json([a, b])


@query("normalize_runs", f"""
select item_id, item_name, item_type, cast(job_instance_id as varchar) as job_instance_id, 'Unknown' as job_type,
 case when job_instance_id % 7 <> 0 then invoke_type else 'Unknown' end as invoke_type, status, {SQL_TS.format('start_time')} as start_time,
 {SQL_TS.format("start_time + to_microseconds(cast(round(duration_seconds * 1000000.0::double) as bigint))")} as end_time,
 duration_seconds, failure_reason, '' as root_activity_id
from fx_runs""")
def _(lake):
    return with_ts(N.normalize_runs(_raw_runs(lake)), "start_time", "end_time")


RAW_GATEWAY = ("id bigint, displayName string, name string, type string, capacityRegion string, publicKey string, version string, "
               "virtualNetworkAzureResource struct<region: string, vnetName: string>")


@query("normalize_inventory", f"""
select 'item' as kind, item_id as id, item_name as name, item_type as type, cast(workspace_id as varchar) as place, {MOVABILITY} as flag from fx_items
union all select 'gateway', gateway_id, gateway_name, gateway_type, region, case when gateway_id % 5 = 0 then 'Present' else 'None' end from fx_gateways
union all select 'connection', connection_id, connection_name, connection_type, gateway_id, '' from fx_connections
union all select 'domain', c_custkey, c_name, '', case when c_custkey = 0 then '' else cast(cast(floor(c_custkey / 3) as bigint) as varchar) end, '' from customer""")
def _(lake):
    spark = lake.spark

    def alternating(df, id_col, name_col):
        odd = F.col(id_col) % 2 == 1
        return df.withColumns({"id": F.col(id_col), "displayName": F.when(odd, F.col(name_col)), "name": F.when(~odd, F.col(name_col))})

    items = alternating(lake.fx("items"), "item_id", "item_name").select(
        "id", "displayName", "name", F.col("item_type").alias("type"), F.col("workspace_id").cast("string").alias("workspaceId"))
    i = N.normalize_inventory(spark.read.schema("id bigint, displayName string, name string, type string, workspaceId string").json(_landed(items, "inv")), "items")
    gw = alternating(lake.fx("gateways"), "gateway_id", "gateway_name").select(
        "id", "displayName", "name", F.col("gateway_type").alias("type"), F.when(F.col("id") % 3 != 0, F.col("region")).alias("capacityRegion"),
        F.when(F.col("id") % 5 == 0, "key").alias("publicKey"),
        F.when(F.col("id") % 3 == 0, F.struct("region")).alias("virtualNetworkAzureResource"))
    g = N.normalize_inventory(spark.read.schema(RAW_GATEWAY).json(_landed(gw, "inv")), "gateways")
    con = alternating(lake.fx("connections"), "connection_id", "connection_name").select(
        "id", "displayName", "name", F.struct(F.col("connection_type").alias("type")).alias("connectionDetails"), F.nullif("gateway_id", F.lit("")).alias("gatewayId"))
    c = N.normalize_inventory(spark.read.schema(
        "id bigint, displayName string, name string, gatewayId string, connectionDetails struct<type: string, path: string>").json(_landed(con, "inv")), "connections")
    dom = alternating(lake.fx("employees").join(lake.table("customer"), F.col("employee_id") == F.col("c_custkey")), "employee_id", "c_name").select(
        "id", "displayName", "name", F.col("manager_id").cast("string").alias("parentDomainId"))
    d = N.normalize_inventory(spark.read.schema("id bigint, displayName string, name string, parentDomainId string").json(_landed(dom, "inv")), "domains")
    out = ["id", "name", "type", "place", "flag"]
    return readers.union_tagged({
        "item": i.select("item_id", "item_name", "item_type", "workspace_id", "movability").toDF(*out),
        "gateway": g.select("gateway_id", "gateway_name", "gateway_type", "region", "public_key").toDF(*out),
        "connection": c.select("connection_id", "connection_name", "connection_type", "gateway_id", F.lit("")).toDF(*out),
        "domain": d.select("domain_id", "domain_name", F.lit(""), "parent_domain_id", F.lit("")).toDF(*out)}, "kind")


RAW_APP = ("name string, appName string, id string, appId string, state string, status string, totalDuration double, duration double, "
           "totalIdleTime double, idleTime double, efficiency double, startTime string, endTime string, startedAt string, finishedAt string, "
           "executorCores int, numExecutors int")


def _apps(lake):
    """Application records in four historic shapes, by id."""
    r = lake.fx("runs")
    k, dur = F.col("job_instance_id") % 4, F.col("duration_seconds")
    idle = dur * (F.col("job_instance_id") % 10) / F.lit(10.0)
    ident = F.col("job_instance_id").cast("string")
    shapes = [
        r.where(k == 0).select(F.col("item_name").alias("name"), ident.alias("id"), F.col("status").alias("state"), dur.alias("totalDuration"), idle.alias("totalIdleTime")),
        r.where(k == 1).select(F.col("item_name").alias("appName"), ident.alias("appId"), "status", dur.alias("duration"), idle.alias("idleTime"), F.lit(4).alias("executorCores")),
        r.where(k == 2).select(F.col("item_name").alias("name"), ident.alias("id"), F.col("status").alias("state"), idle.alias("totalIdleTime"),
                               iso("start_time", "Z").alias("startTime"), iso(_end(), "Z").alias("endTime")),
        # a duration sent as text does not count; the reported efficiency does for half of these
        r.where(k == 3).select(F.col("item_name").alias("name"), ident.alias("id"), F.col("status").alias("state"), F.concat(dur.cast("string"), F.lit("s")).alias("totalDuration"),
                               F.when(F.col("job_instance_id") % 8 == 3, F.lit(87.5)).alias("efficiency"), F.lit(2).alias("numExecutors"))]
    return N.normalize_spark_apps(lake.spark.read.schema(RAW_APP).json([_landed(s, "apps") for s in shapes]))


APPS = """
raw as (select *, job_instance_id % 4 as k, duration_seconds * (job_instance_id % 10) / 10.0::double as idle from fx_runs),
apps as (
 select item_name as notebook_name, cast(job_instance_id as varchar) as app_id, status as state, case when k <> 3 then duration_seconds end as total_duration_sec,
  case when k <> 3 then idle end as total_idle_sec,
  case when k = 3 then case when job_instance_id % 8 = 3 then 87.5::double end
   when duration_seconds > 0 then (duration_seconds - idle) / duration_seconds * 100 end as spark_efficiency_pct,
  case when k = 1 then 4.0::double end as executor_cores, case when k = 3 then 2.0::double end as executor_count from raw)"""


@query("normalize_spark_apps", f"with {APPS} select * from apps")
def _(lake):
    return _apps(lake).withColumns({c: F.col(c).cast("double") for c in ("executor_cores", "executor_count")})


@query("spark_app_tiers", f"""
with {APPS} select case when spark_efficiency_pct is null then 'no data' when spark_efficiency_pct >= 70 then 'good' when spark_efficiency_pct >= 50 then 'fair' else 'poor' end as tier,
 count(*) as apps from apps group by all""")
def _(lake):
    return R.spark_app_tiers(_apps(lake))


@query("project_resources", """
select name, type, resource_group, location, subscription_id, sku_name as sku, cast(null as varchar) as kind,
 case when id % 3 = 0 then '' else 'env=' || location || '; owner=' || resource_group end as tags, id from fx_resources""")
def _(lake):
    r = lake.fx("resources")
    tags = F.when(F.col("id") % 3 != 0, F.create_map(F.lit("env"), "location", F.lit("owner"), "resource_group"))
    raw = r.select("id", "name", "type", F.col("resource_group").alias("resourceGroup"), "location", F.col("subscription_id").alias("subscriptionId"),
                   F.struct(F.col("sku_name").alias("name")).alias("sku"), tags.alias("tags"))
    read = lake.spark.read.schema("id bigint, name string, type string, resourceGroup string, location string, subscriptionId string, "
                                  "sku struct<name: string, tier: string>, kind string, tags map<string,string>").json(_landed(raw, "resources"))
    return I.project_resources(read).withColumn("tags", S.flatten_tags("tags"))


@query("maintenance_flags", f"with {SETTINGS} select * from maintenance")
def _(lake):
    cfg = settings(lake)
    schema = ("item_id bigint, item_name string, item_type string, config struct<enabled: boolean, vOrderOptimization: struct<enabled: boolean>, "
              "unreferencedFileRetention: struct<enabled: boolean, retentionPeriod: string>, fileCompaction: struct<enabled: boolean>>")
    read = lake.spark.read.schema(schema).json(_landed(cfg, "config"))
    return maintenance_flags(read).withColumn("retention_period_days", F.col("retention_period_days").cast("double"))


# -- scalar rules over whole tables ------------------------------------------------------

@query("parse_utc", f"""
select event_id, case when event_id % 5 = 4 then null else {SQL_TS.format('ts')} end as at from events""")
def _(lake):
    k = F.col("event_id") % 5
    text = (F.when(k == 0, iso("ts", "Z")).when(k == 1, iso("ts")).when(k == 2, iso("ts", "+00:00"))
            .when(k == 3, iso("ts", "0")).otherwise("not a time"))
    return lake.table("events").select("event_id", ts_text(S.parse_utc(text)).alias("at"))


@query("duration_seconds", "select job_instance_id, duration_seconds from fx_runs")
def _(lake):
    return lake.fx("runs").select("job_instance_id", S.duration_seconds("start_time", _end()).alias("duration_seconds"))


@query("movability", f"select {MOVABILITY} as movability, {MOVABLE} as is_movable, count(*) as items from fx_items group by all")
def _(lake):
    return lake.fx("items").groupBy(S.movability("item_type").alias("movability"), S.is_movable("item_type").alias("is_movable")).agg(
        F.count(F.lit(1)).alias("items"))


@query("flatten_tags", "select event_id, case when event_id % 4 = 0 then '' else 'k=' || json_extract_string(props, '$.k') end as tags from events")
def _(lake):
    props = F.from_json("props", "map<string,string>")
    return lake.table("events").select("event_id", S.flatten_tags(F.when(F.col("event_id") % 4 != 0, props)).alias("tags"))


@query("json_prop", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(lake):
    return lake.table("events").select("event_id", S.json_prop("props", "k").alias("k"))


@query("sql_endpoint_host", "select page_id, split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) as host from pages")
def _(lake):
    return lake.table("pages").select("page_id", S.endpoint_host("url").alias("host"))


@query("truncate_text", "select doc_id, case when length(text) > 100 then substring(text, 1, 100) || '...' else text end as text from documents")
def _(lake):
    return lake.table("documents").select("doc_id", S.truncate_text("text", 100).alias("text"))


@query("pct", f"""
with {PER_ITEM}
select item_id, case when failure_count > 0 then in_progress_count::double / failure_count::double * 100 else 0.0 end as pct from per_item""")
def _(lake):
    return R._counts(lake.fx("runs")).select("item_id", S.pct("in_progress_count", "failure_count").alias("pct"))


@query("safe_ratio", f"""
with {PER_ITEM} select item_id, in_progress_count::double / nullif(failure_count, 0)::double as ratio from per_item""")
def _(lake):
    return R._counts(lake.fx("runs")).select("item_id", S.safe_ratio("in_progress_count", "failure_count").alias("ratio"))


# -- streams -----------------------------------------------------------------------------

def _stream_dirs(lake, tag):
    return [scratch_path(lake.spark, f"{tag}-{part}") for part in ("in", "out", "state")]


@query("stream_ingest_runs", f"select item_id, job_instance_id, status, {SQL_TS.format('start_time')} as start_time from fx_runs")
def _(lake):
    runs = lake.fx("runs").select("item_id", "job_instance_id", "status", "start_time")
    src, out, state = _stream_dirs(lake, "ingest")

    def feed():
        return jobs.ingest_runs(jobs.file_stream(lake.spark, src, runs.schema), "40 days")

    # first arrival: two thirds of the runs, some of them twice; then the rest with repeats of the first
    runs.where("job_instance_id % 3 <> 0").unionAll(runs.where("job_instance_id % 30 = 1")).write.parquet(src)
    jobs.run_available(feed(), out, state)
    runs.where("job_instance_id % 3 = 0").unionAll(runs.where("job_instance_id % 30 = 2")).write.mode("append").parquet(src)
    jobs.run_available(feed(), out, state)
    return with_ts(lake.spark.read.schema(runs.schema).parquet(out), "start_time")


@query("ingest_file_stream", "select p_partkey as item_id, p_name as item_name, p_partkey % 25 as capacity_id from part")
def _(lake):
    items = lake.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), (F.col("p_partkey") % 25).alias("capacity_id"))
    src, target, state = _stream_dirs(lake, "arrivals")
    # two arrivals, a run after each, and one that finds nothing
    for arrived in (F.col("capacity_id") < 10, F.col("capacity_id") >= 10, F.lit(False)):
        items.where(arrived).write.mode("append").parquet(src)
        jobs.ingest_files(jobs.file_stream(lake.spark, src, items.schema, max_files=4), target, state)
    return jobs.read_ingested_files(lake.spark, target, items.schema)


@query("stream_call_rate", f"""
with windows as (select tenant, time_bucket(interval 5 minute, call_ts) - to_minutes(cast(5 * k as bigint)) as window_start from fx_api_calls, range(0, 12) r(k)),
counted as (select window_start, window_start + interval 1 hour as window_end, tenant, count(*) as calls from windows group by all)
select {SQL_TS.format('window_start')} as window_start, {SQL_TS.format('window_end')} as window_end, tenant, calls,
 window_end <= (select max(call_ts) - interval 10 minute from fx_api_calls) as final from counted""")
def _(lake):
    calls = lake.fx("api_calls")
    src, out, state = _stream_dirs(lake, "calls")
    calls.write.parquet(src)
    jobs.run_available(jobs.call_rate(jobs.file_stream(lake.spark, src, calls.schema), "10 minutes"), out, state)
    return with_ts(jobs.all_call_rates(lake.spark, out, state), "window_start", "window_end")


@query("stream_run_health", f"""
select {SQL_TS.format("date_trunc('day', start_time)")} as day, item_id, count(*) as runs, count(*) filter ({SUCCESS}) as success_count,
 count(*) filter ({FAILED_M}) as failure_count,
 date_trunc('day', start_time) + interval 1 day <= (select max(start_time) - interval 2 hour from fx_runs) as final from fx_runs group by all""")
def _(lake):
    runs = lake.fx("runs").select("item_id", "status", "start_time")
    src, out, state = _stream_dirs(lake, "health")
    runs.write.parquet(src)
    jobs.run_available(jobs.run_health(jobs.file_stream(lake.spark, src, runs.schema), "2 hours"), out, state)
    return with_ts(jobs.all_run_health(lake.spark, out, state), "day")


@query("stream_late_runs", f"""
with ontime as (select max(start_time) as newest from fx_runs where job_instance_id % 50 <> 0)
select job_instance_id, {SQL_TS.format('start_time')} as start_time,
 (select count(*) from fx_runs, ontime where job_instance_id % 50 = 0 and start_time <= newest - interval 2 hour) as dropped_rows from fx_runs, ontime
where job_instance_id % 50 <> 0 or start_time > newest - interval 2 hour""")
def _(lake):
    runs = lake.fx("runs").select("job_instance_id", "start_time")
    src, out, state = _stream_dirs(lake, "late")
    progress = scratch_path(lake.spark, "late-progress")

    def feed():
        return jobs.ingest_runs(jobs.file_stream(lake.spark, src, runs.schema), "2 hours")

    # every 50th run arrives after all others; only those within two hours of the newest still count
    runs.where("job_instance_id % 50 <> 0").write.parquet(src)
    jobs.run_available(feed(), out, state, progress)
    runs.where("job_instance_id % 50 = 0").write.mode("append").parquet(src)
    jobs.run_available(feed(), out, state, progress)
    dropped = lake.spark.read.schema(jobs.PROGRESS).parquet(progress).agg(F.sum("dropped_rows").alias("n"))
    return with_ts(lake.spark.read.schema(runs.schema).parquet(out), "start_time").withColumn("dropped_rows", dropped.scalar())
