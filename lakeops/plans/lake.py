"""The given tables and the operational views derived from them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Declared schemas: no inference job, and timestamps are read as UTC instants.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp",
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

#: View name -> SQL that Spark and the checking engine both accept.
VIEWS = {
    "fx_runs": """
select user_id as item_id, concat('item_', user_id) as item_name,
 case when user_id % 3 = 0 then 'DataPipeline' else 'Notebook' end as item_type, event_id as job_instance_id,
 case when event_id % 4 = 0 then 'Manual' when event_id % 4 = 1 then 'OnDemand' else 'Scheduled' end as invoke_type,
 case when event_type = 'error' and user_id % 4 < 2 then 'Failed' when event_type = 'signup' then 'Succeeded'
      when event_type = 'click' and event_id % 10 = 0 and user_id % 2 = 0 then 'Cancelled'
      when event_type = 'click' and event_id % 10 = 1 and user_id % 2 = 0 then 'Deduped'
      when event_type = 'click' and event_id % 10 = 2 then 'InProgress' else 'Completed' end as status,
 ts as start_time,
 case when event_type = 'click' and event_id % 10 = 2 then cast(null as double) else value end as duration_seconds,
 case when event_type = 'error' and user_id % 4 < 2
      then concat('ERR_', cast(regexp_extract(props, '[0-9]+', 0) as int) % 7) else '' end as failure_reason
from events""",
    "fx_query_log": """
select concat('wh_', user_id % 5) as warehouse_name, concat('q_', user_id) as query_hash, event_id as statement_id,
 ts as start_time, value as data_scanned_remote_storage_mb, value * 1000 as duration_ms, event_type as status
from events""",
    "fx_request_history": """
select concat('wh_', user_id % 5) as warehouse_name, concat('q_', user_id) as query_hash, event_id as statement_id,
 ts as start_time, value * 1000 as duration_ms, concat('select ', event_type, ' where props = ', props) as query_text,
 event_id % 1000 as row_count from events""",
    "fx_accounts": """
select c_custkey as account_id, c_name as account_name, c_mktsegment as industry, n_name as country,
 c_acctbal * 1000000 as annual_revenue_usd from customer join nation on c_nationkey = n_nationkey""",
    "fx_reps": """
select s_suppkey as rep_id, s_name as full_name, r_name as region,
 case when s_suppkey % 3 = 0 then 'Enterprise' when s_suppkey % 3 = 1 then 'Commercial' else 'SMB' end as segment,
 date_add(date '2018-01-01', cast(s_suppkey as int)) as hire_date
from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "fx_opportunities": """
select o_orderkey as opportunity_id, o_custkey as account_id,
 o_orderkey % (select count(*) from supplier) as owner_id, o_totalprice as amount,
 case when o_orderstatus = 'F' then 'ClosedWon' when o_orderpriority = '5-LOW' then 'ClosedLost'
      when o_orderpriority = '1-URGENT' then 'Negotiation' when o_orderpriority = '2-HIGH' then 'Proposal'
      when o_orderpriority = '3-MEDIUM' then 'Qualification' else 'Prospecting' end as stage,
 cast(o_orderdate as date) as close_date from orders""",
    "fx_stage_probability": """
select * from (values ('Prospecting', cast(0.10 as double)), ('Qualification', cast(0.25 as double)),
 ('Proposal', cast(0.50 as double)), ('Negotiation', cast(0.75 as double)), ('ClosedWon', cast(1.00 as double)),
 ('ClosedLost', cast(0.00 as double))) as t(stage, probability)""",
    "fx_fact_sales": """
select o_orderkey as sale_id, o_orderkey as opportunity_id, o_custkey as account_id,
 o_orderkey % (select count(*) from supplier) as rep_id, o_totalprice as amount, cast(o_orderdate as date) as close_date,
 concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as quarter from orders where o_orderstatus = 'F'""",
    "fx_fact_quota": """
select s_suppkey as rep_id, q.quarter, 250000 * (1 + s_suppkey % 4) as quota_amount
from supplier cross join (select distinct concat(year(o_orderdate), 'Q', quarter(o_orderdate)) as quarter from orders) q""",
    "fx_leads": """
select event_id as lead_id, user_id % (select count(*) from supplier) as owner_id, event_type as source,
 cast(regexp_extract(props, '[0-9]+', 0) as int) as lead_score, event_id % 6 = 0 as converted,
 cast(ts as date) as created_date from events""",
    "fx_files": """
select case when doc_id % 3 = 0 then 'Warehouse' else 'Lakehouse' end as item_type, source as item_name, doc_id as file_id,
 concat(lang, '/', 'part_', doc_id % 5, '/', doc_id,
  case when doc_id % 11 = 0 then '' when doc_id % 2 = 0 then '.parquet' else '.JSON' end) as file_path,
 n_chars as size_bytes, doc_id % 7 = 0 as is_deleted,
 case when doc_id % 14 = 0 then cast(null as bigint) else doc_id % 8 end as remaining_days from documents""",
    "fx_capacities": """
select n_nationkey as capacity_id, n_name as capacity_name, concat('F', 2 * (1 + n_nationkey % 4)) as sku,
 r_name as region from nation join region on n_regionkey = r_regionkey""",
    "fx_workspaces": """
select s_suppkey as workspace_id, s_name as workspace_name, s_nationkey as capacity_id from supplier""",
    "fx_items": """
select p_partkey as item_id, p_name as item_name, p_partkey % (select count(*) from supplier) as workspace_id,
 case when (p_partkey % (select count(*) from supplier)) % 3 = 0 or p_size % 4 = 0
      then (case when p_size % 3 = 0 then 'Report' when p_size % 3 = 1 then 'SemanticModel' else 'Dashboard' end)
      when (p_partkey % (select count(*) from supplier)) % 3 = 1
      then (case when p_size % 2 = 0 then 'Lakehouse' else 'Warehouse' end)
      else (case when p_size % 3 = 0 then 'Notebook' when p_size % 3 = 1 then 'DataPipeline' else 'Lakehouse' end)
 end as item_type
from part""",
    "fx_partition_stats": """
select l_returnflag as schema_name, concat(l_returnflag, l_linestatus) as table_name,
 year(l_shipdate) * 100 + month(l_shipdate) as partition_number, count(*) as row_count
from lineitem group by l_returnflag, concat(l_returnflag, l_linestatus), year(l_shipdate) * 100 + month(l_shipdate)""",
    "fx_stats": """
select p_type as schema_name, p_brand as table_name, concat('st_', p_partkey) as stats_name, p_size * 100 as row_cnt,
 p_size * 10 * (1 + p_partkey % 10) as rows_sampled, (p_partkey % 40) * p_size as modification_counter,
 concat('2024-', lpad(concat('', 1 + p_partkey % 12), 2, '0'), '-', lpad(concat('', 1 + p_partkey % 28), 2, '0')) as last_updated from part""",
    "fx_locks": """
select o_orderkey as request_id, o_orderpriority as resource_type,
 case when o_orderkey % 2 = 0 then 'X' else 'S' end as request_mode,
 case when o_orderstatus = 'P' then 'WAIT' else 'GRANT' end as request_status,
 o_custkey % 20 as session_id, o_custkey as entity_id from orders""",
    "fx_employees": """
select c_custkey as employee_id,
 case when c_custkey = 0 then cast(null as bigint) else cast(floor(c_custkey / 3) as bigint) end as manager_id,
 c_mktsegment as department, c_acctbal as salary_usd from customer""",
    "fx_api_calls": """
select event_id as call_id, ts as call_ts, concat('tenant_', user_id % 3) as tenant,
 case when event_type = 'error' then 429 else 200 end as http_status from events""",
    "fx_resources": """
select p_partkey as id, p_name as name, concat(lower(p_type), '/', lower(replace(p_brand, '#', '')), '/', p_size % 3) as type,
 concat('rg_', p_size % 4) as resource_group, concat('loc_', p_size % 5) as location,
 concat('sub_', p_partkey % 5) as subscription_id, concat('S', p_size % 6) as sku_name from part""",
    "fx_gateways": """
select s_suppkey as gateway_id, s_name as gateway_name, concat('loc_', s_nationkey) as region,
 case when s_suppkey % 3 = 0 then 'VirtualNetwork' when s_suppkey % 3 = 1 then 'OnPremises' else 'OnPremisesPersonal' end
 as gateway_type from supplier""",
    "fx_connections": """
select p_partkey as connection_id, p_name as connection_name, p_type as connection_type,
 case when p_size % 3 = 0 then concat('gw_', p_size) else '' end as gateway_id from part""",
}

#: Spark form of a view whose SQL form multiplies tables: the quarters are one
#: short array (a few per year of data), exploded next to each rep.
SPARK_VIEWS = {
    "fx_fact_quota": """
select s_suppkey as rep_id, explode(quarters) as quarter, 250000 * (1 + s_suppkey % 4) as quota_amount
from (select s_suppkey, (select collect_set(concat(year(o_orderdate), 'Q', quarter(o_orderdate))) from orders) as quarters
      from supplier)""",
}

_WORD = re.compile(r"\b[a-z_]+\b")


class Lake:
    """Lazy access to one scale-factor folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # the tables hold UTC instants

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    def raw(self, name: str) -> DataFrame:
        """A table with the schema its own files declare."""
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def fx(self, name: str) -> DataFrame:
        """Derived view ``fx_<name>``."""
        key = f"fx_{name}"
        return self.sql(SPARK_VIEWS.get(key, VIEWS[key]))

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the raw tables it names."""
        for word in sorted(set(_WORD.findall(text)) & SCHEMAS.keys()):
            self.table(word).createOrReplaceTempView(word)
        return self.spark.sql(text)


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every derived view it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body)]
    if not used:
        return body.strip()
    ctes = ",\n".join(f"{v} as ({VIEWS[v].strip()})" for v in used)
    rest = body.strip()
    m = re.match(r"with\s+(recursive\s+)?", rest, re.I)
    if m:
        return f"with {'recursive ' if m.group(1) else ''}{ctes},\n{rest[m.end():]}"
    return f"with {ctes}\n{rest}"
