"""Tenant inventory, migration waves, gateways, connections and cloud resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators import inventory as I
from lakeops.plans.registry import query


def _list(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


MOVABLE = f"item_type in ({_list(K.MOVABLE_TYPES)})"
HIGH = f"item_type in ({_list(K.HIGH_COMPLEXITY_TYPES)})"
MEDIUM = f"item_type in ({_list(K.MEDIUM_COMPLEXITY_TYPES)})"
MOVABILITY = f"case when {MOVABLE} then 'Movable' else 'Non-Movable' end"
WS = "ws as (select w.*, capacity_name, sku, region from fx_workspaces w left join fx_capacities c using (capacity_id))"
ASSESS = f"""
{WS},
types as (select workspace_id, item_type, count(*) as n from fx_items group by all),
grouped as (
 select workspace_id, cast(sum(n) as bigint) as total_items, cast(coalesce(sum(n) filter ({MOVABLE}), 0) as bigint) as movable_items,
  cast(coalesce(sum(n) filter (not ({MOVABLE})), 0) as bigint) as non_movable_items,
  string_agg(item_type || '=' || n, '; ' order by item_type) as item_types,
  coalesce(string_agg(item_type, ', ' order by item_type) filter (not ({MOVABLE})), '') as non_movable_types,
  case when bool_or({HIGH}) then 'High' when bool_or({MEDIUM}) or bool_or(not ({MOVABLE})) then 'Medium' else 'Low' end as migration_complexity
 from types group by workspace_id),
assessed as (
 select workspace_id, total_items, movable_items, non_movable_items, item_types, non_movable_types, migration_complexity, workspace_name,
  capacity_name, sku, region as source_region, 'WEST' as target_region,
  cast(case migration_complexity when 'Low' then 1 when 'Medium' then 2 else 3 end as int) as suggested_wave,
  '' as business_owner, '' as data_size_estimate, '' as external_deps, '' as notes from grouped left join ws using (workspace_id))"""


def _workspaces(lake):
    return I.join_workspace_capacity(lake.fx("workspaces"), lake.fx("capacities"))


def _assessment(lake):
    return I.workspace_assessment(lake.fx("items"), _workspaces(lake), "WEST").withColumn("item_types", S.flatten_tags(
        F.transform_values("item_types", lambda _, v: v.cast("string"))))


@query("filter_by_region", "select * from fx_capacities where lower(region) = 'asia'")
def _(lake):
    return I.filter_by_region(lake.fx("capacities"), "Asia")


STATE = "case when workspace_id % 4 = 0 then 'Disabled' else 'Enabled' end"


@query("filter_enabled_capped", f"""
select workspace_id, workspace_name, {STATE} as state from fx_workspaces where {STATE} = 'Enabled' order by workspace_name, workspace_id""")
def _(lake):
    subs = lake.fx("workspaces").select(
        "workspace_id", "workspace_name", F.when(F.col("workspace_id") % 4 == 0, "Disabled").otherwise("Enabled").alias("state"))
    return I.filter_enabled_capped(subs, ["workspace_name", "workspace_id"])


@query("contains_ignore_case", "select item_id, item_name, contains(lower(item_name), 'ring') as hit from fx_items")
def _(lake):
    return lake.fx("items").select("item_id", "item_name", S.contains_ignore_case("item_name", "RING").alias("hit"))


@query("join_workspace_capacity", f"with {WS} select * from ws")
def _(lake):
    return _workspaces(lake)


@query("join_items_workspace", f"""
with {WS} select i.*, {MOVABLE} as is_movable, {MOVABILITY} as movability, workspace_name, capacity_name, sku, region
from fx_items i left join ws using (workspace_id)""")
def _(lake):
    return I.join_items_workspace(lake.fx("items"), _workspaces(lake))


@query("item_type_distribution", f"select item_type, {MOVABILITY} as movability, count(*) as items from fx_items group by all")
def _(lake):
    return I.item_type_distribution(lake.fx("items"))


@query("is_movable", f"select item_id, {MOVABLE} as is_movable, {MOVABILITY} as movability from fx_items")
def _(lake):
    return I.classify_items(lake.fx("items")).select("item_id", "is_movable", "movability")


@query("workspace_assessment", f"with {ASSESS} select * from assessed")
def _(lake):
    return _assessment(lake)


@query("sort_waves", f"with {ASSESS} select workspace_id, workspace_name, migration_complexity, suggested_wave from assessed order by 4, 3, 1")
def _(lake):
    return I.sort_waves(_assessment(lake)).select("workspace_id", "workspace_name", "migration_complexity", "suggested_wave")


@query("migration_wave", f"""
with {ASSESS} select item_id, cast(case migration_complexity when 'Low' then 1 when 'Medium' then 2 else 3 end as int) as wave
from fx_items join assessed using (workspace_id)""")
def _(lake):
    ws = _assessment(lake).select("workspace_id", "migration_complexity")
    return lake.fx("items").join(ws, "workspace_id").select("item_id", S.migration_wave("migration_complexity").alias("wave"))


@query("wave_summary", f"""
with {ASSESS} select suggested_wave, count(*) as workspaces, cast(sum(total_items) as bigint) as items, cast(sum(movable_items) as bigint) as movable_items,
 cast(sum(non_movable_items) as bigint) as non_movable_items from assessed group by suggested_wave""")
def _(lake):
    return I.wave_summary(_assessment(lake))


@query("inventory_sheet", f"""
with {ASSESS} select workspace_id, item_id, item_name, item_type, {MOVABILITY} as movability, workspace_name, capacity_name, sku, source_region,
 target_region, migration_complexity, suggested_wave, business_owner, data_size_estimate, external_deps, notes
from fx_items join assessed using (workspace_id)""")
def _(lake):
    return I.inventory_sheet(lake.fx("items"), _assessment(lake))


@query("types_intersect", f"""
select workspace_id, coalesce(string_agg(distinct item_type, ', ' order by item_type) filter ({HIGH}), '') as matching from fx_items group by workspace_id""")
def _(lake):
    return I.types_intersect(lake.fx("items")).withColumn("matching", F.array_join("matching", ", "))


ALL_TYPES = ["Dashboard", "DataPipeline", "Lakehouse", "Notebook", "Report", "SemanticModel", "Warehouse"]


@query("missing_keys", f"""
select workspace_id, coalesce(string_agg(t, ', ' order by t) filter (t not in (select item_type from fx_items i where i.workspace_id = w.workspace_id)), '') as missing
from (select distinct workspace_id from fx_items) w cross join (values {', '.join(f"('{t}')" for t in ALL_TYPES)}) v(t) group by workspace_id""")
def _(lake):
    return I.missing_keys(lake.fx("items"), ALL_TYPES).withColumn("missing", F.array_join("missing", ", "))


@query("distinct_types", f"""
select workspace_id, count(distinct item_type) as type_count,
 coalesce(string_agg(distinct item_type, ', ' order by item_type) filter (not ({MOVABLE})), '') as non_movable_types from fx_items group by workspace_id""")
def _(lake):
    return I.distinct_types(lake.fx("items"))


@query("union_items", "select item_id, item_name, item_type from fx_items where item_type in ('Warehouse', 'Lakehouse', 'Notebook', 'DataPipeline')")
def _(lake):
    items = lake.fx("items").select("item_id", "item_name", "item_type")
    return I.union_items([items.where(F.col("item_type") == t) for t in ("Warehouse", "Lakehouse", "Notebook", "DataPipeline")])


@query("gateway_summary", """
select case when contains(lower(gateway_type), 'virtualnetwork') then 'VNet' else 'On-Premises' end as kind, region, count(*) as gateways
from fx_gateways group by all""")
def _(lake):
    return I.gateway_summary(lake.fx("gateways"))


@query("connection_split", """
select connection_type, count(*) as connections, count(*) filter (gateway_id = '') as cloud, count(*) filter (gateway_id <> '') as gateway_bound
from fx_connections group by connection_type""")
def _(lake):
    return I.connection_split(lake.fx("connections"))


SERVICE = "split_part(type, '/', 1) as service, substring(type, instr(type, '/') + 1) as resource_type"
SUBS = [f"sub_{i}" for i in range(5)]


@query("resource_type_summary", f"select {SERVICE}, count(*) as total from fx_resources group by all")
def _(lake):
    return I.resource_type_summary(lake.fx("resources"))


@query("resource_pivot_total", f"""
select {SERVICE}, {', '.join(f"count(*) filter (subscription_id = '{s}') as {s}" for s in SUBS)}, count(*) as TOTAL from fx_resources group by all""")
def _(lake):
    return I.resource_pivot_total(lake.fx("resources"), SUBS)


@query("subscription_summary", """
with subs as (select distinct concat('sub_', s_suppkey % 7) as subscription_id from supplier)
select s.subscription_id, count(r.id) as resources, count(distinct type) as types,
 case when s.subscription_id in ('sub_2', 'sub_6') then 'Error' else 'OK' end as status
from subs s left join fx_resources r using (subscription_id) group by s.subscription_id""")
def _(lake):
    subs = lake.table("supplier").select(F.concat(F.lit("sub_"), F.col("s_suppkey") % 7).alias("subscription_id")).distinct()
    failed = subs.where(F.col("subscription_id").isin("sub_2", "sub_6"))
    return I.subscription_summary(subs, lake.fx("resources"), failed)


@query("top_services", "select split_part(type, '/', 1) as service, count(*) as total from fx_resources group by all order by total desc, service limit 10")
def _(lake):
    return I.top_services(lake.fx("resources"))
