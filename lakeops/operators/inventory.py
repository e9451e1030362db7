"""Tenant inventory, migration assessment and cloud resources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S


def filter_by_region(capacities: DataFrame, region: str | None) -> DataFrame:
    """Capacities of a region, case ignored; ``None`` keeps all."""
    return capacities if region is None else capacities.where(F.lower("region") == region.lower())


def filter_enabled_capped(subscriptions: DataFrame, order: Sequence[str], cap: int | None = None) -> DataFrame:
    """Enabled subscriptions in a stated order; with ``cap`` the first so many."""
    enabled = subscriptions.where(F.col("state") == "Enabled").orderBy(*order)
    return enabled if cap is None else enabled.limit(cap)


def join_workspace_capacity(workspaces: DataFrame, capacities: DataFrame) -> DataFrame:
    return workspaces.join(capacities.select("capacity_id", "capacity_name", "sku", "region"), "capacity_id", "left")


def classify_items(items: DataFrame) -> DataFrame:
    return items.withColumns({"is_movable": S.is_movable("item_type"), "movability": S.movability("item_type")})


def join_items_workspace(items: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Items with their workspace and its capacity. ``workspaces`` is already joined to capacities."""
    return classify_items(items).join(
        workspaces.select("workspace_id", "workspace_name", "capacity_name", "sku", "region"), "workspace_id", "left")


def item_type_distribution(items: DataFrame) -> DataFrame:
    return classify_items(items).groupBy("item_type", "movability").agg(F.count(F.lit(1)).alias("items")).orderBy(
        F.desc("items"), "item_type")


def types_per_workspace(items: DataFrame) -> DataFrame:
    """Items per (workspace, type): all later workspace work starts from this small table."""
    return classify_items(items).where(F.col("workspace_id").isNotNull()).groupBy(
        "workspace_id", "item_type", "is_movable").agg(F.count(F.lit(1)).alias("n"))


def _types(cond: Column | None = None) -> Column:
    """Sorted types of a workspace; one entry per type, never per item."""
    c = F.col("item_type") if cond is None else F.when(cond, F.col("item_type"))
    return F.array_sort(F.collect_set(c))


def workspace_assessment(items: DataFrame, workspaces: DataFrame, target_region: str = "") -> DataFrame:
    """Movability, complexity and wave of every workspace that holds items."""
    high = F.bool_or(F.col("item_type").isin(*K.HIGH_COMPLEXITY_TYPES))
    medium = F.bool_or(F.col("item_type").isin(*K.MEDIUM_COMPLEXITY_TYPES) | ~F.col("is_movable"))
    zero = F.lit(0)
    entry = F.struct("item_type", "n")
    grouped = types_per_workspace(items).groupBy("workspace_id").agg(
        F.sum("n").alias("total_items"),
        F.coalesce(F.sum(F.when(F.col("is_movable"), F.col("n"))), zero).alias("movable_items"),
        F.coalesce(F.sum(F.when(~F.col("is_movable"), F.col("n"))), zero).alias("non_movable_items"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("item_type").isNotNull(), entry)))).alias("item_types"),
        F.array_join(_types(~F.col("is_movable")), ", ").alias("non_movable_types"),
        F.when(F.coalesce(high, F.lit(False)), "High").when(F.coalesce(medium, F.lit(False)), "Medium").otherwise("Low").alias("migration_complexity"),
    )
    blank = {c: F.lit("") for c in ("business_owner", "data_size_estimate", "external_deps", "notes")}
    known = workspaces.select("workspace_id", "workspace_name", "capacity_name", "sku", F.col("region").alias("source_region"))
    return grouped.join(known, "workspace_id", "left").withColumns({
        "target_region": F.lit(target_region), "suggested_wave": S.migration_wave("migration_complexity"), **blank})


def sort_waves(assessment: DataFrame) -> DataFrame:
    return assessment.orderBy("suggested_wave", "migration_complexity", "workspace_id")


def wave_summary(assessment: DataFrame) -> DataFrame:
    return assessment.groupBy("suggested_wave").agg(
        F.count(F.lit(1)).alias("workspaces"), F.sum("total_items").alias("items"),
        F.sum("movable_items").alias("movable_items"), F.sum("non_movable_items").alias("non_movable_items"))


def inventory_sheet(items: DataFrame, assessment: DataFrame) -> DataFrame:
    """Item rows with the assessment of their workspace."""
    ws = assessment.select("workspace_id", "workspace_name", "capacity_name", "sku", "source_region", "target_region",
                           "migration_complexity", "suggested_wave", "business_owner", "data_size_estimate", "external_deps", "notes")
    return classify_items(items).select("workspace_id", "item_id", "item_name", "item_type", "movability").join(ws, "workspace_id")


def types_intersect(items: DataFrame, wanted: Sequence[str] = K.HIGH_COMPLEXITY_TYPES) -> DataFrame:
    """Types of each workspace that are among ``wanted``."""
    have = types_per_workspace(items).groupBy("workspace_id").agg(_types().alias("types"))
    return have.select("workspace_id", F.array_sort(F.array_intersect("types", F.array(*map(F.lit, wanted)))).alias("matching"))


def missing_keys(items: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required types a workspace does not hold."""
    have = types_per_workspace(items).groupBy("workspace_id").agg(_types().alias("types"))
    return have.select("workspace_id", F.array_except(F.array(*map(F.lit, required)), "types").alias("missing"))


def distinct_types(items: DataFrame) -> DataFrame:
    """Distinct types and distinct non-movable types per workspace."""
    return types_per_workspace(items).groupBy("workspace_id").agg(
        F.count("item_type").alias("type_count"), F.array_join(_types(~F.col("is_movable")), ", ").alias("non_movable_types"))


def union_items(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# -- gateways and connections ------------------------------------------------------

def _vnet() -> Column:
    return S.contains_ignore_case("gateway_type", "VirtualNetwork")


def gateway_summary(gateways: DataFrame) -> DataFrame:
    """Gateways per kind and region."""
    kind = F.when(_vnet(), "VNet").otherwise("On-Premises")
    return gateways.groupBy(kind.alias("kind"), "region").agg(F.count(F.lit(1)).alias("gateways"))


def connection_split(connections: DataFrame) -> DataFrame:
    """Cloud and gateway-bound connections per connection type."""
    bound = F.coalesce(F.col("gateway_id"), F.lit("")) != ""
    return connections.groupBy("connection_type").agg(
        F.count(F.lit(1)).alias("connections"), F.count_if(~bound).alias("cloud"), F.count_if(bound).alias("gateway_bound"))


# -- cloud resources ------------------------------------------------------------------

def project_resources(resources: DataFrame) -> DataFrame:
    """The nine report columns, ordered by type and name."""
    return resources.select(
        "name", "type", F.col("resourceGroup").alias("resource_group"), "location", F.col("subscriptionId").alias("subscription_id"),
        F.col("sku.name").cast("string").alias("sku"), "kind", "tags", "id").orderBy("type", "name", "id")


def with_service(resources: DataFrame) -> DataFrame:
    return resources.withColumns({"service": S.provider("type"), "resource_type": S.provider_type("type")})


def resource_type_summary(resources: DataFrame) -> DataFrame:
    return with_service(resources).groupBy("service", "resource_type").agg(F.count(F.lit(1)).alias("total")).orderBy(
        F.desc("total"), "service", "resource_type")


def resource_pivot_total(resources: DataFrame, subscriptions: Sequence[str]) -> DataFrame:
    """Counts per type with one column per named subscription, and the total over all subscriptions, named or not."""
    wide = with_service(resources).groupBy("service", "resource_type").agg(
        *[F.count_if(F.col("subscription_id") == s).alias(s) for s in subscriptions], F.count(F.lit(1)).alias("TOTAL"))
    return wide.orderBy(F.desc("TOTAL"), "service", "resource_type")


def subscription_summary(subscriptions: DataFrame, resources: DataFrame, failed: DataFrame) -> DataFrame:
    """Resources, distinct types and scan status of every subscription, empty ones included."""
    counts = resources.groupBy("subscription_id").agg(
        F.count(F.lit(1)).alias("resources"), F.count_distinct("type").alias("types"))
    bad = failed.select("subscription_id").distinct().withColumn("_bad", F.lit(True))
    return subscriptions.join(counts, "subscription_id", "left").join(bad, "subscription_id", "left").fillna(
        0, ["resources", "types"]).withColumn("status", F.when(F.col("_bad"), "Error").otherwise("OK")).drop("_bad")


def top_services(resources: DataFrame, n: int = 10) -> DataFrame:
    return with_service(resources).groupBy("service").agg(F.count(F.lit(1)).alias("total")).orderBy(
        F.desc("total"), "service").limit(n)
