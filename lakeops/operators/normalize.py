"""Landed API records to flat rows with one set of names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import scalars as S


def _has(schema: T.StructType, path: str) -> bool:
    here: T.DataType = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.fieldNames():
            return False
        here = here[part].dataType
    return True


def first_present(df: DataFrame, paths: Sequence[str], default=None) -> Column:
    """First non-NULL of the fields that the schema has, else ``default``."""
    found = [F.col(p) for p in paths if _has(df.schema, p)]
    if default is not None:
        found.append(F.lit(default))
    return F.coalesce(*found) if found else F.lit(None)


#: text of a failure: an object's message, or the text itself
def failure_text(raw: Column | str) -> Column:
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.coalesce(F.when(F.ltrim(r).startswith("{"), F.get_json_object(r, "$.message")).otherwise(r), F.lit(""))


def normalize_runs(raw: DataFrame) -> DataFrame:
    """Run records to flat rows. ``failureReason`` is read as text, whether the API sent an object or a string."""
    start, end = S.parse_utc("startTimeUtc"), S.parse_utc("endTimeUtc")
    flat = raw.withColumns({"start_time": start, "end_time": end})
    return flat.select(
        "item_id", "item_name", "item_type",
        first_present(raw, ["id"], "").alias("job_instance_id"),
        first_present(raw, ["jobType"], "Unknown").alias("job_type"),
        first_present(raw, ["invokeType"], "Unknown").alias("invoke_type"),
        first_present(raw, ["status"], "Unknown").alias("status"),
        "start_time", "end_time", S.duration_seconds("start_time", "end_time").alias("duration_seconds"),
        failure_text("failureReason").alias("failure_reason"),
        first_present(raw, ["rootActivityId"], "").alias("root_activity_id"))


# Output column -> field names in order of preference, and the default.
INVENTORY_FIELDS: Mapping[str, Mapping[str, tuple[tuple[str, ...], object]]] = {
    "workspaces": {
        "workspace_id": (("id",), None), "workspace_name": (("name",), None), "workspace_type": (("type",), "Workspace"),
        "workspace_state": (("state",), "Active"), "capacity_id": (("capacityId",), ""),
    },
    "items": {
        "item_id": (("id",), None), "item_name": (("displayName", "name"), ""), "item_type": (("type",), "Unknown"),
        "workspace_id": (("workspaceId",), ""), "capacity_id": (("capacityId",), ""), "last_updated": (("lastUpdatedDate",), ""),
    },
    "gateways": {
        "gateway_id": (("id",), ""), "gateway_name": (("displayName", "name"), ""), "gateway_type": (("type",), "Unknown"),
        "region": (("capacityRegion", "virtualNetworkAzureResource.region"), ""),
        "vnet_resource_group": (("virtualNetworkAzureResource.resourceGroupName",), ""),
        "vnet_name": (("virtualNetworkAzureResource.vnetName",), ""), "subnet_name": (("virtualNetworkAzureResource.subnetName",), ""),
        "subscription_id": (("virtualNetworkAzureResource.subscriptionId",), ""),
        "number_of_member_gateways": (("numberOfMemberGateways",), None), "load_balancing_setting": (("loadBalancingSetting",), ""),
        "allow_cloud_connection": (("allowCloudDatasourceRefresh",), None), "allow_custom_connectors": (("allowCustomConnectors",), None),
        "public_key": (("publicKey",), None), "version": (("version",), ""),
    },
    "domains": {
        "domain_id": (("id",), ""), "domain_name": (("displayName", "name"), ""), "description": (("description",), ""),
        "parent_domain_id": (("parentDomainId",), ""), "contributors_scope": (("contributorsScope",), ""),
    },
    "connections": {
        "connection_id": (("id",), ""), "connection_name": (("displayName", "name"), ""), "connectivity_type": (("connectivityType",), ""),
        "connection_type": (("connectionDetails.type",), ""), "data_source_path": (("connectionDetails.path",), ""),
        "credential_type": (("credentialDetails.credentialType",), ""), "gateway_id": (("gatewayId",), ""), "privacy_level": (("privacyLevel",), ""),
    },
}


def normalize_inventory(raw: DataFrame, kind: str) -> DataFrame:
    """Inventory records of one ``kind`` to its flat columns; keys are shown as present or not, never copied."""
    cols = {out: first_present(raw, paths, default) for out, (paths, default) in INVENTORY_FIELDS[kind].items()}
    if kind == "gateways":
        key = cols["public_key"].cast("string")
        cols["public_key"] = F.when(F.length(key) > 0, "Present").otherwise("None")
    out = raw.select(*[c.alias(name) for name, c in cols.items()])
    if kind == "items":
        out = out.withColumns({"is_movable": S.is_movable("item_type"), "movability": S.movability("item_type")})
    return out


def normalize_spark_apps(raw: DataFrame) -> DataFrame:
    """Application records of any API version to one shape.

    Durations count only when numeric; otherwise end minus start. Efficiency is
    the reported one, else the share of time not idle (no idle time is 100 %).
    """
    def pick(*paths: str) -> Column:
        return first_present(raw, paths)

    spent = S.duration_seconds(
        S.parse_utc(pick("startTime", "startedAt").cast("string")), S.parse_utc(pick("endTime", "finishedAt").cast("string")))
    base = raw.select(
        first_present(raw, ["name", "appName"], "Unknown").alias("notebook_name"),
        F.coalesce(pick("id", "appId", "applicationId").cast("string"), F.lit("")).alias("app_id"),
        first_present(raw, ["state", "status"], "").alias("state"),
        F.coalesce(pick("totalDuration", "duration").cast("double"), spent).alias("total_duration_sec"),
        pick("totalIdleTime", "idleTime").cast("double").alias("total_idle_sec"),
        pick("efficiency").cast("double").alias("_given"),
        pick("totalExecutorCores", "executorCores").cast("int").alias("executor_cores"),
        pick("executorCount", "numExecutors").cast("int").alias("executor_count"))
    total, idle = F.col("total_duration_sec"), F.col("total_idle_sec")
    derived = F.when(total > 0, (total - idle) / total * 100)
    return base.withColumn("spark_efficiency_pct", F.coalesce("_given", derived)).drop("_given")
