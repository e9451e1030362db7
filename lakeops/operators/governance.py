"""Environment naming, rule matching, idempotent upserts and call budgets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators.skew import trailing_counts


def replicate_by_env(nodes: DataFrame, name: str, environments: Sequence[tuple[str, bool]]) -> DataFrame:
    """One row per node and environment; production keeps the bare name."""
    envs = F.array(*[F.struct(F.lit(e).alias("env"), F.lit(p).alias("is_prod")) for e, p in environments])
    wide = nodes.withColumn("_e", F.explode(envs)).withColumns({"env": F.col("_e.env"), "is_prod": F.col("_e.is_prod")}).drop("_e")
    return wide.withColumn("env_name", S.env_domain_name(name, "env", "is_prod"))


# Name parts and the theme they point to; the first match wins.
THEME_RULES = (
    ("finance", "finance"), ("revenue", "finance"), ("treasury", "finance"),
    ("hr", "hr"), ("people operations", "hr"), ("compensation", "hr"),
    ("retail", "retail"), ("online sales", "retail"), ("store sales", "retail"), ("sales", "retail"),
    ("marketing", "retail"), ("catalog", "retail"),
    ("telemetry", "telemetry"), ("device", "telemetry"), ("web analytics", "telemetry"),
)


def first_match_theme(df: DataFrame, name: str, rules: Sequence[tuple[str, str]] = THEME_RULES) -> DataFrame:
    """Theme of the first rule whose text the lower-case name contains; unmatched rows are dropped."""
    theme = F.coalesce(*[F.when(S.contains_ignore_case(name, part), t) for part, t in rules])
    return df.withColumn("theme", theme).where(F.col("theme").isNotNull())


def exclude_substrings(df: DataFrame, name: str, parts: Sequence[str]) -> DataFrame:
    """Rows whose name contains none of ``parts``, ignoring case."""
    return df.where(~reduce(lambda a, b: a | b, [S.contains_ignore_case(name, p) for p in parts]))


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"e.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys])


def upsert_diff(existing: DataFrame, desired: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Desired rows with the action that makes the stored state match: CREATE, UPDATE or NOOP.

    Keys compare NULL-safe, so a row without a parent matches a stored row without one. Of stored rows with one key the
    one with the smallest values counts.
    """
    stored = existing.groupBy(*keys).agg(F.min(F.struct(*values, F.lit(True).alias("_stored"))).alias("_row")).select(*keys, "_row.*")
    same = reduce(lambda a, b: a & b, [F.col(f"e.{v}").eqNullSafe(F.col(f"d.{v}")) for v in values], F.lit(True))
    action = F.when(F.col("e._stored").isNull(), "CREATE").when(same, "NOOP").otherwise("UPDATE")
    return desired.alias("d").join(stored.alias("e"), _same(keys), "left").select("d.*", action.alias("action"))


def merge_rows(existing: DataFrame, desired: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored state after the upsert: untouched rows, and of the desired rows of each key the one with the largest values."""
    others = [c for c in existing.columns if c not in keys]
    desired = desired.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_row")).select(*keys, "_row.*") if others else desired.select(*keys).distinct()
    untouched = existing.alias("e").join(desired.select(*keys).distinct().alias("d"), _same(keys), "left_anti")
    return untouched.select("e.*").unionByName(desired.select(*existing.columns))


def not_in_existing(desired: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return desired.join(existing.select(key).distinct(), key, "left_anti")


def call_rate_window(calls: DataFrame, limit: int = K.ADMIN_BUDGET[0], seconds: int = K.ADMIN_BUDGET[1]) -> DataFrame:
    """Calls of the same tenant in the trailing window at every call, judged against the budget."""
    counted = trailing_counts(calls, "tenant", "call_ts", seconds, "calls_in_window")
    used = F.col("calls_in_window") / F.lit(float(limit))
    level = F.when(used >= K.STOP_SHARE, "stop").when(used >= K.WARN_SHARE, "warn").when(used.isNotNull(), "ok")
    return counted.withColumn("level", level)
