"""Column classification, PII scans and sensitivity labels.

Rules are small driver-side configuration, so they become expressions inside
one aggregate over the data instead of a join that multiplies its rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.functions import constants as K
from lakeops.functions import scalars as S


@dataclass(frozen=True)
class ClassificationRule:
    """A column gets ``name`` if enough values match ``value_pattern``, or its own name matches ``column_pattern``."""

    name: str
    value_pattern: str | None = None
    column_pattern: str | None = None
    min_match: float = 0.6
    #: text every match of ``value_pattern`` holds; values without it skip the pattern
    needs: str | None = None


@dataclass(frozen=True)
class LabelRule:
    label: str
    if_any: tuple[str, ...]


def employee_id_rule(domain: str | None = None) -> ClassificationRule:
    """Numbered work addresses at ``domain``; at any host where none is given."""
    host = re.escape(domain) if domain else "[a-z0-9.-]+"
    return ClassificationRule("INTERNAL_EMPLOYEE_ID", rf"^emp[0-9]+@{host}$", r"(?i)(corporate|internal).*email|employee.*email", 0.6, "@")


# Classification rules, scan patterns and label rules.
CLASSIFICATION_RULES = (
    ClassificationRule("CUSTOMER_LOYALTY_ID", r"^LOY-[0-9]{9}$", r"(?i)loyalty.*id", 0.6, "LOY-"),
    employee_id_rule(),
    ClassificationRule("HR_COMPENSATION", None, r"(?i)(salary|compensation|base_pay)", 0.8),
)
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[ -][0-9]{3}[ -][0-9]{3,4}[ -]?[0-9]{0,4}",
    "card": r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b",
    "loyalty_id": r"LOY-[0-9]{9}",
    "employee_email": r"emp[0-9]+@[a-z0-9.-]+",
}
#: text every match of a pattern holds, searched for before the pattern is tried
PII_NEEDS = {"email": "@", "loyalty_id": "LOY-", "employee_email": "@"}
LABEL_RULES = (
    LabelRule("Confidential-PII", ("CUSTOMER_LOYALTY_ID", "PERSONAL.EMAIL", "PERSONAL.PHONE_NUMBER", "GOVERNMENT.US.SOCIAL_SECURITY_NUMBER")),
    LabelRule("Highly-Confidential-Restricted", ("FINANCIAL.CREDIT_CARD_NUMBER", "HR_COMPENSATION")),
    LabelRule("Confidential-PII", ("INTERNAL_EMPLOYEE_ID",)),
)
DEFAULT_LABEL = "Internal"


def matches(value: Column | str, pattern: str, needs: str | None = None) -> Column:
    """Regular-expression match, tried only where the cheap search for ``needs`` succeeds."""
    v = F.col(value) if isinstance(value, str) else value
    return v.rlike(pattern) if needs is None else v.contains(needs) & v.rlike(pattern)


def classify_columns(name: str, df: DataFrame, rules: Sequence[ClassificationRule] = CLASSIFICATION_RULES) -> DataFrame:
    """``table_name, column_name, classification, match_ratio, by_name`` of every rule that fires.

    One scan: each (text column, value rule) pair is a conditional count.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = [(c, r) for c in df.columns for r in rules if r.column_pattern or (r.value_pattern and c in strings)]
    aggs, rows = [F.count(F.lit(1)).alias("_rows")], []
    for i, (c, r) in enumerate(pairs):
        ratio = F.lit(0.0)
        if r.value_pattern and c in strings:
            aggs += [F.count(c).alias(f"_n{i}"), F.count_if(matches(c, r.value_pattern, r.needs)).alias(f"_m{i}")]
            ratio = F.coalesce(S.safe_ratio(f"_m{i}", f"_n{i}"), F.lit(0.0))
        by_name = F.lit(c).rlike(r.column_pattern) if r.column_pattern else F.lit(False)
        rows.append(F.struct(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(r.name).alias("classification"),
            ratio.alias("match_ratio"), by_name.alias("by_name"), F.lit(r.min_match).alias("_min")))
    fired = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return fired.where((F.col("match_ratio") >= F.col("_min")) | F.col("by_name")).drop("_min")


def pii_scan(df: DataFrame, text: str, by: list[str] | None = None, patterns: Mapping[str, str] = PII_PATTERNS,
             needs: Mapping[str, str] = PII_NEEDS) -> DataFrame:
    """Rows holding each kind of personal data, per group, over the whole text."""
    hits = [F.count_if(matches(text, p, needs.get(kind))).alias(f"{kind}_rows") for kind, p in patterns.items()]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("rows"), *hits)


def auto_label(assets: DataFrame, rules: Sequence[LabelRule] = LABEL_RULES, default: str = DEFAULT_LABEL,
               mode: str = "first_match", priority: Mapping[str, int] = K.LABEL_PRIORITY) -> DataFrame:
    """Label per asset from its ``classifications`` array.

    A classification matches a rule by its whole name, or by the name without its leading (vendor) segment.
    ``first_match`` takes the first rule in order; ``highest_priority`` the most sensitive matching rule.
    """
    if mode not in ("first_match", "highest_priority"):
        raise ValueError(f"unknown mode {mode!r}")
    ordered = list(rules)
    if mode == "highest_priority":
        ordered.sort(key=lambda r: -priority[r.label])
    have = F.coalesce("classifications", F.array().cast("array<string>"))
    have = F.concat(have, F.transform(have, lambda c: F.regexp_replace(c, r"^[^.]+\.", "")))
    picks = [F.when(F.arrays_overlap(have, F.array(*map(F.lit, r.if_any))), r.label) for r in ordered]
    return assets.withColumn("label", F.coalesce(*picks, F.lit(default)))


def label_distribution(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("assets"))


def column_sensitivity(columns: DataFrame, defaults: Mapping[str, str], priority: Mapping[str, int] = K.LABEL_PRIORITY) -> DataFrame:
    """Most sensitive label per dataset; a column without its own takes the dataset default."""
    own = F.coalesce("sensitivity", S.lookup("table_name", defaults))
    ranked = columns.withColumns({"_label": own, "_p": S.lookup(own, priority)})
    return ranked.where(F.col("_p").isNotNull()).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.max_by("_label", "_p").alias("sensitivity"), F.max("_p").alias("priority"))


def dlp_gap(labelled: DataFrame, policies: DataFrame, min_priority: int = 2, priority: Mapping[str, int] = K.LABEL_PRIORITY) -> DataFrame:
    """Assets labelled at or above a priority whose label no policy names."""
    sensitive = labelled.where(S.lookup("label", priority) >= min_priority)
    return sensitive.join(policies.select("label").distinct(), "label", "left_anti")


def by_column(classified: DataFrame) -> DataFrame:
    """One row per column with its classifications; at most one per rule, so the array stays short."""
    return classified.groupBy("table_name", "column_name").agg(
        F.array_sort(F.collect_set("classification")).alias("classifications"))
