"""Gold sales tables and KPIs. Facts are aggregated to their join key before any join."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions import constants as K
from lakeops.functions import scalars as S
from lakeops.operators.skew import exact_sum

Silver = dict[str, DataFrame]

#: name -> builder of a gold table from the silver tables
GOLD: dict[str, Callable[..., DataFrame]] = {}


def register_gold(name: str):
    """Add a gold table to the registry :func:`build_gold` publishes."""

    def wrap(fn):
        GOLD[name] = fn
        return fn

    return wrap


def build_gold(silver: Silver, **options) -> dict[str, DataFrame]:
    """Lazily planned gold tables, one per registered builder."""
    return {name: fn(silver, **options) for name, fn in GOLD.items()}


def money(c: str | Column) -> Column:
    return exact_sum(F.col(c) if isinstance(c, str) else c, 4)


def _open() -> Column:
    return ~F.col("stage").isin(*K.CLOSED_STAGES)


def open_opportunities(opportunities: DataFrame) -> DataFrame:
    return opportunities.where(_open())


def qualified_leads(leads: DataFrame) -> DataFrame:
    return leads.where(F.col("lead_score") >= K.QUALIFIED_SCORE)


@register_gold("dim_account")
def dim_account(silver: Silver, **_) -> DataFrame:
    return silver["accounts"].withColumn("revenue_tier", S.revenue_tier("annual_revenue_usd"))


@register_gold("dim_sales_rep")
def dim_sales_rep(silver: Silver, as_of: dt.date, **_) -> DataFrame:
    return silver["sales_reps"].withColumn("tenure_years", S.tenure_years("hire_date", F.lit(as_of)))


@register_gold("fact_pipeline_by_stage")
def fact_pipeline_by_stage(silver: Silver, **_) -> DataFrame:
    total = money("amount")
    return open_opportunities(silver["opportunities"]).groupBy("stage").agg(
        F.count("opportunity_id").alias("open_opps"), total.alias("total_amount"),
        F.try_divide(total, F.count("amount").cast("double")).alias("avg_amount"))


@register_gold("fact_revenue_by_quarter")
def fact_revenue_by_quarter(silver: Silver, **_) -> DataFrame:
    return silver["fact_sales"].groupBy("quarter").agg(
        F.count("sale_id").alias("deals_won"), money("amount").alias("revenue_usd")).orderBy("quarter")


def _booked(sales: DataFrame) -> DataFrame:
    return sales.groupBy("rep_id", "quarter").agg(money("amount").alias("actual"))


@register_gold("fact_rep_performance")
def fact_rep_performance(silver: Silver, **_) -> DataFrame:
    """Quota rows with what was booked against them; bookings without a quota do not appear."""
    reps = silver["sales_reps"].select("rep_id", "full_name", "region", "segment")
    joined = silver["fact_quota"].join(_booked(silver["fact_sales"]), ["rep_id", "quarter"], "left").fillna({"actual": 0.0})
    rated = joined.withColumn("attainment_pct", S.safe_ratio("actual", "quota_amount") * 100)
    return rated.join(reps, "rep_id", "left")


@register_gold("fact_account_pipeline")
def fact_account_pipeline(silver: Silver, **_) -> DataFrame:
    """Open and won value per account from one pass over the opportunities."""
    zero = F.lit(0.0)
    per_account = silver["opportunities"].groupBy("account_id").agg(
        F.coalesce(money(F.when(_open(), F.col("amount"))), zero).alias("open_pipeline"),
        F.coalesce(money(F.when(F.col("stage") == "ClosedWon", F.col("amount"))), zero).alias("won_revenue"))
    accounts = silver["accounts"].select("account_id", "account_name", "industry", "country")
    return accounts.join(per_account, "account_id", "left").fillna(0.0, ["open_pipeline", "won_revenue"]).orderBy(
        F.desc("won_revenue"), "account_id")


@register_gold("fact_lead_funnel")
def fact_lead_funnel(silver: Silver, **_) -> DataFrame:
    counts = silver["leads"].groupBy("source").agg(
        F.count("lead_id").alias("total_leads"),
        F.count_if(F.col("lead_score") >= K.QUALIFIED_SCORE).alias("qualified"),
        F.count_if("converted").alias("converted"))
    return counts.withColumns({
        "qualification_rate_pct": S.safe_ratio("qualified", "total_leads") * 100,
        "conversion_rate_pct": S.safe_ratio("converted", "total_leads") * 100,
    })


# -- KPIs ---------------------------------------------------------------------

def _weighted(opportunities: DataFrame, stages: DataFrame, keys: list[str]) -> DataFrame:
    """Open value times stage probability; amounts are summed per stage before the lookup."""
    per_stage = open_opportunities(opportunities).groupBy(*dict.fromkeys([*keys, "stage"])).agg(money("amount").alias("_amount"))
    weighted = per_stage.join(stages, "stage").withColumn("_w", F.col("_amount") * F.col("probability"))
    return weighted.groupBy(*keys).agg(exact_sum(F.col("_w"), 4).alias("weighted_pipeline"))


def weighted_pipeline(opportunities: DataFrame, stages: DataFrame, from_day: dt.date | None = None) -> DataFrame:
    """Weighted open value by stage, optionally of deals closing on or after ``from_day``."""
    if from_day is not None:
        opportunities = opportunities.where(F.col("close_date") >= F.lit(from_day))
    return _weighted(opportunities, stages, ["stage"])


def qualified_leads_by_rep(leads: DataFrame, reps: DataFrame, as_of: dt.date) -> DataFrame:
    """Qualified leads per rep created in the calendar month before ``as_of``."""
    end = F.trunc(F.lit(as_of), "month")
    recent = qualified_leads(leads).where((F.col("created_date") >= F.add_months(end, -1)) & (F.col("created_date") < end))
    per_owner = recent.groupBy(F.col("owner_id").alias("rep_id")).agg(F.count(F.lit(1)).alias("qualified_leads"))
    return per_owner.join(reps.select("rep_id", "full_name"), "rep_id").orderBy(F.desc("qualified_leads"), "rep_id")


def top_accounts_open(opportunities: DataFrame, accounts: DataFrame, top: int = 5) -> DataFrame:
    """Accounts with the most open value."""
    per_account = open_opportunities(opportunities).groupBy("account_id").agg(money("amount").alias("open_value"))
    named = per_account.join(accounts.select("account_id", "account_name"), "account_id")
    return named.orderBy(F.desc("open_value"), "account_id").limit(top)


def quota_attainment(sales: DataFrame, quota: DataFrame) -> DataFrame:
    """Booked value, quota and their ratio in percent per rep and quarter with bookings."""
    return _booked(sales).withColumnRenamed("actual", "booked").join(quota, ["rep_id", "quarter"]).withColumn(
        "attainment_pct", S.safe_ratio("booked", "quota_amount") * 100)


def quota_hit(sales: DataFrame, reps: DataFrame, quota: DataFrame, quarter: str) -> DataFrame:
    """Reps that booked at least their quota in ``quarter``."""
    rated = quota_attainment(sales.where(F.col("quarter") == quarter), quota.where(F.col("quarter") == quarter))
    hit = rated.withColumn("attainment", S.safe_ratio("booked", "quota_amount")).where(F.col("attainment") >= 1.0)
    return hit.join(reps.select("rep_id", "full_name"), "rep_id").select(
        "rep_id", "full_name", "quarter", "booked", "quota_amount", "attainment").orderBy(F.desc("attainment"), "rep_id")


def quota_grid(reps: DataFrame, as_of: dt.date, quarters: int = 4) -> DataFrame:
    """Every rep next to the last ``quarters`` quarter labels; the labels are a short array per row."""
    newest = F.trunc(F.lit(as_of), "quarter")
    labels = F.array(*[S.quarter_label(F.add_months(newest, -3 * i)) for i in range(quarters)])
    return reps.select("rep_id", "segment", F.explode(labels).alias("quarter"))


def pipeline_coverage(opportunities: DataFrame, stages: DataFrame, quota: DataFrame) -> DataFrame:
    """Weighted open value over quota, per owner and closing quarter; NULL where the quota is 0."""
    opps = opportunities.select(F.col("owner_id").alias("rep_id"), "stage", "amount", S.quarter_label("close_date").alias("quarter"))
    return _weighted(opps, stages, ["rep_id", "quarter"]).join(quota, ["rep_id", "quarter"]).withColumn(
        "coverage", S.safe_ratio("weighted_pipeline", "quota_amount"))


def win_rate(opportunities: DataFrame, reps: DataFrame, by: list[str]) -> DataFrame:
    """Won over won plus lost, by attributes of the owner."""
    per_owner = opportunities.groupBy(F.col("owner_id").alias("rep_id")).agg(
        F.count_if(F.col("stage") == "ClosedWon").alias("won"), F.count_if(F.col("stage") == "ClosedLost").alias("lost"))
    return per_owner.join(reps.select("rep_id", *by), "rep_id").groupBy(*by).agg(
        F.sum("won").alias("won"), F.sum("lost").alias("lost")).withColumn(
        "win_rate", S.safe_ratio("won", F.col("won") + F.col("lost")))


def lead_count_qualified(leads: DataFrame) -> DataFrame:
    return leads.agg(F.count_if(F.col("lead_score") >= K.QUALIFIED_SCORE).alias("qualified_leads"))


def customer_orders_enriched(customers: DataFrame, orders: DataFrame, lineitem: DataFrame, parts: DataFrame,
                             events: DataFrame) -> DataFrame:
    """Order-grain fact: customer attributes, line totals, brands on the order, customer event count.

    Lines and events shrink to their join key first. The remaining joins keep one row per order, so a
    customer with very many orders is a skewed join side that adaptive execution splits.
    """
    priced = lineitem.join(parts.select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey", "left")
    lines = priced.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count(F.lit(1)).alias("lines"), money("l_quantity").alias("quantity"),
        money("l_extendedprice").alias("line_total"), money("p_retailprice").alias("list_total"))
    seen = events.groupBy(F.col("user_id").alias("customer_id")).agg(F.count(F.lit(1)).alias("customer_events"))
    people = customers.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                              F.col("c_mktsegment").alias("segment")).join(seen, "customer_id", "left")
    head = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                         F.col("o_totalprice").alias("order_total"))
    return head.join(lines, "order_id", "left").join(people, "customer_id", "left").fillna(
        0, ["lines", "customer_events"])
