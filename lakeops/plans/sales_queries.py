"""Gold tables and sales KPIs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lakeops.functions import scalars as S
from lakeops.operators import sales as G
from lakeops.plans.registry import query
from lakeops.plans.run_queries import dsum

AS_OF = dt.date(2001, 8, 1)
OPEN = "stage not in ('ClosedWon', 'ClosedLost')"


def _silver(lake, *names):
    fx = {"accounts": "accounts", "sales_reps": "reps", "opportunities": "opportunities", "leads": "leads",
          "fact_quota": "fact_quota", "fact_sales": "fact_sales"}
    return {n: lake.fx(fx[n]) for n in names}


@query("open_opportunities", f"""
select opportunity_id, account_id, owner_id, amount, stage, cast(close_date as varchar) as close_date from fx_opportunities where {OPEN}""")
def _(lake):
    return G.open_opportunities(lake.fx("opportunities")).withColumn("close_date", F.col("close_date").cast("string"))


@query("qualified_leads", """
select lead_id, owner_id, source, lead_score, converted, cast(created_date as varchar) as created_date from fx_leads where lead_score >= 70""")
def _(lake):
    return G.qualified_leads(lake.fx("leads")).withColumn("created_date", F.col("created_date").cast("string"))


TIER = """case when annual_revenue_usd is null or annual_revenue_usd <= 0 then null when annual_revenue_usd <= 50000000 then 'SMB'
 when annual_revenue_usd <= 500000000 then 'MidMarket' when annual_revenue_usd <= 5000000000 then 'Enterprise' else 'Strategic' end"""


@query("dim_account", f"select *, {TIER} as revenue_tier from fx_accounts")
def _(lake):
    return G.dim_account(_silver(lake, "accounts"))


@query("revenue_tier", f"select {TIER} as revenue_tier, count(*) as accounts from fx_accounts group by all")
def _(lake):
    return lake.fx("accounts").groupBy(S.revenue_tier("annual_revenue_usd").alias("revenue_tier")).agg(
        F.count(F.lit(1)).alias("accounts"))


@query("dim_sales_rep", """
select rep_id, full_name, region, segment, cast(cast(hire_date as date) as varchar) as hire_date,
 date_diff('day', cast(hire_date as date), date '2024-02-01') / cast(365.25 as double) as tenure_years from fx_reps""")
def _(lake):
    out = G.dim_sales_rep(_silver(lake, "sales_reps"), as_of=dt.date(2024, 2, 1))
    return out.withColumn("hire_date", F.col("hire_date").cast("string"))


@query("tenure_years", """
select rep_id, date_diff('day', cast(hire_date as date), date '2001-08-01') / cast(365.25 as double) as tenure_years,
 round(cast(date_diff('day', cast(hire_date as date), date '2024-02-01') as decimal(18,6)) / 365.25, 1)::double as tenure_1dp from fx_reps""")
def _(lake):
    return lake.fx("reps").select(
        "rep_id", S.tenure_years("hire_date", F.lit(AS_OF)).alias("tenure_years"),
        F.round(S.tenure_years("hire_date", F.lit(dt.date(2024, 2, 1))), 1).alias("tenure_1dp"))


@query("fact_pipeline_by_stage", f"""
select stage, count(opportunity_id) as open_opps, {dsum('amount', 4)} as total_amount,
 {dsum('amount', 4)} / cast(count(amount) as double) as avg_amount from fx_opportunities where {OPEN} group by stage""")
def _(lake):
    return G.fact_pipeline_by_stage(_silver(lake, "opportunities"))


@query("fact_revenue_by_quarter", f"""
select quarter, count(sale_id) as deals_won, {dsum('amount', 4)} as revenue_usd from fx_fact_sales group by quarter order by quarter""")
def _(lake):
    return G.fact_revenue_by_quarter(_silver(lake, "fact_sales"))


BOOKED = f"booked as (select rep_id, quarter, {dsum('amount', 4)} as booked from fx_fact_sales group by all)"


@query("fact_rep_performance", f"""
with {BOOKED}
select q.rep_id, q.quarter, q.quota_amount, coalesce(booked, 0.0) as actual,
 coalesce(booked, 0.0) / nullif(cast(quota_amount as double), 0) * 100 as attainment_pct, full_name, region, segment
from fx_fact_quota q left join booked b on q.rep_id = b.rep_id and q.quarter = b.quarter left join fx_reps r on q.rep_id = r.rep_id""")
def _(lake):
    return G.fact_rep_performance(_silver(lake, "fact_quota", "fact_sales", "sales_reps"))


@query("fact_account_pipeline", f"""
select a.account_id, account_name, industry, country,
 coalesce({dsum(f'case when {OPEN} then amount end', 4)}, 0.0) as open_pipeline,
 coalesce({dsum("case when stage = 'ClosedWon' then amount end", 4)}, 0.0) as won_revenue
from fx_accounts a left join fx_opportunities o on a.account_id = o.account_id group by all""")
def _(lake):
    return G.fact_account_pipeline(_silver(lake, "accounts", "opportunities"))


@query("fact_lead_funnel", """
select source, count(lead_id) as total_leads, count(*) filter (lead_score >= 70) as qualified, count(*) filter (converted) as converted,
 cast(count(*) filter (lead_score >= 70) as double) / cast(count(lead_id) as double) * 100 as qualification_rate_pct,
 cast(count(*) filter (converted) as double) / cast(count(lead_id) as double) * 100 as conversion_rate_pct
from fx_leads group by source""")
def _(lake):
    return G.fact_lead_funnel(_silver(lake, "leads"))


def weighted_sql(keys: str, where: str = OPEN, quarter: str = "") -> str:
    k = f"{keys}, " if keys else ""
    return f"""
staged as (select {k}stage, {dsum('amount', 4)} as amount from (select *, owner_id as rep_id{quarter} from fx_opportunities) where {where} group by all),
weighted as (select {k.rstrip(', ') or "stage"}, {dsum('amount * probability', 4)} as weighted_pipeline
 from staged join fx_stage_probability using (stage) group by all)"""


@query("weighted_pipeline", f"with {weighted_sql('', OPEN + chr(32) + chr(10) + chr(32) + 'and close_date >= date ' + repr('2001-07-01'))} select * from weighted")
def _(lake):
    return G.weighted_pipeline(lake.fx("opportunities"), lake.fx("stage_probability"), dt.date(2001, 7, 1))


@query("qualified_leads_by_rep", """
select r.rep_id, full_name, count(*) as qualified_leads from fx_leads l join fx_reps r on l.owner_id = r.rep_id
where lead_score >= 70 and created_date >= date '2024-01-01' and created_date < date '2024-02-01' group by all""")
def _(lake):
    return G.qualified_leads_by_rep(lake.fx("leads"), lake.fx("reps"), dt.date(2024, 2, 1))


@query("top_accounts_open", f"""
select a.account_id, account_name, {dsum('amount', 4)} as open_value from fx_opportunities o join fx_accounts a on o.account_id = a.account_id
where {OPEN} group by all order by open_value desc, a.account_id limit 5""")
def _(lake):
    return G.top_accounts_open(lake.fx("opportunities"), lake.fx("accounts"))


@query("quota_attainment", f"""
with {BOOKED}
select rep_id, quarter, booked, quota_amount, booked / nullif(cast(quota_amount as double), 0) * 100 as attainment_pct
from booked join fx_fact_quota using (rep_id, quarter)""")
def _(lake):
    return G.quota_attainment(lake.fx("fact_sales"), lake.fx("fact_quota"))


@query("quota_hit", f"""
with {BOOKED}
select rep_id, full_name, quarter, booked, quota_amount, booked / nullif(cast(quota_amount as double), 0) as attainment
from booked join fx_fact_quota using (rep_id, quarter) join fx_reps using (rep_id)
where quarter = '2001Q2' and booked / nullif(cast(quota_amount as double), 0) >= 1.0""")
def _(lake):
    return G.quota_hit(lake.fx("fact_sales"), lake.fx("reps"), lake.fx("fact_quota"), "2001Q2")


@query("quota_grid", """
select rep_id, segment, quarter from fx_reps cross join (values ('2001Q3'), ('2001Q2'), ('2001Q1'), ('2000Q4')) q(quarter)""")
def _(lake):
    return G.quota_grid(lake.fx("reps"), AS_OF)


@query("pipeline_coverage", f"""
with {weighted_sql('rep_id, quarter', OPEN, ", concat(year(close_date), 'Q', quarter(close_date)) as quarter")}
select rep_id, quarter, weighted_pipeline, quota_amount, weighted_pipeline / nullif(cast(quota_amount as double), 0) as coverage
from weighted join fx_fact_quota using (rep_id, quarter)""")
def _(lake):
    return G.pipeline_coverage(lake.fx("opportunities"), lake.fx("stage_probability"), lake.fx("fact_quota"))


@query("win_rate", """
select segment, region, count(*) filter (stage = 'ClosedWon') as won, count(*) filter (stage = 'ClosedLost') as lost,
 cast(count(*) filter (stage = 'ClosedWon') as double)
  / nullif(cast(count(*) filter (stage in ('ClosedWon', 'ClosedLost')) as double), 0) as win_rate
from fx_opportunities join fx_reps on owner_id = rep_id group by all""")
def _(lake):
    return G.win_rate(lake.fx("opportunities"), lake.fx("reps"), ["segment", "region"])


@query("lead_count_qualified", "select count(*) filter (lead_score >= 70) as qualified_leads from fx_leads")
def _(lake):
    return G.lead_count_qualified(lake.fx("leads"))


@query("customer_orders_enriched", f"""
with lines as (select l_orderkey as order_id, count(*) as lines, {dsum('l_quantity', 4)} as quantity, {dsum('l_extendedprice', 4)} as line_total,
 {dsum('p_retailprice', 4)} as list_total from lineitem left join part on l_partkey = p_partkey group by all),
seen as (select user_id, count(*) as n from events group by all)
select o_orderkey as order_id, o_custkey as customer_id, o_totalprice as order_total, coalesce(lines, 0) as lines, quantity, line_total, list_total,
 c_name as customer_name, c_mktsegment as segment, coalesce(n, 0) as customer_events
from orders left join lines on o_orderkey = order_id left join customer on o_custkey = c_custkey left join seen on c_custkey = user_id""")
def _(lake):
    return G.customer_orders_enriched(*[lake.table(t) for t in ("customer", "orders", "lineitem", "part", "events")])


@query("quarter_label", """
select sale_id, concat(year(close_date), 'Q', quarter(close_date)) as quarter_label, quarter from fx_fact_sales""")
def _(lake):
    return lake.fx("fact_sales").select("sale_id", S.quarter_label("close_date").alias("quarter_label"), "quarter")


@query("last_quarter", """
select sale_id, concat(year(close_date - interval 3 month), 'Q', quarter(date_trunc('quarter', close_date) - interval 3 month)) as last_quarter
from fx_fact_sales""")
def _(lake):
    return lake.fx("fact_sales").select("sale_id", S.last_quarter("close_date").alias("last_quarter"))
